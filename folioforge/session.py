"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_TEMPORARY: dict[str, str] = {}


def local_session(cores: str = "*", name: str = "folioforge", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once a session, for clusters whose workers lack it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="folioforge-"), "folioforge_pkg")
    with tempfile.TemporaryDirectory() as stage:
        shutil.copytree(root, os.path.join(stage, "folioforge"), ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", stage))
    _SHIPPED.add(app)


def _local(spark: SparkSession) -> bool:
    """Does everything run on this machine, so that its temporary folder is shared by all tasks?"""
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. A temporary one only in local mode (tests); else an error, as other machines couldn't read it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not _local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _TEMPORARY:
        _TEMPORARY[app] = tempfile.mkdtemp(prefix="folioforge-shared-")
    return _TEMPORARY[app]


def shared_folder(spark: SparkSession, name: str, *parts: str) -> str:
    """A folder of a query in the shared folder, one an application and set of arguments."""
    key = hashlib.sha1("\n".join(parts).encode()).hexdigest()[:12]
    return f"{shared_base(spark)}/{name}_{spark.sparkContext.applicationId}_{key}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_base(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() to the shared folder: survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
