from pyspark.sql import functions as F

from folioforge.functions import settings as S


def test_lookups(spark):
    ui = S.translate_ui(spark.createDataFrame([("저장",), ("x",)], "t string"), spark.createDataFrame([("저장", "Save")], "text string, shown string"), "t")
    assert {r.t: r.shown for r in ui.collect()} == {"저장": "Save", "x": "x"}
    p = spark.createDataFrame([("claude_cli", "C", ["m1"], True), ("openai", "O", ["m2", "m3"], True), ("gemini", "G", ["m4"], False)], "provider string, label string, models array<string>, usable boolean")
    assert S.engine_options(p).count() == 4
    assert tuple(S.pick_provider(p, None).collect()[0]) == ("openai", "m2") and tuple(S.pick_provider(p, "claude_cli").collect()[0]) == ("claude_cli", "m1")
    assert tuple(S.pick_provider(p.withColumn("usable", F.lit(False)), "openai").collect()[0]) == ("gemini", "m4")


def test_files(spark):
    info = spark.createDataFrame([(1, "CreationDate:   Thu Mar  5 10:11:12 2020"), (1, "Pages: 3"), (2, "ModDate: D:20210102")], "d long, l string")
    assert {r.d: (r.source_created, r.source_modified) for r in S.pdf_info_dates(info, "d", "l").collect()} == {1: ("2020-03-05", ""), 2: ("", "2021-01-02")}
    f = spark.createDataFrame([("a_01_x.md", "a"), ("a_1_x.md", "a"), ("ab_01_x.md", "a")], "n string, s string")
    assert [r.n for r in S.split_files(f, "n", "s").collect()] == ["a_01_x.md"]
    t = spark.createDataFrame([("[EN]\na\n\n[KO]\nb\n\n---\n\n[EN]\nc",), ("a\n\nb\n\n---\n\nc",), ("",)], "t string")
    assert [r.n for r in t.select(S.translated_blocks(F.col("t")).alias("n")).collect()] == [1, 1, 0]
    a, b = spark.createDataFrame([("x", "/1"), ("x", "/0")], "s string, p string"), spark.createDataFrame([("x", "/a"), ("y", "/b")], "s string, p string")
    assert {r.s: r.p for r in S.books_listing([a, b], "s", "p").collect()} == {"x": "/0", "y": "/b"}


def test_shared_folder_is_named_by_the_cluster(spark, monkeypatch):
    """A folder of this machine serves local mode only."""
    import types

    import pytest

    from folioforge import session

    fake = lambda master, base: types.SimpleNamespace(conf={"spark.checkpoint.dir": base}, sparkContext=types.SimpleNamespace(master=master, applicationId="app", getConf=lambda: {}))
    assert session.shared_base(fake("spark://host", "hdfs:///x/")) == "hdfs:///x"
    assert session.shared_folder(fake("spark://host", "hdfs:///x"), "q", "/a") != session.shared_folder(fake("spark://host", "hdfs:///x"), "q", "/b")
    with pytest.raises(ValueError):
        session.shared_base(fake("spark://host", None))
    assert session.shared_base(fake("local[2]", None)) == session.shared_base(fake("local[2]", None))
