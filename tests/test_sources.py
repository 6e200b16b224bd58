"""Sources, sinks and streams."""

import io
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.operators.model import OfflineModel
from folioforge.sources import files as S
from folioforge.streaming import stages as R


def docx(*paras):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paras)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_inbox_and_office_texts(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("one", "two"))
    (tmp_path / "old.docx").write_bytes(S.OLE2 + b"x")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "b.txt").write_text("text\n\n\n\nmore")
    (tmp_path / "c.exe").write_bytes(b"x")
    box = S.inbox(spark, str(tmp_path))
    assert {r.stem for r in box.collect()} == {"a", "old", "bad", "b"}
    got = {r.stem: (r.text, r.error) for r in S.office_texts(box).collect()}
    assert got == {"a": ("one\ntwo", ""), "old": (None, "old_format"), "bad": (None, "unreadable"), "b": ("text\n\nmore", "")}


def test_notes_vaults_and_logs(spark, tmp_path):
    for p in ("n/a.md", "n/.trash/b.md", "n/_x/c.md", "n/sub/d.md", "n/sub/e.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = S.notes(spark, f"{tmp_path}/n")
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["a.md", "d.md"]
    root = got.filter(F.col("path").endswith("d.md")).select(F.regexp_replace("path", "/d.md$", "").alias("root"))
    assert [r.path.rsplit("/", 1)[1] for r in S.notes(spark, f"{tmp_path}/n", root).collect()] == ["a.md"]
    (tmp_path / "v.json").write_text('{"vaults": {"k": {"path": "/a", "ts": 1}, "l": {"path": "/b", "ts": 2}}}')
    assert [r.path for r in S.vaults(spark, f"{tmp_path}/v.json").collect()] == ["/b", "/a"]
    (tmp_path / "log").write_text("[2024-01-01 00:00:00] a\n[2024-01-02 00:00:00] b\nnoise\n")
    assert [r.line for r in S.log_tail(spark, f"{tmp_path}/log", 1).collect()] == ["[2024-01-02 00:00:00] b"]


def test_chapters_replace_only_their_book(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "stem string, chapter_no int, body string")
    S.write_chapters(rows(("A", 1, "x"), ("B", 1, "y")), str(tmp_path / "c"))
    S.write_chapters(rows(("A", 1, "z")), str(tmp_path / "c"))
    assert {(r.book, r.body) for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {("A", "z"), ("B", "y")}


def test_translation_stream_resumes(spark, tmp_path):
    schema = "chapter_id long, idx long, src string"
    src, state, ckpt = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "ckpt")
    spark.createDataFrame([(1, 1, "a mill"), (1, 2, "12")], schema).coalesce(1).write.parquet(src)
    R.translate_stream(R.source(spark, src, schema, 1), state, ckpt, OfflineModel()).awaitTermination()
    spark.createDataFrame([(1, 1, "a mill"), (1, 3, "a river")], schema).coalesce(1).write.mode("append").parquet(src)
    R.translate_stream(R.source(spark, src, schema, 1), state, ckpt, OfflineModel()).awaitTermination()
    got = {(r.idx, r.status) for r in R.latest_state(spark, state).collect()}
    assert got == {(1, "translated"), (2, "dropped"), (3, "translated")}
    # A batch holds only its own rows, and one that is gone is an error, not an empty state.
    assert sorted(r.idx for r in spark.read.parquet(f"{state}/batch=1").collect()) == [1, 3]
    shutil.move(f"{state}/batch=0", f"{state}/gone")
    with pytest.raises(FileNotFoundError):
        R.latest_state(spark, state)


def test_errors_go_to_the_failed_stage(spark):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "item string, ok boolean")
    good, bad = R.split_errors(df, "ok")
    assert [r.item for r in good.collect()] == ["a"] and {(r.item, r.stage) for r in bad.collect()} == {("b", "tab4_failed"), ("c", "tab4_failed")}
