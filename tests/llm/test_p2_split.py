"""Splitting: brute force over small texts, ranges against whole texts, files against strings."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.llm import p2_split as p2


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_kind string, item_id long, text string, max_chars int, overlap_chars int")


def _text(rng, n):
    words = ["하나", "둘이", "a", "lantern", "x" * 30, "été", "끝.", "end.", "\n\n", "\n", "、", "。"]
    out = ""
    while len(out) < n:
        out += rng.choice(words) + rng.choice([" ", "", " "])
    return out[:n]


def _check(rows, text, limit, overlap):
    assert rows[0]["start"] == 0 and rows[-1]["end"] == len(text)
    for i, r in enumerate(rows):
        assert r["piece_no"] == i
        assert r["text"] == text[r["start"] : r["end"]]
        assert 0 < len(r["text"]) <= limit
        if i:
            assert r["start"] == max(0, rows[i - 1]["end"] - overlap)
            assert r["end"] > rows[i - 1]["end"]


@pytest.mark.parametrize("span", [4, 64])
def test_pieces_cover_the_text_within_the_limit(spark, monkeypatch, span):
    monkeypatch.setattr(p2, "RANGE_LIMITS", span)
    monkeypatch.setattr(p2, "BLOCK", 3)
    rng = random.Random(5)
    texts = {i: _text(rng, n) for i, n in enumerate([1, 39, 40, 41, *range(300, 345), 1777, 4000])} | {90: "z" * 900, 91: "가" * 301}
    rows = [("txt", i, t, 40, 7) for i, t in texts.items()] + [("txt", 500, None, 40, 7), ("txt", 501, "", 40, 7)]
    got = p2.split_items(p2.text_ranges(_items(spark, rows))).orderBy("item_id", "piece_no").collect()
    by = {}
    for r in got:
        by.setdefault(r["item_id"], []).append(r)
    assert set(by) == set(texts)
    for i, t in texts.items():
        _check(by[i], t, 40, 7)


def test_sizes_agree_with_brute_force_over_range_edges(spark, monkeypatch):
    monkeypatch.setattr(p2, "RANGE_LIMITS", 2)
    monkeypatch.setattr(p2, "BLOCK", 2)
    rng = random.Random(6)
    texts = {i: _text(rng, rng.randint(1, 600)) for i in range(40)} | {100: "q" * 333, 101: "ab. " + "q" * 50 + " " + "r" * 61}
    got = {r["item_id"]: r for r in p2.stitch(p2.text_ranges(_items(spark, [("txt", i, t, 20, 3) for i, t in texts.items()]))).collect()}
    for i, t in texts.items():
        assert got[i]["n_chars"] == len(t)
        run = best = 0
        for c in t:
            run = 0 if c in p2.BREAKS else run + 1
            best = max(best, run)
        assert got[i]["longest_run"] == best


def test_files_give_the_same_cover(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(p2, "RANGE_LIMITS", 3)
    monkeypatch.setattr(p2, "BLOCK", 4)
    text = _text(random.Random(7), 5000)
    path = tmp_path / "big.txt"
    path.write_text(text, encoding="utf-8")
    ranges = p2.file_ranges(spark, [(str(path), 1, path.stat().st_size)], 50, 9)
    _check(p2.split_items(ranges).orderBy("piece_no").collect(), text, 50, 9)
    size = p2.stitch(ranges).collect()[0]
    assert size["n_chars"] == len(text)


@pytest.mark.parametrize("limit, overlap", [(100, 0), (10, 0), (12, 5), (3, 1)])
def test_ranges_agree_at_marks_without_breaks(spark, monkeypatch, limit, overlap):
    """Combining marks, joiners and four-byte characters at the ranges' edges: neighbours cut at the same place."""
    rng = random.Random(limit)
    for span in (12, 64):
        monkeypatch.setattr(p2, "RANGE_LIMITS", span)
        texts = {i: "".join(rng.choice(["e\u0301", "a\u0300\u0301\u0302", "가", "x", "👩\u200d👩", "é", "ｱ"]) for _ in range(4000)) for i in range(3)}
        got = p2.split_items(p2.text_ranges(_items(spark, [("txt", i, t, limit, overlap) for i, t in texts.items()]))).orderBy("item_id", "piece_no").collect()
        for i, t in texts.items():
            _check([r for r in got if r["item_id"] == i], t, limit, overlap)


def test_bytes_of_values_and_files_give_the_same_ranges(spark, tmp_path):
    text = _text(random.Random(8), 30_000)
    path = tmp_path / "same.txt"
    path.write_text(text, encoding="utf-8")
    cols = ["range_no", "n_ranges", "at", "chunk_at", "span", "chunk"]
    a = p2.text_ranges(_items(spark, [("file", 1, text, 60, 8)])).select(*cols).orderBy("range_no").collect()
    b = p2.file_ranges(spark, [(str(path), 1, path.stat().st_size)], 60, 8).select(*cols).orderBy("range_no").collect()
    assert a == b and len(a) > 5


def test_prefers_natural_boundaries():
    text = "One sentence here. Another one follows.\n\nA new paragraph starts and goes on for a while."
    assert text[: p2.best_cut(text, 20, 50)].endswith("\n\n")
    assert text[: p2.best_cut(text, 10, 30)].endswith("here. ")


def test_empty_table_extra_columns_and_odd_limits(spark):
    empty = _items(spark, [])
    assert p2.split_items(p2.text_ranges(empty)).count() == 0
    odd = _items(spark, [("txt", 1, "abc def", 0, 9), ("txt", 2, "abc def", None, None)]).withColumn("chunk", F.lit("x")).withColumn("n_chars", F.lit(3))
    got = p2.split_items(p2.text_ranges(odd)).collect()
    assert sorted(r["text"] for r in got if r["item_id"] == 2) == ["abc def"]
    assert "".join(r["text"] for r in sorted(got, key=lambda r: r["piece_no"]) if r["item_id"] == 1) == "abc def"
