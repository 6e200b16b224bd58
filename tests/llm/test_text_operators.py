"""Operators on documents, pages, pairs and files: fixtures, brute force and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import p1_scan_noise as p1
from folioforge.llm import p3_pairs as p3
from folioforge.llm import p5_language as p5
from folioforge.llm import p9_quality as p9
from folioforge.llm import tokenizer as tok
from folioforge.llm.boosting import BoostedTrees


# Problem 7


def _reference():
    import tiktoken

    auto = tok.BpeAutomaton.from_file(tok.vocab_path())
    return auto, tiktoken.Encoding("own", pat_str=tok.PRE_SPLIT, mergeable_ranks=auto.ranks, special_tokens={})


def test_automaton_agrees_with_a_public_encoder():
    auto, ref = _reference()
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeinrst ABle  \n\t'01가나다é日本<|>. ") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["a" * 3000, "가" * 1500, "<|endoftext|>", "  \n ", "it's I'll   x", "  a 　b", "👩‍👩‍👧 ok"]
    for t in texts:
        assert auto.encode(t) == ref.encode_ordinary(t), t
        assert auto.decode(auto.encode(t)) == t


def test_encode_rows(spark):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "Hello world", "x"), (4, "Hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in tok.encode_documents(df).collect())
    _, ref = _reference()
    ids = ref.encode_ordinary("Hello world")
    assert got == [(1, ids), (2, []), (3, []), (4, ids), (4, ids)]
    assert tok.encode_documents(df.limit(0)).count() == 0


# Problem 3


@pytest.mark.parametrize(
    "src, out, want",
    [
        ("The mill is old.", "방앗간은 오래되었다.", []), (None, "", []), ("The mill is old.", None, ["empty"]), ("The mill is old.", "  ​", ["empty"]), ("The mill is old.", "N/A", ["empty"]),
        ("The mill is old.", "방앗간은 오", ["truncated"]), ("The mill is old. It stands. It fell. It rose.", "방앗간은 오래되었다.", ["truncated"]), ("The mills", "방앗간들", []),
        ("The mill is old.", "The mill is old.", ["copy", "wrong_language"]), ("The mill is old.", "번역: THE MILL IS OLD .", ["copy", "wrong_language"]), ("The mill is old.", "Die Mühle steht am alten Fluss.", ["wrong_language"]),
        ("The mill is old.", "죄송하지만 요청하신 단락은 번역해 드릴 수 없습니다.", ["refusal"]), ("The mill is old.", "I'm sorry, but I cannot help with translating this.", ["refusal", "wrong_language"]),
        ("“Sorry, I cannot accept it,” he wrote.", '"죄송하지만 받아들일 수 없습니다"라고 적었다.', []), ("The mill is old.", "방앗간은 오래되었다 (the mill, old).", []),
    ],
)
def test_pairs(src, out, want):
    assert p3.defects_of(src, out) == want


LONG_KO = "죄송하지만 요청하신 단락은 번역해 드릴 수 없습니다. " + "다른 단락이 있으면 언제든지 다시 보내 주시기 바라며 안내해 드리겠습니다. " * 12
LONG_EN = "I'm sorry, but I cannot help with translating this paragraph. " + "There are several reasons for that, and they are explained in the terms of use. " * 8
PROSE = "방앗간은 오래되었다. 강은 마을을 지나 흐른다. " * 10


@pytest.mark.parametrize(
    "src, out, want",
    [
        ("The mill is old.", LONG_KO.strip(), "refusal"), ("The mill is old.", LONG_EN.strip(), "refusal"), ("The mill is old. " * 20, PROSE + "그는 번역할 수 없습니다라고 말하지 않았다.", None),
        ("The mill is very old and grey.", "The mill is very old and grey.\n방앗간은 아주 오래되었고 회색이다. 방앗간은 아주 오래되었고 회색이다.", "copy"), ("Mill Town is old. It is grey.", "Mill Town은 오래되었다. 회색이다.", None),
    ],
)
def test_long_refusals_and_copied_prefixes(src, out, want):
    assert (p3.defects_of(src, out) or [None])[0] == want


def test_engine_report(spark, tmp_path):
    rows = [(1, "a", "The mill.", "", "translated"), (1, "a", "The mill.", "", "translated"), (2, "a", "The mill is old.", "방앗간은 오래되었다.", "failed"), (3, "b", "The mill is old.", "방앗간은 오래되었다.", None), (4, None, "The mill is old.", None, "translated"), (5, "c", None, "", "translated"), (6, "c", "x", "", "dropped")]
    spark.createDataFrame(rows, "pair_id long, engine string, src string, out string, status string").write.parquet(f"{tmp_path}/translate_pairs.parquet")
    got = {r.engine: (r.n_pairs, r.n_defective, r.n_empty, r.n_copy) for r in p3.p3_engine_report(spark, str(tmp_path)).collect()}
    assert got == {"a": (2, 1, 1, 0), "b": (1, 0, 0, 0), "": (1, 1, 1, 0)}


def test_pairs_table(spark):
    df = spark.createDataFrame([(1, "A b c.", "", "x"), (1, "A b c.", "", "x"), (2, None, None, "y")], "pair_id long, src string, out string, defects string")
    assert [r.pair_id for r in p3.find_defects(df, ["pair_id"]).collect()] == [1, 1]
    assert p3.find_defects(df.limit(0), ["pair_id"]).count() == 0


# Problem 5


def _filters():
    rng = random.Random(2)
    words = {"en": "the of and to in house river because mother light", "de": "der die und nicht haus fluss weil mutter licht straße", "fr": "les des est pour maison rivière parce mère lumière", "es": "los las pero casa porque madre calle luz según", "ko": "집은 강은 그리고 어머니 빛이 길에서 있었다", "ja": "家は川とそして母の光が道であった"}
    return p5.LanguageFilters.train([(k, " ".join(rng.choices(v.split(), k=60)) if k != "ja" else v * 5) for k, v in words.items()])


def test_languages_of_paragraphs():
    f = _filters()
    text = "the house and the river\nbecause of light\n \t\nder fluss und die mutter nicht\n\n\n12 345\n\n집은 강은 (the house of the river and the light) 있었다"
    assert [(n, k) for n, _, k, _ in p5.classify(text, f)] == [(1, "en"), (2, "de"), (3, None), (4, "ko")]
    assert p5.classify(" \n\t\n", f) == []


def test_a_look_up_returns_all_languages_and_few_others():
    f = p5.LanguageFilters()
    rng = np.random.default_rng(3)
    keys = [rng.integers(1, 2**62, 20_000).astype(np.uint64) for _ in range(3)]
    for i, k in enumerate(keys):
        f.add(i, k)
    f.close()
    for i, k in enumerate(keys):
        assert ((f.languages(k) >> i) & 1).all()
    other = f.languages(rng.integers(1, 2**62, 50_000).astype(np.uint64))
    for i in range(3):
        assert abs(((other >> i) & 1).mean() - f.false[i]) < 0.002


@pytest.mark.parametrize("label, want", [("en-US", "en"), ("ko_KR", "ko"), ("Deutsch", "de"), (" FRA ", "fr"), ("日本語", "ja"), ("xx", None), ("", None), (None, None), ("und", None), ("Español", "es")])
def test_labels(spark, label, want):
    assert p5.label_language(label) == want
    got = spark.createDataFrame([(label,)], "label string").select(p5.label_column(F.col("label"))).collect()[0][0]
    assert got == want


def test_paragraph_offsets():
    text = "a\nb\n\n \t\nc \n　\nd\n"
    assert [text[b:e] for b, e in p5.paragraphs(text)] == ["a\nb", "c \n　\nd"]


# Problem 9


def test_boosted_trees_learn_and_are_calibrated():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 5))
    y = (x[:, 0] > 0).astype(int) + 2 * ((x[:, 1] > 0.3) & (x[:, 2] < 0)).astype(int)
    m = BoostedTrees(4, rounds=25).fit(x[:800], y[:800]).calibrate(x[800:1000], y[800:1000])
    p = m.proba(x[1000:])
    assert (p.argmax(axis=1) == y[1000:]).mean() > 0.93
    assert np.allclose(p.sum(axis=1), 1)


def test_holdout_kinds(spark, sf):
    common = p9._common(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = p9.train(docs, common)
    x = np.array([p9.statistics(t, *common) for _, t in p9.HOLDOUT])
    hit = [p9.KINDS[i] == k for i, (k, _) in zip(model.proba(x).argmax(axis=1), p9.HOLDOUT)]
    assert sum(hit) >= 0.85 * len(hit)


def test_statistics_of_odd_texts(spark, sf):
    common = p9._common(spark, sf)
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " \n", 1), (4, "word", 1), (5, "x" * 300_000, 1)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in p9.document_statistics(df, common).collect()}
    assert got[1].n_chars is None and got[2].n_chars == 0 and got[3].n_words == 0 and got[4].n_words == 1 and got[5].n_chars == 300_000
    assert p9.document_statistics(df.limit(0), common).count() == 0


# Problem 1


@pytest.mark.parametrize("line, yes", [("12", True), ("- 45 -", True), ("[13]", True), ("p. 211", True), ("l2O", True), ("xvii", True), ("12 / 99", True), ("word", False), ("CO2", False), ("15   66.1   1961", False), ("M4-7 / A1", False), ("part.", False)])
def test_page_numbers(line, yes):
    assert p1.page_number(line) is yes


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, file_id long, stem string, page_no int, field string, text string")


def test_furniture_hyphens_and_misread_words(spark):
    body = "the measurements support the old conversations and the long-term records of the river"
    rows = [(i, 1, "Quiet Mills_1", i, "txt", f"{'Quiet Mills' if i != 3 else 'Qulet Mills'}\n\n{body}\n{body}.\n{i + 40}") for i in range(1, 13)]
    rows.append((13, 1, "Quiet Mills_1", 13, "txt", f"Quiet Mills\n{body}\nthe meas-\nurements and the long-\nterm records\nthe convers@tions of the rriver\nthe old measure-\n53"))
    rows.append((14, 1, "Quiet Mills_1", 14, "txt", f"54\nments of the river\nA Chapter Title\n{body}."))
    pages = _pages(spark, rows)
    found = p1.furniture(pages)
    body_rows = p1.body_of(pages, found)
    scanned = p1.scan_words(body_rows)
    vocab = p1.word_counts(scanned)
    kinds = {(r.page_id, r.line_no, r.kind) for r in found.collect()}
    assert {(i, 5, "page_number") for i in range(1, 13)} <= kinds and (13, 8, "page_number") in kinds and (14, 1, "page_number") in kinds
    assert {(i, 1, "header") for i in range(2, 14)} <= kinds and (1, 1, "header") not in kinds and not any(k == "header" for p, _, k in kinds if p == 14)
    cuts = {(r.page_id, r.line_no): r.is_cut for r in p1.cut_words(scanned, vocab).collect()}
    assert cuts == {(13, 3): True, (13, 4): False, (13, 7): True}
    bad = {(r.page_id, r.line_no, r.word, r.fix) for r in p1.misread_words(body_rows, p1.corrections(vocab)).collect()}
    assert bad == {(13, 6, "convers@tions", "conversations")}


def test_words_of_a_line_agree_with_the_pattern():
    rng = random.Random(12)
    for _ in range(20_000):
        line = "".join(rng.choice("abé가0@!|_-'.,;:()“”\" ") for _ in range(rng.randint(0, 14)))
        assert p1.words_of(line) == p1._WORD.findall(line), line


def test_repair():
    text = "Header\nthe meas-\nurements of the convers@tions\nwent on\n\nNew line\n12"
    assert p1.repair(text, [1, 7], [2], [("convers@tions", "conversations")], None, False) == "the measurements of the conversations went on\n\nNew line"


def test_no_pages(spark):
    pages = _pages(spark, [])
    found = p1.furniture(pages)
    assert found.count() == 0 and p1.corrections(p1.word_counts(p1.scan_words(p1.body_of(pages, found)))).count() == 0


def test_anagram_difference_is_the_confusion():
    assert p1.anagram("forrnal") - p1.anagram("formal") == p1.anagram("rn") - p1.anagram("m")
