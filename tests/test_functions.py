"""Scalar functions against values derived by hand from their rules."""

import pytest
from pyspark.sql import functions as F

from folioforge.functions import biblio as B
from folioforge.functions import python as P
from folioforge.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).collect()[0]["r"]


def many(spark, rows, f, kind="string"):
    got = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in got]


def test_entity_keys(spark):
    assert many(spark, ["add_pdf_01_My Book — Ch 1.txt", "03. 윤리학 개론_ko.txt", None], T.entity_key) == ["mybook", "윤리학개론", None]


def test_clean_dates(spark):
    assert many(spark, ["2020년 3월 5일", "2019.11", "2021", "202012", "n.d.", ""], B.clean_date) == ["2020-03-05", "2019-11", "2021", "2020-12", "", ""]


@pytest.mark.parametrize(
    "chars, pct, want",
    [
        (0, 15, (2550, 4, 637, 3, "5~9", "4~6", "6~9", 6630)), (70000, 15, (10500, 15, 700, 10, "5~9", "4~6", "6~9", 27300)), (100000, 15, (15000, 21, 714, 14, "5~9", "4~6", "6~9", 39000)),
        (1000000, 15, (150000, 24, 6250, 14, "5~9", "4~6", "6~9", 64000)), (0, 5, (1650, 3, 550, 3, "5~9", "3~5", "5~8", 6000)), (0, 40, (4800, 7, 685, 5, "9~13", "7~9", "10~13", 12480)),
    ],
)
def test_length_params(spark, chars, pct, want):
    assert tuple(one(spark, chars, lambda c: T.length_params(c, F.lit(pct)), "long")) == want


def test_note_budgets(spark):
    assert [tuple(r) for r in many(spark, [1000, 500000, 1000000], T.note_budgets, "long")] == [(7, 8, 4, 16384), (14, 17, 4, 30800), (24, 30, 9, 52800)]


def test_sources(spark):
    assert many(spark, ["2412.12107v2", "10.1000/xyz", "10.1145/3442188.3445922"], B.arxiv_id) == ["2412.12107", None, None]
    assert one(spark, "https://arxiv.org/abs/2412.12107", B.safe_stem) == "arxiv.org_abs_2412.12107"
    assert one(spark, "doi:10.1145/3442188.3445922", B.source_candidates) == ["https://doi.org/10.1145/3442188.3445922"]


def test_paragraph_gate(spark):
    rows = ["[1] Smith, John. Title", "2 Methods", "3.14 is pi", "1 0 see above", "Plain text.", "12, 34 – 56%", None, " "]
    assert many(spark, rows, T.drop_paragraph) == [False] * 5 + [True] * 3
    assert many(spark, rows[:5], T.skip_paragraph) == [True] * 4 + [False]


def test_roman_health_noise_author(spark):
    assert many(spark, ["IV", "IX", "XIV"], T.roman_value) == [4, 9, 14]
    assert many(spark, ["a" * 26 + " b", "", None], T.token_health) == [0.5, 1.0, 1.0]
    assert many(spark, ["V o l . : ( 0", "a normal line of words it is"], T.vertical_noise) == [True, False]
    assert many(spark, ["Title_Jane Doe", "Title_2020", "Solo", None], T.author_from_stem) == ["Jane Doe", "", "", ""]


def test_versions(spark):
    a, b = many(spark, ["v1.0.33", "1.0.9"], T.version_parts)
    assert a > b and many(spark, ["", None], T.version_parts) == [[0], [0]]


def test_bilingual(spark):
    got = many(spark, ["[EN]\nhi\n\n[KO]\n안녕", "hi\n\n안녕", "[EN]\nhi", "one line", "", None], T.bilingual)
    assert [r and tuple(r) for r in got] == [("hi", "안녕"), ("hi", "안녕"), ("hi", ""), None, None, None]


def test_footnote_numbers(spark):
    rows = ["1. Smith, A. Old Mills, p. 3", "[12] ibid, the whole of it", "1 0 see p. 4 of the same book", "1.3.4 Numbered section of a long text", "2. Short", "3 Two\nlines p. 3", "판 1 쇄"]
    assert many(spark, rows, T.footnote_number) == [1, 12, 10, None, None, None, None]


def test_pdf_dates(spark):
    rows = ["D:20200305", "D:2020", "D:20201399", "Thu Mar  5 10:11:12 2020", "Mar 5 2020", "2020-03-05", "made in 1999 or so", "none", ""]
    assert many(spark, rows, B.pdf_date) == ["2020-03-05", "2020-01-01", "2020", "2020-03-05", "2020-03-05", "2020-03-05", "1999", "", ""]


def test_imprint(spark):
    text = "Title\n발행일: 2020년 3월 5일\n출판사: 먼 강 출판 주소 서울\n"
    assert one(spark, text, B.published) == "2020-03-05" and one(spark, text, B.publisher) == "먼 강 출판"
    assert one(spark, "nothing", B.published) == "" and one(spark, "nothing", B.publisher) == ""


def test_names(spark):
    assert many(spark, ['a/b: c*?"', "", "  "], T.note_filename) == ["a - b - c.md", "untitled.md", "untitled.md"]
    long = "word " * 20
    assert one(spark, long, lambda c: T.chapter_filename(F.lit(7), c)) == "07_" + ("word " * 12).strip() + ".md"
    assert one(spark, "..", lambda c: T.chapter_filename(F.lit(120), c)) == "120_장.md"
    assert many(spark, ["secretkey123", "short", None], T.mask_key) == ["secr…y123", "•••••", ""]


def test_yaml_and_front_matter(spark):
    assert many(spark, ["plain", 'a: "b"', " ", None], lambda c: T.yaml_line("k", c)) == ["k: plain\n", 'k: "a: \\"b\\""\n', "", ""]
    fm = one(spark, "---\ntitle: x\nbook: \"y\"\n---\n\nbody", B.frontmatter)
    assert tuple(fm) == ('title: x\nbook: "y"', "body") and one(spark, "no rule", B.frontmatter) is None
    assert one(spark, fm["fm"], lambda c: B.frontmatter_value(c, "book")) == "y"
    s = one(spark, "---\nbook: b\n---\n> **요약:** one line\n\nrest\nof it", B.summary_parts)
    assert tuple(s) == ("one line", "rest\nof it")
    assert tuple(one(spark, "all body", B.summary_parts)) == ("", "all body")


@pytest.mark.parametrize(
    "fm, rendered, want",
    [
        ("title: a\nsource: b\nmodel: m", "published: 2020\n", "title: a\nsource: b\npublished: 2020\nmodel: m"), ("title: a\nmodel: m", "published: 2020", "title: a\npublished: 2020\nmodel: m"), ("published: 1999", "published: 2020", "published: 2020"),
        ("title: a", "publisher: p\npublished: 2020\nother: x", "title: a\npublisher: p\npublished: 2020"), ("published: 1\npublished: 2\ntags: t", "published: 3\npublisher: p", "published: 3\npublished: 2\ntags: t\npublisher: p"),
        ("", "published: 2020", "published: 2020"), (None, "", ""), ("title: a", None, "title: a"), ("no key\nsummary: s\nbook: b", "source_created: c", "no key\nsummary: s\nsource_created: c\nbook: b"),
    ],
)
def test_upsert_goes_behind_or_before(spark, fm, rendered, want):
    df = spark.createDataFrame([(fm, rendered)], "fm string, r string")
    assert df.select(B.upsert_frontmatter(F.col("fm"), F.col("r")).alias("x")).collect()[0].x == want


def test_python_functions(spark):
    assert one(spark, "각", P.nfc) == "각" and one(spark, None, P.nfc) is None
    assert one(spark, "IT'S A TEST", P.english_title) == "It'S A Test"
    got = spark.createDataFrame([("abcd", "bcde"), (None, "")], "a string, b string").select(P.seq_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in got] == [0.75, 1.0]


def test_service_answers(spark):
    j = '{"message": {"title": [" A  B "], "author": [{"given": "C", "family": "D"}, {"family": "E"}], "issued": {"date-parts": [[2020, 3]]}, "publisher": "P"}}'
    assert tuple(one(spark, j, B.crossref_metadata)) == ("A B", "C D, E", "2020-03", "P")
    x = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A\n B</title><published>2024-12-17T00:00:00Z</published><author><name>C D</name></author><author><name>E</name></author></entry></feed>'
    assert tuple(one(spark, x, B.arxiv_metadata)) == ("A B", "C D, E", "2024-12-17", "arXiv")


def test_refusals_and_sentences(spark):
    assert many(spark, ["Please provide the text.", "원문을 제공해 주세요", "번역문이다.", "", None], T.asks_for_text) == [True, True, False, False, False]
    assert many(spark, ["이것은 충분히 길고 깨끗한 한국어 문장이라고 할 수 있다.", "짧다.", None], T.clean_sentence) == [True, False, False]
