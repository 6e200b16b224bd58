"""DataFrame operators: fixtures, round trips, properties and odd tables."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.operators import chapters as C
from folioforge.operators import outline as O
from folioforge.operators import cleanup as K
from folioforge.operators import layout as L
from folioforge.operators import matching as M
from folioforge.operators import notes as N
from folioforge.operators import segment as G
from folioforge.operators import stages as Q
from folioforge.operators.model import OfflineModel, RateLimited, complete_json, lenient_json, summarise, translate_chapters, valid_answer


def pages(spark, rows):
    return spark.createDataFrame(rows, "book long, page int, text string")


def kept(spark, rows):
    return [r.s for r in K.strip_furniture(K.page_lines(pages(spark, rows), "book", "page", "text")).orderBy("page", "line_no").collect()]


def test_furniture(spark):
    assert kept(spark, [(1, 1, "Header\nalpha\n1"), (1, 2, "Header\nbeta\n2"), (1, 3, "Header\ngamma\n3")]) == ["Header", "alpha", "beta", "gamma"]
    assert kept(spark, [(1, 1, "X"), (1, 2, "X")]) == ["X"]  # both edges of a short page count
    assert kept(spark, [(1, 1, "a\n\nb"), (1, 2, None)]) == ["a", "", "b"]
    assert kept(spark, []) == []


def test_reflow(spark):
    df = spark.createDataFrame([("coop-\neration works\nHigh-\nLevel\n\nSecond",), ("",), (None,)], "t string")
    assert [r.r for r in df.select(K.reflow(F.col("t")).alias("r")).collect()] == ["cooperation works High-Level\n\nSecond", "", None]


def test_form_feeds(spark):
    df = spark.createDataFrame([(1, "Head\none\f\nHead\ntwo\fHead\nthree")], "id long, t string")
    assert K.clean_form_feeds(df, "id", "t").collect()[0].text.split("\n\n")[0].startswith("Head one")


def test_merge_dangling(spark):
    paras = ["This is a sentence that", "continues here.", "# Title", "Next para."]
    got = spark.createDataFrame([(paras,)], "p array<string>").select(G.merge_dangling(F.col("p")).alias("m")).collect()[0].m
    assert got == ["This is a sentence that continues here.", "# Title", "Next para."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "two words.", "A sentence that goes on for a while and ends.", "\n", "\n\n"]), max_size=80))
def test_paragraphs_hold_the_text(parts):
    text = " ".join(parts)
    got = G.split_text(text, 120, 2)
    words = [w for p in got for w in p.split()]
    source = text.split()
    at = iter(source)
    assert all(w in at for w in words)  # in order, nothing twice


def test_footnotes_and_sections(spark):
    rows = [(1, i, f"This is paragraph {i} of the text and it is long enough.") for i in range(20)]
    rows += [(1, 20 + k, f"{k}. Brown, A. Old Mills, p. {k}") for k in (1, 2, 3)]
    rows += [(2, i, f"{i + 1}. Brown, A. Old Mills, p. 3") for i in range(4)]  # dense from the start: no notes
    df = spark.createDataFrame(rows, "d long, idx int, t string")
    assert sorted(r.idx for r in G.sequential_footnotes(df, "d", "idx", "t").collect()) == [21, 22, 23]
    rows = [(1, 0, "text"), (1, 1, "## References"), (1, 2, "a"), (1, 3, "## Glossary"), (1, 4, "b")]
    rows += [(2, i, "n" * 450 if i < 50 else "short") for i in range(60)]
    df = spark.createDataFrame(rows, "d long, idx int, t string")
    got = {(r.d, r.idx) for r in G.skipped_sections(df, "d", "idx", "t").collect()}
    assert got == {(1, 1), (1, 2)} | {(2, i) for i in range(50, 60)}


def test_min_gap(spark):
    df = spark.createDataFrame([([(0,), (1000,), (1600,), (3000,), (3200,)],)], "m array<struct<pos:int>>")
    assert [x.pos for x in df.select(G.min_gap(F.col("m"), 1500).alias("m")).collect()[0].m] == [0, 1600, 3200]


# Chapters


def _body(rng, n):
    return " ".join(rng.choice(["mill", "river", "old", "harbour", "letters", "winter"]) for _ in range(n)) + "."


def test_numbered_headings_round_trip():
    rng = random.Random(1)
    bodies = [_body(rng, 300) for _ in range(5)]
    text = "".join(f"Chapter {i}: Mills and Rivers\n{b}\n" for i, b in enumerate(bodies, 1))
    mode, got = O.split_text(text)
    assert mode == "numbered" and [b.split("\n", 1)[1] for _, b in got] == bodies and got[0][0] == "1. Mills and Rivers"


def test_korean_chapters_and_running_heads():
    rng = random.Random(2)
    text = "1장 강의 시작 1\n2장 강의 끝 9\n" + "".join(f"제 {i} 장 강 이야기\n" + _body(rng, 400) + f"\n{i}장 강 이야기 2{i}\n" + _body(rng, 300) + "\n" for i in range(1, 5))
    mode, got = O.split_text(text)
    assert mode == "numbered" and len(got) == 4


def test_markdown_headings():
    rng = random.Random(3)
    md = "".join(f"## Part {c}\n\n{_body(rng, 600)}\n\n" for c in "ABCD") + "## References\n\nx"
    mode, got = O.split_text(None, md)
    assert mode == "heading" and [t for t, _ in got] == ["Part A", "Part B", "Part C", "Part D"]
    assert O.by_headings("no heads at all") is None


def test_contents_lists():
    rng = random.Random(4)
    names = ["Early Cathedrals", "Quiet Lanterns", "Northern Bridges"]
    toc = "".join(f"{i}. {t} {i * 9}\n" for i, t in enumerate(names, 1))
    text = toc + "\n" + _body(rng, 100) + "\n" + "".join(f"{t.upper()}\n{_body(rng, 400)}\n" for t in names)
    got = O.by_contents(text)
    assert got and [b.split("\n")[0] for _, b in got] == [t.upper() for t in names]
    roman = "".join(f"{r}. {t} ........ {i * 9}\n" for i, (r, t) in enumerate(zip(("I", "II", "III"), names), 1)) + _body(rng, 60) + "\n" + "".join(f"{r}. {t}\n{_body(rng, 400)}\n" for r, t in zip(("I", "II", "III"), names))
    assert [t for t, _ in O.by_contents(roman)] == ["I. Early Cathedrals", "II. Quiet Lanterns", "III. Northern Bridges"]
    assert O.roman_contents(roman.replace("II. Quiet Lanterns ...", "V. Quiet Lanterns ...", 1)) == []


def test_titles_are_located_with_slips():
    rng = random.Random(5)
    text = "Early Winters\nHarbour Letters\n" + _body(rng, 900) + "\n" + "Earlv Winters\n" + _body(rng, 600) + "\nHarbour  Lettcrs\n" + _body(rng, 600)
    got = O.locate_titles(text, ["Early Winters", "Harbour Letters", "Absent Title"])
    assert [text[p:].split("\n")[0] for p, _ in got] == ["Earlv Winters", "Harbour  Lettcrs"]


def test_bookmarks_on_pages():
    rng = random.Random(6)
    text = "\f".join(_body(rng, 400) for _ in range(6))
    got = O.by_bookmarks(text, [("A", 0, 0), ("sub", 1, 1), ("B", 2, 0), ("C", 4, 0), ("out", 99, 0)])
    assert [t for t, _ in got] == ["1. A", "2. B", "3. C"]
    assert O.by_bookmarks(text, [("A", 0, 0), ("B", 2, 0)]) is None


def test_split_books_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "short text", "x")], "book long, text string, mode string")
    assert [(r.book, r["mode"], r.body) for r in C.split_books(df, "book", "text").collect()] == [(3, "single", "short text")]
    marks = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, " ", 0), (1, "c", 0), (1, "d", 0), (2, "x", 0)], "doc long, title string, level int")
    assert sorted(r.title for r in C.top_bookmarks(marks, "doc").collect()) == ["a", "c", "d"]


# Layout: top-origin boxes on a page of 200 x 100


def glyphs(*boxes):
    return [(i, ch, float(x0), float(100 - y1), float(x1), float(100 - y0)) for i, (ch, x0, y0, x1, y1) in enumerate(boxes)]


def word(text, x, y, w=10, h=10):
    return [(c, x + i * w, y, x + i * w + w, y + h) for i, c in enumerate(text)]


def feed():
    return [("\n", 0, 0, 0, 0)]


def lines(raw):
    got, mh, mw = L.glyphs_of(100, raw)
    rows = L.rows_of(got, mh)
    return [L.row_text(r, L.space_gap(rows, mw)) for r in rows], got


def test_a_flat_initial_moves_to_its_word():
    text, got = lines(glyphs(*word("end", 0, 10), *feed(), ("A", 80, 10, 80, 10), *word("uthor", 10, 40)))
    assert text == ["end", "Author"]
    a = next(g for g in got if g.ch == "A")
    assert a.repaired and a.x0 == 10


def test_an_outlying_word_start_moves():
    text, got = lines(glyphs(*word("Introd", 0, 5), *word("uction", 60, 40), ("s", 120, 40, 130, 50)))
    assert sum(g.repaired for g in got) >= 6 and len(text) == 1


def test_the_last_glyph_uses_the_one_before():
    text, got = lines(glyphs(*word("ab", 0, 10), ("X", 150, 80, 150, 80)))
    assert text == ["abX"] and got[-1].x0 == 20


def test_no_repair_across_raw_lines():
    _, got = lines(glyphs(("A", 80, 10, 80, 10), *feed(), *word("bc", 0, 40)))
    assert not got[0].repaired and got[0].x0 == 80


def test_flat_space_and_hyphens():
    assert lines(glyphs(*word("j", 0, 10), (" ", 40, 90, 40, 90), *word("u", 20, 10)))[0] == ["j u"]
    assert lines(glyphs(*word("benefi", 0, 10), ("￾", 60, 10, 61, 20)))[0] == ["benefi-"]
    assert lines(glyphs(*word("educa", 0, 10), ("￾", 50, 10, 51, 20), *word("tional", 52, 10)))[0] == ["educational"]
    assert lines(glyphs(*word("가", 0, 10), ("￾", 10, 10, 11, 20), *word("나", 12, 10)))[0] == ["가 나"]


def test_gap_statistics():
    _, got = lines(glyphs(*word("ab", 0, 10)))
    assert L.space_gap([got], 10) == 2.5


def test_two_columns_are_read_one_after_the_other(spark):
    rows = []
    for i in range(6):
        rows += [*word(f"left{i}", 0, 10 + 14 * i, 6), *feed(), *word(f"right{i}", 120, 10 + 14 * i, 6), *feed()]
    raw = [(i, ch, a, b, c, e) for i, ch, a, b, c, e in glyphs(*rows)]
    text = L.reading_order(200, 100, raw)
    assert [x for x in text.split("\n") if x] == [f"left{i}" for i in range(6)] + [f"right{i}" for i in range(6)]
    df = spark.createDataFrame([(1, 1, 200.0, 100.0, *r) for r in raw] + [(1, 2, 200.0, None, 0, "a", 0.0, 0.0, 1.0, 1.0)], "doc_id long, page_no int, width double, height double, idx int, ch string, `left` double, bottom double, `right` double, top double")
    got = {r.page_no: r for r in L.read_pages(df).collect()}
    assert got[1].text == text and got[1].ok


def test_glyph_kinds(spark):
    df = spark.createDataFrame([("a",), (" ",), ("\n",), ("￾",), ("　",), ("\x07",)], "c string")
    assert [r.k for r in df.select(L.glyph_kind(F.col("c")).alias("k")).collect()] == ["", "space", "drop", "broken", "space", "drop"]


# Matching


def test_entity_links(spark):
    notes = spark.createDataFrame([(1, ["mybook"]), (2, ["absent", "윤리학개론"]), (3, ["thequietmillsofthenorth"]), (4, ["nothingalike"]), (5, [])], "id long, c array<string>")
    src = spark.createDataFrame([("mybook",), ("윤리학개론",), ("thequietmilsofthenorth",), ("zzzzzzzz",), ("",), (None,)], "key string")
    got = {r.id: (r.key, r.how) for r in M.link_entities(notes, src, "id", "c", "key").collect()}
    assert got == {1: ("mybook", "exact"), 2: ("윤리학개론", "exact"), 3: ("thequietmilsofthenorth", "fuzzy")}


def test_fuzzy_blocks_lose_no_pair(spark):
    import difflib

    rng = random.Random(8)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 14))) for _ in range(60)]
    damaged = [w[: len(w) // 2] + rng.choice("abcdefg") + w[len(w) // 2 + rng.randint(0, 1) :] for w in words]
    notes = spark.createDataFrame([(i, [w]) for i, w in enumerate(damaged)], "id long, c array<string>")
    keys = spark.createDataFrame([(w,) for w in words], "key string")
    got = {r.id for r in M.link_entities(notes, keys, "id", "c", "key").collect()}
    want = {i for i, w in enumerate(damaged) if any(k == w or difflib.SequenceMatcher(None, k, w).ratio() >= 0.88 for k in words)}
    assert got == want


def test_citations_and_preferences(spark):
    q = spark.createDataFrame([(1, "“the old mill (1900)”"), (1, "the new mill"), (2, "the old mill"), (1, None)], "d long, q string")
    t = spark.createDataFrame([(1, "Here stood the old\nmill, once.")], "d long, t string")
    got = {(r.d, r.q): r.verified for r in M.verify_citations(q, t, "d", "q", "t").collect()}
    assert got == {(1, "“the old mill (1900)”"): True, (1, "the new mill"): False, (2, "the old mill"): False, (1, None): False}
    base = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    a, b = spark.createDataFrame([(1, "a"), (2, "")], "k long, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k long, v string")
    assert {r.k: r.x for r in M.prefer(base, ["k"], [(a, "v"), (b, "v")], "x").collect()} == {1: "a", 2: "b", 3: None}


# Stages


def items(spark, rows):
    return spark.createDataFrame(rows, "stage string, item string, seq long")


def test_queue(spark):
    q = Q.queue_add(items(spark, []), items(spark, [("s", "a", 1), ("s", "b", 2), ("s", "a", 3)]))
    assert [r.item for r in Q.queue_list(q, "s").collect()] == ["a", "b"]
    q = Q.queue_remove(q, items(spark, [("s", "a", 0)]))
    assert [r.item for r in Q.queue_list(q, "s").collect()] == ["b"]
    assert Q.queue_clear(q, "s").count() == 0


def test_states(spark):
    state = spark.createDataFrame([(1, 1, "a", "x", "translated"), (1, 2, "b", None, "failed"), (1, 3, "old", "y", "translated")], "chapter_id long, idx long, src string, tgt string, status string")
    paras = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "new"), (1, 4, "12"), (1, 5, "[1] Smith, John. Title")], "chapter_id long, idx long, src string")
    assert sorted(r.idx for r in Q.unfinished(paras, state).collect()) == [2, 3, 4, 5]
    new = {r.idx: (r.src, r.status) for r in translate_chapters(paras, state, OfflineModel()).collect()}
    assert new == {1: ("a", "translated"), 2: ("b", "translated"), 3: ("new", "translated"), 4: ("12", "dropped"), 5: ("[1] Smith, John. Title", "preserved")}
    counts = Q.status_counts(state, "chapter_id").collect()[0]
    assert (counts.n_translated, counts.n_failed, counts.n) == (2, 1, 3)


def test_model_answers(spark):
    assert valid_answer("The old mill.", "오래된 방앗간.") and not valid_answer("The old mill.", "The old mill.") and not valid_answer("x", "") and not valid_answer("x", "원문을 제공해 주세요")
    assert lenient_json('```json\n{"a": 1}\n```') == {"a": 1} and lenient_json('so {"a": 2} it is') == {"a": 2}

    class Busy:
        def __init__(self):
            self.calls = 0

        def complete(self, system, prompt, max_tokens):
            self.calls += 1
            if self.calls < 3:
                raise RateLimited
            return '{"ok": true}'

    waits = []
    assert complete_json(Busy(), "", "", 1, waits.append) == {"ok": True} and waits == [65, 65]
    df = spark.createDataFrame([(1, "One. Two. Three."), (2, None)], "k long, t string")
    assert {r.k: r.summary for r in summarise(df, "k", "t", OfflineModel()).collect()} == {1: "One. Two.", 2: None}


def test_waiting_for_a_provider(spark):
    """Limited rows are asked for again after a wait on the driver, the others aren't; what stays limited is reported."""
    from folioforge.operators.model import ask_json, with_waits

    class Limited:
        def __init__(self, free):
            self.free = free

        def complete(self, system, prompt, max_tokens):
            if prompt.startswith("x") and not self.free:
                raise RateLimited
            return "no json" if prompt == "bad" else '{"a": "%s", "tags": ["t"]}' % prompt

    df = spark.createDataFrame([(1, "x1"), (2, "y"), (3, "bad"), (4, None), (5, " ")], "k long, p string")
    waits = []
    got = with_waits(lambda rows: ask_json(rows, "k", "p", Limited(bool(waits)), ("a", "tags")), df, "k", waits.append)
    assert sorted((r.k, r.status, r.a) for r in got.collect()) == [(1, "done", "x1"), (2, "done", "y"), (3, "failed", None), (4, "failed", None), (5, "failed", None)]
    assert waits == [65] and {r.tags for r in got.collect()} == {'["t"]', None}
    never = with_waits(lambda rows: ask_json(rows, "k", "p", Limited(False), ("a",), ("a",)), df, "k", lambda _: None, 2)
    assert {r.k: r.status for r in never.collect()} == {1: "limited", 2: "done", 3: "failed", 4: "failed", 5: "failed"}


def test_glossary_of_a_translation(spark):
    from folioforge.operators.model import translate_rows, translate_system

    pairs = [(f"n{i}", f"이름{i}") for i in range(100)]
    assert translate_system() == "translate" and "n20 = 이름20" in translate_system(pairs) and "n19 =" not in translate_system(pairs)

    class Named:
        def complete(self, system, prompt, max_tokens):
            return "오래된 방앗간 이름99" if "n99 = 이름99" in system else None

    df = spark.createDataFrame([(1, "The old mill n99."), (2, None)], "k long, src string")
    assert {r.k: (r.tgt, r.status) for r in translate_rows(df, ["k"], "src", Named(), pairs).collect()} == {1: ("오래된 방앗간 이름99", "translated"), 2: (None, "failed")}
    assert {r.status for r in translate_rows(df, ["k"], "src", Named()).collect()} == {"failed"}


def test_overviews_and_book_notes_of_odd_rows(spark):
    from folioforge.operators import books as B

    sections = spark.createDataFrame([("a_Jane Doe", 2, "Two", "s2"), ("a_Jane Doe", 1, None, "s1"), ("b", 1, "x", None), ("c", 1, "x", " ")], "book string, no long, title string, summary string")
    texts = spark.createDataFrame([("a_Jane Doe", "One. Two. Three. Four."), ("a_Jane Doe", "short"), ("z", None)], "book string, text string")
    prompts = B.overview_prompts(sections, texts, "book", "no", "title", "summary", "text")
    assert [r.prompt for r in prompts.collect()] == ["1. : s1\n2. Two: s2\n\nOne. Two. Three. Four.\n…\nOne. Two. Three. Four."]
    o = B.overviews(prompts, "book", OfflineModel(), "m", "2020-01-01").select("status", B.parse_overview(F.col("file")).alias("o")).collect()[0]
    assert o["status"] == "done" and (o["o"]["author"], o["o"]["category"], o["o"]["summary"]) == ("Jane Doe", "기타", "One. Two.")
    assert spark.range(1).select(B.parse_overview(F.lit("---\nbook: x\n---\n")).alias("o")).collect()[0]["o"] is None

    class Quoting:
        def complete(self, system, prompt, max_tokens):
            return __import__("json").dumps({"body": "## 핵심 인용\n| a | the old mill stood by the river |\n| b | an invented one that is long |\n", "category": "역사 | 문학", "title": "T"})

    books = spark.createDataFrame([("a", "So the old mill stood by the river. Yes."), ("b", None), ("c", "  ")], "book string, text string")
    rows = B.book_notes(books, "book", "text", Quoting(), "m", "2020-01-01").collect()
    assert [(r.book, r.category, r.n_cites, r.filename) for r in rows] == [("a", "역사", 1, "a.md")] and "invented" not in rows[0].note and rows[0].note.startswith("---\ntitle: T\n")


def test_rewritten_notes(spark):
    from folioforge.operators import books as B

    body = "## 핵심 요약\n\n" + "a sentence of the old mill. " * 40

    class Short:
        def complete(self, system, prompt, max_tokens):
            return '{"body": "## x"}'

    rows = [(1, "s", f"---\ntitle: x\nmodel: m\n---\n{body}"), (2, "s", body), (3, "s_번역", f"---\nmodel: m\n---\n{body}"), (4, None, None)]
    df = spark.createDataFrame(rows, "k long, stem string, text string")
    got = {r.k: (r.outcome, r.note) for r in B.rewritten_notes(df, "k", "stem", "text", Short(), "m", "d").collect()}
    assert got == {1: ("too_short", None), 2: ("not_pipeline", None), 3: ("full_text", None), 4: ("not_pipeline", None)}


def test_titles_merging_and_single_chapters_of_odd_rows(spark):
    books = spark.createDataFrame([(1, None), (2, ""), (3, "Old Mills\nbody")], "k long, text string")
    titles = spark.createDataFrame([(1, 1, "Old Mills"), (3, 1, "Old Mills"), (3, 2, None), (3, 3, " ")], "k long, no long, title string")
    assert [(r.k, r.pos, r.title) for r in C.title_marks(books, titles, "k", "text", "no", "title").collect()] == [(3, 0, "Old Mills")]
    c = spark.createDataFrame([(1, 2, "two"), (1, 1, " one "), (1, 3, None), (2, 1, None)], "book long, no long, body string")
    t = spark.createDataFrame([(1, 2, "zwei"), (1, 1, " ")], "book long, no long, body string")
    assert [(r.book, r.text) for r in C.merge_chapters(c, t, "book", "no", "body").collect()] == [(1, "one\n\nzwei")]
    assert [r.text for r in C.merge_chapters(c, t, "book", "no", "body", False).collect()] == ["one\n\ntwo"]
    assert [r.k for r in C.single_chapters(books, titles.filter("k = 1"), "k", "text").collect()] == [3]
    raw = spark.createDataFrame([(1, '{"chapters": [{"title": "a", "page": 1}, {"title": " "}, {"title": null}]}'), (2, "no"), (3, None), (4, '{"chapters": [%s]}' % ", ".join('{"title": "%s", "page": 2}' % ("t" * 100) for _ in range(3)))], "k long, raw string")
    assert [(r.k, r.no, len(r.title)) for r in C.visual_contents(raw, "k", "raw").collect()] == [(4, 1, 90), (4, 2, 90), (4, 3, 90)]


def test_fuzzy_links_agree_with_brute_force(spark):
    """Blocking by rarest pairs loses no link."""
    import difflib

    rng = random.Random(21)
    stems = ["thehistoryofmills", "thehistoryofrivers", "thehistoryofharbours", "quietlanternsofthenorth", "역사의강과방앗간이야기들"]
    keys = sorted({s + rng.choice(["", "one", "two", "x"]) for s in stems for _ in range(6)})
    cands = [k[: (i := rng.randrange(len(k)))] + rng.choice(["", "q", "th"]) + k[i + rng.choice([0, 1]) :] for k in keys for _ in range(8)]
    df = spark.createDataFrame([(i, [c]) for i, c in enumerate(cands)], "id long, c array<string>")
    got = {r.id: (r.key, r.how) for r in M.link_entities(df, spark.createDataFrame([(k,) for k in keys], "key string"), "id", "c", "key").collect()}
    for i, c in enumerate(cands):
        score = {k: difflib.SequenceMatcher(None, k, c).ratio() for k in keys}
        best = max(score.values())
        if c in keys:
            assert got[i] == (c, "exact")
        elif best >= 0.88:
            assert got[i][1] == "fuzzy" and score[got[i][0]] == best
        else:
            assert i not in got


# Notes


@pytest.mark.parametrize(
    "text, stem, want",
    [
        ("no front matter", "a", "not_pipeline"), ("---\nmodel: m\nrefined: x\n---\n## 핵심 요약", "a", "already_done"), ("---\nmodel: m\n---\nbody", "a", "not_summary"),
        ("---\nmodel: m\n---\n## 핵심 요약\n" + "x" * 900, "a_번역", "full_text"), ("---\nmodel: m\n---\n## 핵심 요약\nx", "a", "thin"), ("---\nmodel: m\n---\n## 주요 내용\n" + "x" * 900, "a", ""),
    ],
)
def test_note_classes(spark, text, stem, want):
    assert spark.createDataFrame([(text, stem)], "t string, s string").select(N.classify_note(F.col("t"), F.col("s")).alias("r")).collect()[0].r == want


def test_hub_note(spark):
    s = spark.createDataFrame([("B", 2, "Two", "s2", "body2", False), ("B", 1, "One", "s1", "body1", True)], "stem string, no int, title string, summary string, body string, noted boolean")
    o = spark.createDataFrame([("B", "역사", "Ann", "intro", "short", "2020", 'P "Q"', "m", "2021-01-01")], "stem string, category string, author string, intro string, summary string, published string, publisher string, model string, day string")
    note = N.hub_notes(s, o, "stem").collect()[0].note
    assert note.index("✅ [[B — One]] — s1") < note.index("📄 [[B — Two]] — s2") and "body2" in note and "body1" not in note and "publisher: \"P 'Q'\"" in note and 'tags: ["역사"]' in note
    assert N.hub_notes(s.limit(0), o, "stem").count() == 0


def test_links_are_appended_then_replaced(spark):
    df = spark.createDataFrame([("# A\n\ntext",)], "n string")
    block = F.lit(N.LINKS_HEADER + "\n\n→ x\n")
    once = df.select(N.put_links(F.col("n"), block).alias("n"))
    twice = once.select(N.put_links(F.concat("n", F.lit("\n## Next\nz")), F.lit(N.LINKS_HEADER + "\n\n→ y\n")).alias("n")).collect()[0].n
    assert "→ y" in twice and "→ x" not in twice and twice.endswith("## Next\nz")


def _picked(lines, most):
    """The down-sampling in plain Python: strong lines first, evenly if too many, then every step-th of the others."""
    strong, weak = ([p for p, s in lines if ("Chapter" in s) is want] for want in (True, False))
    if len(lines) <= most:
        return sorted(strong + weak)
    if len(strong) > most:
        strong = [strong[i * len(strong) // most] for i in range(most)]
    room = most - len(strong)
    return sorted(strong + (weak[:: max(1, len(weak) // room)][:room] if room else []))


@pytest.mark.parametrize("n_strong, n_weak", [(2, 3), (2, 40), (7, 0), (10, 30), (17, 5), (0, 23)])
def test_pick_candidates_are_spread(spark, n_strong, n_weak):
    kinds = [True] * n_strong + [False] * n_weak
    random.Random(7).shuffle(kinds)
    lines = [(i, f"Chapter of mill {i}" if k else f"quiet mill {i}") for i, k in enumerate(kinds)]
    df = spark.createDataFrame([(1, p, s) for p, s in lines] + [(1, 900, "It ends."), (1, 901, "x"), (2, 0, "alone")], "doc long, pos long, line string")
    got = C.pick_candidates(df, "doc", "pos", "line", 7).collect()
    assert sorted(r.pos for r in got if r.doc == 1) == _picked(lines, 7) and sum(r.doc == 2 for r in got) == 1


def test_pick_lines_keeps_what_the_bound_allows(spark, tmp_path):
    from folioforge.plans.segment_queries import pick_lines

    text = "\n".join(f"a quiet mill {i}" for i in range(300))
    spark.createDataFrame([(1, k, text) for k in (1, 2)] + [(2, k, text) for k in (1, 2, 3)], "file_id long, page_no int, txt string").write.parquet(f"{tmp_path}/txt_pages.parquet")
    got = {r.file_id: r["count"] for r in pick_lines(spark, str(tmp_path)).groupBy("file_id").count().collect()}
    assert got == {1: 600, 2: 600}


def _hard(rng, n):
    """A body with what the round trip leaves out: digits at a line's head, tabs, runs of spaces, the word Chapter."""
    return _body(rng, n) + "\n12 mills stood there.\n\tand   more, as Chapter 3 says.\n" + _body(rng, n)


def test_chapters_of_files_and_pages(spark, tmp_path):
    from folioforge.plans import catalog

    rng = random.Random(11)
    names = ["Early Cathedrals", "Quiet Lanterns", "Northern Bridges"]
    numbered, listed, headed = ([_hard(rng, 500) for _ in range(k)] for k in (5, 3, 4))
    toc = "".join(f"{i}. {t} {i * 9}\n" for i, t in enumerate(names, 1)) + "\n" + _body(rng, 100) + "\n"
    files = [
        (1, "".join(f"Chapter {i}: Of Mills\n{b}\n" for i, b in enumerate(numbered, 1))), (2, toc + "".join(f"{t.upper()}\n{b}\n" for t, b in zip(names, listed))), (3, "no\theads   at all\n1 mill"), (4, None), (5, ""),
    ]
    spark.createDataFrame(files + files[:1], "file_id long, txt string").write.parquet(f"{tmp_path}/txt_files.parquet")
    md = [f"## Part {c}\n\n{b}" for c, b in zip("ABCD", headed)]
    pages = [(6, i, None if i == 2 else "some text", m) for i, m in enumerate(md, 1)] + [(7, 2, "second", None), (7, 1, "first", None), (8, 1, None, None)]
    spark.createDataFrame(pages + pages[:2], "file_id long, page_no int, txt string, md string").write.parquet(f"{tmp_path}/txt_pages.parquet")
    md5 = lambda s: __import__("hashlib").md5(s.strip().encode()).hexdigest()
    rows = lambda q: sorted((r.file_id, r["mode"], r.chapter_no, r.body) for r in catalog.queries()[q](spark, str(tmp_path)).collect())
    want = [(1, "numbered", i, md5(f"Chapter {i}: Of Mills\n{b}")) for i, b in enumerate(numbered, 1)] + [(2, "toc", i, md5(f"{t.upper()}\n{b}")) for i, (t, b) in enumerate(zip(names, listed), 1)]
    assert rows("file_chapters") == want + [(3, "single", 1, md5(files[2][1]))]
    assert rows("page_chapters") == [(6, "heading", i, md5(m)) for i, m in enumerate(md, 1)] + [(7, "single", 1, md5("first\fsecond"))]


def test_split_books_takes_bookmarks(spark):
    rng = random.Random(12)
    pages = [_body(rng, 400) for _ in range(4)]
    marks = [("A", 0, 0), ("sub", 1, 1), ("B", 1, 0), ("C", 3, 0)]
    df = spark.createDataFrame([(1, "\f".join(pages), marks), (2, "\f".join(pages), None)], "book long, text string, marks array<struct<title:string,page:int,level:int>>")
    got = C.split_books(df, "book", "text", bookmarks="marks").orderBy("book", "chapter_no").collect()
    assert [(r.book, r["mode"], r.title) for r in got] == [(1, "bookmark", "1. A"), (1, "bookmark", "2. B"), (1, "bookmark", "3. C"), (2, "single", "")]
    assert [r.body for r in got[:3]] == [pages[0].strip(), "\f".join(pages[1:3]).strip(), pages[3].strip()]


def test_model_tier_splits_a_book_without_headings(spark):
    class Picks:
        """A model that answers with fixed lines, by their text."""

        def __init__(self, wanted, extra=()):
            self.wanted, self.extra = wanted, list(extra)

        def complete(self, system, prompt, max_tokens):
            rows = [line.split(" | ", 2) for line in prompt.split("\n") if line.count(" | ") >= 2]
            return '{"chapters": %s}' % __import__("json").dumps([{"idx": int(i), "title": s} for i, _, s in rows if s in self.wanted] + self.extra)

    rng = random.Random(13)
    names = ["On mills", "On rivers", "On towns", "On winters"]
    bodies = [_body(rng, 1200) for _ in names]
    text = "".join(f"{t}\n{b}\n" for t, b in zip(names, bodies))
    assert len(text) >= 20_000
    df = spark.createDataFrame([(1, text), (2, text[:9000])], "book long, text string")
    rows = C.split_books(df, "book", "text", model=Picks(names)).orderBy("book", "chapter_no").collect()
    assert [(r["mode"], r.title) for r in rows] == [("llm", f"{i}. {t}") for i, t in enumerate(names, 1)] + [("single", "")]
    assert [r.body for r in rows[:4]] == [f"{t}\n{b}".strip() for t, b in zip(names, bodies)]
    for bad in (Picks(names[:2]), Picks(names, [{"idx": 10**6}]), Picks(names, [{"title": "x"}]), Picks(names, [{"idx": 0}] * 40), OfflineModel()):
        assert O.split_text(text, pick=lambda t: O.pick_chapters(t, bad))[0] == "single"


def _rows_out(plan):
    """Rows that each node of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    rows = plan.metrics().get("numOutputRows")
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return ([rows.get().value()] if rows.isDefined() else []) + [n for p in below for n in _rows_out(p)]


def test_fuzzy_links_of_titles_of_a_pattern(spark, monkeypatch):
    """Titles of the same few words have nearly all pairs of letters in common: no step gives a row a pair of strings, over any number of blocks each link is the one of get_close_matches."""
    import difflib

    monkeypatch.setattr(M, "CAND_BLOCK", 200, raising=False)
    monkeypatch.setattr(M, "KEY_BLOCK", 400, raising=False)
    rng = random.Random(34)
    title = lambda: rng.choice(["quiet", "slow", "hidden", "northern"]) + rng.choice(["lanterns", "footnotes", "harbours", "orchards"]) + rng.choice(["afterdark", "inpractice", "ofthecoast"])
    keys = sorted({title() + format(i * 7, "x") for i in range(1200)} | {"가나다라마바사아자" + "하" * (i % 3) for i in range(3)} | {"z" * 300, "z" * 298 + "y", "a"})
    damaged = [k[: (i := rng.randrange(len(k) + 1))] + rng.choice(["q", "", "qq", "addpdf"]) + k[i + rng.choice([0, 0, 1]) :] for k in rng.sample(keys, 250)]
    cands = [c for c in [*damaged, *(title() for _ in range(20)), "z" * 301, "가나다라마바사자", "b", "nothingalikeatall"] if c and c not in keys]
    df = M.link_entities(spark.createDataFrame([(i, [c]) for i, c in enumerate(cands)], "id long, c array<string>"), spark.createDataFrame([(k,) for k in keys], "key string"), "id", "c", "key")
    got = {r.id: r.key for r in df.collect()}
    assert got == {i: m[0] for i, c in enumerate(cands) if (m := difflib.get_close_matches(c, keys, n=1, cutoff=0.88))}
    assert len(got) > 150
    assert max(_rows_out(df._jdf.queryExecution().executedPlan())) <= 40 * (len(keys) + len(cands))  # a row for each letter, not for each pair
