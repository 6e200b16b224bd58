"""Truncation: endings by sign, near-copies that end early, and odd tables."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.llm import p6_truncation as p6


@pytest.mark.parametrize(
    "text, state",
    [
        ("It rained all day.", "whole"), ("비가 왔다.", "whole"), ('그는 "간다"고 했다.', "whole"), ("비가 왔�", "cut"), ("| a | b |\n|---|---|\n| 1 | 2 |", "whole"),
        ("| a | b |\n| 1 | 2", "cut"), ("text.\n\n[[A Title]]", "whole"), ("text.\n\n[[A Ti", "cut"), ("text.\n\n[[A Ti\n\n```", "cut"), ("> A quote.\n> — Ann, p. 12", "whole"),
        ("> A quote.\n> — Ann, p", "cut"), ("**A bold line.**", "whole"), ("**A bold li", "cut"), ("It rained all d...", "cut"), ("It rained all da (계속", "cut"), ("a title", "open"), ("", "whole"),
    ],
)
def test_signs(text, state):
    assert p6.ending(text)[0] == state


def _corpus(spark, rows):
    return spark.createDataFrame(rows, "note_id long, model string, field string, text string")


def _early(spark, rows):
    return {r.note_id for r in p6.early_copies(_corpus(spark, rows)).collect()}


def test_near_copies_that_end_early(spark):
    """Copies cut at 30 to 95 % of a whole text, some of them with other words here and there, meet it; whole ones, ends of sentences and other fields don't."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    full = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 400))) + "." for _ in range(40)]
    rows = [(i, "m", "body", t) for i, t in enumerate(full)]
    cut, edited = set(), set()
    for share in (0.3, 0.4, 0.5, 0.6, 0.75, 0.8, 0.85, 0.95):
        for i, t in enumerate(full):
            part = t[: int(len(t) * share)].rstrip(" .")
            no = 1000 + len(rows)
            if i % 2:
                own = part.split()
                for k in rng.sample(range(len(own) - 6), len(own) // 60):
                    own[k] = "other"
                part = " ".join(own)
                edited.add(no)
            cut.add(no)
            rows.append((no, "m", "body", part))
    rows += [(500 + i, "m", "body", full[0]) for i in range(5)]  # exact copies of a whole text
    rows += [(600, "m", "summary", full[0][:300])]  # another field
    rows += [(700, "m", "body", "other words " + " ".join(rng.choice(words) for _ in range(80)))]
    got = _early(spark, rows)
    assert got <= cut
    assert cut - edited <= got
    assert len(got & edited) >= 0.9 * len(edited)


def test_alignment():
    rng = random.Random(5)
    full = " ".join(f"w{rng.randint(0, 500)}" for _ in range(200))
    for share in (0.1, 0.3, 0.6, 0.95):
        part = full[: int(len(full) * share)]
        assert p6.ends_early(part, full) and not p6.ends_early(full, part)
    assert not p6.ends_early(full, full) and not p6.ends_early("one two", full) and not p6.ends_early("", "")
    assert not p6.ends_early("x " * 150 + full[:60], full)  # ends alike, but is no near-copy
    assert p6.ends_early("a " * 3000 + "b c d e f", "a " * 3000 + "b c d e fgh")


def test_hot_bucket_of_a_template(spark):
    """Every copy is aligned with its own full text, though the buckets hold many longer ones."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    template = some(600)
    full = [f"{template} {some(10 + i % 5)} the end." for i in range(40)]
    rows = [(i, "m", "body", t) for i, t in enumerate(full)] + [(100 + i, "m", "body", t[:-12]) for i, t in enumerate(full)]
    rows += [(200 + i, "m", "body", template[: 300 + 40 * i]) for i in range(40)]  # cuts within the template
    texts = {r[0]: r[3] for r in rows}
    want = {i for i, x in texts.items() if p6.ending(x)[0] == "open" and any(p6.ends_early(x, y) for j, y in texts.items() if len(y) > len(x))}
    assert {100 + i for i in range(40)} <= want
    assert _early(spark, rows) == want


def test_counts_of_longer_words(spark):
    """Against brute force, in a context and anywhere."""
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("ab가") for _ in range(rng.randint(1, 5))) for _ in range(150)})
    counts = [(rng.choice("^x"), w, rng.randint(0, 3), rng.randint(0, 3)) for w in words for _ in range(3)]
    keys = [(b, w) for b in "^xz" for w in [*words[::3], "a", "b", "c", "aaaaaaaaa"]]
    c, k = spark.createDataFrame(counts, "before string, word string, inner long, stop long"), spark.createDataFrame(keys, "before string, word string").distinct()
    rows = p6.terminality(c, k.withColumn("limited", F.lit(False))).collect()
    assert len(rows) == len(set(keys))
    for r in rows:
        own, any_ = [x for x in counts if x[0] == r.before], counts
        for name, some in (("", own), ("_any", any_)):
            assert r["inner" + name] == sum(x[2] for x in some if x[1] == r.word)
            assert r["stop" + name] == sum(x[3] for x in some if x[1] == r.word)
            assert r["longer" + name] == sum(x[2] + x[3] for x in some if x[1] != r.word and x[1].startswith(r.word)), (r, name)


def test_contexts():
    seen = p6.Contexts()
    seen.add([("The mill. It\n\n#tag #tag\nIs 12", True), ("Was the mil", False), ("Was", False), ("", True)])
    assert seen.stop == {("The", "mill"): 1, ("mill", "It"): 1, ("#", "#tag"): 1, ("Is", "0"): 1, ("^", "Was"): 1}
    assert seen.inner == {("^", "The"): 1, ("#", "#tag"): 1, ("^", "Is"): 1}


def test_additions():
    for t, want in (("a b...", "a b"), ("a b …\n", "a b"), ("a (계속)", "a"), ("a (cont.", "a"), ("a b.", "a b."), ("a [more]", "a"), ("a\n```", "a"), ("a" + " ..." * 500, "a"), ("..." * 300, ""), ("a 더 보기", "a")):
        assert p6.without_additions(t) == want


def test_report(spark, tmp_path):
    rows = [(1, "m", "A whole sentence.", "It rained all d..."), (1, "m", "A whole sentence.", "It rained all d..."), (2, None, None, "| a | b"), (3, "m", " ", "")]
    spark.createDataFrame(rows, "note_id long, model string, summary string, body string").write.parquet(f"{tmp_path}/wiki_notes.parquet")
    got = sorted((r.model, r.n_values, r.n_cut, r.share_cut) for r in p6.p6_report(spark, str(tmp_path)).collect())
    assert got == [("", 1, 1, 1.0), ("m", 2, 1, 0.5)]


def test_terminality(spark):
    rows = [(i, "m", "body", f"the old mill near the river was closed in {1900 + i}. it was opened by the river again.") for i in range(30)]
    rows += [(100, "m", "body", "the old mill near the river was clo"), (101, "m", "body", "the old mill near the river was"), (102, "m", "body", "it was opened by the river again")]
    rows += [(103, "m", "body", None), (104, "m", "body", ""), (105, "m", "body", " \n "), (100, "m", "body", "the old mill near the river was clo")]
    values = _corpus(spark, rows).filter("text rlike '\\\\S'")
    got = sorted(r.note_id for r in p6.cut_values(values).collect())
    assert got == [100, 101]


def test_long_words(spark):
    """Tags and words that are cut behind their twelfth character, once or many times, and whole ones."""
    rows = [(i, "m", "body", f"The mill {i} is old.\n\n#neighbourhood #long-term_rent\n\nHere the internationalisation of mills went on.") for i in range(20)]
    rows += [(50, "m", "body", "The mill is old.\n\n#neighbourhoo"), (51, "m", "body", "The mill is old.\n\n#neighbourhood #long-term_re"), (52, "m", "body", "The mill is old.\n\n#neighbourhood")]
    rows += [(60 + i, "m", "body", f"The mill {i} saw internationali") for i in range(4)]
    rows += [(70, "m", "body", "Here the internationalisatio")]
    got = sorted(r.note_id for r in p6.cut_values(_corpus(spark, rows)).collect())
    assert got == [50, 51, 60, 61, 62, 63, 70]


def test_empty_table(spark):
    assert p6.cut_values(_corpus(spark, [])).count() == 0
    assert p6.early_copies(_corpus(spark, [])).count() == 0
