"""Names: families of spellings, near misses, and odd tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from folioforge.llm import p4_names as p4

FAMILIES = [
    ["Penelope Harrowgate", "HARROWGATE, Penelope", "P. Harrowgate", "Harrowgate P.", "Penny Harrowgate", "penelope  harrowgate", "Dr. Penelope Harrowgate", "Penelope K. Harrowgate", "Penelope Harrowgte", "Peneloep Harrowgate"],
    ["Susanna Harrowgate", "S. Harrowgate", "Sue Harrowgate"],
    ["Robert Lindqvist", "Bob Lindqvist", "Lindqvist, Robert"],
    ["김다솔", "김 다솔", "김다솔 교수", "Kim Da Sol", "Kim Da-sol", "KIM Dasol", "Dasol Kim"],
    ["Brackwater Institute of Marine Biology", "Institute of Marine Biology, Brackwater", "Brackwater Inst. Mar. Biol.", "The Brackwater Institute of Marine Biology", "Brackwater Institute of Marine Biology (BRAMB)", "BRAMB", "Brackwatr Institute of Marine Biology"],
    ["Brackwater Institute of Linguistics"],
    ["Tove Jørgensen", "Jorgensen, Tove"],
]


def test_families(spark):
    rows = [(s,) for f in FAMILIES for s in f] * 2 + [(None,), ("",), (" ",), ("123",)]
    links = p4.link_names(spark.createDataFrame(rows, "spelling string")).collect()
    entity = {r.spelling: r.entity for r in links}
    assert len(links) == len(entity) == sum(map(len, FAMILIES))
    for f in FAMILIES:
        assert len({entity[s] for s in f}) == 1, [(s, entity[s]) for s in f]
    assert len({entity[f[0]] for f in FAMILIES}) == len(FAMILIES)


def test_slips_in_names_of_any_length(spark):
    families = [["Maria Elena Garcia", "Garcia, Maria Elena", "Maria Elena Gracia", "Maria Elena Garciia"], ["Maria Elene Sandoval"], ["Gil Byeok Chan", "Gil Byeox Chan", "길벽찬"], ["Gil Sun Chan"], ["Voltarine", "Voltarne"], ["Ann Maria Elena Garcia"]]
    got = {r.spelling: r.entity for r in p4.link_names(spark.createDataFrame([(s,) for f in families for s in f], "spelling string")).collect()}
    for f in families:
        assert len({got[s] for s in f}) == 1, [(s, got[s]) for s in f]
    assert len({got[f[0]] for f in families}) == len(families)


def test_a_slip_in_several_formats(spark):
    """The same links, however many formats of the right name and of the slip there are."""
    right, slip = (["Isabela Thornquist", "Thornquist, Isabela", "Dr. Isabela Thornquist"], ["Isabela Thornquits", "Thornquits, Isabela", "Dr. Isabela Thornquits"])
    others = ["Rebecca Thornquist", "Thornquist, Rebecca"]
    for n in (1, 2, 3):
        got = {r.spelling: r.entity for r in p4.link_names(spark.createDataFrame([(s,) for s in right[:n] + slip[:n] + others], "spelling string")).collect()}
        assert len({got[s] for s in right[:n] + slip[:n]}) == 1 and len({got[s] for s in others}) == 1 and len(set(got.values())) == 2


def _entities(spark, names):
    return {r.spelling: r.entity for r in p4.link_names(spark.createDataFrame([(s,) for s in names], "spelling string")).collect()}


def test_middle_initials(spark):
    """Different middle initials are different people; a name without one joins the only one there is."""
    got = _entities(spark, ["John A. Smithson", "Smithson, John A.", "Johnny A. Smithson", "John B. Smithson", "John Smithson", "Mary C. Oakfield", "Mary Oakfield", "M. C. Oakfield", "M. D. Oakfield"])
    assert got["John A. Smithson"] == got["Smithson, John A."] == got["Johnny A. Smithson"]
    assert len({got[s] for s in ("John A. Smithson", "John B. Smithson", "John Smithson")}) == 3
    assert got["Mary C. Oakfield"] == got["Mary Oakfield"] == got["M. C. Oakfield"] != got["M. D. Oakfield"]


def test_short_forms_of_several_names(spark):
    got = _entities(spark, ["Matt Lindqvist", "Matthew Lindqvist", "Matty Harrowgate", "Matthias Harrowgate", "Alex Oakfield", "Alexander Oakfield", "Alexandra Oakfield", "A. Lindqvist", "M. Lindqvist"])
    assert got["Matt Lindqvist"] == got["Matthew Lindqvist"] == got["M. Lindqvist"] and got["Matty Harrowgate"] == got["Matthias Harrowgate"]
    assert len({got[s] for s in got if "Oakfield" in s}) == 3 and got["A. Lindqvist"] not in (got["Matt Lindqvist"],)


def test_one_token_in_other_scripts(spark):
    got = _entities(spark, ["山田太郎", "山田 太郎", "ヤマダタロウ", "ヤマダタロ", "田中太郎"])
    assert got["ヤマダタロウ"] == got["ヤマダタロ"] and got["山田太郎"] != got["田中太郎"]


def test_blocks_lose_no_link(spark):
    """The edges of the blocks are those of a comparison of all nodes with all."""
    import random

    rng = random.Random(9)
    given, family = ["matt", "matthew", "maria", "mariia", "elena", "john", "a", "j", "bea", "beatrice", "jo"], ["stonebridge", "stonebrdge", "stobebridge", "oakfield", "okafield", "li", "ly"]
    names = {" ".join(w.capitalize() + ("." if len(w) == 1 else "") for w in rng.sample(given, rng.choice([1, 1, 2])) + [rng.choice(family)]) for _ in range(220)}
    names |= {f"{p} Institute of {f}" for p in ("Brackwater", "Brackwatr", "Oakfield") for f in ("Marine Biology", "Mar. Biol.", "Linguistics")}
    got = {(r.a, r.b): r.how for r in p4.node_edges(p4.parsed(spark.createDataFrame([(s,) for s in names], "spelling string"))).collect()}
    nodes = {p4.node_of(n): n for n in map(p4.parse, names)}
    want = {}
    for a, b in itertools.combinations(sorted(nodes), 2):
        if how := p4.compare(nodes[a], nodes[b]):
            want[a, b] = how
    assert {tuple(sorted(k)): v for k, v in got.items()} == want
    assert {"same", "middle", "short", "initial"} <= set(want.values())


def test_common_surname_makes_no_large_block(spark):
    """Two thousand names of one surname and initial, a hundred of one phonetic code: nothing near the square is compared."""
    import random

    rng = random.Random(10)
    names = {"J" + "".join(rng.choice("aeiou") + rng.choice("bdglmnrst") for _ in range(4)) + " Stonebridge" for _ in range(2000)}
    keys = [k for n in names for k in p4.block_keys("P", p4.parse(n)["tokens"], "") if k[0] != "N"]
    size = {}
    for k in keys:
        size[k] = size.get(k, 0) + 1
    assert sum(v * v for v in size.values()) < 0.01 * len(names) ** 2 + 20 * len(keys)


def test_ambiguous_initial_joins_none(spark):
    rows = [("Maria Stonebridge",), ("Monica Stonebridge",), ("M. Stonebridge",)]
    got = {r.spelling: r.entity for r in p4.link_names(spark.createDataFrame(rows, "spelling string")).collect()}
    assert len(set(got.values())) == 3


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "spelling string")
    assert p4.link_names(empty).count() == 0


@pytest.mark.parametrize("a, b, yes", [("lozefeld", "loozefeld", True), ("lozefeld", "lozfeld", True), ("lozefeld", "lzoefeld", True), ("lozefeld", "lozefels", True), ("lozefeld", "lozefelp", False), ("abc", "abd", False), ("lozefeld", "lozefeldxy", False)])
def test_slips(a, b, yes):
    assert p4.one_slip(a, b) is yes and p4.one_slip(b, a) is yes


def test_jaro_winkler():
    assert p4.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert p4.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert p4.jaro_winkler("", "a") == 0


def test_components(spark):
    from folioforge.llm.components import connected_components

    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "x"), ("z", "z"), ("q", None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and got["x"] == got["y"] == "x" and "q" not in got


def test_components_of_random_graphs_and_hubs(spark):
    import random

    from folioforge.llm.components import connected_components

    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1001 + i) for i in range(300)] + [(2000 + i, 2001 + (i * 7) % 50) for i in range(50)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {v: find(v) for v in list(root)}
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
