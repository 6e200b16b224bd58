"""Problem 4: variant spellings of names typed by people.

Different spellings are parsed into nodes (a person's tokens in any order and middle
initials, nicknames of one name resolved; an institute's place and field), so format
variants meet in a node without being compared. Nodes are blocked by the phonetic code of
one of their sorted tokens beside the others as they are and, for slips that change the
code, by that token with one character left out; Jaro-Winkler and the kind of slip decide.
Two names differ in one token at most, so these blocks lose none that whole codes would
hold, and a common surname or code doesn't make a block large. Accepted pairs and nodes are
clustered by connected components; a short form, a missing middle initial or a name by
initial joins the one entity it can mean, or none.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.components import connected_components
from folioforge.session import cut_lineage, table

#: Least Jaro-Winkler similarity of two tokens, and least length of a token that may hold a slip.
SIMILAR, SLIP_CHARS = 0.86, 4

#: Full given names with the short forms people type.
NICKNAMES = {
    "adelaide": "addie adele heidi", "alexander": "alex alec sandy xander", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny benji", "catherine": "katherine kathryn cathy kathy kate katie cat kat",
    "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "dorothea": "dot dottie dora thea", "edward": "ed eddie ned", "elizabeth": "liz lizzie beth betty eliza ellie",
    "emmanuel": "manny emanuel", "florence": "flo flora flossie", "frederick": "fred freddie", "gabriella": "gabby gabi ella", "henry": "harry hank", "isabella": "bella izzy isabel bel",
    "jacob": "jake", "james": "jim jimmy jamie", "jonathan": "jon jonny nathan", "john": "jack johnny", "joseph": "joe joey", "josephine": "josie jo josey", "alexandra": "alex sandy", "christina": "chris tina", "samantha": "sam", "patrick": "pat paddy",
    "lawrence": "larry laurie lars lawrie", "leonard": "leo len", "margaret": "maggie meg peggy", "matthias": "matt matty", "matthew": "mat matt matty", "michael": "mike mick", "mireille": "mimi mirei",
    "nathaniel": "nate nat", "nicholas": "nick nicky", "olivia": "liv livvy ollie", "patricia": "pat trish", "penelope": "penny pen nell", "richard": "dick rick rich ricky richie",
    "robert": "bob rob bobby robbie", "samuel": "sam sammy", "sebastian": "seb bastian", "stephen": "steve", "susanna": "sue susie suzy susan", "tabitha": "tabby tabs", "theodore": "ted theo teddy",
    "thomas": "tom tommy", "timothy": "tim", "ursula": "ulla uschi", "victoria": "vicky tori", "william": "bill will billy willie liam", "yolanda": "yoli yola lanny", "zacharias": "zach zack zak",
    "zenobia": "zen nobia", "beatrice": "bea trixie", "cornelius": "neil corny", "dominic": "dom", "eleanor": "nora", "gregory": "greg", "jeremiah": "jerry", "maximilian": "max", "rosalind": "roz", "vincent": "vince",
}
_MEANT: dict[str, list[str]] = {}
for _full, _shorts in NICKNAMES.items():
    for _s in _shorts.split():
        _MEANT.setdefault(_s, []).append(_full)
#: Short forms of one name stand for it; those of several are resolved by who there is.
_FULL = {s: fulls[0] for s, fulls in _MEANT.items() if len(fulls) == 1}
_MEANT = {s: fulls for s, fulls in _MEANT.items() if len(fulls) > 1}

#: Titles, words for institutes, and words without meaning in their names.
_TITLES = re.compile(r"^(?:(?:dr|prof|professor|mr|mrs|ms|miss|sir|dame|rev|phd|md)\b\.?\s*)+|(?:\s*(?:교수|박사|선생|님|씨|연구원))+$|(?:,?\s*(?:phd|ph\.d\.?|md|m\.d\.?|jr\.?|sr\.?))+$", re.I)
_INSTITUTE = re.compile(r"\b(?:institutes?|insts?|institut|university|univ|cent(?:er|re)|academy|acad|laborator(?:y|ies)|lab|dept|department|college|school|society|museum)\b\.?", re.I)
_EMPTY_WORDS = {"of", "for", "the", "and", "in", "at", "von", "für", "de", "la", "des", "du"}
#: The order of Korean letters, as the national romanisation writes them.
_HEAD = "g kk n d tt r m b pp s ss - j jj ch k t p h".split()
_VOWEL = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
_TAIL = "- k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split()
_SYLLABLES = {(h + v + t).replace("-", "") for h in _HEAD for v in _VOWEL for t in set(_TAIL)}
#: Surnames that are usually not written by the national romanisation.
_SURNAMES = {"kim": "gim", "lee": "i", "yi": "i", "park": "bak", "pak": "bak", "choi": "choe", "yoon": "yun", "lim": "im", "oh": "o", "ahn": "an", "shin": "sin", "kang": "gang", "kwon": "gwon", "noh": "no", "woo": "u", "moon": "mun", "chung": "jeong", "jung": "jeong"}
#: Rows of the keyboard; a slip hits a neighbour.
_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEAR = {
    c: {r[j] for r in _KEYS for j in range(len(r)) if any(c in q and abs(j + 0.25 * _KEYS.index(r) * 2 - (q.index(c) + 0.25 * _KEYS.index(q) * 2)) <= 1.1 and abs(_KEYS.index(r) - _KEYS.index(q)) <= 1 for q in _KEYS)} - {c}
    for c in "".join(_KEYS)
}


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).lower().replace("ß", "ss").replace("ł", "l").replace("ø", "o").replace("đ", "d").replace("æ", "ae"))
    return unicodedata.normalize("NFC", "".join(c for c in text if unicodedata.category(c) != "Mn" or "ᄀ" <= c <= "ᇿ"))


def romanize(name: str) -> list[str]:
    """A Hangul name's syllables in Latin letters."""
    out = []
    for c in name:
        i = ord(c) - 0xAC00
        if 0 <= i < 11172:
            out.append((_HEAD[i // 588] + _VOWEL[i % 588 // 28] + _TAIL[i % 28]).replace("-", ""))
    return out


def parse(spelling: str) -> dict:
    """A spelling as a node: ``kind`` (P person, N person by initial, I institute, A acronym), ``tokens``, ``first`` (initials; of a person with a whole given name the others), ``also`` (acronym)."""
    s = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", spelling)).strip()
    if re.fullmatch(r"[A-Z]{3,10}", s):
        return {"kind": "A", "tokens": [s], "first": "", "also": ""}
    if _INSTITUTE.search(fold(s)):
        return _institute(s)
    s = _TITLES.sub("", s).strip(" ,")
    if re.search("[가-힣]", s):
        sy = romanize(s)
        tokens = [sy[0], "".join(sy[1:])] if len(sy) > 1 else sy
        return {"kind": "P", "tokens": sorted(tokens), "first": "", "also": ""}
    comma = "," in s
    parts = [p for p in re.split(r"[\s,]+", re.sub(r"(?<=\w)\.(?=\w)", ". ", fold(s))) if p]
    words = [p.strip(".'’") for p in parts]
    full = [_SURNAMES.get(w, w).replace("-", "") for w in words if len(w) > 1]
    initials = "".join(w for w in words if len(w) == 1)
    words = [_SURNAMES.get(w, w) for w in words]
    if not initials and len(words) == 3 and all(w in _SYLLABLES for w in words) and not comma:
        full = [words[0], words[1] + words[2]]
    if not initials and len(words) == 3 and comma and all(w in _SYLLABLES for w in words):
        full = [words[0], words[1] + words[2]]
    if len(full) == 1 and initials:
        return {"kind": "N", "tokens": full, "first": initials, "also": ""}
    return {"kind": "P", "tokens": sorted(_FULL.get(w, w) for w in full), "first": initials, "also": ""}


def _institute(s: str) -> dict:
    acronym = ""
    inside = re.search(r"\(([^)]*)\)", s)
    place = ""
    if inside:
        if re.fullmatch(r"[A-Z]{3,10}", inside.group(1).strip()):
            acronym = inside.group(1).strip()
        else:
            place = inside.group(1)
        s = s[: inside.start()] + s[inside.end() :]
    t = fold(s)
    m = _INSTITUTE.search(t)
    before, after = t[: m.start()], t[m.end() :]
    if not place and "," in after:
        after, place = after.rsplit(",", 1)
    if not place:
        place = before
    words = lambda x: [w for w in re.split(r"[^\w]+", x) if w and w not in _EMPTY_WORDS]
    return {"kind": "I", "tokens": ["".join(words(fold(place))), *words(after)], "first": "", "also": acronym}


def node_of(p: dict) -> str:
    return p["kind"] + ":" + "|".join(p["tokens"]) + (f"#{p['first']}" if p["first"] else "")


def phonetic(word: str) -> str:
    """First letter and the classes of the consonants after it, without repeats."""
    classes = {c: k for k, cs in enumerate(("bfpvw", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in cs}
    out, last = word[:1], classes.get(word[:1], 0)
    for c in word[1:]:
        k = classes.get(c, 0)
        if k and k != last:
            out += str(k)
        if c not in "hw":
            last = k
    return out


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    used, hits = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(m) if used[j]]
    swaps = sum(x != y for x, y in zip(hits, other)) / 2
    k = len(hits)
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    prefix = next((i for i in range(min(4, n, m)) if a[i] != b[i]), min(4, n, m))
    return jaro + 0.1 * prefix * (1 - jaro)


def one_slip(a: str, b: str) -> bool:
    """Is one word the other with a letter left out, doubled, swapped with the next, hit on a neighbouring key or lost to an x?"""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < SLIP_CHARS:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        if i == len(a):
            return True
        if a[i + 1 :] == b[i + 1 :]:
            return b[i] in _NEAR.get(a[i], ()) or "x" in (a[i], b[i])
        return i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :]
    if len(a) < len(b):
        a, b = b, a
    return a[i + 1 :] == b[i:]


def block_keys(kind: str, tokens: list[str], first: str) -> list[str]:
    """The blocks in which a node is compared; in those that begin with N only with names by initial."""
    dropped = lambda w: {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} if len(w) >= SLIP_CHARS else {w}
    if kind == "I":
        heads = "".join(w[:1] for w in tokens[1:])
        return sorted({f"I{d}|{heads}" for d in dropped(tokens[0])} | {f"IP{phonetic(tokens[0])}|{heads}"})
    if kind == "N":
        return [f"N{tokens[0]}|{first[:1]}"]
    keys = {"K" + "|".join(t) for t in meant(tokens)}
    for form in forms(tokens):
        for i, w in enumerate(form):
            rest = "|".join(form[:i] + form[i + 1 :])
            keys.add(f"S{rest}|{phonetic(w)}")
            keys |= {f"D{rest}|{d}" for d in dropped(w)}
            if len(tokens) == 2:
                keys.add(f"N{rest}|{w[:1]}")
    return sorted(keys)


def meant(tokens: list[str]) -> list[list[str]]:
    """The tokens with each short form of several names as every name it may stand for, and themselves."""
    return [sorted(t) for t in itertools.product(*[[w, *_MEANT.get(w, ())] for w in tokens])]


def agree(a: str, b: str) -> bool:
    """Can both strings of initials belong to one person?"""
    return a.startswith(b) or b.startswith(a)


def forms(tokens: list[str]) -> list[list[str]]:
    """The sorted tokens of a person, and where three are syllables but for one (a slip may have made it none), any two of them joined."""
    if len(tokens) != 3 or sum(w in _SYLLABLES for w in tokens) < 2:
        return [tokens]
    return [tokens, *(sorted((s, u + v)) for s, u, v in itertools.permutations(tokens))]


def compare(a: dict, b: dict) -> str:
    """How two nodes of a block belong together: ``same``; ``middle`` (one has a middle initial), ``short`` (a short form of several names), ``initial`` (a name by initial), which join only what is unique; or not at all (empty)."""
    if a["kind"] == "I" and b["kind"] == "I":
        x, y = a["tokens"], b["tokens"]
        if len(x) != len(y):
            return ""
        same_place = x[0] == y[0]
        if not same_place and not (jaro_winkler(x[0], y[0]) >= SIMILAR and one_slip(x[0], y[0])):
            return ""
        for u, v in zip(x[1:], y[1:]):
            if not (u.startswith(v) or v.startswith(u) or (same_place and one_slip(u, v))) or min(len(u), len(v)) < 2:
                return ""
        return "same"
    if a["kind"] == "N" or b["kind"] == "N":
        if a["kind"] != "N":
            a, b = b, a
        if b["kind"] == "N":
            return "initial" if a["tokens"] == b["tokens"] and agree(a["first"], b["first"]) else ""
        for given, name in (b["tokens"], b["tokens"][::-1]) if len(b["tokens"]) == 2 else ():
            if name == a["tokens"][0] and given[:1] == a["first"][:1] and agree(a["first"][1:], b["first"]):
                return "initial"
        return ""
    if not agree(a["first"], b["first"]):
        return ""
    for x, y in itertools.product(forms(a["tokens"]), forms(b["tokens"])):
        if len(x) != len(y):
            continue
        u, v = [*(Counter(x) - Counter(y)).elements()], [*(Counter(y) - Counter(x)).elements()]
        if not u or len(u) == 1 and jaro_winkler(u[0], v[0]) >= SIMILAR and one_slip(u[0], v[0]):
            return "same" if a["first"] == b["first"] else "middle"
    return "short" if a["tokens"] in meant(b["tokens"]) or b["tokens"] in meant(a["tokens"]) else ""


_NODE = "node string, kind string, tokens array<string>, first string, also string"


def parsed(spellings: DataFrame) -> DataFrame:
    """``spelling`` with its node and parts; spellings without letters have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s in b.column(0).to_pylist():
                if s and re.search(r"[^\W\d_]", s):
                    p = parse(s)
                    if any(p["tokens"]):
                        rows.append({"spelling": s, "node": node_of(p), **p})
            schema = pa.schema([("spelling", pa.string()), ("node", pa.string()), ("kind", pa.string()), ("tokens", pa.list_(pa.string())), ("first", pa.string()), ("also", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spellings.select("spelling").mapInArrow(run, f"spelling string, {_NODE}")


def node_edges(names: DataFrame) -> DataFrame:
    """``a, b, how`` of nodes that a block holds and the comparison accepts.

    Blocks are joined on their keys and hold nodes, not spellings or rows. A block of a
    surname and an initial may be large: there only the names by initial, of which there are
    a few, are held against the others, never full names against each other.
    """
    nodes = names.filter("kind <> 'A'").groupBy("node").agg(F.first("kind").alias("kind"), F.first("tokens").alias("tokens"), F.first("first").alias("first"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [block_keys(k, t, f) for k, t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())]
            at = pa.array([i for i, ks in enumerate(every) for _ in ks], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for ks in every for k in ks], pa.string()), *(c.take(at) for c in b.columns)], names=["key", *b.schema.names])

    rows = cut_lineage(nodes.select("node", "kind", "tokens", "first").mapInArrow(keys, "key string, node string, kind string, tokens array<string>, first string"))
    side = lambda df, x: df.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "kind", "tokens", "first")])
    own, by_initial = rows.filter(~F.col("key").startswith("N")), rows.filter(F.col("key").startswith("N"))
    pairs = side(own, "a").join(side(own, "b"), "key").filter("node_a < node_b")
    pairs = pairs.unionByName(side(by_initial.filter("kind = 'N'"), "a").join(side(by_initial, "b"), "key").filter("kind_b = 'P' or node_a < node_b"))
    pairs = pairs.drop("key").dropDuplicates(["node_a", "node_b"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            how = [compare(*({c: r[f"{c}_{s}"] for c in ("kind", "tokens", "first")} for s in "ab")) for r in rows]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], pa.string()) for c in ("node_a", "node_b")), pa.array(how, pa.string())], names=["a", "b", "how"])

    # The kind of slip decides, not how often either is written: a frequent author's slip turns up in every format.
    return cut_lineage(pairs.mapInArrow(check, "a string, b string, how string").filter("how <> ''"))


def link_names(spellings: DataFrame) -> DataFrame:
    """``spelling, entity``: each different spelling and its entity (the smallest node).

    ``spellings`` has one column ``spelling``; repeats, nulls and blanks don't matter. A name
    with an initial joins the one entity of that surname and initial, a name without a middle
    initial the one that has one, a short form of several names the one that there is; if
    several entities could be meant, they join none.
    """
    names = cut_lineage(parsed(spellings.distinct()))
    edges = node_edges(names)
    every = names.select("node").distinct()
    short = names.filter("also <> ''").select(F.col("node").alias("a"), F.concat(F.lit("A:"), F.col("also")).alias("b"))
    sure = edges.filter("how = 'same'").select("a", "b").unionByName(short)
    groups = _components(every, sure)
    # Who a short form or a name without middle initial means is settled before names by initial are.
    for how in ("short", "middle"):
        meant_by = _unique(groups, edges.filter(F.col("how") == how)).withColumnsRenamed({"a": "component", "b": "other"})
        groups = cut_lineage(groups.join(meant_by.hint("merge"), "component", "left").select("node", F.coalesce("other", "component").alias("component")))

    initial = edges.filter("how = 'initial'")
    to_full = initial.filter(~F.col("b").startswith("N:")).select(F.col("a").alias("n"), F.col("b").alias("p")).join(groups.select(F.col("node").alias("p"), "component"), "p")
    # A second initial must agree with the middle initial that the entity is known to have.
    middles = groups.filter("node like 'P:%#%'").select("component", F.substring_index("node", "#", -1).alias("middle")).distinct()
    second = F.substring(F.substring_index("n", "#", -1), 2, 100)
    against = ~(second.startswith(F.col("middle")) | F.col("middle").startswith(second))
    to_full = to_full.join(middles, "component", "left").groupBy("n", "component").agg(F.max(F.coalesce(against, F.lit(False))).alias("against")).filter("not against")
    one = to_full.groupBy("n").agg(F.min("component").alias("c"), F.countDistinct("component").alias("k"))
    clear, unclear = one.filter("k = 1").select("n", "c"), one.filter("k > 1").select("n")
    among = initial.filter(F.col("b").startswith("N:")).select(F.col("a").alias("n"), F.col("b").alias("p")).join(unclear, "n", "left_anti").join(unclear.select(F.col("n").alias("p")), "p", "left_anti")
    # Every spelling hangs on its node and each node on its component, so nothing is expanded into pairs here.
    links = groups.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = links.unionByName(clear.select(F.col("n").alias("a"), F.col("c").alias("b"))).unionByName(among.select(F.col("n").alias("a"), F.col("p").alias("b")))
    whole = connected_components(links)
    return names.join(whole, "node", "left").select("spelling", F.coalesce("component", "node").alias("entity"))


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` of every node."""
    found = connected_components(links)
    return cut_lineage(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def _unique(groups: DataFrame, weak: DataFrame) -> DataFrame:
    """``a, b``: components that weak edges tie to one other component only, which is then the one meant.

    The less certain side of an edge is the component without middle initial (``middle``) or with the short form (``short``).
    """
    middle = F.when(F.col("how") == "middle", ~F.col("a").contains("#")).otherwise(F.exists(F.split(F.substring("a", 3, 10_000), "[|#]"), lambda w: w.isin(*_MEANT)))
    turned = weak.select(F.when(middle, F.col("a")).otherwise(F.col("b")).alias("n"), F.when(middle, F.col("b")).otherwise(F.col("a")).alias("p"))
    tied = turned.join(groups.select(F.col("node").alias("n"), F.col("component").alias("a")), "n").join(groups.select(F.col("node").alias("p"), F.col("component").alias("b")), "p")
    one = tied.filter("a <> b").groupBy("a").agg(F.min("b").alias("b"), F.countDistinct("b").alias("k"))
    return one.filter("k = 1").select("a", "b")


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "wiki_notes").select(F.col("author").alias("spelling"))
    papers = table(spark, sf_dir, "papermeta").select(F.explode(F.split("author", ";")).alias("spelling")).select(F.trim("spelling").alias("spelling"))
    return notes.unionByName(papers).filter(F.col("spelling").rlike(r"\S")).distinct()


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different spelling, its entity and the count of the entity's spellings."""
    links = link_names(_spellings(spark, sf_dir))
    n = links.groupBy("entity").agg(F.count("*").alias("n_spellings"))
    return links.join(n, "entity").select("spelling", "entity", "n_spellings")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different spellings of an entity."""
    links = cut_lineage(link_names(_spellings(spark, sf_dir)))
    a, b = links.select("entity", F.col("spelling").alias("name_a")), links.select("entity", F.col("spelling").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")


QUERIES = {"p4_found": p4_found, "p4_entities": p4_entities}
