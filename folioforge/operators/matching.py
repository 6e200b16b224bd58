"""Joins of the corpus: anti joins of pending work, entity links by key and likeness, caches, citations."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.python import nfc
from folioforge.functions.text import WS, asks_for_text, despace, entity_key, hangul_ratio, note_filename, squeeze, strip
from folioforge.operators.model import VALID_RATIO

#: Least likeness of two keys, least length of a quotation without white space.
CUTOFF, QUOTE_CHARS = 0.88, 10
#: Candidates and keys that are held against each other at once; length up to which keys that one letter parts are joined.
CAND_BLOCK, KEY_BLOCK, ONE_LETTER = 8_000, 16_000, 255


def pending(items: DataFrame, done: DataFrame, on: list[str], size: str | None = None) -> DataFrame:
    """Items that aren't done, smallest first if ``size`` is given. Repeated items stay."""
    left = items.join(done.select(*on).distinct(), on, "left_anti")
    return left.orderBy(size, *on) if size else left


def without_note(texts: DataFrame, notes: DataFrame, stem: str, filename: str) -> DataFrame:
    """Texts whose note's file name isn't among the notes."""
    return texts.withColumn("note_file", note_filename(F.col(stem))).join(notes.select(F.col(filename).alias("note_file")).distinct(), "note_file", "left_anti")


def split_known(items: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Items with ``known``: is their key among the known ones?"""
    flag = known.select(on).distinct().withColumn("known", F.lit(True))
    return items.join(flag, on, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def orphan_audit(raw: DataFrame, processed: DataFrame, notes: DataFrame, stem: str) -> DataFrame:
    """One row of counts: all stems, unprocessed ones, and those of them with and without a note."""
    flags = raw.select(stem).distinct()
    for name, other in (("processed", processed), ("noted", notes)):
        flags = flags.join(other.select(stem).distinct().withColumn(name, F.lit(True)), stem, "left")
    orphan = F.col("processed").isNull()
    return flags.agg(F.count("*").alias("n_stems"), F.count_if(orphan).alias("n_orphans"), F.count_if(orphan & F.col("noted").isNotNull()).alias("n_noted"), F.count_if(orphan & F.col("noted").isNull()).alias("n_lost"))


def queue_plan(queued: DataFrame, texts: DataFrame, chaptered: DataFrame, stem: str, n_chars: str, short: int) -> DataFrame:
    """``stem, state``: queued and unregistered texts as pending, short, missing, or duplicates of what has chapters."""
    t = texts.groupBy(stem).agg(F.max(n_chars).alias("n_chars"))
    q = queued.select(stem).distinct().withColumn("queued", F.lit(True))
    c = chaptered.select(stem).distinct().withColumn("chaptered", F.lit(True))
    every = t.join(q, stem, "full").join(c, stem, "left")
    state = F.when(F.col("n_chars").isNull(), "missing").when(F.col("chaptered").isNotNull(), "dup").when(F.col("n_chars") < short, "short").otherwise("pending")
    return every.select(stem, state.alias("state"), F.coalesce("queued", F.lit(False)).alias("queued"))


def first_by_key(sources: DataFrame, name: str, order: str) -> DataFrame:
    """``key`` and the first source of each entity key."""
    keyed = sources.withColumn("key", entity_key(F.col(name))).filter("key <> ''")
    return keyed.groupBy("key").agg(F.min_by(name, F.struct(order, name)).alias(name), F.count("*").alias("n_sources"))


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``owner, code`` of each pair of neighbouring letters; the code holds the pair and how often it came before in its text."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = owner[1:] == owner[:-1]
    owner, code = owner[:-1][inside], (chars[:-1] << np.uint64(21) | chars[1:])[inside]
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    place = np.arange(len(code))
    first = np.ones(len(code), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    before = place - np.maximum.accumulate(np.where(first, place, 0))
    return owner, code << np.uint64(21) | np.minimum(before, (1 << 21) - 1).astype(np.uint64)


def _matches(total: np.ndarray, cutoff: float) -> np.ndarray:
    """Least number of matching letters at which two texts of so many letters together reach the cutoff."""
    m = np.maximum(0, np.floor(cutoff * total / 2).astype(np.int64) - 1)
    for _ in range(3):
        m += 2.0 * m / total < cutoff
    return m


def closest(cands: list[str], keys: list[str], cutoff: float) -> list[tuple[str, float]]:
    """For each candidate the key of the highest ratio, the last by code points of equals, and that ratio; 0 if none reaches the cutoff.

    M matching letters of T are in T - 2M + 1 runs at most, as an unmatched letter ends a run; so
    two texts have 3M - T - 1 pairs of letters in common at least. The pairs are counted over an
    index of the keys; a ratio is made only where the bound that they set could beat the best so far.
    """
    keys = sorted(keys)
    n_key = np.array([len(k) for k in keys], np.int64)
    owner, code = _pairs(keys)
    order = np.argsort(code, kind="stable")
    owner = owner[order]
    codes, starts = np.unique(code[order], return_index=True)
    ends = np.append(starts[1:], len(owner))
    c_owner, c_code = _pairs(cands)
    at = np.searchsorted(codes, c_code)
    known = at < len(codes)
    known[known] = codes[at[known]] == c_code[known]
    c_owner, at = c_owner[known], at[known]
    cut = np.searchsorted(c_owner, np.arange(len(cands) + 1))
    least: dict[int, np.ndarray] = {}
    m, out = difflib.SequenceMatcher(), []
    for i, c in enumerate(cands):
        n = len(c)
        if n not in least:
            most = _matches(n + n_key, cutoff)
            least[n] = np.where(most <= np.minimum(n, n_key), 3 * most - n - n_key - 1, np.iinfo(np.int64).max)
        lists = [owner[starts[f] : ends[f]] for f in at[cut[i] : cut[i + 1]]]
        common = np.bincount(np.concatenate(lists), minlength=len(keys)) if lists else np.zeros(len(keys), np.int64)
        near = np.flatnonzero(common >= least[n])
        total = n + n_key[near]
        bound = 2.0 * np.minimum((total + 1 + common[near]) // 3, np.minimum(n, n_key[near])) / total
        best = (cutoff, -1)
        m.set_seq2(c)
        for j in np.lexsort((near, bound))[::-1]:
            k = int(near[j])
            if (bound[j], k) <= best:
                break
            m.set_seq1(keys[k])
            if (m.quick_ratio(), k) > best:
                best = max(best, (m.ratio(), k))
        out.append((keys[best[1]], best[0]) if best[1] >= 0 else ("", 0.0))
    return out


def link_entities(notes: DataFrame, sources: DataFrame, note_id: str, candidates: str, key: str) -> DataFrame:
    """``note_id, key, how``: the source of each note, exact by the first candidate key that has one, else the most alike of the first candidate that has any.

    ``candidates`` is an ordered array of keys. Only candidates of notes without an exact hit go to
    the fuzzy steps. Those that one letter parts from a key are joined on the letters left, and no
    key further off can be more alike. Of the others every block meets every block of keys once, and
    a block's best key is found there, so that no pair of strings is shuffled; the best of the blocks is taken at last.
    """
    # Shuffled once with all that the steps need of it, and no filter that only some of them could push below: none makes the candidates again.
    cand = notes.select(note_id, candidates).repartition(note_id).select(note_id, F.posexplode_outer(candidates).alias("ord", "cand")).filter("cand <> ''")
    keys = sources.select(F.col(key).alias("key")).filter("key <> ''").distinct()
    hit = F.min(F.when(F.col("key").isNotNull(), F.struct("ord", "key"))).alias("hit")
    met = cand.join(keys, cand["cand"] == keys["key"], "left").groupBy(note_id).agg(hit, F.collect_list(F.struct("ord", "cand")).alias("own"))
    exact = met.filter("hit is not null").select(note_id, "hit.key", F.lit("exact").alias("how"))
    left = met.filter("hit is null").select(note_id, F.explode("own").alias("own")).select(note_id, "own.*")
    tried = left.select("cand").distinct()

    def ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            r = [difflib.SequenceMatcher(None, k, c).ratio() for c, k in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(r, pa.float64())], names=["cand", "key", "ratio"])

    def best_of_block(c: pa.Table, k: pa.Table) -> pa.Table:
        cands = c.column("cand").to_pylist()
        found = closest(cands, k.column("key").to_pylist(), CUTOFF) if cands and k.num_rows else []
        rows = [(x, *y) for x, y in zip(cands, found) if y[1]]
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate((("cand", pa.string()), ("key", pa.string()), ("ratio", pa.float64())))})

    best = lambda scored: scored.groupBy("cand").agg(F.max(F.struct("ratio", "key")).alias("b")).select("cand", "b.*")
    without = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.xxhash64(F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))))
    less = lambda c: F.explode(F.array_distinct(F.when(F.length(c) <= ONE_LETTER + 1, without(c)))).alias("h")
    longer = tried.select("cand", less(F.col("cand"))).join(keys.select("key", F.xxhash64("key").alias("h")), "h")
    shorter = tried.select("cand", F.xxhash64("cand").alias("h")).join(keys.select("key", less(F.col("key"))), "h")
    pairs = longer.unionByName(shorter).select("cand", "key")
    # Two unmatched letters, both of the key, are the best that is left: 2n of 2n + 2 letters match.
    beyond = 2 * F.length("cand") / (2 * F.length("cand") + 2)
    one = best(pairs.mapInArrow(ratio, "cand string, key string, ratio double")).filter((F.length("cand") <= ONE_LETTER) & (F.col("ratio") >= CUTOFF) & (F.col("ratio") > beyond))
    rest = tried.join(one, "cand", "left_anti")
    n_blocks = lambda df, size, name: df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias(name))
    sizes = F.broadcast(n_blocks(tried, CAND_BLOCK, "n_c").crossJoin(n_blocks(keys, KEY_BLOCK, "n_k")))
    block = lambda text, n: F.pmod(F.xxhash64(text), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    c_side = rest.crossJoin(sizes).select(block("cand", "n_c").alias("bc"), every("n_k").alias("bk"), "cand")
    k_side = keys.crossJoin(sizes).select(every("n_c").alias("bc"), block("key", "n_k").alias("bk"), "key")
    blocks = c_side.groupBy("bc", "bk").cogroup(k_side.groupBy("bc", "bk")).applyInArrow(best_of_block, "cand string, key string, ratio double")
    found = one.unionByName(best(blocks))
    fuzzy = left.join(found, "cand").groupBy(note_id).agg(F.min_by("key", "ord").alias("key")).withColumn("how", F.lit("fuzzy"))
    return exact.unionByName(fuzzy)


def prefer(base: DataFrame, on: list[str], ranked: list[tuple[DataFrame, str]], name: str) -> DataFrame:
    """``base`` with ``name``: the value of the first table in order that has one that isn't blank."""
    out, cols = base, []
    for i, (df, col) in enumerate(ranked):
        one = df.groupBy(*on).agg(F.max(F.nullif(F.col(col), F.lit(""))).alias(f"__{i}"))
        out, cols = out.join(one, on, "left"), [*cols, f"__{i}"]
    return out.withColumn(name, F.coalesce(*cols)).drop(*cols)


def translation_cache(blocks: DataFrame, order: list[str]) -> DataFrame:
    """``src, tgt``: the first answer of each source over all works; blanks and marks of kept originals don't count."""
    good = blocks.filter((F.coalesce("src", F.lit("")) != "") & (F.coalesce("tgt", F.lit("")) != "") & ~F.col("tgt").startswith("(원문 보존"))
    return good.groupBy("src").agg(F.min_by("tgt", F.struct(*order)).alias("tgt"))


def verify_citations(quotes: DataFrame, texts: DataFrame, on: str, quote: str, text: str) -> DataFrame:
    """Quotes with ``verified``: long enough, and in the text of the same key once white space is gone."""
    q = despace(F.col(quote))
    body = texts.select(on, F.regexp_replace(text, f"{WS}+", "").alias("__text"))
    return quotes.join(body, on, "left").withColumn("verified", F.coalesce((F.length(q) >= QUOTE_CHARS) & F.col("__text").contains(q), F.lit(False))).drop("__text")


def override(model: Column, sidecar: Column) -> Column:
    """A value delivered with the source before what a model wrote."""
    return F.coalesce(F.nullif(sidecar, F.lit("")), model)


#: Suffixes of files that count as processed.
PROCESSED = ("pdf", "txt", "md", "docx", "doc")


def processed_stems(roots: list[DataFrame], done: DataFrame, name: str) -> DataFrame:
    """``stem``: composed stems of the files under any of the roots and of the names in the done file, once each."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    every = done.select(strip(F.col(name)).alias("name"))
    for df in roots:
        every = every.unionByName(df.filter(suffix.isin(*PROCESSED)).select(F.col(name).alias("name")))
    stem = F.regexp_replace(F.element_at(F.split("name", "/"), -1), r"\.[^.]+$", "")
    return every.filter("name is not null").select(stem.alias("stem")).filter("stem <> ''").distinct().select(nfc("stem").alias("stem")).distinct()


def file_counts(files: DataFrame, name: str, exts: list[str], without: tuple[str, ...] = ()) -> DataFrame:
    """``ext, n``: files of each suffix, those out whose stem ends in one of ``without``."""
    stem, ext = F.regexp_replace(name, r"\.[^.]+$", ""), F.regexp_extract(name, r"\.([^.]+)$", 1)
    kept = files.filter(ext.isin(*exts))
    for end in without:
        kept = kept.filter(~stem.endswith(end))
    return kept.groupBy(ext.alias("ext")).agg(F.count("*").alias("n"))


def best_by_count(rows: DataFrame, group: str, candidate: str, n: str) -> DataFrame:
    """``group, candidate, n``: of each group the candidate with the largest count above 0, the first of equals."""
    best = rows.filter(F.col(n) > 0).groupBy(group).agg(F.max(F.struct(F.col(n).alias("n"), (-F.col(candidate)).alias("c"))).alias("m"))
    return best.select(group, (-F.col("m.c")).alias(candidate), F.col("m.n").alias(n))


def refresh_list(chapters: DataFrame, done: DataFrame, book: str, chapter: str) -> DataFrame:
    """``book, n_chapters, n_done, state``: books with a summarised chapter are refreshed, the others are new."""
    c = chapters.filter(F.col(book).isNotNull()).groupBy(book).agg(F.count_distinct(chapter).alias("n_chapters"))
    s = done.groupBy(book).agg(F.count_distinct(chapter).alias("n_done"))
    return c.join(s, book, "left").select(book, "n_chapters", F.coalesce("n_done", F.lit(0)).alias("n_done"), F.when(F.col("n_done").isNull(), "new").otherwise("refresh").alias("state"))


def ruled_answer(out: Column) -> Column:
    """Is an answer not blank, no request for the text, and partly Hangul? What ``valid_answer`` asks besides likeness."""
    text = squeeze(F.coalesce(out, F.lit("")))
    return (text != "") & ~asks_for_text(text) & (hangul_ratio(text) >= VALID_RATIO)
