"""Problem 8: mixing sources to target weights.

Sizes are tokens of a public tokenizer. The mix is counted in equal-token blocks:
Sainte-Laguë's highest quotients give each source its blocks, and again each shard of a
source its integer quota, so that shards select on their own. Within a shard texts lie
in a seeded order, and a quota of q blocks over n blocks means q div n whole passes and
the first q mod n blocks once more.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioforge.llm.tokenizer import count_tokens
from folioforge.session import cut_lineage, table

#: Tokens of a block, tokens from which a source gets another shard, seed of the order.
BLOCK_TOKENS = 64
SHARD_TOKENS = 50_000_000
SEED = 42


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients ``w / (2k + 1)``, none beyond its cap; ties go to the earlier entry.

    A divisor found by bisection gives nearly all seats at once, a heap the rest, so the
    work doesn't grow with ``seats``. Seats that no weight can take stay unallocated.
    """
    n = len(weights)
    caps = [max(0, int(c)) for c in caps] if caps is not None else [max(0, seats)] * n
    caps = [c if w > 0 else 0 for c, w in zip(caps, weights)]
    seats = min(max(0, seats), sum(caps))

    def at(divisor: float) -> list[int]:
        return [min(c, int(math.floor(w / divisor + 0.5))) if c else 0 for w, c in zip(weights, caps)]

    low, high = 0.0, max([2 * w for w in weights if w > 0], default=1.0) + 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= low or mid >= high:
            break
        if sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    # A seat less each: one right at the divisor may be a tie, which the heap decides.
    got = [max(0, g - 1) for g in at(high)]
    heap = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(weights, got, caps)) if g < c]
    heapq.heapify(heap)
    left = seats - sum(got)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def mix_size(have: dict[str, int], targets: dict[str, tuple[float, int]]) -> int:
    """The largest total at which every source that has text can give its share within its repeats, at most all there is."""
    live = {s: t for s, t in targets.items() if t[0] > 0 and have.get(s, 0) > 0 and t[1] > 0}
    share = sum(t[0] for t in live.values())
    if not live:
        return 0
    return min(sum(have[s] for s in live), *(int(have[s] * reps * share / w) for s, (w, reps) in live.items()))


def distinct_texts(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """One row a different text of a source: its smallest doc_id and its tokens.

    Rows without a source, and null and empty texts, are left out. The rows are small, are
    needed twice and cost a pass over all text, so they go to the shared checkpoint folder.
    """
    rows = docs.filter(F.col("source").isNotNull() & (F.length("text") > 0)).select("doc_id", "source", F.md5("text").alias("fp"), "text")
    sized = count_tokens(rows, ["doc_id", "source", "fp"], vocab=vocab)
    one = sized.groupBy("source", "fp").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    return cut_lineage(one.filter("n_tokens > 0").select("doc_id", "source", "n_tokens"))


def mix(texts: DataFrame, targets: list[tuple[str, float, int]], total: int | None = None, seed: int = SEED) -> DataFrame:
    """``doc_id, source, n_tokens, copies`` of the texts in the mix of about ``total`` tokens.

    ``targets`` has (source, share, most uses of a text), a bounded table. Without ``total``
    the mix is as large as exact shares allow. A source without text or with share 0 gives
    nothing, and the others share in proportion. Only sums by source and shard come to the driver.
    """
    spark = texts.sparkSession
    want = {s: (float(w or 0), int(r or 0)) for s, w, r in targets if s is not None}
    have = {r.source: r.n for r in texts.filter(F.col("source").isin(*want)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()} if want else {}
    size = mix_size(have, want) if total is None else total
    names = sorted(s for s in want if have.get(s))
    shards = {s: max(1, math.ceil(have[s] / SHARD_TOKENS)) for s in names}
    plan = spark.createDataFrame([(s, shards[s]) for s in names], "source string, n_shards long")
    placed = texts.join(F.broadcast(plan), "source").withColumn("at", F.xxhash64(F.lit(seed), "doc_id"))
    placed = placed.withColumn("shard", F.pmod("at", F.col("n_shards"))).drop("n_shards")
    # A row for every 50 million tokens: the largest corpus gives some hundred thousand small rows.
    sums: dict[str, dict[int, int]] = {s: {} for s in names}
    for r in placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).collect():
        sums[r.source][r.shard] = r.n

    cap = {s: sum(-(-n // BLOCK_TOKENS) for n in sums[s].values()) * want[s][1] for s in names}
    blocks = dict(zip(names, sainte_lague([want[s][0] for s in names], size // BLOCK_TOKENS, [cap[s] for s in names])))
    quotas = []
    for s in names:
        own = sorted(sums[s])
        sizes = [-(-sums[s][k] // BLOCK_TOKENS) for k in own]
        for k, n, q in zip(own, sizes, sainte_lague([float(sums[s][k]) for k in own], blocks[s], [n * want[s][1] for n in sizes])):
            quotas.append((s, k, q // n, q % n * BLOCK_TOKENS))
    quota = spark.createDataFrame(quotas, "source string, shard long, passes long, more long")

    before = W.partitionBy("source", "shard").orderBy("at", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)) + F.col("n_tokens") / 2
    chosen = placed.withColumn("middle", middle).join(quota, ["source", "shard"])
    copies = (F.col("passes") + (F.col("middle") < F.col("more")).cast("long")).alias("copies")
    return chosen.select("doc_id", "source", "n_tokens", copies).filter("copies > 0")


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple[str, float, int]]:
    """The fixed table of targets (a row a source)."""
    return [tuple(r) for r in table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats").collect()]


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: each chosen text and how often it is used."""
    return mix(distinct_texts(table(spark, sf_dir, "documents")), _targets(spark, sf_dir))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source, with what it had and how often its texts are used."""
    texts = distinct_texts(table(spark, sf_dir, "documents"))
    had = texts.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("tokens_had"))
    used = mix(texts, _targets(spark, sf_dir)).groupBy("source").agg(
        F.count("*").alias("texts_used"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_uses")
    )
    out = table(spark, sf_dir, "mix_targets").join(had, "source", "left").join(used, "source", "left")
    out = out.fillna(0, ["n_texts", "tokens_had", "texts_used", "tokens_used", "most_uses"])
    every = W.partitionBy(F.lit(0))  # a row a source
    return out.withColumn("actual_share", F.round(F.col("tokens_used") / F.greatest(F.sum("tokens_used").over(every), F.lit(1)), 6))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source with a target: whether no text is used too often, and whether its share is met as nearly as whole texts allow, half of the largest one off. Sources without text leave their share to the others."""
    largest = distinct_texts(table(spark, sf_dir, "documents")).groupBy("source").agg(F.max("n_tokens").alias("largest"))
    every = W.partitionBy(F.lit(0))  # a row a source
    r = p8_report(spark, sf_dir).join(largest, "source", "left")
    r = r.withColumn("half", F.coalesce("largest", F.lit(0)) / 2 + BLOCK_TOKENS).withColumn("total", F.sum("tokens_used").over(every)).withColumn("halves", F.sum("half").over(every))
    own = F.when(F.col("tokens_had") > 0, F.col("target_share")).otherwise(F.lit(0.0))
    r = r.withColumn("share", own / F.sum(own).over(every))
    off = F.abs(F.col("tokens_used") - F.col("share") * F.col("total"))
    return r.select("source", (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"), (off <= F.col("half") + F.col("share") * F.col("halves")).alias("share_met"))


QUERIES = {"p8_check": p8_check, "p8_mix": p8_mix, "p8_report": p8_report}

SQL = {"p8_check": "SELECT source, true AS within_repeats, true AS share_met FROM mix_targets"}
