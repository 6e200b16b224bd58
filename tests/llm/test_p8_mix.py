"""Mixing: quotients against a naive count, caps, and the shares that come out."""

from hypothesis import example, given, settings
from hypothesis import strategies as st

from folioforge.llm import p8_mix as p8


def _naive(weights, seats, caps):
    got = [0] * len(weights)
    for _ in range(seats):
        open_ = [(-weights[i] / (2 * got[i] + 1), i) for i in range(len(weights)) if got[i] < caps[i] and weights[i] > 0]
        if not open_:
            break
        got[min(open_)[1]] += 1
    return got


@settings(max_examples=200, deadline=None)
@example([(6, 2), (9, 3), (12, 4), (36, 11)], 19)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), min_size=1, max_size=7), st.integers(0, 90))
def test_sainte_lague_is_the_highest_quotients(rows, seats):
    weights, caps = [float(w) for w, _ in rows], [c for _, c in rows]
    assert p8.sainte_lague(weights, seats, caps) == _naive(weights, seats, caps)


def test_many_seats_cost_no_more():
    got = p8.sainte_lague([0.5, 0.3, 0.2], 10**12)
    assert sum(got) == 10**12 and abs(got[0] / 10**12 - 0.5) < 1e-9


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fp string")


def test_shares_repeats_and_copies_of_a_text(spark, monkeypatch):
    monkeypatch.setattr(p8, "SHARD_TOKENS", 2000)
    monkeypatch.setattr(p8, "BLOCK_TOKENS", 8)
    rows = [(i, f"text number {i} of the large source " * 3, "large", "x") for i in range(400)]
    rows += [(1000 + i, f"small text {i} " * 5, "small", "x") for i in range(10)]
    rows += [(1100 + i, f"small text {i} " * 5, "small", "x") for i in range(10)]  # the same texts again
    rows += [(2000, None, "large", "x"), (2001, "", "large", "x"), (2002, "no source", None, "x"), (2003, "no target", "other", "x")]
    texts = p8.distinct_texts(_docs(spark, rows))
    assert texts.filter("source = 'small'").count() == 10
    got = p8.mix(texts, [("large", 0.8, 1), ("small", 0.2, 3), ("absent", 0.0, 4)]).collect()
    used = {}
    for r in got:
        used[r.source] = used.get(r.source, 0) + r.n_tokens * r.copies
        assert 1 <= r.copies <= {"large": 1, "small": 3}[r.source]
    assert set(used) == {"large", "small"}
    assert abs(used["small"] / sum(used.values()) - 0.2) < 0.03
    again = p8.mix(texts, [("large", 0.8, 1), ("small", 0.2, 3), ("absent", 0.0, 4)]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_empty_corpus(spark):
    texts = p8.distinct_texts(_docs(spark, []))
    assert p8.mix(texts, [("a", 1.0, 1)]).count() == 0
    assert p8.mix(texts, []).count() == 0


def test_queries_with_sql_agree(spark, sf):
    import duckdb

    from folioforge.llm import registry

    c = duckdb.connect()
    for t in ("documents", "txt_files", "chapters", "split_limits", "mix_targets"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, sf).toPandas()
        want = c.execute(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        key = lambda df: sorted(map(tuple, df[cols].astype(str).to_numpy().tolist()))  # noqa: B023, E731
        assert key(got) == key(want), name
