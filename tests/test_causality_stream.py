"""The causality fold as a stream: drained twice, late rows, evicted state, the same rows as a plain fold."""

import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np

from lodestone.plans import notions  # noqa: F401
from lodestone.plans.catalog import ORACLES, QUERIES
from lodestone.streaming import causality as cs
from lodestone.streaming.twins import change_feed, drained

SCHEMA = "user_id long, ts timestamp_ntz, event_id long, kind string"
START = datetime(2024, 1, 1)
WIDTH = timedelta(minutes=256)


def plain(events, until):
    """Pairs whose target lies in a bucket that ends at or before until."""
    out = Counter()
    for user in {e[0] for e in events}:
        mine = sorted((e[1], e[2], e[3]) for e in events if e[0] == user)
        for i, (at, _, target) in enumerate(mine):
            if START + ((at - START) // (2 * WIDTH) + 1) * 2 * WIDTH > until:
                continue
            for before, _, source in mine[max(0, i - 512) : i]:
                gap = at - before
                if timedelta(0) < gap < WIDTH:
                    out[source, target, next((x for x in cs.LAGS if gap <= timedelta(minutes=x)), 128)] += 1
    return out


def test_occupancy_and_lags():
    n = cs.OCCUPANCY + 2
    second = 1_000_000
    got = cs.pairs_of(np.arange(n) * second, np.arange(n), np.array([str(i) for i in range(n)], dtype=object), np.arange(n) == n - 1)
    assert set(got.target) == {str(n - 1)} and set(got.source) == {str(i) for i in range(1, n - 1)}
    at = np.array([0, 60, 60, 255 * 60, 256 * 60]) * second
    got = cs.pairs_of(at, np.arange(5), np.array(list("abcde"), dtype=object), np.ones(5, dtype=bool))
    found = {(r.source, r.target): r.lag for r in got.itertuples()}
    assert found == {("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 128, ("b", "d"): 128, ("c", "d"): 128, ("b", "e"): 128, ("c", "e"): 128, ("d", "e"): 1}
    assert cs.pairs_of(at[:1], np.arange(1), np.array(["a"], dtype=object), np.ones(1, dtype=bool)).empty


def test_drained_twice(spark, tmp_path):
    global START
    # buckets are counted from the epoch
    epoch = datetime(1970, 1, 1)
    START = epoch + (datetime(2024, 1, 1) - epoch) // (2 * WIDTH) * 2 * WIDTH
    rng = random.Random(3)
    make = lambda a, b, ids: [(rng.randrange(3), START + timedelta(minutes=rng.randrange(a, b)), i, rng.choice("xyz")) for i in ids]
    first = make(0, 1300, range(120))
    second = make(1300, 3000, range(200, 320))
    late = [(0, START + timedelta(minutes=5), 900, "late")]
    odd = [(None, START, 901, "x"), (1, None, 902, "x"), (1, START + timedelta(minutes=1900), 903, None)]
    feed, where = tmp_path / "feed", f"file://{tmp_path}/drain"
    run = lambda: drained(change_feed(spark, str(feed), spark.createDataFrame([], SCHEMA).schema), lambda s: cs.causality(s, "user_id", "ts", "event_id", "kind", windows=2), "append", where)

    def counted():
        return Counter({(r.source, r.target, r.lag): r.n for r in run().groupBy("source", "target", "lag").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()})

    spark.createDataFrame(first, SCHEMA).coalesce(1).write.mode("append").parquet(str(feed))
    until = max(e[1] for e in first) - timedelta(hours=2)
    got = counted()
    assert got == plain(first, until) and got
    spark.createDataFrame([*second, *late, *odd], SCHEMA).coalesce(1).write.mode("append").parquet(str(feed))
    until = max(e[1] for e in second) - timedelta(hours=2)
    assert counted() == plain(first + second, until)  # the late row is in no pair, its bucket was folded before
    assert counted() == plain(first + second, until)  # nothing new


def test_entities_of_one_key_make_no_pairs():
    at = np.array([0, 60, 30, 90, 120]) * 1_000_000
    got = cs.pairs_of(at, np.arange(5), np.array(list("aabbc"), dtype=object), np.ones(5, dtype=bool), np.array(["u", "u", "v", "v", "w"], dtype=object))
    assert sorted(map(tuple, got.itertuples(index=False))) == [("a", "a", 1, 1), ("b", "b", 1, 1)]


def test_all_pairs_are_counted_stepwise_or_by_search(monkeypatch):
    rng = np.random.default_rng(5)
    n = 1500
    # a busy entity, a sparse one and one of a label an event; times come twice
    who = np.repeat(["busy", "rare", "many"], [900, 200, 400])
    at = np.concatenate([rng.integers(0, 3 * 256 * 60, 900), rng.integers(0, 40 * 256 * 60, 200), rng.integers(0, 300 * 60, 400)]) * 1_000_000
    at[:900:9] = at[1:900:9]
    at[900:910] = at[900] + np.arange(10) * 128 * 60_000_000
    labels = np.concatenate([rng.choice(list("xyz"), 1100), np.arange(400).astype(str)]).astype(object)
    own, ids = rng.random(n) < 0.7, rng.permutation(n)
    expected = Counter()
    for i in range(n):
        for j in np.flatnonzero((who == who[i]) & (at < at[i]) & (at > at[i] - 256 * 60_000_000)) if own[i] else []:
            expected[labels[j], labels[i], next((x for x in cs.LAGS if at[i] - at[j] <= x * 60_000_000), 128)] += 1
    searched = []
    plainly = cs._searched
    monkeypatch.setattr(cs, "_searched", lambda *part: searched.append(len(part[0])) or plainly(*part))
    for few, sizes in ((cs._FEW, [900]), (1 << 40, [])):  # with and without searches
        monkeypatch.setattr(cs, "_FEW", few)
        searched.clear()
        got = cs.pairs_of(at, ids, labels, own, who.astype(object), None)
        assert Counter({(r.source, r.target, r.lag): r.n for r in got.itertuples()}) == expected and len(got) == len(expected)
        assert searched == sizes
    none = np.array([], dtype=np.int64)
    assert cs.pairs_of(none, none, none.astype(object), none.astype(bool), none.astype(object), None).empty


def test_no_source_within_the_window_is_left_out(spark, tmp_path):
    n = 1200
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i), 1, "ab"[i % 2]) for i in range(n)] + [(n, start + timedelta(days=9), 2, "z")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["r21_causality_stream"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    theirs = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['r21_causality_stream']})").fetchall()
    ours = sorted(map(tuple, got.collect()))
    assert ours == sorted(theirs) and sum(r[3] for r in ours) == n * (n - 1) // 2
