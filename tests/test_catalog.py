"""Catalog queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.plans import catalog, decisions, fields, lanes, measures, recall, signals  # noqa: F401

SF = "/root/testdata/sf0.001"
SOME = ["s01_scan", "s06_upsert", "f19_default_filters", "f23_bit_fields", "j01_rank_fusion", "j07_lag_pairs", "a01_column_statistics", "a05_cooccurrence", "a17_current_state", "a29_mutual_information", "a30_divergence", "w04_modified_z", "t07_bm25", "q01_hybrid_recall", "g09_rules", "r25_field_last_writer", "a15_cascade", "a43_recall_scores", "a50_vocabulary", "a51_merkle", "d02_packed_clock", "d29_spectrum", "d37_keyed_digest", "g24_successors", "j08_conflict_pairs", "x35_fnv1a", "y05_attributes", "s25_inventory", "f28_paging", "f26_illegal_transitions", "d12_simhash", "d15_float_simhash", "x18_query_precision", "x07_spanner", "q02_float_lane", "q04_precise_recall", "q07_session_hybrid", "q08_walk_recall", "q13_vague_recall", "j05_span_fusion", "d18_cosine_top_k", "a06_temporal_matrix", "w07_categorical_trajectory", "w13_cohesion_roster", "g02_restart_walk", "g01_centrality", "r15_maintenance", "r02_drained_stream", "z14_recalled_together", "a12_private_or", "d34_field_fit", "d35_cooccurrence_score", "d36_temporal_score", "z08_multi_index", "z11_multi_seed_concepts", "z19_graph_lane", "z24_container_pruning", "r22_daily_tournament", "r14_dreaming", "r04_settled_jobs", "r05_cursor", "x13_trailer", "g11_estate_rules", "g15_cover_deltas", "d31_split_mix"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    theirs = duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(theirs.columns)
    assert columns == sorted(ours.columns)
    key = lambda df: sorted(tuple(round(x, 5) if isinstance(x, float) else str(x) for x in row) for row in df[columns].itertuples(index=False))
    assert key(ours) == key(theirs)


def test_stream_gives_the_batch_result(spark, tmp_path):
    from lodestone.streaming.twins import change_feed, drained, windowed

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    streamed = drained(change_feed(spark, str(tmp_path / "events"), events.schema), windowed)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, windowed(events).collect()))


def test_dates():
    from datetime import date

    from lodestone.operators.dates import over_years, parse

    day = lambda text: parse(text)[:2]
    assert day("on 9 January 2024?") == (date(2024, 1, 9),) * 2 and day("March 3rd, 2023") == (date(2023, 3, 3),) * 2
    assert day("in Feb 2024") == (date(2024, 2, 1), date(2024, 2, 29)) and day("2023 was fine") == (date(2023, 1, 1), date(2023, 12, 31))
    assert day("2024-01-05 or 2023") == (date(2024, 1, 5),) * 2 and parse("no date here") is None and parse("31 February 2024").start == date(2024, 2, 1)
    assert parse("every december").month == 12 and len(over_years(parse("every december"), 2020, 2022)) == 3
    assert parse("2024-01-05").padded(99).start == date(2023, 12, 26)


def test_dataset_lifecycle(spark, tmp_path):
    from lodestone.operators import datasets as ds

    path, csv = str(tmp_path / "ds"), tmp_path / "rows.csv"
    csv.write_text("id,name\n2,b\n1,a\n")
    assert ds.create(spark, path, {"id": "int", "name": "text"}).count() == 0
    ds.append(spark.createDataFrame([(5, "x")], "id long, name string"), path, "id")
    assert [r.name for r in ds.opened(spark, path).collect()] == ["x"]
    assert ds.drop(spark, path) and not ds.drop(spark, path)
    assert sorted(r.id for r in ds.filed(spark, path, {"id": "int", "name": "text"}, str(csv), "id").collect()) == [1, 2]
    ds.drop(spark, path)
    csv.write_text("id,name\nnot a number,b\n")
    with pytest.raises(Exception):
        ds.filed(spark, path, {"id": "int", "name": "text"}, str(csv))
    assert not (tmp_path / "ds").exists()
    with pytest.raises(ValueError):
        ds.declared({"bad name": "int"})


def test_components_of_a_long_path(spark):
    from lodestone.operators.mining import communities

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "src long, dst long")
    assert {r.id: r.community for r in communities(edges).collect()} == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_morton_and_splitmix(spark):
    from lodestone.operators import bits

    assert bits.splitmix(0, 1) == [0xE220A8397B1DCDAF]
    row = (-5, 77, 1 << 40, -(1 << 63))
    key = spark.createDataFrame([row], "b0 long, b1 long, b2 long, b3 long").select(bits.morton()).first()[0]
    bit = lambda i: row[i // 64] >> (i % 64) & 1
    assert int(key, 16) == sum(bit(i) << 2 * i | bit((97 * i + 41) & 255) << 2 * i + 1 for i in range(256)) and len(key) == 128


def test_null_rows_are_kept_by_delete(spark):
    from pyspark.sql import functions as F

    from lodestone.operators.datasets import deleted

    df = spark.createDataFrame([(1, 5), (2, None), (3, 0)], "id int, x int")
    assert [r.id for r in deleted(df, F.col("x") > 1).orderBy("id").collect()] == [2, 3]


def test_strengths_are_the_likeliest(spark):
    import numpy as np

    from lodestone.operators.preference import fit, strengths

    wins = np.array([[0, 7, 4, 9], [3, 0, 6, 2], [1, 5, 0, 8], [2, 1, 3, 0]], float)
    found, error = fit(wins)
    likelihood = lambda s: (wins * -np.log1p(np.exp(s[None, :] - s[:, None]))).sum()
    for i in range(4):
        for step in (-1e-3, 1e-3):
            moved = found.copy()
            moved[i] += step
            assert likelihood(moved) < likelihood(found)
    assert abs(found.mean()) < 1e-9 and (error > 0).all()
    rows = [(str(i), str(j), int(wins[i, j])) for i in range(4) for j in range(4) if wins[i, j]]
    got = strengths(spark.createDataFrame(rows, "winner string, loser string, n long")).collect()
    assert [r.item for r in got] == [str(i) for i in np.argsort(-found)] and all(r.low < r.strength < r.high for r in got)
    for bad in ([("a", "a", 1)], [("a", "b", 1)], [("a", "b", 1), ("b", "a", 1), ("c", "a", 1)], []):
        with pytest.raises(ValueError):
            strengths(spark.createDataFrame(bad, "winner string, loser string, n long"))


def test_rows_within_bits_are_all_found_once(spark):
    import random

    from lodestone.operators.search import within_bits

    dealt = random.Random(3)
    rows = [(i, dealt.getrandbits(12)) for i in range(300)] + [(300, 0), (301, 0), (302, None)]
    df = spark.createDataFrame(rows, "id long, bits long")
    got = within_bits(df, df.where("id % 3 = 0").withColumnRenamed("id", "probe"), "id", "bits", 12, 3)
    expected = sorted((p, i, (a ^ b).bit_count()) for p, a in rows if p % 3 == 0 and a is not None for i, b in rows if b is not None and (a ^ b).bit_count() <= 3)
    assert sorted(map(tuple, got.select("probe", "id", "distance").collect())) == expected


def test_noise_and_private_or_of_no_rows(spark):
    from lodestone.operators import bits

    noise = bits.laplace(1, 20_000, 2.0)
    assert abs(sum(noise) / 20_000) < 0.1 and abs(sum(map(abs, noise)) / 20_000 - 2.0) < 0.1
    empty = bits.private_or(spark.createDataFrame([], "x long"), "x", 3, 1.0, 1, 7)
    assert [tuple(r) for r in empty.orderBy("bit").collect()] == [(0, False), (1, False), (2, False)]
