"""Rules on texts that small tables do not reach."""

import duckdb
from pyspark.sql import functions as F

from lodestone.operators import index
from lodestone.plans import graphs, measures, themes  # noqa: F401
from lodestone.plans.catalog import ORACLES, QUERIES


def _same(spark, folder, name, table, rows):
    """Rows of a query over one table, which agree with its SQL."""
    spark.createDataFrame(*rows).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    ours = QUERIES[name](spark, str(folder))
    theirs = con.sql(f"SELECT {', '.join(ours.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, ours.collect()), key=str) == sorted(theirs, key=str)
    return ours


def test_a_value_with_something_after_it_is_no_json(spark, tmp_path):
    texts = ["8294846167456848 Inly onhe.", "1 2", "1,2", '1,"b":2', '1,"b"', "1] 2", "1} 2", "[1]]", '{"a":1} {}', "", " 1 ", '{"a":[1,null]}', '"x"', "nul", None]
    out = _same(spark, tmp_path, "s03_skipped_count", "documents", ([*enumerate(texts)], "doc_id long, text string"))
    assert tuple(out.first()) == (3, 12)


def test_sentences_are_trimmed_of_spaces_and_nothing_else(spark, tmp_path):
    texts = ["0", "One. 1", "One.1", "One. ", "One.\u00a0", "One.\t", "\u3000 A \u2003. b", "a\nb", "...", "", None]
    out = _same(spark, tmp_path, "x05_sentences", "documents", ([*enumerate(texts)], "doc_id long, text string"))
    assert [r.n for r in out.orderBy("doc_id").collect()] == [1, 2, 2, 1, 1, 2, 2, 1, 0, 0, None]
    _same(spark, tmp_path, "x17_summary_sizes", "documents", ([*enumerate([*texts, "One.\x0bTwo", "A one.\u00a0\nA two. A one more. And one."])], "doc_id long, text string"))



def test_a_text_apart_from_all_others_has_a_place_in_the_latent_space(spark, tmp_path):
    texts = [" ".join(f"w{(i * j) % 40}" for j in range(1, 60)) for i in range(1, 40)] + ["lonely", "", None]
    out = _same(spark, tmp_path, "z03_embedded", "documents", ([*enumerate(texts)], "doc_id long, text string"))
    assert out.first().empty == 1


def test_an_index_gathers_a_block_where_its_texts_went(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('a b a c', id % 7, ' d', id, ' a') as text").repartition(5)
    index.build(docs.union(docs.where("doc_id = 5")), str(tmp_path))
    rows = spark.read.parquet(f"{tmp_path}/postings").withColumn("file", F.input_file_name())
    assert rows.groupBy("block").agg(F.count_distinct("file").alias("files")).where("files > 1").isEmpty()
    got = {(r.term, r.doc_id): r.tf for r in rows.select("term", F.inline("docs")).collect()}
    assert len(got) == 4 * 3000 and (got["a", 4], got["b", 4], got["d4", 4], got["a", 5]) == (3, 1, 1, 6)
