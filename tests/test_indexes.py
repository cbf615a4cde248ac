"""The stored indexes against full scans, and how much of them is read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.operators import block_index
from kbspark.operators import search as S
from kbspark.operators.vector_index import VectorIndex, recall


@pytest.fixture(scope="module")
def zipf(spark, tmp_path_factory):
    """2,000 texts of a few very common words and many rare ones, nulls and empty texts among them, and their index."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(1500)]
    weights = [1 / (i + 1) for i in range(1500)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(2000)] + [(3000, None), (3001, ""), (3002, "w0 " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("term", F.lit("mine")).repartition(4)
    path = f"file://{tmp_path_factory.mktemp('blocks')}/index"
    block_index.write(df, path, block=16)
    return df, path


QUESTIONS = [(1, "w0"), (2, "w0 w1 w2"), (3, "w900 w0 w1"), (4, "w1400"), (5, "nowhere"), (6, None), (7, "W3 w3 w700, w250!"), (8, "w0 w1 w2 w3 w4 w5 w6 w7 w1200 w800")]


def test_blocks_give_the_rows_of_a_full_scan(spark, zipf):
    df, path = zipf
    questions = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    got = sorted((r.query_id, r.rank, r.key, r.score) for r in block_index.Reader(spark, path).search(questions, 7).collect())
    expected = []
    for q, text in QUESTIONS:
        expected += [(q, i + 1, r.doc_id, r.score) for i, r in enumerate(S.bm25_topk(df, text or "", 7).collect())]
    assert got == sorted(expected)
    assert block_index.Reader(spark, path).search(questions.limit(0)).count() == 0


def test_blocks_below_the_threshold_are_not_read(spark, zipf):
    _, path = zipf
    size = {r.term: r.df for r in spark.read.parquet(f"{path}/terms").collect()}
    reader = block_index.Reader(spark, path)
    rare = spark.createDataFrame([(1, "w900 w0 w1")], "query_id long, text string")
    reader.search(rare, 1, count=True).count()
    whole = size["w900"] + size["w0"] + size["w1"]
    assert reader.read["second"] <= size["w900"] + 0.2 * whole and sum(reader.read.values()) < 0.5 * whole
    common = spark.createDataFrame([(1, "w0")], "query_id long, text string")
    reader.search(common, 5, count=True).count()
    assert reader.read["second"] < 0.2 * size["w0"]


def test_blocks_are_bounded_and_empty_tables_work(spark, zipf, tmp_path):
    _, path = zipf
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.agg(F.max("size")).first()[0] <= 48 and blocks.where("size <> size(entries)").count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    block_index.write(empty, f"file://{tmp_path}/none")
    assert block_index.Reader(spark, f"file://{tmp_path}/none").search(spark.createDataFrame(QUESTIONS, "query_id long, text string")).count() == 0


# --- vectors -------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clustered(spark):
    """40 clusters of 30 vectors, repeats, and vectors without a direction."""
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(40, 16))
    rows = [(c * 30 + i, [float(x) for x in middles[c] + 0.1 * rng.normal(size=16)]) for c in range(40) for i in range(30)]
    rows += [(5000, rows[0][1]), (5001, rows[0][1]), (6000, None), (6001, []), (6002, [0.0] * 16), (6003, [None] + [1.0] * 15), (6004, [float("nan")] * 16), (6005, [float("inf")] * 16), (None, rows[0][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("mine")).repartition(3)


def plain_best(rows, questions, k):
    known = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, v in questions:
        x = np.array(v, float)
        best = sorted((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 6), i) for i, y in known)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def as_rows(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in df.collect())


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:2] == y[:2] and abs(x[3] - y[3]) < 2e-6


def test_vector_index(spark, clustered, tmp_path):
    rows = [(r.vec_id, r.embedding) for r in clustered.collect()]
    asked = [(i, v) for i, v in rows if i in (0, 31, 700, 5000)]
    questions = spark.createDataFrame([*asked, (9, None), (10, [0.0] * 16)], "query_id long, vector array<float>")
    path = f"file://{tmp_path}/vectors"
    index = VectorIndex(spark, path).build(clustered.where("vec_id < 600 or vec_id is null"), 40, batch="a").insert(clustered.where("vec_id >= 600"), batch="b")
    expected = plain_best(rows, asked, 7)
    got = as_rows(index.search(questions, 7, probes=2))
    close(got, expected)
    assert {x[:3] for x in got} == {x[:3] for x in expected}
    # a batch that is put in again counts once
    index.insert(clustered.where("vec_id >= 600"), batch="b")
    close(as_rows(index.search(questions, 7, probes=2)), expected)
    # few lists suffice where vectors lie in clusters
    near = index.search(questions, 7, probes=3, exact=False)
    assert recall(near, index.search(questions, 7)).agg(F.min("recall")).first()[0] >= 0.9
    everything = index.search(questions, 2000, probes=1)
    assert everything.groupBy("query_id").count().where("count <> 1202").count() == 0


def test_vector_index_reads_probed_lists_only(spark, clustered, tmp_path):
    path = f"file://{tmp_path}/vectors"
    index = VectorIndex(spark, path).build(clustered, 40)
    one = index._stored([3])
    files = [f for f in one.inputFiles()]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert files and "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [(list" in plan
    read = {f.split("list=")[1].split("/")[0] for f in one.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert read == {"3"}
    assert VectorIndex(spark, f"file://{tmp_path}/none").build(clustered.limit(0)).search(clustered.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))).count() == 0


def test_many_probes_move_no_vectors_twice(spark, tmp_path):
    """Questions' vectors are joined to their probes by a shuffle, sampling sorts no whole table, and a small list is one file."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(900)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(8)
    index = VectorIndex(spark, f"file://{tmp_path}/v").build(vectors, 12)
    assert len(spark.read.parquet(f"{index.path}/vectors").inputFiles()) == 12
    questions = vectors.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = index.search(questions, 3, probes=2)
    got, expected = as_rows(found), plain_best(rows, [r for r in rows if r[0] % 5 == 0], 3)
    close(got, expected)
    assert {x[:3] for x in got} == {x[:3] for x in expected}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "cogroup" in plan.lower() and "rightHint=(strategy=shuffle_hash)" in plan


def test_block_index_moves_counts(spark, tmp_path):
    """Terms are counted where a text is read; rows of one key are added up."""
    docs = spark.createDataFrame([(1, "b a b"), (1, "a c"), (2, "b"), (3, None), (None, "a")], "doc_id long, text string")
    one = F.transform(F.split("text", " "), lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("tf")))
    assert [tuple(map(tuple, r.c)) if r.c else None for r in docs.select(block_index.counts_of(one).alias("c")).collect()] == [(("a", 1), ("b", 2)), (("a", 1), ("c", 1)), (("b", 1),), None, (("a", 1),)]
    block_index.write(docs, f"file://{tmp_path}/i")
    held = spark.read.parquet(f"file://{tmp_path}/i/blocks").select("term", F.explode("entries").alias("e")).select("term", "e.key", "e.tf", "e.n").collect()
    assert sorted(map(tuple, held)) == [("a", 1, 2, 5), ("b", 1, 2, 5), ("b", 2, 1, 1), ("c", 1, 1, 5)]
    assert tuple(spark.read.parquet(f"file://{tmp_path}/i/totals").first()) == (4, 1.75)


def test_wide_questions_read_postings_once(spark, zipf, tmp_path, monkeypatch):
    """Many common terms: their postings are added up once, where look-ups for candidates would read them again. Hot terms are cut by several tasks, and nothing of them is lost."""
    df, path = zipf
    monkeypatch.setattr(block_index, "HOT", 300)
    monkeypatch.setattr(block_index, "SLICED", 700)
    monkeypatch.setattr(block_index, "ASKED", 2)
    asked = [(q, " ".join(f"w{i}" for i in range(q, 60, 3))) for q in range(3)] + [(7, "w0"), (8, None)]
    expected = sorted((q, i + 1, r.doc_id, r.score) for q, text in asked for i, r in enumerate(S.bm25_topk(df, text or "", 7).collect()))
    questions = spark.createDataFrame(asked, "query_id long, text string")
    block_index.write(df, f"file://{tmp_path}/hot", block=16)
    held = [{(r.term, e.key, e.tf, e.n) for r in spark.read.parquet(f"{x}/blocks").where("term in ('w0', 'w1', 'w900')").collect() for e in r.entries} for x in (path, f"file://{tmp_path}/hot")]
    assert held[0] == held[1] and held[0]
    assert spark.read.parquet(f"file://{tmp_path}/hot/blocks").where("term = 'w0'").agg(F.max("size")).first()[0] <= 64
    for at in (path, f"file://{tmp_path}/hot"):
        reader = block_index.Reader(spark, at)
        assert sorted((r.query_id, r.rank, r.key, r.score) for r in reader.search(questions, 7, count=True).collect()) == expected
        df_sum = spark.read.parquet(f"{at}/terms").where(F.col("term").isin([f"w{i}" for i in range(60)])).agg(F.sum("df")).first()[0]
        assert df_sum <= reader.read["wide"] <= 2 * df_sum and reader.read["second scores"] == 0
