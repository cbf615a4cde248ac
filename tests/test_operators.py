"""Operators on small cases: fusion, neighbours, trees, layout, evidence, navigation, streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kbspark.config import Config
from kbspark.operators import agent, layout, loop, models, navigate, resume, search, store, tree
from kbspark.streaming import flows


def test_fusion(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 1.0)], "id string, score double")
    b = spark.createDataFrame([("x", 9.0), ("w", 8.0), ("y", 7.0)], "id string, score double")
    got = {r.id: r.score for r in search.rrf([a, b]).collect()}
    assert got["x"] == 0.983607 and got["y"] == round(30 / 62 + 30 / 63, 6)
    assert search.grade(a.limit(0)).first().grade == "empty"


def test_neighbours_within_budget(spark):
    chunks = spark.createDataFrame([(1, i, "c" * n) for i, n in enumerate((25, 40, 10))] + [(2, 0, "h" * 30)], "doc_id long, chunk_seq long, text string")
    hits = chunks.where("(doc_id = 1 and chunk_seq = 1) or doc_id = 2").withColumn("rank", F.when(F.col("doc_id") == 1, 1).otherwise(2))
    near = search.neighbours(hits, chunks)
    assert [(r.doc_id, r.chunk_seq) for r in search.within_budget(hits, near, 100).collect()] == [(1, 0)]


def test_sections(spark):
    df = spark.createDataFrame([("0/1",), ("0/1/2",), ("0/10",)], "p string")
    assert [r.p for r in df.where(search.in_section(F.col("p"), "0/1")).collect()] == ["0/1", "0/1/2"]


def test_trees(spark):
    h = spark.createDataFrame([("d", 1, 10, 0), ("d", 5, 11, 1), ("d", 9, 12, 1), ("d", 12, 13, 0)], "doc_id string, ord int, heading_id long, level int")
    assert {r.heading_id: r.parent for r in tree.nest(h).collect()} == {10: None, 11: 10, 12: 10, 13: None}
    c = spark.createDataFrame([("d", 0, 100), ("d", 5, 101), ("d", 13, 102)], "doc_id string, ord int, content_id long")
    assert {r.content_id: r.heading_id for r in tree.attach_to_headings(c, h).collect()} == {100: None, 101: 11, 102: 13}
    n = spark.createDataFrame([("a", "b"), ("b", "a")], "node_id string, parent_id string")
    with pytest.raises(ValueError):
        tree.closure(n, depth=5)
    deep = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(16)], "node_id string, parent_id string")
    assert tree.closure(deep).where("node = '15'").count() == 16


def test_layout(spark):
    cols = "doc_id string, page int, id long, x0 double, x1 double, top double, bottom double, score double, layout_type string, col_id int, text string"
    b = spark.createDataFrame([("d", 1, 1, 0.0, 10.0, 0.0, 10.0, 0.9, "text", 0, "a"), ("d", 1, 2, 1.0, 10.0, 0.0, 10.0, 0.8, "text", 0, "b"), ("d", 1, 3, 50.0, 60.0, 1.0, 11.0, 0.7, "text", 0, "c")], cols)
    assert sorted(r.id for r in layout.suppress(b).collect()) == [1, 3]
    assert [r.text for r in layout.merge_horizontal(b).collect()] == ["abc"]
    assert [r.id for r in layout.sort_rows(b, 5.0).orderBy("place").collect()] == [1, 2, 3]
    assert layout.greedy_labels([1, 1, 0, 1, 2]) == [1, 1, 2]
    assert [r.reading for r in layout.reading_order(b).orderBy("id").collect()] == [1, 2, 3]


def test_evidence(spark):
    status = spark.createDataFrame([("R1", "SUPPORTED"), ("R2", "MISSING")], "id string, status string")
    req = spark.createDataFrame([("R1", 1.0, False), ("R2", 0.5, False), ("R3", 0.9, False)], "id string, importance double, synthetic boolean")
    assert [r.id for r in agent.gaps(req, status).collect()] == ["R3", "R2"]
    rounds = spark.createDataFrame([("a", 1, "PARTIAL"), ("a", 2, "PARTIAL"), ("a", 3, "PARTIAL")], "id string, round int, status string")
    assert {r["round"]: r.streak for r in agent.no_progress(rounds).collect()} == {1: 0, 2: 1, 3: 2}
    assert agent.coverage(status.limit(0)).first().coverage == 0.0


def test_stores(spark):
    p = spark.createDataFrame([("p",)], "parent_id string")
    c = spark.createDataFrame([], "parent_id string")
    assert store.insert_parents(p, c).count() == 0
    t = spark.createDataFrame([("s", "PENDING"), ("t", "DONE")], "source string, status string")
    assert store.is_running(t, "s") and not store.is_running(t, "t")
    assert store.rename_source(t, "s", "").count() == 2


def test_walk_and_loop():
    nodes = [
        {"node_id": "r", "parent_id": None, "type": "document", "title": "", "summary": "", "text": "", "ord": 0},
        {"node_id": "a", "parent_id": "r", "type": "section", "title": "red apples", "summary": "", "text": "", "ord": 1},
        {"node_id": "b", "parent_id": "r", "type": "section", "title": "blue", "summary": "", "text": "", "ord": 2},
        {"node_id": "x", "parent_id": "a", "type": "paragraph", "title": "", "summary": "", "text": "red apples here", "ord": 1},
        {"node_id": "y", "parent_id": "a", "type": "paragraph", "title": "", "summary": "", "text": "beside", "ord": 2},
        {"node_id": "z", "parent_id": "b", "type": "paragraph", "title": "", "summary": "", "text": "sky", "ord": 1},
    ]
    found, steps = navigate.walk(nodes, "red apples")
    assert [(f["node_id"], f["is_neighbor"]) for f in found] == [("x", False), ("y", True)] and steps
    assert navigate.walk([], "q") == ([], [])
    result = loop.run("q", lambda q: [{"id": "1", "text": "t", "score": 1.0}])
    assert result["answer"] == "[1] t" and result["stop"] == "hard: iterations"
    judged = models.Models(judge=lambda q, r, e: dict.fromkeys(r, "SUPPORTED"))
    assert loop.run("q", lambda q: [{"id": "1", "text": "t", "score": 1.0}], judged)["stop"] == "sufficiency"
    docs = navigate.routed_search(["a", "b", "c"], lambda d: [{"node_id": d}], lambda d, f: d != "a")
    assert [d["node_id"] for d in docs] == ["a"]


def test_resume(spark):
    df = spark.createDataFrame([(["本科", "硕士"], "2000-01-01")], "d array<string>, b string")
    row = df.select(resume.highest_degree(F.col("d")).alias("d"), resume.age(F.to_date("b"), F.lit("2024-05-05").cast("date")).alias("a"), resume.company_norm(F.lit("Acme (China) Ltd")).alias("c")).first()
    assert tuple(row) == ("硕士", 24, "acme")
    cv = spark.createDataFrame([(1, '{"name": "A", "married": "Y"}')], "id int, cv string")
    assert resume.flatten(cv, "name string, married string").first().married == "是"


def test_streams(spark, tmp_path, data):
    spark.read.parquet(f"{data}/documents.parquet").repartition(2).write.parquet(str(tmp_path / "in"))
    q = flows.ingest(spark, str(tmp_path / "in"), "doc_id long, text string, lang string, source string, n_chars long", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/parents")).select("doc_id").distinct().count() == spark.read.parquet(f"{data}/documents.parquet").where("text <> ''").select("doc_id").distinct().count()
    assert flows.shown("ab<", False) == ("ab", "<", False) and flows.shown("a<|DSML x", False) == ("a", "", True)
    assert flows.cited("x[1", 2) == ("x", "[1") and flows.cited("x[1][9] [a", 2) == ("x[1] [a", "")
    assert flows.frames(spark.createDataFrame([("t", "c")], "type string, content string")).first().frame == 'data: {"type":"t","content":"c"}\n\n'


def test_token_stream(spark, tmp_path):
    pd.DataFrame({"message_id": ["m", "m", "m", "n"], "token": ["he", "llo <｜DS", "ML｜x>", "ok"]}).to_parquet(tmp_path / "a.parquet")
    s = spark.readStream.schema("message_id string, token string").parquet(str(tmp_path))
    q = flows.filter_tokens(s).writeStream.format("memory").queryName("shown").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("select message_id, array_join(collect_list(shown), '') s from shown group by 1").collect()
    assert {r.message_id: r.s for r in got} == {"m": "hello ", "n": "ok"}


def test_settings(tmp_path):
    c = Config({"tools": {"web": {"enabled": False}}, "x": {"zero": 0, "none": None}})
    assert c.get("x.zero", 5) == 0 and c.get("x.none", 5) == 5 and c.get("a.b", 1) == 1 and not c.enabled("web") and c.enabled("other")
    c.set("a.b", 2)
    c.save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json")).get("a.b") == 2


def test_embedding_hashes_terms_once(spark):
    from kbspark.operators import chunking

    rows = spark.createDataFrame([(1, "b a b c b"), (2, " ,. "), (3, None)], "id long, text string")
    got = rows.select("id", chunking.hash_embedding(F.col("text"), 8).alias("v"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 1
    places = {r.w: r.p for r in spark.createDataFrame([("a",), ("b",), ("c",)], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(8)).alias("p")).collect()}
    counts = [float(sum(places[w] == i for w in "babcb")) for i in range(8)]
    length = sum(x * x for x in counts) ** 0.5
    assert {r.id: r.v for r in got.collect()} == {1: [x / length for x in counts], 2: [0.0] * 8, 3: [0.0] * 8}
