"""The jobs: growing input, reruns, runs that were lost halfway, and awkward rows."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import common, evidence, knowledge_base
from kbspark.operators import chunking, tiers
from kbspark.operators.batches import Batches
from tests.conftest import ROOT

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, folder, name, rows):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    df.coalesce(1).write.parquet(f"{folder}/{name}")


def as_rows(df):
    return sorted(map(repr, df.collect()))


FIRST = [(1, "one text " * 300, "a"), (2, "second", "a"), (3, "", "b"), (4, None, "b"), (None, "nobody's", "b"), (5, "to be changed", "a"), (6, "to be withdrawn", "a")]
LATER = [(5, "changed now", "a"), (6, None, "a"), (7, "new", "c"), (2, "second", "a"), (1, "one text " * 300, "renamed")]


def test_the_knowledge_base_takes_only_what_is_new(spark, tmp_path):
    folder, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("documents", "tables", "checkpoint"))
    put(spark, folder, "a.parquet", FIRST)
    tables = knowledge_base.run(spark, f"{folder}/*", out, checkpoint)
    assert {r.key: r.live for r in tables.ledger().collect()} == {1: True, 2: True, 3: True, 4: False, 5: True, 6: True}
    before = as_rows(knowledge_base.contents(tables))
    knowledge_base.run(spark, f"{folder}/*", out, checkpoint)  # nothing new
    assert as_rows(knowledge_base.contents(tables)) == before
    assert [r.batch for r in spark.read.parquet(f"{out}/ledger").select("batch").distinct().collect()] == [0]

    put(spark, folder, "b.parquet", LATER)
    tables = knowledge_base.run(spark, f"{folder}/*", out, checkpoint)
    ledger = {r.key: (r.live, r.batch) for r in tables.ledger().collect()}
    assert ledger == {1: (True, 1), 2: (True, 0), 3: (True, 0), 4: (False, 0), 5: (True, 1), 6: (False, 1), 7: (True, 1)}
    assert {r.key for r in spark.read.parquet(f"{out}/changes/batch=1").collect()} == {1, 5, 6, 7}  # 2 came again as it was
    whole = {i: (i, t, s) for i, t, s in [*FIRST, *LATER]}
    put(spark, f"file://{tmp_path}/fresh", "all.parquet", list(whole.values()))
    fresh = knowledge_base.run(spark, f"file://{tmp_path}/fresh/*", f"file://{tmp_path}/fresh-tables", f"file://{tmp_path}/fresh-checkpoint")
    assert as_rows(knowledge_base.contents(tables)) == as_rows(knowledge_base.contents(fresh))


def test_a_run_that_is_lost_halfway_counts_for_nothing_and_is_taken_up(spark, tmp_path, monkeypatch):
    folder, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("documents", "tables", "checkpoint"))
    put(spark, folder, "a.parquet", FIRST)
    tables = knowledge_base.run(spark, f"{folder}/*", out, checkpoint)
    before = as_rows(knowledge_base.contents(tables))
    put(spark, folder, "b.parquet", LATER)
    write = Batches.write

    def lost(self, name, *rest):
        if name == "ledger":
            raise RuntimeError("lost")
        write(self, name, *rest)

    monkeypatch.setattr(Batches, "write", lost)
    with pytest.raises(Exception, match="lost"):
        knowledge_base.run(spark, f"{folder}/*", out, checkpoint)
    monkeypatch.undo()
    assert as_rows(knowledge_base.contents(tables)) == before  # chunks and postings of the lost batch are there, but don't count
    tables = knowledge_base.run(spark, f"{folder}/*", out, checkpoint)
    assert {r.key: r.batch for r in tables.ledger().collect()}[5] == 1
    chunks = tables.read("chunks", knowledge_base.CHUNKS, "doc_id")
    assert {r.text for r in chunks.where("doc_id = 5").collect()} == {"changed now"} and chunks.where("doc_id in (4, 6)").count() == 0


def test_of_files_that_come_together_the_newest_counts(spark, tmp_path):
    import os

    for name, text, at in (("x", "newer", 2_000_000_000), ("y", "older", 1_000_000_000)):
        put(spark, f"file://{tmp_path}/documents", name, [(1, text, "a")])
        for f in (tmp_path / "documents" / name).glob("*.parquet"):
            os.utime(f, (at, at))
    tables = knowledge_base.run(spark, f"file://{tmp_path}/documents/*", f"file://{tmp_path}/tables", f"file://{tmp_path}/checkpoint")
    assert [r.text for r in tables.read("chunks", knowledge_base.CHUNKS, "doc_id").collect()] == ["newer"]


def test_one_file_is_a_table_too(spark, data, tmp_path):
    out = f"file://{tmp_path}"
    tables = knowledge_base.run(spark, f"{data}/documents.parquet", f"{out}/tables", f"{out}/checkpoint")
    assert tables.ledger().count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert knowledge_base._pattern("/a/b.parquet") == "/a/b.parque[t]" and knowledge_base._pattern("/a/b/") == "/a/[b]" and knowledge_base._pattern("/a/*") == "/a/*"


def test_evidence_on_awkward_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(40))
    docs = [(1, f"Some title\n{long}"), (2, f"{long} {long}"), (3, "how to pack a very small red box\nnothing else"), (4, None), (5, ""), (None, long), (6, "box"), (7, "w1 w2 box"), (8, "w1 w2 box")]
    questions = [(1, long), (2, "how to pack a very small box"), (3, None), (4, ""), (None, "box"), (5, "unheard of"), (6, "box")]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("tier", F.lit("x")).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(questions, "item_id long, text string").withColumn("rank", F.lit("x")).write.parquet(f"{tmp_path}/q")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    got = evidence.run(spark, f"{tmp_path}/q", f"{tmp_path}/d", f"{tmp_path}/o", {"k": 3})
    assert before == {k: spark.conf.get(k, None) for k in before}
    rows = {(r.query_id, r.rank): (r.doc_id, r.tier) for r in got.collect()}
    assert rows[1, 1] == (1, "quoting") and rows[1, 2] == (2, "quoting") and rows[1, 3][1] == "anchored"
    assert rows[2, 1] == (3, "titled") and {rows[2, 2][1], rows[2, 3][1]} == {"anchored"}
    assert [rows[6, i][0] for i in (1, 2, 3)] == [6, 7, 8] and not {q for q, _ in rows} & {3, 4, 5, None}
    again = as_rows(got)
    assert as_rows(evidence.run(spark, f"{tmp_path}/q", f"{tmp_path}/d", f"{tmp_path}/o", {"k": 3})) == again
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none")
    assert evidence.run(spark, f"{tmp_path}/q", f"{tmp_path}/none", f"{tmp_path}/o2").count() == 0


def test_overlap_join_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    sets = lambda n: [(i, rng.choices([f"t{x}" for x in range(40)], [1 / (x + 1) for x in range(40)], k=rng.randrange(0, 14))) for i in range(n)]
    left, right = sets(60), sets(150)
    got = tiers.overlap_join(spark.createDataFrame(left, "query_id long, terms array<string>"), spark.createDataFrame(right, "key long, terms array<string>"), 4)
    expected = sorted((q, k, float(n)) for q, a in left for k, b in right if (n := len(set(a) & set(b))) >= 4)
    assert sorted(map(tuple, got.collect())) == expected


def test_evidence_hashes_terms_once(spark):
    """Runs of terms are hashed over arrays in a task, not by an expression for each run, and titles are cut into sets once: pairs that met are counted from stored sets."""
    docs = spark.createDataFrame([(1, "A b c d"), (2, "b c\nd e"), (3, None), (4, "b c"), (None, "b c d")], "doc_id long, text string")
    made = tiers.runs(docs, "doc_id", "text", 3)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "xxhash64" not in plan
    got = made.collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got if r.doc_id) == [(False, 1), (False, 1), (False, 2), (False, 2)] and len(got) == 5
    of = lambda i: {(r.a, r.b) for r in got if r.doc_id == i}
    assert len(of(1) & of(2)) == 1 and of(None) == of(1) & of(2) and len(of(1) | of(2)) == 3
    found = tiers.overlap_join(spark.createDataFrame([(1, ["a", "b", "c"])], "query_id long, terms array<string>"), spark.createDataFrame([(2, ["b", "c", "c"]), (3, ["a"]), (4, [])], "key long, terms array<string>"), 2)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 2.0)]
    assert sum("/sets-" in f for f in found.inputFiles()) >= 2


def test_settings_and_command_lines(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"k": 7}))
    assert common.settings(evidence.DEFAULTS, str(tmp_path / "c.json"))["k"] == 7
    with pytest.raises(ValueError, match="unknown"):
        common.settings(evidence.DEFAULTS, None, nothing=1)
    for job, defaults in (("evidence", evidence.DEFAULTS), ("knowledge_base", knowledge_base.DEFAULTS)):
        with open(f"{ROOT}/jobs/{job}.json") as f:
            assert set(json.load(f)) <= set(defaults)
        said = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--help"], cwd=ROOT, capture_output=True, text=True, timeout=60)
        assert said.returncode == 0 and "--config" in said.stdout


def test_quoting_keeps_documents_runs_in_place(spark):
    """The questions' runs are a stored table, whose size lets the documents' runs be looked up where they are."""
    docs = spark.createDataFrame([(1, "a b c d"), (2, "b c d e"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(5, "x b c d", 5)], "query_id long, text string, room int")
    found = tiers.quoting(docs, 3)(asked, None)
    assert sorted(map(tuple, found.collect())) == [(5, 1, 1.0), (5, 2, 1.0)]
    assert any("/runs-" in f for f in found.inputFiles())


def test_chunks_hash_their_terms_once(spark):
    """The job's chunks with vectors, as it makes them."""
    docs = spark.createDataFrame([(1, "one two one")], "doc_id long, text string")
    _, children = chunking.parents_and_children(docs)
    plan = children.withColumn("vector", chunking.hash_embedding(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") == 1


def test_knowledge_base_terms_move_once_and_vectors_stay(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, 0, "Red red sky"), (1, 0, 1, "sky"), (2, 0, 0, "..."), (3, 0, 0, None)], "doc_id long, parent_index int, child_index int, text string")
    postings = knowledge_base._postings(chunks)
    assert sorted(map(tuple, postings.collect())) == [(1, 0, 0, "red", 2), (1, 0, 0, "sky", 1), (1, 0, 1, "sky", 1)]
    plan = postings._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    prepared = spark._jsparkSession.sessionState().executePlan(postings._jdf.queryExecution().analyzed(), postings._jdf.queryExecution().mode()).executedPlan().toString()
    assert prepared.count("Exchange ") == 1
    spark.createDataFrame([(1, "red sky", "s", "en"), (2, None, "s", "en")], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "docs"))
    tables = knowledge_base.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    found = knowledge_base.contents(tables)
    assert [(r.doc_id, r.lang, r.n_terms, r.norm) for r in found.collect()] == [(1, "en", 2, 1.0)]
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line)
    assert any("md5" in line and "vector" in line for line in lines[above + 1 :]) and not any("vector" in line for line in lines[: above + 1])
