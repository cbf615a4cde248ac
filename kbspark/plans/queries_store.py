"""Queries of stored tables, conversations, tasks and the evidence loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import agent as A
from kbspark.operators import store as S
from kbspark.plans.book import Book

Q = Book()


def _docs(t):
    return t.documents.select("doc_id", "source", "lang")


def _children(t):
    return t.lineitem.select(F.col("l_orderkey").alias("parent_id"), "l_linenumber")


Q.add("doc_node_counts", lambda t: S.documents_with_counts(t.region.select(F.col("r_regionkey").alias("doc_id"), "r_name"), t.nation.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("node_id"))), "SELECT r_regionkey AS doc_id, r_name, count(n_nationkey) AS node_count FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL")
Q.add("chunks_per_doc", lambda t: S.count_by(t.lineitem, "l_orderkey"), "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")
Q.add("parents_listing", lambda t: S.parents_listing(t.orders.select(F.col("o_orderkey").alias("parent_id"), F.col("o_orderpriority").alias("text")), _children(t)), "SELECT o_orderkey AS parent_id, substr(o_orderpriority, 1, 100) AS preview, count(l_orderkey) AS children FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
Q.add("parents_page", lambda t: S.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 20, 40), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
Q.add("delete_source", lambda t: S.delete_by(_docs(t), t.spark.createDataFrame([("src0",), ("src1",)], "source string"), "source"), "SELECT source, doc_id, lang FROM documents WHERE source NOT IN ('src0', 'src1')")
Q.add("rename_source", lambda t: S.rename_source(_docs(t), "src0", "renamed"), "SELECT doc_id, CASE WHEN source = 'src0' THEN 'renamed' ELSE source END AS source, lang FROM documents")
Q.add("overwrite_docs", lambda t: S.overwrite_partition(_docs(t), _docs(t).where("doc_id % 7 = 0").withColumn("lang", F.lit("xx"))), "SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang FROM documents")
Q.add("schema_migration", lambda t: S.migrate(_docs(t), {"summary": "string", "lang": "string"}), "SELECT doc_id, source, lang, NULL::VARCHAR AS summary FROM documents")
Q.add("insert_parents", lambda t: S.insert_parents(t.orders.select(F.col("o_orderkey").alias("parent_id")), _children(t)), "SELECT o_orderkey AS parent_id, count(l_orderkey) AS child_count FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
Q.add("stored_vectors", lambda t: S.insert_children(t.embeddings, "embedding").select("vec_id", "label"), "SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0")
Q.add("conv_list", lambda t: S.conversations_listing(t.conversations), "SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
Q.add("conv_brief", lambda t: S.history(t.conversations), "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || CASE WHEN length(trim(text)) > 200 THEN substr(trim(text), 1, 200) || '...' ELSE trim(text) END, chr(10) ORDER BY turn) AS brief FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) WHERE trim(text) <> '' GROUP BY conv_id")
Q.add("conv_history", lambda t: t.conversations.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n")), "SELECT conv_id, turn, role, length(text) AS n FROM conversations")
Q.add("task_latest", lambda t: S.latest(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", ["event_id", "event_type"]).select("user_id", "event_id", "event_type"), "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")


def _tasks(t):
    return S.latest(t.events.select("user_id", "ts", "event_id", F.when(F.col("event_id") % 3 == 0, "DONE").when(F.col("event_id") % 3 == 1, "PARSING").otherwise("FAILED").alias("status")), "user_id", "ts", ["event_id", "status"]).withColumn("error", F.lit(None).cast("string"))


_TASKS = "SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN 'DONE' WHEN 1 THEN 'PARSING' ELSE 'FAILED' END AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
Q.add("task_running", lambda t: _tasks(t).where(F.col("status").isin(*S.RUNNING)).select("user_id", "status"), f"SELECT user_id, status FROM ({_TASKS}) WHERE status = 'PARSING'")
Q.add("task_interrupt", lambda t: S.interrupt(_tasks(t), "stopped").select("user_id", "status", "error"), f"SELECT user_id, CASE WHEN status = 'PARSING' THEN 'FAILED' ELSE status END AS status, CASE WHEN status = 'PARSING' THEN 'stopped' END AS error FROM ({_TASKS})")
Q.add("backoff", lambda t: t.nation.select("n_nationkey", S.backoff(F.col("n_nationkey") % 5).alias("seconds")), "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 20 END::BIGINT AS seconds FROM nation")
Q.add("lru32", lambda t: S.newest(t.conversations.select(F.lower("text").alias("q"), (F.col("conv_id") * 100 + F.col("turn")).alias("seen")), "q", "seen"), "SELECT lower(text) AS q, max(conv_id * 100 + turn) AS seen FROM conversations GROUP BY 1 ORDER BY seen DESC, q LIMIT 32")


def _status(t):
    return t.labels.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") + F.col("toxic") == 2, "PARTIAL").when(F.col("quality") == 1, "SUPPORTED").otherwise("MISSING").alias("status"))


_STATUS = "SELECT doc_id::VARCHAR AS id, CASE WHEN quality + toxic = 2 THEN 'PARTIAL' WHEN quality = 1 THEN 'SUPPORTED' ELSE 'MISSING' END AS status FROM labels"
Q.add("coverage", lambda t: A.coverage(_status(t)), f"SELECT count(*) AS total, round(avg(CASE WHEN status = 'SUPPORTED' THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage FROM ({_STATUS})")
Q.add("status_merge", lambda t: A.merge_status(_status(t), _status(t).where("cast(id as long) % 2 = 0").withColumn("status", F.lit("PARTIAL"))), f"SELECT id, CASE WHEN id::BIGINT % 2 = 0 AND status = 'MISSING' THEN 'PARTIAL' ELSE status END AS status FROM ({_STATUS})")
Q.add("gap_order", lambda t: A.gaps(_status(t).select("id", (F.length("id") / 10).alias("importance"), F.lit(False).alias("synthetic")), _status(t)).select("id", "importance"), f"SELECT id, length(id) / 10.0::DOUBLE AS importance FROM ({_STATUS}) WHERE status <> 'SUPPORTED'")


def _rounds(t):
    s = F.array(F.lit("MISSING"), F.lit("PARTIAL"), F.lit("SUPPORTED"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("round")).agg(F.get(s, F.floor(F.max("l_quantity") / 17).cast("int")).alias("status"))


_ROUNDS = "SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS round, least(floor(max(l_quantity) / 17), 2) AS r FROM lineitem GROUP BY ALL"
Q.add("status_upgrade", lambda t: A.upgraded(_rounds(t)), f"SELECT round, id FROM (SELECT *, coalesce(lag(r) OVER (PARTITION BY id ORDER BY round), 0) AS p FROM ({_ROUNDS})) WHERE r > p")


def _evidence(t, base=0):
    return t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), (F.col("doc_id") % 101).cast("double").alias("score"), (F.col("doc_id") % 4).alias("round"), (F.col("doc_id") % 5 == 0).alias("is_neighbor"), F.col("text").alias("text"))


_EV = "SELECT 'd' || doc_id AS id, CAST(doc_id % 101 AS DOUBLE) AS score, doc_id % 4 AS round, doc_id % 5 = 0 AS is_neighbor, text FROM documents"
Q.add("evidence_merge", lambda t: A.add_evidence(_evidence(t).where("round < 3"), _evidence(t).where("round > 1")).select("id", "round"), f"SELECT id, round FROM ({_EV})")
Q.add("evidence_prune", lambda t: A.prune_new(_evidence(t)).select("id", "round", "score"), f"SELECT id, round, score FROM ({_EV}) QUALIFY row_number() OVER (PARTITION BY round ORDER BY score DESC, id) <= 8")
Q.add("coverage_evidence", lambda t: A.coverage_evidence(_evidence(t)).select("id", "text"), f"SELECT id, trim(substr(text, 1, 150)) AS text FROM ({_EV}) WHERE NOT is_neighbor ORDER BY score DESC, id LIMIT 5")
Q.add("citations", lambda t: A.citations(_evidence(t).withColumnRenamed("id", "evidence_id"), _status(t).withColumn("evidence_ids", F.array(F.concat(F.lit("d"), "id")))).select("num", "evidence_id"), f"SELECT row_number() OVER (ORDER BY score DESC, e.id) AS num, e.id AS evidence_id FROM ({_EV}) e JOIN (SELECT DISTINCT 'd' || id AS id FROM ({_STATUS}) WHERE status <> 'MISSING') USING (id)")
Q.add("default_answer", lambda t: A.default_answer(A.citations(_evidence(t).where("score > 99").withColumnRenamed("id", "evidence_id"), _status(t).withColumn("evidence_ids", F.array(F.concat(F.lit("d"), "id"))))), f"SELECT coalesce(string_agg('[' || num || '] ' || substr(text, 1, 1500), chr(10) || chr(10) ORDER BY num), '') AS answer FROM (SELECT row_number() OVER (ORDER BY score DESC, e.id) AS num, e.text FROM ({_EV}) e JOIN (SELECT DISTINCT 'd' || id AS id FROM ({_STATUS}) WHERE status <> 'MISSING') USING (id) WHERE score > 99)")
Q.add("resolve_synthetic", lambda t: A.resolved_synthetic(_status(t).groupBy(F.length("id").cast("string").alias("k")).agg(F.collect_list("id").alias("deps")).select(F.col("k").alias("id"), F.lit(True).alias("synthetic"), "deps"), _status(t)), f"SELECT length(id)::VARCHAR AS id FROM ({_STATUS}) GROUP BY 1 HAVING bool_and(status = 'SUPPORTED')")
Q.add("stop_rules", lambda t: t.nation.select("n_nationkey", A.should_stop(F.col("n_nationkey"), 20, F.col("n_nationkey") * 2, 30, F.col("n_nationkey") % 6, F.col("n_nationkey") % 3, F.col("n_nationkey") % 4).alias("reason")), "SELECT n_nationkey, CASE WHEN n_nationkey >= 20 THEN 'hard: iterations' WHEN n_nationkey * 2 >= 30 THEN 'hard: tool calls' WHEN n_nationkey % 6 = 0 THEN NULL WHEN n_nationkey % 3 = 0 THEN 'sufficiency' WHEN n_nationkey % 4 >= 3 THEN 'no_progress' END AS reason FROM nation")
Q.add("actions", lambda t: t.nation.select("n_nationkey", A.choose_action(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") > 20, F.col("n_nationkey") % 3, F.lit(None).cast("string")).alias("action"), A.novelty(F.col("n_nationkey") / 25).alias("novelty")), "SELECT n_nationkey, CASE WHEN n_nationkey % 2 <> 0 OR n_nationkey > 20 THEN 'ANSWER' ELSE 'SEARCH' END AS action, CASE WHEN n_nationkey / 25.0::DOUBLE >= 0.55 THEN 'covered' ELSE 'uncovered' END AS novelty FROM nation")
Q.add("event_windows", lambda t: t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total"), "SELECT time_bucket(INTERVAL 1 hour, ts) AS \"start\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
Q.add("event_sessions", lambda t: t.events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n"), "WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 hours THEN 0 ELSE 1 END AS k FROM events), i AS (SELECT *, sum(k) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(ts) AS \"start\", count(*) AS n FROM i GROUP BY user_id, g")
