"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import ingest
from kbspark.operators import search as S
from kbspark.plans.book import Book

Q = Book()
QUERY = "the of token license"
TERMS = ["the", "of", "token", "license"]
COS = "round(list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE)), 6)"
DENSE = f"SELECT e.vec_id, {COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q"
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
BM25 = f"""WITH t AS (SELECT doc_id, {_TOK} AS t FROM documents), n AS (SELECT doc_id, len(t) AS n, {', '.join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))} FROM t), a AS (SELECT count(*) AS docs, avg(n) AS mean, {', '.join(f'count_if(tf{i} > 0) AS df{i}' for i in range(len(TERMS)))} FROM n) SELECT doc_id, round({' + '.join(f'ln(1 + (docs - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))' for i in range(len(TERMS)))}, 6) AS score FROM n, a WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(TERMS)))}"""


def _vector(t) -> list[float]:
    row = t.embeddings.orderBy("vec_id").select("embedding").first()
    return [float(x) for x in row["embedding"]] if row else []


Q.add("dense_rank_all", lambda t: S.dense_scores(t.embeddings, _vector(t)).select("vec_id", "score"), DENSE)
Q.add("dense_topk", lambda t: S.dense_topk(t.embeddings, _vector(t), 10).select("vec_id", "score"), DENSE + " ORDER BY score DESC, vec_id LIMIT 10")
Q.add("df_table", lambda t: S.document_frequencies(S.postings(t.documents)), f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY term")
Q.add("postings", lambda t: S.postings(t.documents), f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL")
Q.add("doclen", lambda t: S.document_lengths(t.documents), f"SELECT doc_id, CAST(len({_TOK}) AS BIGINT) AS doc_length FROM documents")
Q.add("bm25_all", lambda t: S.bm25_scores(t.documents, QUERY), BM25)
Q.add("bm25_topk", lambda t: S.bm25_topk(t.documents, QUERY, 10), f"SELECT * FROM ({BM25}) ORDER BY score DESC, doc_id LIMIT 10")
_LISTS = f"d AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({DENSE}) ORDER BY rank LIMIT 20), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({BM25}) ORDER BY rank LIMIT 20)"
Q.add("hybrid_rrf", lambda t: S.hybrid(t.documents, t.embeddings.withColumnRenamed("vec_id", "doc_id"), QUERY, _vector(t), 10), f"WITH {_LISTS} SELECT id, round(sum(1.0::DOUBLE / (60 + rank)) * 30, 6) AS score FROM (SELECT * FROM d UNION ALL SELECT * FROM b) GROUP BY id ORDER BY score DESC, id LIMIT 10")
Q.add("tier_union", lambda t: S.ordered_union([S.dense_topk(t.embeddings, _vector(t), 8).select(F.col("vec_id").alias("id"), "score"), S.bm25_topk(t.documents, QUERY, 8).select(F.col("doc_id").alias("id"), "score")], "id", 12).select("id", F.col("tier").cast("long").alias("tier"), "score"),
      f"WITH u AS (SELECT vec_id AS id, 0 AS tier, score FROM (SELECT * FROM ({DENSE}) ORDER BY score DESC, vec_id LIMIT 8) UNION ALL SELECT doc_id, 1, score FROM (SELECT * FROM ({BM25}) ORDER BY score DESC, doc_id LIMIT 8)) SELECT id, CAST(tier AS BIGINT) AS tier, score FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, score DESC) = 1) ORDER BY tier, score DESC, id LIMIT 12")
_SYN = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.SYNONYMS.items()) + "}"
_STEM = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN substr(w, 1, length(w) - 3) || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END"
PART_QUERY = "small steel part"
_QT = "[" + ", ".join(f"'{w}'" for w in PART_QUERY.split()) + "]"
Q.add("section_match", lambda t: S.section_match(t.part.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("title"), F.col("p_size").alias("level")), PART_QUERY, 20).select("node_id", "title", F.col("level").cast("long").alias("level"), "score"),
      f"SELECT node_id, title, level, score FROM (SELECT p_partkey AS node_id, p_name AS title, CAST(p_size AS BIGINT) AS level, CAST(2 * len(list_intersect(list_distinct(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: coalesce({_SYN}[w], {_STEM}))), {_QT})) AS BIGINT) AS score FROM part) WHERE score > 0 ORDER BY score DESC, level, node_id LIMIT 20")
Q.add("section_prefix", lambda t: t.lineitem.select("l_orderkey", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path")).where(S.in_section(F.col("path"), "1")).groupBy("path").agg(F.count("*").alias("n")),
      "SELECT path, count(*) AS n FROM (SELECT l_orderkey || '/' || l_linenumber AS path FROM lineitem) WHERE path = '1' OR path LIKE '1/%' GROUP BY path")
_HIT = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
Q.add("parent_fetch_dedup", lambda t: S.with_parents(S.dedup_by_parent(t.lineitem.select(F.col("l_orderkey").alias("parent_id"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("score")), parent="parent_id", order=("score", "l_linenumber", "l_partkey"), tie="l_suppkey"), t.orders.select(F.col("o_orderkey").alias("parent_id"), "o_orderstatus", "o_orderpriority")).withColumn("l_linenumber", F.col("l_linenumber").cast("long")),
      "SELECT l.l_orderkey AS parent_id, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_extendedprice AS score, o_orderstatus, o_orderpriority FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber DESC, l_partkey DESC, l_suppkey) = 1) l LEFT JOIN orders ON l_orderkey = o_orderkey")


def _chat(t):
    return t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_seq"), "role", "text")


Q.add("neighbour_expand", lambda t: S.neighbours(_chat(t).where("role = 'user'"), _chat(t), 1).select("doc_id", "chunk_seq", F.md5("text").alias("digest")),
      "SELECT DISTINCT b.conv_id AS doc_id, b.turn AS chunk_seq, md5(b.text) AS digest FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.role = 'user' AND b.role IS DISTINCT FROM 'user'")


def _budget(t):
    hits = _chat(t).withColumn("score", F.length("text").cast("double")).withColumn("place", F.struct("doc_id", "chunk_seq"))
    top = S.ranked(hits.orderBy(F.desc("score"), "place").limit(10), "place")
    near = S.neighbours(top, _chat(t), 2)
    return S.within_budget(top, near, 40000, window=2).select("doc_id", "chunk_seq", F.col("n").cast("long").alias("n"))


Q.add("neighbour_budget", _budget,
      "WITH RECURSIVE h AS (SELECT *, row_number() OVER (ORDER BY length(text) DESC, conv_id, turn) AS rank FROM conversations ORDER BY rank LIMIT 10), c AS (SELECT conv_id, turn, n, row_number() OVER (ORDER BY rank, turn, conv_id) AS i FROM (SELECT b.conv_id, b.turn, length(b.text) AS n, min(rank) AS rank FROM h JOIN conversations b ON h.conv_id = b.conv_id AND b.turn BETWEEN h.turn - 2 AND h.turn + 2 WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.conv_id = b.conv_id AND x.turn = b.turn) GROUP BY ALL)), w(i, room, took) AS (SELECT 0, 40000 - coalesce((SELECT sum(length(text)) FROM h), 0), false UNION ALL SELECT c.i, CASE WHEN n <= room THEN room - n ELSE room END, n <= room FROM w JOIN c ON c.i = w.i + 1) SELECT conv_id AS doc_id, turn AS chunk_seq, CAST(n AS BIGINT) AS n FROM w JOIN c USING (i) WHERE took")
_QTOK = ["aaa", "the", "of"]
Q.add("rerank_all", lambda t: S.rerank(t.benchmark.select(F.col("item_id").alias("id"), "text"), " ".join(_QTOK)).select("id", "rerank_score"),
      f"SELECT item_id AS id, round(len(list_intersect(list_distinct(list_transform(list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: lower(x)), lambda w: coalesce({_SYN}[w], {_STEM}))), ['aaa', 'the', 'of'])) / 3.0::DOUBLE, 6) AS rerank_score FROM benchmark")
Q.add("score_bands", lambda t: S.dense_scores(t.embeddings, _vector(t)).select("vec_id", S.banded(F.col("score"), 0.2, 0.5).alias("band")), f"SELECT vec_id, CASE WHEN score >= 0.5 THEN 'keep' WHEN score >= 0.2 THEN 'ambiguous' ELSE 'prune' END AS band FROM ({DENSE})")
Q.add("grade", lambda t: S.grade(S.dense_topk(t.embeddings, _vector(t), 5)), f"SELECT count(*) AS hits, CASE WHEN count(*) = 0 THEN 'empty' WHEN max(score) >= 0.25 THEN 'sufficient' ELSE 'weak' END AS grade FROM (SELECT * FROM ({DENSE}) ORDER BY score DESC, vec_id LIMIT 5)")
Q.add("bm25_indexed", lambda t: (lambda d: ingest.bm25_indexed(ingest.postings(d, "doc_id"), ingest.totals(d), QUERY, 10, "doc_id"))(t.documents), f"SELECT * FROM ({BM25}) ORDER BY score DESC, doc_id LIMIT 10")
