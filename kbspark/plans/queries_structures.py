"""Queries of nested exports, dependencies, questions asked before, and chunks by tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import chunking, export, requirements
from kbspark.plans import queries_text
from kbspark.plans.book import Book
from kbspark.plans.queries_hierarchy import nodes
from kbspark.sources import html

Q = Book()
_OBJECT = "'{{\"node_id\":\"' || {id} || '\",\"title\":' || to_json({title}) || ',\"children\":[' || {children} || ']}}'"
_LEAF, _NATION, _REGION, _WORLD = (
    _OBJECT.format(id=i, title=t, children=c)
    for i, t, c in (
        ("'s' || s_suppkey", "s_name", "''"), ("'n' || n_nationkey", "n_name", "coalesce((SELECT string_agg(j, ',' ORDER BY s_suppkey, k) FROM s WHERE s_nationkey = n_nationkey), '')"),
        ("'r' || r_regionkey", "r_name", "coalesce((SELECT string_agg(j, ',' ORDER BY n_nationkey, k) FROM n WHERE n_regionkey = r_regionkey), '')"), ("'w'", "'World'", "string_agg(j, ',' ORDER BY r_regionkey, k)"),
    )
)
Q.add("nested_tree", lambda t: export.nested_json(nodes(t).withColumn("doc_id", F.lit("world")), ["node_id", "title"]),
      f"WITH s AS (SELECT s_suppkey, s_nationkey, 's' || s_suppkey AS k, {_LEAF} AS j FROM supplier), n AS (SELECT n_nationkey, n_regionkey, 'n' || n_nationkey AS k, {_NATION} AS j FROM nation), r AS (SELECT r_regionkey, 'r' || r_regionkey AS k, {_REGION} AS j FROM region) SELECT 'world' AS doc_id, '[' || {_WORLD} || ']' AS json FROM r")


def _requirements(t):
    """Every third order is synthetic and follows from the orders that its parts' numbers name, smaller ones; the others are supported unless they're open and urgent."""
    named = t.lineitem.where("l_orderkey % 3 = 0 and l_orderkey > 0").selectExpr("l_orderkey as id", "try_mod(l_partkey, l_orderkey) as dep")
    parts = named.join(t.orders.select(F.col("o_orderkey").alias("dep")), "dep", "left_semi").groupBy("id").agg(F.collect_set("dep").alias("deps"))
    synthetic = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id")).join(parts, "id", "left").select("id", F.lit(True).alias("synthetic"), "deps")
    status = t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"), "PARTIAL").otherwise("SUPPORTED").alias("status"))
    return requirements.resolve(synthetic, status)


Q.add("requirements_fixpoint", _requirements, """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS id, l_partkey % l_orderkey AS dep FROM lineitem WHERE l_orderkey % 3 = 0 AND l_orderkey > 0 AND l_partkey % l_orderkey IN (SELECT o_orderkey FROM orders)),
bad(id) AS (SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ELSE o_orderkey NOT IN (SELECT id FROM e) END UNION SELECT e.id FROM e JOIN bad ON e.dep = bad.id)
SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT id FROM bad) THEN 'waiting' ELSE 'supported' END AS state FROM orders WHERE o_orderkey % 3 = 0""")
#: These conversations repeat little, so the query asks for less than the default likeness.
Q.add("asked_before", lambda t: requirements.asked_before(t.conversations.where("role = 'user'"), 0.1),
      r"""WITH q AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM conversations WHERE role = 'user'),
s AS (SELECT a.conv_id, a.turn, b.turn AS before, b.n, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE AS score FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 32 AND a.n - 1 AND len(a.t) > 0 AND len(b.t) > 0)
SELECT conv_id, turn, before, round(score, 6) AS score FROM s WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, n DESC) = 1""")
_TOKEN = r"'\s*(?:[一-鿿぀-ヿ가-힯]|[^\s一-鿿぀-ヿ가-힯]+)(?:\s+$)?'"
Q.add("token_chunks", lambda t: t.pages.select("page_id", F.posexplode(chunking.token_chunks(html.body_text(F.col("html")), 64)).alias("seq", "chunk")).select("page_id", F.col("seq").cast("long").alias("seq"), F.md5("chunk").alias("digest")),
      rf"""WITH RECURSIVE b AS ({queries_text.Q.sql['html_bodies']}), x AS (SELECT page_id, generate_subscripts(l, 1) AS a, unnest(l) AS piece FROM (SELECT page_id, regexp_extract_all(body, '[^。！？!?；;\n]*[。！？!?；;\n]+|[^。！？!?；;\n]+') AS l FROM b)),
y AS (SELECT page_id, a, piece, regexp_extract_all(piece, {_TOKEN}) AS t FROM x), z AS (SELECT page_id, a, unnest(CASE WHEN len(t) > 64 THEN list_transform(range(0, (len(t) + 63) // 64), lambda k: struct_pack(c := k, s := array_to_string(t[k * 64 + 1:k * 64 + 64], ''), n := least(64, len(t) - k * 64))) ELSE [struct_pack(c := 0::BIGINT, s := piece, n := len(t))] END) AS u FROM y),
p AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY a, u.c) AS i, u.s AS s, u.n AS n FROM z), w(page_id, i, s, chunk, used) AS (SELECT page_id, i, s, 0::BIGINT, n FROM p WHERE i = 1 UNION ALL SELECT p.page_id, p.i, p.s, CASE WHEN used + n <= 64 THEN chunk ELSE chunk + 1 END, CASE WHEN used + n <= 64 THEN used + n ELSE n END FROM w JOIN p ON w.page_id = p.page_id AND p.i = w.i + 1)
SELECT page_id, chunk AS seq, md5(string_agg(s, '' ORDER BY i)) AS digest FROM w GROUP BY ALL""")
