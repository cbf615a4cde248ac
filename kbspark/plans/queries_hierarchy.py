"""Queries of trees: regions, nations and suppliers are a tree of three levels below one root."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import tree as R
from kbspark.plans.book import Book
from kbspark.plans.queries_search import _STEM, _SYN

Q = Book()


def nodes(t):
    root = t.spark.range(1).select(F.lit("w").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("World").alias("title"), F.lit("section").alias("type"), F.lit("").alias("text"), F.lit(0).cast("long").alias("ord"))
    r = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit("w").alias("parent_id"), F.col("r_name").alias("title"), F.lit("section").alias("type"), F.lit("").alias("text"), F.col("r_regionkey").cast("long").alias("ord"))
    n = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("title"), F.lit("section").alias("type"), F.lit("").alias("text"), F.col("n_nationkey").cast("long").alias("ord"))
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"), F.col("s_name").alias("title"), F.lit("paragraph").alias("type"), F.concat(F.lit("text of "), "s_name").alias("text"), F.col("s_suppkey").alias("ord"))
    return root.unionByName(r).unionByName(n).unionByName(s)


NODES = "SELECT 'w' AS node_id, NULL AS parent_id, 'World' AS title, 'section' AS type, '' AS text, 0 AS ord UNION ALL SELECT 'r' || r_regionkey, 'w', r_name, 'section', '', r_regionkey FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 'section', '', n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, 'paragraph', 'text of ' || s_name, s_suppkey FROM supplier"
CLOSURE = f"WITH RECURSIVE nodes AS ({NODES}), c(node, ancestor, dist) AS (SELECT node_id, node_id, 0 FROM nodes UNION ALL SELECT c.node, n.parent_id, c.dist + 1 FROM c JOIN nodes n ON c.ancestor = n.node_id WHERE n.parent_id IS NOT NULL)"


def _with(f):
    return lambda t: (lambda n: f(n, R.closure(n)))(nodes(t))


Q.add("tree_closure", _with(lambda n, c: c.select("node", "ancestor", F.col("dist").cast("long").alias("dist"))), f"{CLOSURE} SELECT node, ancestor, CAST(dist AS BIGINT) AS dist FROM c")
Q.add("tree_paths", _with(lambda n, c: R.paths(n, c).withColumn("depth", F.col("depth").cast("long"))), f"{CLOSURE} SELECT node, string_agg(title, ' > ' ORDER BY dist DESC) AS path, CAST(max(dist) AS BIGINT) AS depth FROM c JOIN nodes ON ancestor = node_id GROUP BY node")
Q.add("top_ancestor", _with(lambda n, c: R.top_ancestor(c, n)), f"{CLOSURE} SELECT node, ancestor AS top FROM c JOIN nodes ON ancestor = node_id WHERE parent_id = 'w'")
Q.add("subtree_stats", _with(lambda n, c: R.subtree_stats(n, c)), f"{CLOSURE} SELECT ancestor, count_if(type = 'section') AS sections, count_if(type <> 'section') AS leaves, CAST(max(dist) AS BIGINT) AS depth FROM c JOIN nodes ON node = node_id WHERE dist > 0 GROUP BY ancestor")
Q.add("rep_text", _with(lambda n, c: R.representative_text(n, c)), f"{CLOSURE} SELECT ancestor, text FROM c JOIN nodes ON node = node_id WHERE dist > 0 AND type <> 'section' AND text <> '' QUALIFY row_number() OVER (PARTITION BY ancestor ORDER BY dist, ord, node) = 1")
Q.add("nearest_summary", _with(lambda n, c: R.nearest_summary(c, n.withColumn("summary", F.when(F.col("type") == "section", F.concat(F.lit("about "), "title")).otherwise("")))), f"{CLOSURE} SELECT node, 'about ' || title AS summary FROM c JOIN nodes ON ancestor = node_id WHERE type = 'section' QUALIFY row_number() OVER (PARTITION BY node ORDER BY dist) = 1")
Q.add("node_type_counts", lambda t: R.node_counts(nodes(t).withColumn("doc_id", F.lit("world"))), f"SELECT 'world' AS doc_id, count_if(type = 'section') AS section, count_if(type = 'paragraph') AS paragraph, count_if(type = 'table') AS \"table\", count_if(type = 'figure') AS figure FROM ({NODES})")
Q.add("lacks_structure", lambda t: R.lacks_structure(nodes(t).where("node_id <> 'w'").withColumn("parent_id", F.when(F.col("parent_id") != "w", F.col("parent_id"))).withColumn("doc_id", F.lit("world"))), "SELECT 'world' AS doc_id, false AS rebuild")
Q.add("children_order", lambda t: nodes(t).where("parent_id is not null").groupBy("parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id"))), lambda x: x["node_id"]), ",").alias("children")), f"SELECT parent_id, string_agg(node_id, ',' ORDER BY ord, node_id) AS children FROM ({NODES}) WHERE parent_id IS NOT NULL GROUP BY parent_id")


def _sections(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("world").alias("doc_id"), F.col("n_name").alias("title"), F.lit(1).alias("level"), F.array("n_regionkey", "n_nationkey").alias("section_path"))
    return n.unionByName(t.region.select(F.lit("world").alias("doc_id"), F.col("r_name").alias("title"), F.lit(0).alias("level"), F.array("r_regionkey").alias("section_path")))


Q.add("toc_text", lambda t: R.toc(_sections(t)), "SELECT 'world' AS doc_id, string_agg(repeat('#', level + 1) || ' ' || title, chr(10) ORDER BY a, b) AS toc FROM (SELECT r_name AS title, 0 AS level, r_regionkey AS a, -1 AS b FROM region UNION ALL SELECT n_name, 1, n_regionkey, n_nationkey FROM nation)")


def _events(t):
    e = t.events.select((F.col("user_id") % 50).alias("doc_id"), F.col("ts").alias("ord"), "event_id", "event_type")
    return e.where("event_type <> 'purchase'").withColumn("content_id", F.col("event_id")), e.where("event_type = 'purchase'").withColumn("heading_id", F.col("event_id"))


Q.add("asof_heading", lambda t: R.attach_to_headings(*_events(t)).select("doc_id", "content_id", "heading_id"),
      "WITH e AS (SELECT user_id % 50 AS doc_id, ts AS ord, event_id, event_type FROM events), h AS (SELECT doc_id, ord, max(event_id) AS event_id FROM e WHERE event_type = 'purchase' GROUP BY ALL) SELECT c.doc_id, c.event_id AS content_id, h.event_id AS heading_id FROM (SELECT * FROM e WHERE event_type <> 'purchase') c ASOF LEFT JOIN h ON c.doc_id = h.doc_id AND c.ord >= h.ord")
Q.add("heading_nesting", lambda t: R.nest(t.lineitem.groupBy((F.col("l_orderkey") % 200).alias("doc_id"), F.col("l_orderkey").alias("heading_id")).agg(F.min("l_linenumber").alias("level")).withColumn("ord", F.col("heading_id"))).select("heading_id", "parent"),
      "WITH h AS (SELECT l_orderkey % 200 AS doc_id, l_orderkey AS id, min(l_linenumber) AS level FROM lineitem GROUP BY ALL) SELECT a.id AS heading_id, (SELECT max(b.id) FROM h b WHERE b.doc_id = a.doc_id AND b.id < a.id AND b.level < a.level) AS parent FROM h a")
Q.add("unique_node_ids", lambda t: R.with_unique_ids(t.customer.select(F.col("c_mktsegment").alias("node_id"), F.col("c_custkey").alias("ord"))), "SELECT CASE WHEN n > 0 THEN c_mktsegment || '#' || n ELSE c_mktsegment END AS node_id, c_custkey AS ord FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS n FROM customer)")


def _tree_docs(t):
    """A tree for each region, of nations as sections and suppliers as leaves."""
    n = nodes(t).where("node_id <> 'w'").withColumn("summary", F.lit(""))
    r = t.region.select(F.col("r_regionkey").alias("k"))
    of = n.alias("n").join(R.top_ancestor(R.closure(nodes(t)), nodes(t)), F.col("n.node_id") == F.col("node")).select("n.*", F.col("top").alias("doc_id"))
    return of.join(r, F.concat(F.lit("r"), "k") == F.col("doc_id")).drop("k").withColumn("parent_id", F.when(F.col("node_id") != F.col("doc_id"), F.col("parent_id")))


def _nav(t):
    from kbspark.operators.navigate import navigate

    return navigate(_tree_docs(t), "text of Supplier")


def _routing(t):
    from kbspark.operators.navigate import route

    return route(t.benchmark.select(F.col("item_id").cast("string").alias("doc_id"), F.col("text").alias("card")), "the of and", 5).select("doc_id", "score")


_DOCS = f"SELECT CASE WHEN node_id LIKE 'r%' THEN node_id WHEN node_id LIKE 'n%' THEN parent_id ELSE (SELECT 'r' || n_regionkey FROM nation WHERE 'n' || n_nationkey = x.parent_id) END AS doc_id, node_id, CASE WHEN node_id NOT LIKE 'r%' THEN parent_id END AS parent_id, type, title, text, ord FROM ({NODES}) x WHERE node_id <> 'w'"
_WORDS = r"list_distinct(list_filter(string_split_regex(lower({}), '\s+'), lambda w: w <> ''))"
_SHARE = "len(list_intersect({q}, {t})) / len({q})::DOUBLE".format(q=_WORDS.format("query"), t=_WORDS.format("{t}"))


def walked(docs: str, questions: str) -> str:
    """Evidence for ``questions`` (query_id, query), each asked of every tree of ``docs``, with the default limits: a frontier of sections by levels, running sums in order of places."""
    step = "[CASE WHEN type IN ('section', 'document') THEN '1' ELSE '0' END || lpad(n.ord::VARCHAR, 12, '0') || n.node_id]"
    about = _SHARE.format(t="concat_ws(' ', title, sample)")
    return f"""WITH RECURSIVE n AS ({docs}), q AS ({questions}), p(doc_id, node_id, place) AS (SELECT doc_id, node_id, {step} FROM n WHERE parent_id IS NULL UNION ALL SELECT n.doc_id, n.node_id, p.place || {step} FROM n JOIN p ON n.doc_id = p.doc_id AND n.parent_id = p.node_id),
t AS (SELECT n.*, place, type IN ('section', 'document') AS holds, row_number() OVER (PARTITION BY n.doc_id, parent_id, type IN ('section', 'document') ORDER BY ord, n.node_id) AS i FROM n JOIN p ON n.doc_id = p.doc_id AND n.node_id = p.node_id),
x AS (SELECT s.doc_id, s.node_id, arg_min(substr(l.text, 1, 200), l.place) AS sample FROM t s JOIN t l ON s.doc_id = l.doc_id AND s.holds AND NOT l.holds AND trim(l.text) <> '' AND l.place[1:len(s.place)] = s.place GROUP BY ALL),
s AS (SELECT t.*, sample FROM t LEFT JOIN x ON t.doc_id = x.doc_id AND t.node_id = x.node_id WHERE holds),
f(query_id, query, doc_id, node_id, place, depth) AS (SELECT query_id, query, doc_id, node_id, place, 0 FROM q, s WHERE parent_id IS NULL UNION ALL SELECT query_id, query, s.doc_id, s.node_id, s.place, depth + 1 FROM f JOIN s ON f.doc_id = s.doc_id AND s.parent_id = f.node_id WHERE depth < 4 AND {about} >= 0.2),
r AS (SELECT query_id, f.doc_id, f.node_id, t.node_id AS leaf, i, text, {_SHARE.format(t='text')} AS score FROM f JOIN t ON f.doc_id = t.doc_id AND t.parent_id = f.node_id AND NOT holds WHERE depth < 4),
c AS (SELECT query_id, doc_id, node_id, count_if(score >= 0.2) AS reads, count_if(score >= 0.5) AS sure FROM r GROUP BY ALL), o AS (SELECT a.query_id, a.doc_id, a.node_id, count(*) AS n_open FROM f a JOIN s ON a.doc_id = s.doc_id AND s.parent_id = a.node_id JOIN f b ON b.query_id = a.query_id AND b.doc_id = s.doc_id AND b.node_id = s.node_id GROUP BY ALL),
w AS (SELECT f.query_id, f.doc_id, f.node_id, f.place, depth, (sum(coalesce(sure, 0)) OVER v >= 2 OR row_number() OVER v >= 8 OR sum(coalesce(reads, 0)) OVER v >= 20) AND (coalesce(lead(depth) OVER v > 0, false) OR depth >= 3 AND n_open > 0) AS ends FROM f LEFT JOIN c USING (query_id, doc_id, node_id) LEFT JOIN o USING (query_id, doc_id, node_id) WHERE depth < 4 WINDOW v AS (PARTITION BY f.query_id, f.doc_id ORDER BY f.place)),
y AS (SELECT r.* FROM r JOIN (SELECT *, coalesce(bool_or(ends) OVER (PARTITION BY query_id, doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM w) USING (query_id, doc_id, node_id) WHERE NOT over)
SELECT query_id, doc_id, leaf AS node_id, text, score, score < 0.5 AS ambiguous, false AS is_neighbor FROM y WHERE score >= 0.2
UNION ALL SELECT query_id, doc_id, leaf, text, 0.0::DOUBLE, false, true FROM y WHERE score < 0.2 AND EXISTS (SELECT 1 FROM y z WHERE z.query_id = y.query_id AND z.doc_id = y.doc_id AND z.node_id = y.node_id AND z.score >= 0.2 AND abs(z.i - y.i) = 1)
UNION ALL SELECT query_id, doc_id, leaf, text, score, true, false FROM (SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM y z WHERE z.query_id = y.query_id AND z.doc_id = y.doc_id AND z.score >= 0.2) QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, leaf) <= 3)"""


def _levels(t):
    """The nations' and the suppliers' names as questions to every region's tree."""
    from kbspark.operators.levels import search

    q = t.nation.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("text of "), "n_name").alias("query")).union(t.supplier.select((F.col("s_suppkey") + 1000).cast("long"), F.col("s_name")))
    docs = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("doc_id"))
    return search(_tree_docs(t), q.join(F.broadcast(docs)).select("query_id", "doc_id", "query"))[0]


_ONE = "SELECT 0 AS query_id, 'text of Supplier' AS query"
Q.add("tree_nav", _nav, f"SELECT doc_id, node_id, text, score, ambiguous, is_neighbor FROM ({walked(_DOCS, _ONE)})")
Q.add("tree_levels", _levels, walked(_DOCS, "SELECT n_nationkey::BIGINT AS query_id, 'text of ' || n_name AS query FROM nation UNION ALL SELECT s_suppkey::BIGINT + 1000, s_name FROM supplier"))
_CARD = f"len(list_intersect(list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda v: list_transform([lower(v)], lambda w: coalesce({_SYN}[w], {_STEM}))[1])), ['the', 'of', 'and'])) / 3.0::DOUBLE"
Q.add("doc_routing", _routing, f"SELECT item_id::VARCHAR AS doc_id, round({_CARD}, 6) AS score FROM benchmark ORDER BY score DESC, doc_id LIMIT 5")
