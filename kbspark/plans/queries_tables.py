"""Queries over whole tables of operators on stored nodes, conversations, evidence and boxes: lookups, roots, listings, streaks, places and distances."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import agent, layout, search, store, tree
from kbspark.plans import queries_hierarchy as H
from kbspark.plans import queries_store
from kbspark.plans.book import Book

Q = Book()


# stored nodes: an order is a document, its lines are nodes


def _lines(t):
    """A node for each line number of an order: returned open lines are of type document, lines not returned have no parent."""
    kept = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("state"))
    kind = F.when((F.col("flag") == "R") & (F.col("state") == "O"), "document").when(F.col("l_linenumber") == 1, "section").otherwise("paragraph")
    return kept.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").cast("string").alias("node_id"), F.when(F.col("flag") != "N", "1").alias("parent_id"), kind.alias("type"))


_LINES = "SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_linenumber::VARCHAR AS node_id, CASE WHEN min(l_returnflag) <> 'N' THEN '1' END AS parent_id, CASE WHEN min(l_returnflag) = 'R' AND min(l_linestatus) = 'O' THEN 'document' WHEN l_linenumber = 1 THEN 'section' ELSE 'paragraph' END AS type FROM lineitem GROUP BY l_orderkey, l_linenumber"
Q.add("node_roots", lambda t: store.root_of(_lines(t)), f"SELECT doc_id, coalesce(arg_min(node_id, ord) FILTER (WHERE type = 'document'), arg_min(node_id, ord) FILTER (WHERE parent_id IS NULL)) AS root FROM ({_LINES}) GROUP BY doc_id")
Q.add("rebuild_flags", lambda t: tree.lacks_structure(_lines(t)), f"SELECT doc_id, count_if(type = 'section') = 0 OR 10 * count_if(type <> 'section' AND parent_id IS NULL) > 6 * count_if(type <> 'section') AS rebuild FROM ({_LINES}) GROUP BY doc_id")
Q.add("node_lookup", lambda t: store.lookup(store.lookup(_lines(t), "doc_id", 7), "node_id", "1").select("doc_id", "node_id", "type"), f"SELECT doc_id, node_id, type FROM ({_LINES}) WHERE doc_id = 7 AND node_id = '1'")
Q.add("document_nodes", lambda t: store.lookup(_lines(t), "doc_id", 7).select("node_id", "ord", "type"), f"SELECT node_id, ord, type FROM ({_LINES}) WHERE doc_id = 7")
Q.add("store_counts", lambda t: store.counts(t.orders, t.lineitem), "SELECT (SELECT count(*) FROM lineitem) AS count, (SELECT count(*) FROM orders) AS parent_count")


def _children(t):
    """Orders as chunks: the parent is the customer, the document the order's state."""
    return t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("parent_id"), F.col("o_orderstatus").alias("doc_id"), F.concat_ws(" ", "o_orderpriority", "o_orderdate").alias("text"))


Q.add("children_preview", lambda t: store.children_of(_children(t), "c11").select("id", "preview"), "SELECT o_orderkey AS id, substr(concat_ws(' ', o_orderpriority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')), 1, 100) AS preview FROM orders WHERE o_custkey = 11")
Q.add("document_preview", lambda t: store.children_of(_children(t), "tree:P").select("id", "preview"), "SELECT o_orderkey AS id, substr(concat_ws(' ', o_orderpriority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')), 1, 100) AS preview FROM orders WHERE o_orderstatus = 'P'")
Q.add("delete_customer", lambda t: store.delete_parent({"children": _children(t)}, "c11")["children"].select("id", "parent_id"), "SELECT o_orderkey AS id, 'c' || o_custkey AS parent_id FROM orders WHERE o_custkey <> 11")
Q.add("delete_tree_document", lambda t: store.delete_parent({"children": _children(t)}, "tree:P")["children"].select("id", "doc_id"), "SELECT o_orderkey AS id, o_orderstatus AS doc_id FROM orders WHERE o_orderstatus <> 'P'")

# paths in the tree of regions, nations and suppliers
_WANTED = ["s3", "s1", "n4", "n9", "s7", "r2"]
Q.add("distinct_paths", lambda t: store.distinct_titles(H._tree_docs(t), tree.closure(H.nodes(t)), _WANTED),
      f"{H.CLOSURE}, d AS ({H._DOCS}), f AS (SELECT doc_id, arg_min(node_id, list_position({_WANTED}, node_id)) AS node FROM d WHERE node_id IN ({str(_WANTED)[1:-1]}) GROUP BY doc_id) SELECT f.doc_id, string_agg(d.title, ' > ' ORDER BY dist DESC) AS titles FROM f JOIN c ON c.node = f.node JOIN d ON d.node_id = c.ancestor WHERE d.title <> '' GROUP BY f.doc_id")


def _evidence(t):
    """Each line as evidence: first lines name their supplier's node in the id, the others beside it."""
    s = F.concat(F.lit("s"), "l_suppkey")
    return t.lineitem.select(F.when(F.col("l_linenumber") == 1, F.concat(F.lit("tree:"), s)).otherwise(F.concat(F.lit("line"), "l_orderkey")).alias("id"), s.alias("node_id"))


Q.add("readable_sources", lambda t: store.readable_sources(_evidence(t), t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("doc_id"), F.col("r_name").alias("title")), H._tree_docs(t)),
      "SELECT CASE WHEN l_linenumber = 1 THEN 'tree:s' || l_suppkey ELSE 'line' || l_orderkey END AS id, concat_ws(' / ', r_name, s_name) AS source FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")


def _turns(t):
    """A chain for each conversation: every turn hangs below the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    name = F.concat_ws(":", "conv_id", "turn")
    return t.conversations.where("turn is not null").select("conv_id", "turn").distinct().select(name.alias("node_id"), F.lag(name).over(w).alias("parent_id"))


Q.add("turn_ancestors", lambda t: tree.closure(_turns(t)).select("node", "ancestor", F.col("dist").cast("long").alias("dist")),
      "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn IS NOT NULL)) SELECT a.conv_id || ':' || a.turn AS node, b.conv_id || ':' || b.turn AS ancestor, a.i - b.i AS dist FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.i <= a.i")

# conversations


def _titles(t):
    first = t.conversations.groupBy("conv_id").agg(F.min_by(F.coalesce("text", F.lit("")), "turn").alias("question"))
    return store.titled(first.withColumn("title", F.when(F.col("conv_id") % 2 == 0, store.DEFAULT_TITLE).otherwise(F.concat(F.lit("chat "), "conv_id"))), F.col("question"))


Q.add("conversation_titles", lambda t: store.title_of(_titles(t)), "SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN substr(trim(arg_min(coalesce(text, ''), turn)), 1, 20) ELSE 'chat ' || conv_id END AS title FROM conversations GROUP BY conv_id")
Q.add("conversation_exchange", lambda t: store.exchange(t.conversations, 5, "and then?", "that was all"),
      "SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT 5, (SELECT coalesce(max(turn) + 1, 0) FROM conversations WHERE conv_id = 5) + i, role, text FROM (VALUES (0, 'user', 'and then?'), (1, 'assistant', 'that was all')) x(i, role, text)")

# hits and evidence


def _hits(t):
    return t.documents.select(F.when(F.col("lang") == "en", F.col("doc_id").cast("string")).otherwise("").alias("id"), "text", (F.col("n_chars") / 8).alias("score"), F.nullif("source", F.lit("src0")).alias("source"))


Q.add("result_rows", lambda t: store.result_rows(_hits(t)), "SELECT CASE WHEN lang = 'en' THEN doc_id::VARCHAR ELSE '' END AS id, trim(text) AS text, round(n_chars / 8.0::DOUBLE, 4) AS score, coalesce(nullif(source, 'src0'), '') AS source FROM documents")
Q.add("evidence_rows", lambda t: store.evidence_rows(_hits(t), 2, "vector"), "SELECT doc_id::VARCHAR AS id, trim(text) AS text, n_chars / 8.0::DOUBLE AS score, 'vector' AS origin, 2::BIGINT AS round FROM documents WHERE lang = 'en'")


def _longest(t):
    hits = t.documents.select("doc_id", "text", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(5)
    return hits.select("text", (F.col("n_chars") / 3).alias("score"), F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))


Q.add("docs_brief", lambda t: store.docs_brief(_longest(t)),
      r"SELECT string_agg(printf('- [%.2f] ', n_chars / 3.0::DOUBLE) || substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 160), chr(10) ORDER BY n_chars DESC, doc_id) AS brief FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 3)")
Q.add("line_neighbours", lambda t: search.neighbours(t.lineitem.where("l_quantity >= 49"), t.lineitem, 2, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey"),
      "WITH h AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_quantity >= 49) SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM h WHERE k = l_orderkey AND abs(n - l_linenumber) <= 2) AND NOT EXISTS (SELECT 1 FROM h WHERE k = l_orderkey AND n = l_linenumber)")
Q.add("evidence_first", lambda t: agent.evidence_order(t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_discount").alias("score"), (F.col("l_linenumber") % 2 == 0).alias("is_neighbor"))).limit(50),
      "SELECT l_orderkey * 10 + l_linenumber AS id, l_discount AS score, l_linenumber % 2 = 0 AS is_neighbor FROM lineitem ORDER BY is_neighbor, score DESC, id LIMIT 50")
Q.add("progress_streaks", lambda t: agent.no_progress(queries_store._rounds(t)),
      f"WITH r AS ({queries_store._ROUNDS}), u AS ({queries_store.Q.sql['status_upgrade']}), n AS (SELECT round, row_number() OVER (ORDER BY round) AS n, round IN (SELECT round FROM u) AS up FROM (SELECT DISTINCT round FROM r)) SELECT round, n - coalesce(max(CASE WHEN up THEN n END) OVER (ORDER BY round), 0) AS streak FROM n")

# boxes: fifty parts are a document


def _boxes(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    return t.part.select(F.floor(k / 50).alias("doc_id"), k.alias("id"), (s % 3).alias("page"), (k % 2).alias("col_id"), (k % 100 * 10.0).alias("x0"), (k % 100 * 10.0 + s).alias("x1"), (s * 7.0).alias("top"), (s * 7.0 + 6 + k % 11).alias("bottom"))


_BOXES = "SELECT p_partkey // 50 AS doc_id, p_partkey AS id, p_size % 3 AS page, p_partkey % 2 AS col_id, p_partkey % 100 * 10.0::DOUBLE AS x0, p_partkey % 100 * 10.0::DOUBLE + p_size AS x1, p_size * 7.0::DOUBLE AS top, p_size * 7.0::DOUBLE + 6 + p_partkey % 11 AS bottom FROM part"
Q.add("box_reading", lambda t: layout.reading_order(_boxes(t)).select("id", F.col("reading").cast("long").alias("reading")), f"SELECT id, row_number() OVER (PARTITION BY doc_id ORDER BY page, col_id, top, x0, id) AS reading FROM ({_BOXES})")
Q.add("box_levels", lambda t: layout.level_by_height(_boxes(t)).select("id", F.col("level").cast("long").alias("level")), f"WITH b AS ({_BOXES}), m AS (SELECT doc_id, list_sort(list(bottom - top))[count(*) // 2 + 1] AS middle FROM b GROUP BY doc_id) SELECT id, CASE WHEN bottom - top >= 1.4::DOUBLE * middle THEN 0 ELSE 1 END::BIGINT AS level FROM b JOIN m ON b.doc_id = m.doc_id")


def _beside(t):
    """Each box with the one of the next number."""
    a, b = _boxes(t), _boxes(t)
    named = lambda x, p: x.select(*[F.col(c).alias(p + c) for c in ("id", "x0", "x1", "top", "bottom")])
    return named(a, "a_").join(named(b, "b_").withColumn("before", F.col("b_id") - 1), F.col("a_id") == F.col("before"))


Q.add("box_distances", lambda t: _beside(t).select("a_id", T.x_distance("a_", "b_").alias("dx"), T.y_distance("a_", "b_").alias("dy")),
      f"WITH b AS ({_BOXES}) SELECT a.id AS a_id, least(abs(a.x1 - b.x0), abs(a.x0 - b.x1), abs(a.x0 + a.x1 - b.x0 - b.x1) / 2) AS dx, (b.top + b.bottom - a.top - a.bottom) / 2 AS dy FROM b a JOIN b ON b.id = a.id + 1")
Q.add("turned_points", lambda t: _boxes(t).withColumn("p", T.rotated_point(F.col("x0"), F.col("top"), F.col("id") % 4 * 90, F.lit(1000.0), F.lit(400.0))).select("id", "p.x", "p.y"),
      f"SELECT id, CASE id % 4 WHEN 1 THEN top WHEN 2 THEN 1000 - x0 WHEN 3 THEN 1000 - top ELSE x0 END AS x, CASE id % 4 WHEN 1 THEN 400 - x0 WHEN 2 THEN 400 - top WHEN 3 THEN x0 ELSE top END AS y FROM ({_BOXES})")
