"""Document trees as adjacency tables: as-of placement of content under headings, ancestor closure, paths, subtree counts and tables of contents."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_to_headings(content: DataFrame, headings: DataFrame, order: str = "ord", group: str = "doc_id") -> DataFrame:
    """Content with the last heading at or before it (null: the root). One sort of the union in place of an as-of join."""
    rows = headings.select(group, order, F.col("heading_id").alias("heading_id"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("content_id"))
    rows = rows.unionByName(content.select(group, order, F.lit(None).cast("long").alias("heading_id"), F.lit(1).alias("kind"), F.col("content_id").cast("long")))
    w = Window.partitionBy(group).orderBy(order, "kind", "heading_id", "content_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("parent", F.last("heading_id", ignorenulls=True).over(w)).where("kind = 1").select(group, order, "content_id", F.col("parent").alias("heading_id"))


def nest(headings: DataFrame, group: str = "doc_id", order: str = "ord", key: str = "heading_id", level: str = "level", levels: int | None = None) -> DataFrame:
    """Each heading's parent: the last earlier heading of a lower level (null: the root). ``levels``: more than the deepest level; it is looked up if not given."""
    if levels is None:
        levels = (headings.agg(F.max(level)).first()[0] or 0) + 1
    w = Window.partitionBy(group).orderBy(order, key).rowsBetween(Window.unboundedPreceding, -1)
    # the last heading of each level so far, of which the latest lower one is the parent
    lasts = [F.last(F.when(F.col(level) == n, F.struct(F.col(order).alias("o"), F.col(key).alias("k"))), ignorenulls=True).over(w) for n in range(levels)]
    seen = F.array(*[F.when(F.col(level) > n, last) for n, last in enumerate(lasts)])
    return headings.withColumn("parent", F.array_max(seen)["k"])


def closure(nodes: DataFrame, key: str = "node_id", parent: str = "parent_id", depth: int = 1 << 16) -> DataFrame:
    """(node, ancestor, dist) with each node as its own ancestor at 0.

    The distances that are known double in each round: what reaches a node at 2^k - 1 steps or fewer is joined with the ancestors exactly 2^k
    steps up, so a tree of any depth takes a logarithm of rounds, each checkpointed. Parents that
    aren't nodes are left out. Nodes on a cycle have no end: they raise an error beyond ``depth`` steps.
    """
    known = nodes.select(F.col(key).alias("n"))
    jump = nodes.select(F.col(key).alias("n"), F.col(parent).alias("p")).join(known.select(F.col("n").alias("p")), "p", "left_semi").select("n", "p")
    out = known.select(F.col("n").alias("node"), F.col("n").alias("ancestor"), F.lit(0).alias("dist"))
    reach = 1
    while jump.limit(1).count():
        if reach > depth:
            raise ValueError(f"the tree is deeper than {depth} steps or has a cycle")
        far = out.join(jump.withColumnRenamed("n", "at"), F.col("ancestor") == F.col("at")).select("node", F.col("p").alias("ancestor"), (F.col("dist") + reach).alias("dist"))
        up = jump.select(F.col("n").alias("at"), F.col("p").alias("above"))
        out, jump = _settled(out.unionByName(far)), _settled(jump.join(up, F.col("p") == F.col("at")).select("n", F.col("above").alias("p")))
        reach *= 2
    return out


def _settled(df: DataFrame) -> DataFrame:
    """A checkpoint in place of a growing plan, in the folder that ``spark.checkpoint.dir`` names; a local session without one gets a temporary folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kbspark-checkpoint-"))
    return df.checkpoint()


def paths(nodes: DataFrame, ancestors: DataFrame, key: str = "node_id", title: str = "title") -> DataFrame:
    """(node, path, depth): the titles from the root down, joined by `` > ``."""
    named = ancestors.join(nodes.select(F.col(key).alias("ancestor"), F.col(title).alias("title")), "ancestor")
    ordered = named.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("o"), "title"))).alias("all"), F.max("dist").alias("depth"))
    return ordered.select("node", F.array_join(F.transform("all", lambda x: x["title"]), " > ").alias("path"), "depth")


def top_ancestor(ancestors: DataFrame, nodes: DataFrame, key: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """(node, top): the ancestor right below the root; a root has none."""
    roots = nodes.where(F.col(parent).isNull()).select(F.col(key).alias("root"))
    below = nodes.join(roots, F.col(parent) == F.col("root"), "left_semi").select(F.col(key).alias("ancestor"))
    return ancestors.join(below, "ancestor").select("node", F.col("ancestor").alias("top"))


def subtree_stats(nodes: DataFrame, ancestors: DataFrame, key: str = "node_id", kind: str = "type") -> DataFrame:
    """(ancestor, sections, leaves, depth) of what lies below each node."""
    below = ancestors.where("dist > 0").join(nodes.select(F.col(key).alias("node"), F.col(kind).alias("kind")), "node")
    return below.groupBy("ancestor").agg(F.count_if(F.col("kind") == "section").alias("sections"), F.count_if(F.col("kind") != "section").alias("leaves"), F.max("dist").cast("long").alias("depth"))


def representative_text(nodes: DataFrame, ancestors: DataFrame, key: str = "node_id", kind: str = "type", text: str = "text", order: str = "ord", most: int = 200) -> DataFrame:
    """(ancestor, text): the first non-empty leaf, the nearest first."""
    leaves = nodes.where((F.col(kind) != "section") & (F.col(text) != "")).select(F.col(key).alias("node"), F.substring(text, 1, most).alias("t"), F.col(order).alias("o"))
    return ancestors.where("dist > 0").join(leaves, "node").groupBy("ancestor").agg(F.min_by("t", F.struct("dist", "o", "node")).alias("text"))


def nearest_summary(ancestors: DataFrame, nodes: DataFrame, key: str = "node_id", summary: str = "summary") -> DataFrame:
    """(node, summary) of the nearest ancestor-or-self that has one."""
    given = nodes.where(F.coalesce(F.col(summary), F.lit("")) != "").select(F.col(key).alias("ancestor"), F.col(summary).alias("s"))
    return ancestors.join(given, "ancestor").groupBy("node").agg(F.min_by("s", "dist").alias("summary"))


def toc_line(level: Column, title: Column) -> Column:
    """A heading mark for each level, six at most, and the title."""
    return F.concat(F.repeat(F.lit("#"), F.least(F.greatest(level + 1, F.lit(1)), F.lit(6))), F.lit(" "), title)


def toc(sections: DataFrame, group: str = "doc_id", path: str = "section_path", level: str = "level", title: str = "title") -> DataFrame:
    """(doc, toc): the sections' lines in order of their numeric paths, levels counted from the document's lowest."""
    low = F.min(level).over(Window.partitionBy(group))
    lines = sections.withColumn("line", toc_line(F.col(level) - low, F.col(title)))
    return lines.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), "line"))), lambda x: x["line"]), "\n").alias("toc"))


def node_counts(nodes: DataFrame, group: str = "doc_id", kind: str = "type", kinds: tuple[str, ...] = ("section", "paragraph", "table", "figure")) -> DataFrame:
    return nodes.groupBy(group).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def lacks_structure(nodes: DataFrame, group: str = "doc_id", kind: str = "type", parent: str = "parent_id") -> DataFrame:
    """(doc, rebuild): whether a document has no sections, or over six tenths of its leaves right below the root."""
    root_leaf = F.count_if((F.col(kind) != "section") & F.col(parent).isNull())
    leaves = F.count_if(F.col(kind) != "section")
    return nodes.groupBy(group).agg((F.count_if(F.col(kind) == "section") == 0).alias("bare"), root_leaf.alias("r"), leaves.alias("l")).select(group, (F.col("bare") | (F.col("r") * 10 > F.col("l") * 6)).alias("rebuild"))


def with_unique_ids(nodes: DataFrame, key: str = "node_id", order: str = "ord") -> DataFrame:
    """Ids that repeat get #1, #2, ... after the first."""
    w = Window.partitionBy(key).orderBy(order)
    return nodes.withColumn("__n", F.row_number().over(w) - 1).withColumn(key, F.when(F.col("__n") > 0, F.concat_ws("#", key, F.col("__n").cast("string"))).otherwise(F.col(key))).drop("__n")
