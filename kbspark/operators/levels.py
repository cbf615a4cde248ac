"""Navigation of many documents' trees towards many questions, level by level: what ``navigate.walk`` finds without a model, as joins and windows.

A frontier (question, document, section) goes down one level a round: one join with the sections below, one scoring pass, and those that are pruned
stay out. The walk goes depth first and ends at a budget; in the order of the sections' places that is a running sum, so that the sections it came
to are those before the first place where the sums say stop. Nothing of a document or question is gathered in one group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators import tree
from kbspark.operators.navigate import CONTAINERS, Limits
from kbspark.sources.shared import new_folder, stored

Scorer = Callable[[Column, Column], Column]


def word_share(query: Column, text: Column) -> Column:
    """The built-in scorer: the share of the query's words that the text has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    q = words(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(F.coalesce(text, F.lit(""))))) / F.size(q)).otherwise(F.lit(0.0))


def placed(nodes: DataFrame) -> DataFrame:
    """Nodes with ``place``, the way down to each (leaves before sections, then by ord and id), whether it ``holds`` others, its ``at`` among its siblings of the kind, and ``sample``: of a section the first text below it."""
    ids = nodes.select("doc_id", "node_id")
    known = ids.select("doc_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    clean = nodes.select("doc_id", "node_id", "parent_id", "type", "title", "summary", "text", "ord").join(known, ["doc_id", "parent_id"], "left")
    clean = clean.withColumn("parent_id", F.when(F.col("known"), F.col("parent_id"))).drop("known").withColumn("holds", F.col("type").isin(*CONTAINERS))
    siblings = Window.partitionBy("doc_id", "parent_id", "holds").orderBy("ord", "node_id")
    clean = stored(clean.withColumn("at", F.row_number().over(siblings)), new_folder(nodes.sparkSession, "nodes"))
    key = lambda c: F.when(F.col(c).isNotNull(), F.struct("doc_id", F.col(c).alias("node_id")))
    above = tree.closure(clean.select(key("node_id").alias("k"), key("parent_id").alias("up")), "k", "up")
    steps = clean.select(key("node_id").alias("ancestor"), F.struct(F.col("holds"), F.col("ord"), F.col("node_id")).alias("step"))
    places = above.join(steps, "ancestor").groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("o"), "step"))), lambda x: x["step"]).alias("place"))
    out = stored(clean.join(places.select("node.*", "place"), ["doc_id", "node_id"]), new_folder(nodes.sparkSession, "places"))
    texts = out.where(~F.col("holds") & (F.trim(F.coalesce("text", F.lit(""))) != "")).select(key("node_id").alias("node"), "place", F.substring("text", 1, 200).alias("t"))
    samples = above.where("dist > 0").join(texts, "node").groupBy("ancestor").agg(F.min_by("t", "place").alias("sample"))
    return out.join(samples.select("ancestor.*", "sample"), ["doc_id", "node_id"], "left")


def search(nodes: DataFrame, questions: DataFrame, score: Scorer = word_share, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(evidence, visits) for ``questions`` (query_id, doc_id, query): each asks the tree of its document.

    Evidence is (query_id, doc_id, node_id, text, score, ambiguous, is_neighbor), visits (query_id, doc_id, node_id, depth, visit): the sections that
    were expanded, in order. Both are what ``navigate.walk`` gives with the same scorer and no model. Documents without nodes give nothing.
    """
    spark = nodes.sparkSession
    keep = lambda df, name: stored(df, new_folder(spark, name))
    rows = keep(placed(nodes), "tree")
    sections = rows.where("holds").select("doc_id", "node_id", "parent_id", "title", "summary", "sample", "place")
    # entries: the sections below a document and the loose ones; where there are none, the documents themselves
    roots = rows.where("holds and parent_id is null").select("doc_id", "node_id", "place", "type")
    below = sections.join(roots.where("type = 'document'").select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi").select("doc_id", "node_id", "place")
    tops = below.union(roots.where("type <> 'document'").select("doc_id", "node_id", "place"))
    bare = roots.join(tops.select("doc_id"), "doc_id", "left_anti").select("doc_id", "node_id", "place")
    asked = keep(questions.select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "query"), "asked")
    entry = tops.union(bare).withColumn("doc_id", F.col("doc_id").cast("string"))
    frontier = keep(asked.join(entry, "doc_id").select("query_id", "doc_id", "query", "node_id", "place", F.lit(0).alias("depth")), "frontier")
    met = []
    children = sections.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("parent_id").alias("above"), "node_id", "place", F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("title", "summary", "sample")]).alias("about"))
    for depth in range(limits.depth):
        down = frontier.select("query_id", "doc_id", "query", F.col("node_id").alias("above")).join(children, ["doc_id", "above"])
        kept = keep(down.withColumn("value", score(F.col("query"), F.col("about"))).where(F.col("value") >= limits.node_low), "level")
        some = kept.groupBy("query_id", "doc_id", F.col("above").alias("node_id")).agg(F.count("*").alias("open"))
        met.append(frontier.join(some, ["query_id", "doc_id", "node_id"], "left").select("query_id", "doc_id", "query", "node_id", "place", "depth", F.coalesce("open", F.lit(0)).alias("open")))
        frontier = kept.select("query_id", "doc_id", "query", "node_id", "place", F.lit(depth + 1).alias("depth"))
    seen = met[0]
    for one in met[1:]:
        seen = seen.union(one)
    seen = keep(seen, "seen")

    # the leaves of every section that may be met, in bands
    leaves = rows.where(~F.col("holds")).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("parent_id").alias("node_id"), F.col("node_id").alias("leaf"), "at", "text")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    rated = seen.select("query_id", "doc_id", "query", "node_id").join(leaves, ["doc_id", "node_id"]).withColumn("value", F.when(blank, F.lit(0.0)).otherwise(score(F.col("query"), F.col("text"))))
    rated = keep(rated.select("query_id", "doc_id", "node_id", "leaf", "at", "text", "value", blank.alias("blank"), (F.col("value") >= limits.leaf_low).alias("read"), (F.col("value") < limits.leaf_high).alias("doubt")), "rated")
    counts = rated.groupBy("query_id", "doc_id", "node_id").agg(F.count_if("read").alias("reads"), F.count_if(F.col("read") & ~F.col("doubt") & ~F.col("blank")).alias("sure"))

    # the walk stops before a section below another, or at one that may go no deeper but could, once its sums say so
    walk = Window.partitionBy("query_id", "doc_id").orderBy("place")
    sums = seen.join(counts, ["query_id", "doc_id", "node_id"], "left").withColumn("visit", F.row_number().over(walk))
    upto = walk.rowsBetween(Window.unboundedPreceding, 0)
    over = (F.sum(F.coalesce("sure", F.lit(0))).over(upto) >= limits.enough) | (F.col("visit") >= limits.expansions) | (F.sum(F.coalesce("reads", F.lit(0))).over(upto) >= limits.leaf_reads)
    ahead = F.coalesce(F.lead("depth").over(walk) > 0, F.lit(False)) | ((F.col("depth") + 1 >= limits.depth) & (F.col("open") > 0))
    sums = sums.withColumn("ends", (over & ahead).cast("int"))
    before = F.coalesce(F.max("ends").over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    visits = keep(sums.withColumn("before", before).where("before = 0 and visit is not null").select("query_id", "doc_id", "node_id", "depth", "visit"), "visits")

    came = rated.join(visits.select("query_id", "doc_id", "node_id"), ["query_id", "doc_id", "node_id"], "left_semi")
    hits = came.where("read and not blank").select("query_id", "doc_id", F.col("leaf").alias("id"), "text", F.col("value").alias("score"), F.col("doubt").alias("ambiguous"), F.lit(False).alias("is_neighbor"))
    around = came.where("read").select("query_id", "doc_id", "node_id", F.explode(F.sequence(F.col("at") - limits.neighbours, F.col("at") + limits.neighbours)).alias("at")).distinct()
    beside = came.where("not read and not blank").join(around, ["query_id", "doc_id", "node_id", "at"], "left_semi").select("query_id", "doc_id", F.col("leaf").alias("id"), "text", F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"), F.lit(True).alias("is_neighbor"))
    found = hits.union(beside)
    best = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("value"), "leaf")
    lost = came.where("not read").join(came.where("read").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    rescued = lost.withColumn("rn", F.row_number().over(best)).where((F.col("rn") <= limits.rescue) & ~F.col("blank")).select("query_id", "doc_id", F.col("leaf").alias("id"), "text", F.col("value").alias("score"), F.lit(True).alias("ambiguous"), F.lit(False).alias("is_neighbor"))
    return found.union(rescued).withColumnRenamed("id", "node_id"), visits
