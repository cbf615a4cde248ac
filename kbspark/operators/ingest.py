"""Structured ingest: files to nodes, nodes to chunks with their lineage, chunks to vectors and postings, each step a table that a later run takes up again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import chunking, search, store, tree
from kbspark.operators.batches import Batches, digest_of
from kbspark.sources import markup
from kbspark.sources.shared import new_folder, stored

#: Steps in their order.
STEPS = ("parse", "chunk", "embed", "index")


def nodes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node_id, parent_id, type, title, text, level, ord, section_path) of Markdown or plain documents.

    Headings are sections below the last earlier heading of a lower level, other blocks are leaves of the heading before them, and a
    document is the root of both. ``section_path`` has the places of the sections from the top down, counted from 0 among their siblings;
    a leaf has its section's. Null and empty texts give their root alone.
    """
    named = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    blocks = markup.markdown_blocks(named, "doc_id", "text").withColumnRenamed("seq", "ord")
    headings = blocks.where("kind = 'heading'").withColumn("heading_id", F.col("ord").cast("long"))
    parents = tree.nest(headings, "doc_id", "ord", "heading_id", "level").select("doc_id", "heading_id", F.col("parent").cast("long").alias("parent"))
    places = _paths(parents)
    node_id = lambda c: F.concat_ws(":node:", "doc_id", F.col(c).cast("string"))
    root = F.concat(F.col("doc_id"), F.lit(":root"))
    above = lambda c: F.when(F.col(c).isNull(), root).otherwise(node_id(c))
    sections = headings.join(places, ["doc_id", "heading_id"]).select("doc_id", node_id("heading_id").alias("node_id"), above("parent").alias("parent_id"), F.lit("section").alias("type"), F.col("text").alias("title"), F.lit("").alias("text"), F.col("level").cast("long").alias("level"), F.col("ord").cast("long").alias("ord"), "section_path")
    content = blocks.where("kind <> 'heading'").select("doc_id", "ord", F.col("ord").cast("long").alias("content_id"), "kind", "text")
    held = tree.attach_to_headings(content, headings).select("doc_id", "content_id", "heading_id")
    leaves = content.join(held, ["doc_id", "content_id"]).join(places.select("doc_id", "heading_id", "section_path"), ["doc_id", "heading_id"], "left")
    leaves = leaves.select("doc_id", node_id("content_id").alias("node_id"), above("heading_id").alias("parent_id"), F.when(F.col("kind") == "table", "table").otherwise("paragraph").alias("type"), F.lit("").alias("title"), "text", F.lit(None).cast("long").alias("level"), F.col("content_id").alias("ord"), F.coalesce("section_path", F.array().cast("array<long>")).alias("section_path"))
    roots = named.select("doc_id", root.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("document").alias("type"), F.col("doc_id").alias("title"), F.lit("").alias("text"), F.lit(None).cast("long").alias("level"), F.lit(-1).cast("long").alias("ord"), F.array().cast("array<long>").alias("section_path"))
    return roots.unionByName(sections).unionByName(leaves)


def _paths(parents: DataFrame) -> DataFrame:
    """(doc_id, heading_id, parent, section_path) from each heading's parent."""
    siblings = Window.partitionBy("doc_id", "parent").orderBy("heading_id")
    placed = parents.withColumn("at", F.row_number().over(siblings) - 1)
    key = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("#", "doc_id", F.col(c).cast("string")))
    keyed = placed.select("doc_id", "heading_id", "parent", F.col("at").cast("long").alias("at"), key("heading_id").alias("k"), key("parent").alias("up"))
    up = tree.closure(keyed, "k", "up").join(keyed.select(F.col("k").alias("ancestor"), "at"), "ancestor")
    steps = up.groupBy(F.col("node").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("o"), "at"))), lambda x: x["at"]).alias("section_path"))
    return keyed.join(steps, "k").select("doc_id", "heading_id", "parent", "section_path")


def chunks(found: DataFrame, most: int = chunking.MOST_CHARS, short: int = chunking.SHORT_CHARS) -> DataFrame:
    """(doc_id, chunk_id, chunk_seq, text, parent_node_id, source_node_ids, section_path, node_type) of ``nodes``.

    Within a section short leaves are joined while they fit, longer ones are cut by themselves; a section's own chunks come before those
    of its sections, and ``chunk_seq`` counts through the document. A chunk of short leaves belongs to their section, one of a longer
    leaf to that leaf. One group is a section's leaves.
    """
    leaves = found.where(~F.col("type").isin("section", "document") & (F.trim("text") != ""))
    ordered = leaves.groupBy("doc_id", "parent_id", "section_path").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id", "type", "text"))).alias("all"))
    piece = "struct<text:string,sources:array<string>,type:string,owner:string>"
    empty = F.struct(F.array().cast(f"array<{piece}>").alias("done"), F.lit("").alias("held"), F.array().cast("array<string>").alias("ids"), F.lit("").alias("type"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["held"] == "", acc["done"]).otherwise(F.array_append(acc["done"], F.struct(acc["held"].alias("text"), acc["ids"].alias("sources"), acc["type"].alias("type"), F.lit(None).cast("string").alias("owner"))))

    def step(acc: Column, x: Column) -> Column:
        t, ids = F.trim(x["text"]), F.array(x["node_id"])
        fits = (acc["held"] == "") | (F.length(acc["held"]) + F.length(t) + 2 <= most)
        joined = F.when(acc["held"] == "", t).otherwise(F.concat(acc["held"], F.lit("\n\n"), t))
        own = F.transform(chunking.split_long(t, most), lambda p: F.struct(p.alias("text"), ids.alias("sources"), x["type"].alias("type"), x["node_id"].alias("owner")))
        begun = F.struct(F.when(fits, acc["done"]).otherwise(flushed(acc)).alias("done"), F.when(fits, joined).otherwise(t).alias("held"), F.when(fits, F.concat(acc["ids"], ids)).otherwise(ids).alias("ids"), F.when(fits & (acc["held"] != ""), acc["type"]).otherwise(x["type"]).alias("type"))
        alone = F.struct(F.concat(flushed(acc), own).alias("done"), F.lit("").alias("held"), F.array().cast("array<string>").alias("ids"), F.lit("").alias("type"))
        return F.when(F.length(t) <= short, begun).otherwise(alone)

    folded = ordered.withColumn("pieces", F.aggregate("all", empty, step, flushed)).select("doc_id", "parent_id", "section_path", F.posexplode("pieces").alias("at", "p"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_path", "at")) - 1
    owner = F.coalesce("p.owner", "parent_id")
    out = folded.withColumn("chunk_seq", number.cast("long"))
    return out.select("doc_id", F.concat_ws(":chunk:", "doc_id", F.col("chunk_seq").cast("string")).alias("chunk_id"), "chunk_seq", F.col("p.text").alias("text"), owner.alias("parent_node_id"), F.col("p.sources").alias("source_node_ids"), "section_path", F.col("p.type").alias("node_type"))


def embedded(rows: DataFrame, text: str = "text") -> DataFrame:
    """Chunks with their vectors (the built-in hashed embedding)."""
    return rows.withColumn("vector", chunking.hash_embedding(F.col(text)))


def postings(rows: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(term, chunk_id, tf, n): the stored index, with each chunk's length beside its terms, so that a question reads its own terms' rows only."""
    cut = rows.select(F.col(key), T.bm25_terms(F.col(text)).alias("terms"))
    counted = cut.select(key, F.size("terms").cast("long").alias("n"), "terms")  # before they're exploded, or each posting would cut its text again
    # of a plain explode Spark infers a filter on the terms' number, which would cut each text once more
    posted = counted.select(key, "n", F.explode_outer("terms").alias("term")).where("term is not null")
    # a maximum lets a filter on terms pass below the grouping, which ``first`` would not
    return posted.groupBy("term", key).agg(F.count("*").alias("tf"), F.max("n").alias("n"))


def totals(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row: the number of chunks and their mean length."""
    return rows.agg(F.count("*").alias("docs"), F.avg(F.size(T.bm25_terms(F.col(text)))).alias("mean"))


def bm25_indexed(index: DataFrame, total: DataFrame, query: str, k: int = 5, key: str = "chunk_id") -> DataFrame:
    """(key, score) of the best k by the stored index; written clustered by term, the filter prunes the files of all other terms. The question's postings are read once, into a table that the counts and the scores are read from."""
    import re

    terms = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    rows = stored(index.where(F.col("term").isin(*terms)) if terms else index.where("false"), new_folder(index.sparkSession, "asked"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the question
    met = rows.join(F.broadcast(df), "term").join(F.broadcast(total))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (search.K1 + 1) / (F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("n") / F.col("mean")))
    return met.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def _steps(tables: Batches, batch: int) -> None:
    """The steps of one batch, from its stored changes to its ledger. A step that is whole is read, not made again."""

    def step(name: str, build, *by: str) -> DataFrame:
        if batch not in tables.done(name):
            rows = build()
            tables.write(name, rows.repartitionByRange(*by).sortWithinPartitions(*by) if by else rows, batch)
        return tables.part(name, batch)

    changed = tables.part("changes", batch)
    found = step("parse", lambda: nodes(changed.where("live").select(F.col("key").alias("doc_id"), "text")))
    cut = step("chunk", lambda: chunks(found))
    step("embed", lambda: embedded(cut))
    step("index", lambda: postings(cut).withColumn("doc_id", F.regexp_extract("chunk_id", r"(?s)^(.*):chunk:\d+$", 1)), "term")
    if batch not in tables.done("ledger"):
        tables.commit(changed, batch)


def run(spark: SparkSession, docs: DataFrame, out: str, key: str = "doc_id", text: str = "text", withdrawn: DataFrame | None = None) -> dict[str, DataFrame]:
    """Ingest documents that are new, or changed since they were ingested last, as a batch of tables below ``out``; returns all tables as they stand.

    A batch that was lost halfway is gone on with first, from the step that isn't whole. Documents that are as they were do nothing, so running
    again with the same input writes nothing. ``withdrawn`` (``key``) takes documents out. Rows with a null key are left out; of rows that share one, one counts.
    """
    tables = Batches(spark, out, "string")
    for batch in tables.done("changes"):
        _steps(tables, batch)
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.lit(True).alias("live"))
    if withdrawn is not None:
        rows = rows.unionByName(withdrawn.select(F.col(key).cast("string").alias("key"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("live")))
    batch = max(tables.done("changes"), default=-1) + 1
    changes = tables.changes(rows.withColumn("digest", digest_of("text", "live")), batch, "digest")
    if changes.limit(1).count() or not batch:
        tables.write("changes", changes, batch)
        _steps(tables, batch)
    made = {name: tables.read(name, tables.part(name, batch if batch in tables.done(name) else 0).schema, "doc_id") for name in STEPS}
    return made | {"totals": totals(made["chunk"])}


def resume_point(spark: SparkSession, out: str) -> str | None:
    """The first step that isn't whole for every batch; None when all are."""
    tables = Batches(spark, out, "string")
    batches = tables.done("changes")
    return next((s for s in STEPS if not batches or set(batches) - set(tables.done(s))), None)


def pdf_sections(boxes: DataFrame, outlines: DataFrame, larger: float = 1.2, longest: int = 120) -> DataFrame:
    """(path, kind, level, page, top, text, source): the headings and paragraphs of PDF files, from the lines and outlines of ``sources.pdf``.

    An outline's heading stands where the first line that matches its title does, else before its page's first line (top -1). Of the other
    lines those of at most ``longest`` characters whose font is ``larger`` times the file's median size are headings, too: of the level
    that their number tells, else by their height. Null texts are left out, and files without an outline have lines only.
    """
    median = boxes.groupBy("path").agg(F.median("size").alias("body"))
    lines = boxes.where("text is not null").withColumn("id", F.col("page").cast("long") * (1 << 32) + F.col("seq"))
    place = store.calibrated(outlines.select(F.col("path").alias("doc_id"), "ord", "title"), lines.select(F.col("path").alias("doc_id"), "id", "page", "top", "text"))
    place = place.select(F.col("doc_id").alias("path"), "ord", F.col("page").alias("at"), "top")
    named = outlines.join(place, ["path", "ord"]).select("path", F.lit("heading").alias("kind"), "level", F.coalesce("at", "page").alias("page"), F.coalesce("top", F.lit(-1.0)).alias("top"), F.col("title").alias("text"), F.lit("outline").alias("source"))
    rest = lines.join(place.where("top is not null").select("path", F.col("at").alias("page"), "top"), ["path", "page", "top"], "left_anti").join(median, "path")
    title = (F.col("size") >= larger * F.col("body")) & (F.length("text") <= longest)
    level = F.coalesce(T.heading_level(F.col("text")), F.when(F.col("size") >= 1.4 * F.col("body"), 0).otherwise(1)).cast("int")
    return named.unionByName(rest.select("path", F.when(title, "heading").otherwise("paragraph").alias("kind"), F.when(title, level).alias("level"), "page", "top", "text", F.lit("box").alias("source")))
