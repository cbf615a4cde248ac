"""A knowledge base that follows a growing folder of documents: chunks with vectors, and postings, of what is new or changed.

    python -m jobs.knowledge_base DOCUMENTS OUT CHECKPOINT [--config jobs/knowledge_base.json]

Documents are (doc_id, text, ...) in Parquet files that are added over time (a file, a folder or a pattern). The stream's checkpoint knows which files
were taken, and the ledger below ``OUT`` which documents, with a hash of their content: one that comes again unchanged is passed over, one that changed is cut,
embedded and indexed anew in place of its old rows, and one whose text is null is withdrawn. Of rows with one id that come together the one of
the newest file counts. ``OUT/parents``, ``OUT/chunks`` and ``OUT/postings`` are
partitioned by batch (chunks also by language). A run that stops halfway is taken up again by its batch, and a run over nothing new writes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, parser, session, settings
from kbspark.functions import text as T
from kbspark.operators import chunking
from kbspark.operators.batches import Batches, digest_of

DEFAULTS = {"key": "doc_id", "text": "text", "columns": ["source", "lang"], "files_per_batch": 100}
PARENTS = "doc_id long, parent_id string, parent_index int, text string"
CHUNKS = "doc_id long, parent_id string, parent_index int, child_index int, text string, vector array<double>, source string, lang string"
POSTINGS = "doc_id long, parent_index int, child_index int, term string, tf long"


def _pattern(path: str) -> str:
    """A pattern that means the path itself: a stream reads a single file only by a pattern."""
    return path if re.search(r"[*?\[{]", path) else re.sub(r"([^/])/*$", r"[\1]", path)


def _postings(chunks: DataFrame) -> DataFrame:
    """(doc_id, parent_index, child_index, term, tf) in ranges of terms. Terms move once: a range of terms is also what they're counted in."""
    # of a plain explode Spark infers a filter on the terms' number, which would cut each text once more
    terms = chunks.select("doc_id", "parent_index", "child_index", F.explode_outer(T.bm25_terms(F.col("text"))).alias("term")).where("term is not null")
    return terms.repartitionByRange("term").groupBy("doc_id", "parent_index", "child_index", "term").agg(F.count("*").alias("tf"))


def _take(tables: Batches, rows: DataFrame, batch: int, s: dict) -> None:
    """One batch: what changed, step by step, and then its ledger."""
    named = rows.select(F.col(s["key"]).cast("long").alias("key"), F.col(s["text"]).alias("text"), "file_time", *[F.col(c).cast("string").alias(c) for c in s["columns"]])
    tables.write("changes", tables.changes(named.withColumn("digest", digest_of("text", *s["columns"])), batch, "file_time").drop("file_time"), batch)
    changed = tables.spark.read.parquet(f"{tables.folder}/changes/batch={batch}")
    parts = int(tables.spark.conf.get("spark.sql.shuffle.partitions"))  # small files mustn't keep the work in few tasks
    live = changed.where("text is not null").select(F.col("key").alias("doc_id"), "text", *s["columns"]).repartition(parts, "doc_id")
    about = live.select("doc_id", "text", *[F.col(c) if c in live.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")])
    parents, children = chunking.parents_and_children(about, keep=("source", "lang"))
    tables.write("parents", parents.select("doc_id", "parent_id", "parent_index", "text"), batch)
    embedded = children.withColumn("vector", chunking.hash_embedding(F.col("text")))
    tables.write("chunks", embedded.select("doc_id", "parent_id", "parent_index", "child_index", "text", "vector", "source", "lang"), batch, "lang")
    chunks = tables.spark.read.schema(CHUNKS).parquet(f"{tables.folder}/chunks/batch={batch}")
    tables.write("postings", _postings(chunks).sortWithinPartitions("term"), batch)
    tables.commit(changed.select("key", "digest", F.col("text").isNotNull().alias("live")), batch)
    counts = changed.agg(F.count("text").alias("live"), F.count_if(F.col("text").isNull()).alias("gone")).first()
    log.info("batch %d: read %d documents; %d new or changed, %d withdrawn; wrote %d chunks to %s", batch, rows.count(), counts["live"], counts["gone"], chunks.count(), tables.folder)


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> Batches:
    """Take what is new of ``documents``; returns the tables when the stream has ended."""
    s = settings(DEFAULTS, **(config or {}))
    tables = Batches(spark, out)
    source = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", s["files_per_batch"]).parquet(_pattern(documents))
    source = source.select("*", F.col("_metadata.file_modification_time").alias("file_time"))
    query = source.writeStream.foreachBatch(lambda rows, batch: _take(tables, rows, batch, s)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s has %d documents", out, tables.ledger().where("live").count())
    return tables


def contents(tables: Batches) -> DataFrame:
    """(doc_id, parent_index, child_index, lang, digest, n_terms, n_distinct, norm): every chunk as it stands, with what its postings and its vector have."""
    postings = tables.read("postings", POSTINGS, "doc_id").groupBy("doc_id", "parent_index", "child_index").agg(F.sum("tf").alias("n_terms"), F.count("*").alias("n_distinct"))
    norm = F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 3)
    # texts and vectors stay where they are: what is made of them meets the postings
    chunks = tables.read("chunks", CHUNKS, "doc_id").select("doc_id", "parent_index", "child_index", "lang", F.md5("text").alias("digest"), norm.alias("norm"))
    zero = F.lit(0).cast("long")
    met = chunks.join(postings, ["doc_id", "parent_index", "child_index"], "left")
    return met.select("doc_id", F.col("parent_index").cast("long").alias("parent_index"), F.col("child_index").cast("long").alias("child_index"), "lang", "digest", F.coalesce("n_terms", zero).alias("n_terms"), F.coalesce("n_distinct", zero).alias("n_distinct"), "norm")


def main() -> None:
    args = parser("A knowledge base of a growing folder", documents="Parquet of (doc_id, text, ...)", out="the tables' folder", checkpoint="the stream's checkpoint").parse_args()
    with session("knowledge-base") as spark:
        run(spark, args.documents, args.out, args.checkpoint, settings(DEFAULTS, args.config))


if __name__ == "__main__":
    main()
