"""Evidence for many questions in tiers: a later tier runs only for questions that are still short, without what earlier ones took."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.sources.shared import new_folder, stored

#: Fixed value: characters of the best hit that join a question in the last tier.
ANCHOR_CHARS = 600

#: From (query_id, text, room) of short questions and (query_id, key, tier, score) of what is taken to (query_id, key, score).
Tier = Callable[[DataFrame, DataFrame], DataFrame]


def fill(questions: DataFrame, tiers: list[Tier], k: int = 5) -> DataFrame:
    """(query_id, rank, key, tier, score): up to ``k`` documents for each question (query_id, text), tier by tier, each by falling score and then by key.

    A document counts where it comes first; of a tier's hits that repeat, the best. Questions whose id is null or repeats: null ids get
    nothing, and of texts that share an id the smallest is asked. Each tier's takings are a stored table.
    """
    spark = questions.sparkSession
    asked = questions.where("query_id is not null").groupBy("query_id").agg(F.min("text").alias("text"))
    taken = None
    for i, tier in enumerate(tiers):
        short = asked.withColumn("room", F.lit(k))
        if taken is not None:
            held = taken.groupBy("query_id").agg(F.count("*").alias("held"))
            short = asked.join(held, "query_id", "left").withColumn("room", (F.lit(k) - F.coalesce("held", F.lit(0))).cast("int")).where("room > 0").drop("held")
        short = stored(short, new_folder(spark, "short"))
        none = spark.createDataFrame([], f"query_id {questions.schema['query_id'].dataType.simpleString()}, key long, tier int, score double")
        so_far = none if taken is None else taken
        found = tier(short, so_far).groupBy("query_id", "key").agg(F.max(F.col("score").cast("double")).alias("score"))
        fresh = found.join(so_far.select("query_id", "key"), ["query_id", "key"], "left_anti").join(short.select("query_id", "room"), "query_id")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
        fresh = fresh.withColumn("rn", F.row_number().over(order)).where((F.col("rn") <= k) & (F.col("rn") <= F.col("room"))).select("query_id", "key", F.lit(i).alias("tier"), "score")
        taken = stored(so_far.unionByName(fresh), new_folder(spark, "taken"))
    order = Window.partitionBy("query_id").orderBy("tier", F.desc("score"), "key")
    return taken.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "key", "tier", "score")


#: Odd factors of a run's two hashes.
_FACTORS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def runs(rows: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(key, a, b): the runs of ``length`` terms of each text, as 96 bits of hashes each. Terms are cut by a Column expression and hashed once each; a run's hashes are sums over arrays."""
    powers = [np.array([pow(f, i + 1, 1 << 64) for i in range(length)], np.uint64) for f in _FACTORS]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                terms = [x.split() for x in part.column(1).to_pylist()]
                at = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
                n = len(at) - length + 1
                if n < 1:
                    continue
                h = pd.util.hash_array(np.array([x for t in terms for x in t], object), categorize=False)
                whole = np.flatnonzero(at[:n] == at[length - 1 :])
                a, b = (sum(h[i : n + i] * p for i, p in enumerate(x))[whole] for x in powers)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at[whole])), pa.array(a.view(np.int64)), pa.array((b >> np.uint64(32)).astype(np.uint32).view(np.int32))], names=["key", "a", "b"])

    said = F.trim(F.regexp_replace(F.lower(T.text_or_empty(F.col(text))), r"[^\p{L}\p{N}]+", " "))
    made = rows.select(F.col(key).alias("key"), said.alias("said")).mapInArrow(emit, f"key {rows.schema[key].dataType.simpleString()}, a long, b int")
    return made.withColumnRenamed("key", key)


def quoting(docs: DataFrame, length: int = 8, key: str = "doc_id", text: str = "text") -> Tier:
    """Documents that share runs of ``length`` terms with a question, by how many different ones. Runs meet by equality; nothing else moves."""

    def tier(short: DataFrame, taken: DataFrame) -> DataFrame:
        # stored, so that its size is known before the documents' runs would move
        asked = stored(runs(short, "query_id", "text", length).distinct(), new_folder(docs.sparkSession, "runs"))
        held = runs(docs.where(F.col(key).isNotNull()), key, text, length).withColumnRenamed(key, "key").join(asked.select("a", "b").distinct(), ["a", "b"], "left_semi")
        return asked.join(held.distinct(), ["a", "b"]).groupBy("query_id", "key").agg(F.count("*").cast("double").alias("score"))

    return tier


def overlap_join(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """(query_id, key, score): pairs of ``left`` (query_id, terms) and ``right`` (key, terms) whose term sets share at least ``least``, with how many they share.

    Terms are put in order of how many of ``right`` have them, rarest first. Two sets that share ``least`` terms also share one if each leaves out its ``least - 1``
    last ones, so only the rest meets; common terms hardly ever do. Every pair that met is then counted whole. Sets are cut and stored once, terms as 64 bits of hashes.
    """
    spark = left.sparkSession

    def sets(rows: DataFrame, by: str) -> DataFrame:
        return stored(rows.select(by, F.array_distinct(F.transform("terms", lambda x: F.xxhash64(x))).alias("terms")), new_folder(spark, "sets"))

    ids, keys = sets(left, "query_id"), sets(right, "key")
    exploded = stored(keys.select("key", F.size("terms").alias("n"), F.explode("terms").alias("term")).where(F.col("n") >= least), new_folder(spark, "terms"))
    counts = stored(exploded.groupBy("term").agg(F.count("*").alias("df")), new_folder(spark, "counts"))

    def firsts(rows: DataFrame, by: str) -> DataFrame:
        order = Window.partitionBy(by).orderBy(F.coalesce("df", F.lit(0)), "term")
        return rows.join(counts, "term", "left").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= F.col("n") - (least - 1)).select(by, "term")

    asked = ids.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term")).where(F.col("n") >= least)
    met = firsts(asked, "query_id").join(firsts(exploded, "key"), "term").select("query_id", "key").distinct()
    shared = met.join(ids, "query_id").join(keys.withColumnRenamed("terms", "others"), "key").select("query_id", "key", F.size(F.array_intersect("terms", "others")).cast("double").alias("score"))
    return shared.where(F.col("score") >= least)


def titled(docs: DataFrame, least: int = 6, key: str = "doc_id", text: str = "text") -> Tier:
    """Documents whose first line that isn't blank shares at least ``least`` different terms with a question, by how many."""
    line = F.get(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != ""), F.lit(0))

    def tier(short: DataFrame, taken: DataFrame) -> DataFrame:
        held = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), T.bm25_terms(line).alias("terms"))
        return overlap_join(short.select("query_id", T.bm25_terms(F.col("text")).alias("terms")), held, least)

    return tier


def anchored(docs: DataFrame, search: Callable[[DataFrame, int], DataFrame], k: int = 5, key: str = "doc_id", text: str = "text") -> Tier:
    """Documents that ``search`` (of questions and a number) finds for the question and the beginning of its first document so far."""

    def tier(short: DataFrame, taken: DataFrame) -> DataFrame:
        first = taken.groupBy("query_id").agg(F.min_by("key", F.struct("tier", -F.col("score"), "key")).alias("key"))
        begun = first.join(docs.select(F.col(key).alias("key"), F.substring(text, 1, ANCHOR_CHARS).alias("begun")), "key").groupBy("query_id").agg(F.min("begun").alias("begun"))
        asked = short.join(begun, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "begun").alias("text"))
        return search(asked, 2 * k).select("query_id", "key", "score")

    return tier
