"""Evidence sheets for a set of questions: up to ``k`` documents for each, as an evaluation or a review needs them.

    python -m jobs.evidence QUESTIONS DOCUMENTS OUT [--config jobs/evidence.json]

Questions are (id, text) and documents (id, text) in Parquet. Documents that quote a question come first, then those whose title shares
enough of its terms, then the best by BM25 of the question and the beginning of its first document. ``OUT/index`` holds the BM25 index, ``OUT/evidence``
the sheets, partitioned by tier. A run writes both anew, so running it again gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import conf, log, parser, session, settings
from kbspark.operators import block_index, tiers

DEFAULTS = {"question_id": "item_id", "question": "text", "key": "doc_id", "text": "text", "k": 5, "run_terms": 8, "title_terms": 6, "block": 128}
TIERS = ("quoting", "titled", "anchored")
SCHEMA = "query_id long, rank int, doc_id long, score double, tier string"


def run(spark: SparkSession, questions: str, documents: str, out: str, config: dict | None = None) -> DataFrame:
    """Make the sheets; returns them read back: (query_id, rank, doc_id, score, tier)."""
    s = settings(DEFAULTS, **(config or {}))
    asked = spark.read.parquet(questions).select(F.col(s["question_id"]).cast("long").alias("query_id"), F.col(s["question"]).alias("text"))
    docs = spark.read.parquet(documents).select(F.col(s["key"]).cast("long").alias("doc_id"), F.col(s["text"]).alias("text"))
    log.info("read %d questions of %s and %d documents of %s", asked.count(), questions, docs.count(), documents)
    with conf(spark, spark__sql__sources__partitionOverwriteMode="static"):
        block_index.write(docs, f"{out}/index", block=s["block"])
        reader = block_index.Reader(spark, f"{out}/index")
        steps = [tiers.quoting(docs, s["run_terms"]), tiers.titled(docs, s["title_terms"]), tiers.anchored(docs, reader.search, s["k"])]
        found = tiers.fill(asked, steps, s["k"])
        names = F.element_at(F.array(*[F.lit(x) for x in TIERS]), F.col("tier") + 1)
        rows = found.select("query_id", "rank", F.col("key").alias("doc_id"), "score", names.alias("tier"))
        rows.repartition("tier").sortWithinPartitions("query_id", "rank").write.mode("overwrite").partitionBy("tier").parquet(f"{out}/evidence")
    written = spark.read.schema(SCHEMA).parquet(f"{out}/evidence")
    for r in written.groupBy("tier").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("q")).orderBy("tier").collect():
        log.info("wrote %d documents for %d questions to %s/evidence/tier=%s", r["n"], r["q"], out, r["tier"])
    return written


def main() -> None:
    args = parser("Evidence sheets for a set of questions", questions="Parquet of (item_id, text)", documents="Parquet of (doc_id, text)", out="the folder of the index and the sheets").parse_args()
    with session("evidence") as spark:
        run(spark, args.questions, args.documents, args.out, settings(DEFAULTS, args.config))


if __name__ == "__main__":
    main()
