"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are cut into blocks of about equal text. With whole weights a of a total W, block k of a source is released in slot
floor(k*W/a) and due by slot ceil((k+1)*W/a); the earliest deadline runs first. The schedule of W slots repeats, so it is worked out once,
for one period, and every block's slot follows from its number: no step of it grows with the data. In every prefix of the slots each
source is less than one block off its share.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def whole_weights(weights: dict[str, float], period: int = 1000) -> dict[str, int]:
    """Weights as whole numbers that add up to ``period`` (largest remainders; at least one each)."""
    total = sum(Fraction(w).limit_denominator(10**9) for w in weights.values())
    exact = {k: Fraction(w).limit_denominator(10**9) * period / total for k, w in weights.items()}
    out = {k: max(1, int(v)) for k, v in exact.items()}
    order = sorted(exact, key=lambda k: (exact[k] - int(exact[k]), k), reverse=True)
    i = 0
    while (gap := period - sum(out.values())) > 0:
        out[order[i % len(order)]] += 1
        i += 1
    while gap < 0:
        most = max(out, key=lambda k: (out[k], k))
        out[most] -= 1
        gap += 1
    return out


def schedule(shares: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, number in the period, slot): one period by earliest deadline, ties by source name."""
    period = sum(shares.values())
    waiting = [(0, source, 0) for source in shares]  # by release time
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, source, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // shares[source]), source, k))
        _, source, k = heapq.heappop(ready)
        out.append((source, k, slot))
        if k + 1 < shares[source]:
            heapq.heappush(waiting, ((k + 1) * period // shares[source], source, k + 1))
    return out


def mix(docs: DataFrame, shares: dict[str, int], other: int = 0, block_chars: int = 100_000, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``mix_block`` (its source's block), ``mix_slot`` (the block's place in the mixture) and ``mix_seq`` (its place in the block).

    Columns of these names are replaced. ``shares`` gives each source's whole weight. Sources without one, the null source among them, share the weight ``other``, or where
    that is 0 follow after everything else in slots counted from 2^62. A block is a run of a source's rows, ordered by the MD5 of
    ``doc_id`` and the text's own MD5 (so that rows of one id, or of none, spread over all ranges), in which ``block_chars`` characters begin (null texts have none); a longer text has its block alone. When a source has run out its
    slots stay empty, and the others keep their proportions. No row is dropped or repeated. Equal rows are interchangeable. An empty table gives no rows.

    A source's running length comes from two levels: sums over ranges of the hash are added up for each source, and rows are added up
    within a range, so that a source with a third of all rows still spreads over all tasks.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_block", "mix_slot", "mix_seq")
    names = set(shares)
    lane = F.when(F.col("source").isin(*names), F.col("source")) if names else F.lit(None).cast("string")
    keyed = docs.withColumns({"__lane": lane, "__chars": F.coalesce(F.length(text), F.lit(0)).cast("long"), "__digest": F.md5(F.coalesce(F.col(text), F.lit("")))})
    keyed = keyed.withColumn("__hash", F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__digest"))).withColumn("__range", F.substring("__hash", 1, 3))
    sums = keyed.groupBy("__lane", "__range").agg(F.sum("__chars").alias("__sum"))
    # at most 4096 rows for each source
    before = F.sum("__sum").over(Window.partitionBy("__lane").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(F.col("__lane").alias("__l"), F.col("__range").alias("__r"), F.coalesce(before, F.lit(0)).alias("__start"))
    within = Window.partitionBy("__lane", "__range").orderBy("__hash", F.col("doc_id").asc_nulls_first(), "__chars", "__digest")
    placed = keyed.withColumn("__upto", F.coalesce(F.sum("__chars").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("mix_seq", F.row_number().over(within).cast("long"))
    placed = placed.join(starts, F.col("__lane").eqNullSafe(F.col("__l")) & (F.col("__range") == F.col("__r")), "left")
    placed = placed.withColumn("mix_block", F.expr(f"(__start + __upto) div {int(block_chars)}"))
    # within a block rows keep the hash's order: the range, then the place in it
    placed = placed.withColumn("mix_seq", F.conv("__range", 16, 10).cast("long") * F.lit(1 << 40) + F.col("mix_seq"))
    late = F.col("mix_block") + F.lit(1 << 62)
    all_shares = dict(shares) | ({"\0other": other} if other else {})
    if not all_shares:
        return placed.select(*docs.columns, "mix_block", late.alias("mix_slot"), "mix_seq")
    period = sum(all_shares.values())
    # both tables have at most ``period`` rows, which is a parameter
    lanes = spark.createDataFrame(list(all_shares.items()), "__name string, __weight long")
    plan = spark.createDataFrame([(s, k, slot) for s, k, slot in schedule(all_shares)], "__source string, __k long, __slot long")
    out = placed.join(F.broadcast(lanes), F.coalesce(F.col("__lane"), F.lit("\0other")) == F.col("__name"), "left").withColumn("__at", F.expr("mix_block % __weight"))
    out = out.join(F.broadcast(plan), (F.col("__name") == F.col("__source")) & (F.col("__at") == F.col("__k")), "left")
    return out.select(*docs.columns, "mix_block", F.coalesce(F.expr(f"(mix_block div __weight) * {period}L + __slot"), late).alias("mix_slot"), "mix_seq")


def in_mixed_order(mixed: DataFrame, partitions: int) -> DataFrame:
    """The rows in the order of the mixture, over range-split partitions."""
    return mixed.repartitionByRange(partitions, "mix_slot", "mix_seq").sortWithinPartitions("mix_slot", "mix_seq")
