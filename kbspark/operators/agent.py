"""The evidence loop as tables: coverage, gaps, upgrades between rounds, stop rules, citations and the default answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of a requirement's states, and the importance from which a requirement must be met.
RANKS = {"MISSING": 0, "PARTIAL": 1, "SUPPORTED": 2}
HIGH_IMPORTANCE, NO_PROGRESS_ROUNDS = 0.8, 3
ALIASES = {"PARTIALLY": "PARTIAL", "NONE": "MISSING", "EMPTY": "MISSING"}


def rank(status: Column) -> Column:
    out = F
    for k, v in RANKS.items():
        out = out.when(status == k, v)
    return out.otherwise(0)


def normalize_status(status: Column) -> Column:
    """A known state or alias of one, in any case; everything else is PARTIAL, so that no unclear answer counts as supported."""
    s = F.upper(F.trim(F.coalesce(status, F.lit(""))))
    out = F
    for k, v in ALIASES.items():
        out = out.when(s == k, v)
    return out.when(s.isin(*RANKS), s).otherwise("PARTIAL")


def coverage(status: DataFrame) -> DataFrame:
    """One row: the share that is supported, 0 without any."""
    return status.agg(F.count("*").alias("total"), F.coalesce(F.round(F.avg((F.col("status") == "SUPPORTED").cast("double")), 6), F.lit(0.0)).alias("coverage"))


def merge_status(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """States only rise."""
    o, n = old.select(key, F.col("status").alias("old")), new.select(key, F.col("status").alias("new"))
    return o.join(n, key, "full").select(key, F.when(rank(F.col("new")) >= rank(F.col("old")), F.coalesce("new", "old")).otherwise(F.coalesce("old", "new")).alias("status"))


def gaps(requirements: DataFrame, status: DataFrame, key: str = "id") -> DataFrame:
    """Requirements that aren't supported and aren't synthetic, the most important first."""
    met = status.where("status = 'SUPPORTED'").select(key)
    return requirements.where("not synthetic").join(met, key, "left_anti").orderBy(F.desc("importance"), key)


def upgraded(rounds: DataFrame, key: str = "id", round_: str = "round") -> DataFrame:
    """(round, id) whose state rose from the round before; before the first all count as missing."""
    w = Window.partitionBy(key).orderBy(round_)
    r = rounds.withColumn("r", rank(F.col("status")))
    return r.withColumn("before", F.coalesce(F.lag("r").over(w), F.lit(0))).where("r > before").select(round_, key)


def no_progress(rounds: DataFrame, key: str = "id", round_: str = "round") -> DataFrame:
    """(round, streak): rounds without an upgrade up to each round. Rounds are few; ids may be many."""
    risen = upgraded(rounds, key, round_).select(round_, F.lit(1).alias("up")).distinct()
    all_rounds = rounds.select(round_).distinct().join(risen, round_, "left")
    last = F.last(F.when(F.col("up") == 1, F.col("n")), ignorenulls=True).over(Window.orderBy(round_).rowsBetween(Window.unboundedPreceding, 0))
    numbered = all_rounds.withColumn("n", F.row_number().over(Window.orderBy(round_)))
    return numbered.select(round_, (F.col("n") - F.coalesce(last, F.lit(0))).cast("long").alias("streak"))


def resolved_synthetic(requirements: DataFrame, status: DataFrame, key: str = "id", deps: str = "deps") -> DataFrame:
    """Synthetic requirements all of whose parts are supported."""
    parts = requirements.where(F.col("synthetic") & (F.size(deps) > 0)).select(key, F.explode(deps).alias("dep"))
    known = status.select(F.col(key).alias("dep"), (F.col("status") == "SUPPORTED").alias("ok"))
    return parts.join(known, "dep", "left").groupBy(key).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok")).where("ok").select(key)


def should_stop(iteration: Column, max_iterations: int, calls: Column, max_calls: int, requirements: Column, open_high: Column, streak: Column) -> Column:
    """The reason to stop, or null: iterations, calls, nothing important left, no progress - in this order."""
    return F.when(iteration >= max_iterations, "hard: iterations").when(calls >= max_calls, "hard: tool calls").when(requirements == 0, F.lit(None)).when(open_high == 0, "sufficiency").when(streak >= NO_PROGRESS_ROUNDS, "no_progress")


def choose_action(has_gap: Column, at_limit: Column, evidence: Column, model: Column) -> Column:
    return F.when(~has_gap | at_limit, "ANSWER").when(evidence == 0, "SEARCH").otherwise(F.coalesce(model, F.lit("SEARCH")))


def add_evidence(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Evidence with new rows of new, non-empty ids; of equal new ids the best."""
    w = Window.partitionBy(key).orderBy(F.desc("score"))
    fresh = new.where(F.coalesce(key, F.lit("")) != "").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return old.unionByName(fresh.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def prune_new(evidence: DataFrame, most: int = 8, round_: str = "round", key: str = "id") -> DataFrame:
    """The best ``most`` of each round."""
    w = Window.partitionBy(round_).orderBy(F.desc("score"), key)
    return evidence.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def citations(evidence: DataFrame, status: DataFrame, key: str = "evidence_id") -> DataFrame:
    """(num, id, text) of the evidence that supported or partly met requirements name, by falling score; numbered after missing rows are gone."""
    named = status.where(F.col("status").isin("SUPPORTED", "PARTIAL")).select(F.explode("evidence_ids").alias(key)).distinct()
    found = evidence.join(named, key)
    return found.withColumn("num", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))


def default_answer(cited: DataFrame, most: int = 1500) -> DataFrame:
    """The answer without a model: numbered texts, a blank line between them. Citations are a bounded list."""
    line = F.concat(F.lit("["), F.col("num").cast("string"), F.lit("] "), F.substring("text", 1, most))
    return cited.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("num", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("answer"))


def evidence_order(evidence: DataFrame, key: str = "id") -> DataFrame:
    return evidence.orderBy("is_neighbor", F.desc("score"), key)


def coverage_evidence(evidence: DataFrame, k: int = 5, most: int = 150, key: str = "id") -> DataFrame:
    return evidence.where("not is_neighbor").orderBy(F.desc("score"), key).limit(k).withColumn("text", F.trim(F.substring("text", 1, most)))


def novelty(best: Column, high: float = 0.55) -> Column:
    return F.when(best >= high, "covered").otherwise("uncovered")
