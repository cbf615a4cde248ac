"""Requirements that follow from others, to a fixpoint; and questions that were asked before in other words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.sources.shared import new_folder, stored

#: How many of a conversation's newest questions are remembered, and how alike two must be.
REMEMBERED, ALIKE = 32, 0.9


def _settle(state: DataFrame) -> DataFrame:
    """(id, ok) of everything that can be settled, of ``state`` (id, rest, ok): what each waits for, and whether all that it waited for was supported. A round moves only what still waits, and what it waits for."""
    spark, done = state.sparkSession, None
    while True:
        new = state.where("size(rest) = 0").select("id", "ok")
        done = new if done is None else done.union(new)
        if not new.limit(1).count():
            return done
        waiting = state.where("size(rest) > 0").select("id", "ok", F.explode("rest").alias("x")).select("id", "ok", "x.dep")
        met = waiting.join(new.select(F.col("id").alias("dep"), F.col("ok").alias("met")), "dep", "left")
        state = stored(_grouped(met, F.col("met").isNull(), F.col("ok") & F.coalesce("met", F.lit(True))), new_folder(spark, "waiting"))


def _grouped(edges: DataFrame, waits: Column, ok: Column) -> DataFrame:
    # structs, since a null is something to wait for, too
    return edges.groupBy("id").agg(F.collect_list(F.when(waits, F.struct("dep"))).alias("rest"), F.bool_and(ok).alias("ok"))


def resolve(requirements: DataFrame, status: DataFrame) -> DataFrame:
    """(id, state) of every synthetic requirement: supported, waiting or cycle.

    ``requirements`` are (id, synthetic, deps), ``status`` (id, status) of the others. A synthetic one is supported when all that it depends on are, synthetic ones
    among them, over any number of steps. It waits while something that isn't supported is in the way, also where it depends on nothing or on what there is
    not; and where it can't be settled in any case, as it's part of a cycle or behind one, the state says so. Repeated dependencies count once.
    """
    spark = requirements.sparkSession
    synthetic = stored(requirements.where("synthetic").select("id", F.array_distinct(F.coalesce("deps", F.array().cast(requirements.schema["deps"].dataType))).alias("deps")), new_folder(spark, "synthetic"))
    edges = synthetic.select("id", F.explode("deps").alias("dep"))
    waits = synthetic.where("size(deps) > 0").select(F.col("id").alias("dep"), F.lit(True).alias("waits")).distinct()
    given = status.where("status = 'SUPPORTED'").join(synthetic.select("id"), "id", "left_anti").select(F.col("id").alias("dep"), F.lit(True).alias("given")).distinct()
    first = _grouped(edges.join(waits, "dep", "left").join(given, "dep", "left"), F.col("waits") | F.col("dep").isNull(), F.coalesce("waits", "given", F.lit(False)))
    # what can't be settled at all hangs on a cycle
    settled = _settle(stored(first, new_folder(spark, "waiting")))
    marks = synthetic.join(settled, "id", "left")
    return marks.select("id", F.when(F.col("ok"), "supported").when(F.col("ok").isNotNull() | (F.size("deps") == 0), "waiting").otherwise("cycle").alias("state"))


def asked_before(questions: DataFrame, alike: float = ALIKE, newest: int = REMEMBERED, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(conv_id, turn, before, score): for each question the most alike of the ``newest`` ones before it in its conversation, the newest of equal ones, if their sets of terms have a Jaccard similarity of ``alike`` at least.

    Terms are in order of how many questions of all have them. Of two sets so alike, the first terms (all but ``alike`` times the size, and one) share one,
    so only questions of a conversation that share a rare term meet. Questions without terms aren't like any.
    """
    spark = questions.sparkSession
    place = Window.partitionBy(key).orderBy(order)
    rows = questions.where(F.col(key).isNotNull()).select(F.col(key).alias("conv"), F.col(order).alias("at"), F.array_distinct(T.bm25_terms(F.col(text))).alias("terms"), F.row_number().over(place).alias("n"))
    rows = stored(rows.where(F.size("terms") > 0), new_folder(spark, "questions"))
    exploded = rows.select("conv", "n", F.size("terms").alias("size"), F.explode("terms").alias("term"))
    counts = stored(exploded.groupBy("term").agg(F.count("*").alias("df")), new_folder(spark, "counts"))
    rare = Window.partitionBy("conv", "n").orderBy("df", "term")
    firsts = exploded.join(counts, "term").withColumn("rn", F.row_number().over(rare)).where(F.col("rn") <= F.col("size") - F.ceil(F.col("size") * alike - 1e-9) + 1)
    firsts = stored(firsts.select("conv", "n", "size", "term"), new_folder(spark, "firsts"))
    a, b = firsts.alias("a"), firsts.alias("b")
    near = (F.col("b.n") < F.col("a.n")) & (F.col("b.n") >= F.col("a.n") - newest) & (F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * alike - 1e-9)
    met = a.join(b, (F.col("a.conv") == F.col("b.conv")) & (F.col("a.term") == F.col("b.term")) & near).select(F.col("a.conv").alias("conv"), F.col("a.n").alias("n"), F.col("b.n").alias("m")).distinct()
    whole = met.join(rows, ["conv", "n"]).join(rows.select("conv", F.col("n").alias("m"), F.col("at").alias("before"), F.col("terms").alias("others")), ["conv", "m"])
    shared = F.size(F.array_intersect("terms", "others"))
    scored = whole.withColumn("score", shared / (F.size("terms") + F.size("others") - shared)).where(F.col("score") >= alike)
    best = scored.groupBy("conv", "at").agg(F.max_by(F.struct("before", "score"), F.struct("score", "m")).alias("x"))
    return best.select(F.col("conv").alias(key), F.col("at").alias(order), "x.before", F.round("x.score", 6).alias("score"))
