"""Quality rules: thresholds that follow the data, from mergeable quantile sketches per language and source, then a joined filter.

A sketch is a histogram: a whole number's bin keeps its five leading bits, so a quantile is exact below 32 and at most 1/16 too low above.
Sketches merge by adding counts, give the same result in any order, and have at most a few hundred bins for each group and measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import WORD_PATTERN, cut

#: The measures that thresholds are set for (whole numbers, in thousandths) and the least spread that counts as ordinary.
MEASURES = {"symbol_pm": 15, "capital_pm": 40, "repeat_pm": 60, "line_pm": 75, "word_length_pm": 1000}
#: The counts that they are made from.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")
_SPACE = r"\x20\x09-\x0D"


def _repeat_words(grams: Column, ranked: Column) -> Column:
    """Words in the windows that occur twice or more: each such window adds its words that the one before it didn't have."""
    # sorted (hash, position) pairs: a window is repeated if a neighbour has its hash
    pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(ranked) == 0, F.lit(0)).otherwise(_covered(pairs))


def _covered(pairs: Column) -> Column:
    def repeated(all_pairs: Column) -> Column:
        n = F.size(all_pairs)
        hit = F.filter(all_pairs, lambda p, k: ((k > 0) & (p["h"] == F.get(all_pairs, k - 1)["h"])) | ((k < n - 1) & (p["h"] == F.get(all_pairs, k + 1)["h"])))
        return F.array_sort(F.transform(hit, lambda p: p["i"]))

    def total(places: Column) -> Column:
        gains = F.transform(places, lambda v, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), v - F.get(places, k - 1))))
        return F.aggregate(gains, F.lit(0), lambda a, x: a + x)

    # let-bindings: a one-element array's transform gives its element a name, so that it is computed once
    places = F.get(F.transform(F.array(pairs), repeated), F.lit(0))
    return F.get(F.transform(F.array(places), total), F.lit(0))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the word counts of the whole text (``COUNTS``) and the measures (see ``MEASURES``); columns of these names are replaced.

    Null and empty texts have no words and zeros. A window is told by a 64-bit hash of its three words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.split(F.btrim(t, F.lit(" \t\n\x0b\f\r")), f"[{_SPACE}]+")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    rest = [c for c in docs.columns if c not in (text, *COUNTS, *MEASURES)]
    base = docs.select(
        *rest,
        F.when(F.btrim(t, F.lit(" \t\n\x0b\f\r")) == "", F.array().cast("array<string>")).otherwise(words).alias("__words"),
        F.length(F.regexp_replace(t, f"[{_SPACE}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        lines.alias("__lines"),
    )
    w = F.col("__words")
    grams = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    hashed = base.select(
        *rest, F.size("__words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_capitals", F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), grams.alias("__grams"),
    )
    ordered = hashed.withColumn("__sorted", F.sort_array("__grams"))
    twice = ordered.withColumn("__twice", F.filter("__sorted", lambda h, k: (k > 0) & (h == F.get(F.col("__sorted"), k - 1)))).drop("__sorted")
    found = twice.withColumn("n_repeat_words", _repeat_words(F.col("__grams"), F.col("__twice")).cast("long")).drop("__grams", "__twice")

    def pm(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.expr(f"{a} * 1000 div {b}")).otherwise(F.lit(0)).cast("long")

    return found.withColumns({"symbol_pm": pm("n_symbols", "n_words"), "capital_pm": pm("n_capitals", "word_chars"), "repeat_pm": pm("n_repeat_words", "n_words"), "line_pm": pm("n_dup_lines", "n_lines"), "word_length_pm": pm("word_chars", "n_words")})


def sketch(measured: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, edge, n): the bin counts of each group and measure, summed before they are shuffled."""
    each = measured.select(*groups, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES])).alias("m")).select(*groups, "m.measure", "m.value")
    shift = F.greatest(F.length(F.bin("value")) - 5, F.lit(0))
    return each.withColumn("edge", F.call_function("shiftleft", F.call_function("shiftright", F.col("value"), shift), shift)).groupBy(*groups, "measure", "edge").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of coarser groups, from those of finer ones."""
    return sketches.groupBy(*groups, "measure", "edge").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str], at: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """(groups, measure, total, q<percent>...): the lowest bin edge up to which at least that share of the rows lies. Windows hold bins only."""
    w = Window.partitionBy(*groups, "measure")
    running = sketches.withColumns({"upto": F.sum("n").over(w.orderBy("edge")), "total": F.sum("n").over(w)})
    picks = [F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("edge"))).alias(f"q{q}") for q in at]
    return running.groupBy(*groups, "measure").agg(F.first("total").alias("total"), *picks)


def blended(counts: DataFrame, coarser: DataFrame, groups: list[str], shared: list[str], least: int) -> DataFrame:
    """(groups, measure, edge, share): the share of a group's rows up to each edge, with ``least`` more rows that lie as the ``coarser`` group's do.

    ``coarser`` is (shared, measure, edge, share) and has every edge of its parts. A group's own rows count for the more the more of them
    there are, and no number of rows is an edge at which its sketch begins to count. A group has a few hundred rows here, as its sketch does.
    """
    totals = counts.groupBy(*groups, "measure").agg(F.sum("n").alias("total"))
    wide = coarser.withColumnsRenamed({c: f"__{c}" for c in shared} | {"measure": "__measure"})
    same = F.col("measure") == F.col("__measure")
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    grid = totals.join(wide, same).select(*groups, "measure", "edge", F.lit(0).cast("long").alias("n"), "total", "share")
    own = counts.select(*groups, "measure", "edge", "n", F.lit(None).cast("long").alias("total"), F.lit(None).cast("double").alias("share"))
    each = grid.union(own).groupBy(*groups, "measure", "edge").agg(F.sum("n").alias("n"), F.max("total").alias("total"), F.max("share").alias("share"))
    upto = F.sum("n").over(Window.partitionBy(*groups, "measure").orderBy("edge"))
    return each.select(*groups, "measure", "edge", ((upto + least * F.col("share")) / (F.col("total") + least)).alias("share"))


def thresholds(sketches: DataFrame, least: int = 200, width: int = 4) -> DataFrame:
    """(lang, source, measure, high): the median plus ``width`` times the spread from the tenth percentile to the median, that spread at least the measure's ordinary one.

    A group's sketch has ``least`` rows of its language's added, and a language's as many of the whole table's (see ``blended``): small
    groups follow the coarser ones, large ones themselves, without a size at which that changes. Up to half of a large group may be bad without moving its threshold.
    """
    w = Window.partitionBy("measure")
    whole = merge(sketches, []).select("measure", "edge", (F.sum("n").over(w.orderBy("edge")) / F.sum("n").over(w)).alias("share"))
    by_lang = blended(merge(sketches, ["lang"]), whole, ["lang"], [], least)
    own = blended(sketches, by_lang, ["lang", "source"], ["lang"], least)
    found = own.groupBy("lang", "source", "measure").agg(*[F.min(F.when(F.col("share") * 100 >= q, F.col("edge"))).alias(f"q{q}") for q in (10, 50)])
    ordinary = F.coalesce(*[F.when(F.col("measure") == m, F.lit(v)) for m, v in MEASURES.items()])
    return found.select("lang", "source", "measure", (F.col("q50") + width * F.greatest(F.col("q50") - F.col("q10"), ordinary)).cast("long").alias("high"))


def judge(docs: DataFrame, text: str = "text", least: int = 200, width: int = 4) -> DataFrame:
    """``docs`` without its text, with the base counts, ``base_failed``, the measures and ``kept``.

    A document fails the base rules with under 50 words or with over half of its words in repeated three-word windows. Of the rest it is
    kept unless a measure lies above its group's threshold. Null languages and sources are groups of their own; repeated rows count each;
    an empty table gives no rows; columns of the names that are added are replaced. The measures are written once and read for both the sketches and the filter. The thresholds, a row for
    each language and source, meet the rows by a join that Spark may broadcast by size and whose hot keys adaptive execution splits.
    """
    measured = cut(measure(docs.drop("base_failed", "kept"), text), "measures")
    high = thresholds(sketch(measured, ["lang", "source"]), least, width)
    wide = high.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col("high"))).alias(f"high_{m}") for m in MEASURES])
    wide = wide.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    joined = measured.join(wide, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left").drop("__lang", "__source")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = F.lit(False)
    for m in MEASURES:
        over = over | (F.col(m) > F.col(f"high_{m}"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(False)))
