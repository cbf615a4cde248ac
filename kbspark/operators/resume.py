"""Records of people: flattening nested rows, degrees, names of regions and companies. Dictionaries are tables that the caller brings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as T

#: Degrees from low to high, and suffixes that region names may lack.
DEGREE_ORDER = ("初中", "中技", "中专", "职高", "高中", "专科", "专升本", "本科", "硕士", "MBA", "EMBA", "MPA", "博士", "博士后")
REGION_SUFFIX = "市"


def highest_degree(degrees: Column) -> Column:
    """The highest of an array of degree names; empty without a known one."""
    order = F.array(*[F.lit(d) for d in DEGREE_ORDER])
    best = F.array_max(F.transform(degrees, lambda d: F.array_position(order, d)))
    return F.when(best > 0, F.get(order, (best - 1).cast("int"))).otherwise("")


def age(birth: Column, as_of: Column) -> Column:
    return F.year(as_of) - F.year(birth)


def integrity(*fields: Column) -> Column:
    """The share of fields that are filled."""
    filled = sum((F.when(F.coalesce(f.cast("string"), F.lit("")) != "", 1).otherwise(0) for f in fields), F.lit(0))
    return filled / len(fields)


def is_region(names: DataFrame, regions: DataFrame, name: str = "name", region: str = "region") -> DataFrame:
    """``names`` with ``is_region``: the name, or the name with the suffix, is a region's."""
    known = regions.select(F.col(region).alias("__r")).union(regions.where(F.col(region).endswith(REGION_SUFFIX)).select(F.regexp_replace(region, f"{REGION_SUFFIX}$", ""))).distinct()
    return names.join(known, F.col(name) == F.col("__r"), "left").withColumn("is_region", F.col("__r").isNotNull()).drop("__r")


def company_norm(name: Column) -> Column:
    """Lower case without parentheses, punctuation and legal forms."""
    t = T.strip_noise(F.lower(T.text_or_empty(name)))
    return F.regexp_replace(t, r"(有限责任公司|股份有限公司|有限公司|集团|公司|inc|ltd|llc|corp|co)$", "")


def flatten(rows: DataFrame, schema: str, column: str = "cv") -> DataFrame:
    """JSON records as columns of a schema; Y and N, M and F as words."""
    parsed = rows.withColumn("__j", F.from_json(column, schema))
    words = {"Y": "是", "N": "否", "M": "男", "F": "女"}
    flat = parsed.select(*[c for c in rows.columns if c != column], "__j.*")
    return flat.withColumns({c: T.lookup(words, F.col(c), F.col(c)) for c, t in flat.dtypes if t == "string" and c not in rows.columns})


def tenure(start: Column, end: Column, as_of: Column) -> Column:
    """Years from start to end (or ``as_of``), one decimal."""
    return F.round(F.datediff(F.coalesce(end, as_of), start) / 365.0, 1)


def ancestors(dictionary: DataFrame, ids: DataFrame, key: str = "id", parent: str = "parent_id", name: str = "name") -> DataFrame:
    """(id, names): each id's name and those above it, nearest first."""
    from kbspark.operators.tree import closure

    up = closure(dictionary, key, parent).join(dictionary.select(F.col(key).alias("ancestor"), F.col(name).alias("__n")), "ancestor")
    named = up.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("dist", "__n"))), lambda x: x["__n"]).alias("names"))
    return ids.join(named.withColumnRenamed("node", key), key, "left")
