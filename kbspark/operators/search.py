"""Retrieval: exact dense top-k, BM25 over an inverted index, reciprocal-rank fusion, section filters, neighbours and parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.sources.shared import new_folder, stored

#: The fusion constant, and the factor that puts fused scores on a scale to one for two lists.
RRF_K, RRF_SCALE = 60, 30.0
K1, B = 1.2, 0.75


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_scores(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """Every row with its cosine to the query, six decimals; the query is a literal in the scan's own stage."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", F.round(cosine(F.col(column), q), 6))


def dense_topk(vectors: DataFrame, query: list[float], k: int = 5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest rows; every task keeps k, and only those meet."""
    return dense_scores(vectors, query, column).orderBy(F.desc("score"), key).limit(k)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, term, tf): the inverted index."""
    return docs.select(F.col(key), F.explode(T.bm25_terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.size(T.bm25_terms(F.col(text))).cast("long").alias("doc_length"))


def document_frequencies(index: DataFrame, key: str = "doc_id") -> DataFrame:
    return index.groupBy("term").agg(F.count(key).alias("df"))


def bm25_scores(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of the documents that hold a query term. One pass counts terms in place, into a table of a few numbers a document that the totals and the scores are read from."""
    import re

    terms = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    found = T.bm25_terms(F.col(text))
    counted = docs.select(F.col(key), F.size(found).cast("long").alias("n"), found.alias("t"))

    def times(w: str) -> Column:
        return F.size(F.filter("t", lambda x: x == F.lit(w))).cast("long")

    tf = [times(w).alias(f"tf{i}") for i, w in enumerate(terms)]
    counted = stored(counted.select(key, "n", *tf), new_folder(docs.sparkSession, "term-counts"))
    totals = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])  # one row
    joined = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(terms))) or "false").join(F.broadcast(totals))
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return joined.select(key, F.round(score, 6).alias("score"))


def bm25_topk(docs: DataFrame, query: str, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    return bm25_scores(docs, query, key, text).orderBy(F.desc("score"), key).limit(k)


def ranked(hits: DataFrame, key: str) -> DataFrame:
    """A bounded hit list (a top-k result) with its ranks from 1."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def rrf(lists: list[DataFrame], key: str = "id", k: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of bounded hit lists (key, score)."""
    out = None
    for hits in lists:
        one = ranked(hits, key).select(key, (F.lit(1.0) / (RRF_K + F.col("rank"))).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.round(F.sum("part") * RRF_SCALE, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float], k: int = 10, key: str = "doc_id") -> DataFrame:
    """Dense and BM25 lists of twice k, fused. Both tables name the same things by ``key``: the vectors are those of the documents."""
    dense = dense_topk(vectors, vector, 2 * k, key).select(F.col(key).alias("id"), "score")
    lexical = bm25_topk(docs, query, 2 * k, key).select(F.col(key).alias("id"), "score")
    return rrf([dense, lexical], "id", k)


def dedup_by_parent(hits: DataFrame, k: int | None = None, parent: str = "parent_id", order: tuple = ("score",), tie: str = "id") -> DataFrame:
    """The best hit of each parent, best first."""
    w = Window.partitionBy(parent).orderBy(*[F.desc(c) for c in order], tie)
    out = hits.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return out if k is None else out.orderBy(*[F.desc(c) for c in order], tie).limit(k)


def in_section(path: Column, section: str) -> Column:
    """Whether a path is the section's or below it; an empty section holds everything."""
    return F.lit(True) if section == "" else (path == section) | path.startswith(section + "/")


def section_match(sections: DataFrame, query: str, k: int = 5, title: str = "title", level: str = "level", key: str = "node_id") -> DataFrame:
    """Sections by twice the number of tokens that they share with the query, then by level and key."""
    shared = F.size(F.array_intersect(T.search_tokens(F.col(title)), T.search_tokens(F.lit(query))))
    return sections.withColumn("score", (2 * shared).cast("long")).where("score > 0").orderBy(F.desc("score"), level, key).limit(k)


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1, group: str = "doc_id", seq: str = "chunk_seq") -> DataFrame:
    """Chunks up to ``window`` away from a hit in its group, without the hits. An equi-join on the exploded positions, not a range join."""
    around = hits.select(group, F.explode(F.sequence(F.col(seq) - window, F.col(seq) + window)).alias(seq)).distinct()
    near = chunks.join(around, [group, seq], "left_semi")
    return near.join(hits.select(group, seq).distinct(), [group, seq], "left_anti")


def within_budget(hits: DataFrame, near: DataFrame, budget: int, group: str = "doc_id", seq: str = "chunk_seq", text: str = "text", window: int = 1) -> DataFrame:
    """Hits in order of rank, each followed by its neighbours that still fit the characters which all hits leave of the budget.

    Hits are a bounded list with ``rank``. The walk is one fold over the collected candidates, since what fits depends on what was taken.
    """
    used = hits.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("used"))  # one row
    a, b = hits.alias("a"), near.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & F.col(f"b.{seq}").between(F.col(f"a.{seq}") - window, F.col(f"a.{seq}") + window))
    first = pairs.select(F.col("a.rank").alias("rank"), F.col(f"b.{group}").alias(group), F.col(f"b.{seq}").alias(seq), F.length(f"b.{text}").alias("n")).groupBy(group, seq).agg(F.min("rank").alias("rank"), F.first("n").alias("n"))
    folded = first.agg(F.array_sort(F.collect_list(F.struct("rank", seq, group, "n"))).alias("all")).join(F.broadcast(used))
    start = F.struct((F.lit(budget) - F.col("used")).cast("long").alias("left"), F.array().cast(f"array<struct<rank:int,{seq}:bigint,{group}:bigint,n:int>>").alias("taken"))
    step = lambda acc, x: F.when(x["n"] <= acc["left"], F.struct((acc["left"] - x["n"]).cast("long").alias("left"), F.array_append(acc["taken"], x.cast(f"struct<rank:int,{seq}:bigint,{group}:bigint,n:int>")).alias("taken"))).otherwise(acc)
    return folded.select(F.explode(F.aggregate("all", start, step, lambda acc: acc["taken"])).alias("x")).select("x.*")


def with_parents(hits: DataFrame, parents: DataFrame, key: str = "parent_id") -> DataFrame:
    """Hits with their parents' text; hits without a parent stay."""
    return hits.join(parents, key, "left")


def ordered_union(tiers: list[DataFrame], key: str = "id", k: int = 10) -> DataFrame:
    """Rows of the tiers in order, each id once where it comes first, up to k."""
    out = None
    for i, t in enumerate(tiers):
        one = t.withColumn("tier", F.lit(i))
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy(key).orderBy("tier", F.desc("score"))
    return out.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").orderBy("tier", F.desc("score"), key).limit(k)


def overlap_score(query: Column, text: Column) -> Column:
    """The built-in scorer: the share of the query's tokens that the text has."""
    q = T.search_tokens(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.search_tokens(text))) / F.size(q)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, query: str, k: int | None = None, text: str = "text", scorer=overlap_score, key: str = "id") -> DataFrame:
    """Hits by a scorer (a function of two columns), best first."""
    out = hits.withColumn("rerank_score", F.round(scorer(F.lit(query), F.col(text)), 6)).orderBy(F.desc("rerank_score"), key)
    return out if k is None else out.limit(k)


def banded(score: Column, low: float, high: float) -> Column:
    """keep, ambiguous or prune."""
    return F.when(score >= high, "keep").when(score >= low, "ambiguous").otherwise("prune")


def grade(hits: DataFrame, threshold: float = 0.25) -> DataFrame:
    """One row: empty, sufficient or weak, by the best score."""
    return hits.agg(F.count("*").alias("hits"), F.max("score").alias("best")).select("hits", F.when(F.col("hits") == 0, "empty").when(F.col("best") >= threshold, "sufficient").otherwise("weak").alias("grade"))


def query_vector(spark: SparkSession, vectors: DataFrame, vec_id: int) -> list[float]:
    """The vector of one row, as a query."""
    row = vectors.where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row["embedding"]]
