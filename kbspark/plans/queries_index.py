"""Queries of stored indexes: each builds its index over the whole table in a new folder and asks many questions at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import block_index
from kbspark.operators.vector_index import PROBES, VectorIndex, recall
from kbspark.plans.book import Book
from kbspark.sources.shared import new_folder

Q = Book()
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def bm25_many(questions: str, docs: str, k: int, columns: str = "query_id, CAST(rank AS INTEGER) AS rank, key, score") -> str:
    """The best ``k`` of each question (query_id, text) by BM25 over all of ``docs`` (key, text)."""
    return f"""WITH q AS (SELECT DISTINCT query_id, unnest({_TOK}) AS term FROM ({questions})), d AS (SELECT key, {_TOK} AS t FROM ({docs})), a AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d),
p AS (SELECT key, len(t) AS n, unnest(t) AS term FROM d), tf AS (SELECT key, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, key, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term), a GROUP BY query_id, key),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank, key, score FROM s QUALIFY rank <= {k}) SELECT {columns} FROM r"""


def _blocks(t):
    path = new_folder(t.spark, "block-index")
    block_index.write(t.documents, path)
    return block_index.Reader(t.spark, path).search(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), 5)


Q.add("bm25_blocks", _blocks, bm25_many("SELECT item_id AS query_id, text FROM benchmark", "SELECT doc_id AS key, text FROM documents", 5))


def _lists(t):
    """The table in two batches: the second is put into the lists of the first."""
    index = VectorIndex(t.spark, new_folder(t.spark, "vector-index"))
    return index.build(t.embeddings.where("label % 2 = 0"), batch="even").insert(t.embeddings.where("label % 2 <> 0 or label is null"), batch="odd")


def _questions(t):
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _recall(t):
    index = _lists(t)
    return recall(index.search(_questions(t), 10, PROBES, exact=False), index.search(_questions(t), 10))


_D = "list_transform({}.embedding, lambda x: x::DOUBLE)"
Q.add("vector_lists", lambda t: _lists(t).search(_questions(t), 10).withColumnRenamed("id", "vec_id"),
      f"SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity({_D.format('e')}, {_D.format('q')}), 6) DESC, e.vec_id) AS INTEGER) AS rank, e.vec_id, round(list_cosine_similarity({_D.format('e')}, {_D.format('q')}), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 QUALIFY rank <= 10")
#: The share of the true ten that the nearest ten lists give; what they are depends on the fitted centres.
Q.add("vector_recall", _recall)
