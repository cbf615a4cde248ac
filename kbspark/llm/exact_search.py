"""Exact top-k search by inner products: blocks of an inverted index, gone through term by term for blocks of sparse queries.

Candidates are numbered into blocks of at most ``BLOCK_ROWS`` rows and ``BLOCK_ENTRIES`` entries. A block is one row that holds, for each component
("term"), the places and weights of the rows where it isn't zero. Queries are blocks of sparse rows. A task gets some blocks of each and, term by
term, scatters the weighted postings of the term into a dense array of scores, a line a query; a partition of each line finds its best
``k``, and the best of all tasks are merged. Every candidate is scored for every query: work is their product, and only blocks of bounded
size move. No group of rows meets but the ``k`` best of each task for one query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import cut, lean

#: Rows and non-zero components of a block; queries are scored so many at a time, so that their scores stay in a core's cache.
BLOCK_ROWS, BLOCK_ENTRIES, TILE = 2048, 1 << 20, 32
#: Rows and components that one task holds of the candidates, and of the queries.
CELL_ROWS, CELL_ENTRIES = 8192, 1 << 22

_BLOCK = "part int, block int, ids binary, starts binary, terms binary, places binary, weights binary"
_FOUND = "query_id long, block int, part int, place long, vec_id long, score long"


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as a long; null for a vector that is null or has null or non-finite components. What a long can't hold is clamped."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~odd, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _blocks(by_term: bool):
    """Arrow batches of (id, vector) to blocks of sparse rows, ordered by id: entries row by row, or term by term as postings."""

    def block(part: int, number: int, ids: list[np.ndarray], sizes: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        i, n, v = np.concatenate(ids), np.concatenate(sizes), np.concatenate(values)
        order = np.argsort(i, kind="stable")
        place_of = np.empty(len(i), np.int32)
        place_of[order] = np.arange(len(i), dtype=np.int32)
        starts = np.cumsum(n) - n
        term = (np.arange(len(v)) - np.repeat(starts, n)).astype(np.int32)
        place, keep = np.repeat(place_of, n), v != 0
        term, place, v = term[keep], place[keep], v[keep]
        major, minor = (term, place) if by_term else (place, term)
        at = np.lexsort((minor, major))
        firsts = np.flatnonzero(np.diff(major[at], prepend=-1)).astype(np.int64)
        row = [part, number, i[order].tobytes(), np.append(firsts, len(at)).astype(np.int64).tobytes(), term[at].tobytes(), place[at].tobytes(), v[at].astype(np.int64).tobytes()]
        names = ["part", "block", "ids", "starts", "terms", "places", "weights"]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if c in ("part", "block") else pa.binary()) for x, c in zip(row, names)], names=names)

    def run(batches):
        part = TaskContext.get().partitionId()
        number, ids, sizes, values, rows, entries = 0, [], [], [], 0, 0
        for batch in batches:
            own, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            at = 0
            while at < len(own):
                room = np.searchsorted(ends - (ends[at - 1] if at else 0), BLOCK_ENTRIES - entries, "right")  # a row of over BLOCK_ENTRIES is a block of its own
                to = min(len(own), at + BLOCK_ROWS - rows, max(int(room), at + (rows == 0)))
                if to > at:
                    a, b = (int(ends[at - 1]) if at else 0), int(ends[to - 1])
                    ids.append(own[at:to])
                    sizes.append(n[at:to])
                    values.append(flat[a:b])
                    rows, entries = rows + to - at, entries + b - a
                if rows and (to == at or rows == BLOCK_ROWS or entries >= BLOCK_ENTRIES):
                    yield block(part, number, ids, sizes, values)
                    number += 1
                    ids, sizes, values, rows, entries = [], [], [], 0, 0
                at = to
        if rows:
            yield block(part, number, ids, sizes, values)

    return run


def _arrays(table: pa.Table):
    kinds = {"ids": np.int64, "starts": np.int64, "terms": np.int32, "places": np.int32, "weights": np.int64}
    for row in table.select(["part", "block", *kinds]).to_pylist():
        yield (row["part"], row["block"]), *(np.frombuffer(row[c], t) for c, t in kinds.items())


def accumulate(queries: tuple, index: tuple, first: int, last: int) -> np.ndarray:
    """Scores of the queries ``first`` to ``last`` with every row of an index block. Sums that a long can't hold wrap around."""
    _, _, q_starts, q_terms, q_places, q_weights = queries
    _, ids, starts, terms, places, weights = index
    a, b = np.searchsorted(q_places, [first, last])
    q_terms, q_places, q_weights = q_terms[a:b], q_places[a:b] - first, q_weights[a:b]
    order = np.argsort(q_terms, kind="stable")
    bounds = np.flatnonzero(np.diff(q_terms[order], prepend=-1, append=-1)) if len(order) else []
    scores = np.zeros((len(ids), last - first), np.int64)  # a row's scores lie together, so that a posting moves whole lines
    posted = terms[starts[:-1]]  # the terms of the block, ascending
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        at = order[lo:hi]
        k = np.searchsorted(posted, q_terms[at[0]])
        if k == len(posted) or posted[k] != q_terms[at[0]]:
            continue
        asked = np.zeros(last - first, np.int64)
        asked[q_places[at]] = q_weights[at]
        p, add = places[starts[k] : starts[k + 1]], weights[starts[k] : starts[k + 1], None] * asked
        if len(p) == len(ids):  # a posting of every row: places are 0, 1, ...
            scores += add
        else:
            scores[p] += add
    return np.ascontiguousarray(scores.T)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """For each line the places of its ``k`` highest scores, ties to the smaller id; ids ascend, and a query's own id is left out."""
    for i, line in enumerate(scores):
        a, b = np.searchsorted(ids, own[i]), np.searchsorted(ids, own[i], "right")
        at = np.delete(np.arange(len(ids)), np.s_[a:b]) if b > a else None
        line = line if at is None else line[at]
        if len(line) > k:
            least = line[np.argpartition(line, len(line) - k)[len(line) - k :]].min()
            over = np.flatnonzero(line > least)
            took = np.concatenate([over, np.flatnonzero(line == least)[: k - len(over)]])
        else:
            took = np.arange(len(line))
        yield took if at is None else at[took]


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "block": [], "part": [], "place": [], "vec_id": [], "score": []}
        blocks = list(_arrays(right))
        for queries in _arrays(left):
            (part, number), own = queries[:2]
            for first in range(0, len(own), TILE):
                last = min(first + TILE, len(own))
                mine = own[first:last]
                held_ids, held_scores = [[] for _ in mine], [[] for _ in mine]
                for index in blocks:
                    scores = accumulate(queries, index, first, last)
                    for i, at in enumerate(best(scores, index[1], mine, k)):
                        held_ids[i].append(index[1][at])
                        held_scores[i].append(scores[i, at])
                for i, q in enumerate(mine):
                    ids, s = np.concatenate(held_ids[i]), np.concatenate(held_scores[i])
                    top = np.lexsort((ids, ~s))[:k]  # ~s falls as s rises, without the overflow of -s
                    for name, x in (("query_id", np.full(len(top), q)), ("block", np.full(len(top), number, np.int32)), ("part", np.full(len(top), part, np.int32)), ("place", np.full(len(top), first + i)), ("vec_id", ids[top]), ("score", s[top])):
                        out[name].append(x)
        kinds = {"part": pa.int32(), "block": pa.int32()}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], kinds.get(c, pa.int64())) for c, v in out.items()})

    return run


def _cells(rows: int, entries: int, wanted: int) -> int:
    """Over how many tasks to deal rows: enough for the bounds of a task, and for ``wanted`` tasks if there are rows for them."""
    return max(1, -(-rows // CELL_ROWS), -(-entries // CELL_ENTRIES), min(wanted, rows // 512))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the ``k`` rows with the highest inner products of ``whole_numbers``.

    Fewer where there are fewer others; ties go to the smaller key. Vectors that are null or hold null or non-finite components take no part, nor do
    rows without a key. Zero and empty vectors score 0 with everything; components that one of two vectors lacks count as 0. A row is no
    candidate for queries of its own key. Rows that repeat a key are candidates each (so an id can take several ranks) and, as queries,
    answered each. An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole_numbers(F.col(column), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null and v is not null")
    size = lambda w: F.coalesce(F.sum(F.when(w, F.size("v"))), F.lit(0))
    counts = rows.agg(F.count("*").alias("n"), size(F.lit(True)).alias("e"), F.count_if("asks").alias("q"), size(F.col("asks")).alias("f")).first()
    c, q = _cells(counts["n"], counts["e"], spark.sparkContext.defaultParallelism), _cells(counts["q"], counts["f"], 1)
    index = cut(rows.select("id", "v").repartition(c).mapInArrow(lean(_blocks(True)), _BLOCK), "index")
    asked = cut(rows.where("asks").select("id", "v").repartition(q).mapInArrow(lean(_blocks(False)), _BLOCK), "queries")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("cell", every(c)).withColumn("other", F.col("part"))
    right = index.withColumn("other", every(q)).withColumn("cell", F.col("part"))
    found = left.groupBy("cell", "other").cogroup(right.groupBy("cell", "other")).applyInArrow(_search(k), _FOUND)
    one = Window.partitionBy("query_id", "part", "block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(one)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
