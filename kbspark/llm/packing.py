"""Lexical retrieval packing: a sharded BM25 inverted index over the whole table gives each seed document its unused neighbours, which greedily fill its window."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import cut, discard, lean, new_table, rows_to_batch, slices, tokenizer_of, utf8_column

PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECE_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
CODED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("terms", pa.binary()), ("tf", pa.binary())])
INDEX_SCHEMA = pa.schema([("group", pa.int64()), ("mass", pa.int64()), ("numbers", pa.binary()), ("names", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()), ("weights", pa.binary())])
INDEX_DDL = "group long, mass long, numbers binary, names binary, counts binary, docs binary, weights binary"
CODED_DDL = "doc_id long, n long, ids binary, terms binary, tf binary"
#: Where a row was read: its file, where the part of it that one task reads begins, and the row's number in its partition (which holds the partition's, too).
PLACE_DDL = "file string, block long, row long"

#: Documents of a shard of the index: few enough for near bounds, and enough for matrix products.
SHARD_DOCS = 512
#: Documents that one task searches, about: the more, the sooner its lists rule out the rest.
TASK_DOCS = 16_384

_PIECES = re.compile(rb" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
#: Where white space runs on, the pattern above has to look ahead.
_SPACE_RUN = re.compile(rb"[ \n][ \n]")
#: White space other than spaces and newlines, in ASCII and (by the bytes it begins with) in UTF-8.
_ODD_ASCII = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_ODD_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80")
_ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def spaced_pieces(text: bytes) -> list[bytes] | None:
    """A byte-level vocabulary's words with the space before them, and runs of spaces and newlines; None if the text has other white space."""
    if len(text.translate(None, _ODD_ASCII)) != len(text) or any(x in text for x in _ODD_LEADS) and _ODD_SPACE.search(text):
        return None
    if b"\0" in text or _SPACE_RUN.search(text):
        return _PIECES.findall(text)
    return [x for x in text.replace(b"\n", b"\0\n\0").replace(b" ", b"\0 ").split(b"\0") if x]


class ShardIndex:
    """BM25 inverted index over the token ids of a shard's documents, as arrays: for each term its documents and their weights.

    A document's own tokens are the query for its neighbours. ``k1`` and ``b`` are BM25's parameters. Terms of any
    frequency are followed: copies that are a large part of a shard have no others.
    """

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        n = len(docs)
        terms, tfs, owners = [], [], []
        for i, ids in enumerate(docs):
            t, c = np.unique(ids, return_counts=True)
            terms.append(t)
            tfs.append(c)
            owners.append(np.full(len(t), i, np.int32))
        self.own = terms
        term, tf, owner = (np.concatenate(x) for x in (terms, tfs, owners))
        size = np.array([len(x) for x in docs], np.float64)
        norm = k1 * (1 - b + b * size / size.mean())
        order = np.argsort(term, kind="stable")
        term, tf, self.doc = term[order], tf[order], owner[order]
        df = np.bincount(term)
        self.first = np.concatenate([[0], np.cumsum(df)])
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.weight = (idf[term] * tf * (k1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """Every document's BM25 score for the terms of the seed; those that were dropped have none."""
        own = self.own[seed]
        spans = [slice(a, b) for a, b in zip(self.first[own].tolist(), self.first[own + 1].tolist()) if b > a]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.doc[x] for x in spans]), np.concatenate([self.weight[x] for x in spans]), self.n)

    def keep(self, wanted: np.ndarray) -> None:
        """Drop the postings of documents that aren't ``wanted`` any more; the weights of the others stay as they are."""
        held = wanted[self.doc]
        self.first = np.concatenate([[0], np.cumsum(held)])[self.first]
        self.doc, self.weight = self.doc[held], self.weight[held]


def falling(score: np.ndarray, block: int = 64) -> Iterator[int]:
    """The places of all scores over 0, by falling score and then place; sorted block by block, as far as they're asked for."""
    left = np.flatnonzero(score > 0)
    while len(left):
        least = np.partition(score[left], len(left) - block)[len(left) - block] if len(left) > block else 0
        near = left[score[left] >= least]
        yield from near[np.argsort(-score[near], kind="stable")].tolist()
        left = left[score[left] < least]
        block *= 4


def pack_shard(docs: list[np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of the shard once.

    Documents give their full windows by themselves. What is left of each is a rest shorter than a window: the longest unused rest is
    the seed, its unused neighbours follow by falling BM25 score (then position) whole while they fit, and the next one is cut to fill
    the window, its own rest staying for later. Where no neighbour shares a term, the next unused rest in order follows. At the shard's
    end one window may stay short; it is written as sequences whose lengths are powers of two, so that none needs padding.
    """
    out: list[list[tuple[int, int, int]]] = []
    begin = np.zeros(len(docs), np.int64)
    size = np.array([len(x) for x in docs], np.int64)
    for i, n in enumerate(size.tolist()):
        while n - begin[i] >= window:
            out.append([(i, int(begin[i]), window)])
            begin[i] += window
    rest = size - begin
    if not rest.any():
        return out
    index = ShardIndex(docs)
    held = len(docs)
    seeds = np.argsort(-rest, kind="stable").tolist()
    next_unused = 0
    for seed in seeds:
        if not rest[seed]:
            continue
        row = [(seed, int(begin[seed]), int(rest[seed]))]
        room = window - int(rest[seed])
        rest[seed] = 0
        if room:
            unused = rest > 0
            if 5 * np.count_nonzero(unused) < 4 * held:
                index.keep(unused)
                held = np.count_nonzero(unused)
            score = index.scores(seed)
            score[rest == 0] = 0
            for i in falling(score):
                take = min(room, int(rest[i]))
                row.append((i, int(begin[i]), take))
                begin[i] += take
                rest[i] -= take
                room -= take
                if not room:
                    break
            while room and next_unused < len(seeds):
                i = seeds[len(seeds) - 1 - next_unused]  # the shortest rests first: they're hardest to place
                if not rest[i]:
                    next_unused += 1
                    continue
                take = min(room, int(rest[i]))
                row.append((i, int(begin[i]), take))
                begin[i] += take
                rest[i] -= take
                room -= take
        if room:
            out += _powers_of_two(row)
        else:
            out.append(row)
    return out


def _powers_of_two(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of a short window as sequences whose lengths are falling powers of two."""
    total, out = sum(n for _, _, n in row), []
    left = [list(x) for x in row]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        made: list[tuple[int, int, int]] = []
        while room:
            i, start, n = left[0]
            take = min(room, n)
            made.append((i, start, take))
            left[0] = [i, start + take, n - take]
            if take == n:
                left.pop(0)
            room -= take
        out.append(made)
    return out


def _coder(path: str, end: int):
    """Each text's ids, its distinct terms and how often each of them occurs; other columns go along."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer_of(path, spaced_pieces, lower=False)
        for batch in slices(batches, 500):
            rows = {f.name: [] for f in CODED_SCHEMA}
            for doc, text in zip(batch.column(0).to_pylist(), utf8_column(batch, "text")):
                ids = coder.encode(text or b"", end)
                terms, tf = np.unique(ids, return_counts=True)
                for k, v in zip(rows, (doc, len(ids), ids.tobytes(), terms.tobytes(), tf.astype(np.uint32).tobytes())):
                    rows[k].append(v)
            if rows["n"]:
                made = rows_to_batch(CODED_SCHEMA, rows)
                yield pa.RecordBatch.from_arrays([*made.columns, *batch.columns[2:]], names=[*made.schema.names, *batch.schema.names[2:]])

    return code


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each term, in one partition."""
    df = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for terms in batch.column(0).to_pylist():
            t = np.frombuffer(terms, np.uint32)
            if len(t) and t[-1] >= len(df):
                df = np.concatenate([df, np.zeros(int(t[-1]) + 1, np.int64)])
            df[t] += 1
    t = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(df[t])], names=["term", "n"])


def _full_windows(window: int):
    """Every window that a document fills by itself; where rows have a position, their sequences are numbered by it (see ``_positions``)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in slices(batches, 200):
            rows = {f.name: [] for f in PIECE_SCHEMA}
            positions = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            for doc, n, ids, position in zip(*(batch.column(i).to_pylist() for i in range(3)), positions):
                for start in range(0, n - window + 1, window):
                    number = part << 40 | made if position is None else position << 31 | start
                    for k, v in zip(rows, (doc, start, window, ids[4 * start : 4 * (start + window)], n, number, 0)):
                        rows[k].append(v)
                    made += 1
            yield rows_to_batch(PIECE_SCHEMA, rows)

    return emit


def _positions(coded: DataFrame) -> DataFrame:
    """``position`` in place of where a row was read: its number from 0 on, over the files in the order in which they were written, and within each."""
    rows = coded.withColumn("part", F.shiftright("row", 33))
    # a row for each task and file that it reads; a writer's files have its tasks' numbers in their names
    runs = rows.groupBy("file", "block", "part").agg(F.min("row"), F.count("*")).collect()
    runs.sort(key=lambda r: (len(r[0]), *r[:3]))
    before = np.concatenate([[0], np.cumsum([r[4] for r in runs])]).tolist()
    starts = coded.sparkSession.createDataFrame([(*r[:3], b - r[3]) for r, b in zip(runs, before)], "file string, block long, part long, shift long")
    return rows.join(F.broadcast(starts), ["file", "block", "part"]).withColumn("position", F.col("row") + F.col("shift")).drop("file", "block", "part", "row", "shift")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its partition and its place there."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "part", "place"])
        at += n


def centres(rows: list[np.ndarray], idf: np.ndarray, often: np.ndarray, most: int = 8, rounds: int = 8) -> np.ndarray:
    """Weights by term of at most ``most`` groups of alike documents, by k-means over those of ``rows`` (their terms) and the terms ``often``.

    They only decide which documents share a shard of the index; results don't depend on them.
    """
    spot = np.full(len(idf), -1)
    spot[often] = np.arange(len(often))
    x = np.zeros((len(rows), len(often)), np.float32)
    for i, t in enumerate(rows):
        at = spot[t]
        x[i, at[at >= 0]] = idf[t[at >= 0]]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    c = x[np.linspace(0, len(rows) - 1, min(most, len(rows))).astype(int)]
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(1)
        for k in np.unique(nearest):
            c[k] = x[nearest == k].mean(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    out = np.zeros((len(idf), len(c)), np.float32)
    out[often] = c.T * idf[often, None]
    return out


def _shard(group: int, numbers: np.ndarray, terms: np.ndarray, docs: np.ndarray, weights: np.ndarray) -> tuple:
    """A row of the index: postings of documents of one group by term, and the largest sum of a document's weights."""
    order = np.argsort(terms, kind="stable")
    names, counts = np.unique(terms, return_counts=True)
    mass = int(np.bincount(docs, weights).max())
    return group, mass, numbers.tobytes(), names.astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes(), docs[order].astype(np.uint16).tobytes(), weights[order].astype(np.int32).tobytes()


def _shard_rows(rows: list[tuple]) -> pa.RecordBatch:
    return rows_to_batch(INDEX_SCHEMA, {f.name: [r[i] for r in rows] for i, f in enumerate(INDEX_SCHEMA)})


def _indexer(stats, shard_ids: int, shard_docs: int, k1: float = 1.2, b: float = 0.75):
    """Shards of the BM25 index with the counts of the whole table; weights are whole multiples of 2^-16, so that their sums are the same in any order.

    Of at most ``shard_ids`` postings at a time, documents of a group and of like sums of weights share a shard, so that bounds of a shard are near its scores.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean, middle = stats.value
        held: list[tuple] = []
        total = 0

        def pool() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(x[1]) for x in held])
            terms, tf = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            doc = np.repeat(np.arange(len(held)), sizes)
            norm = k1 * (1 - b + b * np.array([x[3] for x in held]) / mean)
            weights = np.rint(65536 * idf[terms] * tf * (k1 + 1) / (tf + norm[doc])).astype(np.int32)
            group, numbers = np.array([x[4] for x in held]), np.array([x[0] for x in held], np.int64)
            order = np.lexsort((numbers, -np.bincount(doc, weights), group))
            edges = [0, *(np.flatnonzero(np.diff(group[order])) + 1).tolist(), len(order)]
            first = np.concatenate([[0], np.cumsum(sizes)])
            for lo, hi in zip(edges, edges[1:]):
                for i in range(lo, hi, shard_docs):
                    part = order[i : min(i + shard_docs, hi)]
                    at = np.concatenate([np.arange(first[d], first[d + 1]) for d in part])
                    yield _shard_rows([_shard(int(group[part[0]]), numbers[part], terms[at], np.repeat(np.arange(len(part)), sizes[part]), weights[at])])

        for batch in slices(batches, 500):
            numbers, terms, tf, n = (batch.column(i).to_pylist() for i in range(4))
            terms = [np.frombuffer(t, np.uint32) for t in terms]
            if not terms:
                continue
            starts = np.concatenate([[0], np.cumsum([len(t) for t in terms])[:-1]])
            groups = np.add.reduceat(middle[np.concatenate(terms)], starts).argmax(1).tolist()
            for number, t, f, size, group in zip(numbers, terms, tf, n, groups):
                if held and total + len(t) > shard_ids:
                    yield from pool()
                    held, total = [], 0
                held.append((number, t, np.frombuffer(f, np.uint32), size, group))
                total += len(t)
        if held:
            yield from pool()

    return emit


def _unused(row: tuple, used: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(numbers, names, counts, docs, weights) of a shard's unused documents, if there are any."""
    numbers, names, counts, docs, weights = (np.frombuffer(x, t) for x, t in zip(row[2:], (np.int64, np.uint32, np.uint32, np.uint16, np.int32)))
    free = (used[numbers >> 3] >> (numbers & 7) & 1) == 0
    if not free.any():
        return None
    if not free.all():
        held = free[docs]
        ends = np.cumsum(counts, dtype=np.int64)
        counts = np.diff(np.concatenate([[0], np.cumsum(held)[ends - 1]]))
        names, counts = names[counts > 0], counts[counts > 0]
        docs, weights, numbers = (np.cumsum(free) - 1)[docs[held]], weights[held], numbers[free]
    return numbers, names, counts.astype(np.int64), docs.astype(np.int64), weights


def _compact(used, shard_docs: int):
    """The index without the documents used up: what is left of shards of one group is joined to shards of about ``shard_docs`` documents."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: (r[0], -r[1], r[2]))
            for i, row in enumerate(rows):
                if (left := _unused(row, used.value)) is not None:
                    held.append(left)
                if held and (i + 1 == len(rows) or rows[i + 1][0] != row[0] or sum(len(x[0]) for x in held) + len(rows[i + 1][2]) // 8 > 2 * shard_docs):
                    shift = np.cumsum([0, *(len(x[0]) for x in held)])
                    docs = np.concatenate([x[3] + s for x, s in zip(held, shift)])
                    yield _shard_rows([_shard(row[0], np.concatenate([x[0] for x in held]), np.concatenate([np.repeat(x[1], x[2]) for x in held]), docs, np.concatenate([x[4] for x in held]))])
                    held = []

    return emit


class Questions:
    """A block of queries (each a document's distinct terms) and the best ``most`` documents found for each so far, by falling score, then number.

    A shard is first bounded: a query's score is at most the sum of its terms' largest weights in the shard, and at most the largest sum of a document's
    weights. Queries whose list is full and ends above that bound can't gain there; only the others are scored. ``scored`` counts pairs of query and document.
    """

    def __init__(self, queries: list[np.ndarray], most: int):
        self.n, self.most = len(queries), most
        terms = np.concatenate(queries).astype(np.int64)
        rows = np.repeat(np.arange(self.n), [len(q) for q in queries])
        order = np.argsort(terms, kind="stable")
        self.row = rows[order]
        self.names, counts = np.unique(terms, return_counts=True)
        self.term = np.repeat(np.arange(len(self.names)), counts)
        self.asks = np.zeros((len(self.names), self.n), np.uint8)
        self.asks[self.term, self.row] = 1
        self.number = np.full((self.n, most), -1, np.int64)
        self.score = np.zeros((self.n, most))
        self.least = np.ones(self.n)
        self.scored = 0

    def search(self, numbers: np.ndarray, names: np.ndarray, counts: np.ndarray, docs: np.ndarray, weights: np.ndarray) -> None:
        """Take what a shard's documents add to the lists; ``docs`` and ``weights`` are the postings, ``counts`` of them for each of ``names``."""
        n = len(numbers)
        first = np.cumsum(counts) - counts
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        known = self.names[at] == names
        largest = np.zeros(len(self.names))
        largest[at[known]] = np.maximum.reduceat(weights, first)[known]
        bound = np.minimum(np.bincount(self.row, largest[self.term], self.n), np.bincount(docs, weights, n).max())
        able = np.flatnonzero(bound >= self.least)
        if not len(able):
            return
        often = known & (counts > max(16, n // 16))
        seldom = known & ~often
        spot = np.full(len(names), -1)
        spot[often] = np.arange(np.count_nonzero(often))
        spot = np.repeat(spot, counts)
        dense = np.zeros((np.count_nonzero(often), n), np.float32)
        dense[spot[spot >= 0], docs[spot >= 0]] = weights[spot >= 0]
        # so many parts that a document's weights in each are whole numbers below 2^24, whose sums single precision holds exactly
        parts = 1 + int(dense.sum(0, dtype=np.float64).max(initial=0)) // (1 << 24)
        while any(dense[k::parts].sum(0, dtype=np.float64).max(initial=0) >= 1 << 24 for k in range(parts)):
            parts += 1
        rare = np.zeros((2, len(self.names)), np.int64)
        rare[:, at[seldom]] = first[seldom], counts[seldom]
        asked = np.flatnonzero(rare[1][self.term] > 0)
        place = np.full(self.n, -1)
        step = max(64, 65536 // self.most)
        for i in range(0, len(able), step):
            part = able[i : i + step]
            self.scored += len(part) * n
            place[:] = -1
            place[part] = np.arange(len(part))
            asks = self.asks[at[often]][:, part].astype(np.float32)
            got = np.zeros((len(part), n))
            for k in range(parts):
                got += asks[k::parts].T @ dense[k::parts]
            at_row, term = place[self.row[asked]], self.term[asked]
            at_row, term = at_row[at_row >= 0], term[at_row >= 0]
            length = rare[1][term]
            if len(term):
                stop = np.cumsum(length)
                posting = np.arange(stop[-1]) + np.repeat(rare[0][term] - stop + length, length)
                got += np.bincount(np.repeat(at_row * n, length) + docs[posting], weights[posting], len(part) * n).reshape(len(part), n)
            self._take(part, got, numbers)

    def _take(self, part: np.ndarray, got: np.ndarray, numbers: np.ndarray) -> None:
        least = self.least[part]
        if got.shape[1] > self.most and (new := np.flatnonzero(least <= 1)).size:
            k = got.shape[1] - self.most
            least[new] = np.maximum(1, np.partition(got[new], k, axis=1)[:, k])
        row, doc = np.nonzero(got >= least[:, None])
        if not len(row):
            return
        who = np.unique(row)
        held = part[who]
        owner = np.concatenate([np.repeat(np.arange(len(who)), self.most), np.searchsorted(who, row)])
        number = np.concatenate([self.number[held].ravel(), numbers[doc]])
        score = np.concatenate([self.score[held].ravel(), got[row, doc]])
        order = np.lexsort((number, -score, owner))
        best = order[np.searchsorted(owner[order], np.arange(len(who)))[:, None] + np.arange(self.most)]
        self.number[held], self.score[held] = number[best], score[best]
        self.least[held] = np.maximum(1, self.score[held, -1])


def _search(asked):
    """The best ``most`` unused documents of a task's shards for each query: (query, number, score). Shards that may hold the highest scores come first."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, used, most = asked.value
        lists = Questions(queries, most)
        for batch in batches:
            for i in np.argsort(-batch.column(1).to_numpy(), kind="stable").tolist():
                if batch.column(1)[i].as_py() < lists.least.min():
                    break
                if (left := _unused(tuple(c[i].as_buffer() if k > 1 else None for k, c in enumerate(batch.columns)), used)) is not None:
                    lists.search(*left)
        for i in range(0, lists.n, 256):
            query, k = np.nonzero(lists.score[i : i + 256] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(query + i), pa.array(lists.number[query + i, k]), pa.array(lists.score[query + i, k])], names=["query", "number", "score"])

    return emit


def _assign(spark, index: DataFrame, terms: DataFrame, parts: list[int], before: list[int], rest: np.ndarray, window: int, block: int, emit) -> None:
    """Windows of all rests, over the whole index. Documents are numbered by falling rest; ``emit`` gets each window's (number, skipped, taken).

    ``before`` holds the first number of each of the ``parts`` of ``terms``: a block's seeds lie in a few of them, and only their files are read.

    Seeds are asked in blocks, the longest unused rests first, and each takes what of its list is still unused. A seed whose list was
    cut off before its window is full goes first in the next block, where it's asked again for what is unused then.
    """
    whole = rest.copy()
    waiting: list[tuple[int, list, int]] = []
    next_seed, last = 0, len(rest) - 1
    most = int(min(4096, max(32, 4 * window / rest.mean())))
    held_by_index, path = len(rest), None

    def take(row: list, i: int, room: int) -> int:
        n = min(room, int(rest[i]))
        row.append((i, int(whole[i] - rest[i]), n))
        rest[i] -= n
        return room - n

    while True:
        seeds, waiting = [(s, row, room) for s, row, room in waiting], []
        begun = {s for s, _, _ in seeds}
        while next_seed < len(rest) and len(seeds) < block:
            if rest[next_seed]:
                seeds.append((next_seed, [], window))
            next_seed += 1
        if not seeds:
            return
        unused = np.count_nonzero(rest)
        if 2 * unused < held_by_index and unused > 4 * block:  # else shards of few documents cost as much as full ones
            used, old = spark.sparkContext.broadcast(np.packbits(rest == 0, bitorder="little")), path
            index = cut(index.mapInArrow(lean(_compact(used, SHARD_DOCS)), INDEX_DDL), "index", path := new_table(spark, "index"))
            used.unpersist()
            held_by_index = unused
            if old:
                discard(spark, old)
        wanted = [s for s, _, _ in seeds]
        held = [parts[i] for i in np.unique(np.searchsorted(before, wanted, side="right") - 1)]
        got = terms.where(F.col("part").isin(held) & F.col("number").isin(wanted)).toArrow()
        of = dict(zip(got["number"].to_pylist(), got["terms"].to_pylist()))
        asked = spark.sparkContext.broadcast(([np.frombuffer(of[s], np.uint32) for s in wanted], np.packbits(rest == 0, bitorder="little"), most + 1))
        found = index.mapInArrow(lean(_search(asked)), "query long, number long, score double").toArrow()
        asked.unpersist()
        query, number, score = (found[k].to_numpy() for k in ("query", "number", "score"))
        order = np.lexsort((number, -score, query))
        query, number = query[order], number[order]
        starts = np.searchsorted(query, np.arange(len(seeds) + 1))
        for q, (seed, row, room) in enumerate(seeds):
            if seed not in begun:
                if not rest[seed]:
                    continue
                room = take(row, seed, room)
            listed = number[starts[q] : starts[q + 1]]
            for i in listed[: most + 1].tolist():
                if not room:
                    break
                if rest[i]:
                    room = take(row, i, room)
            if room and len(listed) > most:  # there's more than the list holds
                waiting.append((seed, row, room))
                continue
            while room and last >= 0:  # none of the unused shares a term: the shortest rests first, they're hardest to place
                if rest[last]:
                    room = take(row, last, room)
                else:
                    last -= 1
            for made in [row] if not room else _powers_of_two(row):
                emit(made)
        if 2 * len(waiting) > len(seeds):
            most, block = min(4096, 2 * most), max(64, block // 2)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end: int = 0, shard_ids: int = 3_000_000, shard_docs: int = SHARD_DOCS, block: int = 1024, ordered: bool = False) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): pieces of all documents in sequences of ``window`` ids.

    Documents give their full windows by themselves. What is left of each is a rest: the longest unused rest is the seed, its best unused
    neighbours in the whole table follow whole while they fit, and the next one is cut to fill the window (see ``pack_shard``, which does
    the same within one list). Document counts and the mean length are those of the whole table, and each seed asks all shards of
    ``shard_docs`` documents and ``shard_ids`` ids (or one longer document), so results don't depend on how the table is split. Work grows with the square of the table. The driver
    holds two numbers for each rest and one block's lists.

    Null texts are empty and give only ``end``; null and repeated ids are kept as they are, each row packed for itself; other columns
    are ignored. ``sequence_id`` is unique: the partition and a number in it for full windows, from 2^62 on for the others. An empty table gives no rows.

    ``ordered``: the sequences follow the order of the rows, over files in the order in which Spark wrote them and within each (of other tables, over
    partitions). A sequence comes where its first piece does, in a full window or as a seed: ``sequence_id`` is the document's number in that order (below
    2^32) times 2^31, plus the piece's start. Which pieces make a sequence doesn't depend on it.
    """
    spark = docs.sparkSession
    places = [F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("row")] if ordered else []
    ddl = f"{CODED_DDL}, {PLACE_DDL}" if ordered else CODED_DDL
    coded = cut(docs.select("doc_id", "text", *places).mapInArrow(lean(_coder(tokenizer_path, end), keep=450_000), ddl), "coded")
    counted = coded.select("terms").mapInArrow(lean(_counts), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each id of the vocabulary
    total, mean = coded.agg(F.count("*"), F.avg("n")).first()
    position = ["position"] if ordered else []
    if ordered:
        coded = _positions(coded)
    full = coded.where(F.col("n") >= window).select("doc_id", "n", "ids", *position).mapInArrow(lean(_full_windows(window)), PIECE_DDL)
    if not total:
        return full
    df = np.zeros(max(counted["term"].to_pylist()) + 1)
    df[counted["term"].to_numpy()] = counted["n"].to_numpy()
    idf = np.log1p((total - df + 0.5) / (df + 0.5))
    some = coded.select("terms").sample(min(1.0, 1000 / total), seed=7).limit(2000).toArrow()["terms"].to_pylist() or [b"\0\0\0\0"]
    middle = centres([np.frombuffer(t, np.uint32) for t in some], idf, np.argsort(-df, kind="stable")[:4096])
    stats = spark.sparkContext.broadcast((idf, mean, middle))

    rests = coded.withColumns({"rest": F.col("n") % window, "key": F.xxhash64("doc_id", "ids")}).where("rest > 0")
    rests = rests.withColumn("ids", F.expr("substring(ids, cast(4 * (n - rest) + 1 as int), cast(4 * rest as int))"))
    parts = max(1, rests.rdd.getNumPartitions())
    ranged = rests.repartitionByRange(parts, F.desc("rest"), "key").sortWithinPartitions(F.desc("rest"), "key").drop("key")
    placed = cut(ranged.mapInArrow(lean(_placed), ", ".join([CODED_DDL, *(f"{p} long" for p in [*position, "rest", "part", "place"])])), "rests")
    # a row for each task and for each length below a window
    sizes = sorted(map(tuple, placed.groupBy("part").count().collect()))
    lengths = sorted(map(tuple, placed.groupBy("rest").count().collect()), reverse=True)
    if not sizes:
        return full
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])[:-1]]).tolist()
    starts = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before)], "part long, before long")
    numbered = placed.join(F.broadcast(starts), "part").withColumn("number", F.col("before") + F.col("place")).drop("before", "place")
    cores = spark.sparkContext.defaultParallelism
    n_rests = sum(n for _, n in sizes)
    tasks = min(cores * -(-n_rests // (cores * TASK_DOCS)), -(-n_rests // (TASK_DOCS // 2)))
    index = cut(numbered.select("number", "terms", "tf", "n").mapInArrow(lean(_indexer(stats, shard_ids, min(shard_docs, 1 << 15))), INDEX_DDL).repartition(tasks), "index")
    rest = np.repeat(np.array([r for r, _ in lengths], np.int32), [n for _, n in lengths])

    path = new_table(spark, "windows")
    made: list[tuple[int, int, int, int, int]] = []
    count = 0
    ddl = "number long, skip long, length long, sequence_id long, offset long"

    def write() -> None:
        table = pa.table([pa.array([x[i] for x in made], pa.int64()) for i in range(5)], names=["number", "skip", "length", "sequence_id", "offset"])
        spark.createDataFrame(table, ddl).write.mode("append").parquet(path)
        made.clear()

    def emit(row: list[tuple[int, int, int]]) -> None:
        nonlocal count
        offset = 0
        for number, skip, n in row:
            made.append((number, skip, n, 1 << 62 | count, offset))
            offset += n
        count += 1
        if len(made) >= 500_000:
            write()

    _assign(spark, index, numbered.select("part", "number", "terms"), [p for p, _ in sizes], before, rest, window, block, emit)
    write()
    windows = spark.read.schema(ddl).parquet(path)
    begin = F.col("n") - F.col("rest") + F.col("skip")
    if ordered:
        first = windows.where("offset = 0").join(numbered.select("number", "position", "n", "rest"), "number")
        first = first.select("sequence_id", F.shiftleft("position", 31).bitwiseOR(begin).alias("place"))
        windows = windows.join(first, "sequence_id").withColumn("sequence_id", F.col("place")).drop("place")
    joined = windows.join(numbered.select("number", "doc_id", "n", "ids", "rest"), "number").withColumn("start", begin)
    ids = F.expr("substring(ids, cast(4 * skip + 1 as int), cast(4 * length as int))")
    return full.union(joined.select("doc_id", "start", "length", ids.alias("ids"), F.col("n").alias("doc_tokens"), "sequence_id", "offset"))
