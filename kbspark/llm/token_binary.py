"""Token-ID binary output: frequency-ranked ids in byte-aligned variable-length code, the control bytes kept apart from the data bytes.

File format. A file is one row of a Parquet table (so that Spark's committer makes writes atomic and a lost executor's task is written
anew) and holds a run of documents in ascending ``doc_id`` order: ``doc_ids`` (little-endian signed 64-bit), ``sizes`` (ids of each
document, unsigned 32-bit), ``control`` (two bits for each id, four to a byte from the low end: bytes of its rank's code less one) and
``data`` (the ranks, little end first, one to four bytes each). ``part``, ``number`` and ``before`` give the file's place: partition,
number in it and ids before it in the partition. The row of part -1 is the dictionary of all files: its ``ranks`` are the table's
distinct ids, most frequent in the whole table first and smaller id first on ties, unsigned 32-bit. Frequent ids have small ranks, so
most take one byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import cut, discard, lean, new_table, rows_to_batch, slices, tokenizer_of, utf8_column

FILE_SCHEMA = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("no_id", pa.binary()), ("sizes", pa.binary()), ("ranks", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])
FILE_DDL = "part int, number int, before long, n_ids long, doc_ids binary, no_id binary, sizes binary, ranks binary, control binary, data binary"
CODED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("width", pa.int8()), ("counts", pa.binary())])
CODED_DDL = "doc_id long, ids binary, width byte, counts binary"


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    n = len(ranks)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(n, 4)[keep].tobytes()


#: For each control byte the sizes of its four codes, looked up when decoding.
SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])[None, :]) & 3).astype(np.uint8) + 1


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Inverse of ``encode_ranks``: a table lookup gives the sizes, and a masked scatter puts the data bytes in place."""
    size = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8)[None, :] < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def by_frequency(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids, most frequent first and smaller id first on ties: an id's rank is its place."""
    return ids[np.lexsort((ids, -counts))].astype("<u4")


def rank_table(ranked: np.ndarray) -> np.ndarray:
    """Each id's rank, by id."""
    rank = np.zeros(int(ranked.max()) + 1 if len(ranked) else 0, np.uint32)
    rank[ranked] = np.arange(len(ranked))
    return rank


def encode_file(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranks, control, data) of ids that are ranked by themselves."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    seen = np.flatnonzero(counts)
    ranked = by_frequency(seen, counts[seen])
    return ranked.tobytes(), *encode_ranks(rank_table(ranked)[ids])


def decode_file(ranks: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ranks, "<u4")[decode_ranks(control, data, n)] if n else np.zeros(0, np.uint32)


def ascii_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, which this vocabulary's tokenizer drops."""
    return text.split()


def _coder(path: str, end: int, most_ids: int = 1 << 20):
    """Each text's ids in two bytes each, or four where one is larger, and at a task's end how often it saw each id."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer_of(path, ascii_words, lower=True)
        counts = np.zeros(1 << 16, np.int64)
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal counts
            seen = np.bincount(np.concatenate(held))
            if len(seen) > len(counts):
                counts = np.concatenate([counts, np.zeros(len(seen) - len(counts), np.int64)])
            counts[: len(seen)] += seen
            wide = [len(x) > 0 and int(x.max()) > 0xFFFF for x in held]
            rows = {"doc_id": docs, "ids": [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(held, wide)], "width": [4 if w else 2 for w in wide], "counts": [None] * len(docs)}
            return rows_to_batch(CODED_SCHEMA, rows)

        for batch in slices(batches, 500):
            for doc, text in zip(batch.column(0).to_pylist(), utf8_column(batch, "text")):
                docs.append(doc)
                held.append(coder.encode(text or b"", end))
                size += len(held[-1])
                if size >= most_ids:
                    yield flush()
                    docs, held, size = [], [], 0
        if held:
            yield flush()
        if counts.any():
            ids = np.flatnonzero(counts)
            yield rows_to_batch(CODED_SCHEMA, {"doc_id": [None], "ids": [None], "width": [None], "counts": [np.stack([ids, counts[ids]]).astype("<i8").tobytes()]})

    return code


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n) of each task's counts."""
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            ids, n = np.frombuffer(raw, "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])


def _writer(ranks, ids_per_file: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rank = TaskContext.get().partitionId(), ranks.value
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        state = {"number": 0, "before": 0, "n": 0}

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            control, data = encode_ranks(rank[ids])
            row = {"part": part, "number": state["number"], "before": state["before"], "n_ids": len(ids), "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(), "no_id": np.array([d is None for d in docs], np.uint8).tobytes(), "sizes": np.array([len(x) for x in held], "<u4").tobytes(), "ranks": b"", "control": control, "data": data}
            state.update(number=state["number"] + 1, before=state["before"] + len(ids), n=0)
            docs.clear()
            held.clear()
            return rows_to_batch(FILE_SCHEMA, {k: [v] for k, v in row.items()})

        for batch in batches:
            for doc, raw, width in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = np.frombuffer(raw, f"<u{width}")
                if held and state["n"] + len(ids) > ids_per_file:
                    yield flush()
                docs.append(doc)
                held.append(ids)
                state["n"] += len(ids)
        if held:
            yield flush()

    return write


def write_token_files(docs: DataFrame, tokenizer_path: str, end: int = 1, ids_per_file: int = 500_000) -> DataFrame:
    """Encode every whole text and write the files (see the module) to the shared folder; returns the written table.

    Null texts are empty; every document gets ``end`` as its last id, so none has no ids. Rows with a null ``doc_id`` come first; rows of
    one id are ordered by a hash of their ids, and equal rows are interchangeable. Other columns are ignored. A file holds at most
    ``ids_per_file`` ids or one document, so memory is bounded; rows are range-partitioned by ``doc_id``, that hash and their place in the
    table, so that no task grows with the corpus and no id, null and repeated ones included, is one task's. Texts are encoded once, and
    what is counted then ranks the ids of the whole table: the driver and each task hold one number for each id of the vocabulary. No
    table row, no file.
    """
    spark = docs.sparkSession
    path = new_table(spark, "coded")
    coded = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_coder(tokenizer_path, end), keep=450_000), CODED_DDL), "coded", path)
    counts = coded.where("counts is not null").select("counts").mapInArrow(lean(_counted), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ranked = by_frequency(counts["id"].to_numpy(), counts["n"].to_numpy())
    ranks = spark.sparkContext.broadcast(rank_table(ranked))
    rows = coded.where("ids is not null").select("doc_id", "ids", "width", F.xxhash64("ids").alias("key"), F.monotonically_increasing_id().alias("place"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), coded.rdd.getNumPartitions())
    dealt = rows.repartitionByRange(parts, "doc_id", "key", "place").sortWithinPartitions("doc_id", "key", "place").select("doc_id", "ids", "width")
    files = dealt.mapInArrow(lean(_writer(ranks, ids_per_file)), FILE_DDL)
    if len(ranked):
        row = {"part": -1, "number": 0, "before": 0, "n_ids": 0, "doc_ids": b"", "no_id": b"", "sizes": b"", "ranks": ranked.tobytes(), "control": b"", "data": b""}
        files = files.union(spark.createDataFrame(pa.Table.from_batches([rows_to_batch(FILE_SCHEMA, {k: [v] for k, v in row.items()})]), FILE_DDL))
    written = cut(files, "tokens")
    discard(spark, path)
    return written


def _reader(ranks):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = decode_file(ranks.value, row["control"], row["data"], row["n_ids"])
                sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                stop = np.cumsum(sizes)
                docs = np.frombuffer(row["doc_ids"], "<i8")
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(docs), row["part"], np.int32)),
                        pa.array(docs, pa.int64(), mask=np.frombuffer(row["no_id"], np.uint8).astype(bool)),
                        pa.array(row["before"] + stop - sizes),
                        pa.array(sizes),
                        pa.array([bytes(raw[4 * (b - n) : 4 * b]) for b, n in zip(stop.tolist(), sizes.tolist())], pa.binary()),
                    ],
                    names=["part", "doc_id", "local_start", "n_tokens", "ids"],
                )

    return read


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document of the files; ``ids`` are little-endian unsigned 32-bit, ``start`` counts the ids of all documents before it."""
    spark = files.sparkSession
    dictionary = files.where("part = -1").select("ranks").first()
    ranks = spark.sparkContext.broadcast(bytes(dictionary[0]) if dictionary else b"")
    files = files.where("part >= 0")
    base = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each partition written
    sums, total = {}, 0
    for row in base:
        sums[row["part"]] = total
        total += row["n"]
    starts = spark.createDataFrame(list(sums.items()), "part int, base long")
    found = files.mapInArrow(lean(_reader(ranks)), "part int, doc_id long, local_start long, n_tokens long, ids binary")
    return found.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def token_digests(files: DataFrame) -> DataFrame:
    """As ``read_token_files``, with the checksum of each document's ids in their place."""
    return read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
