"""Shared helpers of the training-data operators: shared storage, lineage cuts, graph components and word-cached tokenizing."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, newline, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a local session (as in tests) gets a temporary one; a cluster must name one."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("kbspark.shared.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="kbspark-shared-")
        spark.conf.set("kbspark.shared.dir", got)
    return got.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def new_table(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, which is deleted when its ``scratch`` block or else the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, target = _hadoop(spark, path)
    files.deleteOnExit(target)
    for held in _SCRATCH[-1:]:
        held.append(path)
    return path


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are cut inside the block are deleted at its end: whatever is made of them must be written outside of it by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    files, target = _hadoop(spark, path)
    files.delete(target, True)


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder (see ``new_table``) and read it again: lineage ends there and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = path or new_table(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(keep: int = 0) -> None:
    """Give what a worker process no longer needs back to the system: Spark keeps idle workers, of which an executor may have several."""
    if PieceTable._active is not None and len(PieceTable._active.words) > keep:
        PieceTable._active._reset()
        PieceTable._active = None
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(function, keep: int = 0):
    """``function`` of Arrow batches, with its memory released when a task ends; a table of at most ``keep`` pieces stays for the worker's next task."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release(keep)

    return run


def rows_to_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def slices(batches, rows: int = 1000):
    """Arrow batches of at most ``rows`` rows, so that what a function holds for a batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def utf8_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The strings of a column as their UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


# --- connected components -------------------------------------------------------------------------------------------------------


def _local_forest(batches):
    """Union-find over the edges of one partition; of each tree it emits (node, smallest node), so at most one edge per node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                lo, hi = (ra, rb) if ra < rb else (rb, ra)
                parent[hi] = lo
                parent.setdefault(lo, lo)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 65536):
        part = nodes[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["v", "m"])


#: Edges that one task joins in memory.
FOREST_EDGES = 400_000


def hot_keys(df: DataFrame, keys: list[str], most: int = 1000, least: int = 20_000) -> DataFrame:
    """The keys that hold over a ``most``-th part of all rows (and over ``least``): fewer than ``most`` rows, whatever the table."""
    limit = max(least, -(-df.count() // most))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(*keys)


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "left", parts: int = 64, hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key. Rows of a hot key are dealt over ``parts`` tasks by a hash of the ``spread``
    columns, as are rows with a null key, which meet nothing; of ``right`` only the rows of hot keys are repeated."""
    hot = F.broadcast((hot_keys(left, keys) if hot is None else hot).withColumn("__hot", F.lit(True)))
    dealt = F.pmod(F.xxhash64(*spread), F.lit(parts))
    lost = F.lit(False)
    for k in keys:
        lost = lost | F.col(k).isNull()
    one = left.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__hot") | lost, dealt).otherwise(0).cast("long")).drop("__hot")
    many = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    other = right.join(hot, keys, "left").withColumn("__salt", F.explode(many)).drop("__hot")
    return one.join(other, [*keys, "__salt"], how).drop("__salt")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, forests: bool = False) -> DataFrame:
    """(id, component): for every node of an undirected edge, the smallest id it reaches. Nodes without an edge aren't returned.

    Each partition reduces its edges to a forest (``forests``: they are that already). What remains is joined by one task where it has at
    most ``FOREST_EDGES`` edges, which settles it; else by tasks of that many, whose forests alternating large-star and small-star rounds
    flatten, each a written table. Work per round follows the remaining edges, and the number of rounds the logarithm of the nodes;
    a hub's rows are dealt over many tasks. Null ends and self-loops are ignored; repeated edges count once.
    """
    e = edges.select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("m")).where("v is not null and m is not null and v <> m")
    e = cut(e if forests else e.mapInArrow(lean(_local_forest), "v long, m long"), "forest")
    count = e.count()
    if count <= FOREST_EDGES:
        e = cut(e.coalesce(1).mapInArrow(lean(_local_forest), "v long, m long"), "stars")
        rounds = 0
    else:
        e = cut(e.repartition(-(-count // FOREST_EDGES)).mapInArrow(lean(_local_forest), "v long, m long"), "forest")
    for left in range(rounds, -1, -1):
        # stars: no node has two parents, and no parent has one
        twice = left and e.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not left or not twice and not e.join(e.select(F.col("m").alias("v")).distinct(), "v", "left_semi").limit(1).count():
            if rounds and not left:
                raise RuntimeError(f"components did not settle in {rounds} rounds")
            break
        # large star: neighbours larger than u go to the smallest of u and its neighbours
        both = e.select("v", "m").union(e.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.min("m").alias("lo")).select("v", F.least("v", "lo").alias("lo"))
        large = cut(join_spread(both, low, ["v"], ["m"], "inner").where(F.col("m") > F.col("v")).select(F.col("m").alias("v"), F.col("lo").alias("m")).where("v <> m").distinct(), "large")
        # small star: smaller neighbours of u, and u, go to the smallest of them
        least = large.groupBy("v").agg(F.min("m").alias("lo"))
        small = join_spread(large, least, ["v"], ["m"], "inner").select(F.col("m").alias("v"), F.col("lo").alias("m")).union(least.select("v", F.col("lo").alias("m"))).where("v <> m").distinct()
        e = cut(small, "stars")
    roots = e.select(F.col("m").alias("id")).distinct()
    return e.select(F.col("v").alias("id"), F.col("m").alias("component")).union(roots.select("id", F.col("id").alias("component")))


# --- tokenizers -------------------------------------------------------------------------------------------------------------------


class _Words(dict):
    """Numbers words in the order in which they're first met; new ones wait in ``fresh`` until they're encoded."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class _Bounded(dict):
    """Forgets everything when it holds ``most`` entries."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def __setitem__(self, key, value) -> None:
        if len(self) >= self.most:
            self.clear()
        super().__setitem__(key, value)


class PieceTable:
    """What ``resolve`` makes of each different piece (a list of numbers), computed once and kept as flat arrays; at most about ``limit`` pieces.

    A process keeps the pieces of one table only, the one used last, and those until its task ends or somewhat longer (see ``lean``).
    """

    _active: PieceTable | None = None

    def __init__(self, resolve: Callable[[bytes], list[int]], dtype, limit: int = 500_000):
        self.resolve, self.dtype, self.limit = resolve, dtype, limit
        self._reset()

    def _reset(self) -> None:
        self.words = _Words()
        self.flat = np.empty(1 << 16, self.dtype)
        self.first = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.known = self.used = 0

    def _learn(self) -> None:
        fresh, self.words.fresh = self.words.fresh, []
        got = [self.resolve(w) for w in fresh]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(itertools.chain.from_iterable(got), self.dtype)
        while self.known + len(got) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.first, self.size))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), self.dtype)])
        at = slice(self.known, self.known + len(got))
        self.first[at], self.size[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.known += len(got)
        self.used += len(flat)

    def gather(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the pieces' numbers in a row, how many are each piece's)."""
        if PieceTable._active is not self:
            if PieceTable._active is not None:
                PieceTable._active._reset()
            PieceTable._active = self
        if len(self.words) > self.limit:
            self._reset()
        at = np.fromiter(map(self.words.__getitem__, parts), np.int64, len(parts))
        if self.words.fresh:
            self._learn()
        n = self.size[at]
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(stop) else 0
        return self.flat[np.repeat(self.first[at] - stop + n, n) + np.arange(total)], n


def _byte_letters() -> dict[int, str]:
    """The printable characters that byte-level vocabularies write for bytes: printable Latin-1 ones stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
#: A word of Latin letters and the ASCII marks after it; these are two pieces to the pre-tokenizers of both vocabularies.
_PLAIN = re.compile(r"( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


class WordTokenizer:
    """Encodes texts piece by piece, and each different piece once, with a tokenizers-library file.

    ``pieces`` cuts a UTF-8 text where the tokenizer never joins characters, so that the pieces' ids in a row are the text's ids;
    it returns None for a text that can't be cut so, which is then encoded whole. Plain Latin words go straight to the file's model
    (``lower``: its normalizer lower-cases), all other pieces through the whole tokenizer.
    """

    def __init__(self, path: str, pieces: Callable[[bytes], list[bytes] | None], lower: bool, limit: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.pieces, self.lower = pieces, lower
        self.table = PieceTable(self._piece_ids, np.uint32, limit)
        self.marks = _Bounded(4096)

    def _piece_ids(self, piece: bytes) -> list[int]:
        text = piece.decode("utf-8", "replace")
        if not self.lower and text[:1] == " " and text.isascii() and text[1:].isalpha():
            return [t.id for t in self.model.tokenize(_LETTERS[32] + text[1:])]
        if plain := _PLAIN.fullmatch(text):
            space, word, marks = plain.groups()
            if self.lower:
                word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_LETTERS)
            got = [t.id for t in self.model.tokenize(_LETTERS[32] + word if space else word)]
            if marks:
                if marks not in self.marks:
                    self.marks[marks] = [t.id for t in self.model.tokenize(marks)]
                got += self.marks[marks]
            return got
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: bytes, end: int) -> np.ndarray:
        """The text's ids and then ``end``, as uint32."""
        parts = self.pieces(text)
        ids = np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) if parts is None else self.table.gather(parts)[0]
        return np.append(ids, np.uint32(end))


_TOKENIZERS: dict[tuple, WordTokenizer] = {}


def tokenizer_of(path: str, pieces: Callable[[bytes], list[bytes] | None], lower: bool, limit: int = 500_000) -> WordTokenizer:
    """One per file and worker process; it remembers about ``limit`` pieces (some 200 bytes each)."""
    key = (path, pieces, lower)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordTokenizer(path, pieces, lower, limit)
    return _TOKENIZERS[key]
