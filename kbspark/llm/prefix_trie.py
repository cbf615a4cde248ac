"""The trie of conversations' beginnings, with sums over its subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns. It's known by the XOR of 128-bit digests of its turns, each taken with its depth; since XOR needs
no order, the prefixes of one conversation are worked out in pieces, in as many tasks as hold its rows. Every node's heavy child is the one with
the most members, so a step to any other child at least halves them: a conversation meets at most log2(conversations) light steps. Heavy
paths are kept as arrays of at most ``PIECE`` nodes; from the deepest level of light steps up, each round adds to the arrays of one level what the
level below gave to its parents, and takes suffix sums: within arrays, then over the arrays of a path. Nodes with very many children or
ends, very long conversations and very common turns are pre-aggregated or dealt over tasks, never gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import cut, join_spread, lean, slices

#: Nodes in one array of a path; ids in one piece of a node's list of ends.
PIECE, IDS = 4096, 8192
#: Characters of role and text by which equal turns of a conversation are dealt over tasks.
_LEAD = 32
#: The contract's values: conversations share the turns of the first of five, and up to eight of them.
GROUP, MOST_SHARED = 5, 8
ROOT = bytes(16)


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its five: the unsigned CRC-32 of its decimal id, modulo nine."""
    return F.crc32(conv_id.cast("string")) % (MOST_SHARED + 1)


def _parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _places(batches):
    """(conv_id, part, place in the part, ...) of rows that are in order."""
    part, conv, n = TaskContext.get().partitionId(), None, 0
    for batch in slices(batches, 8192):
        ids = batch.column(0).to_pylist()
        place = []
        for c in ids:
            n = n + 1 if c == conv else 1
            conv = c
            place.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(place, pa.int64()), batch.column(5), batch.column(6)], names=["conv_id", "part", "place", "digest", "n_bytes"])


def _before(df: DataFrame, value: Column, name: str) -> DataFrame:
    """For each (conv_id, part) what the parts before it give; one row for each conversation and task that holds rows of it."""
    return df.withColumn(name, F.coalesce(value.over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, n_bytes) of every turn: its place from 1 in order of turn (null first), then of the first ``_LEAD`` characters of role
    and text, then of a hash of both; null roles and texts are empty.

    Texts don't move: a turn is its 128-bit digest and its bytes. A conversation's rows are dealt over tasks by ranges, repeated rows too.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.substring(role, 1, _LEAD).alias("r"), F.substring(text, 1, _LEAD).alias("t"),
        F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt"),
        F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    keys = ["conv_id", F.asc_nulls_first("turn"), "r", "t", F.xxhash64("digest"), "salt"]
    dealt = rows.repartitionByRange(_parts(rows), *keys).sortWithinPartitions(*keys)
    placed = cut(dealt.mapInArrow(lean(_places), "conv_id long, part int, place long, digest binary, n_bytes long"), "turns")
    counts = placed.groupBy("conv_id", "part").agg(F.max("place").alias("n"))
    before = _before(counts, F.sum("n"), "before").select("conv_id", "part", "before")
    return placed.join(before, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("before")).alias("place"), "digest", "n_bytes")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, digest, n_bytes) of every rebuilt turn, (conv_id, length) of every conversation, also of those without turns).

    A conversation is the first ``shared_turns`` turns of the first of its five (all if there are fewer), then its own turns after as many.
    """
    turns = cut(numbered_turns(conversations), "numbered")
    own = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = own.select("conv_id", "own", first.alias("base"), shared_turns(F.col("conv_id")).alias("h"))
    heads = own.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    taken = F.least("h", F.coalesce("of_base", F.lit(0)))
    convs = cut(convs.join(heads, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "convs")
    begun = turns.where((F.col("place") <= MOST_SHARED) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")  # eight rows a base at most
    lent = begun.join(convs.select("conv_id", "base", "taken"), "base").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "digest", "n_bytes")
    rest = join_spread(turns, convs.select("conv_id", "h", "taken"), ["conv_id"], ["place"], "inner").where("place > h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "n_bytes")
    return lent.union(rest), convs.select("conv_id", "length")


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(16, "big")


def _prefixes(batches):
    """(conv_id, part, depth, n_bytes, prefix, turn): the XOR over the rows of a conversation in this part up to each row, and the row's own digest."""
    part, conv, state = TaskContext.get().partitionId(), None, ROOT
    for batch in slices(batches, 8192):
        prefix, own = [], []
        for c, d, digest in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if c != conv:
                conv, state = c, ROOT
            h = hashlib.blake2b(digest, digest_size=16, salt=d.to_bytes(16, "little")).digest()
            state = _xor(state, h)
            prefix.append(state)
            own.append(h)
        n = len(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * n, pa.int32()), batch.column(1), batch.column(3), pa.array(prefix, pa.binary()), pa.array(own, pa.binary())], names=["conv_id", "part", "depth", "n_bytes", "prefix", "turn"])


def _halves(c: str) -> list[Column]:
    """A 128-bit value as two longs, which SQL can XOR."""
    half = lambda at: F.conv(F.hex(F.substring(c, at, 8)), 16, -10).cast("long")
    return [half(1), half(9)]


def members(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, n_bytes, k1, k2, p1, p2): for each conversation and depth the key of its node and of the node's parent."""
    dealt = turns.select("conv_id", "depth", "digest", "n_bytes").repartitionByRange(_parts(turns), "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    steps = dealt.mapInArrow(lean(_prefixes), "conv_id long, part int, depth long, n_bytes long, prefix binary, turn binary")
    (x1, x2), (t1, t2) = _halves("prefix"), _halves("turn")
    steps = cut(steps.select("conv_id", "part", "depth", "n_bytes", x1.alias("x1"), x2.alias("x2"), t1.alias("t1"), t2.alias("t2")), "steps")
    totals = steps.groupBy("conv_id", "part").agg(F.bit_xor("t1").alias("y1"), F.bit_xor("t2").alias("y2"))
    before = _before(_before(totals, F.bit_xor("y1"), "b1"), F.bit_xor("y2"), "b2").select("conv_id", "part", "b1", "b2")
    k1, k2 = F.col("x1").bitwiseXOR(F.col("b1")), F.col("x2").bitwiseXOR(F.col("b2"))
    return steps.join(before, ["conv_id", "part"]).select("conv_id", "depth", "n_bytes", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("t1")).alias("p1"), k2.bitwiseXOR(F.col("t2")).alias("p2"))


def _pieces(batches):
    """Ids in order, joined by commas into pieces of at most ``IDS``: (node, first id, text)."""
    key, ids, out = None, [], {"k1": [], "k2": [], "depth": [], "first": [], "ids": []}

    def done():
        for c, x in zip(out, (*key, ids[0], ",".join(map(str, ids)))):
            out[c].append(x)

    def batch_of():
        rows = pa.RecordBatch.from_arrays([pa.array(v, pa.string() if c == "ids" else pa.int64()) for c, v in out.items()], names=list(out))
        for v in out.values():
            v.clear()
        return rows

    for batch in slices(batches, 8192):
        for a, b, d, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (a, b, d) != key or len(ids) == IDS:
                if ids:
                    done()
                key, ids = (a, b, d), []
            ids.append(c)
        if out["k1"]:
            yield batch_of()
    if ids:
        done()
        yield batch_of()


def _hashes(batches):
    """SHA-256 over a node's pieces, which come in order."""
    key, state, out = None, None, []
    rows = lambda: pa.RecordBatch.from_arrays([pa.array(v, pa.string() if i == 3 else pa.int64()) for i, v in enumerate(zip(*out))], names=["k1", "k2", "depth", "ends_sha256"])
    for batch in slices(batches, 256):
        for a, b, d, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if (a, b, d) != key:
                if state:
                    out.append((*key, state.hexdigest()))
                key, state = (a, b, d), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) >= 4096:
            yield rows()
            out = []
    if state:
        out.append((*key, state.hexdigest()))
        yield rows()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256) of nodes where conversations end. Ids are ordered and joined over many tasks; only the hash itself, which can't be
    split, goes through a node's pieces in one, and holds one at a time."""
    keys = ["k1", "k2", "depth"]
    pieces = ends.repartitionByRange(_parts(ends), *keys, "conv_id").sortWithinPartitions(*keys, "conv_id").mapInArrow(lean(_pieces), "k1 long, k2 long, depth long, first long, ids string")
    return pieces.repartition(_parts(ends), *keys).sortWithinPartitions(*keys, "first").mapInArrow(lean(_hashes), "k1 long, k2 long, depth long, ends_sha256 string")


def _suffix_sums(batches):
    """Each array of a path from its end to every node, and the array's total."""
    for batch in slices(batches, 64):
        lists = batch.column(2)
        n = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        ends = np.cumsum(n)
        of = np.repeat(np.arange(len(n)), n)
        columns = [pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), n), pa.int64()) for i in (0, 1)]
        columns += [flat.field(i) for i in range(3)]
        for i in (3, 4):
            x = flat.field(i).to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(x)])
            columns.append(pa.array(upto[ends[of]] - upto[:-1], pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, names=["path", "piece", "depth", "k1", "k2", "leaves", "saved"])


def prefix_trie(parts: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie of ``rebuilt`` conversations.

    ``conv_id`` is the smallest member. Rows without a conv_id are left out; a conversation without turns is a member of the root alone; an
    empty table has no root and gives no rows. Turns of the same number are in the order that ``numbered_turns`` states, and repeated rows are
    turns of their own. Other columns, whatever their names, are ignored. Nodes are told apart by 128 bits of their turns' digests, their depth
    among them.
    """
    turns, convs = parts
    rows = cut(members(turns), "members")
    ids = ["k1", "k2", "depth"]
    length = convs.withColumnRenamed("length", "depth")
    ends = cut(rows.join(length.where("depth > 0"), ["conv_id", "depth"], "left_semi").select(*ids, "conv_id"), "ends")
    at_root = length.where("depth = 0").select(*[F.lit(0).cast("long").alias(c) for c in ("k1", "k2")], "depth", "conv_id")

    # nodes, with what is their own
    below = rows.groupBy(*ids).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("n_bytes").alias("n_bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = root.select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), none.alias("p1"), none.alias("p2"), "conv_id", "n_convs", zero.alias("n_bytes"))
    plain = cut(below.unionByName(root), "plain")
    up = plain.where("depth > 0").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"), "n_convs", "conv_id")
    # of the children the largest, of equal ones that with the smallest id: its (conv_id, depth) names it
    children = up.groupBy(*ids).agg(F.count("*").alias("n_children"), F.max_by("conv_id", F.struct(F.col("n_convs"), -F.col("conv_id"))).alias("heavy"))
    nodes = cut(plain.join(children, ids, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    named = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy"))
    nodes = join_spread(nodes.drop("heavy"), named.where("heavy is not null"), ["p1", "p2", "depth"], ["conv_id"])
    nodes = cut(nodes.withColumn("light", F.coalesce(F.col("heavy") != F.col("conv_id"), F.lit(True))).drop("heavy"), "nodes")

    # each leaf has the path that ends in it; it begins at the last light node above, and lies below as many light steps as there are light nodes
    leaves = nodes.where("n_children = 0 and depth > 0").select(F.col("conv_id").alias("path"), "k1", "k2", "depth")
    line = join_spread(rows.select(F.col("conv_id").alias("path"), *ids), leaves.select("path"), ["path"], ["depth"], "inner")
    line = cut(join_spread(line, nodes.select(*ids, "light", "n_children", "n_convs", "n_bytes"), ids, ["path"], "inner"), "lines")
    starts = line.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("light"), F.col("depth"))), zero).alias("begins"), F.count_if("light").alias("level"))
    placed = join_spread(line, starts, ["path"], ["depth"], "inner").where("depth >= begins")
    own = [F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")]
    piece = F.floor(F.col("depth") / PIECE).alias("piece")
    top = nodes.where("depth = 0").withColumn("of", F.lit(0))
    end_of_top = starts.where("begins = 0").agg(F.max("path").alias("path"))  # one row; null where the root has no children
    top = top.join(F.broadcast(end_of_top)).select(F.coalesce("path", "conv_id").alias("path"), zero.alias("piece"), *ids, F.lit(True).alias("heads"), zero.alias("level"), *own)
    placed = cut(placed.select("path", piece, *ids, (F.col("depth") == F.col("begins")).alias("heads"), "level", *own).union(top), "paths")

    deepest = placed.agg(F.max("level")).first()[0]
    added = None
    results = None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        at = placed.where(F.col("level") == level)
        if added is not None:
            at = at.join(added, ids, "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in ("leaves", "saved")})
        arrays = at.groupBy("path", "piece").agg(F.array_sort(F.collect_list(F.struct("depth", "k1", "k2", "leaves", "saved"))).alias("nodes"))
        sums = cut(arrays.mapInArrow(lean(_suffix_sums), "path long, piece long, depth long, k1 long, k2 long, leaves long, saved long"), "sums")
        pieces = sums.groupBy("path", "piece").agg(F.max("leaves").alias("leaves"), F.max("saved").alias("saved"))
        later = Window.partitionBy("path").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
        rest = pieces.select("path", "piece", *[F.coalesce(F.sum(c).over(later), zero).alias(f"rest_{c}") for c in ("leaves", "saved")])
        whole = sums.join(rest, ["path", "piece"]).select(*ids, *[(F.col(c) + F.col(f"rest_{c}")).alias(c) for c in ("leaves", "saved")])
        whole = cut(whole, "level")
        results = whole if results is None else results.union(whole)
        if level:
            heads = placed.where((F.col("level") == level) & F.col("heads")).select(*ids)
            parents = whole.join(heads, ids, "left_semi").join(nodes.select(*ids, "p1", "p2"), ids)
            added = parents.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(*[F.sum(c).alias(f"more_{c}") for c in ("leaves", "saved")])
    if results is None:
        results = placed.select(*ids, "leaves", "saved")
    hashed = ends_digests(ends.unionByName(at_root))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = nodes.select(*ids, "conv_id", "parent_conv_id", "n_convs", "n_children").join(results, ids).join(hashed, ids, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))
