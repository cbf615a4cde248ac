"""Exact search and the prefix trie against brute force: the driver's smallest tables, and awkward rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import exact_search, prefix_trie
from kbspark.llm import queries as Q

# --- exact search --------------------------------------------------------------------------------------------------------------------


def plain_numbers(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * x) for x in v]


def plain_search(rows, asks, k=5):
    """Sorted (query_id, rank, vec_id, score)."""
    known = [(i, w) for i, v in rows if i is not None and (w := plain_numbers(v)) is not None]
    out = []
    for q, a in known:
        if asks(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in known if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(df, **options):
    return sorted(map(tuple, exact_search.top_k(df, F.col("vec_id") % 50 == 0, **options).collect()))


def test_search_over_the_table(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = Q.QUERIES["op11_exact_search"](spark, data)
    assert sorted(map(tuple, got.collect())) == plain_search(rows, lambda i: i % 50 == 0)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = random.Random(5)
    same = [0.5, -0.25, 0.0]
    rows = [(0, same), (50, same), (100, None), (150, [0.1, None, 0.2]), (200, [0.1, float("nan"), 0.2]), (250, [0.1, float("inf"), 0.2]), (300, []), (350, [0.0, 0.0]), (None, same), (400, [1.0]), (50, [0.3, 0.3, 0.3, 0.3]), (7, same), (7, same), (450, [0.0] * 40 + [2.0])]
    rows += [(1000 + i, same) for i in range(300)] + [(2001 + i, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(rng.choice([3, 9, 41]))]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({"score": F.lit("x"), "rank": F.lit(1), "part": F.lit(2), "query_id": F.lit(3), "id": F.lit(4)}).repartition(3)


def test_search_on_awkward_vectors(spark, odd_vectors):
    rows = [(r.vec_id, r.embedding) for r in odd_vectors.collect()]
    assert found(odd_vectors) == plain_search(rows, lambda i: i % 50 == 0)
    assert found(odd_vectors, k=700) == plain_search(rows, lambda i: i % 50 == 0, 700)
    assert found(odd_vectors.limit(0)) == []
    assert found(odd_vectors.where("vec_id = 0")) == []


def test_search_in_many_small_blocks(spark, odd_vectors, monkeypatch):
    rows = [(r.vec_id, r.embedding) for r in odd_vectors.collect()]
    expected = plain_search(rows, lambda i: i % 50 == 0)
    for rows_of, entries in ((7, 1 << 20), (64, 50)):
        batches = [b for b in odd_vectors.where("vec_id is not null").select(F.col("vec_id").alias("id"), exact_search.whole_numbers(F.col("embedding")).alias("v")).where("v is not null").toArrow().to_batches()]
        monkeypatch.setattr(exact_search, "BLOCK_ROWS", rows_of)
        monkeypatch.setattr(exact_search, "BLOCK_ENTRIES", entries)
        monkeypatch.setattr(exact_search, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 3})())}))
        import pyarrow as pa

        index = pa.Table.from_batches(exact_search._blocks(True)(batches))
        assert max(np.frombuffer(x, np.int64).size for x in index["ids"].to_pylist()) <= rows_of
        asked = pa.Table.from_batches(exact_search._blocks(False)(b.filter(pa.array([x % 50 == 0 for x in b["id"].to_pylist()])) for b in batches))
        got = exact_search._search(5)(asked, index).to_pylist()
        assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == sorted((q, i, s) for q, _, i, s in expected)


# --- prefix trie ---------------------------------------------------------------------------------------------------------------------

ROW = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, full = defaultdict(list), {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        first = c - int(math.fmod(c, 5))
        full[c] = tuple(own.get(first, [])[:h] + own[c][h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    children = defaultdict(set)
    for seq in members:
        if seq:
            children[seq[:-1]].add(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] = sum(leaves[x] for x in children[seq]) or 1
        saved[seq] = sum(saved[x] for x in children[seq]) + ((len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0)
    sha = lambda seq: hashlib.sha256(",".join(str(c) for c in members[seq] if full[c] == seq).encode()).hexdigest()
    return sorted((m[0], len(s), members[s[:-1]][0] if s else -1, len(m), len(children[s]), leaves[s], saved[s], sha(s)) for s, m in members.items())


def trie_rows(df):
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(df)).select(*ROW).collect()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got)


def test_trie_over_the_table(spark, data):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{data}/conversations.parquet").collect()]
    got = Q.QUERIES["op12_prefix_trie"](spark, data)
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got.select(*ROW).collect()) == plain_trie(rows)
    assert {f.dataType.simpleString() for f in got.schema if f.name != "ends_sha256"} == {"bigint"}


@pytest.fixture(scope="module")
def odd_talks(spark):
    """Nulls, ties, repeated rows, missing first conversations, negative ids, a node with many ends, and one with many children."""
    rng = random.Random(9)
    rows = [(5, None, None, None), (5, 0, "user", ""), (5, 1, "user", "xé中"), (5, 1, "user", "xé中"), (5, 1, None, "a"), (6, 3, "user", "y"), (-3, 0, "a", "b"), (-5, 0, "a", "c"), (None, 0, "a", "lost"), (12, 0, "user", "long " * 9000)]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 160) for t in range(rng.choice([2, 11, 12]))]
    rows += [(c, t, "user", f"own {c if t else 0}") for c in range(200, 260) for t in range(10)]
    rows += [(c, t, "bot", rng.choice("ab")) for c in range(300, 380) for t in range(rng.randrange(1, 14))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    return df.withColumns({"depth": F.lit("x"), "path": F.lit(1), "k1": F.lit(None).cast("string"), "level": F.lit(2), "place": F.lit(0)}).repartition(3)


def test_trie_on_awkward_rows(spark, odd_talks):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in odd_talks.collect()]
    assert trie_rows(odd_talks) == plain_trie(rows)
    assert trie_rows(odd_talks.limit(0)) == []
    assert trie_rows(odd_talks.where("conv_id is null")) == []
    lone = odd_talks.where("conv_id = 6")  # its first conversation isn't there, and its only turn comes before those that it keeps
    assert trie_rows(lone) == plain_trie([(6, 3, "user", "y")])


def test_long_paths_and_many_ends_are_cut(spark, monkeypatch):
    """Paths of several arrays, lists of ends of several pieces, and a long conversation over several tasks."""
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    rows = [(c, t, "user", f"{t}" if t < 90 else f"{c % 3} {t}") for c in range(1000, 1012) for t in range(150)] + [(c, 0, "user", "only") for c in range(5000, 9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert trie_rows(df) == plain_trie(rows)


def test_ends_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "IDS", 3)
    ends = [(1, 2, 3, c) for c in range(10)] + [(1, 5, 3, 7)] + [(2, 0, 1, c) for c in (-4, 11, 400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*ends[i : i + 4])], names=["k1", "k2", "depth", "conv_id"]) for i in range(0, len(ends), 4)]
    got = {(r["k1"], r["k2"], r["depth"]): r["ends_sha256"] for b in prefix_trie._hashes(prefix_trie._pieces(batches)) for r in b.to_pylist()}
    expected = defaultdict(list)
    for *k, c in ends:
        expected[tuple(k)].append(str(c))
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in expected.items()}
