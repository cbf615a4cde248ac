"""Embedding near-dedup by product quantisation: coarse inverted lists, residual subspace codes, asymmetric table distances over enough probes, exact cosine at last.

Vectors are scaled to length one, so cosine c is distance sqrt(2 - 2c). Three steps:

* A vector probes every list whose boundary to its own list lies within ``margin`` of it, and each pair is tried from both ends. The
  distances of two linked vectors to the boundary between their lists add up to the link distance at most, so that with ``margin`` at half
  of it (the default, with an allowance for rounding) no link is lost. A smaller margin loses links that run straight across a boundary,
  as they do where vectors drift along a line.
* A table distance is off by at most the length of what the code leaves of the stored vector, which is kept with the code: a pair is
  ruled out only if the table distance less that length is over the link distance.
* What remains is compared exactly, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import connected_components, cut, join_spread, lean


@dataclass(frozen=True)
class Quantiser:
    """``centres`` of the lists [lists, dims] and, for each subspace, ``codes`` [subspaces, 256 at most, dims / subspaces]."""

    centres: np.ndarray
    codes: np.ndarray

    @property
    def padded(self) -> int:
        return self.codes.shape[0] * self.codes.shape[2]

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.padded - x.shape[1])))

    def lists(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """(each vector's own list, the lists it probes, its own first)."""
        c = self.centres
        cc = (c * c).sum(1)
        between = np.sqrt(np.maximum(cc[:, None] + cc[None] - 2 * c @ c.T, 1e-12))
        own, probes = np.empty(len(x), np.int64), []
        for i in range(0, len(x), 1024):
            d = cc[None] - 2 * x[i : i + 1024] @ c.T  # squared distance less the vector's own square
            home = d.argmin(1)
            own[i : i + 1024] = home
            away = (d - d[np.arange(len(d)), home][:, None]) / (2 * between[home])
            for row, h in zip(away <= margin, home.tolist()):
                row[h] = False
                probes.append(np.concatenate([[h], np.flatnonzero(row)]))
        return own, probes

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the residuals [vectors, subspaces], lengths of what the codes leave)."""
        rest = self.pad(x - self.centres[own])
        parts = rest.reshape(len(x), self.codes.shape[0], -1)
        out = np.empty(parts.shape[:2], np.uint8)
        for s in range(self.codes.shape[0]):
            cb = self.codes[s]
            out[:, s] = ((cb * cb).sum(1)[None] - 2 * parts[:, s] @ cb.T).argmin(1)
        left = parts - self.codes[np.arange(self.codes.shape[0])[None], out]
        return out, np.sqrt((left * left).sum((1, 2)))

    def tables(self, q: np.ndarray, home: int) -> np.ndarray:
        """Squared distances of queries to every code of a list [subspaces, queries, codes]."""
        rest = self.pad(q - self.centres[home]).reshape(len(q), self.codes.shape[0], -1).transpose(1, 0, 2)
        across = rest @ self.codes.transpose(0, 2, 1)
        return (rest * rest).sum(2)[:, :, None] - 2 * across + (self.codes * self.codes).sum(2)[:, None, :]


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = np.concatenate([((c * c).sum(1)[None] - 2 * x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)])
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[count > 0] = total[count > 0] / count[count > 0][:, None]
    return c


def fit(sample: np.ndarray, lists: int, subspaces: int = 8, seed: int = 5) -> Quantiser:
    """Lists and codes from a sample of unit vectors."""
    centres = _kmeans(sample, lists, 6, seed)
    wide = -(-sample.shape[1] // subspaces) * subspaces
    near = np.concatenate([((centres * centres).sum(1)[None] - 2 * sample[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(sample), 4096)])
    rest = np.pad(sample - centres[near], ((0, 0), (0, wide - sample.shape[1]))).reshape(len(sample), subspaces, -1)
    codes = [_kmeans(rest[:, s], 256, 6, seed + 1 + s) for s in range(subspaces)]
    return Quantiser(centres, np.array(codes))


def usable(column: str, dims: int) -> Column:
    """Vectors of the right length without null or non-finite components and with some length."""
    v = F.col(column)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) == dims) & F.forall(v, fine) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors, in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _assign(quantiser, dims: int, margin: float):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dims)
            own, probes = quantiser.value.lists(x, margin)
            codes, left = quantiser.value.encode(x, own)
            names = ["cls", "copies", "vector", "own", "probes", "code", "rest"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64())), pa.array(own), pa.array(probes, pa.list_(pa.int64())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)], names=names)

    return emit


def _merge_labels(hit: np.ndarray, lq: np.ndarray, lm: np.ndarray) -> None:
    """Smallest labels spread over the links of a block until nothing changes."""
    big = np.iinfo(np.int64).max
    while True:
        q = np.minimum(lq, np.where(hit, lm[None], big).min(1, initial=big))
        m = np.minimum(lm, np.where(hit, q[:, None], big).min(0, initial=big))
        if (q == lq).all() and (m == lm).all():
            return
        lq[:], lm[:] = q, m


def _blocks(quantiser, dims: int, least: float):
    reach = float(np.sqrt(2 - 2 * least)) + 1e-6

    def block(home: int, q: dict, m: dict) -> Iterator[pa.RecordBatch]:
        z = quantiser.value
        qx, mx, qc, mc, q_own = q["vector"], m["vector"], q["cls"], m["cls"], q["own"]
        q_copies, m_copies = q["copies"], m["copies"]
        codes = np.frombuffer(b"".join(m["code"]), np.uint8).reshape(len(mc), -1)
        rest = m["rest"]
        # a pair of different lists may be met from both ends; it counts here unless the other end, in the list of lower number, has it too
        m_probes = [frozenset(p) for p in m["probes"]]
        q_links, m_links = np.zeros(len(qc), np.int64), np.zeros(len(mc), np.int64)
        lq, lm = qc.copy(), mc.copy()
        passed: list[tuple[int, int]] = []
        for i in range(0, len(qc), 256):
            at = slice(i, min(i + 256, len(qc)))
            table = z.tables(qx[at], home)
            far = np.zeros((table.shape[1], len(mc)))
            for s in range(codes.shape[1]):
                far += table[s][:, codes[:, s]]
            near = np.sqrt(np.maximum(far, 0)) - rest[None] <= reach
            cols = np.flatnonzero(near.any(0))
            if not len(cols):
                continue
            hit = near[:, cols] & (qx[at] @ mx[cols].T >= least)
            same = q_own[at] == home
            # within a list each pair once, from the smaller id; never a vector with itself
            hit &= ~same[:, None] | (qc[at][:, None] < mc[cols][None])
            for r in np.flatnonzero(~same & hit.any(1)):
                if q_own[i + r] > home:
                    for c in np.flatnonzero(hit[r]):
                        hit[r, c] = q_own[i + r] not in m_probes[cols[c]]
            if not hit.any():
                continue
            q_links[at] += hit @ m_copies[cols]
            m_links[cols] += q_copies[at] @ hit
            part_q, part_m = lq[at].copy(), lm[cols].copy()
            _merge_labels(hit, part_q, part_m)
            # what earlier chunks took for the smallest label is itself linked with the one found now
            changed = (part_m != lm[cols]) & (lm[cols] != mc[cols])
            passed += zip(lm[cols][changed].tolist(), part_m[changed].tolist())
            lq[at], lm[cols] = part_q, part_m
        if passed:
            a, b = zip(*sorted(set(passed)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([0] * len(a), pa.int64()), pa.array(b, pa.int64())], names=["cls", "n", "low"])
        for c, n, lab in ((qc, q_links, lq), (mc, m_links, lm)):
            keep = n > 0
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]), pa.array(n[keep]), pa.array(lab[keep])], names=["cls", "n", "low"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if sides[0] and sides[1]:
                q, m = ({k: np.concatenate([x[k] for x in side]) if isinstance(side[0][k], np.ndarray) else [v for x in side for v in x[k]] for k in side[0]} for side in sides)
                yield from block(current[0], q, m)

        for batch in batches:
            if not batch.num_rows:
                continue
            col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            keys = np.stack([col[k].to_numpy() for k in ("list", "mt", "qt", "member")], 1)
            flat = col["vector"].flatten().to_numpy().reshape(-1, dims)
            plain = {k: col[k].to_numpy() for k in ("cls", "copies", "own")}
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                key, member = tuple(keys[a, :3].tolist()), int(keys[a, 3])
                if key != current:
                    yield from done()
                    current, sides = key, ([], [])
                part = {"vector": flat[a:b]} | {k: v[a:b] for k, v in plain.items()}
                if member:
                    part |= {"code": col["code"].slice(a, b - a).to_pylist(), "rest": col["rest"].slice(a, b - a).to_numpy(), "probes": col["probes"].slice(a, b - a).to_pylist()}
                sides[member].append(part)
        yield from done()

    return emit


def near_duplicates(vectors: DataFrame, least: float = 0.95, sample: int = 20_000, list_size: int | None = None, margin: float | None = None, tile: int = 1024, column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, all rows compared whatever their other columns.

    A row links with every other row of cosine ``least`` or more. Null and zero vectors, and those with null or non-finite components or
    another length than most of the table has, link with nothing. Equal vectors are one class, counted with their number, so that copies
    cost a row. Rows of a null ``vec_id`` have a null component, aren't kept and count for nobody. An empty table gives no rows.

    Lists and codes are fitted on at most ``sample`` vectors (those with the smallest hashes), as many lists as
    the root of the classes (or ``list_size`` of them to a list); all rows are indexed. Lists and probes are cut into tiles of about ``tile`` rows, and a job is
    one tile of each; it emits counts and labels, never pairs. A list of any size is thus spread over many jobs.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v"))
    length = named.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = max(1, length["d"]) if length else 1
    good = named.where(F.col("vec_id").isNotNull() & usable("v", dims))
    classes = cut(good.groupBy("v").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies")).select("cls", "v", "copies"), "classes")
    total = classes.count()
    if not total:
        return named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    picked = classes.select("v", F.xxhash64("v").alias("h"), "cls").orderBy("h", "cls").limit(sample).select("v").toArrow()
    x = _matrix(picked["v"].combine_chunks(), dims)
    quantiser = fit(x, max(1, total // list_size if list_size else math.isqrt(total)))
    sent = spark.sparkContext.broadcast(quantiser)
    if margin is None:
        margin = 0.5 * float(np.sqrt(2 - 2 * least)) + 1e-6

    index = cut(classes.mapInArrow(lean(_assign(sent, dims, margin)), "cls long, copies long, vector array<double>, own long, probes array<long>, code binary, rest double"), "index")
    # both are a row for each list at most; tiles are dealt by a hash of the id
    sizes = index.groupBy(F.col("own").alias("list")).agg(F.ceil(F.count("*") / tile).alias("m_tiles"))
    asked = index.select(F.explode("probes").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / tile).alias("q_tiles"))
    tiles = F.broadcast(sizes.join(asked, "list"))
    deal = lambda n: F.pmod(F.xxhash64("cls"), F.col(n))
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    light = index.select("cls", "copies", "vector", "own", F.explode("probes").alias("list")).join(tiles, "list")
    queries = light.select("list", up_to("m_tiles").alias("mt"), deal("q_tiles").alias("qt"), F.lit(0).alias("member"), "cls", "copies", "vector", "own", F.lit(None).cast("array<long>").alias("probes"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("rest"))
    stored = index.withColumnRenamed("own", "list").join(tiles, "list")
    members = stored.select("list", deal("m_tiles").alias("mt"), up_to("q_tiles").alias("qt"), F.lit(1).alias("member"), "cls", "copies", "vector", F.col("list").alias("own"), "probes", "code", "rest")
    rows = queries.unionByName(members).repartition("list", "mt", "qt").sortWithinPartitions("list", "mt", "qt", "member", "cls")
    links = cut(rows.mapInArrow(lean(_blocks(sent, dims, least)), "cls long, n long, low long"), "links")

    counts = links.groupBy("cls").agg(F.sum("n").alias("n"))
    components = connected_components(links, "cls", "low", forests=True)
    of_class = classes.join(counts, "cls", "left").join(components, F.col("cls") == F.col("id"), "left")
    # rows find their class by two hashes of the vector, so that vectors needn't move again
    keys = lambda v: {"k1": F.xxhash64(v), "k2": F.xxhash64(F.lit(1), v)}
    of_class = of_class.withColumns(keys(F.col("v"))).select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    fine = F.col("vec_id").isNotNull() & usable("v", dims)
    keyed = named.select("vec_id", *[F.when(fine, k).alias(c) for c, k in keys(F.col("v")).items()])
    many = max(20_000, named.count() // 1000)  # fewer than 1,000 vectors have more copies
    out = join_spread(keyed, of_class, ["k1", "k2"], ["vec_id"], hot=classes.where(F.col("copies") > many).select(*[k.alias(c) for c, k in keys(F.col("v")).items()]))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
