"""A stored vector index: inverted lists around centres, one partition of a Parquet table for each list, searched by cosine for many questions at once.

Searching probes the lists whose centres are nearest to a question, and no other partition is read. ``exact`` then probes those lists,
too, that may hold something better than the ``k``-th best so far: a vector in a list of radius r (the greatest angle to its centre) is at
least the question's angle to the centre less r away. Without it the answer is approximate; ``recall`` measures it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.operators.search import dot
from kbspark.sources.shared import new_folder, stored

#: Vectors on which centres are fitted at most, and how many of a list's vectors and how many questions are compared at once at most, about.
SAMPLE, DEAL, ASKED = 20_000, 4096, 2048
PROBES = 10
_SLACK = 1e-6


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: null, empty and zero ones, and ones with null or non-finite components have none."""
    length = dot(vector, vector)
    return F.coalesce((length > 0) & ~F.exists(vector, lambda x: x.isNull()) & (length < float("inf")), F.lit(False))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as the rows of an array; they become no Python objects."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def fit_centres(vectors: DataFrame, lists: int, key: str, column: str, sample: int = SAMPLE, rounds: int = 5) -> np.ndarray:
    """Unit centres of at most ``lists`` lists: spherical k-means on the ``sample`` vectors whose keys hash lowest, begun at the first different ones."""
    low = F.xxhash64(key)
    share = min(1.0, 1.2 * sample / max(1, vectors.count()))
    rows = vectors.where(low.cast("double") <= share * 2.0**64 - 2.0**63).orderBy(low, key).limit(sample).select(F.col(column).cast("array<double>").alias("v")).toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0))
    x = _matrix(rows["v"].combine_chunks())
    x /= np.linalg.norm(x, axis=1)[:, None]
    _, at = np.unique(x.round(9), axis=0, return_index=True)
    centres = x[np.sort(at)[:lists]]
    for _ in range(rounds):
        of = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(x, -(-len(x) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        lengths = np.linalg.norm(sums, axis=1)
        centres = np.where(lengths[:, None] > 0, sums / np.where(lengths, lengths, 1)[:, None], centres)
    return centres


def _with_angles(centres: np.ndarray, most: int):
    """Arrow batches (id, vector) with the ``most`` nearest lists of each and the angles to their centres."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = _matrix(part.column(1))
                angles = np.arccos(np.clip((x / np.linalg.norm(x, axis=1)[:, None]) @ centres.T, -1, 1))
                near = np.argsort(angles, axis=1, kind="stable")[:, :most]
                found = np.take_along_axis(angles, near, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["id", "v", "lists", "angles"])

    return run


def _near(rows: DataFrame, centres: np.ndarray, most: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_with_angles(centres, most), f"id {kind}, v array<double>, lists array<int>, angles array<double>")


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed up in order as Spark's are."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _best(k: int):
    """Arrow tables of some vectors (id, v) and of questions (query_id, q, least) to (query_id, id, score): of each question the best ``k`` that aren't below ``least``, ties to the smaller id."""

    def run(vectors: pa.Table, questions: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if vectors.num_rows and questions.num_rows:
            vectors = vectors.sort_by("id")
            v, q = _matrix(vectors["v"].combine_chunks()), _matrix(questions["q"].combine_chunks())
            least = questions["least"].to_numpy()
            n, lengths = len(v), np.sqrt(_dot(v, v))
            for at in range(0, len(q), 128):
                part = q[at : at + 128]
                score = part @ v.T / (np.sqrt(_dot(part, part))[:, None] * lengths)
                # scores in millionths and, in their last digits, places: all different
                order = np.floor(score * 1e6 + 0.5).astype(np.int64) * n + np.arange(n - 1, -1, -1)
                near = np.argpartition(-order, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), order.shape)
                row, col = np.nonzero(np.take_along_axis(score, near, axis=1) >= least[at : at + 128, None])
                x, y = part[row], v[near[row, col]]
                found.append((row + at, near[row, col], _dot(x, y) / (np.sqrt(_dot(x, x)) * np.sqrt(_dot(y, y)))))
        asked, held, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": questions["query_id"].take(pa.array(asked)), "id": vectors["id"].take(pa.array(held)), "score": pa.array(score)})

    return run


class VectorIndex:
    """``lists`` (the centres), ``radii`` and ``vectors`` below a path; the latter two have a partition for each batch that was put in."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, vectors: DataFrame, lists: int | None = None, key: str = "vec_id", column: str = "embedding", batch: str = "first", sample: int = SAMPLE) -> VectorIndex:
        """Fit the centres (as many as the root of the vectors, if ``lists`` is null), store them, and put the vectors in. Vectors without a direction, and rows with a null key, are left out."""
        rows = vectors.where(usable(F.col(column)) & F.col(key).isNotNull())
        centres = fit_centres(rows, lists or max(1, round(rows.count() ** 0.5)), key, column, sample)
        found = [(i, [float(y) for y in x]) for i, x in enumerate(centres)]
        self.spark.createDataFrame(found, "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists")
        return self.insert(rows, key, column, batch)

    def centres(self) -> np.ndarray:
        """The centres, as many as were asked for, whatever the number of vectors."""
        rows = self.spark.read.parquet(f"{self.path}/lists").orderBy("list").collect()
        return np.array([r["centre"] for r in rows])

    def insert(self, vectors: DataFrame, key: str = "vec_id", column: str = "embedding", batch: str = "first") -> VectorIndex:
        """Put vectors into their nearest lists. A batch that is put in again replaces what it wrote before. Radii come first: one that is too large for a while loses nothing."""
        centres = self.centres()
        rows = vectors.where(usable(F.col(column)) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"))
        if not len(centres):
            if rows.limit(1).count():
                raise ValueError("the index was built without vectors and has no lists")
            return self
        placed = _near(rows, centres, 1).select("id", "v", F.get("lists", F.lit(0)).alias("list"), F.get("angles", F.lit(0)).alias("angle"))
        placed = stored(placed, new_folder(self.spark, "placed"))
        write = lambda df, *by: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
        write(placed.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n")), "batch").parquet(f"{self.path}/radii")
        # a file for each list and batch, unless it's a long one
        dealt = placed.join(self._deals(), "list").repartition("list", F.pmod(F.xxhash64("id"), F.col("deals")))
        write(dealt.select("list", "id", "v"), "list", "batch").parquet(f"{self.path}/vectors")
        return self

    def _deals(self) -> DataFrame:
        """(list, deals): into how many parts a list's vectors are dealt. A row for each list."""
        sizes = self.spark.read.parquet(f"{self.path}/radii").groupBy("list").agg(F.ceil(F.sum("n") / DEAL).alias("deals"))
        return F.broadcast(sizes)

    def _stored(self, lists: list[int]) -> DataFrame:
        """The vectors of some lists: a filter on the partition column, so that other lists' files aren't opened."""
        kind = self.spark.read.parquet(f"{self.path}/vectors")
        return kind.where(F.col("list").isin(lists))

    def _scored(self, probes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score): the best ``k`` of each question (query_id, q) in the lists that it probes (query_id, list, least).

        Parts of lists meet blocks of questions. A vector moves once for each block, a question once for each list that it probes.
        """
        wanted = [r["list"] for r in probes.select("list").distinct().collect()]  # at most as many as there are lists
        blocks = max(1, -(-asked.count() // ASKED))
        deals = self._deals()
        rows = self._stored(wanted).select("list", "id", "v").join(deals, "list").withColumn("deal", F.pmod(F.xxhash64("id"), F.col("deals")))
        rows = rows.select("list", "deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "id", "v")
        # the vectors of the questions are the hashed side, so that the many probes are never broadcast
        dealt = probes.join(asked.hint("shuffle_hash"), "query_id").join(deals, "list").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
        dealt = dealt.select("list", "deal", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("long").alias("block"), "query_id", "q", "least")
        kind = lambda df, name: df.schema[name].dataType.simpleString()
        cells = ["list", "deal", "block"]
        pairs = rows.groupBy(*cells).cogroup(dealt.groupBy(*cells)).applyInArrow(_best(k), f"query_id {kind(asked, 'query_id')}, id {kind(rows, 'id')}, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return pairs.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")

    def search(self, questions: DataFrame, k: int = 5, probes: int = PROBES, exact: bool = True, query: str = "query_id", column: str = "vector") -> DataFrame:
        """(query_id, rank, id, score): the best ``k`` of each question by cosine in six decimals, ties to the smaller id. Questions without a direction get no rows; ids of questions are unique."""
        centres = self.centres()
        if not len(centres):
            return questions.select(F.col(query).alias("query_id"), F.lit(1).alias("rank"), F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("score")).where("false")
        asked = questions.where(usable(F.col(column))).select(F.col(query).alias("id"), F.col(column).cast("array<double>").alias("v"))
        near = stored(_near(asked, centres, len(centres)).select(F.col("id").alias("query_id"), "lists", "angles"), new_folder(self.spark, "near"))
        asked = stored(asked.withColumnsRenamed({"id": "query_id", "v": "q"}), new_folder(self.spark, "asked"))
        first = near.select("query_id", F.explode(F.slice("lists", 1, probes)).alias("list"), F.lit(-2.0).alias("least"))
        found = stored(self._scored(first, asked, k), new_folder(self.spark, "found"))
        if exact:
            kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            least = F.when(F.col("n") >= k, F.col("least") - _SLACK).otherwise(-2.0)
            radii = F.broadcast(self.spark.read.parquet(f"{self.path}/radii").groupBy("list").agg(F.max("radius").alias("radius")))  # a row for each list
            rest = near.join(kth, "query_id", "left").select("query_id", F.coalesce(least, F.lit(-2.0)).alias("least"), F.posexplode(F.arrays_zip("lists", "angles")).alias("at", "x")).where(F.col("at") >= probes)
            rest = rest.select("query_id", "least", F.col("x.lists").alias("list"), F.col("x.angles").alias("angle")).join(radii, "list")
            more = rest.where(F.cos(F.greatest(F.col("angle") - F.col("radius"), F.lit(0.0))) >= F.col("least")).select("query_id", "list", "least")
            found = found.union(self._scored(stored(more, new_folder(self.spark, "more")), asked, k))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the true (query_id, id) that was found."""
    hits = found.select("query_id", "id", F.lit(1).alias("hit"))
    return true.select("query_id", "id").join(hits, ["query_id", "id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
