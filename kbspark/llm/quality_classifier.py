"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates and scored as sparse dot products."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import PieceTable, lean, slices, utf8_column

_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SAME = np.uint64(0xD6E8FEB86659FD93)


def _token_hashes(word: bytes) -> list[int]:
    """A word's letters, digits and marks are tokens of their own."""
    return [xxhash.xxh64_intdigest(t) for t in _TOKENS.findall(word.decode("utf-8", "replace"))]


_TABLE = PieceTable(_token_hashes, np.uint64, limit=600_000)


def features(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a whole text's unigrams and bigrams, hashed to ``bits`` bits: logarithmic counts, scaled to length one.

    A bigram of a token with itself is the same feature for all tokens. A text without tokens has no features.
    """
    hashes, _ = _TABLE.gather(text.split())
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0)
    a, b = hashes[:-1], hashes[1:]
    pairs = np.where(a == b, _SAME, (a * _MIX) ^ (b + (a >> np.uint64(29))))
    pairs = (pairs ^ (pairs >> np.uint64(32))) * _MIX
    index, count = np.unique(np.concatenate([hashes >> np.uint64(64 - bits), pairs >> np.uint64(64 - bits)]), return_counts=True)
    value = np.log1p(count)
    return index.astype(np.int64), value / np.sqrt((value * value).sum())


@dataclass(frozen=True)
class Model:
    bits: int
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        index, value = features(text, self.bits)
        return 1 / (1 + np.exp(-np.clip(self.bias + self.weights[index] @ value, -35, 35)))


def train(seen: list[tuple[np.ndarray, np.ndarray]], labels: list[int], bits: int = 18, updates: int = 20_000, balance: float = 0.9, alpha: float = 0.8, beta: float = 1.0, l1: float = 0.02, l2: float = 0.2) -> Model:
    """FTRL-proximal logistic regression over rows' ``features`` in the given order, at least three times and about ``updates`` rows in all.

    Of two labels the rarer one's rows weigh more, by the ratio of their numbers to the power ``balance``.

    With no rows every score is 1 (nothing speaks against a text); with one label only, training still runs and leans to that label.
    """
    z, n, w = (np.zeros(1 << bits) for _ in range(3))
    if not labels:
        return Model(bits, w, 35.0)
    share = min(max(sum(labels) / len(labels), 0.01), 0.99)
    ratio = (share / (1 - share)) ** balance
    weigh = (max(ratio, 1.0), max(1 / ratio, 1.0))
    bias = float(np.log(share / (1 - share))) * (1 - balance)
    bias_n = 1.0
    for _ in range(min(60, max(3, updates // len(labels)))):
        for (index, value), y in zip(seen, labels):
            zi = z[index]
            wi = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[index])) / alpha + l2))
            w[index] = wi
            p = 1 / (1 + np.exp(-np.clip(bias + wi @ value, -35, 35)))
            error = (p - y) * weigh[y]
            g = error * value
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - sigma * wi
            n[index] += g * g
            bias -= 0.05 * error / np.sqrt(bias_n)
            bias_n += error * error
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(bits, w, bias)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: CRC-32 of the id as text, remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000, sample_features: int = 16_000_000, bits: int = 18, **training) -> Model:
    """Train, in one task, on at most ``sample`` labelled rows that aren't held out: those whose ids have the smallest hashes.

    Texts become features where they lie; the training task holds at most ``sample_features`` of them (12 bytes each), the rows that
    would exceed that being left out, and only the weights come to the driver. Null labels, ids and texts don't count; an id labelled both
    ways counts as 0, and of rows with the same id one is used.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("int").alias("__y"))
    chosen = known.withColumn("__h", F.xxhash64("doc_id")).orderBy("__h", "doc_id").limit(sample)
    # at most ``sample`` rows
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__y").alias("y"), F.first("__h").alias("h"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            got = [features(t, bits) for t in utf8_column(batch, "text")]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("h", "doc_id", "y")]
            raw = [pa.array([x.astype(t).tobytes() for x in part], pa.binary()) for part, t in zip(zip(*got), (np.int32, np.float64))]
            yield pa.RecordBatch.from_arrays([*columns, *raw], names=["h", "doc_id", "y", "at", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ys, left = [], [], sample_features
        for batch in batches:
            for y, at, value in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if len(at) // 4 <= left:
                    left -= len(at) // 4
                    seen.append((np.frombuffer(at, np.int32), np.frombuffer(value, np.float64)))
                    ys.append(y)
        model = train(seen, ys, bits, **training)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    described = rows.mapInArrow(lean(describe), "h long, doc_id long, y int, at binary, value binary")
    got = described.repartition(1).sortWithinPartitions("h", "doc_id").mapInArrow(lean(learn), "weights binary, bias double").first()
    return Model(bits, np.frombuffer(got["weights"]), got["bias"]) if got else train([], [], bits)


def score_column(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """A score from 0 to 1 of every whole text, higher where label 1 is likelier; null texts are empty. The model (2^bits doubles) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        yield from lean(lambda parts: (pa.array([float(m.score(x or b"")) for x in c.cast(pa.binary()).to_pylist()], pa.float64()) for c in parts))(columns)

    return score(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.7, **options) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``least`` on, else 0) added; columns of these names are replaced. Every row is kept, in an empty table none."""
    scored = docs.drop("score", "predicted").withColumn("score", score_column(fit(docs, labels, **options), docs))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
