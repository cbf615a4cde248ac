"""Tables that grow by batches: each batch writes its rows as partitions of its own, and a row in the ledger, written last, makes them count.

Below a folder, ``ledger`` has (key, digest, live) for each batch and document that was new, changed or withdrawn in it, and every other table the batch's rows. A
document's rows are those of its last batch in the ledger; older ones are passed over, so that replacing, withdrawing and renaming never touch files
that someone reads. A batch that is done again writes its own partitions anew, and one that was lost before its ledger was written counts for
nothing in any table. Batches are numbered upward and done one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kbspark.sources.shared import exists, names_in

LEDGER = "key {kind}, digest string, live boolean, batch long"


def digest_of(*columns: str) -> Column:
    """A hash of a row's values, with nulls told apart from empty strings."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]), 256)


class Batches:
    """The tables below a folder. ``key`` is the type of the documents' ids."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "long"):
        self.spark, self.folder, self.schema = spark, folder, LEDGER.format(kind=key)

    def ledger(self, before: int | None = None) -> DataFrame:
        """(key, digest, live, batch) of each document's last change, of the batches before one or of all."""
        path = f"{self.folder}/ledger"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(path)
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        return rows.groupBy("key").agg(F.max_by(F.struct("digest", "live"), "batch").alias("x"), F.max("batch").alias("batch")).select("key", "x.digest", "x.live", "batch")

    def changes(self, rows: DataFrame, batch: int, at: str) -> DataFrame:
        """Of (key, digest, ...) those rows that are new or not as they were before ``batch``; rows with a null key are left out, and of several with one key the newest counts (by ``at``, then by digest)."""
        one = Window.partitionBy("key").orderBy(F.desc(at), F.desc("digest"))
        rows = rows.where("key is not null").withColumn("rn", F.row_number().over(one)).where("rn = 1").drop("rn")
        return rows.join(self.ledger(batch).select("key", "digest"), ["key", "digest"], "left_anti")

    def done(self, name: str) -> list[int]:
        """The batches whose part of a table is whole: Spark's committer leaves its mark in such only."""
        found = [int(x.removeprefix("batch=")) for x in names_in(self.spark, f"{self.folder}/{name}") if x.startswith("batch=")]
        return sorted(n for n in found if exists(self.spark, f"{self.folder}/{name}/batch={n}/_SUCCESS"))

    def part(self, name: str, batch: int) -> DataFrame:
        """One batch's rows of a table."""
        return self.spark.read.parquet(f"{self.folder}/{name}/batch={batch}")

    def write(self, name: str, rows: DataFrame, batch: int, *by: str) -> None:
        """A batch's rows of a table, in partitions by ``by`` within the batch's own."""
        out = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (out.partitionBy(*by) if by else out).parquet(f"{self.folder}/{name}/batch={batch}")

    def commit(self, rows: DataFrame, batch: int) -> None:
        """The ledger of a batch, (key, digest, live); all its tables are written by then."""
        self.write("ledger", rows.select("key", "digest", "live"), batch)

    def read(self, name: str, schema: str | StructType, key: str = "key") -> DataFrame:
        """A table's rows as they stand: of each document those of its last batch, if it's live then. ``schema`` names the columns but ``batch``."""
        rows = self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        if exists(self.spark, f"{self.folder}/{name}"):
            rows = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")
        live = self.ledger().where("live").select(F.col("key").alias(key), "batch")
        return rows.join(live, [key, "batch"], "left_semi").drop("batch")
