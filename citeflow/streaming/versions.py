"""The store as a stream: versions of entries arrive as files and are merged
batch by batch; rejected candidates are appended once each."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def versions(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Versions of entries from JSON files that are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def merge_into(rows: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, first: list[str], last: list[str], sticky: dict[str, str] | None = None) -> StreamingQuery:
    """Keeps a table of merged records up to date: ``first`` columns have the
    value of least order, ``last`` columns that of greatest, a ``sticky`` column
    keeps the named value once reached. The table holds each value with its
    order, so versions may arrive late or twice. Each batch writes the next
    generation; a batch that is run again writes the same one, so the result is
    exactly once."""
    sticky = sticky or {}

    def lift(df: DataFrame) -> DataFrame:
        pair = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))).alias(c)
        return df.select(*keys, *[pair(c) for c in [*first, *last, *sticky]], *[F.coalesce(F.col(c) == v, F.lit(False)).alias(f"{c}_reached") for c, v in sticky.items()])

    def batch(df: DataFrame, number: int) -> None:
        spark, new = df.sparkSession, lift(df)
        try:
            new = new.unionByName(spark.read.parquet(f"{path}/generation={number - 1}"))
        except AnalysisException:  # the first generation
            if number:
                raise
        kept = new.groupBy(*keys).agg(*[F.min(c).alias(c) for c in first], *[F.max(c).alias(c) for c in [*last, *sticky]], *[F.max(f"{c}_reached").alias(f"{c}_reached") for c in sticky])
        kept.write.mode("overwrite").parquet(f"{path}/generation={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: list[str], columns: list[str], sticky: dict[str, str] | None = None) -> DataFrame:
    """The newest generation of a merged table, as plain columns."""
    table = spark.read.parquet(path)
    newest = table.agg(F.max("generation")).head()[0]
    plain = {c: F.col(f"{c}.v") for c in columns} | {c: F.when(F.col(f"{c}_reached"), F.lit(v)).otherwise(F.col(f"{c}.v")) for c, v in (sticky or {}).items()}
    return table.where(F.col("generation") == newest).select(*keys, *[x.alias(c) for c, x in plain.items()])


def append_once(rows: DataFrame, key: str, at: str, lateness: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each key once within the lateness bound; state is dropped as the
    watermark passes."""
    once = rows.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_per_day(rows: DataFrame, at: str, lateness: str) -> DataFrame:
    """Records that arrive each day and topic, late ones within the bound."""
    return rows.withWatermark(at, lateness).groupBy(F.window(at, "1 day").alias("day"), "topic").agg(F.count("*").alias("records"))
