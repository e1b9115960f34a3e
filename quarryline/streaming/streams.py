"""Structured Streaming forms: rate windows, incremental ingest, feedback intake."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.plans.base import query
from quarryline.session import checkpoint_root


def table_stream(spark: SparkSession, d: str, name: str, files: int = 8) -> DataFrame:
    """A table as a file stream; a single Parquet file is picked out of its folder by name."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return reader.parquet(path)


def run_batches(stream: DataFrame, land: Callable[[DataFrame, int], None], at: str) -> None:
    """All that is there, batch by batch; a batch that fails is given to ``land`` again under its number."""
    stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


def landed(spark: SparkSession, at: str, schema: str, before: int | None = None) -> DataFrame:
    """What the batches (those numbered below ``before``) have landed; nothing if there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/out")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return spark.createDataFrame([], schema + ", batch int")
    df = spark.read.schema(schema + ", batch int").parquet(f"{at}/out")
    return df if before is None else df.where(F.col("batch") < before)


#: Partial counts of windows as a stream lands them.
COUNTS = "user_id long, window_start timestamp, n long"


def land_counts(at: str) -> Callable[[DataFrame, int], None]:
    """A batch's counts by user and minute; a repeated batch replaces its own."""

    def land(batch: DataFrame, epoch: int) -> None:
        counts = batch.groupBy("user_id", F.window("ts", "60 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
        counts.select("user_id", F.col("w.start").alias("window_start"), "n").write.mode("overwrite").parquet(f"{at}/out/batch={epoch}")

    return land


@query(
    """select user_id, date_trunc('minute', ts) as window_start, count(*) as n, count(*) > 2 as over_limit from events group by 1, 2"""
)
def stream_rate_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events a user and minute from a stream, whatever the order of its files.

    Each batch lands its own counts, which are added up when read: no state is kept and no late event dropped. For alerts at once, :func:`closed_windows` gives windows when the watermark passes.
    """
    events = table_stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    at = f"{checkpoint_root(spark)}/quarryline-rate-{uuid.uuid4().hex}"
    run_batches(events, land_counts(at), at)
    w = landed(spark, at, COUNTS).groupBy("user_id", "window_start").agg(F.sum("n").alias("n"))
    return w.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", (F.col("n") > 2).alias("over_limit"))


def closed_windows(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of (user_id, window_start, n), each once the watermark has passed its end (append mode): the state holds open windows only."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "60 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("window_start"), "n")


@query("select id, trace_id, rating, comment from feedback qualify row_number() over (partition by id order by loaded_at) = 1")
def stream_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Feedback intake without repeats: of every id the delivery loaded first counts, in whatever files and order they come.

    A batch lands its first delivery of an id unless one as early has landed; the landed rows are folded once more when read, as a later
    batch may bring an earlier delivery. A null loaded_at comes last; equal ones are told apart by the other columns.
    """
    stream = table_stream(spark, d, "feedback")
    rows = stream.select("id", F.struct(F.col("loaded_at").isNull().alias("late"), "loaded_at", "created_at", "trace_id", "rating", "comment").alias("row"))
    at = f"{checkpoint_root(spark)}/quarryline-feedback-{uuid.uuid4().hex}"
    schema = rows.schema

    def land(batch: DataFrame, epoch: int) -> None:
        fresh = batch.groupBy("id").agg(F.min("row").alias("row")).alias("b")
        if epoch:
            landed = batch.sparkSession.read.schema(schema).parquet(f"{at}/out").where(F.col("batch") < epoch).select("id", "row").alias("l")
            fresh = fresh.join(landed, F.col("b.id").eqNullSafe(F.col("l.id")) & (F.col("l.row") <= F.col("b.row")), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{at}/out/batch={epoch}")  # a repeated batch replaces its own files

    run_batches(rows, land, at)
    first = spark.read.schema(schema).parquet(f"{at}/out").groupBy("id").agg(F.min("row").alias("row"))
    return first.select("id", "row.trace_id", "row.rating", "row.comment")


INGESTED = "doc_id long, source string, text_hash string"


def land_documents(at: str) -> Callable[[DataFrame, int], None]:
    """Documents of a batch whose digest differs from the one that counts so far; of one document in a batch the latest update, then the greatest digest.

    What landed under this batch's own number (before a failure) is not looked at and is replaced.
    """

    def land(batch: DataFrame, epoch: int) -> None:
        last = F.max_by(F.struct("source", "text_hash"), F.struct("updated_at", "text_hash"))
        fresh = batch.groupBy("doc_id").agg(last.alias("x")).select("doc_id", "x.*")
        known = landed(batch.sparkSession, at, INGESTED, before=epoch).groupBy("doc_id").agg(F.max_by("text_hash", "batch").alias("known"))
        fresh = fresh.join(known, "doc_id", "left").where("known is null or known <> text_hash").drop("known")
        fresh.write.mode("overwrite").parquet(f"{at}/out/batch={epoch}")

    return land


@query("select doc_id, source, sha256(text) as text_hash from documents where status = 'indexed'")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Incremental, idempotent ingest: unchanged documents are skipped, a changed one replaces what the batches before landed for it."""
    docs = table_stream(spark, d, "documents").where("status = 'indexed' and doc_id is not null").select("doc_id", "source", F.sha2("text", 256).alias("text_hash"), "updated_at")
    at = f"{checkpoint_root(spark)}/quarryline-ingest-{uuid.uuid4().hex}"
    run_batches(docs, land_documents(at), at)
    return current_documents(landed(spark, at, INGESTED))


def current_documents(all_landed: DataFrame) -> DataFrame:
    """Of every document what landed last."""
    return all_landed.groupBy("doc_id").agg(F.max_by(F.struct("source", "text_hash"), "batch").alias("x")).select("doc_id", "x.*")
