"""Incremental modes on Structured Streaming: facts of new files, and counts of edges that arrive late."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.graph import edge_type
from ..parse.facts import facts
from ..runtime import ensure_checkpoint_dir, table


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4()}"


def edge_counts(edges: DataFrame, late: str = "120 days", span: str = "28 days") -> DataFrame:
    """(start, type, edges) per span of event time; deliveries later than ``late`` after the newest one are let go.

    Repeated deliveries of an edge_id count once, as long as they arrive within the watermark.
    """
    timed = edges.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    seen = timed.withWatermark("recorded_at", late).dropDuplicatesWithinWatermark(["edge_id"])
    return seen.groupBy(F.window("recorded_at", span).alias("w"), edge_type().alias("type")).agg(F.count(F.lit(1)).alias("edges")).select(F.col("w.start").alias("start"), "type", "edges")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for the input that is there now, as a table: each micro-batch is written to the shared folder."""
    spark = stream.sparkSession
    out, state = shared_path(spark, "stream"), shared_path(spark, "stream-state")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a repeated epoch overwrites itself

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields])).option("recursiveFileLookup", "true").parquet(out)


def open_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A stream over a Parquet table ``name`` in ``folder``, which may be a folder of files or a single file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{folder}/{name}") if status.isDirectory() else reader.option("pathGlobFilter", name).parquet(folder)


def new_facts(spark: SparkSession, source: str, schema: StructType) -> DataFrame:
    """A stream of facts of the files (path, content) that appear in a folder of Parquet files."""
    return facts(spark.readStream.schema(schema).parquet(source))


# ---------------------------------------------------------------- queries


def stream_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    """Edges per type and span through a stream; the watermark is wide enough to keep every row of the table."""
    schema = table(spark, d, "graph_edge").schema
    stream = open_stream(spark, d, "graph_edge.parquet", schema)
    return drain(edge_counts(stream, late="3650 days").select("type", "edges", F.date_format("start", "yyyy-MM-dd").alias("start")), "update").groupBy("start", "type").agg(F.max("edges").alias("edges"))


QUERIES = {f.__name__: f for f in (stream_edge_counts,)}
SQL = {
    "stream_edge_counts": """SELECT strftime(make_timestamp(CAST(floor(epoch_us(recorded_at) / (28 * 86400e6)) * 28 * 86400e6 AS BIGINT)), '%Y-%m-%d') AS start,
 upper(trim(type, ' ' || chr(9) || chr(10) || chr(13))) AS type, count(DISTINCT edge_id) AS edges FROM graph_edge GROUP BY ALL""",
}
