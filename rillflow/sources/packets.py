"""Tables and streams of packets and frames, and the sinks of flow rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FlowConfig
from ..operators.dissect import decode_frames
from ..operators.features import all_parts, csv_rows, to_wide
from ..schema import FRAMES, PACKETS


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Captured frames: pkt_id, ts_ns, frame, iface."""
    return spark.read.schema(FRAMES).parquet(path)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets that are decoded already."""
    return spark.read.schema(PACKETS).parquet(path)


def read_interfaces(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Packets of several interfaces as one table, with the name of each in iface."""
    return all_parts([read_packets(spark, p).withColumn("iface", F.lit(name)) for name, p in paths.items()])


def stream_packets(spark: SparkSession, path: str | None = None, kafka: dict[str, str] | None = None, files_per_batch: int = 100, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """A stream of packets from Parquet files that arrive in a folder, or from frames in Kafka values.

    A Kafka record's timestamp is the capture time, and its offset with its partition orders ties.
    """
    if path is not None:
        return spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    if not kafka:
        raise ValueError("a path or Kafka options are needed")
    records = spark.readStream.format("kafka").options(**kafka).load()
    frames = records.select((F.col("offset") * 4096 + F.col("partition")).alias("pkt_id"), (F.unix_micros("timestamp") * 1000).alias("ts_ns"), F.col("value").alias("frame"))
    return decode_frames(frames, cfg)


def write_flows(flows: DataFrame, path: str, kind: str = "parquet", cfg: FlowConfig = FlowConfig(), mode: str = "errorifexists") -> None:
    """Flow rows as Parquet (typed), or as CSV with the wide row as text under one header a file."""
    if kind == "csv":
        csv_rows(to_wide(flows, cfg), cfg).write.mode(mode).option("header", True).csv(path)
    elif kind == "parquet":
        flows.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"no sink of kind {kind}")


def batch_sink(path: str, kind: str = "parquet", cfg: FlowConfig = FlowConfig()) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch under which a batch that is run again leaves its rows once.

    A batch owns the folder batch=<its number>, which it replaces; the marker that Spark writes last commits it.
    """
    return lambda flows, n: write_flows(flows, f"{path.rstrip('/')}/batch={n}", kind, cfg, "overwrite")


def read_batches(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """The rows of the committed batches of a batch_sink; those of a batch that is being written, or failed, are not there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    top = hadoop(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    batches = [s.getPath() for s in files.listStatus(top) if s.getPath().getName().startswith("batch=")]
    done = [b.toString() for b in batches if files.exists(hadoop(b, "_SUCCESS"))]
    if not done:
        raise ValueError(f"{path} has no batch that is whole")
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    return reader.format(kind).load(done)
