"""Flow keys, directions and segments, as windows over one partitioning by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..config import FlowConfig
from ..schema import KEY, SEG

_ORDER = ("ts_ns", "pkt_id")
#: Packets of whole flows that a task takes about, and packets up to which Spark may deal them as it likes.
TASK_PACKETS, FEW_PACKETS = 20_000, 200_000


def by_flow():
    return Window.partitionBy(*KEY).orderBy(*_ORDER)


def by_segment():
    return Window.partitionBy(*SEG).orderBy(*_ORDER)


def by_segment_direction():
    return Window.partitionBy(*SEG, "is_fwd").orderBy(*_ORDER)


def with_key(packets: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """Adds the key columns: the endpoints in order (or source and destination as they are), and the protocol."""
    source, target = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    a, b = (source, target) if cfg.direction == "as_coded" else (F.least(source, target), F.greatest(source, target))
    return packets.withColumns({"a_ip": a["ip"], "a_port": a["port"], "b_ip": b["ip"], "b_port": b["port"]})


def flow_tasks(n: int) -> int | None:
    """Tasks for the windows over n packets: adaptive execution would join partitions by bytes, however many packets these hold."""
    return -(-n // TASK_PACKETS) if n > FEW_PACKETS else None


def with_direction(packets: DataFrame, cfg: FlowConfig = FlowConfig(), tasks: int | None = None) -> DataFrame:
    """Adds the key columns and is_fwd: sent by the sender of the flow's first packet; false for all as coded.

    tasks: so many are to hold the flows, by a hash of the key, in this and the following windows.
    """
    keyed = with_key(packets, cfg)
    keyed = keyed.repartition(tasks, *KEY) if tasks else keyed
    if cfg.direction == "as_coded":
        return keyed.withColumn("is_fwd", F.lit(False))
    first = [F.first_value(c).over(by_flow()) for c in ("src_ip", "src_port")]
    return keyed.withColumn("is_fwd", (first[0] == F.col("src_ip")) & (first[1] == F.col("src_port")))


def with_flow_first_of_large(packets: DataFrame, columns: tuple[str, ...], cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """with_direction and the first packet's columns (first_*) for few large flows that have their key.

    The first packets come from an aggregation and are broadcast: there is a row a flow, so take this for flows that a count
    has shown to be few.
    """
    first = packets.groupBy(*KEY).agg(F.min(F.struct(*_ORDER, *columns)).alias("first"))
    joined = packets.join(F.broadcast(first.select(*KEY, *[F.col(f"first.{c}").alias(f"first_{c}") for c in columns])), KEY)
    same = (F.col("first_src_ip") == F.col("src_ip")) & (F.col("first_src_port") == F.col("src_port"))
    return joined.withColumn("is_fwd", F.lit(False) if cfg.direction == "as_coded" else same)


def _starts(cfg: FlowConfig) -> Column:
    """Whether a packet follows a close by idle time or by TCP flags, or is the first."""
    before, flags = F.lag("ts_ns").over(by_flow()), F.lag("tcp_flags").over(by_flow())
    return before.isNull() | (F.col("ts_ns") - before > cfg.timeout_ns) | (flags.bitwiseAND(F.lit(cfg.end_flags_mask)) != 0)


def assign_segments(packets: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """Adds seg_id, the number from 0 of each packet's segment within its flow.

    A segment closes after max_packets, after a packet with an end flag, and before a packet that comes more
    than the timeout later. As the last two restart the count, a segment is a run of max_packets since them.
    """
    w = by_flow()
    told = packets.withColumns({"s_start": _starts(cfg), "s_rn": F.row_number().over(w)})
    base = F.max(F.when(F.col("s_start"), F.col("s_rn"))).over(w)
    told = told.withColumn("s_new", (F.pmod(F.col("s_rn") - base, F.lit(cfg.max_packets)) == 0).cast("long"))
    return told.withColumn("seg_id", F.sum("s_new").over(w) - 1).drop("s_start", "s_rn", "s_new")


def with_time_buckets(packets: DataFrame, bucket_s: float = 60.0) -> DataFrame:
    """Adds bucket: the number of the span of so many seconds."""
    return packets.withColumn("bucket", F.floor(F.col("ts_ns") / F.lit(bucket_s * 1e9)).cast("long"))


def with_range_buckets(packets: DataFrame, buckets: int) -> DataFrame:
    """Adds bucket: ranges of (flow, time) with about as many packets each, however many a flow has; written.

    A flow's buckets follow each other in time, and no packet of one comes between those of another.
    """
    ranged = packets.repartitionByRange(buckets, *KEY, *_ORDER)
    return scratch.saved(ranged.withColumn("bucket", F.spark_partition_id().cast("long")), "ranges")


def assign_segments_in_buckets(packets: DataFrame, cfg: FlowConfig = FlowConfig(), bucket_s: float = 60.0) -> DataFrame:
    """assign_segments for flows too large for one task, over spans of time."""
    return segments_over_buckets(with_time_buckets(packets, bucket_s), cfg).drop("bucket")


def segments_over_buckets(bucketed: DataFrame, cfg: FlowConfig = FlowConfig(), tasks: int | None = None) -> DataFrame:
    """assign_segments for flows too large for one task: windows run over (flow, bucket), and bucket stays.

    tasks: so many are to hold the buckets in these windows.

    What a bucket needs of those before it is small and combines: the last time and flags, the packets since
    the last restart, and the segments so far. One row a bucket is combined over a flow and joined back.
    """
    part = [*KEY, "bucket"]
    w = Window.partitionBy(*part).orderBy(*_ORDER)
    ends = bucketed.groupBy(*part).agg(F.max(F.struct("ts_ns", "pkt_id", "tcp_flags")).alias("last"))
    flow = Window.partitionBy(*KEY).orderBy("bucket")
    ends = ends.withColumns({"p_ts": F.lag("last.ts_ns").over(flow), "p_flags": F.lag("last.tcp_flags").over(flow)}).drop("last")
    bucketed = bucketed.repartition(tasks, *part) if tasks else bucketed
    joined = bucketed.join(ends, part)
    before, flags = F.coalesce(F.lag("ts_ns").over(w), F.col("p_ts")), F.coalesce(F.lag("tcp_flags").over(w), F.col("p_flags"))
    start = before.isNull() | (F.col("ts_ns") - before > cfg.timeout_ns) | (flags.bitwiseAND(F.lit(cfg.end_flags_mask)) != 0)
    told = joined.withColumns({"s_start": start, "s_rn": F.row_number().over(w)}).drop("p_ts", "p_flags")
    # packets before the first restart of a bucket go on counting from the buckets before
    since = F.col("s_rn") - F.max(F.when(F.col("s_start"), F.col("s_rn"))).over(w)
    told = told.withColumns({"s_since": since, "s_open": since.isNull()})
    m = F.lit(cfg.max_packets)
    totals = told.groupBy(*part).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("s_open").cast("long")).alias("open"),
        F.max(F.struct("ts_ns", "pkt_id", (F.col("s_since") + 1).alias("run"))).alias("last"),
        F.sum(((F.col("s_since").isNotNull()) & (F.pmod("s_since", m) == 0)).cast("long")).alias("opened"),
    )
    runs = Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # the packets since the last restart before a bucket: those of the last bucket with one, and all since
    restarted = F.max(F.when(F.col("open") < F.col("n"), F.struct("bucket", F.col("last.run").alias("run"), (F.col("total")).alias("total")))).over(runs)
    totals = totals.withColumn("total", F.sum("n").over(flow))
    before_n = F.coalesce(F.col("total") - F.col("n") - F.col("r.total") + F.col("r.run"), F.lit(0))
    totals = totals.withColumn("r", restarted).withColumn("carry", before_n)
    carried = F.floor((F.col("carry") + F.col("open") + m - 1) / m) - F.floor((F.col("carry") + m - 1) / m)
    totals = totals.withColumn("segs", carried + F.col("opened"))
    totals = totals.select(*part, "carry", F.coalesce(F.sum("segs").over(runs), F.lit(0)).alias("before"))
    again = told.join(totals, part)
    new = F.when(F.col("s_since").isNull(), F.pmod(F.col("carry") + F.col("s_rn") - 1, m) == 0).otherwise(F.pmod("s_since", m) == 0)
    again = again.withColumn("s_new", new.cast("long"))
    return again.withColumn("seg_id", F.col("before") + F.sum("s_new").over(w) - 1).drop("s_start", "s_rn", "s_since", "s_open", "s_new", "carry", "before")


def close_reasons(segmented: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """One row per segment: key, seg_id, n, close_reason (count, flags, idle or end)."""
    last = F.max(F.struct(*_ORDER, "tcp_flags"))["tcp_flags"]
    told = segmented.groupBy(*SEG).agg(F.count(F.lit(1)).alias("n"), last.alias("c_flags"))
    told = told.withColumn("c_next", F.lead("seg_id").over(Window.partitionBy(*KEY).orderBy("seg_id")))
    ended = F.col("c_flags").bitwiseAND(F.lit(cfg.end_flags_mask)) != 0
    reason = F.when(ended, "flags").when(F.col("n") >= cfg.max_packets, "count").when(F.col("c_next").isNotNull(), "idle").otherwise("end")
    return told.select(*SEG, "n", reason.alias("close_reason"))


def flow_rollup(packets: DataFrame, cfg: FlowConfig = FlowConfig(direction="as_coded"), *by: Column) -> DataFrame:
    """One row per flow (and what else to group by), not cut: packets, bytes, first and last time, all flags seen. Also for streams."""
    keyed = with_key(packets, cfg)
    return keyed.groupBy(*KEY, *by).agg(F.count(F.lit(1)).alias("pkts_count"), F.sum("total_bytes").alias("total_bytes"), F.min("ts_ns").alias("start_ts"), F.max("ts_ns").alias("last_ts"), F.bit_or("tcp_flags").alias("tcp_flags"))
