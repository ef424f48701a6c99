"""What a packet is against those before it in its segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FlowConfig
from ..schema import SEG
from .segment import by_flow, by_segment, by_segment_direction

#: What the first packet of a flow gives to all its segments.
FIRST = ("src_ip", "dst_ip", "src_port", "dst_port", "src_mac", "dst_mac", "eth_proto")


def packet_deltas(segmented: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """Adds, for each packet of a segment:

    iat, dir_iat (seconds since the last packet, and since the last of its direction), delta_len, dir_delta_len,
    idle_s and active_s (set where a gap above the idle threshold ends), active_start, the bulk run so far of
    its direction (run_pkts, run_bytes) and closed_run (the run before it was long enough and ends here), hist_bin,
    is_first, is_last, dir_first and dir_last.
    """
    w, d = by_segment(), by_segment_direction()
    p = segmented.withColumns({"p_ts": F.lag("ts_ns").over(w), "p_len": F.lag("payload_len").over(w), "is_last": F.lead("ts_ns").over(w).isNull()})
    p = p.withColumns({"d_ts": F.lag("ts_ns").over(d), "d_len": F.lag("payload_len").over(d), "dir_last": F.lead("ts_ns").over(d).isNull()})
    p = _against_before(p, cfg)
    gap, run_gap = _gaps(cfg)
    p = p.withColumn("active_start", F.max(F.when(F.col("is_first") | gap, F.col("ts_ns"))).over(w))
    p = p.withColumns({"r_n": F.count("d_ts").over(d), "r_bytes": F.sum(_run_bytes()).over(d)})
    p = p.withColumn("a_before", F.lag("active_start").over(w))
    base_n = F.coalesce(F.max(F.when(run_gap, F.col("r_n") - 1)).over(d), F.lit(0))
    base_b = F.coalesce(F.max(F.when(run_gap, F.col("r_bytes") - F.col("payload_len"))).over(d), F.lit(0))
    p = p.withColumns({"run_pkts": F.col("r_n") - base_n, "run_bytes": F.col("r_bytes") - base_b})
    return _periods_and_runs(p, F.lag("run_pkts").over(d), cfg).drop("r_n", "r_bytes")


def _against_before(p: DataFrame, cfg: FlowConfig) -> DataFrame:
    """What follows from the time and length of the packet before (p_), and of the one before in its direction (d_)."""
    return p.withColumns({
        "iat": (F.col("ts_ns") - F.col("p_ts")) / 1e9,
        "dir_iat": (F.col("ts_ns") - F.col("d_ts")) / 1e9,
        "delta_len": F.abs(F.col("payload_len") - F.col("p_len")),
        "dir_delta_len": F.abs(F.col("payload_len") - F.col("d_len")),
        "is_first": F.col("p_ts").isNull(),
        "dir_first": F.col("d_ts").isNull(),
        "hist_bin": F.least(F.floor(F.col("payload_len") / cfg.hist_step), F.lit(cfg.hist_bins - 1)).cast("int"),
    })


def _gaps(cfg: FlowConfig) -> tuple[Column, Column]:
    return F.col("iat") > cfg.idle_threshold_s, F.col("dir_iat") >= cfg.bulk_threshold_s


def _run_bytes() -> Column:
    return F.when(~F.col("dir_first"), F.col("payload_len")).otherwise(0)


def _periods_and_runs(p: DataFrame, run_before: Column, cfg: FlowConfig) -> DataFrame:
    gap, run_gap = _gaps(cfg)
    p = p.withColumns({
        "idle_s": F.when(gap, F.col("iat")),
        "active_s": F.when(gap, (F.col("p_ts") - F.col("a_before")) / 1e9),
        "closed_run": F.coalesce(run_gap & (run_before >= cfg.bulk_min_packets), F.lit(False)),
    })
    return p.drop("p_ts", "p_len", "d_ts", "d_len", "a_before")


def packet_deltas_in_buckets(segmented: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """packet_deltas for segments too large for one task: windows run over (segment, bucket).

    What a bucket needs of those before it in its segment combines: the last time and length (of all, and of each
    direction), the start of the open active period, and for each direction the packets and bytes so far and where the open
    bulk run began. One row a bucket is combined over a segment, twice, and joined back.
    """
    part = [*SEG, "bucket"]
    w, d = (Window.partitionBy(*part, *more).orderBy("ts_ns", "pkt_id") for more in ((), ("is_fwd",)))
    of_seg = Window.partitionBy(*SEG).orderBy("bucket")
    before = of_seg.rowsBetween(Window.unboundedPreceding, -1)
    ways = {"fwd": F.col("is_fwd"), "bwd": ~F.col("is_fwd")}
    packet = F.struct("ts_ns", "pkt_id", "payload_len")
    ends = segmented.groupBy(*part).agg(F.max(packet).alias("end"), *[F.max(F.when(c, packet)).alias(f"end_{k}") for k, c in ways.items()])
    after = of_seg.rowsBetween(1, Window.unboundedFollowing)
    borders = ends.select(
        *part,
        F.lag("end").over(of_seg).alias("b"),
        F.lead("bucket").over(of_seg).isNotNull().alias("more"),
        *[F.max(f"end_{k}").over(before).alias(f"b_{k}") for k in ways],
        *[(F.count(f"end_{k}").over(after) > 0).alias(f"more_{k}") for k in ways],
    )
    own = lambda name: F.when(F.col("is_fwd"), F.col(f"{name}_fwd")).otherwise(F.col(f"{name}_bwd"))
    p = segmented.join(borders, part)
    p = p.withColumns({"p_ts": F.coalesce(F.lag("ts_ns").over(w), F.col("b.ts_ns")), "p_len": F.coalesce(F.lag("payload_len").over(w), F.col("b.payload_len")), "is_last": F.lead("ts_ns").over(w).isNull() & ~F.col("more")})
    p = p.withColumns({"d_ts": F.coalesce(F.lag("ts_ns").over(d), own("b")["ts_ns"]), "d_len": F.coalesce(F.lag("payload_len").over(d), own("b")["payload_len"]), "dir_last": F.lead("ts_ns").over(d).isNull() & ~own("more")})
    p = _against_before(p, cfg).drop("b", "more", *[f"{n}_{k}" for n in ("b", "more") for k in ways])
    gap, run_gap = _gaps(cfg)
    p = p.withColumns({"o_active": F.max(F.when(F.col("is_first") | gap, F.col("ts_ns"))).over(w), "o_n": F.count("d_ts").over(d), "o_bytes": F.sum(_run_bytes()).over(d)})
    p = p.withColumns({"o_base_n": F.max(F.when(run_gap, F.col("o_n") - 1)).over(d), "o_base_bytes": F.max(F.when(run_gap, F.col("o_bytes") - F.col("payload_len"))).over(d)})
    counted = ("n", "bytes")
    sums = [F.max(F.when(c, F.col(f"o_{x}"))).alias(f"{x}_{k}") for x in ("n", "bytes", "base_n", "base_bytes") for k, c in ways.items()]
    told = p.groupBy(*part).agg(F.max("o_active").alias("active"), *sums)
    zero = F.lit(0).cast("long")
    told = told.withColumns({f"c_{x}_{k}": F.coalesce(F.sum(f"{x}_{k}").over(before), zero) for x in counted for k in ways})
    carried = [F.max(F.col(f"c_{x}_{k}") + F.col(f"base_{x}_{k}")).over(before).alias(f"c_base_{x}_{k}") for x in counted for k in ways]
    told = told.select(*part, F.max("active").over(before).alias("c_active"), *[f"c_{x}_{k}" for x in counted for k in ways], *carried)
    p = p.join(told, part)
    p = p.withColumn("active_start", F.coalesce("o_active", "c_active"))
    # greatest passes over nulls
    runs = {x: own(f"c_{x}") + F.col(f"o_{x}") - F.coalesce(F.greatest(own(f"c_{x}") + F.col(f"o_base_{x}"), own(f"c_base_{x}")), zero) for x in counted}
    p = p.withColumns({"run_pkts": runs["n"], "run_bytes": runs["bytes"], "a_before": F.coalesce(F.lag("active_start").over(w), F.col("c_active"))})
    run_before = F.coalesce(F.lag("run_pkts").over(d), own("c_n") - F.coalesce(own("c_base_n"), zero))
    helpers = [c for c in p.columns if c.startswith(("o_", "c_")) and c not in segmented.columns]
    return _periods_and_runs(p, run_before, cfg).drop(*helpers)


def with_flow_first(packets: DataFrame) -> DataFrame:
    """Adds the addresses, MACs and EtherType of the first packet of the flow to all its packets."""
    return packets.withColumns({f"first_{c}": F.first_value(c).over(by_flow()) for c in FIRST})
