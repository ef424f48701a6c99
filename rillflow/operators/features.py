"""Features of flow segments: counters, suites and histograms, and the row that joins them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from ..config import FlowConfig
from ..functions.bytes import byte_entropy, ip_text, mac_text
from ..functions.median import histogram_median, p2_median, p2_medians_of, p2_of_sorted
from ..functions.text import fixed_texts
from ..schema import FLAGS, KEY, LAST, SEG, STATS, SUITES, wide_columns
from ..shipping import ship
from .deltas import FIRST, packet_deltas, packet_deltas_in_buckets, with_flow_first
from .segment import FEW_PACKETS, TASK_PACKETS, assign_segments, flow_tasks, segments_over_buckets, with_direction, with_flow_first_of_large, with_key, with_range_buckets


def prepared(packets: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """Packets with key, direction, segment and deltas: one Exchange, by key."""
    return packet_deltas(assign_segments(with_direction(packets, cfg, flow_tasks(packets.count())), cfg), cfg)


#: What a packet gives to the suites and histograms.
_GIVEN = ("payload_len", "header_len", "iat", "dir_iat", "delta_len", "dir_delta_len", "window_size", "ip_id", "frag_off", "ttl", "active_s", "idle_s", "is_fwd", "hist_bin")
#: Packets of a segment up to which they are held as one array.
HELD_PACKETS = 10_000
#: Packets from which a flow is cut over several tasks (where there are more than FEW_PACKETS), and flows that there can be of that kind at most.
LARGE_PACKETS, LARGE_FLOWS = 2 * TASK_PACKETS, 100_000
#: Buckets of large flows for a shuffle partition (more where they would hold over TASK_PACKETS), and packets that a bucket has at least.
BUCKETS, BUCKET_PACKETS = 16, 1_000


def _suite_inputs(col: Callable[[str], Column]) -> dict[str, Column]:
    """What each suite takes of a packet, whose values col gives by name; null where it takes nothing."""
    fwd = col("is_fwd")
    split = lambda total, direction: {"Tot": col(total), "Fwd": F.when(fwd, col(direction)), "Bwd": F.when(~fwd, col(direction))}
    inputs = {f"{d}_{s}": x for s, (t, k) in {"Pay": ("payload_len", "payload_len"), "Hdr": ("header_len", "header_len"), "IAT": ("iat", "dir_iat"), "DeltaLen": ("delta_len", "dir_delta_len")}.items() for d, x in split(t, k).items()}
    return inputs | {"Win": col("window_size"), "IpId": col("ip_id"), "Frag": col("frag_off"), "TTL_Var": col("ttl"), "Active": col("active_s"), "Idle": col("idle_s")}


def suite_values(names: list[str]) -> Column:
    """An array of (suite, x) of a packet, for the suites asked for."""
    inputs = _suite_inputs(F.col)
    return F.array(*[F.struct(F.lit(SUITES.index(n)).alias("suite"), inputs[n].cast("double").alias("x")) for n in names])


def _median(values: Column, cfg: FlowConfig) -> Column:
    if cfg.median == "none":
        return F.lit(0.0)
    return F.median("x") if cfg.median == "exact" else values


def suites(prepared_packets: DataFrame, names: list[str] | None = None, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """One row per segment and suite with values: key, seg_id, suite (its name), n and the ten statistics.

    Suites are rows while they are aggregated, so that all are one code path and only those asked for cost.
    The P-square median needs the values in order: they are held where max_packets bounds them, and pass by in order beyond.
    """
    names = names or SUITES
    p2 = cfg.median == "p2" and cfg.max_packets <= HELD_PACKETS
    passing = cfg.median == "p2" and not p2
    rows = prepared_packets.select(*SEG, "ts_ns", "pkt_id", F.inline(suite_values(names))).where("x is not null")
    floor = F.floor if cfg.floor_extrema else lambda c: c
    m2, mean, n = F.var_pop("x") * F.count("x"), F.avg("x"), F.count("x")
    std = F.coalesce(F.stddev_samp("x"), F.lit(0.0))
    rowed = rows.groupBy(*SEG, "suite").agg(
        n.alias("n"),
        floor(F.max("x")).cast("double").alias("Max"),
        floor(F.min("x")).cast("double").alias("Min"),
        mean.alias("Mean"),
        std.alias("Std"),
        F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("Var"),
        (F.array_sort(F.collect_list(F.struct("ts_ns", "pkt_id", "x")))["x"] if p2 else F.lit(0.0) if passing else _median(F.lit(0.0), cfg)).alias("Median"),
        F.when(m2 > cfg.moment_epsilon, F.skewness("x")).otherwise(0.0).alias("Skew"),
        F.when(m2 > cfg.moment_epsilon, F.kurtosis("x")).otherwise(0.0).alias("Kurt"),
        F.when(mean > 0, std / mean).otherwise(0.0).alias("CoV"),
        (F.mode("x") if cfg.exact_mode else F.lit(0.0)).alias("Mode"),
    )
    if p2:
        ship(rows.sparkSession)
        rowed = rowed.withColumn("Median", p2_median("Median"))
    if passing:
        ship(rows.sparkSession)
        by = [*SEG, "suite"]
        in_order = rows.repartition(*by).sortWithinPartitions(*by, "ts_ns", "pkt_id").select(*by, "x")
        medians = in_order.mapInArrow(p2_of_sorted(by, "x"), T.StructType([*in_order.select(*by).schema, T.StructField("Median", T.DoubleType())]))
        rowed = rowed.withColumnRenamed("Median", "none").join(medians, by).select(*rowed.columns)
    return rowed.withColumn("suite", F.get(F.array(*map(F.lit, SUITES)), F.col("suite")))


def histograms(prepared_packets: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """key, seg_id and three arrays of bin counts: Hist_Tot, Hist_Fwd, Hist_Bwd."""
    fwd = F.col("is_fwd").cast("long")
    bins = prepared_packets.groupBy(*SEG, "hist_bin").agg(F.count(F.lit(1)).alias("tot"), F.sum(fwd).alias("fwd"))
    held = bins.groupBy(*SEG).agg(F.map_from_entries(F.collect_list(F.struct("hist_bin", F.struct("tot", "fwd")))).alias("bins"))
    each = F.transform(F.sequence(F.lit(0), F.lit(cfg.hist_bins - 1)), lambda i: F.coalesce(F.element_at("bins", i), F.struct(F.lit(0).cast("bigint").alias("tot"), F.lit(0).cast("bigint").alias("fwd"))))
    held = held.select(*SEG, each.alias("each"))
    return held.select(*SEG, F.col("each.tot").alias("Hist_Tot"), F.col("each.fwd").alias("Hist_Fwd"), F.transform("each", lambda e: e["tot"] - e["fwd"]).alias("Hist_Bwd"))


def _when_max(condition: Column, value: Column | str) -> Column:
    return F.max(F.when(condition, F.col(value) if isinstance(value, str) else value))


def _ratio(a: Column, b: Column, none: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(none.cast("double"))


def counters(prepared_packets: DataFrame, cfg: FlowConfig = FlowConfig(), more: tuple[Column, ...] = ()) -> DataFrame:
    """Everything of a segment but suites and histograms, one row each. more: further aggregates to carry."""
    fwd, first, last = F.col("is_fwd"), F.col("is_first"), F.col("is_last")
    zero = lambda c: F.coalesce(c, F.lit(0))
    count = lambda c: F.sum(c.cast("long"))
    dir_end = lambda d: F.col("dir_last") & (fwd if d == "Fwd" else ~fwd)
    aggs = [F.count(F.lit(1)).alias("PacketsCount"), count(fwd).alias("FwdPacketsCount"), count(~fwd).alias("BwdPacketsCount"), F.sum("payload_len").alias("TotalBytes"), F.sum(F.when(fwd, F.col("payload_len")).otherwise(0)).alias("FwdBytes"), F.sum(F.when(~fwd, F.col("payload_len")).otherwise(0)).alias("BwdBytes")]
    for bit, name in enumerate(FLAGS):
        has = F.col("tcp_flags").bitwiseAND(F.lit(1 << bit)) != 0
        aggs += [count(has).alias(f"{name}_Cnt"), count(has & fwd).alias(f"{name}_Fwd_Cnt"), count(has & ~fwd).alias(f"{name}_Bwd_Cnt")]
    for d in ("Fwd", "Bwd"):
        aggs += [zero(_when_max(dir_end(d), "run_bytes")).alias(f"{d}BulkBytes"), zero(_when_max(dir_end(d), "run_pkts")).alias(f"{d}BulkPkts"), count(F.col("closed_run") & (fwd if d == "Fwd" else ~fwd)).alias(f"{d}BulkCnt")]
    back_window = zero(_when_max(F.col("dir_first") & ~fwd, "window_size")) if cfg.backward_window else F.lit(0)
    forward_window = _when_max(first, "window_size") if cfg.direction == "as_coded" else zero(_when_max(F.col("dir_first") & fwd, "window_size"))
    aggs += [forward_window.alias("FwdInitWinBytes"), F.max(back_window).alias("BwdInitWinBytes") if not cfg.backward_window else back_window.alias("BwdInitWinBytes")]
    aggs += [_when_max(last, c).alias(n) for c, n in LAST.items()]
    aggs += [_when_max(first, c).alias(c) for c in ("ip_ver", "traffic_class", "flow_label")]
    entropy = byte_entropy(F.col("payload_hint")) if cfg.payload_entropy else F.lit(0.0)
    aggs += [zero(_when_max(first, entropy)).alias("PayloadEntropy"), F.min("ts_ns").alias("start_ts_ns"), F.max("ts_ns").alias("end_ts_ns"), _when_max(last, "active_start").alias("active_start"), _when_max(last, "tcp_flags").alias("end_flags")]
    held = ["first_src_ip", "first_dst_ip", "first_src_port", "first_dst_port", "first_src_mac", "first_dst_mac", "first_eth_proto"]
    rows = prepared_packets.groupBy(*SEG, *held).agg(*aggs, *more)
    return _derived(rows, cfg)


def _derived(rows: DataFrame, cfg: FlowConfig) -> DataFrame:
    """Timing, ratios and rates of counters."""
    c = F.col
    # as the last packet's flags and count close a segment at once, only an idle one can wait for the timer
    ended = (c("PacketsCount") >= cfg.max_packets) | (c("end_flags").bitwiseAND(F.lit(cfg.end_flags_mask)) != 0)
    close = c("end_ts_ns") if cfg.idle_close == "last_packet" else F.when(ended, c("end_ts_ns")).otherwise(c("end_ts_ns") + cfg.timeout_ns)
    rows = rows.withColumn("close_ts_ns", close).drop("end_flags")
    span = (c("close_ts_ns") - c("active_start")) / 1e9
    rows = rows.withColumns({"timestamp": c("close_ts_ns") / 1e9, "duration": F.when(span > 0, span).otherwise(cfg.min_duration_s), "flow_duration": (c("end_ts_ns") - c("start_ts_ns")) / 1e9})
    rate = lambda n: c(n) / c("duration")
    return rows.withColumns({
        "FwdBwdPktRatio": _ratio(c("FwdPacketsCount"), c("BwdPacketsCount"), c("FwdPacketsCount")),
        "FwdBwdByteRatio": _ratio(c("FwdBytes"), c("BwdBytes"), c("FwdBytes")),
        "DownUpRatio": _ratio(c("BwdPacketsCount"), c("FwdPacketsCount"), F.lit(0)),
        "BytesRate": rate("TotalBytes"), "FwdBytesRate": rate("FwdBytes"), "BwdBytesRate": rate("BwdBytes"),
        "PacketsRate": rate("PacketsCount"), "FwdPacketsRate": rate("FwdPacketsCount"), "BwdPacketsRate": rate("BwdPacketsCount"),
    })


def _array_stats(values: Column, cfg: FlowConfig) -> Column:
    """Arrays of values to structs of their statistics but the median (and with it the mode, which is constant here)."""
    floor = F.floor if cfg.floor_extrema else lambda c: c
    total = F.transform(values, lambda v: F.struct(v.alias("v"), F.size(v).alias("n"), (F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(v), F.lit(0))).alias("mean")))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))

    def powers(mean: Column) -> Callable[[Column, Column], Column]:
        d = lambda x: x - mean
        return lambda a, x: F.struct((a["a"] + d(x) * d(x)).alias("a"), (a["b"] + d(x) * d(x) * d(x)).alias("b"), (a["c"] + d(x) * d(x) * d(x) * d(x)).alias("c"))

    summed = F.transform(total, lambda s: F.struct(s["v"].alias("v"), s["n"].alias("n"), s["mean"].alias("mean"), F.aggregate(s["v"], zero, powers(s["mean"])).alias("m")))
    zeroed = lambda c: F.coalesce(c, F.lit(0.0))

    def told(s: Column) -> Column:
        n, mean, m2 = s["n"], s["mean"], s["m"]["a"]
        var = F.when(n > 1, m2 / (n - 1)).otherwise(0.0)
        return F.struct(
            zeroed(floor(F.array_max(s["v"])).cast("double")).alias("Max"),
            floor(F.array_min(s["v"])).cast("double").alias("Min"),
            zeroed(mean).alias("Mean"),
            F.sqrt(var).alias("Std"),
            var.alias("Var"),
            F.when(m2 > cfg.moment_epsilon, F.sqrt(n) * s["m"]["b"] / (m2 * F.sqrt(m2))).otherwise(0.0).alias("Skew"),
            F.when(m2 > cfg.moment_epsilon, n * s["m"]["c"] / (m2 * m2) - 3).otherwise(0.0).alias("Kurt"),
            F.when(mean > 0, F.sqrt(var) / mean).otherwise(0.0).alias("CoV"),
            F.lit(0.0).alias("Mode"),
        )

    return F.transform(summed, told)


def _middle(v: Column) -> Column:
    """The exact median of an array; 0 for none."""
    held, n = F.array_sort(v), F.size(v)
    return F.coalesce((F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2, F.lit(0.0))


_HIST_MEDIANS = {"Tot_Pay": "Hist_Tot", "Fwd_Pay": "Hist_Fwd", "Bwd_Pay": "Hist_Bwd"}


def _folded_features(p: DataFrame, cfg: FlowConfig, names: list[str]) -> DataFrame:
    """The flow rows from one aggregation: a segment's packets are an array, which max_packets bounds."""
    held = F.array_sort(F.collect_list(F.struct("ts_ns", "pkt_id", *_GIVEN))).alias("packets")
    rows = counters(p, cfg, (held,))
    chosen = lambda condition: F.filter("packets", condition) if condition else F.col("packets")
    for name, condition in (("Hist_Tot", None), ("Hist_Fwd", lambda q: q["is_fwd"]), ("Hist_Bwd", lambda q: ~q["is_fwd"])):
        rows = rows.withColumn(f"bins_{name}", F.transform(chosen(condition), lambda q: q["hist_bin"]))
    bins = lambda h: F.transform(F.sequence(F.lit(0), F.lit(cfg.hist_bins - 1)), lambda i: F.size(F.filter(f"bins_{h}", lambda b: b == i)).cast("bigint"))
    taken = lambda n: lambda q: _suite_inputs(lambda c: q[c])[n].cast("double")
    values = F.array(*[F.filter(F.transform("packets", taken(n)), lambda x: x.isNotNull()) for n in names])
    rows = rows.withColumns({h: bins(h) for h in _HIST_MEDIANS.values()} | {"values": values}).drop("packets", *[f"bins_{h}" for h in _HIST_MEDIANS.values()])
    of_hist = {i: _HIST_MEDIANS[n] for i, n in enumerate(names) if cfg.median == "p2" and n in _HIST_MEDIANS}
    estimated = [i for i in range(len(names)) if i not in of_hist]
    if cfg.median == "p2" and estimated:
        ship(p.sparkSession)
        medians = p2_medians_of(F.array(*[F.get("values", F.lit(i)) for i in estimated]))
    else:
        medians = F.array(*[_middle(F.get("values", F.lit(i))) if cfg.median == "exact" else F.lit(0.0) for i in estimated]) if estimated else F.array().cast("array<double>")
    rows = rows.withColumn("medians", medians)
    rows = rows.withColumn("stats", _array_stats(F.col("values"), cfg)).drop("values")

    def stat(i: int, t: str) -> Column:
        if t == "Median":
            return histogram_median(F.col(of_hist[i]), cfg.hist_step) if i in of_hist else F.get("medians", F.lit(estimated.index(i)))
        return F.get("stats", F.lit(i))[t]

    kept = [x for x in rows.columns if x not in ("stats", "medians")]
    return rows.select(*kept, *[stat(i, t).alias(f"{n}_{t}") for i, n in enumerate(names) for t in STATS])


def segment_features(segmented: DataFrame, cfg: FlowConfig = FlowConfig(), names: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """The typed flow row of every segment of packets that assign_segments, segments_of_large or a stream has cut.

    Segments of at most HELD_PACKETS packets are aggregated once; longer ones, and exact modes, by joining
    aggregates of packets. tasks: so many are to hold the segments (or their buckets), dealt anew.
    """
    told = segmented if "first_src_ip" in segmented.columns else with_flow_first(segmented)
    in_buckets = "bucket" in segmented.columns and cfg.max_packets > HELD_PACKETS
    told = told.repartition(tasks, *SEG, *(["bucket"] if in_buckets else [])) if tasks else told
    p = packet_deltas_in_buckets(told, cfg) if in_buckets else packet_deltas(told, cfg)
    names = names or SUITES
    return _joined_features(p, cfg, names) if cfg.max_packets > HELD_PACKETS or cfg.exact_mode else _folded_features(p, cfg, names)


def _joined_features(p: DataFrame, cfg: FlowConfig, names: list[str]) -> DataFrame:
    """The flow rows by joining counters, suites and histograms."""
    folded = suites(p, names, cfg).groupBy(*SEG).agg(F.map_from_entries(F.collect_list(F.struct("suite", F.struct(*STATS)))).alias("suites"))
    joined = counters(p, cfg).join(folded, SEG).join(histograms(p, cfg), SEG)
    hist_medians = _HIST_MEDIANS if cfg.median == "p2" else {}
    joined = joined.withColumns({f"{s}_row": F.element_at("suites", F.lit(s)) for s in names} | {f"{s}_hist_median": histogram_median(F.col(h), cfg.hist_step) for s, h in hist_medians.items() if s in names})

    def stat(s: str, t: str) -> Column:
        if t == "Median" and s in hist_medians:
            return F.col(f"{s}_hist_median").alias(f"{s}_Median")
        value = F.col(f"{s}_row.{t}")
        return (value if t == "Min" else F.coalesce(value, F.lit(0.0))).alias(f"{s}_{t}")

    kept = [x for x in joined.columns if x not in ("suites", *(f"{s}_row" for s in names), *(f"{s}_hist_median" for s in hist_medians))]
    return joined.select(*kept, *[stat(s, t) for s in names for t in STATS])


def large_flows(packets: DataFrame, cfg: FlowConfig = FlowConfig(), least: int = LARGE_PACKETS) -> DataFrame | None:
    """Key and n of the flows with more than so many packets (at most LARGE_FLOWS, by a higher bound); None for none."""
    return _counted_flows(packets, cfg, least, least)[1]


def _counted_flows(packets: DataFrame, cfg: FlowConfig, least: int, few: int) -> tuple[int, DataFrame | None]:
    """The number of packets, and large_flows; none up to few packets."""
    keyed = with_key(packets, cfg)
    total = keyed.limit(few + 1).count()
    if total <= few:
        return total, None
    counted = scratch.saved(keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), "flows")
    total = counted.agg(F.sum("n").alias("n")).first().n
    large = counted.where(F.col("n") > max(least, total // LARGE_FLOWS))
    return total, large if large.limit(1).count() else None


def segments_of_large(packets: DataFrame, large: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """The packets of the large flows with direction, segment, bucket and the columns of the flow's first packet.

    Packets are cut into ranges of (flow, time) of even size, and windows run over (flow, range).
    """
    own = with_key(packets, cfg).join(F.broadcast(large.select(*KEY)), KEY, "left_semi")
    n = _packets_of(large)
    most = BUCKETS * int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = with_range_buckets(own, max(1, min(most, n // BUCKET_PACKETS), n // TASK_PACKETS))
    return segments_over_buckets(with_flow_first_of_large(bucketed, FIRST, cfg), cfg, flow_tasks(n))


def _packets_of(large: DataFrame) -> int:
    return large.agg(F.sum("n").alias("n")).first().n


def flow_features(packets: DataFrame, cfg: FlowConfig = FlowConfig(), names: list[str] | None = None, least: int | None = None) -> DataFrame:
    """Packets to typed flow rows, one a segment. Flows of more than least packets (LARGE_PACKETS, but none up to FEW_PACKETS in all) are cut over many tasks.

    Whole flows, and the parts of cut ones, are dealt by the number of packets, so that a task's memory does not grow with the input.
    """
    total, large = _counted_flows(packets, cfg, *((LARGE_PACKETS, FEW_PACKETS) if least is None else (least, least)))
    whole = lambda p, n: segment_features(assign_segments(with_direction(p, cfg, flow_tasks(n)), cfg), cfg, names)
    if large is None:
        return whole(packets, total)
    rest = with_key(packets, cfg).join(F.broadcast(large.select(*KEY)), KEY, "left_anti").select(*packets.columns)
    n = _packets_of(large)
    return whole(rest, total - n).unionByName(segment_features(segments_of_large(packets, large, cfg), cfg, names, flow_tasks(n)))


def to_wide(flows: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """The row of 495 columns by name and order: addresses as text, bins as columns."""
    ship(flows.sparkSession)
    c = F.col
    src, dst = ip_text(c("first_src_ip"), c("ip_ver")), ip_text(c("first_dst_ip"), c("ip_ver"))
    named = flows.withColumns({"src_ip": src, "dst_ip": dst, "src_port": c("first_src_port"), "dst_port": c("first_dst_port"), "src_mac": mac_text(c("first_src_mac")), "dst_mac": mac_text(c("first_dst_mac")), "eth_proto": c("first_eth_proto")})
    named = named.withColumn("flow_id", F.concat_ws("-", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"))
    bins = {f"Hist_{d}_{i}": F.get(f"Hist_{d}", F.lit(i)) for d in ("Tot", "Fwd", "Bwd") for i in range(cfg.hist_bins)}
    return named.select(*[bins[n].alias(n) if n in bins else c(n) for n in wide_columns(cfg.hist_bins)])


def csv_rows(wide: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """The wide row as text: six decimals for times, two for other doubles, a sentinel for the minimum of nothing."""
    sentinel = 4294967295.0 if cfg == FlowConfig.as_coded() else 0.0
    doubles = [n for n, k in wide.dtypes if k == "double"]
    places = {6: [n for n in doubles if n in ("timestamp", "duration")], 2: [n for n in doubles if n not in ("timestamp", "duration")]}
    value = lambda n: F.coalesce(n, F.lit(sentinel if n.endswith("_Min") else 0.0))
    texts = {p: unused_name(f"texts{p}", wide.columns) for p in places}
    told = wide.select("*", *[fixed_texts(F.array(*map(value, names)), p).alias(texts[p]) for p, names in places.items() if names])
    at = {n: (texts[p], k) for p, names in places.items() for k, n in enumerate(names)}
    return told.select(*[(F.get(at[n][0], F.lit(at[n][1])) if n in at else F.coalesce(F.col(n).cast("string"), F.lit("0"))).alias(n) for n in wide.columns])


def unused_name(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def all_parts(parts: list[DataFrame]) -> DataFrame:
    """Tables of the same kind as one."""
    return reduce(DataFrame.unionByName, parts)
