"""The flow queries over packets and frames that are derived from the events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..config import FlowConfig
from ..functions.bytes import byte_entropy, ip_text, mac_text
from ..functions.median import histogram_median, small_median
from ..operators import deltas, dissect, features, segment
from ..schema import FLAGS, LAST, SEG, STATS, SUITES
from ..sources import packets as sources
from .fixtures import dealt_packets_v, frames_v, packets_v
from .oracle import PLACES, VARIANCE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CODED = FlowConfig.as_coded()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _hex(c: str) -> Column:
    return F.lower(F.hex(c))


def _end(ip: str, port: str) -> Column:
    return F.concat(_hex(ip), F.lpad(F.col(port).cast("string"), 5, "0"))


def _keys(*more: str) -> list[Column]:
    return [_end("a_ip", "a_port").alias("ep_a"), _end("b_ip", "b_port").alias("ep_b"), F.col("protocol"), *map(F.col, more)]


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _segmented(spark: SparkSession, sf_dir: str, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    packets = dealt_packets_v(spark, sf_dir)
    return segment.assign_segments(segment.with_direction(packets, cfg, segment.flow_tasks(packets.count())), cfg)


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.prepared(dealt_packets_v(spark, sf_dir))


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.counters(deltas.packet_deltas(deltas.with_flow_first(_segmented(spark, sf_dir))))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_v(spark, sf_dir).select("pkt_id", "ts_ns", "frame", "kind")


def _rounded(*names: str) -> list[Column]:
    return [F.expr(VARIANCE.format("Var").replace("0.0123", "0.0123D").replace("0.000000123", "0.000000123D")).alias("Var") if n == "Var" else (F.round(n, PLACES[n]) + 0.0).alias(n) for n in names]


_DOUBLES = {"timestamp": 6, "duration": 6, "flow_duration": 6, "FwdBwdPktRatio": 6, "FwdBwdByteRatio": 6, "DownUpRatio": 6, "PayloadEntropy": 6} | dict.fromkeys(("BytesRate", "FwdBytesRate", "BwdBytesRate", "PacketsRate", "FwdPacketsRate", "BwdPacketsRate"), 4)


def _told(c: str) -> Column:
    """A double of a flow row, rounded by its name."""
    name = c.rpartition("_")[2]
    if c in _DOUBLES:
        return (F.round(c, _DOUBLES[c]) + 0.0).alias(c)
    if name == "Var":
        return F.expr(VARIANCE.format(c).replace("0.0123", "0.0123D").replace("0.000000123", "0.000000123D")).alias(c)
    return F.col(c) if name in ("Max", "Min", "Mode") else (F.round(c, PLACES.get(name, 6)) + 0.0).alias(c)


# sources and sinks


@query
def packets_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "packets")
    packets_v(spark, sf_dir).write.parquet(path)
    p = sources.read_packets(spark, path)
    return p.groupBy("protocol", "ip_ver").agg(F.count(F.lit(1)).alias("n"), F.sum("payload_len").alias("bytes"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"))


@query
def packets_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {}
    for k in (0, 1):
        paths[f"eth{k}"] = scratch.new_path(spark, f"packets-{k}")
        packets_v(spark, sf_dir).where(F.col("pkt_id") % 2 == k).write.parquet(paths[f"eth{k}"])
    return sources.read_interfaces(spark, paths).groupBy("iface").agg(F.count(F.lit(1)).alias("n"), F.sum("payload_len").alias("bytes"))


@query
def frames_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "captured")
    _frames(spark, sf_dir).select("pkt_id", "ts_ns", "frame").write.parquet(path)
    n = F.length("frame").cast("bigint")
    return sources.read_frames(spark, path).select("pkt_id", "ts_ns", F.when(F.col("pkt_id") % 10 == 9, n).alias("cut_len"))


@query
def flows_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide row, with doubles rounded as in the single queries."""
    wide = features.to_wide(features.flow_features(dealt_packets_v(spark, sf_dir)))
    whole = {"tinyint", "smallint", "int", "bigint"}
    return wide.select(*[F.col(n).cast("bigint").alias(n) if k in whole and n != "protocol" else _told(n) if k == "double" else F.col(n) for n, k in wide.dtypes])


@query
def flows_csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.csv_rows(features.to_wide(features.flow_features(dealt_packets_v(spark, sf_dir))))


# dissection


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dissect.headers(_frames(spark, sf_dir))


def _fields(layer: str, *names: str) -> list[Column]:
    hexed = {"src_ip", "dst_ip", "src_mac", "dst_mac", "payload_hint"}
    return [(_hex(f"{layer}.{n}") if n in hexed else F.col(f"{layer}.{n}")).alias(n) for n in names]


@query
def decode_ethernet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir).select("pkt_id", *_fields("eth", "dst_mac", "src_mac", "eth_proto"))


def _ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dissect.ip_only(_headers(spark, sf_dir))


@query
def decode_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ip(spark, sf_dir).where("ip.ip_ver = 4").select("pkt_id", *_fields("ip", "header_len", "total_bytes", "payload_len", "ip_id", "frag_off", "ttl", "protocol", "src_ip"))


@query
def decode_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ip(spark, sf_dir).where("ip.ip_ver = 6").select("pkt_id", *_fields("ip", "traffic_class", "flow_label", "payload_len", "total_bytes", "protocol", "ttl", "src_ip", "dst_ip"))


@query
def filter_ip_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ip(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def ip_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ip(spark, sf_dir).select("pkt_id", *_fields("ip", "src_ip", "dst_ip"))


@query
def ip_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..shipping import ship

    ship(spark)
    ips = packets_v(spark, sf_dir).select("src_ip", "ip_ver").distinct()
    return ips.select(_hex("src_ip").alias("ip"), ip_text(F.col("src_ip"), F.col("ip_ver")).alias("ip_text"))


@query
def mac_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_v(spark, sf_dir).select("src_mac").distinct().select(_hex("src_mac").alias("mac"), mac_text(F.col("src_mac")).alias("mac_text"))


@query
def decode_gre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ip(spark, sf_dir).where("gre.tunnel_type = 1").select("pkt_id", *_fields("gre", "tunnel_id", "tunnel_type", "src_ip", "dst_ip", "protocol"))


@query
def decode_vxlan(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = _ip(spark, sf_dir).where("packet.tunnel_type = 2 and gre.tunnel_type = 0")
    return taken.select("pkt_id", *_fields("packet", "tunnel_id", "tunnel_type", "src_ip", "dst_ip", "protocol", "src_port", "dst_port", "tcp_flags"))


@query
def decode_gre_vxlan(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = _ip(spark, sf_dir).where("packet.tunnel_type = 2 and gre.tunnel_type = 1")
    return taken.select("pkt_id", *_fields("packet", "tunnel_id", "tunnel_type", "src_ip", "dst_ip", "protocol", "src_port"))


@query
def decode_tcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ip(spark, sf_dir).where("packet.protocol = 6").select("pkt_id", *_fields("packet", "src_port", "dst_port", "window_size", "tcp_flags"))


@query
def decode_udp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ip(spark, sf_dir).where("packet.protocol = 17").select("pkt_id", *_fields("packet", "src_port", "dst_port"))


@query
def decode_icmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ip(spark, sf_dir).where("packet.protocol = 1").select("pkt_id", *_fields("packet", "icmp_type", "icmp_code", "icmp_id", "src_port"))


@query
def l7_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ip(spark, sf_dir).select("pkt_id", "app")


def _app(spark: SparkSession, sf_dir: str, port: int, *names: str) -> DataFrame:
    return _ip(spark, sf_dir).where(f"{port} in (packet.src_port, packet.dst_port)").select("pkt_id", *_fields("packet", *names))


@query
def decode_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _app(spark, sf_dir, 53, "dns_answer_count", "dns_qtype", "dns_qclass")


@query
def decode_ntp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _app(spark, sf_dir, 123, "ntp_mode", "ntp_stratum")


@query
def decode_snmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _app(spark, sf_dir, 161, "snmp_pdu_type")


@query
def decode_ssdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _app(spark, sf_dir, 1900, "ssdp_method")


@query
def payload_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ip(spark, sf_dir).select("pkt_id", *_fields("packet", "payload_hint"))


@query
def payload_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_v(spark, sf_dir).select("pkt_id", (F.round(byte_entropy(F.col("payload_hint")), 6) + 0.0).alias("entropy"))


# keys and segments


@query
def flow_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = packets_v(spark, sf_dir).groupBy("src_ip", "src_port", "dst_ip", "dst_port", "protocol").agg(F.count(F.lit(1)).alias("n"))
    return keyed.select(_end("src_ip", "src_port").alias("s_ep"), _end("dst_ip", "dst_port").alias("d_ep"), "protocol", "n")


@query
def flow_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.with_direction(packets_v(spark, sf_dir)).select("pkt_id", *_keys("is_fwd")).drop("protocol")


@query
def flow_direction_as_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.with_direction(packets_v(spark, sf_dir), CODED).select("pkt_id", *_keys("is_fwd")).drop("protocol")


@query
def flow_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.flow_rollup(packets_v(spark, sf_dir)).select(*_keys("pkts_count", "total_bytes", "start_ts", "last_ts"), *_long("tcp_flags"))


def _segment_counts(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy(*SEG).agg(F.count(F.lit(1)).alias("n")).select(*_keys("seg_id", "n"))


@query
def segment_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment_counts(_segmented(spark, sf_dir, FlowConfig(end_flags_mask=0, flow_timeout_s=1e9)))


@query
def segment_by_fin_rst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment_counts(_segmented(spark, sf_dir, FlowConfig(max_packets=1 << 30, flow_timeout_s=1e9)))


@query
def segment_by_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment_counts(_segmented(spark, sf_dir, FlowConfig(max_packets=1 << 30, end_flags_mask=0)))


@query
def segments_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _segmented(spark, sf_dir).groupBy(*SEG).agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"))
    return cut.select(*_keys("seg_id", "n", "first_ts", "last_ts"))


@query
def segment_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir).select("pkt_id", *_keys("seg_id"))


@query
def segment_assign_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.assign_segments_in_buckets(segment.with_key(packets_v(spark, sf_dir)), bucket_s=5.0).select("pkt_id", *_keys("seg_id"))


@query
def segment_close_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.close_reasons(_segmented(spark, sf_dir)).select(*_keys("seg_id", "n", "close_reason"))


# deltas


@query
def iat_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).select("pkt_id", F.round("iat", 9).alias("iat"))


@query
def iat_directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).select("pkt_id", "is_fwd", F.round("dir_iat", 9).alias("dir_iat"))


@query
def delta_len_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).select("pkt_id", "delta_len")


@query
def delta_len_directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).select("pkt_id", "is_fwd", "dir_delta_len")


@query
def active_idle_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).where("idle_s is not null").select("pkt_id", F.round("active_s", 9).alias("active_s"), F.round("idle_s", 9).alias("idle_s"))


@query
def bulk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = segment.by_segment_direction()
    run = F.sum((F.coalesce(F.col("dir_iat"), F.lit(0.0)) >= 1.0).cast("long")).over(d)
    told = _prepared(spark, sf_dir).withColumn("run", run)
    runs = told.groupBy(*SEG, "is_fwd", "run").agg(F.max("run_pkts").alias("n"), F.max("run_bytes").alias("bytes"))
    return runs.select(*_keys("seg_id", "is_fwd", "run", "n", "bytes"))


@query
def init_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(spark, sf_dir).select(*_keys("seg_id"), F.col("FwdInitWinBytes").cast("bigint").alias("fwd_window"), F.col("BwdInitWinBytes").cast("bigint").alias("bwd_window"))


# segment aggregates


def _of_counters(*names: str) -> Query:
    return lambda spark, sf_dir: _counters(spark, sf_dir).select(*_keys("seg_id", *names))


QUERIES["packet_counts"] = _of_counters("PacketsCount", "FwdPacketsCount", "BwdPacketsCount")
QUERIES["byte_totals"] = _of_counters("TotalBytes", "FwdBytes", "BwdBytes")
QUERIES["tcp_flag_counts"] = _of_counters(*[f"{f}{d}" for f in FLAGS for d in ("_Cnt", "_Fwd_Cnt", "_Bwd_Cnt")])


@query
def suite_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.suites(_prepared(spark, sf_dir), cfg=FlowConfig(median="none")).select(*_keys("seg_id", "suite", "n", "Max", "Min"))


@query
def suite_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.suites(_prepared(spark, sf_dir), cfg=FlowConfig(median="none")).select(*_keys("seg_id", "suite"), *_rounded("Mean", "Std", "Var", "Skew", "Kurt", "CoV"))


@query
def suite_medians_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.suites(_prepared(spark, sf_dir), cfg=FlowConfig(median="exact")).select(*_keys("seg_id", "suite"), F.round("Median", 6).alias("Median"))


@query
def suite_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constant mode of the row, and how often the exact mode occurs."""
    prepared = _prepared(spark, sf_dir)
    names = ["Tot_Hdr", "TTL_Var"]
    constant = features.suites(prepared, names, FlowConfig(median="none")).select(*SEG, "suite", "Mode")
    exact = features.suites(prepared, names, FlowConfig(median="none", exact_mode=True)).select(*SEG, "suite", F.col("Mode").alias("exact"))
    values = prepared.select(*SEG, F.inline(features.suite_values(names)))
    from ..schema import SUITES

    values = values.withColumn("suite", F.get(F.array(*map(F.lit, SUITES)), F.col("suite")))
    joined = constant.join(exact, [*SEG, "suite"]).join(values, [*SEG, "suite"])
    most = F.sum((F.col("x") == F.col("exact")).cast("long"))
    return joined.groupBy(*SEG, "suite", "Mode").agg(most.alias("most")).select(*_keys("seg_id", "suite", "Mode", "most"))


@query
def payload_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = features.histograms(_prepared(spark, sf_dir))
    return told.select(*_keys("seg_id"), *[F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("Hist_Tot", "Hist_Fwd", "Hist_Bwd")])


@query
def histogram_median_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = features.histograms(_prepared(spark, sf_dir))
    return told.select(*_keys("seg_id"), F.round(histogram_median(F.col("Hist_Tot"), 20), 6).alias("median"))


QUERIES["histogram_median"] = QUERIES.pop("histogram_median_query")


@query
def p2_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.suites(_prepared(spark, sf_dir)).select(*_keys("seg_id", "suite", "n"), F.round("Median", 6).alias("Median"))


@query
def p2_median_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..schema import SUITES

    values = _prepared(spark, sf_dir).select(*SEG, F.inline(features.suite_values(SUITES))).where("x is not null")
    held = values.groupBy(*SEG, "suite").agg(F.collect_list("x").alias("xs")).where(F.size("xs") <= 5)
    return held.select(*_keys("seg_id"), F.get(F.array(*map(F.lit, SUITES)), F.col("suite")).alias("suite"), small_median(F.col("xs")).alias("median"))


@query
def flow_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(spark, sf_dir).select(*_keys("seg_id"), *[F.round(c, 6).alias(c) for c in ("FwdBwdPktRatio", "FwdBwdByteRatio", "DownUpRatio")])


@query
def flow_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(spark, sf_dir).select(*_keys("seg_id"), *[F.round(c, 4).alias(c) for c in ("BytesRate", "FwdBytesRate", "BwdBytesRate", "PacketsRate", "FwdPacketsRate", "BwdPacketsRate")])


@query
def flow_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(spark, sf_dir).select(*_keys("seg_id"), *[F.round(c, 6).alias(c) for c in ("timestamp", "duration", "flow_duration")], "start_ts_ns")


@query
def last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(spark, sf_dir).select(*_keys("seg_id"), *[F.col(n).cast("bigint").alias(c) for c, n in LAST.items()])


@query
def flow_first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(spark, sf_dir).select(*_keys("seg_id"), _hex("first_src_mac").alias("first_src_mac"), *_long("first_eth_proto", "traffic_class", "flow_label"))


@query
def flow_id_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..shipping import ship

    ship(spark)
    p = packets_v(spark, sf_dir).select("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ip_ver").distinct()
    text = [ip_text(F.col(c), F.col("ip_ver")) for c in ("src_ip", "dst_ip")]
    return p.select(F.concat_ws("-", *text, "src_port", "dst_port", "protocol").alias("flow_id"))


@query
def bulk_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counters(spark, sf_dir)
    told = lambda d: F.struct(F.lit(d == "Fwd").alias("is_fwd"), F.col(f"{d}PacketsCount").alias("k"), *[F.col(f"{d}Bulk{x}").alias(f"bulk_{x.lower()}") for x in ("Bytes", "Pkts", "Cnt")])
    return c.select(*SEG, F.inline(F.array(told("Fwd"), told("Bwd")))).where("k > 0").select(*_keys("seg_id", "is_fwd", "bulk_bytes", "bulk_pkts", "bulk_cnt"))


@query
def active_idle_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.suites(_prepared(spark, sf_dir), ["Active", "Idle"], FlowConfig(median="none")).select(*_keys("seg_id", "suite", "n"), *_rounded("Mean", "Std", "Var", "Skew", "Kurt", "CoV"))


@query
def flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow row, with addresses as text and doubles rounded as in the single queries."""
    rows = features.flow_features(dealt_packets_v(spark, sf_dir))
    whole = ["PacketsCount", "FwdPacketsCount", "BwdPacketsCount", "TotalBytes", "FwdBytes", "BwdBytes", "start_ts_ns", "FwdInitWinBytes", "BwdInitWinBytes", "traffic_class", "flow_label", *[f"{f}{d}" for f in FLAGS for d in ("_Cnt", "_Fwd_Cnt", "_Bwd_Cnt")], *[f"{d}Bulk{c}" for d in ("Fwd", "Bwd") for c in ("Bytes", "Pkts", "Cnt")]]
    hist = [F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("Hist_Tot", "Hist_Fwd", "Hist_Bwd")]
    return rows.select(*_keys("seg_id"), *_long(*whole), *[F.col(n).cast("bigint").alias(c) for c, n in LAST.items()], *map(_told, _DOUBLES), *hist, *[_told(f"{s}_{t}") for s in SUITES for t in STATS])
