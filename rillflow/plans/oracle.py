"""DuckDB SQL of the flow queries, over the same events table."""

from __future__ import annotations

from ..schema import LAST, STATS, SUITES, wide_columns
from .fixtures import PACKETS_SQL

_FLOW = "PARTITION BY ep_a, ep_b, protocol ORDER BY ts_ns, pkt_id"
_SEG = "PARTITION BY ep_a, ep_b, protocol, seg_id ORDER BY ts_ns, pkt_id"
_DIR = "PARTITION BY ep_a, ep_b, protocol, seg_id, is_fwd ORDER BY ts_ns, pkt_id"
K = "ep_a, ep_b, protocol, seg_id"

SEGMENTS = f"""WITH {PACKETS_SQL},
k AS (SELECT *, src_ip || lpad(src_port::VARCHAR, 5, '0') AS s_ep, dst_ip || lpad(dst_port::VARCHAR, 5, '0') AS d_ep FROM p),
d AS (SELECT *, least(s_ep, d_ep) AS ep_a, greatest(s_ep, d_ep) AS ep_b FROM k),
w AS (SELECT *, first_value(s_ep) OVER f = s_ep AS is_fwd, ts_ns - lag(ts_ns) OVER f AS gap, lag(tcp_flags) OVER f AS before,
  lead(ts_ns) OVER f AS next_ts, row_number() OVER f AS rn FROM d WINDOW f AS ({_FLOW})),
s1 AS (SELECT *, gap IS NULL OR gap > 60000000000 OR (before & 5) <> 0 AS st FROM w),
s2 AS (SELECT *, CASE WHEN (rn - max(CASE WHEN st THEN rn END) OVER f) % 50 = 0 THEN 1 ELSE 0 END AS nw FROM s1 WINDOW f AS ({_FLOW})),
s AS (SELECT *, CAST(sum(nw) OVER f - 1 AS BIGINT) AS seg_id FROM s2 WINDOW f AS ({_FLOW}))"""

DELTAS = f"""{SEGMENTS},
x1 AS (SELECT *, lag(ts_ns) OVER a AS p_ts, lag(payload_len) OVER a AS p_len, lead(ts_ns) OVER a IS NULL AS is_last,
  lag(ts_ns) OVER b AS d_ts, lag(payload_len) OVER b AS d_len, lead(ts_ns) OVER b IS NULL AS dir_last FROM s WINDOW a AS ({_SEG}), b AS ({_DIR})),
x2 AS (SELECT *, (ts_ns - p_ts) / 1e9 AS iat, (ts_ns - d_ts) / 1e9 AS dir_iat, abs(payload_len - p_len) AS delta_len,
  abs(payload_len - d_len) AS dir_delta_len, p_ts IS NULL AS is_first, least(payload_len // 20, 79) AS hist_bin FROM x1),
x3 AS (SELECT *, max(CASE WHEN is_first OR iat > 1.0 THEN ts_ns END) OVER a AS active_start,
  count(d_ts) OVER b AS r_n FROM x2 WINDOW a AS ({_SEG}), b AS ({_DIR})),
x AS (SELECT *, CASE WHEN iat > 1.0 THEN iat END AS idle_s,
  CASE WHEN iat > 1.0 THEN (p_ts - lag(active_start) OVER a) / 1e9 END AS active_s FROM x3 WINDOW a AS ({_SEG})),
r1 AS (SELECT *, sum(CASE WHEN dir_iat >= 1.0 THEN 1 ELSE 0 END) OVER b AS run FROM x WINDOW b AS ({_DIR})),
r2 AS (SELECT {K}, is_fwd, run, count(d_ts) AS n, coalesce(sum(CASE WHEN d_ts IS NOT NULL THEN payload_len END), 0) AS bytes,
  max(run) OVER (PARTITION BY {K}, is_fwd) AS last_run FROM r1 GROUP BY {K}, is_fwd, run),
bulk AS (SELECT {K}, is_fwd, CAST(sum(CASE WHEN run = last_run THEN bytes ELSE 0 END) AS BIGINT) AS bulk_bytes,
  CAST(sum(CASE WHEN run = last_run THEN n ELSE 0 END) AS BIGINT) AS bulk_pkts,
  CAST(count(CASE WHEN run < last_run AND n >= 3 THEN 1 END) AS BIGINT) AS bulk_cnt FROM r2 GROUP BY {K}, is_fwd)"""

_VALUES = " UNION ALL ".join(
    [f"SELECT {K}, ts_ns, pkt_id, '{d}_{s}' AS suite, CAST({c} AS DOUBLE) AS x FROM x WHERE {c} IS NOT NULL{w}" for s, t, k in (("Pay", "payload_len", "payload_len"), ("Hdr", "header_len", "header_len"), ("IAT", "iat", "dir_iat"), ("DeltaLen", "delta_len", "dir_delta_len")) for d, c, w in (("Tot", t, ""), ("Fwd", k, " AND is_fwd"), ("Bwd", k, " AND NOT is_fwd"))]
    + [f"SELECT {K}, ts_ns, pkt_id, '{s}' AS suite, CAST({c} AS DOUBLE) AS x FROM x WHERE {c} IS NOT NULL" for s, c in (("Win", "window_size"), ("IpId", "ip_id"), ("Frag", "frag_off"), ("TTL_Var", "ttl"), ("Active", "active_s"), ("Idle", "idle_s"))]
)
SUITE_VALUES = f"{DELTAS}, v AS ({_VALUES})"
_MEAN = f"c AS (SELECT *, avg(x) OVER (PARTITION BY {K}, suite) AS m FROM v)"
MOMENTS = f"""{SUITE_VALUES}, {_MEAN},
t AS (SELECT {K}, suite, count(*) AS n, max(x) AS hi, min(x) AS lo, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS std, coalesce(var_samp(x), 0) AS var,
  sum((x - m) ** 2) AS m2, sum((x - m) ** 3) AS m3, sum((x - m) ** 4) AS m4, median(x) AS med FROM c GROUP BY {K}, suite),
u AS (SELECT *, CASE WHEN m2 > 1e-9 THEN sqrt(n) * m3 / (m2 ** 1.5) ELSE 0 END AS skew,
  CASE WHEN m2 > 1e-9 THEN n * m4 / (m2 * m2) - 3 ELSE 0 END AS kurt, CASE WHEN mean > 0 THEN std / mean ELSE 0 END AS cov FROM t)"""

#: The same with two passes over each suite's values in order of time, so that sums do not depend on an engine's own order.
_D = "(y - mean)"
ORDERED = f"""{SUITE_VALUES},
o1 AS (SELECT {K}, suite, list(x ORDER BY ts_ns, pkt_id) AS xs FROM v GROUP BY {K}, suite),
o2 AS (SELECT *, len(xs) AS n, list_reduce(xs, lambda a, y: a + y, 0.0::DOUBLE) / len(xs) AS mean FROM o1),
o3 AS (SELECT *, list_reduce(xs, lambda a, y: a + {_D} * {_D}, 0.0::DOUBLE) AS m2, list_reduce(xs, lambda a, y: a + {_D} * {_D} * {_D}, 0.0::DOUBLE) AS m3,
  list_reduce(xs, lambda a, y: a + {_D} * {_D} * {_D} * {_D}, 0.0::DOUBLE) AS m4 FROM o2),
t AS (SELECT {K}, suite, xs, n, list_max(xs) AS hi, list_min(xs) AS lo, mean, m2, m3, m4, CASE WHEN n > 1 THEN m2 / (n - 1) ELSE 0.0::DOUBLE END AS var FROM o3),
u AS (SELECT *, sqrt(var) AS std, CASE WHEN m2 > 1e-9 THEN sqrt(n) * m3 / (m2 * sqrt(m2)) ELSE 0.0::DOUBLE END AS skew,
  CASE WHEN m2 > 1e-9 THEN n * m4 / (m2 * m2) - 3 ELSE 0.0::DOUBLE END AS kurt, CASE WHEN mean > 0 THEN sqrt(var) / mean ELSE 0.0::DOUBLE END AS cov FROM t)"""

#: Rounding of doubles by statistic: coarse where values are large, as sums of other orders differ in the last bits;
#: variances are moved off the ties that whole numbers give.
PLACES = {"Mean": 4, "Std": 3, "Skew": 4, "Kurt": 4, "CoV": 4}
VARIANCE = "CASE WHEN {0} > 10000 THEN round({0} + 0.0123, 0) ELSE round({0} + 0.000000123, 5) END"
_ROUNDED = ", ".join(f'round({c}, {PLACES[n]}) + 0.0 AS "{n}"' for n, c in (("Mean", "mean"), ("Std", "std"), ("Skew", "skew"), ("Kurt", "kurt"), ("CoV", "cov"))) + f', {VARIANCE.format("var")} AS "Var"'

COUNTS = f"""{DELTAS},
n AS (SELECT {K}, count(*) AS pkts, count(*) FILTER (is_fwd) AS fp, count(*) FILTER (NOT is_fwd) AS bp, CAST(sum(payload_len) AS BIGINT) AS bytes,
  CAST(coalesce(sum(payload_len) FILTER (is_fwd), 0) AS BIGINT) AS fb, CAST(coalesce(sum(payload_len) FILTER (NOT is_fwd), 0) AS BIGINT) AS bb,
  min(ts_ns) AS t0, max(ts_ns) AS t1, max(active_start) FILTER (is_last) AS act FROM x GROUP BY {K}),
q AS (SELECT *, CASE WHEN t1 > act THEN (t1 - act) / 1e9 ELSE 0.001 END AS dur FROM n)"""

HISTOGRAM = f"""{DELTAS},
h1 AS (SELECT {K}, list(hist_bin) AS a, coalesce(list(hist_bin) FILTER (is_fwd), []) AS f, coalesce(list(hist_bin) FILTER (NOT is_fwd), []) AS b FROM x GROUP BY {K})"""


def bin_counts(column: str) -> str:
    return f"array_to_string(list_transform(range(80), lambda i: len(list_filter({column}, lambda y: y = i))), ',')"


FRAMES = f"""WITH {PACKETS_SQL},
fr1 AS (SELECT *, ip_ver = 4 AND protocol <> 1 AS thru,
  (['plain', 'gre_key', 'gre_sum_key', 'gre', 'vxlan_udp', 'vxlan_tcp', 'gre_vxlan', 'arp', 'vlan', 'short'])[pkt_id % 10 + 1] AS kind0 FROM p),
fr AS (SELECT *, CASE WHEN pkt_id % 10 BETWEEN 1 AND 6 AND NOT thru THEN 'plain' WHEN kind0 = 'vxlan_udp' AND protocol <> 17 THEN 'vxlan_tcp'
  WHEN kind0 = 'vxlan_tcp' AND protocol = 17 THEN 'vxlan_udp' ELSE kind0 END AS kind, CASE WHEN kind0 = 'short' THEN pkt_id % 97 ELSE 1000 END AS cut,
  CASE WHEN kind0 IN ('arp', 'vlan', 'short', 'plain') OR NOT thru THEN 0 WHEN kind0 IN ('vxlan_udp', 'vxlan_tcp') THEN 17 ELSE 47 END AS outer_proto FROM fr1)"""

#: Frames that give a packet, with what is there of a short one: bytes behind the IP header (l4) and the UDP header, and ports.
DECODED = f"""{FRAMES},
d1 AS (SELECT *, cut - 14 - header_len AS l4, outer_proto > 0 AND kind NOT LIKE 'gre%' OR kind = 'gre_vxlan' AS vx FROM fr WHERE kind NOT IN ('arp', 'vlan') AND cut >= 14 + header_len),
d2 AS (SELECT *, protocol = 6 AND NOT vx AND l4 >= 20 AS is_tcp, protocol = 17 AND l4 >= 8 AS is_udp FROM d1),
de AS (SELECT * EXCLUDE (src_port, dst_port), src_port AS own_src, dst_port AS own_dst, CASE WHEN is_tcp OR is_udp THEN src_port WHEN vx THEN 49152 ELSE 0 END AS src_port,
  CASE WHEN is_tcp OR is_udp THEN dst_port WHEN vx THEN 4789 ELSE 0 END AS dst_port, l4 - 8 AS l7 FROM d2)"""
_DATA = """CASE WHEN protocol = 6 THEN printf('%04x%04x', own_src, own_dst) || '0000000000000000' || '50' || printf('%02x%04x', tcp_flags, window_size) || '00000000'
  WHEN protocol = 1 THEN printf('%02x%02x0000%04x0000', icmp_type, icmp_code, icmp_id)
  WHEN 53 IN (own_src, own_dst) THEN printf('000100000001%04x00000000', dns_answer_count) || '03777777076578616d706c6503636f6d00' || printf('%04x%04x', dns_qtype, dns_qclass)
  WHEN 123 IN (own_src, own_dst) THEN printf('%02x%02x0000', ntp_mode + 24, ntp_stratum) WHEN 161 IN (own_src, own_dst) THEN '302902010104067075626c6963' || printf('%02x00', snmp_pdu_type)
  WHEN ssdp_method = 1 THEN '4d2d534541524348' ELSE '4e4f54494659202a' END || payload_hint"""
_there = lambda c, bytes_: f"CAST(CASE WHEN l7 >= {bytes_} THEN {c} ELSE 0 END AS BIGINT) AS {c}"

_FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")
_LAST = ("icmp_type", "icmp_code", "ttl", "icmp_id", "dns_answer_count", "dns_qtype", "dns_qclass", "tunnel_id", "tunnel_type", "ntp_mode", "ntp_stratum", "snmp_pdu_type", "ssdp_method")
_group = lambda c: f"coalesce(nullif(ltrim(substr(src_ip, {c}, 4), '0'), ''), '0')"
_IP = f"CASE WHEN ip_ver = 4 THEN concat_ws('.', ('0x' || substr(src_ip, 25, 2))::INT, ('0x' || substr(src_ip, 27, 2))::INT, ('0x' || substr(src_ip, 29, 2))::INT, ('0x' || substr(src_ip, 31, 2))::INT) ELSE 'fd00::' || {_group(25)} || ':' || {_group(29)} END"
_MAC = "concat_ws(':', " + ", ".join(f"substr(src_mac, {i}, 2)" for i in range(1, 12, 2)) + ")"

SQL: dict[str, str] = {
    "packets_scan": f"WITH {PACKETS_SQL} SELECT protocol, ip_ver, count(*) AS n, CAST(sum(payload_len) AS BIGINT) AS bytes, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts FROM p GROUP BY protocol, ip_ver",
    "packets_multi_source": f"WITH {PACKETS_SQL} SELECT CASE WHEN pkt_id % 2 = 0 THEN 'eth0' ELSE 'eth1' END AS iface, count(*) AS n, CAST(sum(payload_len) AS BIGINT) AS bytes FROM p GROUP BY 1",
    "frames_scan": f"{FRAMES} SELECT pkt_id, ts_ns, CAST(CASE WHEN kind = 'short' THEN cut END AS BIGINT) AS cut_len FROM fr",
    "decode_ethernet": f"{FRAMES} SELECT pkt_id, dst_mac, src_mac, CAST(CASE kind WHEN 'arp' THEN 2054 WHEN 'vlan' THEN 33024 ELSE eth_proto END AS BIGINT) AS eth_proto FROM fr WHERE cut >= 14",
    "decode_ipv4": f"{FRAMES} SELECT pkt_id, CAST(header_len AS BIGINT) AS header_len, CAST(total_bytes AS BIGINT) AS total_bytes, CAST(payload_len AS BIGINT) AS payload_len, CAST(ip_id AS BIGINT) AS ip_id, CAST(frag_off AS BIGINT) AS frag_off, CAST(ttl AS BIGINT) AS ttl, CAST(CASE WHEN outer_proto > 0 THEN outer_proto ELSE protocol END AS BIGINT) AS protocol, CASE WHEN outer_proto > 0 THEN repeat('00', 12) || '0a090901' ELSE src_ip END AS src_ip FROM fr WHERE ip_ver = 4 AND kind NOT IN ('arp', 'vlan') AND cut >= 34",
    "decode_ipv6": f"{FRAMES} SELECT pkt_id, CAST(traffic_class AS BIGINT) AS traffic_class, CAST(flow_label AS BIGINT) AS flow_label, CAST(payload_len AS BIGINT) AS payload_len, CAST(total_bytes AS BIGINT) AS total_bytes, CAST(protocol AS BIGINT) AS protocol, CAST(ttl AS BIGINT) AS ttl, src_ip, dst_ip FROM fr WHERE ip_ver = 6 AND kind IN ('plain', 'short') AND cut >= 54",
    "filter_ip_only": f"{FRAMES} SELECT kind, count(*) AS n FROM fr WHERE kind NOT IN ('arp', 'vlan') AND cut >= CASE WHEN ip_ver = 4 THEN 34 ELSE 54 END GROUP BY kind",
    "ip_normalize": f"{DECODED} SELECT pkt_id, CASE WHEN outer_proto > 0 THEN repeat('00', 12) || '0a090901' ELSE src_ip END AS src_ip, CASE WHEN outer_proto > 0 THEN repeat('00', 12) || '0a090902' ELSE dst_ip END AS dst_ip FROM de",
    "ip_format": f"WITH {PACKETS_SQL} SELECT DISTINCT src_ip AS ip, {_IP} AS ip_text FROM p",
    "mac_format": f"WITH {PACKETS_SQL} SELECT DISTINCT src_mac AS mac, {_MAC} AS mac_text FROM p",
    "decode_gre": f"{FRAMES} SELECT pkt_id, CAST(CASE WHEN kind = 'gre' THEN 0 ELSE pkt_id % 4294967296 END AS BIGINT) AS tunnel_id, CAST(1 AS BIGINT) AS tunnel_type, CASE WHEN kind = 'gre_vxlan' THEN repeat('00', 12) || '0a080801' ELSE src_ip END AS src_ip, CASE WHEN kind = 'gre_vxlan' THEN repeat('00', 12) || '0a080802' ELSE dst_ip END AS dst_ip, CAST(CASE WHEN kind = 'gre_vxlan' THEN 17 ELSE protocol END AS BIGINT) AS protocol FROM fr WHERE kind IN ('gre', 'gre_key', 'gre_sum_key', 'gre_vxlan')",
    "decode_vxlan": f"{FRAMES} SELECT pkt_id, CAST(pkt_id % 16777216 AS BIGINT) AS tunnel_id, CAST(2 AS BIGINT) AS tunnel_type, src_ip, dst_ip, CAST(protocol AS BIGINT) AS protocol, CAST(CASE WHEN protocol = 17 THEN src_port ELSE 49152 END AS BIGINT) AS src_port, CAST(CASE WHEN protocol = 17 THEN dst_port ELSE 4789 END AS BIGINT) AS dst_port, CAST(0 AS BIGINT) AS tcp_flags FROM fr WHERE kind IN ('vxlan_udp', 'vxlan_tcp')",
    "decode_gre_vxlan": f"{FRAMES} SELECT pkt_id, CAST(pkt_id % 16777216 AS BIGINT) AS tunnel_id, CAST(2 AS BIGINT) AS tunnel_type, src_ip, dst_ip, CAST(protocol AS BIGINT) AS protocol, CAST(CASE WHEN protocol = 17 THEN src_port ELSE 49152 END AS BIGINT) AS src_port FROM fr WHERE kind = 'gre_vxlan'",
    "decode_tcp": f"{DECODED} SELECT pkt_id, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, CAST(CASE WHEN is_tcp THEN window_size ELSE 0 END AS BIGINT) AS window_size, CAST(CASE WHEN is_tcp THEN tcp_flags ELSE 0 END AS BIGINT) AS tcp_flags FROM de WHERE protocol = 6",
    "decode_udp": f"{DECODED} SELECT pkt_id, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port FROM de WHERE protocol = 17",
    "decode_icmp": f"{DECODED} SELECT pkt_id, " + ", ".join(f"CAST(CASE WHEN l4 >= 8 THEN {c} ELSE 0 END AS BIGINT) AS {c}" for c in ("icmp_type", "icmp_code", "icmp_id")) + ", CAST(src_port AS BIGINT) AS src_port FROM de WHERE protocol = 1",
    "l7_dispatch": f"{DECODED} SELECT pkt_id, CASE WHEN NOT is_udp THEN 'none' WHEN 53 IN (src_port, dst_port) THEN 'dns' WHEN 123 IN (src_port, dst_port) THEN 'ntp' WHEN 161 IN (src_port, dst_port) THEN 'snmp' WHEN dst_port = 1900 THEN 'ssdp' ELSE 'none' END AS app FROM de",
    "decode_dns": f"{DECODED} SELECT pkt_id, {_there('dns_answer_count', 12)}, {_there('dns_qtype', 33)}, {_there('dns_qclass', 33)} FROM de WHERE 53 IN (src_port, dst_port)",
    "decode_ntp": f"{DECODED} SELECT pkt_id, {_there('ntp_mode', 4)}, {_there('ntp_stratum', 4)} FROM de WHERE 123 IN (src_port, dst_port)",
    "decode_snmp": f"{DECODED} SELECT pkt_id, {_there('snmp_pdu_type', 14)} FROM de WHERE 161 IN (src_port, dst_port)",
    "decode_ssdp": f"{DECODED} SELECT pkt_id, {_there('ssdp_method', 8)} FROM de WHERE 1900 IN (src_port, dst_port)",
    "payload_hint": f"{DECODED} SELECT pkt_id, CASE WHEN kind = 'short' THEN repeat('00', 64) ELSE substr({_DATA}, 1, 128) END AS payload_hint FROM de",
    "payload_entropy": f"WITH {PACKETS_SQL}, b AS (SELECT pkt_id, unnest(list_transform(range(64), lambda i: substr(payload_hint, 2 * i + 1, 2))) AS x FROM p), c AS (SELECT pkt_id, x, count(*) / 64.0 AS s FROM b GROUP BY pkt_id, x) SELECT pkt_id, round(-sum(s * log2(s)), 6) + 0.0 AS entropy FROM c GROUP BY pkt_id",
    "flow_key_counts": f"{SEGMENTS} SELECT s_ep, d_ep, protocol, count(*) AS n FROM d GROUP BY s_ep, d_ep, protocol",
    "flow_direction": f"{SEGMENTS} SELECT pkt_id, ep_a, ep_b, is_fwd FROM w",
    "flow_direction_as_coded": f"{SEGMENTS} SELECT pkt_id, s_ep AS ep_a, d_ep AS ep_b, false AS is_fwd FROM w",
    "flow_rollup": f"{SEGMENTS} SELECT s_ep AS ep_a, d_ep AS ep_b, protocol, count(*) AS pkts_count, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, min(ts_ns) AS start_ts, max(ts_ns) AS last_ts, CAST(bit_or(tcp_flags::INT) AS BIGINT) AS tcp_flags FROM d GROUP BY s_ep, d_ep, protocol",
    "segment_by_count": f"{SEGMENTS} SELECT ep_a, ep_b, protocol, CAST((rn - 1) // 50 AS BIGINT) AS seg_id, count(*) AS n FROM w GROUP BY ALL",
    "segment_by_fin_rst": f"{SEGMENTS}, o AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR (before & 5) <> 0 THEN 1 ELSE 0 END) OVER ({_FLOW}) - 1 AS BIGINT) AS sid FROM w) SELECT ep_a, ep_b, protocol, sid AS seg_id, count(*) AS n FROM o GROUP BY ALL",
    "segment_by_idle": f"{SEGMENTS}, o AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 60000000000 THEN 1 ELSE 0 END) OVER ({_FLOW}) - 1 AS BIGINT) AS sid FROM w) SELECT ep_a, ep_b, protocol, sid AS seg_id, count(*) AS n FROM o GROUP BY ALL",
    "segments_all": f"{SEGMENTS} SELECT {K}, count(*) AS n, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts FROM s GROUP BY {K}",
    "segment_assign": f"{SEGMENTS} SELECT pkt_id, {K} FROM s",
    "segment_assign_bucketed": f"{SEGMENTS} SELECT pkt_id, {K} FROM s",
    "segment_close_reason": f"{SEGMENTS}, c AS (SELECT *, count(*) OVER (PARTITION BY {K}) AS n, lead(ts_ns) OVER ({_SEG}) IS NULL AS is_last FROM s) SELECT {K}, n, CASE WHEN (tcp_flags & 5) <> 0 THEN 'flags' WHEN n >= 50 THEN 'count' WHEN next_ts IS NOT NULL THEN 'idle' ELSE 'end' END AS close_reason FROM c WHERE is_last",
    "iat_total": f"{DELTAS} SELECT pkt_id, round(iat, 9) AS iat FROM x",
    "iat_directional": f"{DELTAS} SELECT pkt_id, is_fwd, round(dir_iat, 9) AS dir_iat FROM x",
    "delta_len_total": f"{DELTAS} SELECT pkt_id, delta_len FROM x",
    "delta_len_directional": f"{DELTAS} SELECT pkt_id, is_fwd, dir_delta_len FROM x",
    "active_idle_periods": f"{DELTAS} SELECT pkt_id, round(active_s, 9) AS active_s, round(idle_s, 9) AS idle_s FROM x WHERE idle_s IS NOT NULL",
    "bulk_runs": f"{DELTAS} SELECT {K}, is_fwd, CAST(run AS BIGINT) AS run, n, CAST(bytes AS BIGINT) AS bytes FROM r2",
    "init_window": f"{DELTAS} SELECT {K}, CAST(coalesce(arg_min(window_size, ts_ns) FILTER (is_fwd), 0) AS BIGINT) AS fwd_window, CAST(coalesce(arg_min(window_size, ts_ns) FILTER (NOT is_fwd), 0) AS BIGINT) AS bwd_window FROM x GROUP BY {K}",
    "packet_counts": f'{COUNTS} SELECT {K}, pkts AS "PacketsCount", fp AS "FwdPacketsCount", bp AS "BwdPacketsCount" FROM q',
    "suite_extrema": f'{MOMENTS} SELECT {K}, suite, n, CAST(floor(hi) AS DOUBLE) AS "Max", CAST(floor(lo) AS DOUBLE) AS "Min" FROM u',
    "suite_moments": f"{MOMENTS} SELECT {K}, suite, {_ROUNDED} FROM u",
    "suite_mode": f"{SUITE_VALUES}, c AS (SELECT {K}, suite, x, count(*) AS n FROM v WHERE suite IN ('Tot_Hdr', 'TTL_Var') GROUP BY {K}, suite, x), m AS (SELECT {K}, suite, max(n) AS n FROM c GROUP BY {K}, suite) SELECT {K}, suite, 0.0::DOUBLE AS \"Mode\", n AS most FROM m",
    "payload_histogram": f'{HISTOGRAM} SELECT {K}, {bin_counts("a")} AS "Hist_Tot", {bin_counts("f")} AS "Hist_Fwd", {bin_counts("b")} AS "Hist_Bwd" FROM h1',
    "histogram_median": f"{DELTAS}, b AS (SELECT {K}, hist_bin, count(*) AS h FROM x GROUP BY {K}, hist_bin), c AS (SELECT *, sum(h) OVER (PARTITION BY {K} ORDER BY hist_bin) AS acc, (sum(h) OVER (PARTITION BY {K}) + 1) // 2 AS half FROM b) SELECT {K}, round(arg_min(hist_bin * 20 + 20.0 * (half - (acc - h)) / h, hist_bin), 6) AS median FROM c WHERE acc >= half GROUP BY {K}",
    "tcp_flag_counts": f"{DELTAS} SELECT {K}, " + ", ".join(f'count(*) FILTER ((tcp_flags & {1 << i}) <> 0) AS "{n}_Cnt", count(*) FILTER ((tcp_flags & {1 << i}) <> 0 AND is_fwd) AS "{n}_Fwd_Cnt", count(*) FILTER ((tcp_flags & {1 << i}) <> 0 AND NOT is_fwd) AS "{n}_Bwd_Cnt"' for i, n in enumerate(_FLAGS)) + f" FROM x GROUP BY {K}",
    "p2_median_small": f"{SUITE_VALUES}, c AS (SELECT {K}, suite, list_sort(list(x)) AS xs FROM v GROUP BY {K}, suite) SELECT {K}, suite, xs[len(xs) // 2 + 1] AS median FROM c WHERE len(xs) <= 5",
    "byte_totals": f'{COUNTS} SELECT {K}, bytes AS "TotalBytes", fb AS "FwdBytes", bb AS "BwdBytes" FROM q',
    "flow_ratios": f'{COUNTS} SELECT {K}, round(CASE WHEN bp > 0 THEN fp / bp ELSE fp END, 6) AS "FwdBwdPktRatio", round(CASE WHEN bb > 0 THEN fb / bb ELSE fb END, 6) AS "FwdBwdByteRatio", round(CASE WHEN fp > 0 THEN bp / fp ELSE 0 END, 6) AS "DownUpRatio" FROM q',
    "flow_rates": f'{COUNTS} SELECT {K}, ' + ", ".join(f'round({c} / dur, 4) AS "{n}"' for c, n in (("bytes", "BytesRate"), ("fb", "FwdBytesRate"), ("bb", "BwdBytesRate"), ("pkts", "PacketsRate"), ("fp", "FwdPacketsRate"), ("bp", "BwdPacketsRate"))) + " FROM q",
    "flow_timing": f'{COUNTS} SELECT {K}, round(t1 / 1e9, 6) AS "timestamp", round(dur, 6) AS duration, round((t1 - t0) / 1e9, 6) AS flow_duration, t0 AS start_ts_ns FROM q',
    "last_values": f"{DELTAS} SELECT {K}, " + ", ".join(f"CAST(arg_max({c}, ts_ns) AS BIGINT) AS {c}" for c in _LAST) + f" FROM x GROUP BY {K}",
    "flow_first_values": f"{DELTAS}, o AS (SELECT *, first_value(src_mac) OVER f AS first_src_mac, first_value(eth_proto) OVER f AS first_eth_proto FROM x WINDOW f AS ({_FLOW})) SELECT {K}, first_src_mac, CAST(max(first_eth_proto) AS BIGINT) AS first_eth_proto, CAST(arg_min(traffic_class, ts_ns) AS BIGINT) AS traffic_class, CAST(arg_min(flow_label, ts_ns) AS BIGINT) AS flow_label FROM o GROUP BY {K}, first_src_mac",
    "bulk_features": f"{DELTAS} SELECT {K}, is_fwd, bulk_bytes, bulk_pkts, bulk_cnt FROM bulk",
    "active_idle_suites": f"{MOMENTS} SELECT {K}, suite, n, {_ROUNDED} FROM u WHERE suite IN ('Active', 'Idle')",
    "suite_medians_exact": f"{MOMENTS} SELECT {K}, suite, round(med, 6) AS \"Median\" FROM u",
}
SQL["flow_id_format"] = f"""{SEGMENTS}, t AS (SELECT *, {_IP} AS src_text, {_IP.replace("src_ip", "dst_ip")} AS dst_text FROM p)
SELECT DISTINCT concat_ws('-', src_text, dst_text, src_port, dst_port, protocol) AS flow_id FROM t"""


def _marker(i: int, inner: str) -> str:
    """One step of the P-square rule for marker i (2 to 4), as a subquery over inner: parabola if it keeps the order, else a line."""
    a, b, e = i - 1, i, i + 1
    s = f"CASE WHEN 1 + {i - 1} * c / 4.0::DOUBLE - n{b} >= 1 AND n{e} - n{b} > 1 THEN 1.0::DOUBLE WHEN 1 + {i - 1} * c / 4.0::DOUBLE - n{b} <= -1 AND n{a} - n{b} < -1 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END"
    curve = f"q{b} + s / (n{e} - n{a}) * ((n{b} - n{a} + s) * (q{e} - q{b}) / (n{e} - n{b}) + (n{e} - n{b} - s) * (q{b} - q{a}) / (n{b} - n{a}))"
    line = f"q{b} + s * ((CASE WHEN s > 0 THEN q{e} ELSE q{a} END) - q{b}) / ((CASE WHEN s > 0 THEN n{e} ELSE n{a} END) - n{b})"
    moved = f"SELECT *, CASE WHEN s <> 0 THEN {curve} END AS p FROM (SELECT *, {s} AS s FROM ({inner}))"
    return f"SELECT * EXCLUDE (s, p) REPLACE (CASE WHEN s = 0 THEN q{b} WHEN q{a} < p AND p < q{e} THEN p ELSE {line} END AS q{b}, n{b} + s AS n{b}) FROM ({moved})"


_TAKEN = """SELECT g, c, q1, q2, q3, q4, q5, n1, n2 + CASE WHEN cell < 1 THEN 1 ELSE 0 END AS n2, n3 + CASE WHEN cell < 2 THEN 1 ELSE 0 END AS n3,
  n4 + CASE WHEN cell < 3 THEN 1 ELSE 0 END AS n4, n5 + 1 AS n5, xs FROM (SELECT g, xs, c + 1 AS c, least(q1, xs[c + 1]) AS q1, q2, q3, q4, greatest(q5, xs[c + 1]) AS q5, n1, n2, n3, n4, n5,
  CASE WHEN xs[c + 1] >= q4 THEN 3 WHEN xs[c + 1] >= q3 THEN 2 WHEN xs[c + 1] >= q2 THEN 1 ELSE 0 END AS cell FROM p2 WHERE c < len(xs))"""
_STEP = _marker(4, _marker(3, _marker(2, _TAKEN)))
#: The five-marker median estimate of the values of each suite in order; up to five values have their upper median.
P2 = f"""{ORDERED.replace("WITH ", "WITH RECURSIVE ", 1)},
lists AS (SELECT {K}, suite, xs FROM t),
numbered AS (SELECT *, row_number() OVER () AS g FROM lists),
p2 AS (SELECT g, 5 AS c, o[1] AS q1, o[2] AS q2, o[3] AS q3, o[4] AS q4, o[5] AS q5, 1.0::DOUBLE AS n1, 2.0::DOUBLE AS n2, 3.0::DOUBLE AS n3, 4.0::DOUBLE AS n4, 5.0::DOUBLE AS n5, xs
  FROM (SELECT g, xs, list_sort(xs[1:5]) AS o FROM numbered WHERE len(xs) > 5)
  UNION ALL ({_STEP})),
med AS (SELECT {K}, suite, len(xs) AS n, list_sort(xs)[len(xs) // 2 + 1] AS p2 FROM numbered WHERE len(xs) <= 5
  UNION ALL SELECT {K}, suite, len(numbered.xs) AS n, q3 AS p2 FROM p2 JOIN numbered USING (g) WHERE c = len(numbered.xs))"""
SQL["p2_median"] = f'{P2} SELECT {K}, suite, CAST(n AS BIGINT) AS n, round(p2, 6) AS "Median" FROM med'

_HIST = ", ".join(f'{bin_counts(c)} AS "{n}"' for c, n in (("a", "Hist_Tot"), ("f", "Hist_Fwd"), ("b", "Hist_Bwd")))
_PAY = " UNION ALL ".join(f"SELECT {K}, '{d}_Pay' AS suite, hist_bin, count(*) AS h FROM x{w} GROUP BY {K}, hist_bin" for d, w in (("Tot", ""), ("Fwd", " WHERE is_fwd"), ("Bwd", " WHERE NOT is_fwd")))


def _row_sql(suites: list[str], wide: bool = False, raw: bool = False) -> str:
    """The flow row: what the single queries tell, joined by segment; wide: by the names of the wide row; raw: not rounded."""
    told = lambda value, places: value if raw else f"round({value}, {places})"
    stats = {"Max": "floor(hi)", "Mean": "round(mean, 4) + 0.0", "Std": "round(std, 3) + 0.0", "Var": VARIANCE.format("var"), "Median": "round(median, 6)", "Skew": "round(skew, 4) + 0.0", "Kurt": "round(kurt, 4) + 0.0", "CoV": "round(cov, 4) + 0.0"}
    stats = {"Max": "floor(hi)"} | {n: n.lower() for n in stats if n != "Max"} if raw else stats
    pivot = ", ".join([f"""coalesce(max(CASE WHEN suite = '{s}' THEN {e} END), {"round(0.000000123, 5)" if t == "Var" and not raw else "0"})::DOUBLE AS "{s}_{t}\"""" for s in suites for t, e in stats.items()] + [f"""max(CASE WHEN suite = '{s}' THEN floor(lo) END)::DOUBLE AS "{s}_Min", 0.0::DOUBLE AS "{s}_Mode\"""" for s in suites])
    flags = ", ".join(f'count(*) FILTER ((tcp_flags & {1 << i}) <> 0) AS "{n}_Cnt", count(*) FILTER ((tcp_flags & {1 << i}) <> 0 AND is_fwd) AS "{n}_Fwd_Cnt", count(*) FILTER ((tcp_flags & {1 << i}) <> 0 AND NOT is_fwd) AS "{n}_Bwd_Cnt"' for i, n in enumerate(_FLAGS))
    last = ", ".join(f"CAST(arg_max({c}, ts_ns) AS BIGINT) AS {c}" for c in _LAST)
    rates = ", ".join(f'{told(f"{c} / dur", 4)} AS "{n}"' for c, n in (("bytes", "BytesRate"), ("fb", "FwdBytesRate"), ("bb", "BwdBytesRate"), ("pkts", "PacketsRate"), ("fp", "FwdPacketsRate"), ("bp", "BwdPacketsRate")))
    bulks = ", ".join(f'coalesce({d}.bulk_{c.lower()}, 0) AS "{n}Bulk{c}"' for d, n in (("bf", "Fwd"), ("bw", "Bwd")) for c in ("Bytes", "Pkts", "Cnt"))
    if wide:
        named = ", ".join(f'{c} AS "{n}"' for c, n in LAST.items())
        bins = ", ".join(f'len(list_filter({c}, lambda y: y = {i})) AS "Hist_{n}_{i}"' for c, n in (("a", "Tot"), ("f", "Fwd"), ("b", "Bwd")) for i in range(80))
        texts = {n: _IP.replace("src_ip", f"ff.{n}").replace("ip_ver", "ff.ip_ver") for n in ("src_ip", "dst_ip")}
        shown = f"""{texts["src_ip"]} AS src_ip, {texts["dst_ip"]} AS dst_ip, concat_ws('-', {texts["src_ip"]}, {texts["dst_ip"]}, ff.src_port, ff.dst_port, protocol) AS flow_id, protocol, CAST(ff.src_port AS BIGINT) AS src_port, CAST(ff.dst_port AS BIGINT) AS dst_port,
  CAST(ff.ip_ver AS BIGINT) AS ip_ver, CAST(ff.eth_proto AS BIGINT) AS eth_proto, {_MAC.replace("src_mac", "ff.src_mac")} AS src_mac, {_MAC.replace("src_mac", "ff.dst_mac")} AS dst_mac, {named}, {bins}"""
    own = f"sg.* EXCLUDE ({K}, hint{', ' + ', '.join(LAST) if wide else ''})"
    first = "SELECT " + (shown if wide else f"{K}, {_HIST}, t0 AS start_ts_ns, round((t1 - t0) / 1e9, 6) AS flow_duration")
    return f"""{P2}{COUNTS[len(DELTAS) :]}{HISTOGRAM[len(DELTAS) :]},
pay1 AS ({_PAY}), pay2 AS (SELECT *, sum(h) OVER (PARTITION BY {K}, suite ORDER BY hist_bin) AS acc, (sum(h) OVER (PARTITION BY {K}, suite) + 1) // 2 AS half FROM pay1),
pay AS (SELECT {K}, suite, arg_min(hist_bin * 20 + 20.0 * (half - (acc - h)) / h, hist_bin) AS hm FROM pay2 WHERE acc >= half GROUP BY {K}, suite),
every AS (SELECT u.*, coalesce(hm, p2)::DOUBLE AS median FROM u JOIN med USING ({K}, suite) LEFT JOIN pay USING ({K}, suite)),
pv AS (SELECT {K}, {pivot} FROM every GROUP BY {K}),
sg AS (SELECT {K}, {flags}, {last}, CAST(coalesce(arg_min(window_size, ts_ns) FILTER (is_fwd), 0) AS BIGINT) AS "FwdInitWinBytes", CAST(coalesce(arg_min(window_size, ts_ns) FILTER (NOT is_fwd), 0) AS BIGINT) AS "BwdInitWinBytes",
  CAST(arg_min(traffic_class, ts_ns) AS BIGINT) AS traffic_class, CAST(arg_min(flow_label, ts_ns) AS BIGINT) AS flow_label, arg_min(payload_hint, ts_ns) AS hint FROM x GROUP BY {K}),
e1 AS (SELECT {K}, unnest(range(64)) AS place, unnest(list_transform(range(64), lambda i: substr(hint, 2 * i + 1, 2))) AS byte FROM sg), e2 AS (SELECT {K}, min(place) AS place, count(*) / 64.0::DOUBLE AS share FROM e1 GROUP BY {K}, byte),
e3 AS (SELECT {K}, list(share ORDER BY place) AS shares FROM e2 GROUP BY {K}),
ent AS (SELECT {K}, {told("abs(list_reduce(shares, lambda a, y: a - y * (ln(y) / ln(2.0::DOUBLE)), 0.0::DOUBLE))", 6)} + 0.0 AS "PayloadEntropy" FROM e3),
bf AS (SELECT * FROM bulk WHERE is_fwd), bw AS (SELECT * FROM bulk WHERE NOT is_fwd), ff AS (SELECT ep_a, ep_b, protocol, src_ip, dst_ip, src_port, dst_port, src_mac, dst_mac, eth_proto, ip_ver FROM w WHERE rn = 1)
{first}, pkts AS "PacketsCount", fp AS "FwdPacketsCount", bp AS "BwdPacketsCount", bytes AS "TotalBytes", fb AS "FwdBytes", bb AS "BwdBytes", {told("t1 / 1e9::DOUBLE", 6)} AS "timestamp", {told("dur", 6)} AS duration,
  {told("CASE WHEN bp > 0 THEN fp / bp ELSE fp END", 6)} AS "FwdBwdPktRatio", {told("CASE WHEN bb > 0 THEN fb / bb ELSE fb END", 6)} AS "FwdBwdByteRatio", {told("CASE WHEN fp > 0 THEN bp / fp ELSE 0 END", 6)} AS "DownUpRatio",
  {rates}, {bulks}, {own}, "PayloadEntropy", pv.* EXCLUDE ({K})
FROM q JOIN sg USING ({K}) JOIN h1 USING ({K}) JOIN pv USING ({K}) JOIN ent USING ({K}) LEFT JOIN bf USING ({K}) LEFT JOIN bw USING ({K}){" JOIN ff USING (ep_a, ep_b, protocol)" if wide else ""}"""


SQL["flow_features"] = _row_sql(SUITES)
SQL["flows_wide"] = _row_sql(SUITES, wide=True)
_TEXTS = {n: f"""printf('%.{6 if n in ("timestamp", "duration") else 2}f', coalesce("{n}", 0)::DOUBLE)""" for n in wide_columns() if n.rpartition("_")[0] in SUITES and n.rpartition("_")[2] in STATS or n.endswith(("Ratio", "Rate", "Entropy")) or n in ("timestamp", "duration")}
SQL["flows_csv_projection"] = "SELECT " + ", ".join(f"""{_TEXTS.get(n, f'CAST("{n}" AS VARCHAR)')} AS "{n}\"""" for n in wide_columns()) + f" FROM ({_row_sql(SUITES, wide=True, raw=True)})"
