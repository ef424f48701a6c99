"""Schemas of frames, packets and flow rows."""

from __future__ import annotations

from pyspark.sql import types as T

FRAMES = T.StructType([T.StructField("pkt_id", T.LongType()), T.StructField("ts_ns", T.LongType()), T.StructField("frame", T.BinaryType()), T.StructField("iface", T.StringType())])

_PACKET_TYPES = {
    "pkt_id": T.LongType(), "ts_ns": T.LongType(), "src_ip": T.BinaryType(), "dst_ip": T.BinaryType(), "src_port": T.IntegerType(), "dst_port": T.IntegerType(),
    "protocol": T.IntegerType(), "ip_ver": T.IntegerType(), "traffic_class": T.IntegerType(), "eth_proto": T.IntegerType(), "flow_label": T.LongType(),
    "src_mac": T.BinaryType(), "dst_mac": T.BinaryType(), "ip_id": T.LongType(), "frag_off": T.IntegerType(), "total_bytes": T.LongType(), "payload_len": T.LongType(),
    "header_len": T.IntegerType(), "window_size": T.IntegerType(), "tcp_flags": T.IntegerType(), "ttl": T.IntegerType(), "icmp_type": T.IntegerType(),
    "icmp_code": T.IntegerType(), "icmp_id": T.IntegerType(), "dns_answer_count": T.IntegerType(), "dns_qtype": T.IntegerType(), "dns_qclass": T.IntegerType(),
    "tunnel_id": T.LongType(), "tunnel_type": T.IntegerType(), "ntp_mode": T.IntegerType(), "ntp_stratum": T.IntegerType(), "snmp_pdu_type": T.IntegerType(),
    "ssdp_method": T.IntegerType(), "payload_hint": T.BinaryType(),
}
PACKETS = T.StructType([T.StructField(n, t) for n, t in _PACKET_TYPES.items()])

#: The columns that name a flow, and its segments.
KEY = ["a_ip", "a_port", "b_ip", "b_port", "protocol"]
SEG = [*KEY, "seg_id"]

#: The names and order of the suites, statistics and flags of a flow row.
SUITES = ["Tot_Pay", "Fwd_Pay", "Bwd_Pay", "Tot_Hdr", "Fwd_Hdr", "Bwd_Hdr", "Tot_IAT", "Fwd_IAT", "Bwd_IAT", "Tot_DeltaLen", "Fwd_DeltaLen", "Bwd_DeltaLen", "Win", "IpId", "Frag", "TTL_Var", "Active", "Idle"]
STATS = ["Max", "Min", "Mean", "Std", "Var", "Median", "Skew", "Kurt", "CoV", "Mode"]
FLAGS = ["FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR"]
#: Last values of a segment: packet column and name in a flow row.
LAST = {"icmp_type": "IcmpType", "icmp_code": "IcmpCode", "ttl": "TTL", "icmp_id": "IcmpEchoId", "dns_answer_count": "DNSAnswerCount", "dns_qtype": "DNSQueryType", "dns_qclass": "DNSQueryClass", "tunnel_id": "TunnelId", "tunnel_type": "TunnelType", "ntp_mode": "NTP_Mode", "ntp_stratum": "NTP_Stratum", "snmp_pdu_type": "SNMP_PDU_Type", "ssdp_method": "SSDP_Method"}


def wide_columns(hist_bins: int = 80) -> list[str]:
    """The names of a flow row in order: 495 with 80 bins."""
    suite = lambda s: [f"{s}_{t}" for t in STATS]
    return [
        "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ip_ver", "eth_proto", "traffic_class", "flow_label", "src_mac", "dst_mac", "timestamp", "duration",
        "PacketsCount", "FwdPacketsCount", "BwdPacketsCount", "TotalBytes", "FwdBytes", "BwdBytes", "FwdBwdPktRatio", "FwdBwdByteRatio",
        *[c for s in SUITES[:16] for c in suite(s)],
        "FwdInitWinBytes", "BwdInitWinBytes",
        *[f"{f}{d}" for f in FLAGS for d in ("_Cnt", "_Fwd_Cnt", "_Bwd_Cnt")],
        "PayloadEntropy", "IcmpType", "IcmpCode", "TTL", "IcmpEchoId",
        *suite("Active"), *suite("Idle"),
        "BytesRate", "FwdBytesRate", "BwdBytesRate", "PacketsRate", "FwdPacketsRate", "BwdPacketsRate", "DownUpRatio",
        "FwdBulkBytes", "FwdBulkPkts", "FwdBulkCnt", "BwdBulkBytes", "BwdBulkPkts", "BwdBulkCnt",
        "DNSAnswerCount", "DNSQueryType", "DNSQueryClass", "TunnelId", "TunnelType", "NTP_Mode", "NTP_Stratum", "SNMP_PDU_Type", "SSDP_Method",
        *[f"Hist_{d}_{i}" for d in ("Tot", "Fwd", "Bwd") for i in range(hist_bins)],
    ]
