"""Frames by hand: every header cut short, and the parsers of application protocols."""

import struct

import pytest

from rillflow.config import FlowConfig
from rillflow.operators.dissect import decode_frames

ETH = bytes.fromhex("020000000001020000000002")


def v4(proto, body, src="0a000001", dst="0a000002", total=None):
    return struct.pack(">BBHHHBBH", 0x45, 0, total if total is not None else 20 + len(body), 7, 0x4000, 64, proto, 0) + bytes.fromhex(src + dst) + body


def udp(body, sport=5000, dport=53):
    return struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body


def eth(kind, body):
    return ETH + struct.pack(">H", kind) + body


def decode(spark, frames, cfg=FlowConfig()):
    df = spark.createDataFrame([(i, i, f) for i, f in enumerate(frames)], "pkt_id long, ts_ns long, frame binary")
    return {r.pkt_id: r for r in decode_frames(df, cfg).collect()}


def labels(*names):
    return b"".join(bytes([len(n)]) + n for n in names)


def test_dns(spark):
    head = lambda asks, answers: struct.pack(">HHHHHH", 1, 0, asks, answers, 0, 0)
    end = struct.pack(">HH", 28, 1)
    cases = [
        (head(1, 0) + labels(b"www", b"org") + b"\0" + end, (0, 28, 1)),
        (head(1, 3) + b"\xc0\x0c" + end, (3, 28, 1)),
        (head(1, 2) + labels(*[b"a"] * 15) + b"\0" + end, (2, 28, 1)),
        (head(1, 2) + labels(*[b"a"] * 16) + b"\0" + end, (2, 0, 0)),
        (head(1, 1) + bytes([64]) + b"x" * 64 + b"\0" + end, (1, 0, 0)),
        (head(0, 5) + b"\0" + end, (5, 0, 0)),
        (head(1, 4), (4, 0, 0)),
        (head(1, 4) + labels(b"www") + b"\0\0", (4, 0, 0)),
        (head(1, 4)[:11], (0, 0, 0)),
    ]
    got = decode(spark, [eth(0x0800, v4(17, udp(b))) for b, _ in cases])
    for i, (_, want) in enumerate(cases):
        assert (got[i].dns_answer_count, got[i].dns_qtype, got[i].dns_qclass) == want, i


def test_other_applications(spark):
    snmp = bytes.fromhex("302902010104067075626c6963a003")
    cases = [
        (udp(b"\x1b\x02\0\0", dport=123), "ntp_stratum", 2),
        (udp(b"\x1b\x02\0", dport=123), "ntp_stratum", 0),
        (udp(snmp, dport=161), "snmp_pdu_type", 0xA0),
        (udp(b"\x31" + snmp[1:], dport=161), "snmp_pdu_type", 0),
        (udp(snmp[:13], dport=161), "snmp_pdu_type", 0),
        (udp(b"M-SEARCH * HTTP", dport=1900), "ssdp_method", 1),
        (udp(b"NOTIFY *", dport=1900), "ssdp_method", 0),
        (udp(b"M-SEARC", dport=1900), "ssdp_method", 0),
        (udp(b"M-SEARCH", sport=1900, dport=9), "ssdp_method", 0),
    ]
    got = decode(spark, [eth(0x0800, v4(17, b)) for b, _, _ in cases])
    assert [got[i][c] for i, (_, c, _) in enumerate(cases)] == [w for _, _, w in cases]


def test_short_and_foreign_frames(spark):
    whole = eth(0x0800, v4(6, struct.pack(">HHIIBBHHH", 1, 2, 3, 4, 0x50, 0x18, 99, 0, 0)))
    got = decode(spark, [whole[:n] for n in range(len(whole) + 1)] + [eth(0x0806, b"\0" * 46), eth(0x8100, b"\0" * 46), None])
    assert sorted(got) == list(range(34, len(whole) + 1))
    assert all(got[n].src_port == 0 and got[n].tcp_flags == 0 for n in range(34, 54))
    assert (got[54].src_port, got[54].dst_port, got[54].tcp_flags, got[54].window_size) == (1, 2, 0x18, 99)
    assert bytes(got[54].payload_hint) == bytes(64)


def test_malformed_length_is_clamped(spark):
    assert decode(spark, [eth(0x0800, v4(6, b"", total=10))])[0].payload_len == 0


@pytest.mark.parametrize("mixed", [False, True])
def test_inner_v4_in_outer_v6(spark, mixed):
    inner = v4(17, udp(b"x" * 4, 7, 9))
    gre = struct.pack(">HH", 0x1000, 0x0800) + inner
    frame = eth(0x86DD, struct.pack(">IHBB", 0x6AB12345, len(gre), 47, 61) + bytes.fromhex("fd00" + "11" * 14 + "fd00" + "22" * 14) + gre)
    r = decode(spark, [frame], FlowConfig(mixed_inner_v4=mixed))[0]
    assert (r.tunnel_type, r.src_port, r.dst_port, r.traffic_class, r.flow_label) == (1, 7, 9, 0xAB, 0x12345)
    assert bytes(r.src_ip) == (bytes.fromhex("fd00" + "11" * 10) if mixed else bytes(12)) + bytes([10, 0, 0, 1])
    assert r.ip_ver == (6 if mixed else 4)


def test_gre_cut_at_every_byte(spark):
    whole = eth(0x0800, v4(47, struct.pack(">HHII", 0xA000, 0x0800, 0, 77) + v4(1, bytes([8, 1, 0, 0, 0, 5, 0, 0]), "01020304", "05060708")))
    got = decode(spark, [whole[:n] for n in range(len(whole) + 1)])
    for n in range(34, len(whole) + 1):
        r = got[n]
        assert r.tunnel_id == (77 if n >= 46 else 0)
        assert (r.tunnel_type, r.protocol) == ((1, 1) if n >= 66 else (0, 47))
        assert (r.icmp_type, r.icmp_code, r.icmp_id) == ((8, 1, 5) if n >= 74 else (0, 0, 0))
