"""From captured frames to packets: one pass over the bytes of an Arrow batch, all frames of it in step.

A field is a gather: its place in each frame, from the start of the batch's buffer, and as many bytes as it has. A short frame
leaves the fields of the header that it lacks at 0; frames that are not IPv4 or IPv6, or too short for that header,
give no packet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FlowConfig
from ..schema import PACKETS
from ..shipping import ship

IPV4, IPV6, GRE, TCP, UDP, ICMP, ICMP6 = 0x0800, 0x86DD, 47, 6, 17, 1, 58
VXLAN_PORT, DNS_PORT, NTP_PORT, SNMP_PORT, SSDP_PORT = 4789, 53, 123, 161, 1900
DNS_LABELS, HINT_BYTES = 16, 64

_BYTES = {"src_mac": 6, "dst_mac": 6, "src_ip": 16, "dst_ip": 16, "payload_hint": HINT_BYTES}
_IP = ["ip_ver", "protocol", "ttl", "ip_id", "frag_off", "traffic_class", "flow_label", "header_len", "total_bytes", "payload_len", "src_ip", "dst_ip"]
_GRE = ["tunnel_id", "tunnel_type", "protocol", "src_ip", "dst_ip"]
_L4 = ["src_port", "dst_port", "window_size", "tcp_flags"]
_APP = ["dns_answer_count", "dns_qtype", "dns_qclass", "ntp_mode", "ntp_stratum", "snmp_pdu_type", "ssdp_method"]
_ICMP = ["icmp_type", "icmp_code", "icmp_id", "payload_hint"]
#: What headers() adds, by structs: the frame, the outer IP header, what is left when GRE is off, and the packet.
LAYERS = {
    "eth": ["dst_mac", "src_mac", "eth_proto"],
    "ip": _IP,
    "gre": _GRE,
    "packet": list(dict.fromkeys(["dst_mac", "src_mac", "eth_proto", *_IP, *_GRE, *_L4, *_APP, *_ICMP])),
}


class _Frames:
    """The bytes of a batch of frames."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.binary())
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.data = np.r_[np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.zeros(HINT_BYTES, np.uint8)]
        self.start, self.size = bounds[:-1], np.diff(bounds)
        if column.null_count:
            self.size = np.where(column.is_valid().to_numpy(zero_copy_only=False), self.size, 0)
        self.rows = len(column)

    def has(self, at: np.ndarray | int, n: int) -> np.ndarray:
        return self.size >= at + n

    def part(self, where: np.ndarray, at: np.ndarray | int, n: int) -> np.ndarray:
        """n bytes from a place in each frame, where there are so many; zeros elsewhere."""
        own = where & self.has(at, n)
        first = np.where(own, self.start + at, 0)
        return np.where(own[:, None], self.data[first[:, None] + np.arange(n)], 0).astype(np.uint8)

    def uint(self, where: np.ndarray, at: np.ndarray | int, n: int = 1) -> np.ndarray:
        """A big-endian unsigned number of n bytes."""
        own = where & self.has(at, n)
        first = np.where(own, self.start + at, 0)
        value = np.zeros(self.rows, np.int64)
        for k in range(n):
            value = value << 8 | self.data[first + k]
        return np.where(own, value, 0)


def _v4_mapped(four: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((len(four), 12), np.uint8), four], axis=1)


def _ip_header(f: _Frames, v4: np.ndarray, v6: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The fields of the IP header, and where its payload begins."""
    either = lambda four, six: np.where(v4, four, six)
    ihl, total, rest = (f.uint(v4, 14) & 15) * 4, f.uint(v4, 16, 2), f.uint(v6, 18, 2)
    some = v4 | v6
    fields = {
        "ip_ver": either(4, np.where(v6, 6, 0)),
        "protocol": either(f.uint(v4, 23), f.uint(v6, 20)),
        "ttl": either(f.uint(v4, 22), f.uint(v6, 21)),
        "ip_id": f.uint(v4, 18, 2),
        "frag_off": f.uint(v4, 20, 2),
        "traffic_class": f.uint(v6, 14, 2) >> 4 & 255,
        "flow_label": f.uint(v6, 14, 4) & 0xFFFFF,
        "header_len": either(ihl, np.where(v6, 40, 0)),
        "total_bytes": either(total, np.where(v6, rest + 40, 0)),
        "payload_len": either(np.maximum(total - ihl, 0), rest),
        "src_ip": np.where(v4[:, None], _v4_mapped(f.part(v4, 26, 4)), f.part(v6, 22, 16)),
        "dst_ip": np.where(v4[:, None], _v4_mapped(f.part(v4, 30, 4)), f.part(v6, 38, 16)),
    }
    return fields, np.where(some, either(ihl + 14, 54), 0)


def _inner_v4(f: _Frames, h: dict[str, np.ndarray], off: np.ndarray, at: np.ndarray, found: np.ndarray, kind: int, cfg: FlowConfig) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Addresses, protocol and offset from the IPv4 header at a place, where it was found."""
    taken = dict(h)
    for name, k in (("src_ip", 12), ("dst_ip", 16)):
        four = f.part(found, at + k, 4)
        whole = np.concatenate([h[name][:, :12], four], axis=1) if cfg.mixed_inner_v4 else _v4_mapped(four)
        taken[name] = np.where(found[:, None], whole, h[name])
    taken["protocol"] = np.where(found, f.uint(found, at + 9), h["protocol"])
    taken["tunnel_type"] = np.where(found, kind, h["tunnel_type"])
    if not cfg.mixed_inner_v4:
        taken["ip_ver"] = np.where(found, 4, h["ip_ver"])
    return taken, np.where(found, at + (f.uint(found, at) & 15) * 4, off)


def _without_gre(f: _Frames, h: dict[str, np.ndarray], off: np.ndarray, cfg: FlowConfig) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Takes off one GRE header; the key becomes tunnel_id."""
    here = (h["protocol"] == GRE) & f.has(off, 4) & (h["ip_ver"] > 0)
    flags, inside = f.uint(here, off, 2), f.uint(here, off + 2, 2)
    at = off + 4 + 4 * (flags & 0x8000 != 0)
    keyed = here & (flags & 0x2000 != 0) & f.has(at, 4)
    h = h | {"tunnel_id": f.uint(keyed, at, 4), "tunnel_type": np.zeros(f.rows, np.int64)}
    at = at + 4 * keyed
    return _inner_v4(f, h, np.where(here, at, off), at, here & (inside == IPV4) & f.has(at, 20), 1, cfg)


def _transport(f: _Frames, h: dict[str, np.ndarray], off: np.ndarray, cfg: FlowConfig) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Ports, TCP window and flags, without a VXLAN header; and whether the application layer is read."""
    some = h["ip_ver"] > 0
    tcp, udp = some & (h["protocol"] == TCP) & f.has(off, 20), some & (h["protocol"] == UDP) & f.has(off, 8)
    h = h | {"src_port": f.uint(tcp | udp, off, 2), "dst_port": f.uint(tcp | udp, off + 2, 2), "window_size": f.uint(tcp, off + 14, 2), "tcp_flags": f.uint(tcp, off + 13)}
    off = off + 8 * udp
    here = udp & (h["dst_port"] == VXLAN_PORT) & f.has(off, 8)
    h["tunnel_id"] = np.where(here, f.uint(here, off + 4, 4) >> 8, h["tunnel_id"])
    found = here & f.has(off, 42) & (f.uint(here, off + 20, 2) == IPV4)
    h, off = _inner_v4(f, h, off, off + 22, found, 2, cfg)
    again = found & (h["protocol"] == UDP) & f.has(off, 8)
    for name, k in (("src_port", 0), ("dst_port", 2)):
        h[name] = np.where(again, f.uint(again, off + k, 2), h[name])
    return h, off + 8 * again, udp


def _question(f: _Frames, asks: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the name of a DNS question ends, and whether it does after at most DNS_LABELS labels."""
    at, going, ended = off + 12, asks, np.zeros(f.rows, bool)
    for _ in range(DNS_LABELS):
        here = going & f.has(at, 1)
        size = f.uint(here, at)
        pointer, root = here & (size & 0xC0 == 0xC0), here & (size == 0)
        ended |= pointer | root
        going = here & ~pointer & ~root & (size <= 63) & f.has(at, size + 1)
        at = at + 2 * pointer + root + np.where(going, size + 1, 0)
    return at, ended


def _application(f: _Frames, h: dict[str, np.ndarray], off: np.ndarray, udp: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The fields of DNS, NTP, SNMP and SSDP, by port, and the protocol whose parser was called."""
    s, d = h["src_port"], h["dst_port"]
    either = lambda port: udp & ((s == port) | (d == port))
    app = np.select([either(DNS_PORT), either(NTP_PORT), either(SNMP_PORT), udp & (d == SSDP_PORT)], ["dns", "ntp", "snmp", "ssdp"], "none")
    dns, ntp = (app == "dns") & f.has(off, 12), (app == "ntp") & f.has(off, 4)
    at, ended = _question(f, dns & (f.uint(dns, off + 4, 2) > 0), off)
    ended &= f.has(at, 4)
    # SNMP: sequence tag and length, version, community, then the type of the unit
    snmp = (app == "snmp") & f.has(off, 5)
    snmp &= (f.uint(snmp, off) == 0x30) & (f.uint(snmp, off + 2) == 0x02)
    community = off + 4 + f.uint(snmp, off + 3)
    snmp &= f.has(community, 2)
    snmp &= f.uint(snmp, community) == 0x04
    unit = community + 2 + f.uint(snmp, community + 1)
    search = f.part((app == "ssdp") & f.has(off, 8), off, 8)
    return h | {
        "dns_answer_count": f.uint(dns, off + 6, 2),
        "dns_qtype": f.uint(ended, at, 2),
        "dns_qclass": f.uint(ended, at + 2, 2),
        "ntp_mode": f.uint(ntp, off) & 7,
        "ntp_stratum": f.uint(ntp, off + 1),
        "snmp_pdu_type": f.uint(snmp, unit),
        "ssdp_method": (search == np.frombuffer(b"M-SEARCH", np.uint8)).all(axis=1).astype(np.int64),
    }, app


def _read(f: _Frames, cfg: FlowConfig) -> dict[str, dict[str, np.ndarray]]:
    """The fields of LAYERS, by layer, and of the application."""
    whole = f.has(0, 14)
    eth = {"dst_mac": f.part(whole, 0, 6), "src_mac": f.part(whole, 6, 6), "eth_proto": f.uint(whole, 12, 2)}
    v4, v6 = (eth["eth_proto"] == IPV4) & f.has(0, 34), (eth["eth_proto"] == IPV6) & f.has(0, 54)
    ip, off = _ip_header(f, v4, v6)
    gre, off = _without_gre(f, ip, off, cfg)
    packet, off, udp = _transport(f, gre, off, cfg)
    packet, app = _application(f, packet, off, udp)
    icmp = (packet["ip_ver"] > 0) & np.isin(packet["protocol"], (ICMP, ICMP6)) & f.has(off, 8)
    packet |= {"icmp_type": f.uint(icmp, off), "icmp_code": f.uint(icmp, off + 1), "icmp_id": f.uint(icmp, off + 4, 2), "payload_hint": f.part(packet["ip_ver"] > 0, off, HINT_BYTES)}
    return {"eth": eth, "ip": ip, "gre": gre, "packet": eth | packet, "app": {"app": app}}


def _arrow(name: str, values: np.ndarray) -> pa.Array:
    if name not in _BYTES:
        return pa.array(values.astype(np.int64))
    offsets = np.arange(len(values) + 1, dtype=np.int32) * _BYTES[name]
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _layers(cfg: FlowConfig) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _Frames(batch.column("frame"))
            read = _read(f, cfg)
            structs = [pa.StructArray.from_arrays([_arrow(n, read[layer][n]) for n in names], names) for layer, names in LAYERS.items()]
            told = pa.RecordBatch.from_arrays([*batch.columns, *structs, pa.array(read["app"]["app"].tolist(), pa.string())], [*batch.schema.names, *LAYERS, "app"])
            yield told.filter(pa.array(f.has(0, 14)))

    return run


def headers(frames: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """Adds to frames with a whole Ethernet header what their headers say: the structs of LAYERS, and app.

    app is the application protocol whose parser was called. ip_ver is 0 in frames that are no IP packets.
    """
    ship(frames.sparkSession)
    kinds = {n: T.BinaryType() for n in _BYTES}
    added = [T.StructField(layer, T.StructType([T.StructField(n, kinds.get(n, T.LongType())) for n in names])) for layer, names in LAYERS.items()]
    return frames.mapInArrow(_layers(cfg), T.StructType([*frames.schema, *added, T.StructField("app", T.StringType())]))


def ip_only(read: DataFrame) -> DataFrame:
    """Frames of headers() with a whole IPv4 or IPv6 header."""
    return read.where("ip.ip_ver > 0")


def decode_frames(frames: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """The packets of frames (pkt_id, ts_ns, frame)."""
    read = ip_only(headers(frames.select("pkt_id", "ts_ns", "frame"), cfg))
    return read.select(*[F.col(f.name if f.name in ("pkt_id", "ts_ns") else f"packet.{f.name}").cast(f.dataType).alias(f.name) for f in PACKETS])
