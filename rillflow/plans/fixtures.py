"""Packets and frames derived from the events table, so that the flow queries grow with the given data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segment import FEW_PACKETS
from ..schema import PACKETS
from ..scratch import saved

EPOCH_US = 1704067200000000  # 2024-01-01


def _hex(value: Column, width: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), width, "0")


def dealt_packets_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packets_v for a shuffle by flow, with about FEW_PACKETS packets a task.

    A packet is some 600 bytes made of an event's 8 on disk, so a split of events would give a task of the shuffle millions to hold.
    """
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    return packets_v(spark, sf_dir, max(-(-n // FEW_PACKETS), spark.sparkContext.defaultParallelism) if n > FEW_PACKETS else None)


def packets_v(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """One packet per event: an invented exchange between a client per three users and one of five servers.

    parts: deal the events out to so many tasks first, where much is made of each.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    e = e.repartition(parts, "event_id") if parts else e  # in turn, each task would sort what it holds first
    us = F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US
    e = e.select("event_id", "event_type", "value", F.expr("user_id div 3").alias("fk"), us.alias("us"))
    fk, i, c2s = F.col("fk"), F.col("event_id"), ~F.col("event_type").isin("view", "error")
    v6 = fk % 4 == 3
    protocol = F.when(fk % 11 == 10, 1).when(fk % 3 == 0, 17).otherwise(6)
    udp, tcp, icmp = protocol == 17, protocol == 6, protocol == 1
    port = F.when(udp, F.get(F.array(*map(F.lit, (53, 123, 161, 1900))), (fk % 4).cast("int"))).when(tcp, 443).otherwise(0)
    on = lambda p, x: F.when(udp & (port == p), x).otherwise(0)
    low = _hex((fk / 256).cast("bigint") % 256, 2), _hex(fk % 256, 2)
    front = F.when(v6, "FD00" + "00" * 10).otherwise("00" * 12)
    client, server = F.unhex(F.concat(front, F.lit("0A00"), *low)), F.unhex(F.concat(front, F.lit("C0A801"), _hex(fk % 5 + 1, 2)))
    client_mac, server_mac = F.unhex(F.concat(F.lit("02000000"), *low)), F.unhex(F.concat(F.lit("02FF000000"), _hex(fk % 5 + 1, 2)))
    client_port = F.when(icmp, 0).otherwise(40000 + fk % 20000)
    swap = lambda a, b: F.when(c2s, a).otherwise(b)
    payload, header = F.floor(F.col("value") * 4) + 20, F.when(v6, 40).otherwise(20)
    flags = F.when(~tcp, 0).when(i % 211 == 0, 17).when((F.col("event_type") == "error") & (i % 17 == 0), 4).when(i % 13 == 0, 2).otherwise(24)
    columns = {
        "pkt_id": i, "ts_ns": F.expr("us div 37 + 120000000000 * (us div 864000000000)"), "src_ip": swap(client, server), "dst_ip": swap(server, client),
        "src_port": swap(client_port, port), "dst_port": swap(port, client_port), "protocol": protocol, "ip_ver": F.when(v6, 6).otherwise(4),
        "traffic_class": F.when(v6, i % 256).otherwise(0), "eth_proto": F.when(v6, 0x86DD).otherwise(0x0800), "flow_label": F.when(v6, fk * 17 % 1048576).otherwise(0),
        "src_mac": swap(client_mac, server_mac), "dst_mac": swap(server_mac, client_mac), "ip_id": F.when(v6, 0).otherwise(i % 65536),
        "frag_off": F.when(~v6 & (i % 2 == 0), 16384).otherwise(0), "total_bytes": payload + header, "payload_len": payload, "header_len": header,
        "window_size": F.when(tcp, i * 7919 % 65536).otherwise(0), "tcp_flags": flags, "ttl": F.when(i % 10 == 0, 128).otherwise(64),
        "icmp_type": F.when(icmp & c2s, 8).otherwise(0), "icmp_code": F.when(icmp, i % 3).otherwise(0), "icmp_id": F.when(icmp, fk % 65536).otherwise(0),
        "dns_answer_count": on(53, i % 5), "dns_qtype": on(53, F.get(F.array(F.lit(1), F.lit(28), F.lit(15)), (i % 3).cast("int"))), "dns_qclass": on(53, F.lit(1)),
        "tunnel_id": F.when(fk % 7 == 0, fk * 1000 + 1).otherwise(0), "tunnel_type": F.when(fk % 7 == 0, 1 + fk % 2).otherwise(0), "ntp_mode": on(123, i % 8),
        "ntp_stratum": on(123, i % 16), "snmp_pdu_type": on(161, 160 + i % 6), "ssdp_method": F.when(udp & (port == 1900) & c2s, i % 2).otherwise(0),
        "payload_hint": F.unhex(F.repeat(F.md5(i.cast("string").cast("binary")), F.lit(4))),
    }
    return e.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in PACKETS])


#: What a frame of frames_v is, by pkt_id % 10; version 6 packets and those without ports are plain in kinds 1 to 6.
KINDS = ["plain", "gre_key", "gre_sum_key", "gre", "vxlan_udp", "vxlan_tcp", "gre_vxlan", "arp", "vlan", "short"]


def frames_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets of packets_v as captured bytes: headers, application bytes and 64 bytes of payload.

    Written as a table, as a capture would be, with the columns of the packet, kind and cut (the length of a
    short frame) for tests and SQL.
    """
    p = packets_v(spark, sf_dir, spark.sparkContext.defaultParallelism)
    c = F.col
    h = lambda name, width: _hex(c(name), width)
    lit = F.lit
    hex_of = lambda name: F.hex(c(name))
    dns = F.concat(lit("00010000"), lit("0001"), h("dns_answer_count", 4), lit("00000000"), lit("03777777076578616D706C6503636F6D00"), h("dns_qtype", 4), h("dns_qclass", 4))
    ntp = F.concat(_hex(c("ntp_mode") + 24, 2), h("ntp_stratum", 2), lit("0000"))
    snmp = F.concat(lit("302902010104067075626C6963"), h("snmp_pdu_type", 2), lit("00"))
    ssdp = F.when(c("ssdp_method") == 1, lit("4D2D534541524348")).otherwise(lit("4E4F54494659202A"))
    any_port = lambda n: (c("src_port") == n) | (c("dst_port") == n)
    app = F.when(any_port(53), dns).when(any_port(123), ntp).when(any_port(161), snmp).when(any_port(1900), ssdp).otherwise(lit(""))
    ports = F.concat(h("src_port", 4), h("dst_port", 4))
    tcp = F.concat(ports, lit("00000000" * 2), lit("50"), h("tcp_flags", 2), h("window_size", 4), lit("00000000"))
    udp = F.concat(ports, lit("00000000"), app)
    icmp = F.concat(h("icmp_type", 2), h("icmp_code", 2), lit("0000"), h("icmp_id", 4), lit("0000"))
    l4 = F.concat(F.when(c("protocol") == 6, tcp).when(c("protocol") == 17, udp).otherwise(icmp), hex_of("payload_hint"))
    p = p.withColumn("l4", l4)
    l4 = c("l4")
    four = lambda name: F.substring(hex_of(name), 25, 8)
    v4 = lambda proto, src, dst: F.concat(lit("4500"), h("total_bytes", 4), h("ip_id", 4), h("frag_off", 4), h("ttl", 2), proto, lit("0000"), src, dst)
    own4 = v4(h("protocol", 2), four("src_ip"), four("dst_ip"))
    p = p.withColumn("own4", own4)
    own4 = c("own4")
    v6 = F.concat(lit("6"), h("traffic_class", 2), h("flow_label", 5), h("payload_len", 4), h("protocol", 2), h("ttl", 2), hex_of("src_ip"), hex_of("dst_ip"))
    eth = F.concat(hex_of("dst_mac"), hex_of("src_mac"))
    outer = lambda proto: F.concat(eth, lit("0800"), v4(lit(proto), lit("0A090901"), lit("0A090902")))
    plain = F.concat(eth, h("eth_proto", 4), F.when(c("ip_ver") == 6, v6).otherwise(own4), l4)
    inner = F.concat(own4, l4)
    vni = F.concat(lit("08000000"), _hex(c("pkt_id") % 16777216, 6), lit("00"))
    vxlan = F.concat(lit("C00012B500000000"), vni, eth, lit("0800"), inner)
    key = _hex(c("pkt_id") % 4294967296, 8)
    through = (c("ip_ver") == 4) & (c("protocol") != 1)
    kind = F.get(F.array(*map(lit, KINDS)), (c("pkt_id") % 10).cast("int"))
    kind = F.when(kind.isin(*KINDS[1:7]) & ~through, "plain").when((kind == "vxlan_udp") & (c("protocol") != 17), "vxlan_tcp").when((kind == "vxlan_tcp") & (c("protocol") == 17), "vxlan_udp").otherwise(kind)
    p = p.withColumn("kind", kind)
    k = lambda name: c("kind") == name
    frame = (
        F.when(k("gre_key"), F.concat(outer("2F"), lit("20000800"), key, inner))
        .when(k("gre_sum_key"), F.concat(outer("2F"), lit("A000080000000000"), key, inner))
        .when(k("gre"), F.concat(outer("2F"), lit("00000800"), inner))
        .when(k("vxlan_udp") | k("vxlan_tcp"), F.concat(outer("11"), vxlan))
        .when(k("gre_vxlan"), F.concat(outer("2F"), lit("20000800"), key, v4(lit("11"), lit("0A080801"), lit("0A080802")), vxlan))
        .when(k("arp"), F.concat(eth, lit("0806"), lit("0001080006040001"), lit("00" * 20)))
        .when(k("vlan"), F.concat(eth, lit("81000064"), h("eth_proto", 4), own4, l4))
        .otherwise(plain)
    )
    p = p.withColumn("frame", F.unhex(frame)).withColumn("cut", F.when(k("short"), c("pkt_id") % 97))
    told = p.withColumn("frame", F.when(k("short"), F.substr("frame", lit(1), c("cut").cast("int"))).otherwise(c("frame")))
    return saved(told.drop("l4", "own4"), "frames")


#: packets_v in DuckDB, with addresses, MACs and hints as lower-case hexadecimal text.
PACKETS_SQL = """
e AS (SELECT event_id AS i, event_type, value, user_id // 3 AS fk, epoch_us(ts) - 1704067200000000 AS us,
  event_type NOT IN ('view', 'error') AS c2s FROM events),
f AS (SELECT *, fk % 4 = 3 AS v6, CASE WHEN fk % 11 = 10 THEN 1 WHEN fk % 3 = 0 THEN 17 ELSE 6 END AS protocol,
  CASE WHEN event_type IS NULL THEN NULL ELSE c2s END AS way,
  printf('%02x%02x', (fk // 256) % 256, fk % 256) AS low, printf('%02x', fk % 5 + 1) AS srv FROM e),
g AS (SELECT *, CASE WHEN protocol = 17 THEN CASE fk % 4 WHEN 0 THEN 53 WHEN 1 THEN 123 WHEN 2 THEN 161 ELSE 1900 END
    WHEN protocol = 6 THEN 443 ELSE 0 END AS port,
  CASE WHEN protocol = 1 THEN 0 ELSE 40000 + fk % 20000 END AS cport,
  (CASE WHEN v6 THEN 'fd00' || repeat('00', 10) ELSE repeat('00', 12) END) AS front FROM f),
p AS (SELECT i AS pkt_id, us // 37 + 120000000000 * (us // 864000000000) AS ts_ns,
  CASE WHEN c2s THEN front || '0a00' || low ELSE front || 'c0a801' || srv END AS src_ip,
  CASE WHEN c2s THEN front || 'c0a801' || srv ELSE front || '0a00' || low END AS dst_ip,
  CASE WHEN c2s THEN cport ELSE port END AS src_port, CASE WHEN c2s THEN port ELSE cport END AS dst_port, protocol,
  CASE WHEN v6 THEN 6 ELSE 4 END AS ip_ver, CASE WHEN v6 THEN i % 256 ELSE 0 END AS traffic_class,
  CASE WHEN v6 THEN 34525 ELSE 2048 END AS eth_proto, CASE WHEN v6 THEN fk * 17 % 1048576 ELSE 0 END AS flow_label,
  CASE WHEN c2s THEN '02000000' || low ELSE '02ff000000' || srv END AS src_mac,
  CASE WHEN c2s THEN '02ff000000' || srv ELSE '02000000' || low END AS dst_mac,
  CASE WHEN v6 THEN 0 ELSE i % 65536 END AS ip_id, CASE WHEN NOT v6 AND i % 2 = 0 THEN 16384 ELSE 0 END AS frag_off,
  CAST(floor(value * 4) AS BIGINT) + 20 + CASE WHEN v6 THEN 40 ELSE 20 END AS total_bytes,
  CAST(floor(value * 4) AS BIGINT) + 20 AS payload_len, CASE WHEN v6 THEN 40 ELSE 20 END AS header_len,
  CASE WHEN protocol = 6 THEN i * 7919 % 65536 ELSE 0 END AS window_size,
  CASE WHEN protocol <> 6 THEN 0 WHEN i % 211 = 0 THEN 17 WHEN event_type = 'error' AND i % 17 = 0 THEN 4
    WHEN i % 13 = 0 THEN 2 ELSE 24 END AS tcp_flags,
  CASE WHEN i % 10 = 0 THEN 128 ELSE 64 END AS ttl,
  CASE WHEN protocol = 1 AND c2s THEN 8 ELSE 0 END AS icmp_type, CASE WHEN protocol = 1 THEN i % 3 ELSE 0 END AS icmp_code,
  CASE WHEN protocol = 1 THEN fk % 65536 ELSE 0 END AS icmp_id,
  CASE WHEN port = 53 THEN i % 5 ELSE 0 END AS dns_answer_count,
  CASE WHEN port = 53 THEN CASE i % 3 WHEN 0 THEN 1 WHEN 1 THEN 28 ELSE 15 END ELSE 0 END AS dns_qtype,
  CASE WHEN port = 53 THEN 1 ELSE 0 END AS dns_qclass,
  CASE WHEN fk % 7 = 0 THEN fk * 1000 + 1 ELSE 0 END AS tunnel_id, CASE WHEN fk % 7 = 0 THEN 1 + fk % 2 ELSE 0 END AS tunnel_type,
  CASE WHEN port = 123 THEN i % 8 ELSE 0 END AS ntp_mode, CASE WHEN port = 123 THEN i % 16 ELSE 0 END AS ntp_stratum,
  CASE WHEN port = 161 THEN 160 + i % 6 ELSE 0 END AS snmp_pdu_type,
  CASE WHEN port = 1900 AND c2s THEN i % 2 ELSE 0 END AS ssdp_method, repeat(md5(i::VARCHAR), 4) AS payload_hint
  FROM g)"""
