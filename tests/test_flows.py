"""The flow engine against a sequential model, and its edges."""

import random
from collections import defaultdict

import numpy as np
import pytest
import simulator
from pyspark.sql import functions as F

from rillflow.config import FlowConfig
from rillflow.functions.median import p2_medians
from rillflow.operators import features, segment
from rillflow.schema import LAST, PACKETS, SUITES, wide_columns

SECOND = 1_000_000_000


def packet(i, ts, way=True, flow=0, **more):
    a, b = (bytes(12) + bytes([10, 0, 0, flow]), 40000 + flow), (bytes(12) + bytes([192, 168, 0, 1]), 443)
    (s, sp), (d, dp) = (a, b) if way else (b, a)
    base = {f.name: 0 for f in PACKETS} | {"src_mac": b"\x02\x00\x00\x00\x00\x01", "dst_mac": b"\x02\x00\x00\x00\x00\x02", "payload_hint": bytes(64), "ip_ver": 4, "protocol": 6, "header_len": 20, "ttl": 64, "tcp_flags": 24, "eth_proto": 2048}
    return base | {"pkt_id": i, "ts_ns": ts, "src_ip": s, "dst_ip": d, "src_port": sp, "dst_port": dp} | more


def frame(spark, packets):
    return spark.createDataFrame([tuple(p[f.name] for f in PACKETS) for p in packets], PACKETS)


def edge_packets():
    """Hand-written sequences, one a flow, and random ones."""
    out, i = [], 0

    def flow(k, steps):
        nonlocal i
        ts = 1000 * SECOND
        for gap, more in steps:
            ts += gap
            out.append(packet(i, ts, flow=k, **more))
            i += 1

    ms = SECOND // 1000
    for k, n in enumerate((1, 4, 5, 6, 50, 51, 101)):
        flow(k, [(ms * (7 * j % 5 + 1), {"payload_len": 37 * j % 400, "way": j % 3 != 1}) for j in range(n)])
    flow(10, [(ms, {"tcp_flags": 17 if j == 49 else 24}) for j in range(60)])
    flow(11, [(ms, {"tcp_flags": 4 if j == 0 else 24}) for j in range(3)])
    flow(12, [(60 * SECOND, {}), (60 * SECOND, {}), (60 * SECOND + 1, {}), (SECOND, {}), (SECOND + 1, {})])
    flow(13, [(0, {"payload_len": x}) for x in (0, 19, 20, 1599, 1600, 9000)])
    flow(14, [(1000, {"payload_len": 5}) for _ in range(9)])
    for k, run in enumerate((2, 3, 4)):
        flow(20 + k, [(ms, {"payload_len": 10 + j}) for j in range(run + 1)] + [(2 * SECOND, {"payload_len": 9})] + [(ms, {"payload_len": 3})] * run)
    r = random.Random(3)
    for k in range(30, 60):
        gaps = [r.choice([1, 50, 400, 1000, 1500]) * ms if r.random() < 0.95 else 61 * SECOND for _ in range(r.randint(1, 160))]
        flow(k, [(g, {"way": r.random() < 0.6, "payload_len": r.randrange(3000), "window_size": r.randrange(65536), "ip_id": r.randrange(65536), "ttl": r.choice([64, 128]), "tcp_flags": r.choice([24, 24, 24, 24, 24, 2, 17]) if r.random() < 0.2 else 24, "dns_qtype": r.randrange(9)}) for g in gaps])
    return out


@pytest.fixture(scope="module")
def modelled():
    flows = defaultdict(list)
    for p in edge_packets():
        flows[tuple(sorted([(p["src_ip"], p["src_port"]), (p["dst_ip"], p["dst_port"])]))].append(p)
    out = {}
    for key, packets in flows.items():
        cut = simulator.segments(packets)
        first = cut[0][0]
        for n, seg in enumerate(cut):
            out[(key[0], key[1], n)] = simulator.features(seg, (first["src_ip"], first["src_port"]))
    return out


def test_flow_rows_match_the_model(spark, modelled):
    rows = features.flow_features(frame(spark, edge_packets())).collect()
    assert len(rows) == len(modelled)
    for r in rows:
        m = modelled[((bytes(r.a_ip), r.a_port), (bytes(r.b_ip), r.b_port), r.seg_id)]
        assert (r.PacketsCount, r.FwdPacketsCount, r.BwdPacketsCount) == tuple(m["n"].values())
        assert (r.TotalBytes, r.FwdBytes, r.BwdBytes) == tuple(m["size"].values())
        assert r.duration == pytest.approx(m["duration"]) and r.timestamp == pytest.approx(m["timestamp"])
        for s in SUITES:
            xs = m["suites"].get(s, [])
            for t, v in simulator.stats(xs).items():
                got = r[f"{s}_{t}"]
                assert got is None if v is None else got == pytest.approx(v, rel=1e-6, abs=1e-6), (s, t)
            median = simulator.histogram_median([int(x) for x in xs]) if s.endswith("_Pay") else simulator.p2(xs)
            assert r[f"{s}_Median"] == pytest.approx(median), s
        for d in ("Fwd", "Bwd"):
            assert [r[f"{d}Bulk{x}"] for x in ("Bytes", "Pkts", "Cnt")] == m["bulk"][d]
        assert [r[f"{n}_Cnt"] for n in ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")] == m["flags"]
        assert all(r[n] == m["last"][c] for c, n in LAST.items())
        assert r.Hist_Tot == np.bincount([min(int(x) // 20, 79) for x in m["suites"]["Tot_Pay"]], minlength=80).tolist()
        assert r.Hist_Bwd == [a - b for a, b in zip(r.Hist_Tot, r.Hist_Fwd, strict=True)]


def test_p2_matches_the_sequential_estimate():
    r = np.random.default_rng(1)
    rows = [r.choice([0.0, 1.0, 2.5, 40.0], n) if n % 3 else r.random(n) * 1000 for n in [*range(60)] * 5]
    assert p2_medians(rows) == pytest.approx([simulator.p2(x.tolist()) for x in rows])


def test_bucketed_segments_are_the_same(spark):
    packets = segment.with_key(frame(spark, edge_packets()))
    a = {r.pkt_id: r.seg_id for r in segment.assign_segments(packets).collect()}
    for bucket in (0.05, 1.0, 100.0):
        assert a == {r.pkt_id: r.seg_id for r in segment.assign_segments_in_buckets(packets, bucket_s=bucket).collect()}


def test_as_coded_profile(spark):
    packets = [packet(0, SECOND, way=True, window_size=7), packet(1, 2 * SECOND, way=False), packet(2, 3 * SECOND, way=True)]
    rows = sorted(features.flow_features(frame(spark, packets), FlowConfig.as_coded()).collect(), key=lambda r: -r.PacketsCount)
    assert [(r.PacketsCount, r.FwdPacketsCount, r.FwdInitWinBytes, r.BwdInitWinBytes, r.Fwd_Pay_Min) for r in rows] == [(2, 0, 7, 0, None), (1, 0, 0, 0, None)]


def test_options(spark):
    df = frame(spark, edge_packets()[:40])
    exact = features.flow_features(df, FlowConfig(median="exact", exact_mode=True, idle_close="timer"), ["Tot_Pay"])
    assert {c for c in exact.columns if c.endswith("_Median")} == {"Tot_Pay_Median"}
    assert exact.count() == features.flow_features(df, FlowConfig(median="none")).count()


def test_idle_segments_close_at_the_timer(spark):
    packets = [packet(0, SECOND), packet(1, 2 * SECOND, tcp_flags=17), packet(2, 3 * SECOND)]
    rows = features.flow_features(frame(spark, packets), FlowConfig(idle_close="timer", median="none"), ["Tot_Pay"]).collect()
    assert {r.seg_id: r.timestamp for r in rows} == {0: 2.0, 1: 63.0}


def test_wide_row(spark):
    names = wide_columns()
    assert len(names) == len(set(names)) == 495
    assert names[:3] == ["flow_id", "src_ip", "dst_ip"] and names[182] == "FwdInitWinBytes" and names[-1] == "Hist_Bwd_79"
    flows = features.flow_features(frame(spark, edge_packets()[:20]))
    wide = features.to_wide(flows)
    assert wide.columns == names
    row = features.csv_rows(wide).where("PacketsCount = '1'").first().asDict()
    assert row["flow_id"] == "10.0.0.0-192.168.0.1-40000-443-6" and row["duration"] == "0.001000" and row["Idle_Min"] == "0.00" and row["src_mac"] == "02:00:00:00:00:01"
    assert None not in row.values()


def test_empty_table(spark):
    assert features.flow_features(frame(spark, [])).count() == 0


def test_one_exchange_before_the_aggregates(spark):
    plan = segment.assign_segments(segment.with_direction(frame(spark, edge_packets()[:5])))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sinks_and_sources(spark, tmp_path):
    from rillflow.sources import packets as sources

    df = frame(spark, edge_packets()[:30])
    df.write.parquet(f"{tmp_path}/a")
    df.write.parquet(f"{tmp_path}/b")
    both = sources.read_interfaces(spark, {"x": f"{tmp_path}/a", "y": f"{tmp_path}/b"})
    assert both.groupBy("iface").count().count() == 2
    flows = features.flow_features(sources.read_packets(spark, f"{tmp_path}/a"))
    sources.write_flows(flows, f"{tmp_path}/csv", "csv")
    sources.write_flows(flows, f"{tmp_path}/parquet")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.columns == wide_columns() and back.count() == spark.read.parquet(f"{tmp_path}/parquet").count()
    with pytest.raises(ValueError):
        sources.write_flows(flows, f"{tmp_path}/x", "xml")


def test_stream_gives_the_segments_of_the_batch(spark, tmp_path):
    from rillflow.sources.packets import stream_packets
    from rillflow.streaming import flows as stream

    df = frame(spark, edge_packets())
    bounds = [0, 1001 * SECOND, 1070 * SECOND, 1 << 62]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        df.where((F.col("ts_ns") >= lo) & (F.col("ts_ns") < hi)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = stream.write_flow_stream(stream_packets(spark, f"{tmp_path}/in", files_per_batch=1), lambda d, n: d.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/checkpoint")
    run.awaitTermination(200)
    assert run.exception() is None and not run.isActive
    out, full = spark.read.parquet(f"{tmp_path}/out"), features.flow_features(df)
    names = ["a_ip", "a_port", "seg_id", "PacketsCount", "FwdBytes", "Tot_IAT_Median", "duration", "first_src_port"]
    got, want = (sorted(map(tuple, x.select(names).collect())) for x in (out, full))
    assert got and set(got) <= set(want)
    assert len(got) + stream.close_open_segments(df, out).count() == len(want)


def test_one_aggregation_equals_the_joined_ones(spark, sf_dir):
    from rillflow.operators import deltas, features, segment
    from rillflow.plans.fixtures import packets_v

    for cfg in (FlowConfig(), FlowConfig(median="exact"), FlowConfig.as_coded()):
        p = deltas.packet_deltas(deltas.with_flow_first(segment.assign_segments(segment.with_direction(packets_v(spark, sf_dir), cfg), cfg)), cfg)
        told = [f(p, cfg, features.SUITES) for f in (features._folded_features, features._joined_features)]
        assert set(told[0].columns) == set(told[1].columns)
        names = sorted(told[0].columns)
        rows = [sorted((tuple(r) for r in t.select("a_ip", "a_port", "b_ip", "b_port", "protocol", "seg_id", *names).collect()), key=lambda r: r[:6]) for t in told]
        assert len(rows[0]) == len(rows[1])
        for a, b in zip(*rows, strict=True):
            for n, x, y in zip(names, a[6:], b[6:], strict=True):
                assert x == y or isinstance(x, float) and abs(x - y) <= 1e-6 * max(1, abs(x)), n


def test_flow_row_reads_packets_once(spark, sf_dir):
    """The whole query: one scan, one exchange by key and no join."""
    from rillflow.operators.features import flow_features
    from rillflow.plans.fixtures import packets_v

    plan = flow_features(packets_v(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
