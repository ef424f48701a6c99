"""Flows that are cut over many tasks, against the plain path and sequential models."""

import random

import numpy as np
import pytest
import simulator
from pyspark.sql import functions as F
from test_flows import SECOND, edge_packets, frame, packet

from rillflow.config import FlowConfig
from rillflow.functions.median import P2, p2_medians
from rillflow.operators import deltas, features, segment
from rillflow.schema import KEY, PACKETS, SEG

LONG = FlowConfig(max_packets=1 << 30, flow_timeout_s=1e6, end_flags_mask=0)


def rows_of(df):
    names = sorted(set(df.columns) - {*SEG})
    return names, sorted((tuple(r) for r in df.select(*SEG, *names).collect()), key=lambda r: r[:6])


def same(a, b):
    (names, xs), (more, ys) = rows_of(a), rows_of(b)
    assert names == more and len(xs) == len(ys) and xs
    for x, y in zip(xs, ys, strict=True):
        assert x[:6] == y[:6]
        for n, u, v in zip(names, x[6:], y[6:], strict=True):
            assert u == v or isinstance(u, float) and u == pytest.approx(v, rel=1e-9, abs=1e-9), n


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(features, "BUCKET_PACKETS", 7)


@pytest.mark.parametrize("cfg", [FlowConfig(), FlowConfig.as_coded(), LONG])
def test_flow_rows_are_those_of_the_plain_path(spark, small_buckets, cfg):
    df = frame(spark, edge_packets())
    few = ["Tot_Pay", "Bwd_IAT", "Active", "Idle"]
    same(features.flow_features(df, cfg, few, least=30), features.flow_features(df, cfg, few))


def test_deltas_of_long_segments_in_buckets(spark):
    """One packet a bucket up to many: every border can fall anywhere."""
    r = random.Random(9)
    packets = [packet(i, ts, flow=i % 2, way=r.random() < 0.6, payload_len=r.randrange(3000)) for i, ts in enumerate(np.cumsum([r.choice([0, 1, 400, 1000, 1001, 2500]) * SECOND // 1000 for _ in range(300)]).tolist())]
    plain = segment.assign_segments(segment.with_direction(frame(spark, packets), LONG), LONG)
    want = deltas.packet_deltas(plain, LONG)
    for k in (1, 3, 50):
        place = F.row_number().over(segment.by_flow())
        got = deltas.packet_deltas_in_buckets(plain.withColumn("bucket", F.floor(place / k).cast("long")), LONG).drop("bucket")
        assert set(got.columns) == set(want.columns)
        names = sorted(want.columns)
        assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect()))


def big_flow(spark, n):
    """A flow of n packets, in both directions, with gaps of all kinds."""
    i = F.col("id")
    h = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    way = h % 3 > 0
    base = packet(0, 0)
    a, b = bytes(base["src_ip"]), bytes(base["dst_ip"])
    gap = F.when(h % 1009 == 0, F.lit(70 * SECOND)).when(h % 41 == 0, F.lit(3 * SECOND // 2)).otherwise((h % 1000) * 1000)
    from pyspark.sql import Window

    rows = spark.range(n).select("id", h.alias("h"), gap.alias("gap"), way.alias("way"))
    # times without a window over all rows: the gap is added within a thousand rows, each of which has its own span
    rows = rows.withColumns({"block": F.floor(i / 1000)}).withColumn("at", F.sum("gap").over(Window.partitionBy("block").orderBy("id")))
    values = {f.name: F.lit(base[f.name]) for f in PACKETS} | {
        "pkt_id": F.col("id"), "ts_ns": F.col("block") * (300 * SECOND) + F.col("at"), "src_ip": F.when(F.col("way"), F.lit(a)).otherwise(F.lit(b)), "dst_ip": F.when(F.col("way"), F.lit(b)).otherwise(F.lit(a)),
        "src_port": F.when(F.col("way"), F.lit(40000)).otherwise(F.lit(443)), "dst_port": F.when(F.col("way"), F.lit(443)).otherwise(F.lit(40000)),
        "payload_len": F.col("h") % 1700, "tcp_flags": F.when(F.col("h") % 501 == 0, F.lit(17)).otherwise(F.lit(24)),
    }
    return rows.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in PACKETS])


def test_a_flow_of_a_million_packets(spark, tmp_path):
    big_flow(spark, 1_000_000).write.parquet(f"{tmp_path}/big")
    packets = spark.read.parquet(f"{tmp_path}/big")
    large = features.large_flows(packets)
    assert [r.n for r in large.collect()] == [1_000_000]
    cut = features.segments_of_large(packets, large)
    cut.write.parquet(f"{tmp_path}/cut")
    cut = spark.read.parquet(f"{tmp_path}/cut")
    sizes = sorted(r["count"] for r in cut.groupBy(*KEY, "bucket").count().collect())
    assert len(sizes) >= 32 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    plain = segment.assign_segments(segment.with_direction(packets)).select("pkt_id", "seg_id", "is_fwd")
    assert cut.select("pkt_id", "seg_id", "is_fwd").exceptAll(plain).count() == 0 and cut.count() == 1_000_000
    few = ["Tot_Pay", "Tot_IAT"]
    told = features.segment_features(cut, names=few).agg(F.sum("PacketsCount"), F.sum("FwdBulkCnt"), F.sum("Tot_IAT_Median"), F.count(F.lit(1))).first()
    want = features.segment_features(segment.assign_segments(segment.with_direction(packets)), names=few).agg(F.sum("PacketsCount"), F.sum("FwdBulkCnt"), F.sum("Tot_IAT_Median"), F.count(F.lit(1))).first()
    assert told[0] == want[0] == 1_000_000 and told[1] == want[1] and told[3] == want[3] and told[2] == pytest.approx(want[2])


def test_a_segment_of_a_million_values_equals_the_sequential_estimate(spark, tmp_path):
    packets = big_flow(spark, 1_000_000)
    seg = segment.with_key(packets).withColumns({"seg_id": F.lit(0).cast("long"), "is_fwd": F.lit(True)})
    p = seg.withColumns({c: F.lit(None).cast("double") for c in ("iat", "dir_iat", "delta_len", "dir_delta_len", "active_s", "idle_s")} | {"hist_bin": F.lit(0)})
    got = {r.suite: r.Median for r in features.suites(p, ["Tot_Pay", "Win", "TTL_Var"], LONG).collect()}
    values = [float(r.payload_len) for r in packets.orderBy("ts_ns", "pkt_id").select("payload_len").collect()]
    assert got["Tot_Pay"] == pytest.approx(simulator.p2(values)) and got["TTL_Var"] == 64.0 and got["Win"] == 0.0


def test_the_estimate_goes_on_over_batches():
    import pyarrow as pa

    from rillflow.functions.median import p2_of_sorted

    r = np.random.default_rng(4)
    series = {k: r.choice([0.0, 1.0, 2.5, 40.0, 77.5], n) for k, n in enumerate([1, 2, 5, 6, 7, 90, 3, 400, 11])}
    keys, values = np.concatenate([np.full(len(v), k) for k, v in series.items()]), np.concatenate(list(series.values()))
    for size in (1, 4, 50, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(values[i : i + size])], ["k", "x"]) for i in range(0, len(keys), size)]
        got = {k: m for b in p2_of_sorted(["k"], "x")(iter([batches[0].slice(0, 0), *batches])) for k, m in zip(*[c.to_pylist() for c in b.columns], strict=True)}
        assert got == pytest.approx({k: simulator.p2(v.tolist()) for k, v in series.items()})
        assert got == dict(enumerate(p2_medians([*series.values()]).tolist()))
    state = P2()
    assert state.median() == 0.0 == p2_medians([np.zeros(0)])[0]


def test_tasks_grow_with_the_packets(spark, monkeypatch):
    """Each of the windows' tasks holds about as many packets, however many there are, and rows stay the same."""
    df = frame(spark, edge_packets())
    few = ["Tot_Pay", "Bwd_IAT"]
    want = features.flow_features(df, names=few)
    want.collect()
    monkeypatch.setattr(segment, "FEW_PACKETS", 30)
    monkeypatch.setattr(segment, "TASK_PACKETS", 100)
    n = df.count()
    got = features.flow_features(df, names=few)
    assert got.rdd.getNumPartitions() == features.prepared(df).rdd.getNumPartitions() == -(-n // 100) > 4
    plan = features.flow_features(df, names=few)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    same(got, want)


def test_text_rows_keep_the_tasks_of_their_flows(spark, monkeypatch):
    """The text of a row is made where its flow lies, so its tasks grow with the packets too."""
    df = frame(spark, edge_packets())
    monkeypatch.setattr(segment, "FEW_PACKETS", 30)
    monkeypatch.setattr(segment, "TASK_PACKETS", 100)
    told = features.csv_rows(features.to_wide(features.flow_features(df)))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and f", {-(-df.count() // 100)}), REPARTITION_BY_NUM" in plan


def test_estimates_are_made_in_slices(spark, monkeypatch):
    from rillflow.functions import median

    sizes = []
    plain = median.p2_medians
    monkeypatch.setattr(median, "p2_medians", lambda rows: sizes.append(len(rows)) or plain(rows))
    r = np.random.default_rng(1)
    import pandas as pd

    rows = pd.Series([[r.random(k % 9), r.random(7)] for k in range(1201)], index=range(5, 1206))
    got = next(median.p2_medians_of.func(iter([rows])))
    assert sizes == [1000, 1000, 402] and list(got.index) == list(rows.index)
    assert all(np.allclose(a, plain(b)) for a, b in zip(got, rows, strict=True))
    assert len(next(median.p2_medians_of.func(iter([rows.iloc[:0]])))) == 0


@pytest.mark.parametrize("cfg", [FlowConfig(), LONG])
def test_parts_of_cut_flows_are_dealt_by_their_packets(spark, monkeypatch, cfg):
    """The tasks of large flows' buckets and segments grow with the packets, whatever Spark's number of partitions."""
    df = frame(spark, edge_packets())
    few = ["Tot_Pay", "Bwd_IAT"]
    want = features.flow_features(df, cfg, few)
    n = sum(r.n for r in features.large_flows(df, cfg, 30).collect())
    monkeypatch.setattr(segment, "FEW_PACKETS", 30)
    monkeypatch.setattr(segment, "TASK_PACKETS", 20)
    monkeypatch.setattr(features, "TASK_PACKETS", 20, raising=False)
    got = features.flow_features(df, cfg, few, least=30)
    plan = got._jdf.queryExecution().executedPlan().toString()
    tasks = f", {-(-n // 20)}), REPARTITION_BY_NUM"
    assert -(-n // 20) > 4
    assert any("seg_id" in line and tasks in line for line in plan.splitlines())
    assert any("bucket" in line and "seg_id" not in line and tasks in line for line in plan.splitlines())
    same(got, want)


def test_buckets_of_large_flows_stay_small(spark, monkeypatch):
    """However few partitions Spark has, a bucket holds about as many packets as a task is to have."""
    monkeypatch.setattr(features, "BUCKETS", 1)
    monkeypatch.setattr(features, "TASK_PACKETS", 1_000, raising=False)
    packets = big_flow(spark, 50_000)
    large = features.large_flows(packets)
    assert [r.n for r in large.collect()] == [50_000]
    sizes = [r["count"] for r in features.segments_of_large(packets, large).groupBy("bucket").count().collect()]
    assert len(sizes) >= 40 and max(sizes) < 2_500
