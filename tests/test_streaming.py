"""Streams against the batch engine: order, lateness, expiry, drain, restarts."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from test_flows import SECOND, edge_packets, frame, packet

from rillflow.config import FlowConfig
from rillflow.operators import features, segment
from rillflow.schema import KEY, SEG
from rillflow.sources import capture
from rillflow.sources import packets as sources
from rillflow.streaming import flows as stream

NAMES = ["a_ip", "a_port", "seg_id", "PacketsCount", "FwdBytes", "duration", "first_src_port"]
PLAIN = FlowConfig(median="none")


def rows(df):
    return sorted(map(tuple, df.select(NAMES).collect()))


def feed(spark, tmp_path, batches, name="in"):
    """A folder that gets one file a batch."""
    for b in batches:
        frame(spark, b).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return sources.stream_packets(spark, f"{tmp_path}/{name}", files_per_batch=1)


def run(packets, tmp_path, sink=None, cfg=PLAIN, **more):
    sink = sink or sources.batch_sink(f"{tmp_path}/out")
    q = stream.write_flow_stream(packets, sink, f"{tmp_path}/checkpoint", cfg, **more)
    q.awaitTermination(300)
    assert not q.isActive
    return q


def shuffled_batches(seed=1, n=4):
    """Batches by time whose rows are out of order, with neighbours exchanged over borders within the delay."""
    r = random.Random(seed)
    packets = sorted(edge_packets(), key=lambda p: p["ts_ns"] + r.randrange(8 * SECOND))
    size = len(packets) // n + 1
    return [r.sample(b, len(b)) for b in (packets[k : k + size] for k in range(0, len(packets), size))]


def test_out_of_order_batches_and_drain_give_the_batch_rows(spark, tmp_path):
    batches = shuffled_batches()
    q = run(feed(spark, tmp_path, batches), tmp_path, delay="20 seconds")
    assert q.exception() is None
    out, want = rows(sources.read_batches(spark, f"{tmp_path}/out")), rows(features.flow_features(frame(spark, edge_packets()), PLAIN))
    rest = rows(stream.drain(spark, f"{tmp_path}/checkpoint", PLAIN))
    assert out and rest and sorted(out + rest) == want


def test_late_packets_are_dropped(spark, tmp_path):
    early, late = [packet(i, (100 + i) * SECOND) for i in range(5)], [packet(9, 102 * SECOND + 1), packet(10, 1001 * SECOND)]
    far = [packet(6, 1000 * SECOND)]
    run(feed(spark, tmp_path, [early, far, [packet(7, 1000 * SECOND + 1)], late]), tmp_path)
    out = rows(sources.read_batches(spark, f"{tmp_path}/out"))
    assert [r[2:4] for r in out] == [(0, 5)]
    assert [r[2:4] for r in rows(stream.drain(spark, f"{tmp_path}/checkpoint", PLAIN))] == [(1, 3)]


def test_silent_flows_are_forgotten(spark, tmp_path):
    first = [packet(i, (1 + i) * SECOND, flow=f) for i in range(3) for f in (1, 2)]
    later = [[packet(10 + k, t * SECOND, flow=3)] for k, t in enumerate((400, 800, 801))]
    again = [[packet(20, 802 * SECOND, flow=1)], [packet(21, 1800 * SECOND, flow=3)], [packet(22, 1801 * SECOND, flow=3)]]
    q = run(feed(spark, tmp_path, [first, *later, *again]), tmp_path, ttl_s=300.0)
    counts = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    flows = spark.read.format("statestore").option("stateVarName", "flow").load(f"{tmp_path}/checkpoint")
    assert {r.a_port for r in flows.select("key.*").collect()} == {40003 if r.a_port != 443 else 443 for r in flows.select("key.*").collect()}
    assert flows.count() == 1 and max(counts) > counts[-1]
    out = rows(sources.read_batches(spark, f"{tmp_path}/out"))
    assert sorted(r[2:4] for r in out if 40001 in r or r[-1] == 40001) == [(0, 1), (0, 3)]  # a flow anew


def test_state_writes_grow_with_rows(spark, tmp_path):
    """A flow that goes on for many batches: each writes its rows and a bounded rest."""
    batches = [[packet(100 * k + i, (10 * k + 1) * SECOND + i * SECOND // 10, tcp_flags=24) for i in range(40)] for k in range(8)]
    q = run(feed(spark, tmp_path, batches), tmp_path, cfg=FlowConfig(median="none", max_packets=1 << 20), delay="1 second")
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]
    assert len(updated) == 8 and len(set(updated[2:])) == 1 and updated[-1] <= 4 * 40


def test_a_killed_batch_is_written_once(spark, tmp_path):
    batches, killed = shuffled_batches(2), []
    write = sources.batch_sink(f"{tmp_path}/out")

    def failing(df, n):
        write(df, n)
        if n == 2 and not killed:
            killed.append(n)
            raise RuntimeError("killed between write and commit")

    packets = feed(spark, tmp_path, batches)
    with pytest.raises(Exception, match="killed"):
        run(packets, tmp_path, failing, delay="20 seconds")
    run(sources.stream_packets(spark, f"{tmp_path}/in", files_per_batch=1), tmp_path, failing, delay="20 seconds")
    out = rows(sources.read_batches(spark, f"{tmp_path}/out"))
    assert killed and sorted(out + rows(stream.drain(spark, f"{tmp_path}/checkpoint", PLAIN))) == rows(features.flow_features(frame(spark, edge_packets()), PLAIN))


def test_unfinished_batches_are_not_read(spark, tmp_path):
    sink = sources.batch_sink(f"{tmp_path}/out")
    sink(spark.range(3), 0)
    sink(spark.range(5), 1)
    sink(spark.range(4), 1)
    assert sources.read_batches(spark, f"{tmp_path}/out").count() == 7
    (tmp_path / "out/batch=1/_SUCCESS").unlink()
    assert sources.read_batches(spark, f"{tmp_path}/out").count() == 3


def test_idle_segments_as_session_windows(spark, tmp_path):
    steps = [0, 60 * SECOND, 60 * SECOND + 1, 5, 61 * SECOND]
    exact = [packet(900 + i, 2000 * SECOND + sum(steps[: i + 1]), flow=99) for i in range(5)]
    packets = sorted(edge_packets() + exact, key=lambda p: p["ts_ns"])
    half = len(packets) // 2
    end = [packet(99_999, 9_000 * SECOND, flow=100)]
    q = stream.idle_segment_stream(feed(spark, tmp_path, [packets[:half], packets[half:], end])).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(200)
    cfg = FlowConfig(max_packets=1 << 30, end_flags_mask=0)
    want = segment.assign_segments(segment.with_direction(frame(spark, packets), cfg), cfg).groupBy(*SEG).agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"))
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.select(*KEY, "n", "first_ts", "last_ts").collect())) == sorted(map(tuple, want.select(*KEY, "n", "first_ts", "last_ts").collect()))


def test_rollups_update_and_their_state_ends(spark, tmp_path):
    packets = sorted(edge_packets(), key=lambda p: p["ts_ns"])
    packets += [packet(50_000 + i, (20_000 + 4_000 * i) * SECOND, flow=7) for i in range(4)]
    third = len(packets) // 3
    feed_in = feed(spark, tmp_path, [packets[:third], packets[third : 2 * third], packets[2 * third : -3], packets[-3:-2], packets[-2:-1], packets[-1:]])
    seen = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    q = stream.rollup_stream(feed_in).writeStream.outputMode("update").foreachBatch(seen).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(200)
    total = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(total) > total[-1]
    got = stream.whole_flows(spark.read.parquet(f"{tmp_path}/out").drop("batch"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, segment.flow_rollup(frame(spark, packets)).collect()))


# captured frames as a stream


def pcap(frames, nano=True, order="<"):
    head = struct.pack(f"{order}IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    unit = 1 if nano else 1000
    return head + b"".join(struct.pack(f"{order}IIII", ts // SECOND, ts % SECOND // unit, len(f), len(f) + 7) + f for ts, f in frames)


def test_captures_are_read_in_all_byte_orders(spark, tmp_path):
    frames = [(5 * SECOND + 1000 * k, bytes([k]) * (k + 1)) for k in range(20)]
    for k, (nano, order) in enumerate([(True, "<"), (True, ">"), (False, "<"), (False, ">")]):
        (tmp_path / f"{k}.pcap").write_bytes(pcap(frames, nano, order))
    (tmp_path / "short.pcap").write_bytes(pcap(frames)[:-3])
    (tmp_path / "empty.pcap").write_bytes(b"")
    got = capture.read_captures(spark, str(tmp_path)).collect()
    assert len(got) == 99 and len({r.pkt_id for r in got}) == 99
    for name, n in [("0", 20), ("3", 20), ("short", 19)]:
        own = sorted((r for r in got if r.iface == name), key=lambda r: r.pkt_id)
        assert [(r.ts_ns, bytes(r.frame)) for r in own] == frames[:n]


def test_a_replayed_capture_stream_gives_each_frame_once(spark, tmp_path):
    """A capture that grows, with a record that is cut off at first, ties in time, and a restart after an unfinished batch."""
    src, out = tmp_path / "in", f"{tmp_path}/out"
    src.mkdir()
    frames = [[(SECOND * (k // 4), bytes([f, k])) for k in range(60)] for f in range(2)]
    whole = [pcap(f) for f in frames]
    killed = []

    def sink(df, n):
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")
        if n == 1 and not killed:
            killed.append(n)
            raise RuntimeError("killed")

    def go():
        q = capture.stream_captures(spark, str(src)).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(100)

    for share in (0.41, 0.77, 1.0):
        for k, data in enumerate(whole):
            (src / f"eth{k}.pcap").write_bytes(data[: int(len(data) * share)])
        try:
            go()
        except Exception as e:
            assert "killed" in str(e)
    go()
    got = spark.read.parquet(out).orderBy("ts_ns", "pkt_id").collect()
    assert killed and len(got) == 120 == len({r.pkt_id for r in got})
    for k in range(2):
        assert [bytes(r.frame) for r in got if r.iface == f"eth{k}"] == [f for _, f in frames[k]]
