"""Flow segments of a stream of packets.

Each flow keeps the packets of its open segment and those newer than the watermark. Packets at or below the
watermark are taken in order of time, whatever order they came in, and cut by the rule of the batch engine;
a segment also closes once the watermark is past its last packet by the timeout. Closed segments leave with
a number from a counter in the state, so the batch code computes their features in foreachBatch. What is
older than the watermark when it comes is dropped by the engine.

State is written in proportion to the packets that come: newer ones as one chunk a call, the open segment by appending.
A flow has one live timer. One that is silent for longer than the time to live is forgotten with its counter; its next
packet starts a flow anew, with segment 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..config import FlowConfig
from ..operators.deltas import FIRST
from ..operators.features import segment_features
from ..operators.segment import assign_segments, flow_rollup, with_key
from ..schema import KEY, PACKETS, SEG
from ..shipping import ship

_HELD = [f for f in PACKETS if f.name != "protocol"]
_NAMES = [f.name for f in _HELD]
SEGMENTED = T.StructType([
    *[T.StructField(k, {"a_ip": T.BinaryType(), "b_ip": T.BinaryType()}.get(k, T.IntegerType())) for k in KEY],
    *_HELD,
    T.StructField("is_fwd", T.BooleanType()),
    T.StructField("seg_id", T.LongType()),
    *[T.StructField(f"first_{c}", PACKETS[c].dataType) for c in FIRST],
])
#: State: a flow's counter, last time, live timer, chunks so far and first packet; the chunks of newer packets by their first time.
FLOW = T.StructType([*[T.StructField(n, T.LongType()) for n in ("segments", "last_ns", "timer_ms", "chunks")], *[T.StructField(f"first_{c}", PACKETS[c].dataType) for c in FIRST]])
CHUNK_KEY = T.StructType([T.StructField("from_ns", T.LongType()), T.StructField("chunk", T.LongType())])
CHUNK = T.StructType([T.StructField("packets", T.ArrayType(T.StructType(_HELD)))])


def cut(ts: np.ndarray, flags: np.ndarray, cfg: FlowConfig, watermark_ns: int) -> tuple[np.ndarray, int]:
    """The segment, from 0, of each of the ordered packets that begin a segment, and how many segments are closed."""
    n = len(ts)
    if not n:
        return np.zeros(0, int), 0
    start = np.r_[True, (np.diff(ts) > cfg.timeout_ns) | (flags[:-1] & cfg.end_flags_mask != 0)]
    since = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
    number = np.cumsum(since % cfg.max_packets == 0) - 1
    last = (since[-1] + 1) % cfg.max_packets == 0 or flags[-1] & cfg.end_flags_mask != 0 or watermark_ns - ts[-1] > cfg.timeout_ns
    return number, int(number[-1]) + int(last)


class SegmentProcessor(StatefulProcessor):
    """The state of one flow."""

    def __init__(self, cfg: FlowConfig, ttl_ms: int | None) -> None:
        self.cfg, self.ttl_ms = cfg, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", FLOW)
        self.open = handle.getListState("open", T.StructType(_HELD))
        self.later = handle.getMapState("later", CHUNK_KEY, CHUNK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield from self._advance(key, [b[_NAMES] for b in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield from self._advance(key, [], timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _forget(self, timer_ms: int) -> None:
        for state in (self.flow, self.open, self.later):
            state.clear()
        if timer_ms:
            self.handle.deleteTimer(timer_ms)

    def _advance(self, key, new: list[pd.DataFrame], timers, expired_ms: int = 0) -> Iterator[pd.DataFrame]:
        watermark_ms = timers.getCurrentWatermarkInMs()
        watermark = watermark_ms * 1_000_000
        known = tuple(self.flow.get()) if self.flow.exists() else (0, 0, 0, 0, *[None] * len(FIRST))
        n, last_ns, timer_ms, chunks = known[:4]
        timer_ms = 0 if expired_ms == timer_ms else timer_ms
        first = known[4:]
        waiting = [tuple(k) for k in self.later.keys()] if chunks else []
        if not new and not waiting and self.ttl_ms is not None and watermark_ms - last_ns // 1_000_000 > self.ttl_ms and not self.open.exists():
            self._forget(timer_ms)
            return
        parts = [*new]
        for k in [k for k in waiting if k[0] <= watermark]:
            parts.append(pd.DataFrame([tuple(p) for p in self.later.getValue(k)[0]], columns=_NAMES))
            self.later.removeKey(k)
        came = pd.concat(parts, ignore_index=True).sort_values(["ts_ns", "pkt_id"], kind="stable") if parts else pd.DataFrame(columns=_NAMES)
        is_ready = (came["ts_ns"] <= watermark).to_numpy(bool)
        ready, later = came[is_ready], came[~is_ready]
        rest = [k[0] for k in waiting if k[0] > watermark]
        if len(later):
            self.later.updateValue((int(later["ts_ns"].iloc[0]), chunks), ([tuple(r) for r in later.itertuples(index=False, name=None)],))
            rest.append(int(later["ts_ns"].iloc[0]))
            chunks += 1
        if len(ready) and first[FIRST.index("src_port")] is None:
            first = tuple(ready[c].iloc[0] for c in FIRST)
        before = [tuple(p) for p in self.open.get()] if self.open.exists() else []
        held = pd.concat([pd.DataFrame(before, columns=_NAMES), ready], ignore_index=True) if before else ready
        number, closed = cut(held["ts_ns"].to_numpy(np.int64), held["tcp_flags"].to_numpy(np.int64), self.cfg, watermark)
        is_closed = number < closed
        if closed:
            self.open.clear()
            still = held[~is_closed]
        else:
            still = ready
        if len(still):
            self.open.appendList([tuple(r) for r in still.itertuples(index=False, name=None)])
        last_ns = int(held["ts_ns"].iloc[-1]) if len(held) else last_ns
        due = [last_ns + self.cfg.timeout_ns] if len(held) and not is_closed.all() else []
        due += [min(rest)] if rest else []
        if due:
            due_ms = min(due) // 1_000_000 + 1
        else:
            due_ms = last_ns // 1_000_000 + self.ttl_ms + 1 if self.ttl_ms is not None else 0
        if due_ms != timer_ms:
            if timer_ms:
                self.handle.deleteTimer(timer_ms)
            if due_ms:
                self.handle.registerTimer(due_ms)
        self.flow.update((n + closed, last_ns, due_ms, chunks, *first))
        if not closed:
            return
        out = held[is_closed].copy()
        ways = [self.cfg.direction != "as_coded" and bytes(a) == bytes(first[0]) and p == first[FIRST.index("src_port")] for a, p in zip(out["src_ip"], out["src_port"], strict=True)]
        extra = dict(zip(KEY, key, strict=True)) | {"is_fwd": ways, "seg_id": n + number[is_closed]} | {f"first_{c}": v for c, v in zip(FIRST, first, strict=True)}
        yield out.assign(**{c: [v] * len(out) if isinstance(v, (bytes, bytearray)) else v for c, v in extra.items()})[SEGMENTED.names]


def _timed(packets: DataFrame, cfg: FlowConfig) -> DataFrame:
    return with_key(packets, cfg).withColumn("event_time", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("bigint")))


def segment_stream(packets: DataFrame, cfg: FlowConfig = FlowConfig(), delay: str = "10 seconds", ttl_s: float | None = 3600.0) -> DataFrame:
    """A stream of packets to a stream of the packets of closed segments, with SEGMENTED columns.

    ttl_s: seconds of silence after which a flow is forgotten; None keeps counters for ever. Needs the RocksDB state store:
    spark.sql.streaming.stateStore.providerClass.
    """
    ship(packets.sparkSession)
    ttl_ms = None if ttl_s is None else round(max(ttl_s, cfg.flow_timeout_s) * 1000)
    return _timed(packets, cfg).withWatermark("event_time", delay).groupBy(*KEY).transformWithStateInPandas(SegmentProcessor(cfg, ttl_ms), SEGMENTED, "append", "eventTime")


def write_flow_stream(packets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, cfg: FlowConfig = FlowConfig(), delay: str = "10 seconds", trigger: dict | None = None, ttl_s: float | None = 3600.0) -> StreamingQuery:
    """Runs the engine on a stream: sink gets the flow rows of each batch's closed segments, and the batch's number."""
    batch = lambda df, n: sink(segment_features(df, cfg), n)
    return segment_stream(packets, cfg, delay, ttl_s).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(**(trigger or {"availableNow": True})).start()


def drain(spark: SparkSession, checkpoint: str, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """The flow rows of the segments that are still open in the state of a stopped stream, without its input.

    They are those which the batch engine would cut from the packets that the stream has not given out yet.
    """
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    keys = [F.col(f"key.{k}").alias(k) for k in KEY]
    packet = lambda p: [p[f.name].cast(f.dataType).alias(f.name) for f in _HELD]
    opened = read("open").select(*keys, *packet(F.col("list_element")))
    later = read("later").select(*keys, F.explode("user_map_value.packets").alias("p")).select(*KEY, *packet(F.col("p")))
    flows = read("flow").select(*keys, "value.*").select(*KEY, "segments", *[F.col(f"first_{c}").alias(f"known_{c}") for c in FIRST])
    rest = assign_segments(opened.unionByName(later), cfg).join(flows, KEY)
    # a flow whose packets are all newer than the watermark has no first one yet
    first = F.min(F.struct("ts_ns", "pkt_id", *FIRST)).over(Window.partitionBy(*KEY))
    known = F.col("known_src_port").isNotNull()
    rest = rest.withColumn("earliest", first).withColumns({f"first_{c}": F.when(known, F.col(f"known_{c}")).otherwise(F.col(f"earliest.{c}")) for c in FIRST})
    same = (F.col("first_src_ip") == F.col("src_ip")) & (F.col("first_src_port") == F.col("src_port"))
    told = rest.withColumns({"seg_id": F.col("seg_id") + F.col("segments"), "is_fwd": F.lit(False) if cfg.direction == "as_coded" else same})
    return segment_features(told.select(*SEGMENTED.names), cfg)


def idle_segment_stream(packets: DataFrame, cfg: FlowConfig = FlowConfig(), delay_s: float = 10.0) -> DataFrame:
    """Segments that only idle time cuts, as session windows: key, n, first_ts, last_ts of each closed one.

    The window's clock counts nanoseconds as microseconds, so that a gap of exactly the timeout, which does not
    cut (Spark joins windows that touch), and one that is a nanosecond longer, which does, are told apart.
    """
    timed = with_key(packets, cfg).withColumn("event_time", F.timestamp_micros("ts_ns"))
    session = F.session_window("event_time", f"{cfg.timeout_ns} microseconds")
    told = timed.withWatermark("event_time", f"{round(delay_s * 1e9)} microseconds").groupBy(*KEY, session)
    return told.agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts")).drop("session_window")


def rollup_stream(packets: DataFrame, cfg: FlowConfig = FlowConfig(direction="as_coded"), every: str = "1 hour", delay: str = "10 seconds") -> DataFrame:
    """Flow rollups by span of time (start), updated with every batch; write it in update mode.

    The watermark ends a span's state, so state does not grow with the life of the stream; whole_flows adds spans up.
    """
    timed = _timed(packets, cfg).withWatermark("event_time", delay)
    return flow_rollup(timed, cfg, F.window("event_time", every)).select(F.col("window.start").alias("start"), *KEY, "pkts_count", "total_bytes", "start_ts", "last_ts", "tcp_flags")


def whole_flows(spans: DataFrame) -> DataFrame:
    """The rollup of whole flows from that of their spans, of which the last state of each counts (by pkts_count)."""
    last = spans.groupBy(*KEY, "start").agg(F.max(F.struct("pkts_count", "total_bytes", "start_ts", "last_ts", "tcp_flags")).alias("s")).select(*KEY, "s.*")
    return last.groupBy(*KEY).agg(F.sum("pkts_count").alias("pkts_count"), F.sum("total_bytes").alias("total_bytes"), F.min("start_ts").alias("start_ts"), F.max("last_ts").alias("last_ts"), F.bit_or("tcp_flags").alias("tcp_flags"))


def close_open_segments(packets: DataFrame, emitted: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """drain for a stream whose state is lost: from all its packets, and the key and seg_id of the rows that it wrote."""
    from ..operators.features import flow_features

    return flow_features(packets, cfg).join(emitted.select(*SEG).distinct(), SEG, "left_anti")
