"""A sequential model of the flow engine, written from its specification, for comparison."""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass


@dataclass
class Marker:
    """A marker of Jain and Chlamtac's estimate: its height, its place, and its share of the observations."""

    height: float
    place: float
    share: float

    def wants(self, count: int) -> float:
        return 1 + self.share * count


def _piecewise_parabola(below: Marker, at: Marker, above: Marker, step: int) -> float:
    """Formula of the paper's box 1, as the weighted mean of the slopes on both sides."""
    rise, fall = (above.height - at.height) / (above.place - at.place), (at.height - below.height) / (at.place - below.place)
    return at.height + step / (above.place - below.place) * ((at.place - below.place + step) * rise + (above.place - at.place - step) * fall)


def p2(values: list[float]) -> float:
    """The median estimate: the middle of five markers, moved one observation at a time."""
    head = sorted(values[:5])
    if len(values) <= 5:
        return head[len(head) // 2] if head else 0.0
    markers = [Marker(h, k + 1, k / 4) for k, h in enumerate(head)]
    for count, x in enumerate(values[5:], 6):
        inner = [m.height for m in markers[1:4]]
        for m in markers[bisect.bisect_right(inner, x) + 1 :]:
            m.place += 1
        markers[0].height, markers[4].height = min(markers[0].height, x), max(markers[4].height, x)
        for below, at, above in zip(markers, markers[1:], markers[2:], strict=False):
            away = at.wants(count) - at.place
            goal = above if away > 0 else below
            if abs(away) < 1 or abs(goal.place - at.place) <= 1:
                continue
            step = 1 if away > 0 else -1
            curve = _piecewise_parabola(below, at, above, step)
            at.height = curve if below.height < curve < above.height else at.height + step * (goal.height - at.height) / (goal.place - at.place)
            at.place += step
    return markers[2].height


def stats(xs: list[float]) -> dict[str, float | None]:
    n = len(xs)
    mean = sum(xs) / n if n else 0.0
    m2, m3, m4 = (sum((x - mean) ** k for x in xs) for k in (2, 3, 4))
    var = m2 / (n - 1) if n > 1 else 0.0
    return {
        "Max": float(math.floor(max(xs))) if n else 0.0,
        "Min": float(math.floor(min(xs))) if n else None,
        "Mean": mean,
        "Std": math.sqrt(var),
        "Var": var,
        "Skew": math.sqrt(n) * m3 / m2**1.5 if m2 > 1e-9 else 0.0,
        "Kurt": n * m4 / m2**2 - 3 if m2 > 1e-9 else 0.0,
        "CoV": math.sqrt(var) / mean if mean > 0 else 0.0,
    }


def histogram_median(xs: list[int]) -> float:
    if not xs:
        return 0.0
    bins = [0] * 80
    for x in xs:
        bins[min(x // 20, 79)] += 1
    half, acc = (len(xs) + 1) // 2, 0
    for i, h in enumerate(bins):
        if h and acc + h >= half:
            return i * 20 + 20 * (half - acc) / h
        acc += h
    raise AssertionError


def segments(packets: list[dict], max_packets: int = 50, mask: int = 5, timeout: int = 60_000_000_000) -> list[list[dict]]:
    """The segments of one flow's packets, in order."""
    out: list[list[dict]] = []
    fresh = True
    for p in sorted(packets, key=lambda p: (p["ts_ns"], p["pkt_id"])):
        if fresh or p["ts_ns"] - out[-1][-1]["ts_ns"] > timeout:
            out.append([])
        out[-1].append(p)
        fresh = len(out[-1]) >= max_packets or bool(p["tcp_flags"] & mask)
    return out


def features(seg: list[dict], source: tuple) -> dict:
    """What a segment's row holds; source: address and port of the sender of the flow's first packet."""
    side = lambda p: "Fwd" if (p["src_ip"], p["src_port"]) == source else "Bwd"
    seconds = lambda a, b: (b["ts_ns"] - a["ts_ns"]) / 1e9
    suites, bulk = {}, {}
    for d, own in (("Tot", seg), *((d, [p for p in seg if side(p) == d]) for d in ("Fwd", "Bwd"))):
        steps = list(zip(own, own[1:], strict=False))
        suites[f"{d}_Pay"], suites[f"{d}_Hdr"] = ([float(p[c]) for p in own] for c in ("payload_len", "header_len"))
        suites[f"{d}_IAT"] = [seconds(a, b) for a, b in steps]
        suites[f"{d}_DeltaLen"] = [float(abs(b["payload_len"] - a["payload_len"])) for a, b in steps]
        # a run goes on while gaps are short; a long gap begins the next one, which counts its packet
        runs = [[]]
        for a, b in steps:
            runs = [*runs, []] if seconds(a, b) >= 1.0 else runs
            runs[-1].append(b["payload_len"])
        bulk[d] = [sum(runs[-1]), len(runs[-1]), sum(len(r) >= 3 for r in runs[:-1])]
    for s, c in (("Win", "window_size"), ("IpId", "ip_id"), ("Frag", "frag_off"), ("TTL_Var", "ttl")):
        suites[s] = [float(p[c]) for p in seg]
    # active periods are what stands between long gaps
    cuts = [k for k, (a, b) in enumerate(zip(seg, seg[1:], strict=False), 1) if seconds(a, b) > 1.0]
    periods = [seg[a:b] for a, b in zip([0, *cuts], [*cuts, len(seg)], strict=True)]
    suites["Active"] = [seconds(p[0], p[-1]) for p in periods[:-1]]
    suites["Idle"] = [seconds(a[-1], b[0]) for a, b in zip(periods, periods[1:], strict=False)]
    start = periods[-1][0]["ts_ns"]
    end = seg[-1]["ts_ns"]
    n = {d: len(suites.get(f"{d}_Pay", [])) for d in ("Tot", "Fwd", "Bwd")}
    size = {d: int(sum(suites.get(f"{d}_Pay", []))) for d in ("Tot", "Fwd", "Bwd")}
    return {
        "suites": suites, "bulk": bulk, "n": n, "size": size, "duration": (end - start) / 1e9 if end > start else 0.001, "timestamp": end / 1e9,
        "flags": [sum(bool(p["tcp_flags"] >> b & 1) for p in seg) for b in range(8)], "last": seg[-1], "first": seg[0],
    }
