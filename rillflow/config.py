"""Parameters of the flow engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FlowConfig:
    """How packets become flow segments and features.

    direction: "first_sender" (a flow has both directions; forward is whoever sent its first packet) or
    "as_coded" (each direction is a flow of its own, and every packet counts as backward).
    median: "p2" (the streaming estimate; payload suites take the histogram), "exact" or "none".
    """

    max_packets: int = 50
    end_flags_mask: int = 0x05
    flow_timeout_s: float = 60.0
    idle_threshold_s: float = 1.0
    bulk_threshold_s: float = 1.0
    bulk_min_packets: int = 3
    hist_bins: int = 80
    hist_step: int = 20
    moment_epsilon: float = 1e-9
    min_duration_s: float = 0.001
    idle_close: str = "last_packet"
    direction: str = "first_sender"
    median: str = "p2"
    exact_mode: bool = False
    payload_entropy: bool = True
    floor_extrema: bool = True
    backward_window: bool = True
    mixed_inner_v4: bool = False

    @classmethod
    def as_coded(cls) -> FlowConfig:
        """The behaviour of the coded engine where it is a function of the packet table."""
        return cls(direction="as_coded", payload_entropy=False, backward_window=False, mixed_inner_v4=True)

    @property
    def timeout_ns(self) -> int:
        return round(self.flow_timeout_s * 1e9)
