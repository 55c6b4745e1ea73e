"""Options of the engine, with the defaults of its command surface."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, replace


def log_to(path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """The engine's messages with their time on the standard error stream, and in a file too if a path is given."""
    log = logging.getLogger("helixframe")
    log.setLevel(level)
    for handler in (logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    return log


@dataclass(frozen=True)
class EngineConfig:
    k: int = 15
    eta: float | None = None  # penalty; None: from the histogram
    gamma: float = 1e-20
    rel_tol: float = 1e-4
    max_iterations: int | None = None  # None: until rel_tol is met
    error_rate: float = 0.01
    max_hamming: int | None = None  # None: k // 2
    window: int | None = None  # emission and Hamming windows; None: k // 4
    max_states: int = 256  # of a neighbourhood before its Hamming cap is lowered
    max_states_q2: int = 32768  # the same where a whole window has quality 2
    approx_states: int | None = None  # keep so many states of the largest alpha; None: all
    thin_nats: float | None = None  # drop states whose score lies farther below the read's best; None: keep
    adaptive: bool = True  # Hamming caps per read and window; else max_hamming everywhere
    search_first: bool = True  # first states by search; else the observed first k-mer alone
    rebuild: bool = True  # new first states for a read whose trellis dies
    reverse_decode: bool = False  # decode a read whose trellis dies from its other strand
    partial_decoding: int = 0  # 1, 2: decode what a dead trellis reached
    update_quality: bool = True
    use_init_prob: bool = False
    emission: str = "counted"  # or "phred", "primitive"
    penalized_em: bool = True
    joint_strands: bool = False
    min_quality: float = 15.0  # of a solid k-mer's window
    broadcast_bytes: int = 512 << 20  # largest model that is shipped to every executor; larger ones are read in pages
    cache_bytes: int = 256 << 20  # pages of a larger model that a worker keeps

    def __post_init__(self):
        if not 4 <= self.k <= 31:
            raise ValueError("k must lie in 4..31")
        if self.max_hamming is not None and not 1 <= self.max_hamming <= min(self.k, 15):
            raise ValueError("max_hamming must lie in 1..min(k, 15)")
        if self.emission not in ("counted", "phred", "primitive"):
            raise ValueError("emission must be counted, phred or primitive")

    @property
    def hamming(self) -> int:
        return self.max_hamming or self.k // 2

    @property
    def slot(self) -> int:
        return self.window or max(1, self.k // 4)

    def rho(self, eta: float | None = None) -> float:
        """The threshold on expected counts that a penalty amounts to."""
        return (self.eta if eta is None else eta) / math.log1p(1 / self.gamma)

    def with_(self, **changes) -> EngineConfig:
        return replace(self, **changes)
