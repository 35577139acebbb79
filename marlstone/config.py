"""Default parameters of the panel pipeline (values, no side effects)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    pt_mult: float = 2.0
    sl_mult: float = 2.0
    horizon: int = 10
    vol_span: int = 20
    fd_d: float = 0.4
    fd_thresh: float = 1e-3
    embargo: int = 55
    test_fraction: float = 0.30
    seed: int = 42
    lag_days: int = 90
    rebalance: int = 63
    groups: int = 6
    test_groups: int = 2
    start: str = "2010-01-01"
    end: str = "2026-06-15"


DEFAULT = Config()
