"""Preconditions of temporal protocols, and promotion gates over windows."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

WEEK = datetime.timedelta(days=7)


def guard_sealed(cutoff: datetime.date, sealed: datetime.date) -> None:
    """Rejects a cutoff whose label week touches the sealed one."""
    if cutoff < sealed + WEEK and sealed < cutoff + WEEK:
        raise ValueError(f"the label week of {cutoff} overlaps the sealed week of {sealed}")


def check_rolling(inner_train: datetime.date, inner_valid: datetime.date, outer: datetime.date) -> None:
    """Inner training, inner validation and outer evaluation must follow each other without overlap of labels."""
    if not (inner_train + WEEK <= inner_valid and inner_valid + WEEK <= outer):
        raise ValueError("windows must be at least a label week apart, in order")


def check_causal(training: Sequence[datetime.date], target: datetime.date) -> None:
    """The last training label must end by the target cutoff."""
    if training and max(training) + WEEK > target:
        raise ValueError("a training label ends after the target cutoff")


def promotion_gate(deltas: Sequence[float], mean: float = 1e-4, positive: float = 0.75, worst: float = -5e-4) -> bool:
    """Whether the changes over windows are good enough on average, in most windows, and in the worst."""
    return bool(deltas) and sum(deltas) / len(deltas) >= mean and sum(d > 0 for d in deltas) >= positive * len(deltas) and min(deltas) >= worst


def smallest_depth(retention: dict[int, Sequence[float]], least: float = 0.95, otherwise: int = 300) -> int:
    """The least shortlist depth that keeps enough positives in all windows."""
    return min((k for k, shares in retention.items() if shares and min(shares) >= least), default=otherwise)


def interest_count(events: int, most: int) -> int:
    """How many interests a user of so many events gets."""
    return 1 if events < 5 else max(1, min(most, events.bit_length() - 1))


def sign_pattern(deltas: Sequence[float]) -> str:
    """Whether the changes agree in sign over all windows."""
    signs = {(d > 0) - (d < 0) for d in deltas}
    return "gain" if signs == {1} else "loss" if signs == {-1} else "flat" if signs <= {0} else "mixed"
