"""Splits of a series of sessions by position: plans of a row a fold and role, positions from 0, the end
not included.  They depend on the number of sessions alone and are made on the driver."""

from __future__ import annotations

from collections.abc import Sequence

Span = tuple[int, str, int, int]


def purged(n: int, horizon: int, least: int = 250, folds: int = 4) -> list[Span]:
    """Expanding training that ends a horizon before each test; none where a fold would be under 20 long."""
    room = n - least - 2 * horizon
    if room < folds * 20:
        return []
    size, out = room // folds, []
    for k in range(folds):
        start = least + horizon + k * size
        out += [(k, "train", 0, start - horizon), (k, "test", start, min(n, start + size))]
    return out


def expanding(n: int, first: float = 0.4, folds: int = 4) -> list[Span]:
    """Training on everything before each of equal tests that fill what `first` leaves."""
    cuts = [int(n * (first + (1 - first) * k / folds)) for k in range(folds + 1)]
    return [row for k in range(folds) for row in ((k, "train", 0, cuts[k]), (k, "test", cuts[k], cuts[k + 1]))]


def embargoed(n: int, horizon: int, first: float = 0.4, folds: int = 4) -> list[Span]:
    """Expanding training, and nothing used for a horizon before and after each test's start."""
    out = []
    for k, role, a, b in expanding(n, first, folds):
        out.append((k, role, a, max(a, b - horizon)) if role == "train" else (k, role, min(b, a + horizon), b))
    return out


def holdout(n: int, horizon: int = 0, shares: Sequence[float] = (0.6, 0.2)) -> list[Span]:
    """Training, validation and a frozen rest, a horizon left out before each border; (0.7, 0.15) for the
    other usual shares."""
    a, b = int(n * shares[0]), int(n * (shares[0] + shares[1]))
    return [(0, "train", 0, max(0, a - horizon)), (0, "validation", a, max(a, b - horizon)), (0, "holdout", b, n)]


def nested(n: int, horizon: int, least: int = 250, outer: int = 4, inner: int = 3) -> list[Span]:
    """For each purged fold its own purged folds within the training; numbered 100 * outer + inner, and the
    outer test as fold 100 * outer + 99."""
    out = []
    for k, role, a, b in purged(n, horizon, least, outer):
        if role == "test":
            out.append((100 * k + 99, role, a, b))
        else:
            out += [(100 * k + j, f"inner_{r}", x, y) for j, r, x, y in purged(b, horizon, least // 2, inner)]
    return out
