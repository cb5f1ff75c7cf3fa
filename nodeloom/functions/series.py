"""Numbers along a line: splines, resampling, and dynamic time warping, in numpy."""

from __future__ import annotations

import numpy as np


def spline_basis(knots: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Matrix that takes values at the knots to a not-a-knot cubic spline's values at ``at``.

    Fewer than four knots give the polynomial through them. Outside the knots the end pieces go on.
    """
    knots, at = np.asarray(knots, float), np.asarray(at, float)
    n = len(knots)
    if n < 4:
        return np.stack([np.prod([(at - knots[j]) / (knots[i] - knots[j]) for j in range(n) if j != i], axis=0) if n > 1 else np.ones_like(at) for i in range(n)], 1)
    h = np.diff(knots)
    left, right = np.zeros((n, n)), np.zeros((n, n))  # left @ second derivatives = right @ values
    for i in range(1, n - 1):
        left[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    left[0, :3] = h[1], -h[0] - h[1], h[0]
    left[-1, -3:] = h[-1], -h[-2] - h[-1], h[-2]
    second = np.linalg.solve(left, right)
    piece = np.clip(np.searchsorted(knots, at, side="right") - 1, 0, n - 2)
    width, a, b = h[piece], knots[piece + 1] - at, at - knots[piece]
    eye = np.eye(n)
    return (
        second[piece] * ((a**3 / width - a * width) / 6)[:, None]
        + second[piece + 1] * ((b**3 / width - b * width) / 6)[:, None]
        + eye[piece] * (a / width)[:, None]
        + eye[piece + 1] * (b / width)[:, None]
    )


def pieces_basis(knots: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Values at ``at`` of each piecewise polynomial of an order that is 1 at one knot's interval: B-splines, by their recurrence."""
    out = [((knots[i] <= at) & (at < knots[i + 1])).astype(float) for i in range(len(knots) - 1)]
    last = max(i for i in range(len(knots) - 1) if knots[i] < knots[i + 1])
    out[last][at == knots[-1]] = 1.0
    for k in range(1, order + 1):
        following = []
        for i in range(len(out) - 1):
            rise, fall = knots[i + k] - knots[i], knots[i + k + 1] - knots[i + 1]
            up = (at - knots[i]) / rise * out[i] if rise > 0 else 0.0
            down = (knots[i + k + 1] - at) / fall * out[i + 1] if fall > 0 else 0.0
            following.append(up + down + np.zeros(len(at)))
        out = following
    return np.stack(out, 1)


def polynomial_pieces(x: np.ndarray, y: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The spline of an order through all points; its knots are points, or halfway between them if the order is even."""
    inner = x[(order + 1) // 2 : len(x) - (order + 1) // 2] if order % 2 else ((x[1:] + x[:-1]) / 2)[order // 2 : len(x) - 1 - order // 2]
    knots = np.concatenate((np.repeat(x[0], order + 1), inner, np.repeat(x[-1], order + 1)))
    return pieces_basis(knots, at, order) @ np.linalg.solve(pieces_basis(knots, x, order), y)


def hermite(x: np.ndarray, y: np.ndarray, slopes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubics between points from their values and slopes."""
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = np.diff(x)[i]
    t = (at - x[i]) / h
    return (1 + 2 * t) * (1 - t) ** 2 * y[i] + t * (1 - t) ** 2 * h * slopes[i] + t**2 * (3 - 2 * t) * y[i + 1] - t**2 * (1 - t) * h * slopes[i + 1]


def monotone_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes under which no piece overshoots its ends (Fritsch and Butland, 1984)."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return np.repeat(d, 2)
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.where(d[:-1] * d[1:] > 0, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)

    def end(h0: float, h1: float, d0: float, d1: float) -> float:
        slope = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if slope * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 <= 0 and abs(slope) > 3 * abs(d0) else slope

    return np.concatenate(([end(h[0], h[1], d[0], d[1])], inner, [end(h[-1], h[-2], d[-1], d[-2])]))


def akima_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes that follow the local trend on either side (Akima, 1970)."""
    d = np.diff(y) / np.diff(x)
    if len(x) == 2:
        return np.repeat(d, 2)
    before, after = [2 * d[0] - d[1]], [2 * d[-1] - d[-2]]
    d = np.concatenate(([2 * before[0] - d[0]], before, d, after, [2 * after[0] - d[-1]]))
    left, right = np.abs(d[1:-2] - d[:-3]), np.abs(d[3:] - d[2:-1])
    mean = (d[1:-2] + d[2:-1]) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(left + right > 1e-9 * (left + right).max(initial=0), (right * d[1:-2] + left * d[2:-1]) / (left + right), mean)


def fill_smooth(pos: np.ndarray, values: np.ndarray, method: str = "cubic", order: int = 3) -> np.ndarray:
    """Values with the gaps (NaN) inside filled by a curve through the others; by a line if they are too few for it.

    cubic, quadratic, polynomial (of ``order``), pchip, akima.
    """
    known = np.flatnonzero(~np.isnan(values))
    out = values.copy()
    if len(known) < 2:
        return out
    gap = np.flatnonzero(np.isnan(values))
    gap = gap[(gap > known[0]) & (gap < known[-1])]
    x, y, at = pos[known].astype(float), values[known], pos[gap].astype(float)
    order = {"cubic": 3, "quadratic": 2}.get(method, order)
    if len(known) <= (order if method in ("cubic", "quadratic", "polynomial") else 1):
        out[gap] = np.interp(at, x, y)
    elif method == "cubic":
        out[gap] = spline_basis(x, at) @ y
    elif method in ("quadratic", "polynomial"):
        out[gap] = polynomial_pieces(x, y, at, order)
    else:
        out[gap] = hermite(x, y, monotone_slopes(x, y) if method == "pchip" else akima_slopes(x, y), at)
    return out


def fill_cubic(pos: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values with the gaps (NaN) inside filled by a cubic spline through the others; by a line if they are under four."""
    return fill_smooth(pos, values)


def resample(x: np.ndarray, steps: int) -> np.ndarray:
    """Rows of (time, channel) stretched or shrunk to ``steps`` rows by lines between neighbours."""
    at = np.linspace(0, len(x) - 1, steps)
    return np.stack([np.interp(at, np.arange(len(x)), x[:, c]) for c in range(x.shape[1])], 1)


def descriptors(x: np.ndarray, width: int) -> np.ndarray:
    """Each step with its neighbourhood of ``width`` steps, ends repeated; of any number of series in front."""
    before = -(-width // 2)
    padded = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(before, width - before), (0, 0)], mode="edge")
    return np.stack([padded[..., i : i + width, :].reshape(*x.shape[:-2], -1) for i in range(x.shape[-2])], -2)


#: By slope constraint, how far back in the prototype and in the sample each move comes from; of equal ways the first.
MOVES = {"symmetric": ((1, 1), (1, 0), (0, 1)), "asymmetric": ((1, 0), (1, 1), (1, 2))}


#: Numbers in memory at once while many pairs are aligned.
AT_ONCE = 4_000_000


def cumulate(cost: np.ndarray, slope: str) -> tuple[np.ndarray, np.ndarray]:
    """(cheapest way to each cell, the move that it ends with) of costs (prototype, sample, pair); unreachable cells are infinite.

    Cells are taken along anti-diagonals, or row by row where a move never stays in its row: those of
    one step depend on earlier steps only, so a step is a few operations on arrays, for all pairs.
    """
    p, s, n = cost.shape
    moves, pad = MOVES[slope], 2
    total = np.full((p + pad, s + pad, n), np.inf)
    total[pad - 1, pad - 1] = 0.0  # before the first cell
    chosen = np.zeros((p, s, n), np.int8)
    if slope == "asymmetric":
        steps = ((np.full(s, i), np.arange(s)) for i in range(p))
    else:
        steps = ((i, k - i) for k in range(p + s - 1) for i in [np.arange(max(0, k - s + 1), min(p, k + 1))])
    for i, j in steps:
        ways = np.stack([total[i + pad - up, j + pad - back] for up, back in moves])
        best = ways.argmin(0)
        chosen[i, j] = best
        total[i + pad, j + pad] = cost[i, j] + np.take_along_axis(ways, best[None], 0)[0]
    return total[pad:, pad:], chosen


def trace(chosen: np.ndarray, slope: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair, the path that the recorded moves make to the last cell, as steps of the prototype and of the sample."""
    p, s, n = chosen.shape
    moves, every = np.array(MOVES[slope]), np.arange(n)
    i, j, walked = np.full(n, p - 1), np.full(n, s - 1), []
    while ((i >= 0) & (j >= 0)).any():
        walked.append((i, j))
        inside = (i >= 0) & (j >= 0)
        back = moves[chosen[np.maximum(i, 0), np.maximum(j, 0), every]]
        i, j = np.where(inside, i - back[:, 0], i), np.where(inside, j - back[:, 1], j)
    ps, ss = (np.stack(x[::-1], 1) for x in zip(*walked, strict=True))
    inside = (ps >= 0) & (ss >= 0)
    return [(ps[k, b:], ss[k, b:]) for k, b in enumerate(inside.argmax(1))]  # shorter paths ended outside


def warps(pairs: list[tuple[np.ndarray, np.ndarray, int | None]], slope: str = "asymmetric", shape: bool = False, ratio: float = 0.05, paths: bool = True) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """``warp`` of many (prototype, sample, window), those of the same lengths together; without ``paths`` they are empty."""
    if slope not in MOVES:
        raise ValueError(f"unknown slope constraint {slope}")
    out, alike = [None] * len(pairs), {}
    for k, (a, b, window) in enumerate(pairs):
        alike.setdefault((a.shape, b.shape, window), []).append(k)
    nothing = np.empty(0, int)
    for ((p, c), (s, _), window), places in alike.items():
        width = int(np.clip(np.round(p * ratio), 5, 100)) if shape else 1
        window = max(p, s) if window is None else window
        apart = np.arange(s)[None, :] - np.arange(p)[:, None]
        outside = (apart < -window) | (apart >= (window if shape else window + 1))
        for start in range(0, len(places), step := max(1, AT_ONCE // max(1, p * s * c * width))):
            part = places[start : start + step]
            a, b = (np.stack([pairs[k][side] for k in part]) for side in (0, 1))
            if shape:
                a, b = descriptors(a, width), descriptors(b, width)
            cost = np.sqrt(np.maximum(((a[:, :, None, :] - b[:, None, :, :]) ** 2).sum(3), 0)).transpose(1, 2, 0).copy()
            cost[outside] = np.inf
            total, chosen = cumulate(cost, slope)
            ends = total[-1, -1]
            reached = np.flatnonzero(np.isfinite(ends))
            for k, end in zip(part, ends, strict=True):
                out[k] = (float(end), nothing, nothing)
            if paths and len(reached):
                for k, path in zip(reached, trace(chosen[:, :, reached], slope), strict=True):
                    out[part[k]] = (float(ends[k]), *path)
    return out


def warp(prototype: np.ndarray, sample: np.ndarray, slope: str = "asymmetric", window: int | None = None, shape: bool = False, ratio: float = 0.05):
    """(distance, path of the prototype, path of the sample) of dynamic time warping on rows of (time, channel).

    The local cost is the Euclidean distance, of the steps or, with ``shape``, of their
    neighbourhoods. ``window`` limits how far the steps of a pair may lie apart; a prototype that
    cannot reach the end within it has an infinite distance and empty paths.
    """
    return warps([(prototype, sample, window)], slope, shape, ratio)[0]
