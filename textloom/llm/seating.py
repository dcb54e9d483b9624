"""Seatings of a Chinese restaurant: Gibbs steps for the number of tables of a dish.

A dish with c customers in a Pitman-Yor restaurant has t tables with a weight of

    (lead + slope)(lead + 2 slope) ... (lead + (t - 1) slope) * S(c, t)

where lead + i * slope is the weight of the next table when everybody else's tables and
i of the dish's own stand, and S(c, t) sums the products (1 - d)(2 - d) ... of all ways
to seat c customers at t tables (generalised Stirling numbers).  A dish with few
customers is drawn from the list of its weights.  For many customers the step is
Metropolis-Hastings: a few symmetric moves of t, about as wide as the distribution, each
accepted by the exact ratio of the weights.  Either step leaves the distribution above as
it is, whatever c is; none costs more than a few hundred numbers.

S comes from its generating function, S(c, t) = c! / (t! d^t) [x^c] (1 - (1 - x)^d)^t, by
numerical integration over a contour through the saddle point, to about ten digits.

Random numbers are hashes of a key and a counter: the same everywhere, any number of times.
"""

from __future__ import annotations

import numpy as np

from textloom.llm.common import mix

#: Dishes up to this size are drawn from the list of their weights.
LISTED = 40
#: Moves of a larger dish in one step, and nodes of a contour integral.
MOVES, NODES = 3, 56
GOLD = 0x9E3779B97F4A7C15


def uniform(key: np.ndarray, draw: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the key and the draw only."""
    return ((mix(key + np.uint64(draw * GOLD & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def log_gamma_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(Gamma(a) / Gamma(b)) of positive numbers, precise also where both are large and close."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    a, b, out = a.copy(), b.copy(), np.zeros(a.shape)
    low = np.minimum(a, b) < 8
    if low.any():
        x, y = a[low], b[low]
        over, under = np.ones(len(x)), np.ones(len(x))
        for k in range(8):
            over *= y + k
            under *= x + k
        out[low] = np.log(over) - np.log(under)
        a[low] += 8
        b[low] += 8
    out += (a - 0.5) * np.log1p((a - b) / b) + (a - b) * (np.log(b) - 1)
    return out + (1 / a - 1 / b) / 12 - (a**-3.0 - b**-3.0) / 360 + (a**-5.0 - b**-5.0) / 1260


_ways: dict[float, np.ndarray] = {}


def ways(discount: float, most: int = LISTED) -> np.ndarray:
    """log S(c, t) for c and t up to ``most``, by the recursion over the last customer."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, most + 1)
        joins = out[c, 1:] + np.log(np.maximum(c - t * discount, 1e-300))
        out[c + 1, 1:] = np.logaddexp(np.where(t <= c, joins, -np.inf), out[c, :-1])
    return out


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Where t log(1 - (1 - exp(-p))^d) + c p is least, at least 3 / c."""
    low, high = np.log(3 / c), np.full(len(c), np.log(40.0))
    for _ in range(16):
        p = np.exp((low + high) / 2)
        y = -np.expm1(-p)
        right = t * d * y ** (d - 1) * np.exp(-p) < c * -np.expm1(d * np.log(y))
        high, low = np.where(right, np.log(p), high), np.where(right, low, np.log(p))
    return np.exp(high)


def log_ways(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) - log c! of many (c, t), c > LISTED."""
    c, t = c.astype(float), t.astype(float)
    out = np.empty(len(c))
    full = t >= c  # everybody alone
    out[full] = -log_gamma_ratio(c[full] + 1, 1.0)
    at = np.flatnonzero(~full)
    for part in np.array_split(at, max(1, len(at) // 4096)):
        if len(part):
            out[part] = _contour(c[part], t[part], d) - log_gamma_ratio(t[part] + 1, 1.0) - t[part] * np.log(d)
    return out


def _contour(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log [x^c] (1 - (1 - x)^d)^t for t < c."""
    p = _saddle(c, t, d)
    y, x = -np.expm1(-p), np.exp(-p)
    inner = -np.expm1(d * np.log(y))
    q = d * y ** (d - 1) * x / inner
    wide = 1 / np.sqrt(np.maximum(t * q * ((1 - d) * x / y + 1 - q), 1e-300))  # of the peak along the imaginary axis
    top = t * np.log(inner) + c * p
    node = (np.arange(NODES) + 0.5) / NODES
    out = np.empty(len(c))
    # near the singularity a parabola around it, elsewhere the straight line
    bent = p < 0.3
    for k, curved in ((np.flatnonzero(bent), True), (np.flatnonzero(~bent), False)):
        if not len(k):
            continue
        p0 = p[k, None]
        if curved:
            reach = 6.1 / np.sqrt(c[k] * p[k])
            reach = np.where(p[k] * c[k] < 3.01, reach, np.minimum(45 * wide[k], np.pi) / (2 * p[k]))
            u = node * reach[:, None]
            z, weight, scale = p0 * (1 + 1j * u) ** 2, 1 + 1j * u, 2 * p[k] / np.pi * reach / NODES
        else:
            reach = np.minimum(np.pi, 45 * wide[k])
            z, weight, scale = p0 + 1j * node * reach[:, None], 1.0, reach / np.pi / NODES
        g = t[k, None] * np.log(1 - (-np.expm1(-z)) ** d) + c[k, None] * z - top[k, None]
        total = (np.exp(g) * weight).real.sum(1) * scale
        out[k] = top[k] + np.log(np.maximum(total, 1e-300))
    return out


def _middle(c: np.ndarray, lead: np.ndarray, slope: np.ndarray, d: float) -> np.ndarray:
    """About the most likely number of tables: where one more table is as likely as not, by the saddle point."""
    low, high = np.full(len(c), -300.0), np.full(len(c), np.log(40.0))
    for _ in range(40):
        p = np.exp((low + high) / 2)
        y = -np.expm1(-p)
        inner = -np.expm1(d * np.log(y))
        t = c * inner / (d * y ** (d - 1) * np.exp(-p))
        more = (lead + slope * t) * inner > d * t
        low, high = np.where(more, (low + high) / 2, low), np.where(more, high, (low + high) / 2)
    return np.clip(np.rint(t), 1, c).astype(np.int64)


def seat(c: np.ndarray, lead: np.ndarray, slope: np.ndarray, discount: float, key: np.ndarray, draw: int, before: np.ndarray | None = None) -> np.ndarray:
    """Tables of dishes with ``c`` customers each after one step from ``before`` (the first step needs none)."""
    out = np.ones(len(c), np.int64)
    if not len(c):  # a block may have no dish of its own
        return out
    lead, slope = np.maximum(lead, 1e-300), np.maximum(slope, 1e-300)
    if discount not in _ways:
        _ways[discount] = ways(discount)
    listed = _ways[discount]
    x = uniform(key, draw)
    order = np.argsort(c, kind="stable")
    sizes, start = np.unique(c[order], return_index=True)
    for size, at in zip(sizes.tolist(), np.split(order, start[1:]), strict=True):
        if size == 1 or size > LISTED:
            continue
        w = np.zeros((len(at), size))
        np.cumsum(np.log(lead[at, None] + slope[at, None] * np.arange(1, size)), axis=1, out=w[:, 1:])
        w += listed[size, 1 : size + 1]
        w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
        out[at] = 1 + (w < (x[at] * w[:, -1])[:, None]).sum(1)
    many = np.flatnonzero(c > LISTED)
    if len(many):
        out[many] = _moved(c[many], lead[many], slope[many], discount, mix(key[many] + np.uint64(draw)), None if before is None else before[many])
    return out


def _moved(c: np.ndarray, lead: np.ndarray, slope: np.ndarray, d: float, key: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    slope = np.minimum(slope, d * (1 - 1e-9))
    rise, middle = lead / slope, _middle(c, lead, slope, d)
    now = middle if before is None else np.clip(before, 1, c)

    def weight(t: np.ndarray, k: np.ndarray) -> np.ndarray:
        return (t - 1) * np.log(slope[k]) + log_gamma_ratio(rise[k] + t, rise[k] + 1) + log_ways(c[k], t, d)

    held = weight(now, np.arange(len(c)))
    for move in range(MOVES):
        # as many steps up as down, of one table or more; the width does not depend on where the dish is
        width = np.sqrt(middle) * (0.5, 1.5, 1.0)[move % 3]
        far = 1 + np.floor(-np.log(uniform(key, 3 * move + 1)) * width).astype(np.int64)
        to = now + np.where(uniform(key, 3 * move + 2) < 0.5, far, -far)
        inside = np.flatnonzero((to >= 1) & (to <= c))
        w = weight(to[inside], inside)
        taken = np.log(uniform(key[inside], 3 * move + 3)) < w - held[inside]
        at = inside[taken]
        now = now.copy()
        now[at], held[at] = to[at], w[taken]
    return now
