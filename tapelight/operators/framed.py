"""Statistics of the last n rows of a key, in the order in which DuckDB adds them up.

Rows of a key are cut into blocks of BLOCK. A frame is the rows before its first whole block, one by one, then its whole
blocks, each summed once, then the rows after them. Sums of doubles depend on their order in the last bits, and a slope
of prices in cents may lie at a half of the digit it is rounded to; in this order and with the same formulas both give
the same bits. DuckDB also joins BLOCK blocks for frames of more than BLOCK**2 rows, and counts blocks over all keys that
it has in one bin; there, last bits may differ.

A statistic is a tuple of arrays, one item for each frame; the first is the count.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .carried import Run, Step

BLOCK = 16
State = tuple[np.ndarray, ...]


def _two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = a * 134217729.0
    high = t - (t - a)
    return high, a - high


def fma(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a * b + c rounded once (Boldo and Melquiond: the small parts are added with rounding to odd)."""
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    rest = al * bl - (((p - ah * bh) - al * bh) - ah * bl)
    high, low = _two_sum(c, rest)
    whole, less = _two_sum(p, high)
    small, lost = _two_sum(low, less)
    bits = small.view(np.int64)
    bits = bits + np.where((lost != 0) & (bits & 1 == 0), np.where((lost > 0) == (small > 0), 1, -1), 0)
    out = whole + bits.view(np.float64)
    return np.where(np.isfinite(out), out, p + c)


def add_total(s: State, x: np.ndarray) -> State:
    return s[0] + 1, s[1] + x


def join_totals(s: State, o: State) -> State:
    return s[0] + o[0], s[1] + o[1]


def add_variance(s: State, x: np.ndarray) -> State:
    """count, mean, sum of squared differences from it."""
    n, mean, squares = s
    n = n + 1
    new = mean + (x - mean) / n
    return n, new, squares + (x - new) * (x - mean)


def join_variances(s: State, o: State) -> State:
    n, apart = s[0] + o[0], o[1] - s[1]
    return n, fma(apart, o[0] / n, s[1]), o[2] + s[2] + apart * apart * o[0] * s[0] / n


def add_covariance(s: State, y: np.ndarray, x: np.ndarray) -> State:
    """count, means of x and y, sum of products of differences from them."""
    n, mx, my, products = s
    n = n + 1
    dx = x - mx
    my = my + (y - my) / n
    return n, mx + dx / n, my, fma(dx, y - my, products)


def join_covariances(s: State, o: State) -> State:
    n = s[0] + o[0]
    return n, (o[0] * o[1] + s[0] * s[1]) / n, (o[0] * o[2] + s[0] * s[2]) / n, o[3] + s[3] + (s[1] - o[1]) * (s[2] - o[2]) * o[0] * s[0] / n


TOTAL, VARIANCE, COVARIANCE = (2, add_total, join_totals), (3, add_variance, join_variances), (4, add_covariance, join_covariances)


def over_frames(kind: tuple[int, Callable, Callable], known: np.ndarray, values: tuple[np.ndarray, ...], first: np.ndarray, n: int) -> State:
    """The statistic of rows first to first + n - 1 for every `first`, of those that are `known`; row 0 begins a block."""
    width, add, join = kind

    def where(mask: np.ndarray, new: State, old: State) -> State:
        return tuple(np.where(mask, a, b) for a, b in zip(new, old, strict=True))

    def none(m: int) -> State:
        return tuple(np.zeros(m) for _ in range(width))

    whole = len(known) // BLOCK
    blocks = none(whole)
    for k in range(BLOCK):
        at = slice(k, whole * BLOCK, BLOCK)
        blocks = where(known[at], add(blocks, *(v[at] for v in values)), blocks)
    end = first + n
    begins, ends = -(-first // BLOCK), end // BLOCK
    within = first // BLOCK == ends
    left, right = np.where(within, end, begins * BLOCK), np.where(within, end, ends * BLOCK)
    state = none(len(first))

    def rows(state: State, since: np.ndarray, until: np.ndarray) -> State:
        for k in range(int((until - since).max(initial=0))):
            at = np.minimum(since + k, until - 1).clip(0)
            state = where((since + k < until) & known[at], add(state, *(v[at] for v in values)), state)
        return state

    state = rows(state, first, left)
    for k in range(int((ends - begins).max(initial=0))):
        one = tuple(b[np.minimum(begins + k, whole - 1)] for b in blocks)
        used = (begins + k < ends) & (one[0] > 0)
        state = where(used, where(state[0] > 0, join(state, one), one), state)
    return rows(state, right, end)


def trade_statistics(n: int) -> Callable[[], Step]:
    """The step of a key for `microstructure`: statistics of the last n ticks, NaN (0 of counts) before there are n.

    Of a run: price, flow, quantity and which of them are known. moved: how many ticks have a price difference before them;
    covariance of differences and those before them, their variance; covariance of differences and flow, the flow's
    variance; sum of illiquidities. NaN where no row counts.
    """

    def begin() -> Step:
        kept: dict[str, np.ndarray] = {}
        position = kept_from = 0
        last = {"price": np.zeros(1), "has_price": np.zeros(1, bool), "dp": np.zeros(1), "has_dp": np.zeros(1, bool)}

        def step(run: Run) -> dict:
            nonlocal kept, position, kept_from
            with np.errstate(all="ignore"):
                price, has_price = run["price"].astype(float), run["has_price"].astype(bool)
                prior, had_price = np.concatenate([last["price"], price[:-1]]), np.concatenate([last["has_price"], has_price[:-1]])
                dp, has_dp = price - prior, has_price & had_price
                now = {
                    "dp": dp, "has_dp": has_dp, "before": np.concatenate([last["dp"], dp[:-1]]), "has_before": np.concatenate([last["has_dp"], has_dp[:-1]]),
                    "flow": run["flow"].astype(float), "has_flow": run["has_flow"].astype(bool),
                    "illiquid": np.abs(np.log(price / prior)) / run["quantity"].astype(float), "has_illiquid": has_dp & run["has_quantity"].astype(bool),
                }
                last.update({"price": price[-1:], "has_price": has_price[-1:], "dp": dp[-1:], "has_dp": has_dp[-1:]})
                a = {k: np.concatenate([kept[k], v]) if kept else v for k, v in now.items()}
                first = np.arange(max(position - n + 1, 0), position + len(price) - n + 1) - kept_from
                both, flows = a["has_dp"] & a["has_before"], a["has_dp"] & a["has_flow"]
                so_far = np.concatenate([[0], np.cumsum(a["has_before"])])
                covariance = over_frames(COVARIANCE, both, (a["dp"], a["before"]), first, n)
                variance = over_frames(VARIANCE, a["has_dp"], (a["dp"],), first, n)
                with_flow = over_frames(COVARIANCE, flows, (a["dp"], a["flow"]), first, n)
                of_flow = over_frames(VARIANCE, flows, (a["flow"],), first, n)
                illiquid = over_frames(TOTAL, a["has_illiquid"], (a["illiquid"],), first, n)
                found = {
                    "moved": so_far[first + n] - so_far[first], "flows": of_flow[0], "illiquids": illiquid[0], "covariance": covariance[3] / covariance[0], "variance": variance[2] / variance[0],
                    "flow_covariance": with_flow[3] / with_flow[0], "flow_variance": of_flow[2] / of_flow[0], "amihud": illiquid[1] / illiquid[0],
                }
            position += len(price)
            since = max(position - n + 1, 0) // BLOCK * BLOCK
            kept, kept_from = {k: v[since - kept_from :] for k, v in a.items()}, since
            early = len(price) - len(first)
            return {k: np.concatenate([np.full(early, 0.0 if k in ("moved", "flows", "illiquids") else np.nan), v]) for k, v in found.items()}

        return step

    return begin
