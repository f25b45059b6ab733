"""Measures of single ticks, single bars, runs of bars and rolling windows: columns by name, built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .frames import ratio

C = F.col


def tick_measures(reference: float, step: float, large: float, now_ms: int) -> dict[str, Column]:
    """Measures of a tick against a reference price, a price step, a large quantity and a time."""
    return {
        "is_above": C("price") > reference, "is_at": C("price") == reference, "change_from": C("price") - reference, "change_pct": ratio(C("price") - reference, F.lit(reference)) * 100, "is_round": C("price") % step == 0, "signed_quantity": C("side") * C("quantity"),
        "is_large": C("quantity") >= large, "is_zero": C("quantity") == 0, "dollar_value": C("price") * C("quantity"), "age_ms": F.greatest(F.lit(now_ms) - C("ts_ms"), F.lit(0)), "side_name": F.when(C("side") > 0, "buy").when(C("side") < 0, "sell").otherwise("unknown"),
    }


def bar_measures() -> dict[str, Column]:
    """Measures of one bar (open, high, low, close, volume, trade_count, turnover)."""
    o, h, low, c, v = C("open"), C("high"), C("low"), C("close"), C("volume")
    body, span = F.abs(c - o), h - low
    upper, lower = h - F.greatest(o, c), F.least(o, c) - low
    return {
        "body_size": body, "bar_range": span, "body_ratio": ratio(body, span), "upper_shadow": upper, "lower_shadow": lower, "hlc3": (h + low + c) / 3, "ohlc4": (o + h + low + c) / 4, "weighted_close": (h + low + 2 * c) / 4, "close_location": ratio((c - low) - (h - c), span),
        "is_bullish": c > o, "is_bearish": c < o, "is_marubozu": (upper <= 0.05 * span) & (lower <= 0.05 * span), "is_spinning_top": (body <= 0.3 * span) & (upper > 0) & (lower > 0), "is_shooting_star": (upper >= 2 * body) & (lower <= body) & (span > 0), "range_pct": ratio(span, o) * 100, "notional": v * c,
        "vwap_deviation": ratio(C("turnover"), v) - c, "volume_per_trade": ratio(v, C("trade_count")), "close_above_middle": c > (h + low) / 2, "lower_shadow_pct": ratio(lower, span),
    }


def bar_pair_measures(by: WindowSpec) -> dict[str, Column]:
    """Measures of a bar against the one before."""
    o, h, low, c = (C(x) for x in ("open", "high", "low", "close"))
    po, ph, pl, pc = (F.lag(x).over(by) for x in ("open", "high", "low", "close"))
    return {
        "change_pct": ratio(c - pc, pc) * 100, "close_gap": o - pc, "close_momentum": c - pc, "is_inside": (h < ph) & (low > pl), "is_outside": (h > ph) & (low < pl), "is_harami": (F.greatest(o, c) <= F.greatest(po, pc)) & (F.least(o, c) >= F.least(po, pc)), "is_reversal": ((c > o) & (pc < po)) | ((c < o) & (pc > po)), "overlaps": F.greatest(low, pl) <= F.least(h, ph),
    }


def bar_run_measures(changes: str = "change", prior_high: str = "prior_high", prior_low: str = "prior_low") -> dict[str, Column]:
    """Aggregates over a run of bars, with the change to and the extremes of the bar before as columns."""
    up = C("close") > C("open")
    body, span = F.abs(C("close") - C("open")), C("high") - C("low")
    return {
        "bullish_ratio": F.avg(up.cast("double")), "peak_close": F.max("close"), "trough_close": F.min("close"), "body_fraction": F.avg(ratio(body, span)), "up_volume_share": ratio(F.sum(F.when(up, C("volume")).otherwise(0.0)), F.sum("volume")), "range_deviation": F.stddev_samp(span), "close_deviation": F.stddev_samp("close"),
        "mean_close": F.avg("close"), "mean_volume": F.avg("volume"), "total_body": F.sum(body), "higher_highs": F.count_if(C("high") > C(prior_high)), "lower_lows": F.count_if(C("low") < C(prior_low)), "up_moves": F.count_if(C(changes) > 0), "mean_up_move": F.avg(F.when(C(changes) > 0, C(changes))),
    }


def window_measures(x: str, frame: WindowSpec) -> dict[str, Column]:
    """What a rolling normaliser knows of its window."""
    low, high, mean, deviation = F.min(x).over(frame), F.max(x).over(frame), F.avg(x).over(frame), F.stddev_pop(x).over(frame)
    values = F.collect_list(x).over(frame)
    n = F.count(x).over(frame)
    return {
        "low": low, "high": high, "span": high - low, "mean": mean, "deviation": deviation, "iqr": F.percentile(x, 0.75).over(frame) - F.percentile(x, 0.25).over(frame), "percentile_rank": F.size(F.filter(values, lambda v: v <= C(x))) / n,
        "share_above_middle": F.size(F.filter(values, lambda v: v > (low + high) / 2)) / n, "is_outlier": F.abs(C(x) - mean) > 2 * deviation, "n_outliers": F.size(F.filter(values, lambda v: F.abs(v - mean) > 2 * deviation)),
    }


def boost_measures(beta: Column) -> dict[str, Column]:
    """Scalars of a Lorentz boost of 0 <= beta < 1."""
    gamma = 1 / F.sqrt(1 - beta * beta)
    return {"gamma": gamma, "rapidity": F.atanh(beta), "doppler": F.sqrt((1 + beta) / (1 - beta)), "kinetic": gamma - 1, "momentum": gamma * beta, "contraction": 1 / gamma, "approximate": 1 + beta * beta / 2, "warp": F.cbrt(gamma), "beta_back": F.sqrt(1 - 1 / (gamma * gamma)), "added": (beta + 0.5) / (1 + 0.5 * beta)}


def boost_algebra(beta: Column, other: Column, mass: Column, dt: Column, dx: Column) -> dict[str, Column]:
    """Boosts composed, energies and momenta of a mass, and intervals between events dt and dx apart; c = 1."""
    gamma = 1 / F.sqrt(1 - beta * beta)
    energy, momentum = gamma * mass, gamma * beta * mass
    interval = dt * dt - dx * dx
    cosine = dx / F.sqrt(dx * dx + dt * dt)
    seen = (cosine - beta) / (1 - beta * cosine)
    moved = (cosine + beta) / (1 + beta * cosine)
    return {
        "composed": (beta + other) / (1 + beta * other), "chained": F.tanh(F.atanh(beta) + F.atanh(other) + F.atanh(beta)), "of_rapidity": F.tanh(beta + other), "dilated": gamma * dt, "contracted": dx / gamma, "stretched": gamma * dx, "proper_time": dt / gamma,
        "energy": energy, "kinetic": energy - mass, "momentum": momentum, "invariant": energy * energy - momentum * momentum, "mass": F.when(dt * dt >= dx * dx, F.sqrt(F.abs(interval))), "acceleration": dt / (gamma * gamma * gamma * mass),
        "interval": interval, "distance": F.sqrt(F.abs(interval)), "cone": F.when(interval > 1e-12, "timelike").when(interval < -1e-12, "spacelike").otherwise("lightlike"),
        "aberration": seen, "aberration_angle": F.acos(F.greatest(F.least(moved, F.lit(1.0)), F.lit(-1.0))),
    }


def tick_times(start_ms: int, end_ms: int, exchange_ms: Column) -> dict[str, Column]:
    """Whether a tick lies in a session [start, end), has the exchange's time, and how late it came after it."""
    late = C("ts_ms") - exchange_ms
    return {"in_session": (C("ts_ms") >= start_ms) & (C("ts_ms") < end_ms), "has_exchange_ts": exchange_ms.isNotNull(), "latency_ms": F.greatest(late, F.lit(0))}


def bar_ratios(by: WindowSpec, mean_volume: float, wide: float) -> dict[str, Column]:
    """More measures of a bar, some against the one before; ratios are null over 0."""
    o, h, low, c, v = C("open"), C("high"), C("low"), C("close"), C("volume")
    po, ph, pl, pc = (F.lag(x).over(by) for x in ("open", "high", "low", "close"))
    return {
        "has_upper_wick": h > F.greatest(o, c), "has_lower_wick": low < F.least(o, c), "volume_notional": v * c, "relative_volume": ratio(v, F.lit(mean_volume)), "high_close_ratio": ratio(h, c), "open_close_ratio": ratio(o, c), "close_to_low_ratio": ratio(c - low, h - low), "height_pct": ratio(h - low, o) * 100,
        "is_wide": h - low > wide, "is_engulfing": (F.greatest(o, c) > F.greatest(po, pc)) & (F.least(o, c) < F.least(po, pc)), "is_bullish_engulfing": (pc < po) & (c > o) & (o < pc) & (c > po), "is_intraday_reversal": ((pc > po) & (o > pc) & (c < o)) | ((pc < po) & (o < pc) & (c > o)), "range_overlap": F.greatest(F.least(h, ph) - F.greatest(low, pl), F.lit(0.0)),
    }
