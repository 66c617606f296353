"""Plain versions of the operators, row by row, to test them against."""

from __future__ import annotations

import math
from collections import defaultdict
from statistics import mean, median, stdev


def key(symbol):
    return None if symbol is None else symbol.strip(" ").upper()


def in_force(bars):
    """{(symbol, feed): {date: bar}} of dict rows."""
    out = defaultdict(dict)
    for b in sorted(bars, key=lambda b: b["ingested_at"]):
        if b["date"] is not None:
            out[key(b["symbol"]), b["feed"]][b["date"]] = b
    return out


def figures(series, day, n):
    """(volume total, mean volume, mean close, deviation of returns) over the n days that end on ``day``."""
    inside = [b for d, b in series.items() if 0 <= (day - d).days < n]
    total = sum(b["volume"] or 0 for b in inside)
    closes = [b["close"] for b in inside if b["close"] is not None]
    some = sorted((d, b["close"]) for d, b in series.items() if b["close"] is not None and b["close"] > 0)
    moves = [b / a - 1 for (_, a), (d, b) in zip(some, some[1:], strict=False) if 0 <= (day - d).days < n]
    return total, total / n, mean(closes) if closes else None, stdev(moves) if len(moves) > 1 else None


def cases(series):
    """{(date, field)} of implausible readings of one series."""
    days = sorted(series)
    out = set()
    for f in ("close", "volume", "change_percent"):
        x = [(d, series[d][f], series[d]["volume"]) for d in days if series[d][f] is not None]
        out |= {(d, f) for d, v, _ in x if (f == "close" and v <= 0) or (f == "volume" and v < 0) or (f == "change_percent" and v < -100)}
        if f == "change_percent":
            sizes = [abs(v) for _, v, _ in x if v]
            out |= {(d, f) for d, v, _ in x if sizes and abs(v) > 10 * median(sizes)}
        else:
            p = [(d, math.log(v)) for d, v, _ in x if v > 0]
            sizes = [abs(b - a) for (_, a), (_, b) in zip(p, p[1:], strict=False) if a != b]
            for (_, a), (d, b), (_, c) in zip(p, p[1:], p[2:], strict=False):
                t = 10 * median(sizes) if sizes else math.inf
                if (b - a > t and b - c > t) or (a - b > t and c - b > t):
                    out.add((d, f))
        run = []
        for d, v, vol in [*x, (None, None, None)]:
            if run and d is not None and v == run[-1][1] and vol != 0:
                run.append((d, v))
                continue
            if len(run) >= 5:
                out |= {(r, f) for r, _ in run[1:]}
            run = [(d, v)] if d is not None and v and vol != 0 else []
    return out
