"""Exact order statistics of many columns by refinement.

A quantile needs one or two positions of a column's order, not the order.
Every wanted position keeps a bracket of values that is known, by exact
counts, to hold it.  A round is two aggregations over all columns at once:

1. pivots: per open bracket the approximate percentiles around the position,
   from at most about ``SAMPLE`` of the values inside (drawn at random; fewer
   values are taken all; the percentile's error bound is then below half a
   place, so its answer is the value and the search ends);
2. counts: how many values lie below and at each pivot.

The counts narrow the bracket to one pivot (found) or to the values strictly
between two.  Only pivots and counts move: rows are never shuffled, sorted or
melted, and a bracket shrinks about a hundredfold a round, so a column of 10^11 values
takes five.  The sample guides the search; the result is exact whatever it is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000                # a sketch's error is at most inside / (2 * SAMPLE) places
_DRAW = "_drawn"


@dataclass
class _Bracket:
    """Position ``at`` (from 0) of a column's ascending non-null values."""
    column: str
    at: int
    below: int                 # values under the bracket
    inside: int                # values in it
    low: float | None = None   # exclusive bounds; None: open
    high: float | None = None
    value: float | None = None

    def holds(self, c: Column) -> Column:
        inside = c.isNotNull()
        if self.low is not None:
            inside = inside & (c > F.lit(self.low))
        if self.high is not None:
            inside = inside & (c < F.lit(self.high))
        return inside


def _double(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def _pivots(df: DataFrame, open_: list[_Bracket], sample: int, seed: int) -> dict[str, list[float]]:
    """Values around the open positions of each column, or the value itself
    where the sketch took all.  Positions of one bracket share its sketch."""
    shared: dict[tuple, list[_Bracket]] = {}
    for b in open_:
        shared.setdefault((b.column, b.low, b.high), []).append(b)
    sketches, asked = [], []
    for (name, _, _), held in shared.items():
        c, first = _double(name), held[0]
        share = min(1.0, sample / first.inside)
        inside = first.holds(c) if share >= 1 else first.holds(c) & (F.col(_DRAW) < share)
        ps = set()
        for b in held:
            p = (b.at - b.below + 0.5) / b.inside
            # wide enough for the sampling error; an exact sketch needs the middle only
            slack = 0.0 if share >= 1 else 4 * math.sqrt(p * (1 - p) / sample) + 2 / sample
            ps |= {max(0.0, p - slack), p, min(1.0, p + slack)}
        asked.append(sorted(ps))
        sketches.append(F.percentile_approx(F.when(inside, c), F.array(*[F.lit(x) for x in asked[-1]]),
                                            F.lit(2 * sample + 100)))
    row = df.select("*", F.rand(seed).alias(_DRAW)).agg(*[k.alias(f"p{i}") for i, k in enumerate(sketches)]).first()
    out: dict[str, list[float]] = {}
    for i, ((name, _, _), held) in enumerate(shared.items()):
        if held[0].inside <= sample:
            for b in held:
                b.value = row[f"p{i}"][asked[i].index((b.at - b.below + 0.5) / b.inside)]
        else:
            out.setdefault(name, []).extend(row[f"p{i}"] or [])
    return {name: list(dict.fromkeys(xs)) for name, xs in out.items()}


def _narrow(df: DataFrame, open_: list[_Bracket], pivots: dict[str, list[float]]) -> None:
    """Count at the pivots and shrink every bracket to the part that holds its position."""
    at = [(name, x) for name, xs in pivots.items() for x in xs]
    if not at:
        return
    counts = []
    for i, (name, x) in enumerate(at):
        c = _double(name)
        counts += [F.count_if(c < F.lit(x)).alias(f"u{i}"), F.count_if(c <= F.lit(x)).alias(f"t{i}")]
    row = df.agg(*counts).first()
    by_column: dict[str, list[tuple[float, int, int]]] = {}
    for i, (name, x) in enumerate(at):
        by_column.setdefault(name, []).append((x, row[f"u{i}"], row[f"t{i}"]))
    for b in (b for b in open_ if b.value is None):
        above = b.below + b.inside                         # values up to the bracket's end
        for x, under, upto in by_column.get(b.column, ()):
            if under <= b.at < upto:
                b.value = x
                break
            if b.below < upto <= b.at:
                b.low, b.below = x, upto
            elif b.at < under < above:
                b.high, above = x, under
        b.inside = above - b.below


def order_statistics(df: DataFrame, positions: dict[str, list[int]], counts: dict[str, int],
                     sample: int = SAMPLE) -> dict[str, dict[int, float]]:
    """{column: {position: value}} of the non-null values as doubles;
    ``counts``: how many each column has."""
    brackets = [_Bracket(c, at, 0, counts[c]) for c, ats in positions.items() for at in dict.fromkeys(ats)]
    open_, seed = brackets, 1
    while open_:
        _narrow(df, open_, _pivots(df, open_, sample, seed))
        open_, seed = [b for b in open_ if b.value is None], seed + 1
    out: dict[str, dict[int, float]] = {c: {} for c in positions}
    for b in brackets:
        out[b.column][b.at] = b.value
    return out


def column_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float],
                     sample: int = SAMPLE, counts: dict[str, int] | None = None) -> dict[str, dict[str, float | None]]:
    """PERCENTILE_CONT of many columns: linear interpolation at position
    p * (n - 1) over the non-null values.  {column: {name: value}}, None for a
    column without values.  ``counts``: the columns' non-null values, where known."""
    if not columns:
        return {}
    if counts is None:
        n = df.agg(*[F.count(_double(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        counts = {c: n[f"n{i}"] for i, c in enumerate(columns)}
    at = {c: {name: p * (counts[c] - 1) for name, p in probs.items()} for c in columns if counts[c]}
    positions = {c: [k for pos in wanted.values() for k in (math.floor(pos), math.ceil(pos))] for c, wanted in at.items()}
    found = order_statistics(df, positions, counts, sample)
    out: dict[str, dict[str, float | None]] = {c: {name: None for name in probs} for c in columns}
    for c, wanted in at.items():
        for name, pos in wanted.items():
            low, high = found[c][math.floor(pos)], found[c][math.ceil(pos)]
            out[c][name] = low if pos == math.floor(pos) else low + (high - low) * (pos - math.floor(pos))
    return out
