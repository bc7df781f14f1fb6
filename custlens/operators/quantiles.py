"""Exact linear-interpolation quantiles without gathering a column in one task.

Spark's exact ``percentile`` merges every distinct value into a single task;
at scale that is an unbounded group.  Instead each wanted order statistic is
bracketed with the bounded-memory ``percentile_approx`` sketch, the bracket is
verified with exact counts, and only when a bracket holds at most
``collect_limit`` values are those few values fetched and indexed.  Every
round is one or two aggregations that run partially on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACCURACY = 10_000
COLLECT_LIMIT = 50_000


class _Target:
    __slots__ = ("col", "rank", "lo", "hi", "below", "cnt", "value", "misses")

    def __init__(self, col: str, rank: int, cnt: int):
        self.col, self.rank, self.cnt = col, rank, cnt
        self.lo = self.hi = None
        self.below = 0
        self.value = None
        self.misses = 0

    def in_range(self):
        c = F.col(self.col)
        cond = c.isNotNull()
        if self.lo is not None:
            cond = cond & (c >= F.lit(self.lo))
        if self.hi is not None:
            cond = cond & (c <= F.lit(self.hi))
        return cond


def _ranges(targets: list[_Target]) -> dict[tuple, list[_Target]]:
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault((t.col, t.lo, t.hi), []).append(t)
    return groups


def order_statistics(df: DataFrame, wanted: dict[str, set[int]],
                     counts: dict[str, int], accuracy: int = ACCURACY,
                     collect_limit: int = COLLECT_LIMIT, max_rounds: int = 12) -> dict:
    """Exact k-th smallest non-null value (0-based) for each column/rank.

    Targets that share a column and a current range share one sketch and one
    fetch.  A range is fetched once it holds at most ``collect_limit`` values;
    until then it is narrowed with a sketch whose accuracy is sized so the
    next bracket fits under the limit."""
    targets = [_Target(c, r, counts[c]) for c, ranks in wanted.items() for r in sorted(ranks)]
    targets = [t for t in targets if t.cnt > 0]
    src = df.select(*[F.col(c).cast("double").alias(c) for c in wanted])
    for _ in range(max_rounds):
        open_ = [t for t in targets if t.value is None]
        if not open_:
            break
        # 1) fetch every range that is small enough, one sorted list per range
        small = _ranges([t for t in open_ if t.cnt <= collect_limit])
        if small:
            keys = list(small)
            exprs = [F.array_sort(F.collect_list(F.when(small[k][0].in_range(), F.col(k[0])))).alias(f"v{i}")
                     for i, k in enumerate(keys)]
            row = src.agg(*exprs).first()
            for i, k in enumerate(keys):
                vals = row[f"v{i}"]
                for t in small[k]:
                    t.value = vals[t.rank - t.below]
        big = _ranges([t for t in open_ if t.value is None and t.cnt > collect_limit])
        if not big:
            continue
        # 2) sketch brackets around the wanted ranks inside each large range
        keys = list(big)
        exprs, plan = [], []
        for i, k in enumerate(keys):
            ts = big[k]
            cnt = ts[0].cnt
            acc = int(min(1_000_000, max(accuracy, 8 * cnt / collect_limit)))
            ps = []
            for t in ts:
                # the sketch is deterministic: after a miss the margin doubles
                m = 3.0 * (2 ** t.misses) / acc
                q = (t.rank - t.below + 0.5) / cnt
                ps += [max(0.0, q - m), min(1.0, q + m)]
            exprs.append(F.percentile_approx(F.when(ts[0].in_range(), F.col(k[0])), ps, acc).alias(f"b{i}"))
            plan.append(ts)
        row = src.agg(*exprs).first()
        proposals = []
        for i, ts in enumerate(plan):
            arr = row[f"b{i}"]
            for j, t in enumerate(ts):
                proposals.append((t, arr[2 * j], arr[2 * j + 1]))
        # 3) verify each bracket with exact counts
        cexprs = []
        for i, (t, lo, hi) in enumerate(proposals):
            c = F.col(t.col)
            cexprs += [F.count_if(t.in_range() & (c < F.lit(lo))).alias(f"l{i}"),
                       F.count_if(t.in_range() & (c >= F.lit(lo)) & (c <= F.lit(hi))).alias(f"m{i}"),
                       F.count_if(t.in_range() & (c == F.lit(lo))).alias(f"e{i}"),
                       F.count_if(t.in_range() & (c == F.lit(hi))).alias(f"f{i}")]
        crow = src.agg(*cexprs).first()
        for i, (t, lo, hi) in enumerate(proposals):
            nb, nm, ne, nf = crow[f"l{i}"], crow[f"m{i}"], crow[f"e{i}"], crow[f"f{i}"]
            start = t.below + nb
            if not (start <= t.rank < start + nm):
                t.misses += 1  # sketch missed; the next round uses a wider bracket
                continue
            if t.rank < start + ne:          # inside the run of values == lo
                t.value = lo
            elif t.rank >= start + nm - nf:  # inside the run of values == hi
                t.value = hi
            else:
                t.lo, t.hi, t.below, t.cnt = lo, hi, start, nm
    unresolved = [(t.col, t.rank) for t in targets if t.value is None]
    if unresolved:
        raise RuntimeError(f"order statistics not resolved in {max_rounds} rounds: {unresolved[:5]}")
    return {(t.col, t.rank): t.value for t in targets}


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    **kw) -> dict[tuple[str, float], float | None]:
    """Linear-interpolated quantiles (numpy/pandas default, DuckDB quantile_cont)."""
    crow = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first()
    counts = {c: int(crow[c]) for c in cols}
    wanted: dict[str, set[int]] = {c: set() for c in cols}
    plan = {}
    for c in cols:
        n = counts[c]
        for p in probs:
            if n == 0:
                plan[(c, p)] = None
                continue
            h = (n - 1) * p
            r0 = int(math.floor(h))
            r1 = min(r0 + 1, n - 1)
            wanted[c].update({r0, r1})
            plan[(c, p)] = (r0, r1, h - r0)
    stats = order_statistics(df, {c: r for c, r in wanted.items() if r}, counts, **kw)
    out = {}
    for (c, p), spec in plan.items():
        if spec is None:
            out[(c, p)] = None
            continue
        r0, r1, frac = spec
        v0, v1 = stats[(c, r0)], stats[(c, r1)]
        out[(c, p)] = v0 + (v1 - v0) * frac if frac else v0
    return out


def quantile_frame(spark: SparkSession, df: DataFrame, cols: list[str],
                   probs: list[float]) -> DataFrame:
    q = exact_quantiles(df, cols, probs)
    rows = [(c, float(p), q[(c, p)]) for c in cols for p in probs]
    return spark.createDataFrame(rows, "feature string, p double, value double")
