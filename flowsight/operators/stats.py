"""Exact order statistics without gathering a column in one task.

`exact_quantiles` finds the needed order statistics of several columns at once.
Infinite values are counted up front (ranks that fall on them are answered
directly), so every band below is a strict open interval of finite values:

1. one approximate-quantile job for all columns proposes cut points inside their
   bands (bounded sketches);
2. one pass assigns every band value to a piece - below the first cut, equal to
   a cut, or between two cuts - with a JVM-side binary search (Bucketizer) and a
   small grouped count gives the piece sizes;
3. the piece holding the wanted rank becomes the new band, or, once it holds at
   most `max_collect` values, those values are fetched and ranked.

Interpolation follows the linear rule (pandas / Spark `percentile`).
"""
from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.functions.columns import col as qcol
from flowsight.operators.ordering import global_cumsum

_FINITE = lambda v: v.isNotNull() & ~F.isnan(v) & (v != float("inf")) & (v != float("-inf"))


def _in(v, lo, hi):
    return (v > F.lit(lo)) & (v < F.lit(hi))


def _pieces(df: DataFrame, cols: list[str], bounds: dict, splits: int) -> dict:
    """Per column: [(kind, a, b, count)] covering the open band (lo, hi) in order."""
    probs = [i / splits for i in range(1, splits)]
    names = [f"_b{i}" for i in range(len(cols))]
    # one job for all columns; values outside a column's band are NULL there
    banded = df.select(*[F.when(_in(qcol(c), *bounds[c]), qcol(c)).alias(n) for c, n in zip(cols, names)])
    found = banded.approxQuantile(names, probs, 1.0 / (4 * splits))
    cuts = {c: sorted(set(x for x in f if bounds[c][0] < x < bounds[c][1])) for c, f in zip(cols, found)}
    x = df.select(*[F.when(_in(qcol(c), *bounds[c]), qcol(c)).otherwise(F.lit(float("nan"))).alias(n)
                    for c, n in zip(cols, names)])
    sp = [[-math.inf] + cuts[c] + [math.inf] for c in cols]
    x = Bucketizer(splitsArray=sp, inputCols=names, outputCols=[n + "_k" for n in names],
                   handleInvalid="keep").transform(x)
    items = []
    for i, n in enumerate(names):
        j = F.col(n + "_k").cast("int")
        lower = F.element_at(F.array(*[F.lit(v) for v in sp[i]]), j + 1)   # split below the value
        k = F.when(F.isnan(n), F.lit(None)).when(j == 0, F.lit(0)) \
             .when(F.col(n) == lower, 2 * j - 1).otherwise(2 * j)
        items.append(F.struct(F.lit(i).alias("c"), k.alias("k")))
    rows = (x.select(F.inline(F.array(*items))).filter(F.col("k").isNotNull())
             .groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).collect())
    got = {(r["c"], r["k"]): r["n"] for r in rows}
    out = {}
    for i, c in enumerate(cols):
        lo, hi = bounds[c]
        cs = cuts[c]
        if not cs:
            out[c] = [("open", lo, hi, got.get((i, 0), 0))]
            continue
        parts = [("open", lo, cs[0], got.get((i, 0), 0))]
        for t, cut in enumerate(cs):
            nxt = cs[t + 1] if t + 1 < len(cs) else hi
            parts += [("point", cut, cut, got.get((i, 2 * t + 1), 0)),
                      ("open", cut, nxt, got.get((i, 2 * t + 2), 0))]
        out[c] = parts
    return out


def order_statistics(df: DataFrame, want: dict[str, list[int]], max_collect: int = 100_000,
                     splits: int = 256) -> dict[str, dict[int, float]]:
    """want: column -> 0-based ranks among the column's non-NULL, non-NaN values."""
    cols = sorted(want)
    aggs = []
    for c in cols:
        v = qcol(c)
        aggs += [F.count_if(v == float("-inf")).alias(f"{c}__m"), F.count_if(v == float("inf")).alias(f"{c}__p"),
                 F.count_if(_FINITE(v)).alias(f"{c}__f")]
    st = df.agg(*aggs).first().asDict() if cols else {}
    result = {c: {} for c in cols}
    todo = {}
    for c in cols:
        m, f = st[f"{c}__m"], st[f"{c}__f"]
        for k in want[c]:
            if k < m:
                result[c][k] = -math.inf
            elif k >= m + f:
                result[c][k] = math.inf
            else:
                todo[(c, k)] = (-math.inf, math.inf, m)   # open band of finite values, m values below
    sizes = {}
    rounds = 0
    while todo:
        rounds += 1
        if rounds > 12:   # cut points no longer shrink the bands: count distinct values
            _by_value_counts(df, todo, result)
            break
        # one band per column per round (ranks usually share it)
        bands = {}
        for (c, k), band in todo.items():
            bands.setdefault(c, band)
        small, big = {}, {}
        for c, band in bands.items():
            n = sizes.get((c, band))
            (small if n is not None and n <= max_collect else big)[c] = band
        parts = _pieces(df, sorted(big), {c: b[:2] for c, b in big.items()}, splits) if big else {}
        collect = {}
        for (c, k), band in list(todo.items()):
            if bands[c] != band:
                continue
            if c in small:
                collect.setdefault(c, {}).setdefault(band, []).append(k)
                del todo[(c, k)]
                continue
            pos = band[2]
            pcs = parts[c]
            if len(pcs) == 1:   # no cut point: split at the band minimum (repeated values)
                lo, hi = band[:2]
                r = df.agg(F.min(F.when(_in(qcol(c), lo, hi), qcol(c))).alias("mn"),
                           F.max(F.when(_in(qcol(c), lo, hi), qcol(c))).alias("mx")).first()
                if r["mn"] == r["mx"]:
                    result[c][k] = float(r["mn"])
                    del todo[(c, k)]
                    continue
                e = df.agg(F.count_if(qcol(c) == r["mn"])).first()[0]
                pcs = [("point", r["mn"], r["mn"], e), ("open", r["mn"], hi, pcs[0][3] - e)]
            for kind, a, b, cnt in pcs:
                if k < pos + cnt:
                    if kind == "point":
                        result[c][k] = float(a)
                        del todo[(c, k)]
                    else:
                        nb = (a, b, pos)
                        sizes[(c, nb)] = cnt
                        todo[(c, k)] = nb
                    break
                pos += cnt
        if collect:
            sel, conds = [], []
            for c, bs in collect.items():
                cond = None
                for (lo, hi, _) in bs:
                    one = _in(qcol(c), lo, hi)
                    cond = one if cond is None else (cond | one)
                sel.append(F.when(cond, qcol(c)).alias(c))
                conds.append(cond)
            pred = conds[0]
            for cnd in conds[1:]:
                pred = pred | cnd
            rows = df.filter(pred).select(*sel).collect()
            for c, bs in collect.items():
                for (lo, hi, below), ks in bs.items():
                    vals = sorted(r[c] for r in rows if r[c] is not None and lo < r[c] < hi)
                    for k in ks:
                        result[c][k] = float(vals[k - below])
    return result


def _by_value_counts(df: DataFrame, todo: dict, result: dict) -> None:
    """Answer the ranks left by counting values: a grouped count per distinct value of
    the band, running counts in value order over range partitions."""
    for (c, k), (lo, hi, below) in todo.items():
        counts = df.where(_in(qcol(c), lo, hi)).groupBy(qcol(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        run = global_cumsum(counts, "v", ["n"])
        result[c][k] = float(run.where(F.col("n_cum") > k - below).agg(F.min("v")).first()[0])
    todo.clear()


def exact_quantiles(df: DataFrame, cols: list[str], p: float = 0.5, max_collect: int = 100_000,
                    splits: int = 256) -> dict[str, float | None]:
    """Linear-interpolated p-quantile of the non-missing (not NULL, not NaN)
    values of each column, all columns sharing the same few jobs."""
    clean = df.select(*[F.when(qcol(c).isNotNull() & ~F.isnan(qcol(c)), qcol(c).cast("double")).alias(c)
                        for c in cols])
    counts = clean.agg(*[F.count(qcol(c)).alias(c) for c in cols]).first().asDict()
    want, pos = {}, {}
    for c in cols:
        n = counts[c]
        if n == 0:
            continue
        h = (n - 1) * p
        k1 = int(math.floor(h))
        want[c] = [k1] if (h == k1 or k1 + 1 >= n) else [k1, k1 + 1]
        pos[c] = h
    stats = order_statistics(clean, want, max_collect, splits) if want else {}
    out = {}
    for c in cols:
        if c not in want:
            out[c] = None
            continue
        ks = want[c]
        a = stats[c][ks[0]]
        out[c] = a if len(ks) == 1 else a + (pos[c] - ks[0]) * (stats[c][ks[1]] - a)
    return out


def exact_quantile(df: DataFrame, c: str, p: float = 0.5, max_collect: int = 100_000,
                   splits: int = 256) -> float | None:
    return exact_quantiles(df, [c], p, max_collect, splits)[c]
