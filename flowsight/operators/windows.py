"""Row-ordered window features and sequences.

The reference orders one global flow sequence; here the sequence is per source
(`by`), and each source's sequence is cut into row blocks with a carried
prefix (see `row_blocks`), so neither a global order nor a hot source lands in
a single task.  Frames are ROWS frames over the block-global position.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsight.operators.sliding import row_blocks


def _blocked(df, by, us, order, carry, block_rows):
    x = row_blocks(df, by, us, order, carry, block_rows=block_rows)
    w = Window.partitionBy(*[F.col(k) for k in by], F.col("_blk")).orderBy("_grank")
    return x, w


def _finish(x: DataFrame, cols) -> DataFrame:
    return x.filter(~F.col("_carry")).select(*cols)


def time_delta(df: DataFrame, ts: str = "ts", by=("src_ip",), us: str = "us", order=("us", "id"),
               out: str = "time_delta", block_rows: int = 1_000_000) -> DataFrame:
    """Seconds since the previous event of the same source, first = 0,
    clipped to [0, 3600]."""
    x, w = _blocked(df, list(by), us, list(order), 1, block_rows)
    prev = F.lag(F.col(us)).over(w)
    d = F.coalesce((F.col(us) - prev) / 1e6, F.lit(0.0))
    x = x.withColumn(out, F.least(F.greatest(d, F.lit(0.0)), F.lit(3600.0)))
    return _finish(x, df.columns + [out])


def rolling_stats(df: DataFrame, col: str, n: int = 10, by=("src_ip",), us: str = "us",
                  order=("us", "id"), prefix: str | None = None, block_rows: int = 1_000_000) -> DataFrame:
    """N-row rolling mean / sample std / max (min 1 row; std of 1 row = 0),
    plus E3 diff and E4 clipped percent change of the same column."""
    p = prefix or col
    x, w = _blocked(df, list(by), us, list(order), n - 1, block_rows)
    frame = w.rowsBetween(-(n - 1), 0)
    c = F.col(col)
    prev = F.lag(c).over(w)
    pct = (F.when(prev.isNull(), F.lit(0.0))
           .when(prev == 0, F.when(c > 0, F.lit(10.0)).when(c < 0, F.lit(-10.0)).otherwise(F.lit(0.0)))
           .otherwise(F.least(F.greatest((c - prev) / prev, F.lit(-10.0)), F.lit(10.0))))
    outs = {f"{p}_rolling_mean_{n}": F.avg(c).over(frame),
            f"{p}_rolling_std_{n}": F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0)),
            f"{p}_rolling_max_{n}": F.max(c).over(frame),
            f"{p}_diff": F.coalesce(c - prev, F.lit(0.0)),
            f"{p}_pct_change": pct}
    x = x.select("*", *[e.alias(k) for k, e in outs.items()])
    return _finish(x, df.columns + list(outs))


def make_sequences(df: DataFrame, cols: list[str], n: int = 20, label: str = "label",
                   by=("src_ip",), us: str = "us", order=("us", "id"), binary: bool = False,
                   block_rows: int = 1_000_000) -> DataFrame:
    """E5: for each row with n predecessors, the n previous feature vectors and
    the current row's label as target (`binary`: target = label != 'Normal')."""
    x, w = _blocked(df, list(by), us, list(order), n, block_rows)
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    x = x.withColumn("sequence", F.collect_list(vec).over(w.rowsBetween(-n, -1)))
    tgt = (F.col(label) != "Normal").cast("int") if binary else F.col(label)
    x = x.filter(F.size("sequence") == n).withColumn("target", tgt)
    return _finish(x, df.columns + ["sequence", "target"])


def padded_sequence(df: DataFrame, cols: list[str], n: int = 20, by=("src_ip",), us: str = "us",
                    order=("us", "id"), block_rows: int = 1_000_000) -> DataFrame:
    """The last n feature vectors up to and including the row, left-padded
    with zero vectors."""
    x, w = _blocked(df, list(by), us, list(order), n - 1, block_rows)
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    hist = F.collect_list(vec).over(w.rowsBetween(-(n - 1), 0))
    zero = F.array(*[F.lit(0.0) for _ in cols])
    x = x.withColumn("_h", hist).withColumn(
        "padded", F.concat(F.array_repeat(zero, F.lit(n) - F.size("_h")), F.col("_h")))
    return _finish(x, df.columns + ["padded"])


def time_parts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """H2: hour, day of week (Monday = 0), weekend and night flags (0 when NULL)."""
    t = F.col(ts)
    hour, dow = F.hour(t), F.weekday(t)
    return df.select("*", hour.alias("hour"), dow.alias("day_of_week"),
                     F.coalesce((dow >= 5).cast("int"), F.lit(0)).alias("is_weekend"),
                     F.coalesce(((hour < 6) | (hour > 22)).cast("int"), F.lit(0)).alias("is_night"))
