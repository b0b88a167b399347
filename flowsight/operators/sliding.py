"""Exact event-time sliding-window counts without sliding frames.

Spark's sliding RANGE frames re-aggregate the whole frame for every row
(O(rows x frame)), and a frame partitioned only by key sends a hot key to one
task.  Here a count over the half-open frame (t - w, t] is a running sum of
+1/-1 delta events, and partitions are (key, time bucket):

* bucket = us div B with B >= w; rows of the previous bucket's last w seconds
  are copied into the bucket as context ("back" copies), so every frame of a
  bucket's rows is complete inside the bucket;
* a distinct count keeps, per (key, value), only the coverage interval
  [t, min(t + w, next occurrence)) of each occurrence; the next occurrence is a
  `lead` inside the same partition, for which the first w seconds of the next
  bucket are copied in as well ("fwd" copies);
* the running sum uses an UNBOUNDED PRECEDING frame, which Spark evaluates
  incrementally.

One hash shuffle on (key, bucket) serves both windows, a hot key is spread over
its time buckets, and results equal RANGE-frame semantics exactly (peers at the
same timestamp are included).  Keys with a burst - too many rows in one bucket,
however short - are counted over range partitions of (key, time) instead
(`_range_counts`), which split inside a window.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsight.operators.ordering import global_cumsum, next_value, spread

_REAL, _BACK, _FWD = 0, 1, 2


def time_bucket(us_col: str, size: int):
    """Bucket number of a time in microseconds, rounding down before 1970 too."""
    return F.expr(f"(`{us_col}` - pmod(`{us_col}`, {size})) div {size}")


def choose_bucket_secs(df: DataFrame, keys: list[str], us_col: str, secs: float,
                       target_rows: int = 2_000_000, start_secs: float = 3600.0) -> float:
    """Time-bucket length for (key, bucket) partitions: `start_secs` unless some
    key holds more than `target_rows` rows inside one bucket (a burst), then
    shorter in proportion, but never shorter than the window `secs`.  One
    partially aggregated count job; the result only changes partitioning."""
    start = max(start_secs, secs)
    b = int(start * 1_000_000)
    mx = (df.groupBy(*[F.col(k) for k in keys], time_bucket(us_col, b).alias("_b"))
            .agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]) or 0
    if mx <= target_rows:
        return start
    return max(float(secs), start * target_rows / mx)


#: Time covered by a (key, bucket) partition, and the rows from which a key goes over to
#: range partitions.
BUCKET_SECS = 3600.0
BURST_ROWS = 2_000_000
#: Hashes of keys and buckets that bursts are looked for by.
HASHES = 1 << 16


def burst_keys(df: DataFrame, key_sets: dict[str, list[str]], us_col: str, secs: float,
               burst_rows: int = BURST_ROWS) -> dict[str, DataFrame | None]:
    """Per named key set the keys with more than `burst_rows` rows in some time bucket
    (None without any).  One counting job for all sets finds the hashes of keys and buckets
    that have so many rows, at most HASHES a set; only their rows are counted by key."""
    size = int(max(BUCKET_SECS, secs) * 1_000_000)
    bucket = time_bucket(us_col, size)
    code = {n: F.pmod(F.xxhash64(*[F.col(k) for k in keys], bucket), F.lit(HASHES)) for n, keys in key_sets.items()}
    hashes = F.array(*[F.struct(F.lit(n).alias("_set"), code[n].alias("_h")) for n in key_sets])
    full = df.select(F.explode(hashes).alias("_i")).groupBy("_i._set", "_i._h").agg(F.count(F.lit(1)).alias("_n")) \
        .where(F.col("_n") > burst_rows).collect()  # fewer than rows / burst_rows a set
    if not full:
        return dict.fromkeys(key_sets)
    items = F.array(*[F.when(code[n].isin([r["_h"] for r in full if r["_set"] == n]), F.struct(
        F.lit(n).alias("_set"), F.to_json(F.struct(*[F.col(k).alias(k) for k in keys])).alias("_key")))
        for n, keys in key_sets.items()])
    many = df.select(F.explode(items).alias("_i"), bucket.alias("_b")).where("_i is not null").groupBy("_i._set", "_i._key", "_b") \
        .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > burst_rows).select("_set", "_key").distinct().checkpoint()
    found = {r["_set"] for r in many.select("_set").distinct().collect()}
    return {n: many.where(F.col("_set") == n).select("_key") if n in found else None for n in key_sets}


def sliding_counts(df: DataFrame, keys: list[str], us_col: str, secs: float, count_col: str | None = None,
                   distinct: dict[str, str] | None = None, order_col: str = "id", bucket_secs: float | None = None,
                   where=None, bursts: DataFrame | None | bool = True, burst_rows: int = BURST_ROWS,
                   rows: int | None = None) -> DataFrame:
    """Add per-row counts over the frame (us - w, us] within `keys`.

    count_col: output name for the row count (None to skip).
    distinct:  {output name: column} for distinct counts of `column`.
    where:     optional predicate; rows failing it are neither counted nor
               answered (their outputs are NULL) but stay in the result, so
               callers never branch and re-join the plan.
    bursts:    keys (`burst_keys`) whose rows are counted over range partitions instead of
               (key, time bucket) ones, so that a burst inside one window spreads over
               tasks; True finds them, None says that there are none.
    rows:      number of rows, counted where it is not given.
    All input columns are carried through; project before calling.
    """
    distinct = distinct or {}
    rows = df.count() if rows is None else rows
    if bursts is True:
        bursts = None if bucket_secs else burst_keys(df, {"k": keys}, us_col, secs, burst_rows)["k"]
    args = (keys, us_col, secs, count_col, distinct, order_col)
    if bursts is None:
        return _bucket_counts(df, *args, bucket_secs or BUCKET_SECS, where, rows)
    own = F.to_json(F.struct(*[F.col(k).alias(k) for k in keys]))
    tagged = df.withColumn("_key", own)
    calm = tagged.join(bursts, "_key", "left_anti").drop("_key")
    burst = tagged.join(bursts, "_key", "left_semi").drop("_key")
    return _bucket_counts(calm, *args, bucket_secs or BUCKET_SECS, where, rows).unionByName(
        _range_counts(burst, *args, where, burst_rows))


def _range_counts(df: DataFrame, keys: list[str], us_col: str, secs: float, count_col: str | None,
                  distinct: dict[str, str], order_col: str, where, rows_per_bucket: int) -> DataFrame:
    """The same counts as running sums of +1/-1 events in (key, time) order over range
    partitions; a question at time t comes after all events at t."""
    w = int(round(secs * 1_000_000))
    us = F.col(us_col)
    cols = df.columns
    inside = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    x = df.withColumn("_in", inside)
    for n, v in distinct.items():
        x = next_value(x, [*keys, "_in", v], us_col, [order_col], f"_nxt_{n}", rows_per_bucket)

    def ev(t, dc, dd, ask=False):
        return F.struct(t.alias("_t"), F.lit(int(ask)).alias("_s"), F.lit(dc).cast("long").alias("_dc"),
                        *[F.lit(dd.get(n, 0)).cast("long").alias(f"_dd_{n}") for n in distinct],
                        (F.struct(*cols, "_in") if ask else F.lit(None).cast(row_type)).alias("_row"))
    row_type = x.select(F.struct(*cols, "_in").alias("r")).schema["r"].dataType
    events = [ev(us, 0, {}, ask=True)]
    counted = [ev(us, 1, {n: 1 for n in distinct}), ev(us + w, -1, {})]
    counted += [ev(F.least(us + w, F.coalesce(F.col(f"_nxt_{n}"), us + w)), 0, {n: -1}) for n in distinct]
    events = F.array(*events, *[F.when(F.col("_in"), e) for e in counted])
    x = x.select(*keys, F.inline(F.filter(events, lambda e: e.isNotNull())))
    names = ["_dc", *[f"_dd_{n}" for n in distinct]]
    x = global_cumsum(x, ["_t", "_s"], names, rows_per_bucket, part=keys).where("_s = 1")
    outs = [F.when(F.col("_row._in"), F.col("_dc_cum")).alias(count_col)] if count_col else []
    outs += [F.when(F.col("_row._in"), F.col(f"_dd_{n}_cum")).alias(n) for n in distinct]
    return x.select(*[F.col(f"_row.{c}").alias(c) for c in cols], *outs)


def _bucket_counts(df: DataFrame, keys: list[str], us_col: str, secs: float, count_col: str | None,
                   distinct: dict[str, str], order_col: str, bucket_secs: float, where, rows: int) -> DataFrame:
    """Counts over (key, time bucket) partitions with context copies."""
    w = int(round(secs * 1_000_000))
    bsize = int(max(bucket_secs, secs) * 1_000_000)
    us = F.col(us_col)
    b = time_bucket(us_col, bsize)
    in_cols = df.columns
    x = df.withColumn("_in", F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    inside = F.col("_in")

    copies = [F.struct(b.alias("_bk"), F.lit(_REAL).alias("_role")),
              F.when(inside & (us >= (b + 1) * bsize - w),
                     F.struct((b + 1).alias("_bk"), F.lit(_BACK).alias("_role")))]
    if distinct:
        copies.append(F.when(inside & (us < b * bsize + w),
                             F.struct((b - 1).alias("_bk"), F.lit(_FWD).alias("_role"))))
    x = spread(x.select("*", F.inline(F.filter(F.array(*copies), lambda c: c.isNotNull()))), rows,
               *[F.col(k) for k in keys], F.col("_bk"))

    part = [F.col(k) for k in keys] + [F.col("_bk")]
    for name, vcol in distinct.items():
        wn = Window.partitionBy(*part, inside, F.col(vcol)).orderBy(us, F.col(order_col))
        x = x.withColumn(f"_nxt_{name}", F.lead(us).over(wn))
    x = x.filter(F.col("_role") != _FWD)

    # delta events: the row itself (+1s, answered if real), expiry of the row
    # (-1 count), end of each distinct coverage interval (-1 distinct);
    # rows outside `where` only carry their (unanswered) query row
    def ev(t, dc, qflag, dd, on=None):
        fields = [t.alias("_t"), F.lit(dc).alias("_dc"), qflag.alias("_q")]
        fields += [F.lit(dd.get(n, 0)).alias(f"_dd_{n}") for n in distinct]
        st = F.struct(*fields)
        return st if on is None else F.when(on, st)

    real = F.col("_role") == _REAL
    events = [F.when(inside, ev(us, 1, real, {n: 1 for n in distinct}))
              .otherwise(ev(us, 0, real, {})),
              ev(us + w, -1, F.lit(False), {}, on=inside)]
    for n in distinct:
        end = F.least(us + w, F.coalesce(F.col(f"_nxt_{n}"), us + w))
        events.append(ev(end, 0, F.lit(False), {n: -1}, on=inside))
    x = x.select("*", F.inline(F.filter(F.array(*events), lambda c: c.isNotNull())))

    run = Window.partitionBy(*part).orderBy(F.col("_t")).rangeBetween(Window.unboundedPreceding, 0)
    outs = []
    if count_col:
        outs.append(F.when(inside, F.sum("_dc").over(run)).alias(count_col))
    for n in distinct:
        outs.append(F.when(inside, F.sum(f"_dd_{n}").over(run)).alias(n))
    x = x.select(*[F.col(c) for c in in_cols], F.col("_q"), *outs).filter(F.col("_q")).drop("_q")
    return x


def row_blocks(df: DataFrame, keys: list[str], us_col: str, order_cols: list[str], carry: int,
               bucket_secs: float | None = None, block_rows: int = 1_000_000) -> DataFrame:
    """Prepare row-ordered windows (lag, last-n rows) that stay exact when one
    key holds a large share of the rows.

    Each row gets `_grank`, its 0-based position inside its key in
    (`order_cols`) order: a row number inside (key, time bucket) plus the row
    count of the key's earlier buckets (a small per-bucket table).  Rows are then
    grouped in blocks of `block_rows` consecutive positions and the last `carry`
    rows of each block are copied into the next block (`_carry` = true).  Callers
    window over partitionBy(keys + ['_blk']).orderBy('_grank') and drop carried
    rows afterwards; every block except a key's last one is full, so one
    preceding block always holds the `carry` rows needed.
    """
    if carry >= block_rows:
        raise ValueError("carry must be smaller than block_rows")
    if bucket_secs is None:
        bucket_secs = choose_bucket_secs(df, keys, us_col, 1.0)
    bsize = int(bucket_secs * 1_000_000)
    x = df.withColumn("_tb", time_bucket(us_col, bsize))
    kcols = [F.col(k) for k in keys]
    counts = x.groupBy(*kcols, F.col("_tb")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*keys, "_tb", (F.sum("_n").over(
        Window.partitionBy(*kcols).orderBy("_tb").rowsBetween(Window.unboundedPreceding, 0))
        - F.col("_n")).alias("_start"))
    local = Window.partitionBy(*kcols, F.col("_tb")).orderBy(*[F.col(c) for c in order_cols])
    x = (x.withColumn("_lr", F.row_number().over(local))
          .join(starts, keys + ["_tb"])
          .withColumn("_grank", F.col("_start") + F.col("_lr") - 1)
          .drop("_tb", "_lr", "_start"))
    blk = F.expr(f"_grank div {block_rows}")
    copies = F.array(F.struct(blk.alias("_blk"), F.lit(False).alias("_carry")),
                     F.when(F.expr(f"_grank % {block_rows}") >= block_rows - carry,
                            F.struct((blk + 1).alias("_blk"), F.lit(True).alias("_carry"))))
    x = x.select("*", F.inline(F.filter(copies, lambda c: c.isNotNull())))
    return x.repartition(*kcols, F.col("_blk"))
