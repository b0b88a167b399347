"""Global ordering helpers that never pull a whole table into one task.

Rows are range-partitioned by the sort keys themselves (any orderable type),
sorted inside the partitions and checkpointed, so that a row's partition and place
in it stay fixed; the partitions' row counts (one row per partition) give each its
offset.  The number of partitions follows the rows and their bytes, so that a task's
share of wide rows (texts, sequences) stays small.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of a range partition, at most about.
BUCKET_ROWS, BUCKET_BYTES = 2_000_000, 32 << 20
#: Rows of a partition below which more of them would not occupy the cores better.
BUSY_ROWS = 50_000
#: Rows that a task groups or sorts, about.
TASK_ROWS = 100_000

#: Rows of a table of groups up to which every task gets it whole.
FEW_ROWS = 10_000

#: monotonically_increasing_id keeps the place inside a partition in these bits.
_PLACE_BITS = 33


def _columns(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _bytes(c: Column, kind: T.DataType) -> Column | int:
    """About the bytes of a value; a number where all values of the type are alike."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return sum((_bytes(c.getField(f.name), f.dataType) for f in kind.fields), 8)
    if isinstance(kind, T.ArrayType) and isinstance(each := _bytes(c, kind.elementType), int):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * each + 8
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 8
    return 8


def sized(df: DataFrame) -> tuple[int, int]:
    """(rows, about their bytes): one counting job."""
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), 0)
    r = df.agg(F.count(F.lit(1)), F.sum(F.lit(width) if isinstance(width, int) else width)).first()
    return r[0], int(r[1] or 0)


def spread(df: DataFrame, rows: int, *cols: str | Column) -> DataFrame:
    """df's `rows` rows dealt by `cols` to partitions of about TASK_ROWS rows, or to as many
    as the session has where those are enough."""
    parts = -(-rows // TASK_ROWS)
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(parts, *cols)
    return df.repartition(*cols)


def few(groups: DataFrame) -> DataFrame:
    """`groups`, a row a group, to be broadcast where it has FEW_ROWS rows at most: a join
    by few keys would deal all rows of the other side to as few tasks."""
    rows = groups.limit(FEW_ROWS + 1).collect()
    if len(rows) > FEW_ROWS:
        return groups
    return F.broadcast(groups.sparkSession.createDataFrame(rows, groups.schema))


def placed(df: DataFrame, order: list, rows_per_bucket: int | None = None) -> tuple[DataFrame, int]:
    """(df in range partitions with `_pid` and the 0-based `_place` in it, row count)."""
    if rows_per_bucket:
        n = df.count()
        k = max(1, -(-n // rows_per_bucket))
    else:
        n, size = sized(df)
        busy = min(2 * df.sparkSession.sparkContext.defaultParallelism, n // BUSY_ROWS)
        k = max(1, busy, -(-n // BUCKET_ROWS), -(-size // BUCKET_BYTES))
    cols = _columns(order)
    x = df.repartitionByRange(k, *cols).sortWithinPartitions(*cols)
    mid = F.monotonically_increasing_id()
    x = x.withColumn("_mid", mid).checkpoint()
    return (x.withColumn("_pid", F.shiftright("_mid", _PLACE_BITS))
             .withColumn("_place", F.col("_mid").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).drop("_mid")), n


def number_rows(df: DataFrame, order: list, out: str, rows_per_bucket: int | None = None) -> tuple[DataFrame, int]:
    """df with `out` = 0-based position in the order of all rows, and their number."""
    x, n = placed(df, order, rows_per_bucket)
    sizes = x.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # a global window over one row per partition
    offs = sizes.select("_pid", (F.sum("_cnt").over(Window.orderBy("_pid")) - F.col("_cnt")).alias("_off"))
    # not joined by shuffle: the rows stay in their range partitions
    x = x.join(F.broadcast(offs), "_pid").withColumn(out, F.col("_off") + F.col("_place"))
    return x.drop("_pid", "_place", "_off"), n


def global_row_number(df: DataFrame, key: str, ascending: bool = True, out: str = "rn",
                      tiebreak: str | None = None, rows_per_bucket: int | None = None) -> tuple[DataFrame, int]:
    """(df with `out` = 1-based position in key order, total row count)."""
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in (key, tiebreak) if c]
    x, n = number_rows(df, order, out, rows_per_bucket)
    return x.withColumn(out, F.col(out) + 1), n


HASH_SPACE = 1 << 32


def hash32(*cols, seed: int = 42):
    """Reproducible 32-bit hash of (seed, cols): first 8 hex digits of md5."""
    s = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def rank_within(df: DataFrame, part: list[str], h: str, tiebreak: str, out: str = "rank",
                rows_per_bucket: int | None = None) -> DataFrame:
    """0-based rank of each row inside `part` ordered by (h, tiebreak): the position in
    the order of (part, h, tiebreak) less the group's first one.  A hot group spreads
    over as many range partitions as its rows need."""
    x, _ = number_rows(df, [*part, h, tiebreak], "_pos", rows_per_bucket)
    keys = [f"_g{i}" for i in range(len(part))]
    first = x.groupBy(*[F.col(p).alias(k) for p, k in zip(part, keys)]).agg(F.min("_pos").alias("_first"))
    same = [F.col(p).eqNullSafe(F.col(k)) for p, k in zip(part, keys)]
    return x.join(few(first), same).withColumn(out, F.col("_pos") - F.col("_first")).drop("_pos", "_first", *keys)


def join_same(x: DataFrame, y: DataFrame, keys: list[str], exact: list[str] = ()) -> DataFrame:
    """x joined to y on `keys` (NULL equals NULL) and `exact`, y's keys dropped."""
    names = {k: f"_y_{k}" for k in [*keys, *exact]}
    y = y.withColumnsRenamed(names)
    cond = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys] + [F.col(k) == F.col(names[k]) for k in exact]
    return x.join(y, cond).drop(*names.values())


def global_cumsum(df: DataFrame, key: str | list[str], cols: list[str], rows_per_bucket: int | None = None,
                  suffix: str = "_cum", part: list[str] = ()) -> DataFrame:
    """Inclusive running sums of `cols` in ascending order of `key` (rows that share it in
    a `part` group come in any order) over the whole table: per-(part, partition) totals
    become offsets (a group meets few range partitions), running sums inside each."""
    part = list(part)
    x, _ = placed(df, [*part, *([key] if isinstance(key, str) else key)], rows_per_bucket)
    tot = x.groupBy(*part, "_pid").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(cols)])
    ow = Window.partitionBy(*part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*part, "_pid", *[F.coalesce(F.sum(f"_t{i}").over(ow), F.lit(0)).alias(f"_o{i}")
                                       for i in range(len(cols))])
    w = Window.partitionBy(*part, "_pid").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    x = join_same(x, offs, part, ["_pid"])
    return x.select(*[F.col(c) for c in df.columns],
                    *[(F.col(f"_o{i}") + F.sum(c).over(w)).alias(c + suffix) for i, c in enumerate(cols)])


def next_value(df: DataFrame, part: list[str], value: str, order: list[str], out: str,
               rows_per_bucket: int | None = None) -> DataFrame:
    """`out` = the value of the next row of the same `part` group in (value, order), NULL
    for its last row: a lead inside each range partition; a partition's last row takes the
    first value of the group's next partition."""
    x, _ = placed(df, [*part, value, *order], rows_per_bucket)
    firsts = x.groupBy(*part, "_pid").agg(F.min(value).alias("_first"))
    after = firsts.select(*part, "_pid", F.lead("_first").over(Window.partitionBy(*part).orderBy("_pid")).alias("_after"))
    lead = F.lead(value).over(Window.partitionBy(*part, "_pid").orderBy("_place"))
    return join_same(x, after, part, ["_pid"]).withColumn(out, F.coalesce(lead, F.col("_after"))) \
        .select(*df.columns, out)
