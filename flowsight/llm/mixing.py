"""Mixing sources to target weights by a low-discrepancy schedule.

A schedule of slots is laid out with van der Corput points: slot ``t`` has the
point ``bitreverse(t) / 2**52``, and the interval of cumulative source weights
that holds it names the slot's source.  Slot ``r`` of a source takes the
source's block ``r mod blocks``; blocks are equal runs of tokens of the
source's documents in shuffled order (md5 of the id).  Everything is DataFrame
operations.

The rank of a slot within its source needs no window: how many of the first
``t`` points lie below a bound is a sum over the bound's binary digits
(``_points_below``).  Offsets of documents in the shuffled order are prefix
sums in two levels, (source, md5 prefix) and inside it, so a source holding a
third of all rows is spread over its prefixes.

Cases: null or empty text has size 0 and is taken 0 times; a null source is a
source of its own, the last; repeated rows are each returned, ties in the order
are broken by id and size; a table without tokens has targets 0; an empty table
gives no rows; extra columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsight.llm.common import WORD_RE, materialise, prepare

POINT_BITS = 52
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken at most this many times.
MAX_EPOCHS = 3


def bit_reverse(v: Column) -> Column:
    """The low POINT_BITS bits of a non-negative long, reversed."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F),
                        (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        m = F.lit(mask).cast("long")
        v = F.shiftrightunsigned(v, shift).bitwiseAND(m).bitwiseOR(F.shiftleft(v.bitwiseAND(m), shift))
    v = F.shiftrightunsigned(v, 32).bitwiseOR(F.shiftleft(v, 32))
    return F.shiftrightunsigned(v, 64 - POINT_BITS)


def _digits(bound: str) -> Column:
    """Array over j = 1..POINT_BITS: see ``_points_below``."""
    def one(j: Column) -> Column:
        shift = F.lit(POINT_BITS) - j
        top = F.call_function("shiftright", F.col(bound), shift)
        residue = bit_reverse(F.call_function("shiftleft", top - 1, shift))
        return F.when(top % 2 == 1, residue).otherwise(F.lit(-1).cast("long"))
    return F.transform(F.sequence(F.lit(1), F.lit(POINT_BITS)), one)


def _points_below(t: str, digits: str, bound: str) -> Column:
    """How many of the points of slots 0..t-1 are below the bound.  A bound with
    digit j set covers the dyadic interval of length 2**-j that shares its digits
    above j; its slots are those with one residue r modulo 2**j, of which
    (t + 2**j - 1 - r) div 2**j are below t."""
    total = F.expr(f"aggregate({digits}, named_struct('s', 0L, 'p', 2L), (a, r) -> named_struct("
                   f"'s', a.s + if(r < 0, 0L, ({t} + a.p - 1 - r) div a.p), 'p', a.p * 2), a -> a.s)")
    return F.when(F.col(bound) >= (1 << POINT_BITS), F.col(t)).otherwise(total)


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size) -> + weight, target.  A target is the smaller
    of weight x level and MAX_EPOCHS x size; sources are capped in the order of
    cap / weight, and the level is what is left divided by the weights left.
    One row per source passes one task here, nothing else."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]),
                     ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.lit(MAX_EPOCHS) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    left = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("left", left).withColumn("wl", weight_left)
    s = s.withColumn("capped", F.col("cap") * F.col("wl") <= F.col("left") * F.col("weight"))
    # the first uncapped source in ratio order sets the level
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("left") / F.col("wl")))) \
        .over(every).getField("col2")
    return s.select("source", "source_size", "weight",
                    F.when(F.col("capped"), F.col("cap").cast("double"))
                    .otherwise(F.col("weight") * level).alias("target"))


def schedule(targets: DataFrame, block_tokens: int, min_blocks: int) -> tuple[DataFrame, DataFrame]:
    """(plan, slots).  plan: one row per source with its block length ``block``
    (tokens), number of blocks and interval [lo, hi) of points.  slots: slot,
    source, rank, epoch and block_no of every slot that is filled."""
    spark = targets.sparkSession
    per = lambda c: F.ceil(F.col(c) / min_blocks)
    plan = (targets.where("source_size > 0")
            .withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_tokens), per("source_size"), per("target"))).cast("long"))
            .withColumn("blocks", F.expr("(source_size + block - 1) div block"))
            .withColumn("slots", F.floor(F.col("target") / F.col("block") + 0.5).cast("long")))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy(F.lit(1))
    scaled = lambda c: F.expr(f"cast(cast({c} as decimal(38,0)) * {1 << POINT_BITS} div total as long)")
    plan = (plan.withColumn("upto", F.sum("slots").over(by_name)).withColumn("total", F.sum("slots").over(every))
            .withColumn("lo", scaled("upto - slots")).withColumn("hi", scaled("upto"))
            .withColumn("lo_digits", _digits("lo")).withColumn("hi_digits", _digits("hi")))
    plan = materialise(plan, "mix-plan")
    seen = plan.agg(F.max("total"), F.count("*")).first()
    total, n_sources = int(seen[0] or 0), int(seen[1])
    # cells of points, a few per source: an equality join instead of a range join
    cell_bits = max(1, (4 * n_sources).bit_length())
    cell = lambda c: F.shiftright(c, POINT_BITS - cell_bits)
    cells = (plan.where("hi > lo").withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1)))))
    t = spark.range(total).withColumnRenamed("id", "slot").withColumn("point", bit_reverse(F.col("slot")))
    slots = (t.withColumn("cell", cell(F.col("point"))).join(cells, "cell")
             .where("point >= lo and point < hi")
             .withColumn("rank", _points_below("slot", "hi_digits", "hi") - _points_below("slot", "lo_digits", "lo"))
             .withColumn("epoch", F.expr("rank div blocks")).where(F.col("epoch") < MAX_EPOCHS)
             .select("slot", "source", "rank", "epoch", F.expr("rank % blocks").alias("block_no")))
    return plan, slots


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        block_tokens: int = 4096, min_blocks: int = 2048, bucket_rows: int = 10_000) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's) and
    taken, the words the mix takes of it, repeats counted."""
    prepare(docs.sparkSession)
    key = F.col(id_col).cast("string")
    rows = materialise(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(key, F.lit(""))).alias("h")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = materialise(source_targets(sizes.select("source", "source_size")), "mix-targets")
    plan, slots = schedule(targets, block_tokens, min_blocks)
    uses = slots.groupBy("source", "block_no").agg(F.count("*").alias("uses"))

    digits = 0
    n = rows.count()
    while n > bucket_rows * 16 ** digits:
        digits += 1
    bucketed = rows.where("size > 0").withColumn("bucket", F.substring("h", 1, digits))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (bucketed.withColumn("end", F.sum("size").over(inside))
              .join(starts.withColumnsRenamed({"source": "s2", "bucket": "b2"}),
                    F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
              .withColumn("off", F.col("start") + F.col("end") - F.col("size"))
              .select("doc_id", "source", "size", "off"))
    # blocks beyond the slots of a source (and the points' discrepancy) are never used
    p = plan.select(F.col("source").alias("s3"), "block", (F.col("slots") + 2 * POINT_BITS).alias("last"))
    pieces = (placed.join(p, F.col("source").eqNullSafe(F.col("s3")))
              .withColumn("first_no", F.expr("off div block"))
              .withColumn("last_no", F.least(F.expr("(off + size - 1) div block"), F.col("last")))
              .where("first_no <= last_no")
              .withColumn("block_no", F.explode(F.sequence("first_no", "last_no")))
              .withColumn("words", F.least(F.col("off") + F.col("size"), (F.col("block_no") + 1) * F.col("block"))
                          - F.greatest(F.col("off"), F.col("block_no") * F.col("block"))))
    u = uses.withColumnsRenamed({"source": "s4", "block_no": "b4"})
    got = (pieces.join(u, F.col("source").eqNullSafe(F.col("s4")) & (F.col("block_no") == F.col("b4")))
           .groupBy("source", "off").agg(F.sum(F.col("words") * F.col("uses")).alias("got"))
           .withColumnsRenamed({"source": "s5", "off": "o5"}))
    taken = placed.join(got, F.col("source").eqNullSafe(F.col("s5")) & (F.col("off") == F.col("o5")), "left") \
        .select("doc_id", "source", "size", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))
    whole = taken.unionByName(rows.where("size = 0").select("doc_id", "source", "size",
                                                            F.lit(0).cast("long").alias("taken")))
    t = targets.select(F.col("source").alias("s6"), "source_size", "target")
    return whole.join(t, F.col("source").eqNullSafe(F.col("s6"))) \
        .select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")
