"""B17 at scale: substring search through a table of trigram postings.

Every character of a text starts a trigram; two end marks follow each field, so the short
ends count too and a search of one or two characters is one for trigrams that begin with
them.  A posting row holds the places in one block of up to 65,536 documents, sorted, as
differences, so no group grows with a frequent trigram.  Postings are partitioned by a hash
of the trigram and sorted inside files: a search reads the rows of its own trigrams.
Candidates of the rarest trigrams are verified on the whole text, so results equal the
scan's (``attack.search_techniques``).
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsight.operators.attack import search_techniques
from flowsight.operators.ordering import number_rows
from flowsight.session import join_path

END = "\0\0"
META = "buckets int, block long, fields array<string>, id_col string"
ROWS = 100_000  # rows of one Arrow batch
RARE = 3  # trigrams intersected; verification does the rest


def _terms(rows: DataFrame) -> DataFrame:
    """(key, term): the distinct trigrams of each row's (key, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, terms, texts = [], [], b.column(1).to_pylist()
            for i, t in enumerate(texts):
                own = {t[j:j + 3] for j in range(len(t) - 2)}
                at += [i] * len(own)
                terms += own
                if len(terms) > ROWS or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string())], ["key", "term"])
                    at, terms = [], []
    key, text = rows.columns
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)[key]}, term string")


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted numbers of each list to their differences; the first stays."""
    for b in batches:
        lists = b.column(3)
        v = lists.flatten().to_numpy()
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        d = np.diff(v, prepend=np.int32(0)).astype(np.int32)
        first = at[:-1][np.diff(at) > 0]
        d[first] = v[first]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(
            pa.array(at.astype(np.int32)), pa.array(d))], ["term", "blk", "n", "steps"])


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, term, no) of posting rows (key, term, the block's first number, steps)."""
    for b in batches:
        lists = b.column(3)
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        total = np.concatenate([[0], np.cumsum(lists.flatten().to_numpy(), dtype=np.int64)])
        rows = np.repeat(np.arange(b.num_rows), np.diff(at))
        no = total[1:] - total[at[:-1]][rows] + b.column(2).to_numpy()[rows]
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(no)], ["key", "term", "no"])


def build_index(kb: DataFrame, path: str, id_col: str = "id", fields: tuple[str, ...] = ("name", "description"),
                buckets: int = 64, block: int = 65_536) -> None:
    """Write ``path``/docs (no, blk and the columns of ``kb``) and ``path``/postings.  NULL
    fields hold nothing."""
    numbered, _ = number_rows(kb, [F.col(id_col), *[F.col(f) for f in fields]], "no")
    numbered.withColumn("blk", F.expr(f"no div {block}")).write.mode("overwrite").partitionBy("blk").parquet(join_path(path, "docs"))
    docs = kb.sparkSession.read.parquet(join_path(path, "docs"))
    text = F.concat(*[F.concat(F.lower(F.coalesce(f, F.lit(""))), F.lit(END)) for f in fields])
    found = _terms(docs.select("no", text.alias("text"))).withColumnRenamed("key", "no")
    rows = found.groupBy("term", F.expr(f"no div {block}").alias("blk")).agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.sort_array(F.collect_list((F.col("no") % block).cast("int"))).alias("at"))
    kinds = "term string, blk long, n int, steps array<int>"
    coded = rows.mapInArrow(_differences, kinds).withColumn("bucket", F.crc32("term") % buckets)
    coded.repartition("bucket").sortWithinPartitions("bucket", "term", "blk").write.mode("overwrite") \
        .option("parquet.enable.dictionary", "true").partitionBy("bucket").parquet(join_path(path, "postings"))
    kb.sparkSession.createDataFrame([(buckets, block, list(fields), id_col)], META).write.mode("overwrite").json(join_path(path, "meta"))


def _verified(docs: DataFrame, fields: list[str], query) -> Column:
    hit = None
    for f in fields:
        h = F.contains(F.lower(F.col(f)), query)
        hit = h if hit is None else hit | h
    return hit


def postings(spark: SparkSession, path: str, query: str, buckets: int) -> tuple[DataFrame, list[str]]:
    """The posting rows of the query's trigrams (lower case, not empty), and the trigrams;
    none are listed for fewer than three characters, whose rows are those that begin so."""
    p = spark.read.parquet(join_path(path, "postings"))
    if len(query) < 3:
        return p.where(F.startswith("term", F.lit(query))), []
    terms = sorted({query[i:i + 3] for i in range(len(query) - 2)})
    where = sorted({zlib.crc32(t.encode()) % buckets for t in terms})
    return p.where(F.col("bucket").isin(where) & F.col("term").isin(terms)), terms


def search(spark: SparkSession, path: str, query: str, n: int | None = 10) -> DataFrame:
    """The rows of the knowledge base that hold ``query`` in a field, first ``n`` by id; the
    columns as given to ``build_index``.  An empty query is a scan."""
    meta = spark.read.schema(META).json(join_path(path, "meta")).first()
    docs, q = spark.read.parquet(join_path(path, "docs")), query.lower()
    if not q:
        return search_techniques(docs.drop("no", "blk"), query, n)
    rows, terms = postings(spark, path, q, meta.buckets)
    if terms:
        sizes = {r.term: r.n for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row a trigram of the query
        rare = sorted(terms, key=lambda t: (sizes.get(t, 0), t))[:RARE]
        rows = rows.where(F.col("term").isin(rare))
    found = rows.select(F.lit(0).alias("key"), "term", F.col("blk") * meta.block, "steps").mapInArrow(_numbers, "key int, term string, no long")
    nos = found.groupBy("no").agg(F.count(F.lit(1)).alias("c"))
    if terms:
        nos = nos.where(F.col("c") == len(rare))
    nos = nos.select("no", F.expr(f"no div {meta.block}").alias("blk"))
    out = docs.join(nos, ["blk", "no"], "left_semi").where(_verified(docs, meta.fields, F.lit(q))).drop("no", "blk")
    out = out.orderBy(meta.id_col)
    return out.limit(n) if n else out


def search_many(queries: DataFrame, path: str, key: str = "key", query: str = "query") -> DataFrame:
    """(key, id) of every row that holds the query, for a table of queries with different
    keys.  Empty and NULL queries find nothing here."""
    spark = queries.sparkSession
    meta = spark.read.schema(META).json(join_path(path, "meta")).first()
    docs, p = (spark.read.parquet(join_path(path, x)) for x in ("docs", "postings"))
    q = queries.select(F.col(key).alias("key"), F.lower(F.col(query)).alias("query")).where("length(query) > 0")
    kind = dict(q.dtypes)["key"]
    # three characters and more: the rarest trigrams, sizes read from the counts alone
    long = _terms(q.where("length(query) >= 3").select("key", "query"))
    sizes = p.groupBy("term").agg(F.sum("n").alias("size"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("size", "term"))
    rare = long.join(sizes, "term", "left").fillna(0, ["size"]).withColumn("r", rank).where(F.col("r") <= RARE)
    want = rare.groupBy("key").agg(F.count(F.lit(1)).alias("want"))
    hits = rare.select("key", "term", (F.crc32("term") % meta.buckets).alias("bucket")).join(p, ["bucket", "term"])
    numbers = lambda x: x.select("key", "term", F.col("blk") * meta.block, "steps").mapInArrow(_numbers, f"key {kind}, term string, no long")
    all_of = numbers(hits).groupBy("key", "no").agg(F.count(F.lit(1)).alias("c")).join(want, "key").where("c = want").select("key", "no")
    # shorter: every trigram that begins so
    begin = p.withColumn("begin", F.explode(F.array(F.substring("term", 1, 1), F.substring("term", 1, 2))))
    short = q.where("length(query) < 3").withColumnRenamed("query", "begin").join(begin, "begin")
    cand = all_of.unionByName(numbers(short).select("key", "no").distinct())
    text = docs.select("no", F.col(meta.id_col).alias("id"), *meta.fields)
    both = cand.join(q, "key").join(text, "no")
    return both.where(_verified(both, meta.fields, F.col("query"))).select("key", "id")
