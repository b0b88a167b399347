"""Ranked lexical search by range-maximum queries over posting lists.

An index is a table of shards: up to ``SHARD_DOCS`` documents each, ordered by
their number of terms, with one posting list (document numbers, occurrences) a
term.  A search lays a query's posting lists over the shard's documents, with a
sparse table of range maxima each, and works through intervals of documents best
first: the summed answers of the lists' range-maximum queries bound every score
in an interval; the document with the interval's largest single impact is scored
exactly and splits it in two.  Intervals go when their bound is below the k-th
best score, or equals it and all their ids are larger than the k-th one's.  The
queue is taken from in growing batches, so that range maxima are array work.

Weights and lengths need figures of the whole corpus (N, L, df): one pass over
the shards' dictionaries counts df of the query's terms, a second one searches.
A task carries its k best of each query from shard to shard and returns them at
its end; windows rank what the tasks return, in two levels.

Memory: a shard holds at most ``SHARD_POSTINGS`` postings (or one document), a
worker one shard and tables of ``TABLE_BYTES``.  Queries are taken in blocks of
about ``BLOCK_BYTES`` of terms, picked by a hash of their id; a block's results
are written before the next block is read.  Nothing of the documents meets by a
key, so no term or source can be hot.

Cases: null and empty texts have no term and are neither counted nor found; rows
of one item id are one query with the terms of all; a null item id is a query;
each repeated document row counts and can be found; null document ids come after
all others among equal scores; empty tables give no rows; extra columns are
ignored.
"""
from __future__ import annotations

import bisect
import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsight.llm.common import map_batches, materialise, parts_for, prepare, texts_of, work_path

#: Document numbers of a shard fit these bits.
DOC_BITS = 12
SHARD_DOCS = 1 << DOC_BITS
SHARD_POSTINGS = 1 << 21
TABLE_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
#: Intervals taken from the queue at once: the first time, and at most.
FIRST_BATCH, LAST_BATCH = 16, 1024
#: The weights' and impacts' constants.
IMPACT_SCALE, TF_FACTOR, LENGTH_FACTOR, LENGTH_SHARE = 1_000_000_000, 1000, 8, 90

#: Digits, letters and all bytes of non-ASCII characters stay, A-Z become a-z, the rest separates.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def id_order(x) -> tuple:
    """Sort key of an id: null last."""
    return x is None, 0 if x is None else x


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


# ---------------------------------------------------------------------- index


class ShardBuilder:
    """Collects documents; `pack` returns a shard's columns and starts anew."""

    def __init__(self):
        self.ids, self.lengths, self.sizes = [], [], []
        self.words: dict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.word_of, self.tf = array("i"), array("q")

    def add(self, doc_id, text: bytes) -> None:
        counts = Counter(terms_of(text))
        if not counts:
            return
        self.ids.append(doc_id)
        self.lengths.append(sum(counts.values()))
        self.sizes.append(len(counts))
        self.word_of.extend(map(self.words.__getitem__, counts))
        self.tf.extend(counts.values())

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.tf) >= SHARD_POSTINGS

    def pack(self) -> dict:
        order = sorted(range(len(self.ids)), key=lambda i: (self.lengths[i], *id_order(self.ids[i])))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, self.sizes)
        key = (np.array(self.word_of, np.int64) << DOC_BITS) | doc
        by = np.argsort(key)
        starts = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bincount(self.word_of, minlength=len(self.words)), out=starts[1:])
        row = {"n_docs": len(order), "n_terms": sum(self.lengths), "doc_ids": [self.ids[i] for i in order],
               "lengths": np.array(self.lengths, np.int64)[order].tobytes(), "words": b" ".join(self.words),
               "starts": starts.astype(np.uint32).tobytes(), "docs": doc[by].astype(np.uint16).tobytes(),
               "tfs": np.array(self.tf, np.int64)[by].astype(np.uint32).tobytes()}
        self.__init__()
        return row


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents as a table of shards in the shared folder."""
    spark = docs.sparkSession
    prepare(spark)
    sel = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(sel.dtypes)["doc_id"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, schema = ShardBuilder(), None

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([shard.pack()], schema=schema)
        for b in batches:
            schema = schema or pa.schema([("n_docs", pa.int32()), ("n_terms", pa.int64()), ("doc_ids", pa.list_(b.schema.types[0])),
                                          *[(c, pa.binary()) for c in ("lengths", "words", "starts", "docs", "tfs")]])
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                shard.add(doc_id, text)
                if shard.full():
                    yield packed()
        if shard.ids:
            yield packed()

    blobs = ", ".join(f"{c} binary" for c in ("lengths", "words", "starts", "docs", "tfs"))
    shards = sel.mapInArrow(build, f"n_docs int, n_terms long, doc_ids array<{kind}>, {blobs}")
    path = work_path(spark, "index")
    shards.write.option("parquet.block.size", 16 << 20).parquet(path)  # a reader holds few shards
    return spark.read.schema(shards.schema).parquet(path)


# --------------------------------------------------------------------- search


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def range_maxima(rows: np.ndarray) -> np.ndarray:
    """Sparse table over axis 0: level j at i is the maximum of rows i .. i + 2**j - 1."""
    levels = max(1, len(rows).bit_length())
    out = np.zeros((levels, *rows.shape), rows.dtype)
    out[0] = rows
    for j in range(1, levels):
        half = 1 << (j - 1)
        n = len(rows) - 2 * half + 1
        np.maximum(out[j - 1, :n], out[j - 1, half:half + n], out=out[j, :n])
    return out


_LOG2 = np.frombuffer(bytes(max(0, i.bit_length() - 1) for i in range(SHARD_DOCS + 1)), np.uint8).astype(np.int64)


class Intervals:
    """One query over consecutive documents of a shard: answers per posting list."""

    def __init__(self, impact: np.ndarray):
        """impact[document, list]: the list's impact on the document, 0 where it is not in it."""
        number = np.arange(len(impact), dtype=np.int64)[:, None]
        self.table = range_maxima((impact << DOC_BITS) | number)

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the lists' maxima, document of the largest one) of intervals [lo, hi)."""
        j = _LOG2[hi - lo]
        best = np.maximum(self.table[j, lo], self.table[j, hi - (1 << j)])
        return (best >> DOC_BITS).sum(axis=1), best.max(axis=1) & (SHARD_DOCS - 1)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        return (self.table[0, docs] >> DOC_BITS).sum(axis=1)


def _key(hit: tuple) -> tuple:
    return -hit[0], *id_order(hit[1])


def best_first(view: Intervals, n: int, doc_ids: list, ranks: np.ndarray, sorted_keys: list, best: list, k: int) -> list:
    """The k best (score, id) among `best` and documents 0..n-1 of the view.  doc_ids: the
    view's ids; ranks: their places among sorted_keys, the shard's ids in order."""
    least = None

    def hopeful(lo, hi, bound):
        nonlocal least
        if len(best) < k:
            return bound > 0
        score, last = best[-1][0], bisect.bisect_left(sorted_keys, _key(best[-1])[1:])
        keep = bound > score
        tied = np.flatnonzero(bound == score)
        if len(tied):  # only smaller ids than the last one's can still come in
            least = range_maxima(-ranks) if least is None else least
            j = _LOG2[hi[tied] - lo[tied]]
            keep[tied] = -np.maximum(least[j, lo[tied]], least[j, hi[tied] - (1 << j)]) < last
        return keep

    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    bound, top = view.bounds(lo, hi)
    batch = FIRST_BATCH
    while True:
        keep = hopeful(lo, hi, bound)
        lo, hi, bound, top = lo[keep], hi[keep], bound[keep], top[keep]
        if not len(lo):
            return best
        take = np.arange(len(lo)) if len(lo) <= batch else np.argpartition(-bound, batch)[:batch]
        docs = top[take]
        scores = view.scores(docs)
        good = np.flatnonzero(scores >= max(1, best[-1][0] if len(best) >= k else 1))
        best = sorted(best + [(int(scores[i]), doc_ids[docs[i]]) for i in good], key=_key)[:k]
        a, b = np.concatenate([lo[take], docs + 1]), np.concatenate([docs, hi[take]])
        some = b > a
        a, b = a[some], b[some]
        rest = np.ones(len(lo), bool)
        rest[take] = False
        more, at = view.bounds(a, b)
        lo, hi, bound, top = (np.concatenate([x[rest], y]) for x, y in ((lo, a), (hi, b), (bound, more), (top, at)))
        batch = min(LAST_BATCH, 2 * batch)


def search_shard(shard: dict, terms: dict[bytes, int], weights: np.ndarray, queries: list[np.ndarray], n_docs: int, n_terms: int,
                 best: list[list], k: int) -> None:
    """Updates best[q] for every query q (numbers of its terms) with the shard's documents."""
    starts, docs, tfs = (np.frombuffer(shard[c], t).astype(np.int64)
                         for c, t in (("starts", np.uint32), ("docs", np.uint16), ("tfs", np.uint32)))
    lengths, doc_ids = np.frombuffer(shard["lengths"], np.int64), shard["doc_ids"]
    # m of a document; Python integers, since the products may pass 64 bits
    m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
    place = np.full(len(weights), -1, np.int64)
    for i, w in enumerate(shard["words"].split(b" ")):
        t = terms.get(w)
        if t is not None and weights[t] > 0:
            place[t] = i
    keys = [id_order(x) for x in doc_ids]
    sorted_keys = sorted(keys)
    rank_of = {x: i for i, x in enumerate(sorted_keys)}
    ranks = np.array([rank_of[x] for x in keys], np.int64)
    lists: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def posting(t: int) -> tuple[np.ndarray, np.ndarray, int]:
        if t not in lists:
            a, b = starts[place[t]], starts[place[t] + 1]
            d, f = docs[a:b], tfs[a:b]
            impact = weights[t] * (IMPACT_SCALE * f // (TF_FACTOR * f + LENGTH_FACTOR * m[d]))
            lists[t] = d, impact, int(impact.max())
        return lists[t]

    for q, numbers in enumerate(queries):
        there = [posting(t) for t in numbers[place[numbers] >= 0].tolist()]
        if not there or (len(best[q]) >= k and sum(x[2] for x in there) < best[q][-1][0]):
            continue
        met = np.zeros(len(doc_ids), bool)
        for d, _, _ in there:
            met[d] = True
        own = np.flatnonzero(met)  # the documents of any list, in order
        number = np.cumsum(met) - 1
        step = SHARD_DOCS
        while step > 1 and min(step, len(own)) * len(there) * 8 * step.bit_length() > TABLE_BYTES:
            step //= 2
        for at in range(0, len(own), step):
            here = own[at:at + step]
            impact = np.zeros((len(here), len(there)), np.int64)
            for i, (d, x, _) in enumerate(there):
                if len(here) < len(own):
                    a, b = np.searchsorted(d, (here[0], here[-1] + 1))
                    d, x = d[a:b], x[a:b]
                impact[number[d] - at, i] = x
            ids = [doc_ids[i] for i in here.tolist()]
            best[q] = best_first(Intervals(impact), len(here), ids, ranks[here], sorted_keys, best[q], k)


def _queries(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, terms): the distinct terms of all rows of an item."""
    sel = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(sel.dtypes)["item_id"]

    def split(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [sorted(set(terms_of(t))) for t in texts_of(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])
    terms = map_batches(sel, split, f"item_id {kind}, terms array<binary>").select("item_id", F.explode("terms").alias("term"))
    return terms.distinct().groupBy("item_id").agg(F.collect_list("term").alias("terms"))


def _document_counts(shards: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    """Documents of the index that hold each term."""
    n = len(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n, np.int64)
        for b in batches:
            for words, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                size = np.diff(np.frombuffer(starts, np.uint32).astype(np.int64))
                for i, w in enumerate(words.split(b" ")):
                    t = terms.get(w)
                    if t is not None:
                        df[t] += size[i]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["t", "df"])
    parts = shards.select("words", "starts").mapInArrow(count, "t long, df long")
    out = np.zeros(n, np.int64)
    for t, df in parts.groupBy("t").agg(F.sum("df")).collect():  # a row for each of the block's terms
        out[t] = df
    return out


def search(shards: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k highest-scoring documents of every item: item_id, rank, doc_id, score."""
    spark = shards.sparkSession
    prepare(spark)
    queries = materialise(_queries(items, id_col, text_col), "queries")
    n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    size = queries.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t) + 8))).first()[0] or 0
    item_type, doc_type = dict(queries.dtypes)["item_id"], dict(shards.dtypes)["doc_ids"][len("array<"):-1]
    schema = f"item_id {item_type}, doc_id {doc_type}, score long"
    n_blocks = parts_for(size, BLOCK_BYTES)
    paths = []
    for block in range(n_blocks if n_docs else 0):
        rows = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()
        hits = _search_block(shards, [r[0] for r in rows], [r[1] for r in rows], n_docs, n_terms, k, schema)
        paths.append(work_path(spark, "hits"))
        hits.write.parquet(paths[-1])
    found = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(32))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", salt).orderBy(*order))).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search_block(shards: DataFrame, item_ids: list, item_terms: list, n_docs: int, n_terms: int, k: int, schema: str) -> DataFrame:
    terms = {t: i for i, t in enumerate(dict.fromkeys(bytes(t) for ts in item_terms for t in ts))}
    queries = [np.array([terms[bytes(t)] for t in ts], np.int64) for ts in item_terms]
    df = _document_counts(shards, terms)
    weights = np.array([weight(n_docs, d) for d in df.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]
        kind = None
        for b in batches:
            kind = b.schema.field("doc_ids").type.value_type
            for shard in b.to_pylist():
                search_shard(shard, terms, weights, queries, n_docs, n_terms, best, k)
        if kind is not None:
            rows = [(item_ids[q], d, s) for q, hits in enumerate(best) for s, d in hits]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], item_kind), pa.array([r[1] for r in rows], kind),
                                              pa.array([r[2] for r in rows], pa.int64())], ["item_id", "doc_id", "score"])
    item_kind = pa.array([x for x in item_ids if x is not None]).type if any(x is not None for x in item_ids) else pa.int64()
    return shards.mapInArrow(run, schema)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k highest-scoring documents of every item, indexing all documents first."""
    return search(index(docs), items, k)
