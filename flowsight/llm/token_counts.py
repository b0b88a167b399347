"""Token counts of whole texts by a public tokenizer's own library.

Texts up to ``chunk_chars`` are counted in one go.  Longer ones are cut into
overlapping chunks that are encoded in different tasks, with offsets; chunks
are spliced at a boundary between pre-tokens that both encodings show in their
overlap.  Such a boundary is proven stable: the pre-tokenizer scans left to
right and its state is its position, so once two scans of the same text stand
at one position they agree from there on; the left scan is exact up to the end
of its chunk less a margin for look-ahead and cut special strings.  Texts with an
overlap that shows no common boundary are cut again with chunks and overlaps
four times as wide, until one chunk holds the whole text.

Short texts are counted through a memo of stretches between certain pre-token
boundaries (a space followed by a non-space starts a pre-token, whatever stands
before it), each stretch encoded by the library once per worker and memo
generation; the memo is bounded.

Cases: null counts as empty (0 bytes, 0 tokens); repeated rows are each
returned, equal huge texts are encoded once; an empty table gives no rows; extra
columns are ignored.
"""
from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsight.llm.common import map_batches, materialise, prepare

MEMO_ENTRIES = 600_000
#: Stretches longer than this are encoded but not remembered.
MEMO_CHARS = 64
#: Encodings held at once.
ENCODE_AT_ONCE = 2048
NOT_CUTTABLE = re.compile(r" (?!\S)")
CUT = re.compile(r" (?=\S)")


class Counter:
    """One worker's tokenizer and memo."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = self.tok.get_added_tokens_decoder().values()
        self.margin = 2 + max((len(a.content) for a in added), default=0)
        #: Stretches and splices hold for byte-level BPE whose special strings neither
        #: hold nor swallow white space; other tokenizers encode whole texts.
        self.cuttable = (self.tok.normalizer is None and isinstance(self.tok.pre_tokenizer, pre_tokenizers.ByteLevel)
                         and not self.tok.pre_tokenizer.add_prefix_space and self.tok.pre_tokenizer.use_regex
                         and not any(a.lstrip or a.rstrip or a.single_word or re.search(r"\s", a.content) for a in added))
        self.memo: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(texts), ENCODE_AT_ONCE):
            out += map(len, self.tok.encode_batch_fast(texts[i:i + ENCODE_AT_ONCE], add_special_tokens=False))
        return out

    def count(self, texts: list[str]) -> list[int]:
        if not self.cuttable:
            return [self.lengths([t])[0] for t in texts]
        if len(self.memo) > MEMO_ENTRIES:
            self.memo = {}
        memo, cut, heads, seen = self.memo, [], [], set()
        for t in texts:
            parts = CUT.split(t) if NOT_CUTTABLE.search(t) else t.split(" ")
            heads.append(parts[0])  # no space before it
            del parts[0]
            cut.append(parts)
            seen.update(parts)
        new = [p for p in seen if p not in memo]
        memo.update(zip(new, self.lengths([" " + p for p in new])))
        out = [h + sum(map(memo.__getitem__, parts)) for h, parts in zip(self.lengths(heads), cut)]
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]
        return out

    def boundaries(self, text: str) -> tuple[int, list[tuple[int, int]]]:
        """Tokens of a chunk, and (character, tokens before it) of every pre-token
        start."""
        e = self.tok.encode(text, add_special_tokens=False)
        words, offsets, marks, last = e.word_ids, e.offsets, [], object()
        for i, w in enumerate(words):
            if w is None or w != last:
                marks.append((offsets[i][0], i))
            last = w
        return len(words), marks


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _chunks(big: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Overlapping chunks; equal texts give equal chunks, which meet and collapse
    in the exchange that deals the chunks out."""
    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n = max(1, -(-(len(text) - overlap) // chunk))  # the last chunk is longer than an overlap
            for lo in range(0, n, 64):
                ks = range(lo, min(n, lo + 64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(ks), pa.binary()), pa.array(list(ks), pa.int32()),
                     pa.array([k + 1 == n for k in ks]),
                     pa.array([text[k * chunk:(k + 1) * chunk + overlap] for k in ks], pa.string())],
                    ["key", "no", "final", "part"])
    return map_batches(big.select("key", "text"), cut, "key binary, no int, final boolean, part string") \
        .dropDuplicates(["key", "no"])


def _encode(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Per chunk the pre-token starts (in the text's characters) within the overlap
    with its left and right neighbour, with the tokens before them."""
    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = _counter(path)
        cols = {n: b.column(n).to_pylist() for n in ("key", "no", "final", "part")}
        rows = []
        for key, no, final, part in zip(*cols.values()):
            total, marks = c.boundaries(part)
            at = no * chunk
            safe = len(part) - c.margin
            head = [(at + p, i) for p, i in marks if p <= overlap] if no else [(0, 0)]
            tail = [(at + p, i) for p, i in marks if chunk <= p <= safe] if not final else [(at + len(part), total)]
            rows.append((key, no, final, [p for p, _ in head], [i for _, i in head], [p for p, _ in tail], [i for _, i in tail]))
        names = ["key", "no", "final", "head_at", "head_n", "tail_at", "tail_n"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema(
            [("key", pa.binary()), ("no", pa.int32()), ("final", pa.bool_())]
            + [(n, pa.list_(pa.int64())) for n in names[3:]]))
    arrays = ", ".join(f"{n} array<long>" for n in ("head_at", "head_n", "tail_at", "tail_n"))
    return map_batches(chunks, one, f"key binary, no int, final boolean, {arrays}")


def _spliced(encoded: DataFrame) -> DataFrame:
    """(key, n_tokens): null where some neighbours share no boundary."""
    w = Window.partitionBy("key").orderBy("no")
    e = (encoded.withColumn("in_at", F.when(F.col("no") == 0, F.lit(0).cast("long")).otherwise(
            F.array_min(F.array_intersect("head_at", F.lag("tail_at").over(w)))))
         .withColumn("out_at", F.when(F.col("final"), F.col("tail_at")[0]).otherwise(F.lead("in_at").over(w))))
    def upto(at: str, side: str):
        i = F.array_position(side + "_at", F.col(at)).cast("int")
        return F.when(i > 0, F.get(F.col(side + "_n"), i - 1))
    part = upto("out_at", "tail") - upto("in_at", "head")
    return e.withColumn("part", part).groupBy("key").agg(
        F.when(F.count("*") == F.count("part"), F.sum("part")).alias("n_tokens"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                 limit: int = 1024, chunk_chars: int = 32_768, overlap: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    prepare(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    sel = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(sel.dtypes)["doc_id"]

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = _counter(path)
        texts = ["" if t is None else t for t in b.column(1).to_pylist()]
        big = [c.cuttable and len(t) > chunk_chars for t in texts]
        counts = iter(c.count([t for t, x in zip(texts, big) if not x]))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
             pa.array([None if x else next(counts) for x in big], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).digest() if x else None for t, x in zip(texts, big)], pa.binary()),
             pa.array([t if x else None for t, x in zip(texts, big)], pa.string())],
            ["doc_id", "n_bytes", "n_tokens", "key", "text"])
    rows = materialise(map_batches(sel, one, f"doc_id {kind}, n_bytes long, n_tokens long, key binary, text string"),
                       "tokens")
    big = rows.where("key is not null").select("key", "text")
    done = None
    while True:
        got = materialise(_spliced(_encode(_chunks(big, chunk_chars, overlap), path, chunk_chars, overlap)), "spliced")
        ok = got.where("n_tokens is not null")
        done = ok if done is None else done.unionByName(ok)
        left = got.where("n_tokens is null").select("key")
        if not left.take(1):
            break
        big = big.join(left, "key", "left_semi")
        chunk_chars, overlap = 4 * chunk_chars, 4 * overlap
    small = rows.where("key is null").select("doc_id", "n_bytes", "n_tokens")
    huge = rows.where("key is not null").select("doc_id", "n_bytes", "key").join(done, "key") \
        .select("doc_id", "n_bytes", "n_tokens")
    return small.unionByName(huge).withColumn("over_limit", F.col("n_tokens") > limit)
