"""Keyed event-time state (I2, I9) and the stream-stream merge of verdicts.

`transformWithStateInPandas` keeps, per key, the flows that the watermark has not
passed and what later flows still need of the earlier ones.  A timer at the oldest
waiting flow fires once the watermark passes it: then no earlier flow can come any
more, and all flows up to the watermark are answered in time order.  Flows may thus
come in any order inside the watermark; state is what lies between the watermark less
the window and the newest flow (a sequence keeps its last vectors instead).

`verdict_stream` chains two such stages, by source and by (destination, port), so one
query answers floods, scans and brute force; flows that the second stage does not count
are spread over keys of their own.  `detector.detect_stream` does the same work per
micro-batch with the batch operator, which also splits a single hot source; here a
source's window is one key's state.
"""
from __future__ import annotations

import collections
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowsight import dims
from flowsight.operators import behavior as B

#: Flows without a place in a keyed window are spread over this many keys.
SPREAD = 1024
_WAITING = "us long, id long, value string, payload string"


class InOrder(StatefulProcessor):
    """Holds flows back until the watermark passes them; `answer` sees them in order."""

    tail_schema = "us long, value string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.tail = handle.getListState("tail", self.tail_schema)

    def answer(self, done: list[tuple], tail: list[tuple], until_us: int) -> tuple[list[tuple], list[tuple]]:
        """(output columns of each of the flows `done`, the tail that later flows need)."""
        raise NotImplementedError

    def at_once(self) -> tuple:
        """Output columns of a flow that is not part of any window."""
        raise NotImplementedError

    columns: tuple[str, ...] = ()

    def _frame(self, rows: list[tuple], more: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame({"us": [r[0] for r in rows], "id": [r[1] for r in rows], "payload": [r[3] for r in rows]})
        out.insert(0, "ts", pd.to_datetime(out["us"], unit="us"))
        for i, c in enumerate(self.columns):
            out[c] = pd.Series([m[i] for m in more], dtype=object)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, outside = [], []
        for pdf in rows:
            for r in pdf[["us", "id", "value", "payload", "counted"]].itertuples(index=False):
                (new if r.counted else outside).append((int(r.us), int(r.id), r.value, r.payload))
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[0] for r in new))
        if outside:
            yield self._frame(outside, [self.at_once()] * len(outside))

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))  # the first watermark, in ms, that passes it

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()]
        done = sorted(r for r in held if r[0] <= until)
        rest = [r for r in held if r[0] > until]
        if not done:
            return
        more, tail = self.answer(done, [tuple(r) for r in self.tail.get()], until)
        for state, left in ((self.waiting, rest), (self.tail, tail)):
            if left:
                state.put(left)
            else:
                state.clear()
        if rest:
            self._wake(min(r[0] for r in rest))
        yield self._frame(done, more)

    def close(self) -> None:
        pass


class WindowCounts(InOrder):
    """Flows, and different values, in (t - window, t] of every flow; flows at the same
    time are all counted."""

    columns = ("n", "n_distinct")

    def __init__(self, window_us: int):
        self.window_us = window_us

    def at_once(self) -> tuple:
        return None, None

    def answer(self, done, tail, until_us):
        seen = sorted([(r[0], r[2]) for r in done] + tail)
        us = np.array([s[0] for s in seen], np.int64)
        at = np.array([r[0] for r in done], np.int64)
        first, upto = np.searchsorted(us, at - self.window_us, "right"), np.searchsorted(us, at, "right")
        inside: collections.Counter = collections.Counter()
        a = b = 0
        out = []
        for lo, hi in zip(first.tolist(), upto.tolist()):  # both only grow
            for i in range(b, hi):
                inside[seen[i][1]] += 1
            for i in range(a, lo):
                inside[seen[i][1]] -= 1
                if not inside[seen[i][1]]:
                    del inside[seen[i][1]]
            a, b = lo, hi
            out.append((hi - lo, len(inside)))
        return out, [s for s in seen if s[0] > until_us - self.window_us]


class LastVectors(InOrder):
    """The last n vectors (JSON arrays) up to every flow, without padding."""

    columns = ("history",)
    tail_schema = "us long, id long, value string"

    def __init__(self, n: int):
        self.n = n

    def at_once(self) -> tuple:
        return (None,)

    def answer(self, done, tail, until_us):
        past = [t[2] for t in sorted(tail)] + [r[2] for r in done]
        skip = len(tail)
        out = [("[" + ",".join(past[max(0, skip + i + 1 - self.n):skip + i + 1]) + "]",) for i in range(len(done))]
        keep = (sorted(tail) + [r[:3] for r in done])[-(self.n - 1):] if self.n > 1 else []
        return out, keep


def _packed(df: DataFrame, key: F.Column, value: F.Column, counted: F.Column) -> DataFrame:
    """ts, us, id (-1 where null; it only orders), key, value, counted and all columns but ts
    as JSON."""
    keep = [c for c in df.columns if c != "ts"]
    return df.select("ts", F.unix_micros("ts").alias("us"), F.coalesce("id", F.lit(-1)).alias("id"), key.alias("key"), value.alias("value"), counted.alias("counted"),
                     F.to_json(F.struct(*keep)).alias("payload"))


def _stage(df: DataFrame, processor: InOrder, columns: str) -> DataFrame:
    schema = f"ts timestamp, us long, id long, payload string, {columns}"
    return df.groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts")


def verdict_stream(stream: DataFrame, watermark: str = "30 seconds", secs: float = dims.WINDOW_SECONDS,
                   flood: int = dims.FLOOD_THRESHOLD, scan: int = dims.SCAN_THRESHOLD, brute: int = dims.BRUTE_THRESHOLD,
                   local_ips=()) -> DataFrame:
    """Every flow once the watermark has passed it, with the counts and the verdict
    that the batch operator `behavioral_verdict` gives it.  Flows later than the watermark
    are dropped."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields if f.name != "ts")
    window = int(secs * 1_000_000)
    live = ~B.safe_flow(local_ips=local_ips)
    spread = F.concat(F.lit("#"), F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("string"))
    x = _packed(stream.withWatermark("ts", watermark), F.when(live, F.concat(F.lit("="), "src_ip")).otherwise(spread),
                F.col("dst_ip"), live)
    x = _stage(x, WindowCounts(window), "n long, n_distinct long")
    row = F.from_json("payload", kinds)
    auth = F.col("n").isNotNull() & row["dst_port"].isin(*dims.AUTH_PORTS)
    x = x.select("ts", "us", "id", F.lit("").alias("value"), F.coalesce(auth, F.lit(False)).alias("counted"),
                 F.to_json(F.struct(F.col("payload").alias("row"), F.col("n").alias("src_rate"), F.col("n_distinct").alias("src_fanout")))
                 .alias("payload"),
                 F.when(auth, F.concat_ws(":", row["dst_ip"], row["dst_port"])).otherwise(spread).alias("key"))
    x = _stage(x, WindowCounts(window), "n long, n_distinct long")
    counts = F.from_json("payload", "row string, src_rate long, src_fanout long")
    x = x.select("ts", counts.alias("c"), F.col("n").alias("auth_count")).select(
        "ts", F.from_json("c.row", kinds).alias("r"), "c.src_rate", "c.src_fanout", "auth_count")
    return B.rules(x.select("ts", "r.*", "src_rate", "src_fanout", "auth_count"), secs, flood, scan, brute)


def sequence_stream(stream: DataFrame, cols: list[str], n: int = 20, watermark: str = "30 seconds") -> DataFrame:
    """Id, src and the last n feature vectors of each flow's source in time order,
    left-padded with zero vectors, as the batch operator `padded_sequence` gives them."""
    vector = F.to_json(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]))
    x = _packed(stream.withWatermark("ts", watermark), F.col("src_ip"), vector, F.lit(True))
    x = _stage(x, LastVectors(n), "history string")
    past = F.from_json("history", "array<array<double>>")
    zero = F.array(*[F.lit(0.0) for _ in cols])
    return x.select(F.get_json_object("payload", "$.id").cast("long").alias("id"), F.get_json_object("payload", "$.src_ip").alias("src"),
                    F.concat(F.array_repeat(zero, F.lit(n) - F.size(past)), past).alias("padded"))


def merge_streams(flows: DataFrame, verdicts: DataFrame, watermark: str = "30 seconds") -> DataFrame:
    """I5/C12 on streams: flows with the verdict of the same id and time, where one comes
    within the watermark, and the override (H20); a flow without one is put out, once, when
    the watermark has passed it.  verdicts: id, ts, behavioral_attack,
    behavioral_confidence, behavioral_reason."""
    v = verdicts.withWatermark("ts", watermark).select(
        F.col("id").alias("_id"), F.col("ts").alias("_ts"), "behavioral_attack", "behavioral_confidence", "behavioral_reason")
    f = flows.withWatermark("ts", watermark)
    both = f.join(v, (F.col("id") == F.col("_id")) & (F.col("ts") == F.col("_ts")), "left").drop("_id", "_ts")
    return B.behavioral_override(both.fillna({"behavioral_confidence": 0.0, "behavioral_reason": ""}))
