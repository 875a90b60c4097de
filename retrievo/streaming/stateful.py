"""Streams with keyed state and event-time timers: lifetimes of stored entries, alerts, request quotas.

State lives in Spark's state store and is removed by a timer once the watermark has passed it. An alert has one value for
each label set. Lifetimes and quotas have many keys with few rows each, so ``SHARDS`` shards of keys hold one value each, a
small table by key, and a task works on the columns of all rows of a shard. The rows of a shard in one micro-batch are put
in order of key and time in a task; a micro-batch bounds them. Rows of later micro-batches come after, whatever their time. Spark drops rows behind the watermark: ``telemetry.split_late`` ahead of
these streams keeps them in a table of their own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from retrievo.operators import telemetry
from retrievo.streaming.sinks import drain

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed state needs; the setting before is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def drain_stateful(stream: DataFrame, sink, checkpoint: str):
    """``drain`` for a stream with keyed state."""
    with keyed_state(stream.sparkSession):
        return drain(stream, sink, checkpoint)


def on_time_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that ``telemetry.split_late`` has written to ``path/on_time``, as a stream.

    With the same delay as watermark no row of it is behind the watermark, so nothing is dropped: each row is either in
    this stream or in ``path/late``.
    """
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/on_time")


def _micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _one(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order, kind="stable", ignore_index=True)


def _frame(**columns) -> pd.DataFrame:
    """Columns as Python objects where they hold text or may be null."""
    return pd.DataFrame({k: c if isinstance(c, (pd.Series, np.ndarray)) else pd.Series(c, dtype=object)
                         for k, c in columns.items()})


SHARDS = 256  # keys that share a hash share a state value


def _shard(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SHARDS))


def _packed(table: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    held = pa.Table.from_pandas(table, preserve_index=False)
    with pa.ipc.new_stream(out, held.schema) as writer:
        writer.write_table(held)
    return out.getvalue().to_pybytes()


def _unpacked(state) -> pd.DataFrame | None:
    return pa.ipc.open_stream(bytes(state.get()[0])).read_all().to_pandas() if state.exists() else None


class _Lifetimes(StatefulProcessor):
    """State: when the stored entries of a kind's shard of keys end, in microseconds."""

    def __init__(self, lifetimes_s: dict[str, int]):
        self.lifetimes = {k: s * 1_000_000 for k, s in lifetimes_s.items()}

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "entries binary, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = _one(rows, ["key", "at", "request_id"])
        life, hit = self.lifetimes.get(key[0]), np.zeros(len(asked), bool)
        if life is not None:
            code, names = pd.factorize(asked["key"], use_na_sentinel=False)  # numbered as they come, which is sorted
            ends = np.searchsorted(code, np.arange(len(names)), side="right").tolist()
            held = _unpacked(self.held)
            stored = {} if held is None else dict(zip(held["key"].tolist(), held["until"].tolist()))
            at, i = asked["at"].tolist(), 0
            for name, end in zip(names.tolist(), ends):
                name = name if isinstance(name, str) else None
                until = stored.get(name)
                while i < end:
                    if until is not None and at[i] < until:  # a hit leaves the entry as it is
                        to = bisect_left(at, until, i, end)
                        hit[i:to] = True
                        i = to
                    else:                                    # a miss stores one
                        until, i = at[i] + life, i + 1
                stored[name] = until
            self._keep(stored, None if held is None else self.held.get()[1], timerValues)
        yield _frame(request_id=asked["request_id"], kind=[key[0]] * len(asked), key=asked["key"], hit=hit)

    def _keep(self, stored: dict, before: int | None, timerValues) -> None:
        """The entries that a row may still meet; the timer stands at the last one's end."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        stored = {k: u for k, u in stored.items() if u > passed}
        last = max(stored.values(), default=None)
        if before is not None and before != last:
            self.handle.deleteTimer(-(-before // 1000))
        if last is None:
            self.held.clear()
            return
        names = pd.Series(list(stored), dtype=object)
        self.held.update((_packed(pd.DataFrame({"key": names, "until": list(stored.values())})), last))
        if before != last:
            self.handle.registerTimer(-(-last // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def lifetimes_stream(requests: DataFrame, lifetimes_s: dict[str, int], watermark: str = "10 minutes") -> DataFrame:
    """``requests`` (request_id, kind, key, ts) with ``hit``: whether the kind's entry for the key is stored and lives.

    A miss stores an entry for the kind's lifetime, a hit does not renew it. Kinds without a lifetime are never stored.
    """
    rows = requests.withWatermark("ts", watermark).select(
        F.col("request_id").cast("long").alias("request_id"), F.col("kind").cast("string").alias("kind"),
        F.col("key").cast("string").alias("key"), "ts", _micros().alias("at"))
    return rows.withColumn("shard", _shard("key")).groupBy("kind", "shard").transformWithStateInPandas(
        _Lifetimes(lifetimes_s), "request_id long, kind string, key string, hit boolean", "append", "eventTime")


_SPAN = ("state string, at_us long, started_us long, last_us long, peak double, held_seconds long, fired boolean")
_SPAN_COLUMNS = [c.split()[0] for c in _SPAN.split(", ")]


class _Alerts(StatefulProcessor):
    """State: the open span of a label set. pending -> firing once held for long enough -> resolved."""

    def __init__(self, limit: float, step_s: int, hold_s: int):
        self.limit, self.step, self.hold = limit, step_s * 1_000_000, hold_s * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "started long, last long, peak double, firing boolean")

    def _event(self, state: str, at: int, span) -> dict:
        started, last, peak, firing = span
        return dict(zip(_SPAN_COLUMNS, (state, at, started, last, peak, (last - started) // 1_000_000, firing)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        points = _one(rows, ["at_us"])
        before = span = tuple(self.span.get()) if self.span.exists() else None
        events = []
        for at, value in zip(points["at_us"].tolist(), points["value"].tolist()):
            if span and at > span[1] + self.step:  # a point is missing
                events.append(self._event("resolved", span[1] + self.step, span))
                span = None
            if value is None or not value > self.limit:
                if span:
                    events.append(self._event("resolved", at, span))
                span = None
                continue
            opened = span is None
            span = (at, at, value, False) if opened else (span[0], at, max(span[2], value), span[3])
            if opened:
                events.append(self._event("pending", at, span))
            if not span[3] and at - span[0] >= self.hold:
                span = (*span[:3], True)
                events.append(self._event("firing", at, span))
        if span != before:
            if before:
                self.handle.deleteTimer(self._ends(before))
            if span:
                self.span.update(span)
                self.handle.registerTimer(self._ends(span))
            else:
                self.span.clear()
        if events:
            yield self._frame(key, events)

    def _frame(self, key, events) -> pd.DataFrame:
        return _frame(**{f"_{i}": [k] * len(events) for i, k in enumerate(key)},
                      **{c: [e[c] for e in events] for c in _SPAN_COLUMNS})

    def _ends(self, span) -> int:
        """The millisecond at which the next point is missing; points of a window are known a step later."""
        return (span[1] + 2 * self.step) // 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.span.exists():
            span = tuple(self.span.get())
            self.span.clear()
            yield self._frame(key, [self._event("resolved", span[1] + self.step, span)])

    def close(self) -> None:
        pass


def alert_stream(points: DataFrame, limit: float, step_seconds: int, hold_seconds: int, labels: Sequence[str] = (),
                 value: str = "ratio") -> DataFrame:
    """Transitions of alerts: labels, ``state`` (pending, firing, resolved), at, started_at, last_at, peak,
    held_seconds, fired.

    ``points`` has one row for each label set and evaluation time ``at``, and an ``event_time`` that carries a watermark,
    as ``ratio_points`` gives them. A span opens at the first point above the limit, fires at the point at which it
    has held for ``hold_seconds``, and is resolved by a point not above the limit or, by a timer, by a missing one.
    """
    keys = [F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(labels)] or [F.lit("").alias("_0")]
    rows = points.select(*keys, "event_time", _micros("at").alias("at_us"), F.col(value).cast("double").alias("value"))
    names = [f"_{i}" for i in range(len(keys))]
    out = rows.groupBy(*names).transformWithStateInPandas(
        _Alerts(limit, step_seconds, hold_seconds), ", ".join(f"{k} string" for k in names) + ", " + _SPAN,
        "append", "eventTime")
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(labels)], "state",
                      F.timestamp_micros("at_us").alias("at"), F.timestamp_micros("started_us").alias("started_at"),
                      F.timestamp_micros("last_us").alias("last_at"), "peak", "held_seconds", "fired")


def ratio_points(events: DataFrame, numerator: Column, window: str, slide: str, seconds: float,
                 labels: Sequence[str] = (), watermark: str = "10 minutes") -> DataFrame:
    """``telemetry.windowed_ratio`` in append mode: a window's row comes once the watermark has passed its end.

    ``at`` is the window's end; ``event_time``, a microsecond before, is what later operators can follow.
    """
    counted = telemetry.ratio(events.withWatermark("ts", watermark).withColumn("_num", numerator), F.col("_num"),
                              [F.window("ts", window, slide).alias("_w"), *labels], seconds)
    return counted.select(F.window_time("_w").alias("event_time"), F.col("_w.end").alias("at"), *labels, "ratio")


GROUP_BUCKETS = 16  # neighbouring buckets of a shard of identities that share a state value


class _Quotas(StatefulProcessor):
    """State: requests and tokens of each open bucket of a shard's identities; removed when the watermark passes the
    group of buckets."""

    def __init__(self, limit, window_s, per_min, per_request, max_chars, overhead, keep_s, sized):
        self.limit, self.window, self.per_min, self.per_request = limit, window_s, per_min, per_request
        self.max_chars, self.overhead, self.keep, self.sized = max_chars, max(1, overhead), keep_s, sized

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "counters binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = _one(rows, ["identity", "bucket", "at", "request_id"])
        code, _ = pd.factorize(asked["identity"], use_na_sentinel=False)
        bucket, chars = asked["bucket"].to_numpy(), asked["chars"].astype(np.int64).to_numpy()
        first = np.append(True, (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1]))
        group, starts = np.cumsum(first) - 1, np.flatnonzero(first)
        counters = asked.loc[starts, ["identity", "bucket"]].reset_index(drop=True)
        held = _unpacked(self.open)
        if held is None:
            ends = (int(key[1]) + 1) * GROUP_BUCKETS * self.window + self.keep
            self.handle.registerTimer(ends * 1000)
            before = np.zeros((2, len(counters)), np.int64)
        else:
            met = counters.merge(held, "left", ["identity", "bucket"])  # one row for each pair: nulls meet nulls
            before = met[["n", "used"]].fillna(0).to_numpy(np.int64).T

        def running(step, so_far):
            total = np.cumsum(step)
            return total - (total - step)[starts][group] + so_far[group]

        tokens = self.overhead + chars if self.sized else np.zeros(len(asked), np.int64)
        counted = chars <= self.max_chars if self.sized else np.ones(len(asked), bool)
        n = running(counted.astype(np.int64), before[0])
        over = counted & (n > self.limit)
        costly = counted & ~over & (tokens > self.per_request) & self.sized
        used = running(np.where(counted & ~over & ~costly, tokens, 0), before[1])
        spent = (used > self.per_min) & self.sized
        decision = np.select([~counted, over, costly, spent], ["request_too_large", "rate_limit_exceeded",
                             "request_cost_limit_exceeded", "cost_budget_exceeded"], "allowed").astype(object)
        last = np.append(starts[1:], len(asked)) - 1
        counters = counters.assign(n=n[last], used=used[last])
        if held is not None:
            counters = pd.concat([counters, held]).drop_duplicates(["identity", "bucket"])
        self.open.update((_packed(counters),))
        yield _frame(request_id=asked["request_id"], identity=asked["identity"], bucket=asked["bucket"],
                     tokens=tokens, decision=decision, left=asked["left"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        yield from ()

    def close(self) -> None:
        pass


def quota_stream(requests: DataFrame, identity: str, request: str = "event_id", text_length: Column | None = None,
                 limit: int = 30, window_s: int = 60, per_min: int = 12_000, per_request: int = 4_000,
                 max_chars: int = 12_000, overhead: int = 256, keep_s: int = 600) -> DataFrame:
    """Decisions on the requests of a stream: request_id, identity, bucket, tokens, decision, retry_after.

    The checks and their order are those of ``telemetry.token_budget``; without ``text_length`` only the request rate is
    checked. Counters of a bucket are kept until the watermark, ``keep_s`` behind the newest request, has passed its
    group of buckets, so a request that Spark still lets through always meets them and no decision is read again.
    """
    marked = telemetry.bucketed(requests.withWatermark("ts", f"{keep_s} seconds"), window_s)
    rows = marked.select(
        F.col(identity).cast("string").alias("identity"), F.floor(F.col("bucket") / GROUP_BUCKETS).alias("group"), "ts",
        _micros().alias("at"), F.col(request).cast("long").alias("request_id"), "bucket",
        F.col("retry_after").cast("long").alias("left"),
        (F.lit(0) if text_length is None else F.ceil(text_length)).cast("long").alias("chars"))
    out = rows.withColumn("shard", _shard("identity")).groupBy("shard", "group").transformWithStateInPandas(
        _Quotas(limit, window_s, per_min, per_request, max_chars, overhead, keep_s, text_length is not None),
        "request_id long, identity string, bucket long, tokens long, decision string, left long", "append", "eventTime")
    smaller = F.col("decision").isin("request_too_large", "request_cost_limit_exceeded")
    return out.withColumn("retry_after", F.when(F.col("decision") == "allowed", None).when(smaller, 0)
                          .otherwise(F.col("left"))).drop("left")
