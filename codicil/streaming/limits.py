"""Rate limits: a sliding log for each client, and one for everyone.

The limit of a client is keyed state and runs on any number of tasks, as a batch or a stream. The total is a limit over everyone, so its decisions follow each
other by nature. Tables of more than RUN requests are sorted into runs, a task each. What a run needs of those before it is what still counts at their end: one pass finds that, run after
run where a log goes on, and then all runs are decided at once.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

from codicil.sources.temporary import shared_folder

WINDOW_MS = 60_000
#: Clients whose logs are held before those that no longer count are dropped.
SWEEP = 10_000
#: Requests that one task sorts and decides, about.
RUN = 500_000


class Log:
    """The times of the requests that were let through and still count: those later than now - window."""

    def __init__(self, limit: int, window: int = WINDOW_MS, times: list[int] | None = None):
        if limit < 0:
            raise ValueError(f"limit must be a whole number from 0, got {limit}")
        self.limit, self.window, self.times = limit, window, deque(times or ())

    def wait(self, now: int) -> int:
        """Milliseconds until a request would be let through; 0: at once. A limit of 0 lets everything through."""
        if not self.limit:
            return 0
        while self.times and self.times[0] <= now - self.window:
            self.times.popleft()
        return self.times[-self.limit] + self.window - now if len(self.times) >= self.limit else 0

    def take(self, now: int) -> None:
        if self.limit:
            self.times.append(now)


class OneByOne:
    """The decisions for requests that come client by client, each client by itself: holds the log of the client at hand."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window, self.client, self.log = limit, window, None, Log(limit, window)

    def _log(self, client: str | None) -> Log:
        if client != self.client:
            self.client, self.log = client, Log(self.limit, self.window)
        return self.log

    def decide(self, client: str | None, ms: int) -> tuple[bool, str | None, int]:
        wait = self._log(client).wait(ms)
        if wait:
            return False, "client", wait
        self.log.take(ms)
        return True, None, 0

    def take(self, client: str | None, ms: int) -> None:
        self._log(client).take(ms)

    def held(self, now: int) -> list[tuple[str | None, int]]:
        return [(self.client, t) for t in self.log.times if t > now - self.window]


def _values(column: pa.Array) -> list:
    """to_pylist by way of numpy, which takes a tenth of the time."""
    return column.to_pylist() if column.null_count and pa.types.is_integer(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def _decided(requests: DataFrame, by: list[str], deciding: Callable[[], OneByOne | TwoLevels]) -> DataFrame:
    """requests (id, client, ms) in the order of ``by`` with what deciding().decide says of each in turn: admitted, limit and retry_after_ms. A task sorts about RUN of them
    and holds the logs."""

    def turns(batch: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*(_values(batch.column(c)) for c in ("run", "held", "client", "ms")))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = one = None
        for batch in batches:
            said = []
            for r, held, client, ms in turns(batch):
                if r != run:
                    run, one = r, deciding()
                if held:
                    one.take(client, ms)
                else:
                    said.append(one.decide(client, ms))
            asked = batch.filter(pc.invert(batch.column("held"))).select(["id", "client", "ms"])
            extra = [pa.array([x[i] for x in said], kind) for i, kind in enumerate((pa.bool_(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*asked.columns, *extra], [*asked.schema.names, "admitted", "limit", "retry_after_ms"])

    rows = requests.select(F.col("id").cast("long").alias("id"), F.col("client").cast("string").alias("client"), F.col("ms").cast("long").alias("ms"))
    runs = math.ceil(rows.count() / RUN)
    if runs < 2:
        spread = (rows.repartition("client") if by[0] == "client" else rows.coalesce(1)).select("*", F.lit(0).alias("run"), F.lit(False).alias("held"))
    else:
        spread = _in_runs(rows, by, deciding, turns, runs).repartitionById(runs, "run")
    return spread.sortWithinPartitions("run", F.desc("held"), *by).mapInArrow(decided, "id long, client string, ms long, admitted boolean, limit string, retry_after_ms long")


def _in_runs(rows: DataFrame, by: list[str], deciding: Callable[[], OneByOne | TwoLevels], turns: Callable[[pa.RecordBatch], Iterator[tuple]], runs: int) -> DataFrame:
    """rows with the number of their run; beside them, marked as held, what was let through in earlier runs and still counts as a run begins. Both are tables under spark.checkpoint.dir.

    With ``by`` client first, a run leaves the log of its last client, which is known at once unless that client fills the run. The log of everyone goes on from each run to the
    next, so they are taken one after another; requests that the total shuts out are passed over."""
    spark, path, own = rows.sparkSession, shared_folder(rows.sparkSession), by[0] == "client"
    rows.repartitionByRange(runs, *by).withColumn("run", F.spark_partition_id()).write.partitionBy("run").parquet(f"{path}/rows")
    table = spark.read.schema("id long, client string, ms long, run int").parquet(f"{path}/rows").withColumn("held", F.lit(False))
    key = F.xxhash64("client") if own else F.lit(0)
    found = table.groupBy("run").agg((F.min(key) == F.max(key)).alias("one")).orderBy("run").collect()
    follows = {a.run: b.run for a, b in zip(found, found[1:])}
    needs = {b.run: a.run for a, b in zip(found, found[1:]) if b.one}

    fields = pa.schema([("id", pa.int64()), ("client", pa.string()), ("ms", pa.int64()), ("run", pa.int32()), ("held", pa.bool_())])

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = one = shut = last = None

        def end() -> pa.RecordBatch:
            kept = one.held(last) if one else []
            return pa.RecordBatch.from_pylist([{"client": c, "ms": t, "run": follows[run], "held": True} for c, t in kept], fields)

        for batch in batches:
            for r, held, client, ms in turns(batch):
                if r != run:
                    yield end()
                    run, one, shut = r, deciding(), None
                last = ms
                if held:
                    one.take(client, ms)
                elif shut is None or ms >= shut:
                    _, limit, wait = one.decide(client, ms)
                    shut = ms + wait if limit == "total" else None
        yield end()

    kind = "id long, client string, ms long, run int, held boolean"
    known = lambda *paths: spark.read.schema(kind).parquet(*paths)
    todo, paths = set(follows), []
    while todo:
        now = [r for r in todo if needs.get(r) not in todo]
        given = table.where(F.col("run").isin(now))
        if paths:
            given = given.unionByName(known(paths[-1]).where(F.col("run").isin(now)))
        paths.append(f"{path}/held-{len(paths)}")
        dealt = given.repartitionById(runs, "run") if len(now) > 1 else given.coalesce(1)
        dealt.sortWithinPartitions("run", F.desc("held"), *by).mapInArrow(left, kind).write.parquet(paths[-1])
        todo -= set(now)
    return table.unionByName(known(*paths)) if paths else table


def client_admissions(requests: DataFrame, limit: int, window: int = WINDOW_MS) -> DataFrame:
    """requests (id, client, ms) with admitted and retry_after_ms, each client by itself, in the order of ms, then id. A task holds a log of at most ``limit`` times; the
    requests of a client may fill several runs."""
    return _decided(requests, ["client", "ms", "id"], lambda: OneByOne(limit, window)).drop("limit")


class TwoLevels:
    """The decisions for everyone: a client's limit first, then the total; a request counts only when it is let through, for both limits."""

    def __init__(self, per_client: int, total: int, window: int, everyone: list[int] | None = None, clients: dict[str, list[int]] | None = None):
        self.per_client, self.window, self.everyone = per_client, window, Log(total, window, everyone)
        self.clients = {c: Log(per_client, window, times) for c, times in (clients or {}).items()}

    def decide(self, client: str, ms: int) -> tuple[bool, str | None, int]:
        if len(self.clients) >= SWEEP:
            self.sweep(ms)
        own = self.clients.setdefault(client, Log(self.per_client, self.window))
        wait, which = own.wait(ms), "client"
        if not wait:
            wait, which = self.everyone.wait(ms), "total"
        if wait:
            return False, which, wait
        own.take(ms)
        self.everyone.take(ms)
        return True, None, 0

    def take(self, client: str, ms: int) -> None:
        self.clients.setdefault(client, Log(self.per_client, self.window)).take(ms)
        self.everyone.take(ms)

    def held(self, now: int) -> list[tuple[str | None, int]]:
        """The requests let through that still count: at most the total of them."""
        if not self.per_client:
            return [(None, t) for t in self.everyone.times if t > now - self.window]
        return [(c, t) for c, log in self.clients.items() for t in log.times if t > now - self.window]

    def sweep(self, now: int) -> None:
        """Forgets the clients none of whose requests counts any more."""
        self.clients = {c: log for c, log in self.clients.items() if log.times and log.times[-1] > now - self.window}


def admissions(requests: DataFrame, per_client: int, total: int, window: int = WINDOW_MS) -> DataFrame:
    """requests with admitted, limit (client or total: the one reached) and retry_after_ms, in the order of ms, then id: one sequence for everyone, taken in runs. A task holds
    the times that still count, ``total`` at most. Without a total (0), each client is by itself."""
    if not total:
        return _decided(requests, ["client", "ms", "id"], lambda: OneByOne(per_client, window))
    return _decided(requests, ["ms", "id"], lambda: TwoLevels(per_client, total, window))


class TotalLimiter(StatefulProcessor):
    """Both limits on a stream, in the order of the micro-batches: one key for everyone, with the total's log as a list and each client's as a map entry."""

    def __init__(self, per_client: int, total: int, window: int = WINDOW_MS):
        self.per_client, self.total, self.window = per_client, total, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        times = T.StructType([T.StructField("ms", T.LongType())])
        self.everyone = handle.getListState("everyone", times)
        self.clients = handle.getMapState("clients", T.StructType([T.StructField("client", T.StringType())]), T.StructType([T.StructField("times", T.ArrayType(T.LongType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ms", "id"])
        asked = pdf.client.tolist()
        before = {c: list(self.clients.getValue((c,))[0]) for c in set(asked) if self.clients.containsKey((c,))}
        levels = TwoLevels(self.per_client, self.total, self.window, [r[0] for r in self.everyone.get()], before)
        said = [levels.decide(c, ms) for c, ms in zip(asked, pdf.ms.tolist())]
        self.everyone.put([(int(t),) for t in levels.everyone.times]) if levels.everyone.times else self.everyone.clear()
        for c in set(asked):
            log = levels.clients.get(c)
            if log and log.times:
                self.clients.updateValue((c,), ([int(t) for t in log.times],))
            elif c in before:
                self.clients.removeKey((c,))
        yield pd.DataFrame({"id": pdf.id, "client": pdf.client, "ms": pdf.ms, "admitted": [x[0] for x in said], "limit": [x[1] for x in said], "retry_after_ms": [x[2] for x in said]})

    def close(self) -> None:
        pass


def admitted_stream(requests: DataFrame, per_client: int, total: int, window: int = WINDOW_MS) -> DataFrame:
    """admissions for a stream of requests (id, client, ms): the same decisions as long as no micro-batch holds a request older than one of a batch before. Needs the RocksDB state store.
    One key, so one task, by nature: every decision depends on all before it."""
    rows = requests.select(F.col("id").cast("long").alias("id"), F.col("client").cast("string").alias("client"), F.col("ms").cast("long").alias("ms"), F.lit(0).alias("all"))
    return rows.groupBy("all").transformWithStateInPandas(
        statefulProcessor=TotalLimiter(per_client, total, window), outputStructType="id long, client string, ms long, admitted boolean, limit string, retry_after_ms long", outputMode="append", timeMode="None",
    )


class ClientLimiter(StatefulProcessor):
    """The limit of a client on a stream: the log is kept as list state; with ``expire`` it ends by itself once a client is quiet."""

    def __init__(self, limit: int, window: int = WINDOW_MS, expire: bool = True):
        self.limit, self.window, self.expire = limit, window, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("times", T.StructType([T.StructField("ms", T.LongType())]), ttlDurationMs=10 * self.window if self.expire else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        log = Log(self.limit, self.window, [r[0] for r in self.state.get()])
        pdf = pd.concat(list(rows)).sort_values(["ms", "id"])
        out = []
        for ms in pdf.ms.tolist():
            wait = log.wait(ms)
            if not wait:
                log.take(ms)
            out.append(wait)
        self.state.put([(int(t),) for t in log.times]) if log.times else self.state.clear()
        yield pd.DataFrame({"id": pdf.id, "client": key[0], "ms": pdf.ms, "admitted": [w == 0 for w in out], "retry_after_ms": out})

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, limit: int, window: int = WINDOW_MS, expire: bool = True) -> DataFrame:
    """client_admissions for a stream of requests (id, client, ms). Needs the RocksDB state store. With ``expire`` the stream goes by the clock and
    makes batches without data, so it ends only when it is stopped; without, the log of a client who never comes back (at most ``limit`` times) stays."""
    rows = requests.select(F.col("id").cast("long").alias("id"), F.col("client").cast("string").alias("client"), F.col("ms").cast("long").alias("ms"))
    return rows.groupBy("client").transformWithStateInPandas(
        statefulProcessor=ClientLimiter(limit, window, expire), outputStructType="id long, client string, ms long, admitted boolean, retry_after_ms long", outputMode="append", timeMode="ProcessingTime" if expire else "None",
    )
