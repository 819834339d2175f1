"""Python stages: a run of them is one pass over Arrow batches, so that each callable runs once for each item."""

from __future__ import annotations

import asyncio
import select
import selectors
import sys
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from queue import SimpleQueue
from threading import Thread

import pyarrow as pa
from pyspark.sql.types import StructType

from rillflow.config import PipelineConfig
from rillflow.operators import AsyncMap, Expand, FenceStage, Filter, Map, Stage, TryMap

#: Rows of the batches that go back.
ROWS_OUT = 2048
#: Items that the event loop is given at a time, batches that may wait for their last call, seconds between two switches of threads.
HAND_OVER, MOST_WAITING, SWITCH_S = 16, 4, 0.0005
#: Items that wait for a call to end, at most; shorter waits are timed finely, where the number of a file allows it.
MOST_AHEAD, TIMELY_S, MOST_FILENO = 256, 0.01, 1024
#: One item on its way: its input index, its error as (kind, msg) or None, its value.
Item = tuple[object, tuple[str, str] | None, object]


def batches_of(items: Iterator, size: int) -> Iterator[list]:
    while batch := list(islice(items, size)):
        yield batch


def mapped(items: Iterator[Item], f: Callable, fallible: bool, threads: int) -> Iterator[Item]:
    def one(item: Item) -> Item:
        seq, err, value = item
        if err is not None:
            return item
        if not fallible:
            return seq, None, f(value)
        try:
            return seq, None, f(value)
        except Exception as e:  # noqa: BLE001  any failure of the callable is the item's error
            return seq, (type(e).__name__, str(e)), None

    if threads == 1:
        yield from map(one, items)
    else:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches_of(items, 32 * threads):
                parts = [batch[k : k + 8] for k in range(0, len(batch), 8)]
                for done in pool.map(lambda part: [one(item) for item in part], parts):
                    yield from done


class Timely(selectors.DefaultSelector):
    """Waits no longer than it is told to: epoll counts in whole milliseconds, which a call that takes one waits up to twice."""

    def select(self, timeout: float | None = None) -> list:
        if timeout is not None and 0 < timeout < TIMELY_S and hasattr(self, "fileno") and self.fileno() < MOST_FILENO:
            select.select([self.fileno()], [], [], timeout)
            timeout = 0
        return super().select(timeout)


def awaited(items: Iterator[Item], f: Callable, in_flight: int, timeout: float | None = None, retries: int = 0, full: Callable[[], bool] = lambda: False) -> Iterator[Item]:
    """Results in the order in which calls end, with at most in_flight calls running at any time.

    Calls run in an event loop on a thread of its own, which goes on while items are fetched and results are used, so that a
    slow call holds back nothing but itself. As many items as may run, MOST_AHEAD at most, wait beside them, so that the loop begins
    the next call when one ends and no thread waits for the other. A call that fails, or takes longer than timeout seconds, is made
    again up to retries times. No item is taken while `full` says so. The interpreter switches between the two threads more often meanwhile.
    """
    items, loop, ended, running, held, ready = iter(items), asyncio.SelectorEventLoop(Timely()), SimpleQueue(), 0, set(), deque()
    most, stopped = in_flight + min(in_flight, MOST_AHEAD), False

    async def one(item: Item) -> None:
        for left in range(retries, -1, -1):
            try:
                value = await (f(item[2]) if timeout is None else asyncio.wait_for(f(item[2]), timeout))
            except BaseException as e:  # noqa: BLE001  raised where results are taken
                if stopped:
                    raise
                if not left or not isinstance(e, Exception):
                    ended.put((item, e))
                    return
            else:
                ended.put(((item[0], None, value), None))
                return

    def begin() -> None:
        while ready and len(held) < in_flight and not stopped:
            held.add(task := asyncio.Task(one(ready.popleft()), loop=loop, eager_start=True))
            task.add_done_callback(next_one)

    def next_one(task: asyncio.Task) -> None:
        held.discard(task)
        begin()

    async def stop() -> None:
        for task in (left := list(held)):
            task.cancel()
        await asyncio.gather(*left, return_exceptions=True)
        loop.stop()

    def taken() -> Item:
        item, failure = ended.get()
        if failure is not None:
            raise failure
        return item

    thread, interval, more = Thread(target=loop.run_forever, daemon=True), sys.getswitchinterval(), True
    thread.start()
    sys.setswitchinterval(SWITCH_S)
    try:
        while more or running:
            while more and running < most and not full():
                batch = list(islice(items, min(HAND_OVER, most - running)))
                more = bool(batch)
                calls = [item for item in batch if item[1] is None]
                running += len(calls)
                ready.extend(calls)
                if len(held) < in_flight:  # else the next call to end begins one of them
                    loop.call_soon_threadsafe(begin)
                yield from (item for item in batch if item[1] is not None)
                while not ended.empty():
                    running -= 1
                    yield taken()
            for _ in range(max(1, ended.qsize()) if running else 0):
                running -= 1
                yield taken()
    finally:
        stopped = True
        sys.setswitchinterval(interval)
        asyncio.run_coroutine_threadsafe(stop(), loop)
        thread.join()
        loop.close()


def filtered(items: Iterator[Item], f: Callable) -> Iterator[Item]:
    return (item for item in items if item[1] is not None or f(item[2]))


def expanded(items: Iterator[Item], f: Callable) -> Iterator[Item]:
    for seq, err, value in items:
        if err is not None:
            yield seq, err, value
        else:
            yield from ((seq, None, v) for v in f(value))


def rebatched(items: Iterator[Item], size: int) -> Iterator[Item]:
    for batch in batches_of(items, size):
        yield from batch


def chained(items: Iterator[Item], stages: tuple[Stage, ...], config: PipelineConfig, in_flight: int) -> Iterator[Item]:
    for stage in stages:
        match stage:
            case AsyncMap():
                items = awaited(items, stage.f, in_flight, stage.timeout, stage.retries)
            case Filter():
                items = filtered(items, stage.f)
            case Expand():
                items = expanded(items, stage.f)
            case FenceStage():
                items = rebatched(items, stage.size)
            case Map() | TryMap():
                items = mapped(items, stage.f, isinstance(stage, TryMap), config.oversubscribe)
    return items


def sliced(batch: pa.RecordBatch, size: int | None) -> Iterator[pa.RecordBatch]:
    """batch in parts of at most `size` rows, which become Python objects one part at a time."""
    for at in range(0, batch.num_rows, size or ROWS_OUT):
        yield batch.slice(at, size or ROWS_OUT)


def enricher(stage: AsyncMap, added: StructType, after: StructType, in_flight: int):
    """The function for mapInArrow of a coroutine over some columns; calls go on from one batch to the next.

    A batch goes on when its last call has ended, whichever batch that is; few wait at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    async def called(values: tuple) -> object:
        return await stage.f(*values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, waiting = to_arrow_schema(after), {}  # number of a batch: the batch, its results, how many are missing

        def items() -> Iterator[Item]:
            for k, batch in enumerate(batches):
                if batch.num_rows:
                    waiting[k] = [batch, [None] * batch.num_rows, batch.num_rows]
                    yield from (((k, at), None, v) for at, v in enumerate(zip(*(batch.column(c).to_pylist() for c in stage.columns))))

        for (k, at), _, value in awaited(items(), called, in_flight, stage.timeout, stage.retries, lambda: len(waiting) > MOST_WAITING):
            own = waiting[k]
            own[1][at] = value
            own[2] -= 1
            if own[2]:
                continue
            batch, rows, _ = waiting.pop(k)
            new = {n: rows if len(added) == 1 else [r[n] for r in rows] for n in added.names}
            arrays = [pa.array(new[n], schema.field(n).type) if n in new else batch.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return run


def runner(stages: tuple[Stage, ...], before: StructType, after: StructType, kept: list[str], config: PipelineConfig, in_flight: int):
    """The function for mapInArrow. before and after: fields of the items; kept: which of _seq and _err go along."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names_in, names_out = before.fieldNames(), after.fieldNames()
    scalar_in, scalar_out = names_in == ["value"], names_out == ["value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(after)

        def items() -> Iterator[Item]:
            for batch in (part for whole in batches for part in sliced(whole, config.buffer_size)):
                columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
                values = columns["value"] if scalar_in else [dict(zip(names_in, row)) for row in zip(*(columns[n] for n in names_in))]
                seqs = columns.get("_seq", [None] * batch.num_rows)
                errors = columns.get("_err", [None] * batch.num_rows)
                yield from ((s, (e["kind"], e["msg"]) if e else None, v) for s, e, v in zip(seqs, errors, values))

        for out in batches_of(chained(items(), stages, config, in_flight), config.buffer_size or ROWS_OUT):
            rows = [v for _, _, v in out]
            if scalar_out:
                arrays = [pa.array(rows, schema.field("value").type)]
            else:
                arrays = [pa.array([None if v is None else v[n] for v in rows], schema.field(n).type) for n in names_out]
            extra = {"_seq": lambda out=out: pa.array([s for s, _, _ in out], pa.int64()), "_err": lambda out=out: pa.array([e and {"kind": e[0], "msg": e[1]} for _, e, _ in out], pa.struct([("kind", pa.string()), ("msg", pa.string())]))}
            yield pa.RecordBatch.from_arrays([extra[k]() for k in kept] + arrays, names=[*kept, *names_out])

    return run
