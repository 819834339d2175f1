"""Pipelines: immutable builders whose result is a lazy DataFrame.

Items are rows. A pipeline of scalars has the one column `value`. `_seq` (input index) and `_err` (error struct) are
reserved. Declarative stages become selects and filters for the optimizer; each run of Python stages becomes one pass.
A result is lazy but for two things: a source that needs dense indices is stored when the pipeline is made, and what
precedes a barrier is stored when the result is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rillflow.config import PipelineConfig, Workload
from rillflow.operators import AsyncMap, Expand, Expression, Fence, FenceStage, Filter, Map, MapErr, PipelineError, Stage, TryMap
from rillflow.operators.balance import balanced
from rillflow.operators.opaque import enricher, runner
from rillflow.plans.failures import is_cluster_failure
from rillflow.plans.results import ROWS_EACH, committed, in_order, tried
from rillflow.sources import SEQ, from_items, sequenced
from rillflow.sources.folders import shared_folder, written
from rillflow.streaming.cancel import CancellationToken

ERR = "_err"
ERR_TYPE = "struct<kind:string,msg:string>"
RESERVED = (SEQ, ERR)


def column(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.expr(x)


def named(f: Expression) -> dict[str, Column]:
    return {k: column(v) for k, v in f.items()} if isinstance(f, dict) else {"value": column(f)}


def item_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in RESERVED]


def item_schema(df: DataFrame) -> StructType:
    return StructType([f for f in df.schema.fields if f.name not in RESERVED])


def as_items(rows: Iterable[Row], df: DataFrame, by: tuple[str, ...] = ()) -> Iterator:
    """Rows of df without what orders them: values where there is the one column `value`, else tuples."""
    names = [n for n in item_columns(df) if n not in by]
    return (r["value"] if names == ["value"] else tuple(r[n] for n in names) for r in rows)


def iterated(df: DataFrame, by: tuple[str, ...], rows_each: int) -> Iterator:
    """The items of df in the order of `by`, without it, a bounded part at a time."""
    names = [n for n in item_columns(df) if n not in by]
    return (item for item in in_order(df, by, rows_each, names))


# -- from stages to a DataFrame -----------------------------------------------------------------------------------------


def declared(df: DataFrame, stage: Stage) -> DataFrame:
    """One declarative stage. Failed rows go along untouched: they are not tested, mapped or expanded."""
    kept, items = [c for c in RESERVED if c in df.columns], item_columns(df)
    fallible = ERR in kept
    fine = F.col(ERR).isNull() if fallible else F.lit(True)
    guarded = (lambda c: F.when(fine, c)) if fallible else (lambda c: c)
    match stage:
        case MapErr():
            return df.withColumn(ERR, F.when(F.col(ERR).isNotNull(), stage.f(F.col(ERR))).cast(ERR_TYPE))
        case TryMap():
            fails = F.lit(None).cast(ERR_TYPE) if stage.error is None else stage.error.cast(ERR_TYPE)
            value = {n: F.when(fine & fails.isNull(), c) for n, c in named(stage.f).items()}
            if stage.error is None:
                missing = F.struct(F.lit(stage.kind).alias("kind"), F.to_json(F.struct(*items)).alias("msg"))
                fails = F.when(next(iter(value.values())).isNull(), missing)
            err = F.when(fine, fails).otherwise(F.col(ERR)) if fallible else fails
            return df.select(*[c for c in kept if c != ERR], err.cast(ERR_TYPE).alias(ERR), *(c.alias(n) for n, c in value.items()))
        case Map():
            return df.select(*kept, *(guarded(c).alias(n) for n, c in named(stage.f).items()))
        case Filter():
            return df.filter(~fine | column(stage.f) if fallible else column(stage.f))
        case Expand():
            if fallible:
                raise ValueError("expand has no fallible form")
            (array,) = named(stage.f).values()
            return df.select(*kept, F.posexplode(array).alias("_pos", "value")).drop("_pos")
        case FenceStage():
            shared_folder(df.sparkSession)
            return df.checkpoint(eager=True)
    raise TypeError(f"unknown stage {stage!r}")


def most_calling(config: PipelineConfig, cores: int) -> int | None:
    """How many tasks may make calls, None if there may be as many as there are partitions."""
    at_once = cores if config.async_workers is None else min(cores, config.async_workers)
    return config.io_concurrency if config.io_concurrency < at_once else config.async_workers


def with_calls(df: DataFrame, config: PipelineConfig) -> tuple[DataFrame, int]:
    """df in as many tasks as may make calls at once, and how many calls each of them may have in flight.

    The tasks at once are the cores that the session has when the plan is made; executors that come later add to the calls, and
    fewer partitions than cores take away from them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    most = most_calling(config, cores)
    return df if most is None else df.coalesce(most), config.io_concurrency // min(cores, most or cores)


def dealt_to(tasks: int, stages: tuple[Stage, ...], config: PipelineConfig, cores: int) -> int:
    """tasks, or as few as may make calls in the same pass: more would be put together to shares of one or two of them."""
    for stage in stages:
        if isinstance(stage, FenceStage) and stage.mode is Fence.BARRIER:
            break
        if isinstance(stage, AsyncMap):
            return min(tasks, most_calling(config, cores) or tasks)
    return tasks


def undeclared(df: DataFrame, run: list[Stage], config: PipelineConfig) -> DataFrame:
    """A run of Python stages, fused into one pass over Arrow batches."""
    before = item_schema(df)
    fallible = ERR in df.columns or any(isinstance(s, TryMap) for s in run)
    schemas = [s.schema for s in run if s.schema]
    after = StructType.fromDDL(schemas[-1]) if schemas else StructType([StructField(f.name, f.dataType) for f in before.fields])
    kept = [SEQ] * (SEQ in df.columns) + [ERR] * fallible
    extra = [f for f in df.schema.fields if f.name == SEQ] + [StructField(ERR, StructType.fromDDL("kind string, msg string"))] * fallible
    in_flight = 1
    if any(isinstance(s, AsyncMap) for s in run):
        df, in_flight = with_calls(df, config)
    step = runner(tuple(run), before, after, kept, config.with_profile(None), in_flight)
    return df.mapInArrow(step, StructType([*extra, *after.fields]), profile=config.profile)


def enriched(df: DataFrame, stage: AsyncMap, config: PipelineConfig) -> DataFrame:
    """A coroutine over some columns; all others pass by in Arrow and never become Python objects."""
    df, in_flight = with_calls(df, config)
    added = StructType.fromDDL(stage.schema)
    after = StructType([f for f in df.schema.fields if f.name not in added.names] + added.fields)
    return df.mapInArrow(enricher(stage, added, after, in_flight), after, profile=config.profile)


def known_partitions(df: DataFrame) -> int | None:
    """How many partitions df has, None if only running it would tell."""
    plan = df._jdf.queryExecution().executedPlan()
    return None if "Exchange" in plan.toString() else plan.execute().getNumPartitions()


def lowered(df: DataFrame, stages: tuple[Stage, ...], config: PipelineConfig) -> DataFrame:
    if config.cost is not None:
        df = balanced(df if SEQ in df.columns else sequenced(df), config.cost, SEQ, config.compute_workers)
        config = config.with_cost(None)  # Columns don't go along to Python workers
    elif config.workload is Workload.SPREAD and config.compute_workers is None:
        cores, dealt = df.sparkSession.sparkContext.defaultParallelism, known_partitions(df)
        df = df.repartition(cores * config.workload.value) if dealt is not None and dealt < cores else df
    elif config.compute_workers is not None or config.workload is not Workload.BALANCED:
        cores = df.sparkSession.sparkContext.defaultParallelism
        df = df.repartition(dealt_to((config.compute_workers or cores) * config.workload.value, stages, config, cores))
    run: list[Stage] = []
    for stage in stages:
        apart = isinstance(stage, AsyncMap) and stage.columns
        if stage.opaque and not apart:
            run.append(stage)
            continue
        if run:
            df, run = undeclared(df, run, config), []
        df = enriched(df, stage, config) if apart else declared(df, stage)
    return undeclared(df, run, config) if run else df


# -- builders -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Builder:
    source: DataFrame
    stages: tuple[Stage, ...] = ()
    config: PipelineConfig = PipelineConfig()

    def _with(self, stage: Stage):
        return replace(self, stages=(*self.stages, stage))

    def with_config(self, config: PipelineConfig):
        return replace(self, config=config)

    def with_workload(self, workload: Workload):
        return replace(self, config=self.config.with_workload(workload))

    def with_cost(self, cost: Column | str):
        """Deal items to tasks of nearly equal total cost, by an expression on their columns; rows move only if it is needed."""
        return replace(self, config=self.config.with_cost(cost))

    def with_resources(self, profile: ResourceProfile):
        """Run Python and asynchronous stages on executors of a resource profile, made and shared by Spark as the cluster manager allows.

        Sessions on one machine have no such executors and refuse to run the plan.
        """
        return replace(self, config=self.config.with_profile(profile))

    def with_compute_pool(self, workers: int):
        return replace(self, config=self.config.with_compute_workers(workers))

    def with_oversubscribe(self, factor: int):
        return replace(self, config=self.config.with_oversubscribe(factor))

    def transform(self, f: Callable[[DataFrame], DataFrame]):
        """A stage of one's own: any function on the DataFrame of the items so far."""
        return replace(self, source=f(lowered(self.source, self.stages, self.config)), stages=())

    def to_df(self, keep_seq: bool = False) -> DataFrame:
        """The lazy result. keep_seq leaves the input index in it."""
        out = lowered(self.source, self.stages, self.config)
        return out if keep_seq else out.drop(SEQ)

    def _items(self, df: DataFrame, by: tuple[str, ...] = ()) -> list:
        """The items on the driver, which puts them in order: a distributed sort would first run the stages to sample."""
        rows = df.collect()
        if by:
            rows.sort(key=lambda r: tuple((r[n] is not None, r[n]) for n in by))
        return list(as_items(rows, df, by))


class Pipe(Builder):
    """map, filter and try_map over items, ending in collect, for_each or a DataFrame."""

    def map(self, f: Expression | Callable, schema: str | None = None) -> Pipe:
        return self._with(Map(f, schema))

    def filter(self, f: Column | str | Callable) -> Pipe:
        """Keep items where f holds; a null condition drops the item."""
        return self._with(Filter(f))

    def try_map(self, f: Expression | Callable, schema: str | None = None, error: Column | None = None, kind: str = "Failed") -> TryPipe:
        """Map that may fail: a callable by raising, an expression where `error` is not null or, without it, by a null."""
        return TryPipe(self.source, (*self.stages, TryMap(f, schema, error, kind)), self.config)

    def collect(self) -> list:
        """The items in input order."""
        out = self.to_df(keep_seq=True)
        return self._items(out, (SEQ,) if SEQ in out.columns else ())

    def iterate(self, rows_each: int = ROWS_EACH) -> Iterator:
        """The items in input order, rows_each on the driver at a time: for results that no list would hold.

        The result is stored, sorted by ranges and read file by file; what is stored goes with the iterator.
        """
        out = self.to_df(keep_seq=True)
        by = (SEQ,) if SEQ in out.columns else ()
        return iterated(out, by, rows_each)

    def for_each(self, f: Callable) -> None:
        """Call f on each item where it is, in no order. A task that is tried again calls it again, so f must bear that."""
        scalar = item_columns(out := self.to_df()) == ["value"]

        def partition(rows: Iterable) -> None:
            for row in rows:
                f(row["value"] if scalar else row)

        out.foreachPartition(partition)

    def fold(self, zero: object, add: Callable, merge: Callable) -> object:
        """What add makes of zero and the items of each task, put together by merge; zero, which is neutral to merge, if there are none.

        Effects on a shared value, each once: a task's value comes along with its result, so that an attempt that fails or
        loses a race adds nothing, however far it came. The driver gets one value for each task. zero must not be changed by add.
        """
        scalar = item_columns(out := self.to_df()) == ["value"]
        names = item_columns(out)

        def folded(batches: Iterator) -> Iterator:
            import pickle

            import pyarrow as pa

            value = zero
            for batch in batches:
                columns = [batch.column(n).to_pylist() for n in names]
                for item in columns[0] if scalar else map(dict, (zip(names, row) for row in zip(*columns))):
                    value = add(value, item)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(value)], pa.binary())], names=["value"])

        import pickle

        values = [pickle.loads(r["value"]) for r in out.mapInArrow(folded, "value binary").collect()]  # one for each task
        return reduce(merge, values, zero) if values else zero

    def effects(self, f: Callable, schema: str) -> DataFrame:
        """What f returns for each item, staged: each attempt of a task stages its own, and those of the attempt that
        committed are what one finds, each once, when this returns. To be applied by a job of their own, with `_effect`, which
        stays the same if that job is tried again, to know those that were applied before."""
        return written(self.map(f, schema).to_df().withColumn("_effect", F.monotonically_increasing_id()), "effects")

    def aggregate(self, **parts: Column) -> DataFrame:
        """One row of sums, counts and the like: what side effects on shared counters would add up."""
        return self.to_df().agg(*(c.alias(n) for n, c in parts.items()))


class TryPipe(Builder):
    """A chain in which items may have failed; the error of the smallest input index is the result's."""

    def map(self, f: Expression | Callable, schema: str | None = None) -> TryPipe:
        return self._with(Map(f, schema))

    def filter(self, f: Column | str | Callable) -> TryPipe:
        """Drop items that are fine and do not satisfy f; failed items stay."""
        return self._with(Filter(f))

    def try_map(self, f: Expression | Callable, schema: str | None = None, error: Column | None = None, kind: str = "Failed") -> TryPipe:
        return self._with(TryMap(f, schema, error, kind))

    def map_err(self, f: Callable[[Column], Column]) -> TryPipe:
        """Rewrite the errors raised by the stages before."""
        return self._with(MapErr(f))

    def ok_df(self) -> DataFrame:
        """The values of the items that did not fail."""
        out = self.to_df(keep_seq=True)
        return out.filter(F.col(ERR).isNull()).drop(SEQ, ERR)

    def errors_df(self) -> DataFrame:
        """seq, kind and msg of each failed item."""
        out = self.to_df(keep_seq=True).filter(F.col(ERR).isNotNull())
        return out.select(F.col(SEQ).alias("seq"), f"{ERR}.kind", f"{ERR}.msg")

    def first_error_df(self) -> DataFrame:
        """The error of the smallest input index as one row, nulls if there is none. Partial minima are merged."""
        out = self.to_df(keep_seq=True).filter(F.col(ERR).isNotNull())
        first = out.agg(F.min_by(F.struct(F.col(SEQ).alias("seq"), f"{ERR}.kind", f"{ERR}.msg"), SEQ).alias("e"))
        return first.select("e.seq", "e.kind", "e.msg")

    def try_iterate(self, rows_each: int = ROWS_EACH) -> Iterator:
        """The values in input order, rows_each on the driver at a time, or PipelineError before the first.

        The input is run in growing waves of index ranges, as `take` does: an error ends the run when all before it is done,
        and the waves behind it are never started. Each stage runs once for each item that is reached.
        """
        error, done = tried(self.source, SEQ, ERR, lambda rows: lowered(rows, self.stages, self.config))
        if error is not None:
            raise PipelineError(error["kind"], error["msg"], error["seq"])
        return (item for out in done for item in iterated(out.drop(ERR), (SEQ,), rows_each))

    def try_collect(self) -> list:
        """The values in input order, or PipelineError; see try_iterate. No value reaches the driver if there is an error."""
        return list(self.try_iterate())


@dataclass(frozen=True)
class StreamPipe(Builder):
    """Stages with expansion, asynchronous calls, fences, order and cancellation. Items always carry their input index."""

    by_seq: bool = False
    by_position: bool = False
    expands: bool = False
    token: CancellationToken | None = None

    def stage(self, f: Expression | Callable, schema: str | None = None) -> StreamPipe:
        return self._with(Map(f, schema))

    def stage_async(self, f: Callable, schema: str | None = None, columns: tuple[str, ...] = (), timeout: float | None = None, retries: int = 0) -> StreamPipe:
        """A coroutine function, called for many items at once: io_concurrency over all tasks of the stage.

        With columns, f gets their values as its arguments and returns the value of the column that schema names, or a dict
        if it names several; these are added to the item, or replace columns of it. A call that fails or takes longer than
        timeout seconds is made again up to `retries` times; then its failure is the job's.
        """
        if columns and not schema:
            raise ValueError("name what a stage over columns returns")
        return self._with(AsyncMap(f, schema, tuple(columns), timeout, retries))

    def expand(self, f: Column | str | Callable, schema: str | None = None) -> StreamPipe:
        """Each item gives any number of items, which keep its input index; none if the array is empty or null."""
        return replace(self._with(Expand(f, schema)), expands=True)

    def fence(self, mode: Fence = Fence.BARRIER, size: int = 0) -> StreamPipe:
        """BARRIER: what follows starts when what precedes is done and stored. CHUNKED: pass on `size` items at a time."""
        if mode is Fence.CHUNKED and size < 1:
            raise ValueError("a chunked fence needs a size")
        return self._with(FenceStage(mode=mode, size=size))

    def ordered(self) -> StreamPipe:
        """Results in input order: run sorts what it collects, to_df sorts by ranges of the index."""
        return replace(self, by_seq=True)

    def ordered_by_position(self) -> StreamPipe:
        """Order by input index and, among the items of one expansion, by place in it."""
        return replace(self, by_position=True)

    def with_cancel(self, token: CancellationToken) -> StreamPipe:
        """Run under token. What a cancelled run gives is as fine as its tasks: with_workload or with_compute_pool make more of them."""
        return replace(self, token=token)

    def with_async_pool(self, workers: int) -> StreamPipe:
        return replace(self, config=self.config.with_async_workers(workers))

    def _check_order(self) -> None:
        if self.by_seq and self.expands and not self.source.isEmpty():
            raise ValueError("`.ordered()` is incompatible with `.expand()`; see ordered_by_position")

    def _done(self) -> tuple[DataFrame, tuple[str, ...]]:
        """The items, not yet in order, and the columns that order them."""
        self._check_order()
        out = lowered(self.source, self.stages, self.config) if self.token is None else self._done_and_committed(self.token)
        if self.by_position:
            return (out if "_at" in out.columns else out.withColumn("_at", F.monotonically_increasing_id())), (SEQ, "_at")
        return out, (SEQ,) if self.by_seq else ()

    def to_df(self, keep_seq: bool = False) -> DataFrame:
        """The result, in order if ordered. keep_seq leaves the input index in it.

        Sorting first samples what it sorts, so Python stages before it run twice unless a barrier comes last. With
        a token the run happens now and what it had stored when it was cancelled is the result.
        """
        out, by = self._done()
        out = (out.orderBy(*by) if by else out).drop("_at")
        return out if keep_seq else out.drop(SEQ)

    def iterate(self, rows_each: int = ROWS_EACH) -> Iterator:
        """As run, with rows_each items on the driver at a time; see Pipe.iterate."""
        out, by = self._done()
        return iterated(out, by, rows_each)

    def run(self) -> list:
        """The items, in input order if ordered. A cancelled run returns what had been done."""
        return self._items(*self._done())

    def try_run(self) -> list:
        """As run, with a failure of the session or cluster raised as OSError; failures of stages stay what they are."""
        try:
            return self.run()
        except Exception as e:
            if is_cluster_failure(e, self.source.sparkSession):
                raise OSError("the Spark session or cluster failed") from e
            raise

    def _done_and_committed(self, token: CancellationToken) -> DataFrame:
        """One job for what lies between two barriers: what its tasks had committed when it was cancelled is the result.

        A barrier holds back all items: what follows it starts when what precedes is done, and a run that is cancelled
        before that gives nothing.
        """
        segments: list[list[Stage]] = [[]]
        for stage in self.stages:
            if isinstance(stage, FenceStage) and stage.mode is Fence.BARRIER:
                segments.append([])
            else:
                segments[-1].append(stage)
        nothing = lowered(self.source.limit(0), tuple(s for part in segments for s in part), self.config)
        rows = self.source
        for k, stages in enumerate(segments):
            out, last = lowered(rows, tuple(stages), self.config), k + 1 == len(segments)
            if last and self.by_position:
                out = out.withColumn("_at", F.monotonically_increasing_id())
            rows, ended = committed(out, token)
            if rows is None or not (ended or last):
                return nothing
        return rows


def pipe(items: DataFrame | Iterable, spark: SparkSession | None = None, seq: str | None = None, schema: str | None = None) -> Pipe:
    """A Pipe over a collection or a DataFrame. seq names a unique integer column that gives the input order."""
    return Pipe(_source(items, spark, seq, schema))


def stream(items: DataFrame | Iterable, spark: SparkSession | None = None, seq: str | None = None, schema: str | None = None) -> StreamPipe:
    return StreamPipe(_source(items, spark, seq, schema))


def _source(items: DataFrame | Iterable, spark: SparkSession | None, seq: str | None, schema: str | None) -> DataFrame:
    if isinstance(items, DataFrame):
        return items if SEQ in items.columns else sequenced(items, seq)
    return from_items(spark or SparkSession.builder.getOrCreate(), items, schema)
