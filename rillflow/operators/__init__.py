"""Stages of a pipeline, as values that a plan is made from."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column

#: What a declarative stage takes: a Column, SQL text, or several of them by name.
Expression = Column | str | dict[str, "Column | str"]


class PipelineError(Exception):
    """The error of the smallest input index of a fallible chain."""

    def __init__(self, kind: str, msg: str, seq: int):
        super().__init__(f"{kind}: {msg} (item {seq})")
        self.kind, self.msg, self.seq = kind, msg, seq


class Fence(Enum):
    BARRIER = "barrier"
    CHUNKED = "chunked"


@dataclass(frozen=True)
class Stage:
    """f is an Expression, which stays in the optimizer, or a Python callable on items, which is run in Arrow batches.

    A callable gets the item itself where items have the one column `value`, else a dict; schema describes what it returns
    and is that of the items before where it is left out.
    """

    f: object = None
    schema: str | None = None

    @property
    def opaque(self) -> bool:
        return callable(self.f) and not isinstance(self.f, Column)


@dataclass(frozen=True)
class Map(Stage):
    pass


@dataclass(frozen=True)
class Filter(Stage):
    pass


@dataclass(frozen=True)
class TryMap(Stage):
    """error: a Column that is null for items that succeed; without it, a null value is the failure `kind`."""

    error: Column | None = None
    kind: str = "Failed"


@dataclass(frozen=True)
class MapErr(Stage):
    """f maps the error struct, a Column with kind and msg, to another one."""

    @property
    def opaque(self) -> bool:
        return False


@dataclass(frozen=True)
class Expand(Stage):
    """An array expression, or a callable that returns an iterable."""


@dataclass(frozen=True)
class AsyncMap(Stage):
    """A coroutine function on items, or on the named columns of items; seconds a call may take, and how often it is made again."""

    columns: tuple[str, ...] = ()
    timeout: float | None = None
    retries: int = 0


@dataclass(frozen=True)
class FenceStage(Stage):
    mode: Fence = Fence.BARRIER
    size: int = 0

    @property
    def opaque(self) -> bool:
        return self.mode is Fence.CHUNKED

