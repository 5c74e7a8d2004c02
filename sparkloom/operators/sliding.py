"""Medians over moving frames: rows stream by in order, and an order-statistic list holds the frame.

A row costs one insertion and one removal in a block of a sorted list, and a look-up from where the last one ended, so a frame from the start of a long partition costs little more than a sort. A task holds the frame's values and the rows
from the frame's end back to the current one, never a partition's rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 512


class Sorted:
    """A sorted list in blocks, with a cursor at the block of the last look-up. NaN stands above all numbers; null is not held."""

    def __init__(self):
        self.blocks: list[list[float]] = []
        self.tops: list[float] = []
        self.size = self.nans = self.cursor = self.before = 0  # before: values in the blocks before the cursor's

    def add(self, x: float | None) -> None:
        if x is None:
            return
        if x != x:
            self.nans += 1
            return
        self.size += 1
        if not self.blocks:
            self.blocks, self.tops = [[x]], [x]
            return
        k = min(bisect_left(self.tops, x), len(self.tops) - 1)
        block = self.blocks[k]
        insort(block, x)
        self.before += k < self.cursor
        if len(block) > 2 * BLOCK:
            self.blocks[k:k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.tops[k:k + 1] = [block[BLOCK - 1], block[-1]]
            self.cursor += k < self.cursor
        else:
            self.tops[k] = block[-1]

    def remove(self, x: float | None) -> None:
        if x is None:
            return
        if x != x:
            self.nans -= 1
            return
        self.size -= 1
        k = bisect_left(self.tops, x)
        block = self.blocks[k]
        del block[bisect_left(block, x)]
        self.before -= k < self.cursor
        if block:
            self.tops[k] = block[-1]
        else:
            del self.blocks[k], self.tops[k]
            self.cursor -= k < self.cursor

    def median(self) -> float | None:
        """The smallest value that at least half of the values do not exceed."""
        n = self.size + self.nans
        if not n:
            return None
        at = math.ceil(n * 0.5) - 1
        if at >= self.size:
            return math.nan
        while at < self.before:
            self.cursor -= 1
            self.before -= len(self.blocks[self.cursor])
        while at >= self.before + len(self.blocks[self.cursor]):
            self.before += len(self.blocks[self.cursor])
            self.cursor += 1
        return self.blocks[self.cursor][at - self.before]


class Moving:
    """The medians of one frame as rows of a partition stream by. low, high: see medians()."""

    def __init__(self, low: int | None, high: int):
        self.low, self.high, self.found = low, high, []
        self.begin()

    def begin(self) -> None:
        self.frame, self.held = Sorted(), deque()  # held: values of rows in reach, from place `first` on
        self.first = self.due = self.seen = self.entered = self.left = 0

    def push(self, value: float | None) -> None:
        self.held.append(value)
        self.seen += 1
        self.settle(False)

    def settle(self, ended: bool) -> None:
        """The medians of rows whose frame is complete."""
        frame, held, low, high, seen = self.frame, self.held, self.low, self.high, self.seen
        due, first, entered, left = self.due, self.first, self.entered, self.left
        while due < seen and (ended or due + high < seen):
            stop = min(seen, max(0, due + high + 1))
            start = 0 if low is None else max(0, due + low)
            while entered < stop:
                frame.add(held[entered - first])
                entered += 1
            while left < min(start, entered):
                frame.remove(held[left - first])
                left += 1
            self.found.append(frame.median() if start < stop else None)
            due += 1
            keep = entered if low is None else min(left, entered)
            while first < keep:
                held.popleft()
                first += 1
        self.due, self.first, self.entered, self.left = due, first, entered, left


def medians(low: int | None, high: int):
    """An Arrow function over rows in order (columns __part, __value): their frames' medians. low: rows from the current one to the frame's first, None from the start; high: to its last."""
    return moving([(low, high)], ["__value"], ["__median"])


def moving(reaches: list[tuple[int | None, int]], values: list[str], names: list[str]):
    """An Arrow function over rows in order (column __part and the values): the medians of several frames in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames, now = [Moving(*r) for r in reaches], None
        waiting: deque = deque()  # batches whose medians are not all there

        def ready() -> Iterator[pa.RecordBatch]:
            while waiting and all(len(f.found) >= waiting[0].num_rows for f in frames):
                batch, columns = waiting.popleft(), []
                for f in frames:
                    columns.append(pa.array(f.found[:batch.num_rows], pa.float64()))
                    del f.found[:batch.num_rows]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

        for batch in batches:
            waiting.append(batch)
            parts, rows = batch.column("__part").to_pylist(), zip(*[batch.column(v).cast(pa.float64(), safe=False).to_pylist() for v in values])
            for part, row in zip(parts, rows):
                if part != now:
                    for f in frames:
                        f.settle(True)
                        f.begin()
                    now = part
                for f, value in zip(frames, row):
                    f.push(value)
            yield from ready()
        for f in frames:
            f.settle(True)
        yield from ready()

    return run


def with_medians(df: DataFrame, part: list[str], order: list[Column], asked: list[tuple[Column | str, int | None, int, str]]) -> DataFrame:
    """df with the frames' medians; asked: (value or the name of a column of plain numbers, low, high, name of the medians). All frames share one sort,
    whose rows carry a short key, and values only where they are no columns."""
    if part:
        fields = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(str(i)) for i, c in enumerate(part)]), {"ignoreNullFields": "false"})
        key = F.when(F.octet_length(fields) <= 32, fields).otherwise(F.sha2(fields, 256))  # JSON begins with a brace, digests do not
    else:
        key = F.lit("")
    values = {f"__value_{i}": value.cast("double") for i, (value, *_) in enumerate(asked) if not isinstance(value, str)}
    work = df.withColumns({"__part": key} | values)
    work = (work.repartition("__part") if part else work.repartition(1)).sortWithinPartitions("__part", *order)
    names = [name for *_, name in asked]
    schema = T.StructType([*work.schema.fields, *[T.StructField(name, T.DoubleType()) for name in names]])
    return work.mapInArrow(moving([(low, high) for _, low, high, _ in asked], [value if isinstance(value, str) else f"__value_{i}" for i, (value, *_) in enumerate(asked)], names), schema).drop("__part", *values)
