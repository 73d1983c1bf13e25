"""Filling containers of fixed capacity: bounded-space online packing.

Each partition keeps a fixed number of open windows. An item goes into the window it leaves least
room in; where it fits none and all windows are open, the fullest is emitted and a new one opened.
The items of windows still open at the end of a partition, a bounded number of windows each, are
merged in a second packing, largest first.

Defined results: an item larger than the capacity is cut into full containers and one rest, which
is packed like any item; no other item is cut; items of size zero are placed too; null sizes count
as zero; no items give no containers.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.session import settle

OPEN_WINDOWS = 256


class Packer:
    """Best fit into a bounded number of open windows."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self.room: list[tuple[int, int]] = []  # (room left, window) of the open ones, sorted
        self.following = 0

    def add(self, sizes: np.ndarray) -> np.ndarray:
        """The window of each item, in order of arrival."""
        out = np.empty(len(sizes), dtype=np.int64)
        room = self.room
        for i, size in enumerate(sizes.tolist()):
            k = bisect.bisect_left(room, (size, -1))
            if k < len(room):
                left, w = room.pop(k)
            else:
                if len(room) >= self.windows:
                    room.pop(0)  # the fullest is emitted
                left, w = self.capacity, self.following
                self.following += 1
            out[i] = w
            if left > size or size == 0:
                bisect.insort(room, (left - size, w))
        return out


def _stream(capacity: int, windows: int):
    """Items to windows, batch by batch; at the end one row without an item for each window still open."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, packer = TaskContext.get().partitionId() << 36, Packer(capacity, windows)
        for pdf in batches:
            yield pdf.assign(window=base + packer.add(pdf["size"].to_numpy()))
        left = [base + w for _, w in packer.room]
        yield pd.DataFrame({"item": pd.array([None] * len(left), dtype="Int64"), "part": 0, "size": 0, "window": left})

    return place


def _merge(capacity: int):
    """The items of one task, largest first, all windows open."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, items = TaskContext.get().partitionId() << 36, [pdf for pdf in batches if len(pdf)]
        if items:
            pdf = pd.concat(items, ignore_index=True).sort_values(["size", "item", "part"], ascending=[False, True, True], ignore_index=True)
            yield pdf.assign(window=(1 << 60) + base + Packer(capacity, 1 << 30).add(pdf["size"].to_numpy()))

    return place


def packed(items: DataFrame, capacity: int = 2048, windows: int = OPEN_WINDOWS, merge_rows: int = 200_000) -> DataFrame:
    """(id, size) to (id, part, size, container): one row per item, or per piece of an item above the capacity.

    A task holds its open windows only. merge_rows is how many items of windows left open one task
    packs again; it bounds that task's memory and leaves no item out.
    """
    size = F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long")
    sized = items.select(F.col("id").alias("item"), size.alias("size"))
    full, rest = F.floor(F.col("size") / capacity), F.col("size") % capacity
    cut = sized.filter(F.col("size") > capacity)
    cut = cut.select("item", F.posexplode(F.concat(F.array_repeat(F.lit(capacity).cast("long"), full.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))).alias("part", "size"))
    whole = sized.filter(F.col("size") <= capacity).select("item", F.lit(0).alias("part"), "size")
    schema = "item long, part int, size long, window long"
    first = settle(whole.unionByName(cut).mapInPandas(_stream(capacity, windows), schema), "placed")

    open_ = first.filter("item is null").select("window")  # a bounded number a task
    items = first.filter("item is not null")
    left = settle(items.join(open_, "window", "left_semi").select("item", "part", "size"), "left")
    tasks = max(1, -(-left.count() // merge_rows))
    merged = left.repartition(tasks, "item", "part").mapInPandas(_merge(capacity), schema)
    both = items.join(open_, "window", "left_anti").select("item", "part", "size", "window").unionByName(merged)
    return both.select(F.col("item").alias("id"), "part", "size", F.col("window").alias("container"))
