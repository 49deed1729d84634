"""A bounded memo of a function, and what gives memory back after a task."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


class Memo(dict):
    """Results by key; of the keys not asked for lately, all but about `most` are forgotten.

    Keys met since the last turn are in the dictionary itself, the ones before in `old`.
    """

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def put_all(self, keys: list, values: list) -> None:
        if len(self) + len(keys) > self.most:
            self.old = dict(self)
            self.clear()
        self.update(zip(keys, values, strict=True))


def released(batches_to_batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The function for mapInArrow; after its partition, free memory goes back to the system, as Python workers live on."""

    @functools.wraps(batches_to_batches)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_to_batches(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run
