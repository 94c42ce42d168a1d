"""What Python workers of several operators share: memory that one operator's tasks keep, and give back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What the operator of that name keeps from task to task in this Python process.

    Workers go from one operator's tasks to the next one's, so what others have kept is given up first.
    """
    others = [d for k, d in _KEPT.items() if k != name and d]
    for d in others:
        d.clear()
    if others:
        release()
    return _KEPT.setdefault(name, {})


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task holds on to it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def resting(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, whose Python process gives freed memory back after a task's last batch.

    An executor has more Python workers than cores, as a task with two such steps uses two, and they take turns.
    """

    def out(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return out


def uncollected(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow without the collector of cycles, which would go through the worker's large caches again and again.

    It is called once for each input batch instead, so what it finds stays bounded by a batch.
    """

    def out(batches: Iterator) -> Iterator:
        def counted() -> Iterator:
            for b in batches:
                yield b
                gc.collect()

        on = gc.isenabled()
        gc.disable()
        try:
            yield from run(counted())
        finally:
            if on:
                gc.enable()

    return out


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes of text, so that outputs stay small."""
    lo, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
