"""Word hashing in Arrow batches, shared by the operators that look at words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Odd 64-bit constants of the usual splitmix finaliser (fixed values).
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_sent: list[Broadcast] = []


def send(rows: DataFrame, value) -> Broadcast:
    """A broadcast that ``unsend`` takes back."""
    _sent.append(rows.sparkSession.sparkContext.broadcast(value))
    return _sent[-1]


def unsend() -> None:
    """Free what the workers hold of all broadcasts; a later use fetches it again."""
    while _sent:
        _sent.pop().unpersist()


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, held by this worker for later ``lean`` tasks of the same name."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def make_room(name: str | None) -> None:
    """Forget what the worker holds under other names."""
    others = [n for n in _kept if n != name]
    for other in others:
        del _kept[other]
    if others:
        give_back()


def give_back() -> None:
    gc.collect()
    trim()


def trim() -> None:
    """Memory that the allocators hold free goes back to the machine."""
    pa.default_memory_pool().release_unused()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if malloc_trim:
        malloc_trim(0)


def lean(run: Run, keeps: str | None = None) -> Run:
    """``run``, after which the worker gives its free memory back to the machine.

    Workers go on to other stages; what the allocators keep would add up with theirs. What earlier
    stages hold in the worker goes first, but for what is held under the name ``keeps``.
    """

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(keeps)
        yield from run(batches)
        give_back()

    return inner


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` for the rows of a group, after which the worker gives its free memory back to the machine."""

    def inner(rows: pa.Table) -> pa.Table:
        make_room(None)
        out = run(rows)
        trim()
        return out

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_1
        x = (x ^ (x >> np.uint64(27))) * MIX_2
        return x ^ (x >> np.uint64(31))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pieces(batch: pa.RecordBatch, text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many text bytes; a longer text is a slice alone."""
    sizes = batch.column(text).cast(pa.binary())
    ends = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in sizes]) if len(sizes) else []
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def windows(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word windows of a run of documents, and how many each document has.

    A document with 1 to ``width - 1`` words has its whole sequence as one window.
    """
    with np.errstate(over="ignore"):
        rolled = np.full(len(hashes), GOLDEN, dtype=np.uint64)
        for i in range(width):
            shifted = np.zeros_like(hashes)
            shifted[: max(0, len(hashes) - i)] = hashes[i:]
            rolled = mix(rolled * GOLDEN + shifted)
    counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(lengths.dtype))
    out = np.empty(int(counts.sum()), dtype=np.uint64)
    ends = np.cumsum(counts)
    inside = np.arange(len(out)) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)
    out[:] = rolled[inside] if len(out) else out
    for i in np.flatnonzero((lengths > 0) & (lengths < width)):
        words = hashes[starts[i] : starts[i] + lengths[i]].tobytes()
        out[ends[i] - 1] = np.uint64(xxhash.xxh3_64_intdigest(words, seed=int(lengths[i])))
    return out, counts
