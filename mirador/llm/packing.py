"""Best-fit packing by the configuration linear program over the length histogram.

Documents become pieces of at most CAPACITY tokens. The number of pieces of each length is a
histogram of at most CAPACITY rows, whatever the corpus, and the driver only sees that. A
configuration is a multiset of lengths that fits a sequence. The covering program (use as few
configurations as cover every length's count) is solved by multiplicative weights: each
length's dual weight starts at its size and falls as it gets covered; a knapsack dynamic
program prices the configuration of largest dual value, which is then used for a small step.
The fractional counts are rounded and the program is solved again over what is left, for the
fullest configurations first. The pieces that no rounding places go best fit first.

Pieces are then matched with places by their number within their length: counts per task and
length give each task its first number, so no length is ranked in one task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mirador.sources.tables import stage

from .registry import query, table
from .segments import WHITE, Memory, segments
from .words import kept, lean, pieces, send

CAPACITY = 1024
STEP = 0.34
#: Long pieces are hard to combine: a size weighs a little more than in proportion.
LONGER_FIRST = 1.03
#: Fullest configurations first; what they cannot cover is left to emptier ones.
FILLS = (1.0, 0.995, 0.97, 0.9, 0.0)
#: Amounts of configurations so full are rounded to the nearest, those of others down.
ALMOST_FULL = 0.995

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
     ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("number", pa.int64())]
)
PIECES_DDL = (
    "doc_id bigint, text_hash bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
    "task bigint, number bigint"
)
#: Texts that can't be cut at their blanks alone: white space (Python's, too) before a blank.
UNSAFE = f"[{WHITE}\x1c-\x1f] "
#: A part in runs from white space on; a line feed before another character is a token of its own.
RUNS = re.compile(f"\n(?=[^{WHITE}])|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
MARKS = ".,;:!?#*$%&|<>()"
Configuration = tuple[tuple[int, int], ...]  # (length, copies), longest first


def priced(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the largest weight that fits each room, and its last length's index."""
    value = np.zeros(capacity + 1)
    chosen = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        options = value[room - lengths[: fits[room]]] + weights[: fits[room]]
        top = int(options.argmax())
        if options[top] > value[room - 1]:
            value[room], chosen[room] = options[top], top
        else:
            value[room] = value[room - 1]
    return value, chosen


def configuration_with(first: int, lengths: np.ndarray, chosen: np.ndarray, capacity: int) -> dict[int, int]:
    """The best configuration that holds the given length: copies by index of length."""
    copies = {first: 1}
    room = capacity - int(lengths[first])
    while room > 0:
        k = int(chosen[room])
        if k < 0:
            room -= 1
        else:
            copies[k] = copies.get(k, 0) + 1
            room -= int(lengths[k])
    return copies


def cover(
    histogram: dict[int, int], capacity: int, least_fill: float, step: float = STEP
) -> list[tuple[Configuration, float]]:
    """Fractional configurations, at least so full, that cover the histogram as far as they go.

    Multiplicative weights: a length's weight is its size times a factor that falls as it gets
    covered. One pricing gives the best configuration around every length; those near the best
    value that share no length are used in one round.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[x] for x in lengths], dtype=np.float64)
    covered = np.zeros(len(lengths))
    used: dict[Configuration, float] = {}
    while True:
        weights = (lengths / capacity) ** LONGER_FIRST * np.exp(-0.05 * covered) * (covered < 1 - 1e-9)
        value, chosen = priced(lengths, weights, capacity)
        around = weights + value[capacity - lengths]
        taken = np.zeros(len(lengths), dtype=bool)
        progress = False
        for first in np.flatnonzero((weights > 0) & (around >= 0.95 * around.max()))[::-1]:
            if taken[first]:
                continue
            copies = configuration_with(int(first), lengths, chosen, capacity)
            at = np.array(list(copies))
            n = np.array(list(copies.values()), dtype=np.float64)
            if taken[at].any() or (n > counts[at]).any() or (n * lengths[at]).sum() < least_fill * capacity:
                continue
            amount = float((np.minimum(step, 1 - covered[at]) * counts[at] / n).min())
            configuration = tuple((int(lengths[k]), copies[k]) for k in sorted(copies, reverse=True))
            used[configuration] = used.get(configuration, 0.0) + amount
            covered[at] += n * amount / counts[at]
            taken[at] = True
            progress = True
        if not progress or covered.min() >= 1 - 1e-9:
            return list(used.items())


def best_fit(histogram: dict[int, int], capacity: int) -> dict[Configuration, int]:
    """The pieces one by one, longest first, into the fullest sequence they fit."""
    by_room: dict[int, list[list[int]]] = {}
    rooms = np.zeros(capacity + 1, dtype=np.int64)
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fitting = np.flatnonzero(rooms[length:])
            room = length + int(fitting[0]) if len(fitting) else capacity
            if len(fitting):
                content = by_room[room].pop()
                rooms[room] -= 1
            else:
                content = []
            content.append(length)
            by_room.setdefault(room - length, []).append(content)
            rooms[room - length] += 1
    packed: dict[Configuration, int] = {}
    for contents in by_room.values():
        for content in contents:
            sizes, copies = np.unique(content, return_counts=True)
            key = tuple((int(s), int(n)) for s, n in zip(sizes[::-1], copies[::-1]))
            packed[key] = packed.get(key, 0) + 1
    return packed


def pack(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[Configuration, int]:
    """Whole numbers of configurations that hold exactly the pieces of the histogram."""
    rest = {length: n for length, n in histogram.items() if n > 0}
    packed: dict[Configuration, int] = {}
    if rest.get(capacity):
        packed[((capacity, 1),)] = rest.pop(capacity)
    for least_fill in FILLS:
        placed = 1
        while placed and rest:
            placed = 0
            before = sum(rest.values())
            for configuration, amount in sorted(cover(rest, capacity, least_fill), key=lambda c: -c[1]):
                # to the nearest whole number if the sequence is full, else down
                wanted = int(amount + (0.5 if least_fill >= ALMOST_FULL else 1e-6))
                whole = min([wanted, *(rest[length] // copies for length, copies in configuration)])
                if whole:
                    packed[configuration] = packed.get(configuration, 0) + whole
                    placed += whole * sum(copies for _, copies in configuration)
                    for length, copies in configuration:
                        rest[length] -= copies * whole
            rest = {length: n for length, n in rest.items() if n > 0}
            placed = placed if placed > 0.1 * before else 0
    for configuration, n in best_fit(rest, capacity).items():
        packed[configuration] = packed.get(configuration, 0) + n
    return packed


class Places:
    """Where the n-th piece of a length goes, as sorted intervals of n."""

    def __init__(self, packed: dict[Configuration, int], capacity: int):
        rows, first, taken = [], 0, {}
        for configuration, n in packed.items():
            offset = 0
            for length, copies in configuration:
                for _ in range(copies):
                    rows.append((length, taken.get(length, 0), first, offset))
                    taken[length] = taken.get(length, 0) + n
                    offset += length
            first += n
        rows.sort()
        length, start, self.sequence, self.offset = (np.array(c, dtype=np.int64) for c in zip(*rows or [(0, 0, 0, 0)]))
        self.start = start
        self.key = (length << 48) | start

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) | number, side="right") - 1
        return self.sequence[at] + number - self.start[at], self.offset[at]


def memory_of(vocabulary: str, remembered: int) -> Memory:
    """A memory of so many segments, with a tokenizer of the given file text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    vocabulary_of = tokenizer.get_vocab(with_added_tokens=False)
    widths = np.zeros(max(vocabulary_of.values()) + 1, dtype=np.int64)
    for token, i in vocabulary_of.items():
        widths[i] = len(token)  # one character per byte

    def together(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Segments that can be written one after the other: cut again by their bytes."""
        runs = ["".join(parts[at : at + 100]) for at in range(0, len(parts), 100)]
        found = [e.ids for e in tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        ids = np.concatenate([np.array(f, dtype=np.int32) for f in found])
        ends = np.searchsorted(np.cumsum(widths[ids]), np.cumsum([len(p.encode()) for p in parts])) + 1
        return np.diff(ends, prepend=0), ids

    def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # a segment from its blank to a character that is none has the same tokens anywhere
        joins = [s[0] == " " and not s[-1].isspace() for s in new]
        counts = np.zeros(len(new), dtype=np.int64)
        alone = [e.ids for e in tokenizer.encode_batch_fast([s for s, j in zip(new, joins) if not j], add_special_tokens=False)]
        rest = np.flatnonzero(np.logical_not(joins))
        counts[rest] = [len(i) for i in alone]
        order, ids = [rest], [np.array([i for found in alone for i in found], dtype=np.int32)]
        joined = np.flatnonzero(joins)
        for at in range(0, len(joined), 5000):
            some = joined[at : at + 5000]
            counts[some], found = together([new[k] for k in some])
            order.append(some)
            ids.append(found)
        order, ids = np.concatenate(order), np.concatenate(ids)
        # back to the order asked for
        starts = np.zeros(len(new), dtype=np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        ends = np.cumsum(counts)
        return counts, ids[np.arange(len(ids)) + np.repeat(starts - ends + counts, counts)]

    return Memory(encode, remembered)


def added_tokens(vocabulary: str) -> re.Pattern | None:
    """The strings that the tokenizer file takes out of a text before it is cut into words."""
    added = json.loads(vocabulary).get("added_tokens") or []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that look at their neighbours are not supported")
    return re.compile("(" + "|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) + ")") if added else None


def parts_of(text: str, added: re.Pattern | None) -> list[str]:
    """Segments of a text; added tokens are segments, and no segment goes across them."""
    if added is None or not added.search(text):
        return segments(text)
    return [s for k, part in enumerate(added.split(text)) for s in ([part] if k % 2 else segments(part))]


def cuts(part: str) -> list[str]:
    """Segments of what lies from one blank to the next: lines, and the marks that end them."""
    out = []
    for run in RUNS.findall(part):
        bare = run.rstrip(MARKS)
        if len(bare) < len(run) and bare[-1:].isalnum():  # no token goes on from a letter or digit to a mark
            out += (bare, run[len(bare) :])
        else:
            out.append(run)
    return out


def strings(column: pa.Array, rows: np.ndarray) -> list[str]:
    """The values in these rows; faster than ``to_pylist``."""
    return column.take(pa.array(rows)).to_numpy(zero_copy_only=False).tolist()


def blank_before(column: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise("", column, " ")


def ids_of(texts: pa.Array, memory: Memory, added: re.Pattern | None, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, each with ``end_id`` after it, and where each text ends.

    Arrow splits the texts at blanks and finds their distinct parts, so that Python sees a part once
    for all its places. A text that can't be split there is one part.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    whole = pc.match_substring_regex(texts, UNSAFE)
    if added is not None:
        whole = pc.or_(whole, pc.match_substring_regex(texts, added.pattern))
    at_blanks = pc.split_pattern(pc.if_else(whole, "", texts), " ")
    found = at_blanks.flatten().dictionary_encode()
    lists = np.concatenate([[0], np.cumsum(pc.list_value_length(at_blanks).to_numpy())])
    parts, codes = found.dictionary, found.indices.to_numpy().astype(np.int64)

    # codes: parts after a blank, then first parts, then whole texts
    first = lists[:-1]
    firsts, codes[first] = np.unique(codes[first], return_inverse=True)
    codes[first] += len(parts)
    whole = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    codes[first[whole]] = len(parts) + len(firsts) + np.arange(len(whole))
    times = np.bincount(codes, minlength=len(parts) + len(firsts) + len(whole))

    follows = times[: len(parts)] > 0
    bare = pc.ascii_rtrim(parts, MARKS)
    words = pc.utf8_is_alpha(bare).to_numpy(zero_copy_only=False)
    marked = pc.not_equal(pc.binary_length(bare), pc.binary_length(parts)).to_numpy(zero_copy_only=False)
    simple, ended, other = (np.flatnonzero(follows & x) for x in (words & ~marked, words & marked, ~words))
    more = [[b, p[len(b) :]] for b, p in zip(strings(blank_before(bare), ended), strings(blank_before(parts), ended))]
    more += [cuts(" " + p) for p in strings(parts, other)]
    more += [cuts(p) for p in strings(parts, firsts)]
    more += [parts_of(t, added) for t in strings(texts, whole)]
    order = np.concatenate([simple, ended, other, np.arange(len(parts), len(times))])
    sizes = np.concatenate([np.ones(len(simple), dtype=np.int64), np.fromiter(map(len, more), np.int64, len(more))])
    every = [*strings(blank_before(parts), simple), *chain.from_iterable(more)]
    places = memory.find(every, np.repeat(times[order], sizes))

    # ids of every code, and at last the end
    ids = np.append(memory.tokens(places), np.int32(end_id))
    ends = np.concatenate([[0], np.cumsum(memory.counts[places])])[np.concatenate([[0], np.cumsum(sizes)])]
    starts, counts = np.full(len(times) + 1, len(ids) - 1), np.ones(len(times) + 1, dtype=np.int64)
    starts[order], counts[order] = ends[:-1], np.diff(ends)
    codes = np.insert(codes, lists[1:], len(times))
    sums = np.cumsum(counts[codes])
    out = ids[np.arange(sums[-1] if len(sums) else 0) + np.repeat(starts[codes] - sums + counts[codes], counts[codes])]
    return out, sums[lists[1:] + np.arange(len(texts))]


def cut(docs: DataFrame, path: str, end_id: int, capacity: int, remembered: int) -> DataFrame:
    """Pieces of every document, with the task that made them and their number there."""
    with open(path, encoding="utf-8") as file:
        sent = send(docs, file.read())  # a vocabulary file
    name = f"segments {remembered} {path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, added = kept(name, lambda: memory_of(sent.value, remembered)), added_tokens(sent.value)
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                rows = []
                every, ends = ids_of(batch.column("text"), memory, added, end_id)
                every, at = every.astype("<u4"), 0
                for doc_id, text_hash, end in zip(
                    batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), ends.tolist()
                ):
                    ids, at = every[at:end], end
                    start = 0
                    for n in range(-(-len(ids) // capacity)):
                        stop = start + ((len(ids) - 1) % capacity + 1 if n == 0 else capacity)
                        length = stop - start
                        rows.append((doc_id, text_hash, n, start, length, zlib.crc32(ids[start:stop]), task, seen[length]))
                        seen[length] += 1
                        start = stop
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(lean(run, name), PIECES_DDL)


def packed_pieces(
    docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, remembered: int = 500_000
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and their places.

    doc_id, text_hash (xxhash64 of the text), piece, start, length, ids_crc32, sequence_id,
    offset. ``path`` is a tokenizer file; every document's ids are followed by ``end_id``, so a
    null or empty text is one piece of one token; strings of the file's added tokens have their own
    ids, as the library has it. Longer documents are cut so that only their
    first piece is shorter than ``capacity``. Repeated rows and null ids are packed like
    others; an empty table gives no rows. Other columns are not looked at. A worker remembers the
    tokens of up to ``remembered`` segments, which changes no result.
    """
    made = stage(cut(docs, path, end_id, capacity, remembered), "packing-pieces")  # numbers are fixed once written
    by_task = made.groupBy("length", "task").agg((F.max("number") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stage(
        by_task.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")),
        "packing-firsts",
    )
    histogram = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(pack(histogram, capacity), capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            sequence, offset = places.find(length, batch.column("nth").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(6)], pa.array(sequence), pa.array(offset)],
                names=[*[f.name for f in PIECES][:6], "sequence_id", "offset"],
            )

    of_task = firsts.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("length", "first"))).alias("firsts"))
    nth = F.element_at("firsts", F.col("length")) + F.col("number")
    numbered = made.join(of_task, "task").select(*[f.name for f in PIECES][:6], nth.alias("nth"))
    ddl = PIECES_DDL.split(", task")[0] + ", sequence_id bigint, offset bigint"
    return numbered.mapInArrow(place, ddl)


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return packed_pieces(table(spark, folder, "documents"), path).drop("text_hash")
