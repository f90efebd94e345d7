"""Phrase collocations: phrases of two to five words, counted in HAT-tries and scored by their cuts.

Texts are read once, into chunks of tokens with numbers of the chunk's own. A word's id is a
64-bit hash of language and word. Counts are grouped by id, and if a frequent id turns out to
stand for two words, all words are hashed anew with another seed, so ids are as good as the words.

Words, then phrases, are counted size by size: a task counts the phrases of its chunks in one
HAT-trie and gives out sorted runs; runs are cut into parts by a hash of the phrase, travel as
blocks of many phrases each, and are merged part by part. Two sieves keep the rare phrases out of the tries. A phrase can only be frequent if both phrases of one
word less in it are; and only if its cell, 48 bits of its hash, is: cells are counted first, as
sorted and compressed differences, a few bytes each. Either sieve is sent as a bitmap of a fixed
size, in which a false positive costs a count and no more, so the counts are exact and nothing
that is sent to the tasks grows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mirador.sources.tables import stage

from .hattrie import HatTrie, hashed, in_order
from .registry import query, table

#: Bytes that end a piece, and the mark put for them: a byte that no UTF-8 text has.
ENDS, MARK = b".,;:!?\n\x0b\x0c\r", b"\xff"
PLAIN = bytes.maketrans(ENDS + bytes(range(65, 91)), b"\n" * len(ENDS) + bytes(range(97, 123)))
#: Bytes of a text that are split at a time, bytes of a chunk's texts, tokens whose phrases are made at a time.
SLICE, CHUNK_BYTES, WINDOWS = 8 << 20, 64 << 20, 1 << 19
#: Bits of a cell, cells that are sorted at a time, tokens for each part that cells are dealt out to.
CELL_BITS, CELLS, PART_TOKENS = 48, 1 << 21, 1 << 21
#: Phrases of runs that are cut into parts at a time, phrases that are merged at a time, tokens for each part of runs.
RUN_PHRASES, MERGED_PHRASES, RUN_PART_TOKENS = 1 << 18, 1 << 20, 1 << 24

WORD = pa.struct([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
CHUNKS = pa.schema([("tokens", pa.binary()), ("words", pa.list_(WORD))])
CHUNKS_DDL = "tokens binary, words array<struct<id:bigint,lang:string,word:string,n:bigint>>"


def word_id(lang: str, word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(b"%d\xff%b\xff%b" % (seed, lang.encode(), word)) or 1


class Chunk:
    """Tokens of whole texts as numbers; 0 between pieces and texts."""

    def __init__(self, slice_bytes: int = SLICE):
        self.slice_bytes, self.next = slice_bytes, count(1).__next__
        self.numbers: dict[str, dict[bytes, int]] = {}
        self.parts: list[np.ndarray] = [np.zeros(1, dtype=np.int32)]
        self.tokens = self.bytes = 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.numbers:
            self.numbers[lang] = defaultdict(self.next)
            self.numbers[lang][MARK] = 0
        number = self.numbers[lang].__getitem__
        text = text.translate(PLAIN).replace(b"\n", b" " + MARK + b" ")
        start = 0
        while start < len(text):
            end = text.find(b" ", start + self.slice_bytes)
            end = len(text) if end < 0 else end
            found = text[start:end].split()
            self.parts.append(np.fromiter(map(number, found), np.int32, len(found)))
            self.tokens += len(found)
            start = end
        self.parts.append(np.zeros(1, dtype=np.int32))
        self.bytes += len(text)

    def row(self, identify: Callable[[str, bytes], int]) -> pa.RecordBatch:
        """Tokens, and the chunk's words in the order of their numbers 1, 2 ..."""
        tokens = np.concatenate(self.parts)
        self.parts = []
        pos, langs, words, ids = [], [], [], []
        for place, (lang, numbers) in enumerate(self.numbers.items()):
            del numbers[MARK]
            pos += numbers.values()
            words += numbers
            langs += [place] * len(numbers)
            ids += [identify(lang, w) for w in numbers]
        order = pa.array(np.argsort(np.array(pos, dtype=np.int64)))
        named = pa.DictionaryArray.from_arrays(pa.array(langs, pa.int32()), pa.array(list(self.numbers), pa.string()))
        columns = [
            pa.array(np.array(ids, dtype=np.uint64).view(np.int64)).take(order),
            named.cast(pa.string()).take(order),
            pa.array(words, pa.binary()).cast(pa.string()).take(order),
            pa.array(np.bincount(tokens, minlength=len(pos) + 1)[1:], pa.int64()),
        ]
        listed = pa.ListArray.from_arrays(pa.array([0, len(pos)], pa.int32()), pa.StructArray.from_arrays(columns, fields=list(WORD)))
        return pa.RecordBatch.from_arrays([pa.array([zstandard.compress(tokens, 1)], pa.binary()), listed], schema=CHUNKS)


def chunked(
    batches: Iterator[pa.RecordBatch], identify: Callable[[str, bytes], int], chunk_tokens: int
) -> Iterator[pa.RecordBatch]:
    """Chunks of a task's rows (lang, text)."""
    chunk = Chunk()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for place, lang in enumerate(batch.column("lang").to_pylist()):
            text = texts[place].as_py()
            if text:
                chunk.add(lang, text)
            # every text may be new words, so its bytes bound those of the words
            if chunk.tokens >= chunk_tokens or chunk.bytes >= CHUNK_BYTES:
                yield chunk.row(identify)
                chunk = Chunk()
    if chunk.tokens:
        yield chunk.row(identify)


def spots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the hash of each key is in a bitmap of 2 ** bits bits."""
    return hashed(keys) >> np.uint64(64 - bits)


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bitmap has each key."""
    spot = spots(keys, len(bits).bit_length() + 5)
    return bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1) != 0


def phrases_in(ids: np.ndarray, size: int, shorter: np.ndarray | None) -> np.ndarray:
    """Phrases of ``size`` ids, where the bitmap has both phrases of one id less."""
    windows = len(ids) - size + 1
    whole = np.ones(max(0, windows), dtype=bool)
    for i in range(size):
        whole &= ids[i : windows + i] != 0 if windows > 0 else whole
    at = np.flatnonzero(whole)
    for skip in (0, 1) if shorter is not None else ():
        at = at[marked(shorter, np.stack([ids[at + i + skip] for i in range(size - 1)]))]
    return np.stack([ids[at + i] for i in range(size)])


def streams_of(batch: pa.RecordBatch, frequent_words: np.ndarray, overlap: int) -> Iterator[np.ndarray]:
    """Ids of the tokens of each chunk of (tokens, ids), slice by slice; 0 for rare words and ends of pieces."""
    for raw, own in zip(batch.column("tokens"), batch.column("ids")):
        tokens = np.frombuffer(zstandard.decompress(raw.as_py()), dtype=np.int32)
        ids = own.values.to_numpy().view(np.uint64)
        known = np.concatenate([np.zeros(1, dtype=np.uint64), np.where(marked(frequent_words, ids[None]), ids, np.uint64(0))])
        for start in range(0, len(tokens), WINDOWS):
            yield known[tokens[start : start + WINDOWS + overlap]]


def keys_of(size: int) -> list[str]:
    return [f"id_{i}" for i in range(size)]


def cells_of(phrases: np.ndarray) -> np.ndarray:
    return hashed(phrases) >> np.uint64(64 - CELL_BITS)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits, the first bytes of all, then the second ones, compressed: small ones take little room."""
    return zstandard.compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (a column each) in order, and the sums of their counts."""
    order = in_order(keys) if len(keys) > 1 else np.argsort(keys[0])
    keys, counts = keys[:, order], counts[order]
    new = np.ones(len(counts), dtype=bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    return keys[:, first], np.add.reduceat(counts, first) if len(first) else counts


def dealt(cells: np.ndarray, part_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, cells, counts) of unordered cells, a part being a range of cells."""
    cells, counts = np.unique(cells, return_counts=True)
    parts, starts = np.unique(cells >> np.uint64(CELL_BITS - part_bits), return_index=True)
    ends = [*starts[1:], len(cells)]
    columns = [
        pa.array(parts.view(np.int64)),
        pa.array([packed(np.diff(cells[a:b], prepend=np.uint64(0))) for a, b in zip(starts, ends)], pa.binary()),
        pa.array([packed(counts[a:b]) for a, b in zip(starts, ends)], pa.binary()),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=["part", "cells", "counts"])


def merged(
    batches: Iterator[pa.RecordBatch], opened: Callable[[bytes], np.ndarray], names: list[str], min_count: int, at_once: int
) -> Iterator[pa.RecordBatch]:
    """Keys and their counts, if they add up to ``min_count``, of rows (part, keys, counts) that come part by part."""
    none = np.zeros((len(names) - 1, 0), dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    held, waiting, number, now = none, [], 0, None

    def summed() -> tuple[np.ndarray, np.ndarray]:
        return totals(*(np.concatenate(column, axis=-1) for column in zip(held, *waiting)))

    def ended() -> pa.RecordBatch:
        keys, counts = summed()
        columns = [*keys[:, counts >= min_count], counts[counts >= min_count]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names=names)

    for batch in batches:
        for part, keys, counts in zip(*batch.columns):
            if part.as_py() != now:
                yield ended()
                held, waiting, number, now = none, [], 0, part.as_py()
            waiting.append((opened(keys.as_py()), unpacked(counts.as_py())))
            number += len(waiting[-1][1])
            if number >= at_once:
                held, waiting, number = summed(), [], 0
    yield ended()


def opened_cells(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)[None]


def frequent_in(batches: Iterator[pa.RecordBatch], min_count: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Cells whose counts add up to ``min_count``, of rows that come part by part."""
    for batch in merged(batches, opened_cells, ["id_0", "a"], min_count, at_once):
        yield batch.select(["id_0"])


def frequent_cells(
    chunks: DataFrame, size: int, words: np.ndarray, shorter: np.ndarray | None, min_count: int, tokens: int, cells_at_once: int
) -> DataFrame:
    """(id_0): the cells that phrases of ``size`` words fall into ``min_count`` times or more.

    A task holds up to ``cells_at_once`` cells, and of a part, which is one for every PART_TOKENS
    tokens, its distinct ones. A cell comes once for each ``cells_at_once`` cells of a task, however
    frequent it is.
    """
    sent = chunks.sparkSession.sparkContext.broadcast((words, shorter))
    part_bits = min(CELL_BITS - 1, (tokens // PART_TOKENS).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, number = [], 0
        for batch in batches:
            for ids in streams_of(batch, sent.value[0], size - 1):
                waiting.append(cells_of(phrases_in(ids, size, sent.value[1])))
                number += len(waiting[-1])
                if number >= cells_at_once:
                    yield from dealt(np.concatenate(waiting), part_bits)
                    waiting, number = [], 0
        if number:
            yield from dealt(np.concatenate(waiting), part_bits)

    rows = chunks.select("tokens", F.col("words.id").alias("ids")).mapInArrow(run, "part bigint, cells binary, counts binary")
    rows = rows.repartition("part").sortWithinPartitions("part")
    found = stage(rows.mapInArrow(partial(frequent_in, min_count=min_count, at_once=2 * CELLS), "id_0 bigint"), f"cells-{size}")
    sent.destroy()
    return found


def closed_phrases(phrases: np.ndarray) -> bytes:
    """Phrases as bytes: the differences of their first ids, then their other ids, column by column."""
    return packed(np.concatenate([np.diff(phrases[0], prepend=np.uint64(0)), *phrases[1:]]))


def opened_phrases(raw: bytes, size: int) -> np.ndarray:
    phrases = unpacked(raw).reshape(size, -1)
    phrases[0] = np.cumsum(phrases[0], dtype=np.uint64)
    return phrases


def blocks(runs: Iterator[tuple[np.ndarray, np.ndarray]], part_bits: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, phrases, counts) of sorted runs, about ``at_once`` phrases at a time; a part is a range of cells."""

    def cut(waiting: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        waiting.sort(key=lambda run: int(run[0][0, 0]))  # runs of one trie follow each other
        phrases, counts = (np.concatenate(column, axis=-1) for column in zip(*waiting))
        part = (cells_of(phrases) >> np.uint64(CELL_BITS - part_bits)).view(np.int64)
        order = np.argsort(part, kind="stable")
        parts, starts = np.unique(part[order], return_index=True)
        chosen = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
        columns = [
            pa.array(parts),
            pa.array([closed_phrases(phrases[:, c]) for c in chosen], pa.binary()),
            pa.array([packed(counts[c]) for c in chosen], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["part", "phrases", "counts"])

    waiting, number = [], 0
    for run in runs:
        waiting.append(run)
        number += len(run[1])
        if number >= at_once:
            yield cut(waiting)
            waiting, number = [], 0
    if number:
        yield cut(waiting)


def frequent_phrases(batches: Iterator[pa.RecordBatch], size: int, min_count: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Phrases whose counts add up to ``min_count``, of rows that come part by part."""
    return merged(batches, partial(opened_phrases, size=size), [*keys_of(size), "a"], min_count, at_once)


def counted(
    chunks: DataFrame, size: int, words: np.ndarray, cells: np.ndarray, min_count: int, tokens: int, trie_phrases: int
) -> DataFrame:
    """(id_0 ..., a) of the phrases of ``size`` words in these cells that come ``min_count`` times or more.

    A task counts each phrase of its own texts once, in its trie, and all counts of a part, one for
    every RUN_PART_TOKENS tokens, are merged in one task, MERGED_PHRASES at a time.
    """
    sent = chunks.sparkSession.sparkContext.broadcast((words, cells))
    part_bits = min(CELL_BITS - 1, (tokens // RUN_PART_TOKENS).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            trie = HatTrie(size, trie_phrases)
            for batch in batches:
                for ids in streams_of(batch, sent.value[0], size - 1):
                    phrases = phrases_in(ids, size, None)
                    yield from trie.add(phrases[:, marked(sent.value[1], cells_of(phrases)[None])])
            yield from trie.rest()

        yield from blocks(runs(), part_bits, RUN_PHRASES)

    rows = chunks.select("tokens", F.col("words.id").alias("ids"))
    rows = rows.mapInArrow(run, "part bigint, phrases binary, counts binary")
    rows = rows.repartition("part").sortWithinPartitions("part")
    merge = partial(frequent_phrases, size=size, min_count=min_count, at_once=MERGED_PHRASES)
    found = stage(rows.mapInArrow(merge, ", ".join(f"{c} bigint" for c in [*keys_of(size), "a"])), f"phrases-{size}")
    sent.destroy()
    return found


def bitmap(found: DataFrame, size: int, bits: int) -> np.ndarray:
    """The hashes of all phrases in 2 ** bits bits, as an array of numbers of 64 bits."""
    names = keys_of(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = spots(np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names]), bits)
            one = (np.uint64(1) << (spot & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((spot >> np.uint64(6)).view(np.int64)), pa.array(one)], names=["cell", "bits"])

    cells = found.select(*names).mapInArrow(run, "cell bigint, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    held = cells.toArrow()  # at most one row per cell
    out[held.column("cell").to_numpy()] = held.column("bits").to_numpy().view(np.uint64)
    return out


def read(docs: DataFrame, min_count: int, chunk_tokens: int, identify: Callable[[str, bytes, int], int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks; (id, a, lang, word) of the frequent words; (lang, n)."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    rows = docs.select(lang, "text")
    for seed in count():
        run = partial(chunked, identify=partial(identify, seed=seed), chunk_tokens=chunk_tokens)
        chunks = stage(rows.mapInArrow(run, CHUNKS_DDL), "phrase-chunks")
        seen = chunks.select(F.explode("words").alias("w")).select("w.*")
        named = F.struct("lang", "word")
        words = seen.groupBy("id").agg(F.sum("n").alias("a"), F.min(named).alias("least"), F.max(named).alias("most"))
        words = stage(words.filter(F.col("a") >= min_count), "phrase-words")
        if words.filter("least <> most").isEmpty():
            langs = stage(seen.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-langs")
            return chunks, words.select("id", "a", "least.*"), langs


def frequent(
    chunks: DataFrame, words: DataFrame, tokens: int, min_count: int, longest: int, trie_phrases: int, bits: int, cells_at_once: int
) -> DataFrame:
    """(words, a) of all frequent phrases of one word or more."""
    found = [words.select(F.array("id").alias("words"), "a")]
    shorter = known = bitmap(words.withColumnRenamed("id", "id_0"), 1, bits)
    for size in range(2, longest + 1):
        # the frequent words are applied to the tokens themselves
        cells = frequent_cells(chunks, size, known, shorter if size > 2 else None, min_count, tokens, cells_at_once)
        level = counted(chunks, size, known, bitmap(cells, 1, bits), min_count, tokens, trie_phrases)
        if level.isEmpty():
            break  # nor is there any longer one
        found.append(level.select(F.array(*keys_of(size)).alias("words"), "a"))
        shorter = bitmap(level, size, bits)
    return reduce(DataFrame.unionByName, found)


def collocations(
    docs: DataFrame,
    min_count: int = 100,
    longest: int = 5,
    absorbed: int = 100,
    most: int | None = 2000,
    trie_phrases: int = 1_000_000,
    chunk_tokens: int = 4_000_000,
    bitmap_bits: int = 26,
    cells_at_once: int = CELLS,
    identify: Callable[[str, bytes, int], int] = word_id,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the collocations of each language, best first.

    ``docs``: text and lang. A-Z are lower-cased, texts are split at ``.,;:!?`` and line ends into
    pieces and those at blanks and tabs into words. A candidate is a phrase of 2 to ``longest``
    words that occurs a >= ``min_count`` times within pieces, overlaps included. Cut after its
    first words, l and r are the counts of its two parts and floor(1000 a n / (l r)) is the score,
    where n is the number of words of the language; the cut of the lowest score counts, of equal
    ones the earliest. Candidates inside a longer one that occurs at least ``absorbed`` per cent as
    often are dropped. The first ``most`` of each language are returned by score, then a, both
    descending, then the phrase in byte order; ``None`` returns all. The last five parameters bound
    the memory of tasks and name words; they change no result.

    Null and empty texts have no words. A null lang is ``und``; an empty one is a language. Every
    row counts, repeated ones too. Very long texts are read whole, slice by slice, and pieces go
    on across slices. An empty table gives no rows. Other columns are not looked at.
    """
    chunks, words, langs = read(docs, min_count, chunk_tokens, identify)
    tokens = langs.agg(F.sum("n")).first()[0] or 0
    phrases = stage(frequent(chunks, words, tokens, min_count, longest, trie_phrases, bitmap_bits, cells_at_once), "phrases")
    words = words.drop("a")
    size = F.size("words")
    candidates = phrases.filter(size > 1)

    # a phrase occurs at most as often as one in it, so of the longer ones those by a word decide
    ends = F.explode(F.array(F.slice("words", 1, size - 1), F.slice("words", 2, size - 1))).alias("inner")
    longer = candidates.filter(size > 2).select(ends, F.col("a").alias("outer")).groupBy("inner").agg(F.max("outer").alias("outer"))
    dropped = longer.join(candidates, F.col("inner") == F.col("words")).filter(
        F.col("outer") * 100 >= F.col("a") * absorbed
    )
    kept = stage(candidates.join(dropped.select("words"), "words", "left_anti"), "phrases-kept")

    named = (
        kept.select("words", F.posexplode("words").alias("pos", "id"))
        .join(words, "id")
        .groupBy("words")
        .agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("spelled"))
        .select("words", "lang", F.array_join(F.transform("spelled", lambda w: w["word"]), " ").alias("phrase"))
    )
    count_of = lambda part, name: phrases.select(F.col("words").alias(part), F.col("a").alias(name))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(count_of("left", "l"), "left").join(count_of("right", "r"), "right")
    cuts = cuts.join(named, "words").join(langs, "lang")
    wide = {c: F.col(c).cast("decimal(20,0)") for c in ("a", "l", "r", "n")}
    score = F.expr("thousandfold div parts")
    cuts = cuts.withColumns({"thousandfold": wide["a"] * wide["n"] * 1000, "parts": wide["l"] * wide["r"]}).withColumn("score", score)
    lowest = cuts.groupBy("words").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "lang", "phrase")).alias("cut")).select("cut.*")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(best).cast("bigint"))
    ranked = ranked if most is None else ranked.filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents WHERE text IS NOT NULL)),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM words GROUP BY lang),
starts AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
grams AS (
  SELECT lang, ws, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS size FROM starts),
counted AS (
  SELECT lang, phrase, len(phrase) AS size, count(*) AS f
  FROM (SELECT lang, ws[i : i + size - 1] AS phrase FROM grams) GROUP BY lang, phrase HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, f, size, unnest(range(1, size)) AS k FROM counted WHERE size > 1),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n, c.k,
         ((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN totals t USING (lang)
  JOIN counted x ON x.lang = c.lang AND x.phrase = c.phrase[1 : c.k]
  JOIN counted y ON y.lang = c.lang AND y.phrase = c.phrase[c.k + 1 : c.size]),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, f, phrase[i : i + s - 1] AS phrase
  FROM (SELECT lang, phrase, f, size, s, unnest(range(1, size - s + 2)) AS i
        FROM (SELECT *, unnest(range(2, size)) AS s FROM counted)))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank
  FROM lowest b WHERE NOT EXISTS (
    SELECT 1 FROM inner_phrases i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 100 * b.a))
WHERE rank <= 2000
"""


@query("op11_hat_trie_collocations", SQL)
def op11_hat_trie_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best 2000 phrases of each language over all documents."""
    return collocations(table(spark, folder, "documents"))
