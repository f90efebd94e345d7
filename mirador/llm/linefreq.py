"""Quality rules with cross-document line frequency.

Base rules look at one text. The method looks at lines across documents: normalised lines
are hashed, the distinct documents of a line are counted per host (the ``source`` column),
lines above the limits are removed from the texts, and a document most of whose words were in such
lines is rejected as depleted. Texts are read twice: for the counts, and to cut the lines.

Documents are distinct by a hash of their whole text, lower-cased and with single blanks, so that
copies of one text count once and do not turn its lines into boilerplate, and pages that share all
but a few words count each. A removed line stays in the first document of its host that has
it, so that one of many near copies is left for later stages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from mirador.sources.tables import stage

from .registry import query, table
from .words import lean, mix, pieces, send, texts, windows, word_hashes

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
DIGITS = bytes.maketrans(b"123456789", b"000000000")
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
LINES = pa.schema(
    [("doc_id", pa.int64()), ("host", pa.string()), ("text_hash", pa.int64()), ("content", pa.int64()), ("lines", pa.list_(pa.int64()))]
)
LINES_DDL = "doc_id bigint, host string, text_hash bigint, content bigint, lines array<bigint>"
#: Frequent lines that every task may hold; more are joined to their documents by a shuffle.
LOOKUP_LINES = 200_000

#: Of each host, its frequent lines and the first document of each.
Lookup = dict[str, dict[int, int | None]]


def sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Totals of consecutive runs that end at ``ends``."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[np.concatenate([[0], ends])])


def of_bytes(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in words, and symbols, of each text."""
    data = np.frombuffer(b"".join(found), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in found])
    in_word, symbol = np.ones(256, dtype=np.uint8), np.zeros(256, dtype=np.uint8)
    in_word[0x80:0xC0] = 0  # bytes that continue a code point
    in_word[list(BLANKS)] = 0
    symbol[list(SYMBOLS)] = 1
    return sums(in_word[data], ends), sums(symbol[data], ends)


def repeats(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Words inside 3-word windows that come twice or more in their text."""
    found, counts = windows(hashes, starts, lengths, 3)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(lengths)), counts)
    keyed = found ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keyed, kind="stable")
    same = np.zeros(len(found), dtype=bool)
    pair = keyed[order][1:] == keyed[order][:-1]
    same[order[1:][pair]] = True
    same[order[:-1][pair]] = True
    at = (np.arange(len(found)) - np.repeat(ends - counts, counts) + np.repeat(starts, counts))[same]
    covered = np.zeros(len(hashes), dtype=bool)
    for i in range(3):
        covered[at + i] = True
    return sums(covered, np.cumsum(lengths))


def line_key(parts: list[bytes]) -> int:
    """Hash of a normalised line, from its words."""
    key = xxhash.xxh3_64_intdigest(b" ".join(parts).lower().translate(DIGITS))
    return key - (1 << 64) if key >> 63 else key


def lines_of(text: bytes) -> list[int]:
    """Distinct normalised lines."""
    return list({line_key(parts) for line in text.split(b"\n") if (parts := line.split())})


def cut(text: bytes, gone: Callable[[int], bool] | None) -> tuple[int, int, bytes]:
    """Lines equal to an earlier one; words in lines that are gone; the text without those."""
    seen, again, removed, left = set(), 0, 0, []
    for line in text.split(b"\n"):
        parts = line.split()
        if parts:
            again += line in seen
            seen.add(line)
            if gone and gone(line_key(parts)):
                removed += len(parts)
                continue
        left.append(line)
    return again, removed, b"\n".join(left) if removed else text


def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = texts(batch.column("text"))
    contents = word_hashes([b" ".join(t.split()).lower() for t in found])
    return pa.RecordBatch.from_arrays(
        [
            *[batch.column(c) for c in ("doc_id", "host", "text_hash")],
            pa.array(contents.view(np.int64)),
            pa.array(map(lines_of, found), LINES.field("lines").type),
        ],
        schema=LINES,
    )


def removals(batch: pa.RecordBatch, lookup: Lookup | None) -> Iterator[Callable[[int], bool] | None]:
    """For each row, whether a line is removed from it; None if none is."""
    if lookup is None:
        for lines in batch.column("cut").to_pylist():
            yield set(lines).__contains__ if lines else None
    else:
        for doc_id, host in zip(batch.column("doc_id").to_pylist(), batch.column("host").to_pylist()):
            first = lookup.get(host)
            yield first and (lambda key, first=first, doc_id=doc_id: key in first and (doc_id is None or first[key] != doc_id))


def measure(batch: pa.RecordBatch, lookup: Lookup | None) -> pa.RecordBatch:
    found = texts(batch.column("text"))
    split = [t.split() for t in found]
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    hashes = word_hashes([w for ws in split for w in ws])
    chars, symbols = of_bytes(found)
    repeated = repeats(hashes, np.cumsum(lengths) - lengths, lengths)
    again, removed, left = zip(*map(cut, found, removals(batch, lookup)))
    known = batch.column("text").is_valid().to_pylist()
    counts = [lengths, chars, symbols, again, repeated, removed]
    return pa.RecordBatch.from_arrays(
        [
            *[batch.column(c) for c in ("doc", "doc_id", "text_hash")],
            *[pa.array(c, pa.int64()) for c in counts],
            pa.array([t if k else None for t, k in zip(left, known)], pa.binary()).view(pa.string()),
        ],
        names=["doc", "doc_id", "text_hash", *COLUMNS, "removed_words", "text"],
    )


def in_pieces(function: Callable[[pa.RecordBatch], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                yield function(batch)

    return lean(run)


def keyed(docs: DataFrame, host: str, *more: Column) -> DataFrame:
    return docs.select(
        *more,
        F.col("doc_id").cast("bigint"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.xxhash64("text").alias("text_hash"),
        "text",
    )


def frequent_lines(rows: DataFrame, line_docs: int, line_share: float, least_docs: int) -> DataFrame:
    """(host, line, first_id) of the lines above the limits."""
    lines = rows.select("doc_id", "host", "content", F.explode("lines").alias("line"))
    limits = rows.groupBy("host", "content").agg(F.lit(1).alias("one")).groupBy("host").agg(
        F.least(
            F.lit(float(line_docs)), F.greatest(F.lit(float(least_docs)), F.count("one") * F.lit(line_share))
        ).alias("most")
    )
    # documents of a line: equal contents first, so that a frequent line is counted in parts
    return (
        lines.groupBy("host", "line", "content")
        .agg(F.min("doc_id").alias("first_id"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("documents"), F.min("first_id").alias("first_id"))
        .filter(F.col("documents") > min(line_docs, least_docs))
        .join(limits, "host")
        .filter("documents > most")
        .select("host", "line", "first_id")
    )


def cleaned(
    docs: DataFrame,
    host: str = "source",
    line_docs: int = 50,
    line_share: float = 0.1,
    least_docs: int = 5,
    keep_first: bool = True,
    depleted: float = 0.3,
    min_words: int = 50,
    repeat_percent: int = 50,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text and the ``host`` column), with its remaining text.

    doc (the row's columns but the text, as they are), doc_id, text_hash (xxhash64 of the text
    given), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, text
    (without the removed lines), base_failed, kept. A line is removed if more than ``line_docs``
    distinct documents of its host have it or, in a small host, more than the share ``line_share``
    of them and than ``least_docs``; with ``keep_first`` it stays in the first of them. A
    document is depleted if less than the share ``depleted`` of its words remains. The counts but
    removed_words, and the base rules, are those of the text given.

    Null and empty texts have no words and fail the base rules; they stay as they are. Null hosts
    and empty ones are one host. Repeated rows are judged each and count as one document. A line's
    first document is the one with the smallest doc_id; rows with a null doc_id are first nowhere.
    Very long texts are read whole. An empty table gives no rows.
    """
    rows = stage(keyed(docs, host).mapInArrow(in_pieces(listed), LINES_DDL), "line-lists")
    frequent = frequent_lines(rows, line_docs, line_share, least_docs)
    if not keep_first:
        frequent = frequent.withColumn("first_id", F.lit(None).cast("bigint"))
    frequent = stage(frequent, "line-frequent")
    whole = keyed(docs, host, F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("doc"))
    lookup = None
    if frequent.count() <= LOOKUP_LINES:
        lookup = {}
        for name, line, first_id in frequent.collect():
            lookup.setdefault(name, {})[line] = first_id
    else:
        names = ["host", "doc_id", "text_hash"]
        cuts = (
            rows.select(*names, F.explode("lines").alias("line"))
            .join(frequent, ["host", "line"])
            .filter(F.col("doc_id").isNull() | F.col("first_id").isNull() | (F.col("doc_id") != F.col("first_id")))
            .groupBy(*names)
            .agg(F.collect_set("line").alias("cut"))
        )
        cuts = stage(cuts.select(*[F.col(c).alias(f"cut_{c}") for c in names], "cut"), "line-cuts")
        same = [F.col(c).eqNullSafe(F.col(f"cut_{c}")) for c in names]
        whole = whole.join(cuts, same, "left").drop(*[f"cut_{c}" for c in names])
    shared = send(docs, lookup)
    schema = StructType([whole.schema["doc"]])
    for c in ["doc_id", "text_hash", *COLUMNS, "removed_words"]:
        schema = schema.add(c, "long")
    base_failed = (F.col("n_words") < min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(repeat_percent) * F.col("n_words")
    )
    left = F.col("n_words") - F.col("removed_words")
    return (
        whole.mapInArrow(in_pieces(lambda batch: measure(batch, shared.value)), schema.add("text", "string"))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= F.lit(depleted) * F.col("n_words")))
    )


def quality(docs: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """The columns of ``cleaned`` (see there, also for ``limits``) without doc and text."""
    return cleaned(docs.select(*dict.fromkeys(["doc_id", "text", host])), host, **limits).drop("doc", "text")


@query("op8_line_frequency")
def op8_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Base rules and line frequency of all documents, by source."""
    return quality(table(spark, folder, "documents").select("doc_id", "text", "source")).drop("text_hash")
