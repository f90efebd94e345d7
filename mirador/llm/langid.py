"""Language identification by interpolated Kneser-Ney character models.

One model per language over the letters of lower-cased words, each word between blanks, up to
ORDER characters a gram. Highest-order counts come from a bounded sample of labelled
documents; lower orders use the number of distinct characters seen before a gram. All
languages share one sorted array of gram hashes per order, with the discounted probabilities and
back-off weights of the languages that have the gram. A text gets the language of lowest
cross-entropy per character. The temperature of the score and the entropy above which a text
is rejected are calibrated on sample documents that the models have not seen.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mirador.sources.tables import stage

from .registry import query, table
from .words import GOLDEN, lean, mix, pieces, send

ORDER = 4
#: Stands between words; no word has it.
BLANK = ord(" ")
#: Distinct words, times languages, whose characters are looked up in one go; bounds a task's memory.
WORDS_AT_ONCE = 80_000
#: Numbers, rows times languages, up to which a table is also held in full (16 MB).
FULL_CELLS = 1 << 21
#: Bytes of texts that are looked at in one go; a longer text is looked at alone.
PIECE_BYTES = 2 << 20
UNKNOWN = "und"
#: Every how-many-th sample document calibrates instead of counting.
CALIBRATE = 5

GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
PREDICTED = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
     ("entropy", pa.float64())]
)
PREDICTED_DDL = "doc_id bigint, text_hash bigint, lang_pred string, score double, entropy double"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _letters[0]


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each followed by a blank, with blanks for what is no letter."""
    points = np.frombuffer(" ".join([*words, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(letters()[points], points, np.uint32(BLANK)), np.cumsum([len(w) + 1 for w in words])


def contexts(points: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The last 1, 2, ... characters at each place, blank before the word's own; places that count.

    A place counts if it is a letter or the blank after one.
    """
    before = np.concatenate([[BLANK], points[:-1]]).astype(np.uint32)
    events = (points != BLANK) | (before != BLANK)
    back, inside = [points], np.ones(len(points), dtype=bool)
    for i in range(1, order):
        shifted = np.concatenate([np.full(i, BLANK, dtype=np.uint32), points[:-i] if i < len(points) else points[:0]])
        shifted = shifted[: len(points)]
        inside = inside & (shifted != BLANK)
        back.append(np.where(inside, shifted, np.uint32(BLANK)))
    return back, events


def hashes(back: list[np.ndarray], size: int, skip: int = 0) -> np.ndarray:
    """Hashes of the ``size`` characters that end ``skip`` places before each."""
    with np.errstate(over="ignore"):
        out = np.full(len(back[0]), np.uint64(size) * GOLDEN, dtype=np.uint64)
        for i in range(skip + size - 1, skip - 1, -1):
            out = mix(out * GOLDEN + back[i].astype(np.uint64))
    return out


@dataclass
class Sparse:
    """Numbers by row and language: only those that differ from ``default`` are held."""

    starts: np.ndarray  # of each row, and the end; the last row is empty
    columns: np.ndarray
    values: np.ndarray
    default: float
    full: np.ndarray | None = None  # made where it is used, not sent

    @classmethod
    def of(cls, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, default: float) -> Sparse:
        order = np.lexsort((column, row))
        starts = np.searchsorted(row[order], np.arange(rows + 2))
        return cls(starts, column[order].astype(np.int32), value[order], default)

    def dense(self, rows: np.ndarray, width: int) -> np.ndarray:
        if (len(self.starts) - 1) * width > FULL_CELLS:
            return self.spread(rows, width)
        if self.full is None:
            self.full = self.spread(np.arange(len(self.starts) - 1), width)
        return self.full.take(rows, axis=0)

    def spread(self, rows: np.ndarray, width: int) -> np.ndarray:
        out = np.full((len(rows), width), self.default)
        first, size = self.starts[rows], np.diff(self.starts)[rows]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)
        out[np.repeat(np.arange(len(rows)), size), self.columns[at]] = self.values[at]
        return out


@dataclass
class Models:
    """Sorted gram hashes per order; per gram and language, probability and back-off weight."""

    languages: list[str]
    keys: list[np.ndarray]
    shares: list[Sparse]
    weights: list[Sparse]  # by the order of the context
    floor: np.ndarray
    start: np.ndarray  # weight of the floor under single characters
    temperature: float = 1.0
    most_entropy: float = np.inf

    def find(self, level: int, wanted: np.ndarray) -> np.ndarray:
        """Rows of the grams; the last row is for unseen ones."""
        keys = self.keys[level]
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return np.where(keys[at] == wanted, at, len(keys)) if len(keys) else np.zeros(len(wanted), dtype=np.int64)

    def log_probabilities(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed natural logarithms per word and language, and the number of characters."""
        points, ends = spelled(words)
        back, events = contexts(points, len(self.keys))
        at = np.flatnonzero(events)
        back = [b[at] for b in back]
        width = len(self.languages)
        probability = np.broadcast_to(self.floor, (len(at), width)).astype(np.float64)
        # a place's context is the gram that ends before it, which counts too; blanks at the start of a word
        starts = np.flatnonzero(back[1] == BLANK) if len(back) > 1 else at
        gram = at
        for level in range(len(self.keys)):
            if level:
                context = np.roll(gram, 1)
                context[starts] = self.find(level - 1, hashes([np.array([BLANK], dtype=np.uint32)] * level, level))
                probability *= self.weights[level - 1].dense(context, width)
            else:
                probability *= self.start
            gram = self.find(level, hashes(back, level + 1))
            probability += self.shares[level].dense(gram, width)
        total = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(np.log(probability), axis=0)])
        until = np.searchsorted(at, np.concatenate([[0], ends]))
        return np.diff(total[until], axis=0), np.diff(until)

    def entropies(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text by language, and its characters."""
        split = [t.lower().split() for t in found]
        words = [w for ws in split for w in ws]
        if not words or not self.languages:
            return np.zeros((len(found), len(self.languages))), np.zeros(len(found), dtype=np.int64)
        distinct = list(dict.fromkeys(words))
        number = {w: k for k, w in enumerate(distinct)}
        codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        ends = np.cumsum([0] + [len(ws) for ws in split])
        del split, words, number  # their memory is needed below
        step = max(1, WORDS_AT_ONCE // len(self.languages))
        parts = [self.log_probabilities(distinct[at : at + step]) for at in range(0, len(distinct), step)]
        logs, sizes = (np.concatenate(c) for c in zip(*parts))

        def per_text(of_words: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(of_words[codes])])[ends])

        characters = per_text(sizes)
        total = np.stack([per_text(logs[:, k]) for k in range(logs.shape[1])], axis=1)
        return -total / np.maximum(characters, 1)[:, None], characters

    def predict(self, found: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and cross-entropy; without letters ``und``, 0 and 0."""
        entropy, characters = self.entropies(found)
        if not self.languages:
            return [UNKNOWN] * len(found), np.zeros(len(found)), np.zeros(len(found))
        best = entropy.argmin(axis=1)  # ties: the first in the order of names
        lowest = entropy[np.arange(len(found)), best]
        score = 1 / np.exp((lowest[:, None] - entropy) * self.temperature).sum(axis=1)
        some = characters > 0
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, some)]
        return names, np.where(some, score, 0.0), np.where(some, lowest, 0.0)


def smoothed(counts, order: int) -> Models:
    """Interpolated Kneser-Ney tables from a pandas table of highest-order gram counts (lang, gram, n)."""
    languages = sorted(set(counts["lang"]))
    column = {name: i for i, name in enumerate(languages)}
    counts = counts.assign(lang=[column[name] for name in counts["lang"]])  # numbers are safe to group by
    alphabet = len(set("".join(counts["gram"].str[-1]))) + 1
    levels, frame = [], counts
    for size in range(order, 0, -1):
        levels.insert(0, frame)
        frame = frame.assign(gram=frame["gram"].str[1:]).groupby(["lang", "gram"], as_index=False).size()
        frame = frame.rename(columns={"size": "n"})
    tables = []
    for frame in levels:
        once, twice = ((frame["n"] == k).groupby(frame["lang"]).sum() for k in (1, 2))
        discount = (once / (once + 2 * twice).clip(lower=1)).clip(0.1, 0.9)
        frame = frame.assign(context=frame["gram"].str[:-1], d=frame["lang"].map(discount))
        groups = frame.groupby(["lang", "context"])["n"]
        total = groups.transform("sum")
        frame["share"] = (frame["n"] - frame["d"]).clip(lower=0) / total
        spread = frame.assign(kept=frame["share"]).groupby(["lang", "context"], as_index=False)["kept"].sum()
        tables.append((frame, spread.assign(weight=1 - spread["kept"])))

    def hashed(grams: list[str]) -> np.ndarray:
        size = len(grams[0])
        points = np.array([[ord(c) for c in g] for g in grams], dtype=np.uint64)
        return hashes([points[:, size - 1 - i] for i in range(size)], size)

    keys, shares, weights = [], [], []
    for level, (frame, _) in enumerate(tables):
        following = tables[level + 1][1] if level + 1 < order else None
        grams = sorted(set(frame["gram"]) | (set(following["context"]) if following is not None else set()))
        key = hashed(grams)
        by_key = np.argsort(key)
        row = {grams[k]: i for i, k in enumerate(by_key)}
        held = (frame["gram"].map(row).to_numpy(), frame["lang"].to_numpy(), frame["share"].to_numpy())
        none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        known = none
        if following is not None:
            known = (following["context"].map(row).to_numpy(), following["lang"].to_numpy(), following["weight"].to_numpy())
        keys.append(key[by_key])
        shares.append(Sparse.of(*held, len(grams), 0.0))
        weights.append(Sparse.of(*known, len(grams), 1.0))
    start = tables[0][1].set_index("lang")["weight"].loc[range(len(languages))].to_numpy()
    return Models(languages, keys, shares, weights, np.full(len(languages), 1 / alphabet), start)


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) of all highest-order grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", PIECE_BYTES):
                by_lang: dict[str, Counter] = {}
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                    by_lang.setdefault(lang, Counter()).update((text or "").lower().split())
                for lang, words in by_lang.items():
                    if not words:
                        continue
                    points, ends = spelled(list(words))
                    back, events = contexts(points, order)
                    times = np.fromiter(words.values(), np.int64, len(words))
                    weight = np.repeat(times, np.diff(np.concatenate([[0], ends])))[events]
                    columns = np.stack([b[events] for b in back[::-1]], axis=1)
                    if not len(columns):
                        continue
                    distinct, owner = np.unique(columns, axis=0, return_inverse=True)
                    total = np.bincount(owner.ravel(), weights=weight, minlength=len(distinct)).astype(np.int64)
                    grams = ["".join(map(chr, row)) for row in distinct.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams)), pa.array(grams), pa.array(total)], schema=GRAMS
                    )

    return (
        docs.select("lang", "text")
        .mapInArrow(lean(run), "lang string, gram string, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )


def learn(docs: DataFrame, sample_docs: int = 1000, order: int = ORDER, quantile: float = 0.999, slack: float = 1.25) -> Models:
    """Models of the languages in ``docs`` (doc_id, text, lang).

    A hash of the id draws about ``sample_docs`` whole documents per language, all of smaller
    ones; their number bounds the model. Rows without a lang or without text teach nothing.
    """
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    shares = labelled.groupBy("lang").agg((F.lit(float(sample_docs)) / F.count(F.lit(1))).alias("share"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = stage(
        labelled.join(stage(shares, "language-shares"), "lang").filter(drawn < F.col("share")).select(
            "lang", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0).alias("calibrates")
        ),
        "language-sample",
    )
    counts = count_grams(sample.filter("NOT calibrates"), order).toPandas()
    if not len(counts):  # too few documents to keep some apart
        counts = count_grams(sample, order).toPandas()
    if not len(counts):
        return Models([], [], [], [], np.zeros(0), np.zeros(0))
    models = smoothed(counts, order)
    calibrate(models, sample, quantile, slack)
    return models


def calibrate(models: Models, sample: DataFrame, quantile: float, slack: float) -> None:
    """Set the temperature that fits the labels best, and the entropy of rejection."""
    sent = send(sample, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", PIECE_BYTES):
                entropy, characters = sent.value.entropies([t or "" for t in batch.column("text").to_pylist()])
                keep = characters > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").filter(pa.array(keep)), pa.array(list(entropy[keep]), pa.list_(pa.float64()))],
                    names=["lang", "entropy"],
                )

    rows = sample.filter("calibrates").select("lang", "text").mapInArrow(lean(run), "lang string, entropy array<double>").toPandas()
    rows = rows[rows["lang"].isin(models.languages)]
    if not len(rows):
        return
    entropy = np.stack(rows["entropy"].to_numpy())
    label = rows["lang"].map({name: i for i, name in enumerate(models.languages)}).to_numpy()
    gap = entropy.min(axis=1)[:, None] - entropy

    def loss(temperature: float) -> float:
        logs = gap * temperature - np.log(np.exp(gap * temperature).sum(axis=1))[:, None]
        return -logs[np.arange(len(label)), label].mean()

    models.temperature = float(min(2.0 ** np.arange(-2, 8), key=loss))
    models.most_entropy = float(np.quantile(entropy.min(axis=1), quantile) * slack)


def predictions(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), lang_pred, score, entropy, rejected per row.

    ``docs`` has doc_id and text; other columns are not looked at. A null or empty text, or
    one without letters, is ``und`` with score 0 and rejected; otherwise a text is rejected if
    its entropy is above the calibrated limit. Ties go to the language first by name. Repeated
    rows and null ids are judged like others. Without any learned language every row is
    ``und``. The models' size is bounded by their sample, so they are sent to the workers once.
    """
    sent = send(docs, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", PIECE_BYTES):
                names, score, entropy = sent.value.predict([t or "" for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_hash"), pa.array(names, pa.string()),
                     pa.array(score, pa.float64()), pa.array(entropy, pa.float64())],
                    schema=PREDICTED,
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text")
    limit = models.most_entropy
    return rows.mapInArrow(lean(run), PREDICTED_DDL).withColumn(
        "rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("entropy") > F.lit(limit))
    )


def held_out(doc_id: Column) -> Column:
    """Documents that the models never learn from; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def teachers(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs = table(spark, folder, "documents")
    found = predictions(docs, learn(teachers(docs)))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy", "rejected"
    )
