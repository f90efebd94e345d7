"""Hard-negative mining by Kronecker-packed integer products.

Vectors are scaled to integers. For one dimension, the components of many candidates are shifted
to be non-negative and written side by side into the fields of one wide integer; a field is as
wide as the largest inner product can get, in whole bytes. Multiplying that integer by one
component of an anchor multiplies all fields at once, and the sum over the dimensions has in each
field the inner product of one candidate, which is read out and freed of the shifts exactly.

Candidates and anchors are dealt out in blocks, each pair of blocks is one group, and a group
returns a bounded list per anchor. The lists of the positives come first; candidates of a block
are sorted by label, so that the first round multiplies only those of the anchor's label and the
second only the others: every product is made once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from mirador.sources.tables import stage

from .registry import query, table

#: Candidates in one wide integer.
FIELDS = 4096
LONG = 1 << 63

POSITIVES = pa.schema([("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
NEGATIVES = pa.schema(
    [("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()),
     ("score", pa.int64())]
)


def finite(vector: Column) -> Column:
    """Not null and no null or non-finite component."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(fine(x), F.lit(False))), F.lit(False))


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x); components beyond 62 bits are refused."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    scaled = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
    if len(scaled) and np.abs(scaled).max(initial=0) >= 1 << 62:
        raise OverflowError("a scaled component does not fit 62 bits")
    return scaled.astype(np.int64)


class Packed:
    """Candidates, up to FIELDS of them, as one wide integer per dimension."""

    def __init__(self, rows: np.ndarray, anchor_least: int, anchor_most: list[int]):
        self.least, self.anchor_least, self.number = int(rows.min(initial=0)), anchor_least, len(rows)
        shifted = rows - self.least
        largest = sum(map(mul, anchor_most, shifted.max(axis=0, initial=0).tolist()))
        self.bytes = max(1, -(-largest.bit_length() // 8))
        # whether all terms of a product stay far below 64 bits
        terms = max(map(int, (rows.max(initial=0), -self.least))) * (sum(anchor_most) + len(anchor_most) * abs(anchor_least))
        self.plain = self.bytes < 8 and terms < 1 << 61
        self.sums = rows.sum(axis=1) if self.plain else np.array([sum(r) for r in rows.tolist()], dtype=object)
        self.wide = [self.pack(column) for column in shifted.T]

    def pack(self, column: np.ndarray) -> int:
        raw = np.ascontiguousarray(column.astype("<u8")).view(np.uint8).reshape(-1, 8)
        fields = np.zeros((len(raw), self.bytes), dtype=np.uint8)
        fields[:, : min(8, self.bytes)] = raw[:, : self.bytes]
        return int.from_bytes(fields.tobytes(), "little")

    def products(self, shifted: list[int], shift: int) -> np.ndarray:
        """Inner products of all candidates with an anchor; ``shifted``: its components less their least.

        With candidate c = c' + least and anchor a = a' + anchor_least, a * c is the field's a' * c'
        and least * sum(a') + anchor_least * sum(c), where ``shift`` is sum(a').
        """
        total = sum(map(mul, shifted, self.wide))
        raw = np.frombuffer(total.to_bytes(self.bytes * self.number, "little"), dtype=np.uint8)
        raw = raw.reshape(self.number, self.bytes)
        if self.plain:
            padded = np.zeros((self.number, 8), dtype=np.uint8)
            padded[:, : self.bytes] = raw
            return padded.view("<i8").ravel() + (self.least * shift + self.anchor_least * self.sums)
        fields = [int.from_bytes(f.tobytes(), "little") for f in raw]
        exact = [f + self.least * shift + self.anchor_least * s for f, s in zip(fields, self.sums.tolist())]
        if any(not -LONG <= x < LONG for x in exact):
            raise OverflowError("an inner product does not fit 64 bits")
        return np.array(exact, dtype=np.int64)


class Block:
    """Candidates of a group, sorted by label and id, and the anchors that meet them."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table, width: int, scale: int):
        order = np.lexsort((candidates.column("vec_id").to_numpy(), candidates.column("label").to_numpy()))
        self.ids, self.labels = (candidates.column(c).to_numpy()[order] for c in ("vec_id", "label"))
        rows = integers(candidates.column("vector"), width, scale)[order]
        asked = integers(anchors.column("vector"), width, scale)
        self.anchor_ids, self.anchor_labels = (anchors.column(c).to_numpy() for c in ("vec_id", "label"))
        least = int(asked.min(initial=0))
        self.shifted = [[x - least for x in a] for a in asked.tolist()]
        most = [int(x) - least for x in asked.max(axis=0, initial=least)] if len(asked) else [0] * width
        cuts = np.flatnonzero(np.diff(self.labels)) + 1
        self.parts = []
        for at, until in zip([0, *cuts], [*cuts, len(rows)]):
            for start in range(at, until, FIELDS):
                part = slice(start, min(start + FIELDS, until))
                self.parts.append((self.labels[start], part, Packed(rows[part], least, most)))

    def scores(self, place: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the candidates with the anchor's label, or of the others; not its own."""
        shifted, label = self.shifted[place], self.anchor_labels[place]
        shift = sum(shifted)
        taken = [(self.ids[part], packed.products(shifted, shift)) for own, part, packed in self.parts if (own == label) == same]
        if not taken:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        ids, scores = (np.concatenate(x) for x in zip(*taken))
        other = ids != self.anchor_ids[place]
        return ids[other], scores[other]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    places = np.arange(len(ids))
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)  # with ties
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def positives_of(block: Block, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    for place, anchor in enumerate(block.anchor_ids):
        ids, scores = block.scores(place, same=True)
        at = best(ids, scores, k)
        yield np.full(len(at), anchor), ids[at], scores[at]


def negatives_of(block: Block, known: pa.Table, k: int, low: int, high: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each anchor and positive, the first negatives between the two shares of its score."""
    for place, (anchor, positives) in enumerate(zip(block.anchor_ids, known.column("positives").to_pylist())):
        if not positives:
            continue
        ids, scores = block.scores(place, same=False)
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        for positive in positives:
            score = positive["score"]
            # 30 p <= 100 n <= 90 p for shares of 30 and 90: n from ceil(30 p / 100) to floor(90 p / 100)
            first = np.searchsorted(-scores, -(high * score // 100), side="left")
            last = np.searchsorted(-scores, low * -score // 100, side="right")
            at = slice(first, max(first, min(last, first + k)))
            number = len(ids[at])
            yield np.full(number, anchor), np.full(number, positive["vec_id"]), np.full(number, score), ids[at], scores[at]


def table_of(columns: Iterator[tuple[np.ndarray, ...]], schema: pa.Schema) -> pa.Table:
    parts = list(columns)
    if not parts:
        return schema.empty_table()
    return pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*parts), schema)], schema=schema)


def mined(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    block_rows: int = 8192,
    anchor_rows: int = 8192,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, embedding, label. Components become floor(scale * x), and a score is the
    exact inner product of two such vectors. An anchor's positives are its ``positives`` best other
    rows of its label; of each, the ``negatives`` best rows of another label whose score is from
    ``low`` to ``high`` per cent of the positive's are returned, ranked from 1. Ties go to the
    smaller id. A positive with a negative score, or without such rows, returns nothing.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part;
    zero vectors do. Vectors meet those of their own length. Rows of one id count once, with their
    least label and vector. A scaled component beyond 62 bits, or a score beyond 64, is an error.
    An empty table gives no rows. Other columns are not looked at.
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    once = F.min(F.struct("label", "vector", "is_anchor")).alias("row")
    rows = stage(rows.groupBy("vec_id").agg(once).select("vec_id", "row.*"), "negatives-vectors")
    sizes = rows.groupBy(F.size("vector").alias("width")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("is_anchor"), 1)).alias("anchors")
    )
    found = [
        mined_of_length(rows, size, positives, negatives, low, high, scale, block_rows, anchor_rows)
        for size in sizes.filter("rows > 1 AND anchors > 0").orderBy("width").collect()
    ]
    if not found:
        names = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return vectors.sparkSession.createDataFrame([], names)
    return reduce(DataFrame.unionByName, found)


def mined_of_length(
    rows: DataFrame,
    size: Row,
    positives: int,
    negatives: int,
    low: int,
    high: int,
    scale: int,
    block_rows: int,
    anchor_rows: int,
) -> DataFrame:
    """``mined`` among the vectors of one length; ``size``: the length, its rows and its anchors."""
    width = size["width"]
    rows = rows.filter(F.size("vector") == width)
    blocks, parts = math.ceil(size["rows"] / block_rows), math.ceil(size["anchors"] / anchor_rows)
    number = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block, part = number(blocks, "block").alias("block"), number(parts, "part").alias("part")
    candidates = rows.select("vec_id", "label", "vector", block, every(parts).alias("part"))
    anchors = rows.filter("is_anchor").select("vec_id", "label", "vector", part)

    def meet(asked: DataFrame, answer, schema: pa.Schema) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            return table_of(answer(Block(left, right, width, scale), left), schema)

        names = ", ".join(f"{f.name} bigint" for f in schema)
        grouped = asked.withColumn("block", every(blocks)).groupBy("block", "part")
        return grouped.cogroup(candidates.groupBy("block", "part")).applyInArrow(run, names)

    def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")  # at most k a block
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near = first(meet(anchors, lambda block, _: positives_of(block, positives), POSITIVES), ["anchor_id"], positives)
    near = near.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    asked = stage(anchors.join(near, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "negatives-anchors")
    hard = meet(asked, lambda block, left: negatives_of(block, left, negatives, low, high), NEGATIVES)
    return first(hard, ["anchor_id", "positive_id"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vector
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.vector, b.vector), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM usable a, usable b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


@query("op13_kronecker_negatives", SQL)
def op13_kronecker_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh label is moved on by one first."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
