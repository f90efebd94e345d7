"""Approximate nearest neighbours by multi-index hashing.

Unit vectors are rotated by a matrix learned on a bounded sample (iterative quantisation) and
their signs are binary codes. A code is split into substrings, each of which indexes the
vectors of a block. If two codes differ in at most ``radius`` bits, some substring differs in
at most its share of them, so probing all values that near in every substring finds every
code within the radius. Those are reranked by the cosine of the original vectors.

Vectors and queries are dealt out in blocks, and each pair of blocks is one group, so a
frequent vector or bucket is never in one task with all of its like.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from mirador.sources.tables import stage

from .registry import query, table

HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(fine(x), F.lit(False))), F.lit(False)) & F.exists(
        vector, lambda x: x != 0
    )


def dense(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # tiny and huge ones stay finite
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def learn_rotation(sample: np.ndarray, rounds: int = 20) -> np.ndarray:
    """The rotation under which the sample is nearest to its signs (iterative quantisation)."""
    width = sample.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(7).normal(size=(width, width)))[0]
    for _ in range(rounds):
        signs = np.where(sample @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(sample.T @ signs)
        rotation = left @ right
    return rotation


@dataclass
class Coder:
    """Rotation, substring widths and the radius at which codes are retrieved."""

    rotation: np.ndarray
    substrings: int
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return unit(vectors) @ self.rotation >= 0

    def parts(self, codes: np.ndarray) -> list[np.ndarray]:
        """The value of each substring of each code."""
        return [
            (part @ (1 << np.arange(part.shape[1]))).astype(np.int64)
            for part in np.array_split(codes, min(self.substrings, codes.shape[1]), axis=1)
        ]

    def shares(self) -> list[int]:
        """Bits in which each substring may differ: a code within the radius is near in one.

        With radius = q * parts + rest, a code that differs in more than q bits in the first
        rest + 1 substrings and in more than q - 1 in the others differs in more than radius.
        """
        number = min(self.substrings, self.rotation.shape[1])
        whole, rest = divmod(self.radius, number)
        return [whole if k <= rest else whole - 1 for k in range(number)]


def ball(width: int, most: int) -> np.ndarray:
    """All values of ``width`` bits with at most so many ones."""
    return np.array(
        [sum(1 << b for b in bits) for n in range(min(most, width) + 1) for bits in combinations(range(width), n)],
        dtype=np.int64,
    )


class Index:
    """Substring tables over a block: rows sorted by value, and where each value starts."""

    def __init__(self, coder: Coder, codes: np.ndarray):
        self.coder, self.codes = coder, np.packbits(codes, axis=1)
        widths = [p.shape[1] for p in np.array_split(codes[:1], min(coder.substrings, codes.shape[1]), axis=1)]
        self.tables = []
        for values, width, most in zip(coder.parts(codes), widths, coder.shares()):
            if most >= 0:
                order = np.argsort(values, kind="stable")
                starts = np.searchsorted(values[order], np.arange((1 << width) + 1))
                self.tables.append((order, starts, ball(width, most)))
            else:
                self.tables.append(None)

    def within(self, parts: list[int], code: np.ndarray) -> np.ndarray:
        """Rows whose code differs in at most ``radius`` bits."""
        seen = np.zeros(len(self.codes), dtype=bool)
        for value, found in zip(parts, self.tables):
            if found is None:
                continue
            order, starts, near = found
            first, last = starts[value ^ near], starts[(value ^ near) + 1]
            size = last - first
            ends = np.cumsum(size)
            seen[order[np.arange(ends[-1]) + np.repeat(first - ends + size, size)]] = True
        rows = np.flatnonzero(seen)
        differ = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64)
        return rows[differ <= self.coder.radius]


def fit(vectors: np.ndarray, substrings: int, neighbours: int, recall: float) -> Coder:
    """Rotation and radius from a sample: the radius holds the given share of its neighbours."""
    width = vectors.shape[1]
    scaled = unit(vectors)
    coder = Coder(learn_rotation(scaled), substrings, width)
    if len(scaled) > neighbours:
        codes = np.packbits(coder.codes(vectors), axis=1)
        distances = []
        for at in range(0, len(scaled), 512):
            near = scaled[at : at + 512] @ scaled.T
            near[np.arange(len(near)), np.arange(at, at + len(near))] = -2
            top = np.argpartition(-near, neighbours - 1, axis=1)[:, :neighbours]
            distances.append(np.bitwise_count(codes[at : at + 512, None, :] ^ codes[top]).sum(axis=2))
        coder.radius = int(np.quantile(np.concatenate(distances), recall, method="higher"))
    return coder


def search_blocks(left, right, coder: Coder, k: int, width: int) -> pa.Table:
    """The k best of a block of vectors for every query of a block."""
    if not left.num_rows or not right.num_rows:
        return HITS.empty_table()
    vectors, ids = dense(right.column("vector"), width), right.column("vec_id").to_numpy()
    queries, query_ids = dense(left.column("vector"), width), left.column("vec_id").to_numpy()
    scaled, index = unit(vectors), Index(coder, coder.codes(vectors))
    codes = coder.codes(queries)
    parts, packed, directions = list(zip(*coder.parts(codes))), np.packbits(codes, axis=1), unit(queries)
    out = []
    for query_id, values, code, direction in zip(query_ids, parts, packed, directions):
        rows = index.within([int(v) for v in values], code)
        rows = rows[ids[rows] != query_id]
        score = (scaled[rows] * direction).sum(axis=1)
        if len(rows) > k:
            least = np.partition(score, len(rows) - k)[len(rows) - k]
            rows, score = rows[score >= least], score[score >= least]  # with ties
        best = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(best), query_id), ids[rows[best]], score[best]))
    columns = [np.concatenate(c) for c in zip(*out)]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, HITS)], schema=HITS)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    substrings: int = 8,
    recall: float = 0.99,
    sample_rows: int = 4096,
    block_rows: int = 16_384,
    query_rows: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found by cosine of every query row.

    ``vectors``: vec_id, embedding. The rotation and the radius are fitted on at most about
    ``sample_rows`` rows; every row is indexed. Queries with fewer than ``k`` codes within the
    radius are searched again with a radius that takes all. Null ids, and vectors that are
    null, empty, zero or hold null or non-finite components, take no part. Vectors are compared
    with those of their own length, and each length has a rotation and a radius of its own. Rows
    of one id count once, with their least vector. Ties go to the smaller id. An empty table gives
    no rows. Other columns are not looked at.
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = stage(rows.groupBy("vec_id", "is_query").agg(F.min("vector").alias("vector")), "ann-vectors")
    sizes = rows.groupBy(F.size("vector").alias("width")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("is_query"), 1)).alias("queries")
    )
    found = [
        nearest_of_length(rows, size, k, substrings, recall, sample_rows, block_rows, query_rows)
        for size in sizes.filter("rows > 1 AND queries > 0").orderBy("width").collect()
    ]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return reduce(DataFrame.unionByName, found)


def nearest_of_length(
    rows: DataFrame,
    size: Row,
    k: int,
    substrings: int,
    recall: float,
    sample_rows: int,
    block_rows: int,
    query_rows: int,
) -> DataFrame:
    """``nearest`` among the vectors of one length; ``size``: the length, its rows and its queries."""
    schema = "query_id bigint, vec_id bigint, score double"
    width = size["width"]
    rows = rows.filter(F.size("vector") == width)
    share = min(1.0, sample_rows / size["rows"])
    drawn = F.pmod(F.xxhash64("vec_id", F.lit("rotation")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = rows.filter(drawn).select("vector").toArrow()
    taken = dense(sample.column("vector"), width) if sample.num_rows else np.eye(width)
    coder = fit(taken, substrings, k, recall)

    blocks, parts = math.ceil(size["rows"] / block_rows), math.ceil(size["queries"] / query_rows)
    number = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "vector", number(blocks, "block").alias("block"), every(parts).alias("part"))

    def search(wanted: DataFrame, with_coder: Coder) -> DataFrame:
        asked = wanted.select("vec_id", "vector", number(parts, "part").alias("part"), every(blocks).alias("block"))
        found = (
            asked.groupBy("block", "part")
            .cogroup(candidates.groupBy("block", "part"))
            .applyInArrow(lambda a, b: search_blocks(a, b, with_coder, k, width), schema)
        )
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k a block
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    asked = rows.filter("is_query")
    first = stage(search(asked, coder), "ann-found")
    complete = first.filter(F.col("rank") == min(k, size["rows"] - 1)).select(F.col("query_id").alias("vec_id"))
    short = stage(asked.join(complete, "vec_id", "left_anti"), "ann-short")
    if not short.isEmpty():
        again = search(short, Coder(coder.rotation, substrings, width))
        first = first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return first.select("query_id", "rank", "vec_id", "score")


@query("op5_multi_index_hashing")
def op5_multi_index_hashing(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
