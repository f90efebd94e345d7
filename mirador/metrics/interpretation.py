"""Who benefits: responder groups, their profile, intervals and the ordered effect curve."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from mirador.operators.ordered import ROWS_PER_BUCKET, ordered_rank, quantiles
from mirador.operators.summaries import unpivot


def _poisson_steps(resolution: float = 2.0**-32) -> tuple[float, ...]:
    """P(X <= k) of a Poisson variable with mean 1, as far as a 32-bit uniform can tell."""
    steps, share, k = [], math.exp(-1), 0
    while not steps or 1 - steps[-1] > resolution:
        steps.append((steps[-1] if steps else 0.0) + share)
        k += 1
        share /= k
    return tuple(steps)


POISSON_ONE = _poisson_steps()
DRAWS_PER_DIGEST = 4
#: Rows whose weights a task makes at a time, and groups that it holds sums of.
ROWS_AT_ONCE, GROUPS_HELD = 500, 200


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet; the key columns come from the left."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in on]
    joined = left.alias("l").join(right.alias("r"), same, how)
    return joined.select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in on])


def responder_group(ite: str, lo: float = -0.1, hi: float = 0.1) -> Column:
    """Effect at or below ``lo`` responds, at or above ``hi`` is harmed."""
    return (
        F.when(F.col(ite) <= lo, "responder").when(F.col(ite) >= hi, "harmed")
        .when(F.col(ite).isNotNull(), "neutral")
    )


def ate(df: DataFrame, ite: str) -> DataFrame:
    return df.agg(
        F.avg(ite).alias("ate"), F.stddev_pop(ite).alias("sd"), F.count(ite).alias("n")
    )


def describe_by(
    df: DataFrame, group: str, cols: list[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Count, mean, sample sd, min, quartiles and max of each column in each group."""
    long = unpivot(df, [group], cols, "feature", "value")
    by = [group, "feature"]
    simple = long.groupBy(*by).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = quantiles(long, by, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, rows_per_bucket)
    return null_safe(simple, quartiles, by, "left").select(
        *by, "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def resample_weights(ids: list[str], seed: int, resamples: int) -> np.ndarray:
    """How often each id is drawn in each resample: Poisson(1) numbers from 32 bits of its digests."""
    digests = -(-resamples // DRAWS_PER_DIGEST)
    tails = [f"|{k}".encode() for k in range(digests)]
    raw = b"".join(hashlib.md5(head + tail).digest() for i in ids for head in (f"{seed}|{i}".encode(),) for tail in tails)
    uniform = np.frombuffer(raw, dtype=">u4").reshape(len(ids), -1)[:, :resamples] / 4294967296.0
    return np.searchsorted(POISSON_ONE, uniform, side="right").astype(np.float64)


def resampled_sums(
    batches: Iterator[pa.RecordBatch], resamples: int, columns: int, seed: int, key: pa.DataType
) -> Iterator[pa.RecordBatch]:
    """Per group of a partition, one row per resample: weighted sums and weights of each column.

    The accumulator is groups x resamples x columns; with too many groups it is given out and
    started again.
    """
    names = ["_key", "_replicate", *[f"{part}{i}" for part in "sn" for i in range(columns)]]
    held: dict = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for value, (total, weight) in held.items():
            parts = [pa.array(c) for side in (total, weight) for c in side.T]
            yield pa.RecordBatch.from_arrays([pa.array([value] * resamples, key), pa.array(np.arange(resamples)), *parts], names=names)
        held.clear()

    for whole in batches:
        for batch in (whole.slice(at, ROWS_AT_ONCE) for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            weights = resample_weights(batch.column("_id").to_pylist(), seed, resamples)
            values = np.column_stack([batch.column(f"_c{i}").to_numpy(zero_copy_only=False) for i in range(columns)])
            known = np.column_stack([batch.column(f"_c{i}").is_valid().to_numpy(zero_copy_only=False) for i in range(columns)])
            values = np.where(known, values, 0.0)
            coded = batch.column("_key").dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy()
            for code, value in enumerate(coded.dictionary.to_pylist()):
                own = codes == code
                if value not in held:
                    held[value] = (np.zeros((resamples, columns)), np.zeros((resamples, columns)))
                held[value][0][:] += weights[own].T @ values[own]
                held[value][1][:] += weights[own].T @ known[own].astype(np.float64)
            if len(held) > GROUPS_HELD:
                yield from rows()
    yield from rows()


def bootstrap(
    df: DataFrame, id: str, cols: list[str], group: str, resamples: int = 1000, seed: int = 42,
    level: float = 0.95, min_rows: int = 3, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Percentile interval of each column's mean in each group, with mean and median.

    Poisson resampling: in every replicate a row counts as often as a Poisson(1) number
    drawn from its own id says, so a replicate is a weighted sum. Every row is read once: a batch's
    weight matrix is multiplied with its columns and added to the partition's sums, which leaves
    groups × replicates rows of a partition to shuffle, whatever the size of a group. Groups
    with fewer than ``min_rows`` rows are left out.
    """
    columns = len(cols)
    narrow = df.select(
        F.col(group).alias("_key"), F.coalesce(F.col(id).cast("string"), F.lit("")).alias("_id"),
        *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)],
    )
    key = to_arrow_type(narrow.schema["_key"].dataType)
    schema = StructType([narrow.schema["_key"]]).add("_replicate", "long")
    for part in "sn":
        for i in range(columns):
            schema = schema.add(f"{part}{i}", "double")
    parts = narrow.mapInArrow(lambda batches: resampled_sums(batches, resamples, columns, seed, key), schema)
    sums = parts.groupBy("_key", "_replicate").agg(*[F.sum(f"{p}{i}").alias(f"{p}{i}") for p in "sn" for i in range(columns)])
    means = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.try_divide(f"s{i}", F.nullif(f"n{i}", F.lit(0.0))).alias("_mean"))
        for i, c in enumerate(cols)
    ])
    replicates = sums.select(F.col("_key").alias(group), F.inline(means))
    tail = (1 - level) / 2
    intervals = replicates.groupBy(group, "feature").agg(
        F.percentile("_mean", F.lit(tail)).alias("low"),
        F.percentile("_mean", F.lit(1 - tail)).alias("high"),
    )
    long = unpivot(df, [group], cols, "feature", "value")
    by = [group, "feature"]
    plain = long.groupBy(*by).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    medians = quantiles(long, by, "value", {"median": 0.5}, rows_per_bucket)
    return (
        null_safe(null_safe(plain.filter(F.col("n") >= min_rows), medians, by), intervals, by)
        .select(*by, "mean", "median", "low", "high")
    )


def ordered_curve(
    df: DataFrame, ite: str, id: str, lo: float = -0.1, hi: float = 0.1,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Every unit's place in the order of effects, one sd around it, and its segment."""
    known = df.filter(F.col(ite).isNotNull()).select(id, ite)
    spread = known.agg(F.stddev_pop(ite)).first()[0] or 0.0
    ranked = ordered_rank(known, ite, id, "rank", rows_per_bucket=rows_per_bucket)
    segment = F.when(F.col(ite) > hi, "above").when(F.col(ite) < lo, "below").otherwise("between")
    return ranked.select(
        id, "rank", ite,
        (F.col(ite) - F.lit(spread)).alias("lower"), (F.col(ite) + F.lit(spread)).alias("upper"),
        segment.alias("segment"),
    )
