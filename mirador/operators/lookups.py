"""Joins between long tables of the same unit."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mirador.functions.timing import epoch_micros, to_micros
from mirador.operators.ordered import ROWS_PER_BUCKET, Running, running
from mirador.sources.tables import stage


def block_start(at: Column, width: int) -> Column:
    """Start of the block of ``width`` microseconds that holds ``at``."""
    return at - F.pmod(at, F.lit(width))


def attach(df: DataFrame, units: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join an aggregated table, one row per key, to many rows per key.

    The aggregate is written first. Its size is then known, so Spark broadcasts it when it
    is small; otherwise both sides are plain shuffles, the form in which AQE can split the
    rows of a hot key over many tasks. An aggregate joined in place keeps the key's
    partitioning and would pin a hot key to one task.
    """
    return df.join(stage(units, "units"), on, how)


def lookup_at(
    df: DataFrame,
    right: DataFrame,
    on: list[str],
    where: Column | None = None,
    keep: list[str | Column] | None = None,
) -> DataFrame:
    """Left join on unit and exact time; the condition on the right side comes first.

    ``keep`` orders the right rows of one key and joins only the first, so a left row stays
    one row. Without it every right row of the key is joined.
    """
    right = right.filter(where) if where is not None else right
    if keep:
        return attach(df, first_by(right, on, keep), on, "left")
    return df.join(right, on, "left")


def band_join(
    probe: DataFrame,
    ref: DataFrame,
    on: str,
    id: str,
    ts: str,
    ref_ts: str,
    before: dt.timedelta,
    after: dt.timedelta,
    aggregates: dict[str, tuple[str, str]],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Left outer band join, folded per probe: the aggregates of the reference rows of equal
    unit with ``ts − before < ref_ts < ts + after``, both ends open.

    No pair is formed (see ``rollup_window``), so a hot unit costs what its rows cost. A
    probe without reference rows stays, with nulls and a count of 0.
    """
    tick = dt.timedelta(microseconds=1)
    folded = rollup_window(
        ref, probe, on, id, ref_ts, ts, -before + tick, after - tick, aggregates, rows_per_bucket
    )
    counts = {name: 0 for name, (how, _) in aggregates.items() if how == "count"}
    return probe.join(folded, id, "left").fillna(counts)


def band_pairs(
    probe: DataFrame,
    ref: DataFrame,
    on: str,
    ts: str,
    ref_ts: str,
    before: dt.timedelta,
    after: dt.timedelta,
    how: str = "left",
) -> DataFrame:
    """Pairs of equal unit with ``ts − before < ref_ts < ts + after``, both ends open.

    For sparse bands only: the result holds every pair, and dense data makes many. Use
    ``band_join`` for aggregates and ``asof_match`` for one row per probe. The join key is unit and time bucket, one band wide, so a hot unit is spread over its
    buckets and only neighbours in time meet. Reference rows are copied to the two or
    three buckets they can serve; a probe has one, so no pair appears twice.
    """
    lo, hi = to_micros(before), to_micros(after)
    width = lo + hi
    left = probe.withColumn("_bucket", block_start(epoch_micros(ts), width))
    at = epoch_micros(ref_ts)
    served = F.sequence(block_start(at - hi, width), block_start(at + lo, width), F.lit(width))
    right = ref.withColumn("_bucket", F.explode(served))
    gap = F.timestamp_diff("MICROSECOND", F.col(f"l.{ts}"), F.col(f"r.{ref_ts}"))
    cond = [
        F.col(f"l.{on}") == F.col(f"r.{on}"),
        F.col("l._bucket") == F.col("r._bucket"),
        (gap > -lo) & (gap < hi),
    ]
    joined = left.alias("l").join(right.alias("r"), reduce(lambda a, b: a & b, cond), how)
    kept = [c for c in ref.columns if c != on]
    return joined.select("l.*", *[F.col(f"r.{c}") for c in kept]).drop("_bucket")


def asof_match(
    probe: DataFrame,
    ref: DataFrame,
    on: str,
    ts: str,
    ref_ts: str,
    before: dt.timedelta | None,
    after: dt.timedelta | None,
    payload: list[str],
    kind: Column | None = None,
    kinds: list[int] | None = None,
    tie: list[Column] = (),
    closed: bool = False,
    direction: str = "both",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One reference row, or none, for every probe row.

    Preference order: ``kind`` (in the order of ``kinds``), at or before the probe rather
    than after it, nearest in time, then ``tie`` ascending. ``before``/``after`` bound the
    distance, open unless ``closed``; ``direction`` may be backward or forward.

    The nearest time on each side is a running max or min over the unit's times, so no
    pairs are formed and the cost is linear also for a hot unit. Only numbers go through
    that scan; the payload is fetched afterwards by unit, time and kind.
    """
    if direction not in ("both", "backward", "forward"):
        raise ValueError(f"unknown direction: {direction}")
    kinds = [0] if kinds is None else kinds
    sides = {"both": ["b", "a"], "backward": ["b"], "forward": ["a"]}[direction]
    refs = ref.withColumns({"_at": epoch_micros(ref_ts), "_kind": F.lit(0) if kind is None else kind})
    refs = refs.filter(F.col("_at").isNotNull() & F.col(on).isNotNull() & F.col("_kind").isin(*kinds))
    probes = probe.withColumn("_ts", epoch_micros(ts))

    times = [F.when(F.col("_kind") == k, F.col("_at")).alias(f"k{i}") for i, k in enumerate(kinds)]
    points = refs.select(on, F.col("_at").alias("_ts"), F.lit(0).alias("_asked"), *times)
    asked = probes.filter(F.col("_ts").isNotNull() & F.col(on).isNotNull())
    points = points.unionByName(
        asked.select(on, "_ts", F.lit(1).alias("_asked")), allowMissingColumns=True
    )
    points = points.groupBy(on, "_ts").agg(
        F.max("_asked").alias("_asked"), *[F.max(f"k{i}").alias(f"k{i}") for i in range(len(kinds))]
    )
    columns = [
        Running(f"{s}{i}", "min" if s == "a" else "max", f"k{i}", back=s == "a")
        for s in sides for i in range(len(kinds))
    ]
    seen = running(points, [on], "_ts", columns, rows_per_bucket=rows_per_bucket)

    def candidate(i: int, side: str) -> Column:
        at, limit = F.col(f"{side}{i}"), before if side == "b" else after
        near = at.isNotNull()
        if limit is not None:
            gap = F.abs(F.col("_ts") - at)
            near &= gap <= to_micros(limit) if closed else gap < to_micros(limit)
        return F.when(near, F.struct(at.alias("_at"), F.lit(kinds[i]).alias("_kind")))

    chosen = F.coalesce(*[candidate(i, s) for i in range(len(kinds)) for s in sides])
    found = seen.filter("_asked = 1").select(on, "_ts", chosen.alias("_c")).filter("_c IS NOT NULL")
    rows = first_by(refs.select(on, "_at", "_kind", *_named(tie), *payload), [on, "_at", "_kind"],
                    [f"_tie{i}" for i in range(len(tie))])
    answers = found.select(on, "_ts", "_c.*").transform(
        attach, rows.select(on, "_at", "_kind", *[F.col(c).alias(f"_p_{c}") for c in payload]),
        [on, "_at", "_kind"],
    )
    joined = probes.join(answers.drop("_at", "_kind"), [on, "_ts"], "left")
    return joined.select(*probe.columns, *[F.col(f"_p_{c}").alias(c) for c in payload])


def _named(tie: list[Column]) -> list[Column]:
    return [c.alias(f"_tie{i}") for i, c in enumerate(tie)]


def onset(
    suspicion: DataFrame,
    score: DataFrame,
    on: str,
    ts: str,
    score_ts: str,
    before: dt.timedelta,
    after: dt.timedelta,
    payload: list[str],
    order: list[str],
    tie: list[Column] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Earliest suspicion row per unit that has a score in [ts − before, ts + after].

    Of the scores in that range only the earliest can come first in the order
    (``order``, score time), so each suspicion row looks up its first score at or after
    ``ts − before`` and the pick per unit is one aggregate.
    """
    opened = suspicion.filter(F.col(on).isNotNull()).withColumn(
        "_open", F.col(ts) - F.expr(f"make_dt_interval(0, 0, 0, {to_micros(before)} / 1000000.0BD)")
    )
    matched = asof_match(
        opened, score, on, "_open", score_ts, None, before + after, [score_ts, *payload],
        tie=list(tie), closed=True, direction="forward", rows_per_bucket=rows_per_bucket,
    )
    matched = matched.filter(F.col(score_ts).isNotNull()).drop("_open")
    return first_by(matched, [on], [*order, score_ts])


def first_by(df: DataFrame, on: list[str], order: list[str | Column]) -> DataFrame:
    """The first row per key by ``order`` (nulls first), as a partial aggregate, not a window.

    All other columns follow the order keys, so the pick never depends on row arrival.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    rest = [c for c in df.columns if c not in on]
    packed = F.struct(
        *[k.alias(f"_o{i}") for i, k in enumerate(keys)], *[F.col(c) for c in rest]
    )
    picked = df.groupBy(*on).agg(F.min(packed).alias("_row"))
    return picked.select(*on, *[F.col(f"_row.{c}").alias(c) for c in rest])


def rollup_window(
    facts: DataFrame,
    stays: DataFrame,
    person: str,
    stay: str,
    ts: str,
    stay_ts: str,
    lo: dt.timedelta,
    hi: dt.timedelta,
    aggregates: dict[str, tuple[str, str]],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Aggregate a person's rows in [stay_ts + lo, stay_ts + hi] for each stay.

    ``aggregates`` maps an output name to (min | max | sum | count, column). Rows and stays
    of a person meet many to many, so no pairs are formed: time is cut into blocks as long
    as the window, and a window is the tail of one block plus the head of the next. Both
    come from running aggregates inside the blocks. Stays without a row in the window are
    left out, as with an inner join.
    """
    start, stop = to_micros(lo), to_micros(hi)
    # The window's end always falls in the block after its start's; a window of one instant is
    # a block of its own, of which the tail alone is the whole.
    width = max(1, stop - start)
    parts = {**aggregates, "_rows": ("count", ts)}

    def fold(how: str, c: Column) -> Column:
        return {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}[how](c)

    points = facts.filter(F.col(person).isNotNull() & F.col(ts).isNotNull()).select(
        person, epoch_micros(ts).alias("_at"),
        *[
            (F.col(c).isNotNull().cast("long") if how == "count" else F.col(c)).alias(name)
            for name, (how, c) in parts.items()
        ],
    )
    windows = stays.filter(F.col(person).isNotNull() & F.col(stay_ts).isNotNull()).select(
        stay, person, epoch_micros(stay_ts).alias("_in")
    )
    ends = windows.select(
        stay, person,
        F.explode(
            F.array(*[
                F.struct((F.col("_in") + at).alias("_at"), F.lit(end).alias("_end"))
                for at, end in ([(start, "tail"), (stop, "head")] if stop > start else [(start, "tail")])
            ])
        ).alias("_e"),
    ).select(stay, person, "_e.*")
    marks = ends.select(person, "_at").distinct()
    merged = points.unionByName(marks, allowMissingColumns=True)
    merged = merged.groupBy(person, "_at").agg(
        *[fold(how, F.col(name)).alias(name) for name, (how, _) in parts.items()]
    ).withColumn("_block", block_start(F.col("_at"), width))
    columns = [
        Running(f"{side}_{name}", "sum" if how == "count" else how, name, back=side == "tail")
        for side in ("head", "tail")
        for name, (how, _) in parts.items()
    ]
    scanned = running(merged, [person, "_block"], "_at", columns, rows_per_bucket=rows_per_bucket)
    met = ends.join(scanned, [person, "_at"])
    return met.groupBy(stay).agg(
        *[
            fold(how, F.when(F.col("_end") == "head", F.col(f"head_{name}"))
                 .otherwise(F.col(f"tail_{name}"))).alias(name)
            for name, (how, _) in parts.items()
        ]
    ).filter(F.col("_rows") > 0).drop("_rows")


def reconcile(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join; the key is taken from whichever side has it."""
    return a.join(b, on, "full")


def assemble(
    spine: DataFrame, parts: list[DataFrame], on: str, check_unique: bool = True
) -> DataFrame:
    """Left-join per-unit tables to the spine; a part with a repeated id is refused."""
    if check_unique:
        for i, part in enumerate(parts):
            if part.groupBy(on).count().filter("count > 1").limit(1).count():
                raise ValueError(f"part {i} has more than one row for some {on}")
    return reduce(lambda left, part: left.join(part, on, "left"), parts, spine)
