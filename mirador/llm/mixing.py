"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources share all words by weight, each up to a limit of passes over its own words. Blocks of
equally many words are allocated to sources by the highest quotients share / (2 k + 1), then the
same way to the shards of each source, so every shard has an integer quota. A shard lays its
documents end to end in a seeded order; whole passes come first, and what is left of the quota
is taken in blocks chosen by a seeded permutation of the block numbers.

Nothing is expanded into blocks: documents carry their place in the shard, and the blocks of a
document follow from it. A source has about as many shards as the square root of its words asks
for, so shards, and rows per shard, grow alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mirador.sources.tables import stage

from .registry import query, table

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights by rank of the source, repeating (the mix that the query asks for).
WEIGHTS = (5, 2, 1)
#: Multipliers of the block permutation: primes above any block number, so coprime to all counts.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def apportion(rows: DataFrame, by: list[str], key: str, share: str, seats: str) -> DataFrame:
    """Add ``quota``: the seats of each row, of the ``seats`` of its group, by the highest quotients.

    Quotients are share / 1, share / 3, share / 5 ...; ties go to the smaller ``key``, which names
    the rows of a group. With n rows, a divisor of total / (seats - n / 2) gives no seat too many
    and one of total / (seats + n / 2) none too few. Only the quotients between the two are
    ranked, a few for each row, so the work follows the rows and not the seats.
    """
    group = Window.partitionBy(*by)
    half = F.count(F.lit(1)).over(group) / F.lit(2.0)
    held = rows.withColumns({"_total": F.sum(share).over(group).cast("double"), "_half": half})
    rounded = lambda divided: F.floor(F.col(share) * divided / F.col("_total") + F.lit(0.5))
    fewer, more = F.col(seats) - F.col("_half"), F.col(seats) + F.col("_half")
    has = (F.col(share) > 0) & (F.col(seats) > 0)
    held = held.withColumn("_sure", F.when(has & (fewer > 0), F.greatest(rounded(fewer) - 1, F.lit(0))).otherwise(0))
    held = held.withColumn("_most", F.when(has, rounded(more) + 1).otherwise(0))
    held = held.withColumn("_open", F.col(seats) - F.sum("_sure").over(group))
    between = F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_most") - 1))
    tried = held.withColumn("_k", F.explode_outer(between))
    quotient = F.col(share).cast("double") / (F.lit(2) * F.col("_k") + F.lit(1))
    ranked = tried.withColumn("_rank", F.row_number().over(group.orderBy(F.desc_nulls_last(quotient), key)))
    won = F.count(F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_open")), 1))
    others = [F.first(c).alias(c) for c in rows.columns if c not in (*by, key)]
    return ranked.groupBy(*by, key).agg(*others, (F.first("_sure") + won).alias("quota"))


def source_targets(sources: DataFrame, weights: tuple[int, ...], most_passes: int) -> DataFrame:
    """Add weight, target and capped to (source, source_size): one row per source.

    Sources in code-point order, null last, have the weights in turn. In the order of limit by
    weight, a source is capped if what the ones before it leave would put it at its limit; the
    rest share what the capped ones leave by weight. The list of sources is ranked in one window:
    a mix is a list of sources, not of documents.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    of = F.array(*[F.lit(w).cast("bigint") for w in weights])
    rows = sources.withColumn("place", place.cast("bigint")).withColumn(
        "weight", F.element_at(of, (F.col("place") % len(weights) + 1).cast("int"))
    )
    rows = rows.withColumn("limit", F.col("source_size") * most_passes)
    first = Window.orderBy(F.col("limit") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("place")
    exact = lambda c: c.cast("decimal(38,0)")
    all_words, all_weight = F.sum("source_size").over(every), F.sum("weight").over(every)
    left = all_words - F.coalesce(F.sum("limit").over(first), F.lit(0))
    weight_left = all_weight - F.coalesce(F.sum("weight").over(first), F.lit(0))
    rows = rows.withColumn("capped", exact(F.col("weight")) * exact(left) >= exact(F.col("limit")) * exact(weight_left))
    open_words = all_words - F.coalesce(F.sum(F.when(F.col("capped"), F.col("limit"))).over(every), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    rows = rows.withColumns({"open_words": open_words, "open_weight": open_weight})
    shared = (F.col("weight") * F.col("open_words")).cast("double") / F.col("open_weight")
    return rows.withColumn("target", F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(shared))


def number_of(key: Column, most: Column) -> Column:
    """A number below ``most`` from the first 32 bits of a hexadecimal digest."""
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"), most)


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most_passes: int = 3,
    block_words: int = 16,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source), with what the mix takes of it.

    doc_id, text_hash (xxhash64 of the text), size (words), source, source_size, target, shard,
    quota (blocks of the shard), passes (how often the whole document is taken), spans (array of
    start and words: word ranges that are taken once more), taken (words in all). A source's words
    are its target up to rounding to blocks; no document is taken more than ``most_passes`` times.

    Documents without words (null, empty or blank text) are taken 0 times, and a source of such
    documents has the target 0. Null sources are one source, last in order; an empty string is
    another. Repeated rows, and rows with a null or a repeated doc_id, are documents each; equal
    rows are interchangeable. Texts are read whole and once. Other columns are not looked at. An
    empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )
    rows = stage(rows, "mix-documents")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    shards = F.ceil(F.greatest(F.sqrt("source_size") / 64, F.sqrt("documents") / 16))
    sources = source_targets(sources, weights, most_passes).withColumn("shards", shards.cast("bigint"))
    blocks = F.round(F.col("open_words") / block_words).cast("bigint")
    free = apportion(
        sources.filter("NOT capped").withColumn("blocks", blocks).withColumn("all", F.lit(1)),
        ["all"], "place", "weight", "blocks",
    ).drop("all", "blocks")
    full = sources.filter("capped").withColumn("quota", F.lit(None).cast("bigint"))
    sources = stage(free.unionByName(full).withColumnRenamed("quota", "source_quota"), "mix-sources")

    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    same = F.col("rows.source").eqNullSafe(F.col("sources.source"))
    known = F.broadcast(sources) if sources.count() <= 100_000 else sources
    rows = rows.alias("rows").join(known.alias("sources"), same).select(
        "rows.*", "place", "source_size", "target", "source_quota", key.alias("key"),
        number_of(key, F.col("shards")).alias("shard"),
    )
    sizes = rows.groupBy("place", "shard").agg(
        F.sum("size").alias("words"), F.first("source_quota").alias("source_quota")
    )
    quotas = apportion(sizes, ["place"], "shard", "words", "source_quota")
    # a capped source takes all its passes; a quota above a shard's passes stops there
    limit = F.col("words") * most_passes
    wanted = F.least(F.coalesce(F.col("quota") * block_words, limit), limit)
    quotas = quotas.withColumn("wanted", F.when(F.col("source_quota").isNull(), limit).otherwise(wanted))
    filled = F.col("words") > 0
    quotas = quotas.withColumn("passes", F.when(filled, F.floor(F.col("wanted") / F.col("words"))).otherwise(0))
    quotas = quotas.withColumn("rest", F.col("wanted") - F.col("passes") * F.col("words"))
    quotas = stage(quotas.select(F.col("place").alias("in_source"), F.col("shard").alias("in_shard"), "words",
                                 F.ceil(F.col("wanted") / block_words).alias("quota"), "passes", "rest"), "mix-quotas")

    inside = Window.partitionBy("place", "shard").orderBy("key", "doc_id", "size", "text_hash")
    start = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.coalesce(start, F.lit(0)))
    rows = rows.join(quotas, (F.col("place") == F.col("in_source")) & (F.col("shard") == F.col("in_shard")))
    spans = chosen_spans(block_words, seed)
    rows = rows.withColumn("spans", spans)
    extra = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, x: total + x["words"])
    return rows.withColumn("taken", F.col("passes") * F.col("size") + extra).select(
        "doc_id", "text_hash", "size", "source", "source_size", "target", "shard", "quota", "passes", "spans", "taken"
    )


def chosen_spans(block: int, seed: str) -> Column:
    """The parts of a document in the chosen blocks of its shard.

    The shard's ``words`` hold whole blocks 0, 1 ... and perhaps a shorter one. Whole block i has
    the rank (i * prime + shift) modulo their number; those of rank below rest / block are taken,
    and of the next one the first rest % block words. Without a next whole block that is the
    shorter one, which is longer than that.
    """
    picked = seeded(seed, "prime") % len(PRIMES)
    prime, shift = PRIMES[picked], seeded(seed, "shift")
    number = F.floor(F.col("words") / block)
    taken, part = F.floor(F.col("rest") / block), F.col("rest") % block
    rank = lambda i: (
        F.when(i < number, F.pmod(i * F.pmod(F.lit(prime), number) + F.lit(shift), number)).otherwise(number)
    )
    length = lambda i: F.when(rank(i) < taken, block).when(rank(i) == taken, part).otherwise(0)
    last = F.col("start") + F.col("size")
    touched = F.sequence(F.floor(F.col("start") / block), F.floor((last - 1) / block))
    begin = lambda i: F.greatest(i * block, F.col("start"))
    span = lambda i: F.struct(
        (begin(i) - F.col("start")).cast("bigint").alias("start"),
        (F.least(i * block + length(i), last) - begin(i)).cast("bigint").alias("words"),
    )
    found = F.filter(F.transform(touched, span), lambda x: x["words"] > 0)
    some = (F.col("size") > 0) & (F.col("rest") > 0)
    return F.when(some, found).otherwise(F.array().cast("array<struct<start:bigint,words:bigint>>"))


def seeded(seed: str, use: str) -> int:
    """A fixed number below 2^31 for a use of the seed."""
    return sum(b * 31**i for i, b in enumerate(f"{seed}/{use}".encode())) % (1 << 31)


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: doc_id, source, copy, text; one row per pass of a document and per span.

    Whole passes are copies 0, 1 ... with the text as it is; each span is one more row, its words
    joined by single blanks. The plan of ``mixed`` is joined to the texts by id and text, so one
    shuffle carries them.
    """
    plan = mixed(docs, **settings).filter("taken > 0")
    names = ["plan_id", "plan_source", "plan_hash"]
    plan = plan.groupBy(
        F.col("doc_id").alias("plan_id"), F.col("source").alias("plan_source"), F.col("text_hash").alias("plan_hash")
    ).agg(F.collect_list(F.struct("passes", "spans")).alias("parts"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    # repeated rows share their plans: one row of each carries them all
    rows = rows.dropDuplicates(["doc_id", "source", "text"]).withColumn("hash", F.xxhash64("text"))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(["doc_id", "source", "hash"], names)]
    rows = rows.join(plan, same).withColumn("part", F.explode("parts"))
    words = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))
    cut = lambda x: F.array_join(F.slice(words, (x["start"] + 1).cast("int"), x["words"].cast("int")), " ")
    whole = F.array_repeat("text", F.col("part.passes").cast("int"))
    return rows.select(
        "doc_id", "source", F.posexplode(F.concat(whole, F.transform("part.spans", cut))).alias("copy", "text")
    )


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS documents,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM sources),
capped AS (
  SELECT *, coalesce(sum(most) OVER earlier, 0) AS before, coalesce(sum(weight) OVER earlier, 0) AS lighter,
         sum(source_size) OVER () AS everything, sum(weight) OVER () AS heft
  FROM weighed
  WINDOW earlier AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (
  SELECT *, weight::HUGEINT * (everything - before) >= most::HUGEINT * (heft - lighter) AS at_limit FROM capped),
shared AS (
  SELECT *, everything - coalesce(sum(CASE WHEN at_limit THEN most END) OVER (), 0) AS open_words,
         sum(CASE WHEN NOT at_limit THEN weight END) OVER () AS open_weight FROM flagged),
targets AS (
  SELECT *, CASE WHEN at_limit THEN most::DOUBLE ELSE (weight * open_words)::DOUBLE / open_weight END AS target,
         greatest(1, ceil(greatest(sqrt(source_size) / 64, sqrt(documents) / 16)))::BIGINT AS shards FROM shared),
seats AS (
  SELECT place, weight, unnest(range(0, (weight * open_words / 16.0 / open_weight)::BIGINT + 2)) AS k,
         round(open_words / 16.0)::BIGINT AS blocks FROM targets WHERE NOT at_limit),
won AS (
  SELECT place, count(*) AS quota FROM (
    SELECT place, blocks, row_number() OVER (ORDER BY weight::DOUBLE / (2 * k + 1) DESC, place) AS rank FROM seats)
  WHERE rank <= blocks GROUP BY place),
keyed AS (
  SELECT s.doc_id, s.size, t.place, t.source_size, t.target, t.at_limit, coalesce(w.quota, 0) AS source_quota,
         md5('mix:' || coalesce(s.doc_id::VARCHAR, '')) AS key, t.shards
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN won w USING (place)),
dealt AS (
  SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % shards AS shard FROM keyed),
cells AS (
  SELECT place, shard, sum(size)::BIGINT AS words, any_value(source_quota) AS source_quota, any_value(at_limit) AS at_limit
  FROM dealt GROUP BY place, shard),
cell_seats AS (
  SELECT place, shard, words, source_quota,
         unnest(range(0, (words * source_quota::DOUBLE / greatest(1, sum(words) OVER (PARTITION BY place)))::BIGINT + 3)) AS k
  FROM cells WHERE words > 0),
cell_won AS (
  SELECT place, shard, count(*) AS quota FROM (
    SELECT place, shard, source_quota,
           row_number() OVER (PARTITION BY place ORDER BY words::DOUBLE / (2 * k + 1) DESC, shard) AS rank FROM cell_seats)
  WHERE rank <= source_quota GROUP BY place, shard),
quotas AS (
  SELECT c.place, c.shard, c.words,
         CASE WHEN c.at_limit THEN 3 * c.words ELSE least(coalesce(w.quota, 0) * 16, 3 * c.words) END AS wanted
  FROM cells c LEFT JOIN cell_won w USING (place, shard)),
laid AS (
  SELECT d.*, q.words, CASE WHEN q.words > 0 THEN q.wanted // q.words ELSE 0 END AS passes,
         CASE WHEN q.words > 0 THEN q.wanted % q.words ELSE 0 END AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.place, d.shard ORDER BY d.key, d.doc_id NULLS FIRST, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM dealt d JOIN quotas q USING (place, shard)),
blocks AS (
  SELECT row_number() OVER () AS row, * FROM laid),
touched AS (
  SELECT row, start, size, rest, words // 16 AS n, unnest(range(start // 16, (start + size - 1) // 16 + 1)) AS i
  FROM blocks WHERE size > 0 AND rest > 0),
ranked AS (
  SELECT *, CASE WHEN i < n THEN (i * ({{prime}} % n) + {{shift}}) % n ELSE n END AS rank FROM touched),
cut AS (
  SELECT row, sum(greatest(0, least(i * 16 + CASE WHEN rank < rest // 16 THEN 16 WHEN rank = rest // 16 THEN rest % 16
                                            ELSE 0 END, start + size) - greatest(i * 16, start))) AS extra
  FROM ranked GROUP BY row)
SELECT doc_id, size, source_size, target, (passes * size + coalesce(extra, 0))::BIGINT AS taken
FROM blocks LEFT JOIN cut USING (row)
"""


def oracle() -> str:
    return SQL.replace("{prime}", str(PRIMES[seeded("mix", "prime") % len(PRIMES)])).replace("{shift}", str(seeded("mix", "shift")))


@query("op12_sainte_lague_mix", oracle())
def op12_sainte_lague_mix(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 by source, up to three passes over a source."""
    found = mixed(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")
