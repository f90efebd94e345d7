"""MinHash near-duplicates by an inverted join of signature coordinates.

A document's set is its distinct 5-word windows. Equal sets are one class. Each class has a
signature of COORDINATES minima, and is posted under its (coordinate, value) pairs. Two
classes are candidates if at least MATCHES coordinates agree, which a pair at the threshold
misses with a probability of about 9e-6. Of the posting lists only a prefix is merged: with
pairs ordered by frequency, two classes with MATCHES common pairs share one among the
COORDINATES - MATCHES + 1 rarest of either, so the frequent lists are skipped and only
looked at when the collisions of a candidate are counted. Candidates are confirmed on the
full sets.

A list of up to HOT members yields its pairs. Longer lists are never expanded: lists that share
members form a cluster, whose members are dealt out in blocks; each pair of blocks is one task
that counts collisions, checks candidates on their sets and returns a spanning forest of the
links it finds, so what leaves it grows with its members and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from mirador.sources.tables import stage

from .registry import query, table
from .words import lean, pieces, texts, windows, word_hashes

WIDTH = 5
COORDINATES = 64
MATCHES = 41
#: Lists of more members are not expanded into pairs.
HOT = 64
#: A block of a cluster has about so many members and shingles at most.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 300_000
#: Ids a broadcast may hold (8 bytes each); beyond it the join is a shuffle.
BROADCAST_IDS = 2_000_000

SETS = pa.schema([("set_key", pa.binary()), ("shingles", pa.list_(pa.int64()))])
SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
     ("signature", pa.list_(pa.int64()))]
)


def shingle_sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """Sorted distinct window hashes of each text."""
    words = [t.lower().split() for t in texts(batch.column("text"))]  # ASCII letters and blanks only, as bytes
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    hashes = word_hashes([w for ws in words for w in ws])
    found, counts = windows(hashes, np.cumsum(lengths) - lengths, lengths, width)
    ends = np.cumsum(counts)
    return [np.unique(found[e - c : e]) for e, c in zip(ends, counts)]


def key_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def coordinate_keys(number: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(20240229).integers(0, 2**63, size=(2, number), dtype=np.uint64)
    return drawn[0], drawn[1] * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], number: int) -> np.ndarray:
    """Minima of ``number`` hash orders per set, each with its coordinate in the high bits."""
    flips, factors = coordinate_keys(number)
    out = np.zeros((len(sets), number), dtype=np.int64)
    coordinate = np.arange(number, dtype=np.int64) << 32
    row, step = 0, 1 << 15
    filled = [i for i, s in enumerate(sets) if len(s)]
    while row < len(filled):
        stop, total = row, 0
        while stop < len(filled) and (total == 0 or total + len(sets[filled[stop]]) <= step):
            total += len(sets[filled[stop]])
            stop += 1
        group = [sets[i] for i in filled[row:stop]]
        values = np.concatenate(group)
        starts = np.cumsum([0] + [len(s) for s in group[:-1]])
        with np.errstate(over="ignore"):
            for k in range(number):
                least = np.minimum.reduceat((values ^ flips[k]) * factors[k], starts)
                out[filled[row:stop], k] = (least >> np.uint64(32)).astype(np.int64) | coordinate[k]
        row = stop
    return out


def signed(docs: DataFrame, width: int = WIDTH, number: int = COORDINATES) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, signature) per row; an empty set has null key and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = shingle_sets(batch, width)
                minima = signatures(sets, number)
                filled = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("text_hash"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([key_of(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([m if ok else None for m, ok in zip(minima, filled)], pa.list_(pa.int64())),
                    ],
                    schema=SIGNED,
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(
        lean(run), "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, signature array<bigint>"
    )


def sets_of(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(set_key, shingles) of each text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = [s for s in shingle_sets(batch, width) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key_of(s) for s in sets], pa.binary()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    schema=SETS,
                )

    return docs.select("text").mapInArrow(lean(run), "set_key binary, shingles array<bigint>")


def postings(classes: DataFrame, number: int, matches: int) -> DataFrame:
    """(token, node, n_shingles): the prefix of each class, without lists of one member."""
    tokens = classes.select("node", "n_shingles", F.explode("signature").alias("token"))
    shared = (
        tokens.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    )
    shared = stage(shared, "neardup-lists")
    ranked = (
        tokens.join(shared, "token")
        .groupBy("node", "n_shingles")
        .agg(F.sort_array(F.collect_list(F.struct("members", "token"))).alias("lists"))  # one per coordinate at most
    )
    alone = F.lit(number) - F.size("lists")
    return ranked.select(
        "node",
        "n_shingles",
        F.explode(F.slice("lists", F.lit(1), F.greatest(F.lit(number - matches + 1) - alone, F.lit(0)))).alias("l"),
    ).select(F.col("l.token").alias("token"), "node", "n_shingles")


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable. Alternates large and small stars."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = large.filter("u > v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .filter("u > v")
            .distinct()
        )
        after = stage(small, "stars")
        # both hold each edge once
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.join(stars, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def cold_pairs(lists: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a < b: members of one short list whose set sizes allow a link."""
    side = lambda s: lists.select("token", F.col("node").alias(s), F.col("n_shingles").alias(f"size_{s}"))
    fits = F.lit(100) * F.least("size_a", "size_b") >= F.lit(threshold) * F.greatest("size_a", "size_b")
    return side("a").join(side("b"), "token").filter((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks, by products of 0/1 matrices."""
    distinct, place, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    common = count[place] > 1
    column = (np.cumsum(count > 1) - 1)[place[common]]
    owner = owner[common]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [first, first + columns])
        shown = np.zeros((len(left) + len(right), columns), dtype=np.float32)
        shown[owner[a:b], column[a:b] - first] = 1
        out += shown[: len(left)] @ shown[len(left) :].T
    return out


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of these links, those that join what the ones before them have not."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        tx, ty = top(x), top(y)
        if tx != ty:
            root[tx] = ty
            kept.append((x, y))
    return kept


def block_links(members: pa.Table, matches: int, threshold: int) -> pa.Table:
    """A spanning forest of the links between two blocks (or within one)."""
    nodes = members.column("node").to_numpy()
    second = members.column("second").to_numpy(zero_copy_only=False)
    sets = [s.values.to_numpy() for s in members.column("shingles")]
    minima = np.stack([s.values.to_numpy() for s in members.column("signature")])
    right = np.flatnonzero(second) if second.any() and not second.all() else np.arange(len(nodes))
    left = np.flatnonzero(~second) if second.any() and not second.all() else right
    equal = np.zeros((len(left), len(right)), dtype=np.int16)
    for k in range(minima.shape[1]):
        equal += minima[left, k][:, None] == minima[right, k][None, :]
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    common = intersections([sets[i] for i in left], [sets[i] for i in right])
    union = sizes[left][:, None] + sizes[right][None, :] - common
    linked = (equal >= matches) & (100 * common >= threshold * union)
    linked &= nodes[left][:, None] < nodes[right][None, :] if left is right else nodes[left][:, None] != nodes[right][None, :]
    x, y = np.nonzero(linked)
    kept = forest(nodes[left[x]], nodes[right[y]])
    return pa.table([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])


def hot_links(hot: DataFrame, classes: DataFrame, sets: DataFrame, matches: int, threshold: int) -> DataFrame:
    """Links within clusters of long lists, found block by block."""
    first = hot.groupBy("token").agg(F.min("node").alias("a"))
    nodes = hot.select("node", "n_shingles").distinct()
    stars = hot.join(first, "token").select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    labels = components(stars, nodes.select("node"))
    clustered = stage(nodes.join(labels, "node"), "neardup-clusters")
    blocks = clustered.groupBy("label").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_MEMBERS)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))
        ).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        clustered.join(blocks, "label")
        .select("node", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(
            "node", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).alias("second"),
        )
    )
    full = dealt.join(classes.select("node", "signature"), "node").join(sets, "node")
    return full.groupBy("label", "i", "j").applyInArrow(
        lambda members: block_links(members, matches, threshold), "a bigint, b bigint"
    )


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, matches: int, threshold: int) -> DataFrame:
    """(a, b, linked): pairs with enough equal coordinates, checked on their sets."""
    side = lambda s: classes.select(F.col("node").alias(s), F.col("signature").alias(f"signature_{s}"))
    equal = F.size(F.array_intersect("signature_a", "signature_b"))  # values hold their coordinate
    likely = pairs.join(side("a"), "a").join(side("b"), "b").filter(equal >= matches).select("a", "b")
    likely = stage(likely, "neardup-likely")
    of = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"set_{s}"))
    both = likely.join(of("b"), "b").join(of("a"), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.select("a", "b", (F.lit(100) * common >= F.lit(threshold) * union).alias("linked"))


def grouped(
    docs: DataFrame,
    width: int = WIDTH,
    threshold: int = 85,
    number: int = COORDINATES,
    matches: int = MATCHES,
) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, label, kept for every row of ``docs`` (doc_id, text).

    Rows of a component share a label, which no other component has; it is null for an empty set.
    Documents are linked where 100 * intersection >= threshold * union of their sets; the
    component_id is the smallest doc_id reachable. A null, empty or blank text has an empty
    set, is linked with nothing and is its own component. Rows of one doc_id and equal sets
    are all kept or none; rows of one doc_id and different sets are separate documents. A row
    with a null doc_id takes part and is kept only where its component has no id, so that no
    text is lost. An empty table gives no rows. Other columns are not looked at.
    """
    signed_docs = stage(signed(docs, width, number), "neardup-signed")
    classes = (
        signed_docs.filter("set_key IS NOT NULL")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
        )
        .withColumn("node", F.monotonically_increasing_id())  # fixed once written
    )
    classes = stage(classes, "neardup-classes")
    lists = stage(postings(classes, number, matches), "neardup-postings")
    nodes = stage(lists.select("node").distinct(), "neardup-nodes")
    wanted = classes.join(nodes, "node", "left_semi").select("set_key", "node", "least_id")
    ids = wanted.select("least_id").distinct()
    ids = F.broadcast(ids) if nodes.count() <= BROADCAST_IDS else ids
    texts_of = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi")
    sets = (
        sets_of(texts_of, width).join(wanted.select("set_key", "node"), "set_key").dropDuplicates(["node"])
    )
    sets = stage(sets.select("node", "shingles"), "neardup-sets")

    sizes = lists.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    long = stage(sizes.filter(F.col("members") > HOT), "neardup-long").select("token")
    cold = lists.join(long, "token", "left_anti")
    checked = confirmed(cold_pairs(cold, threshold), classes, sets, matches, threshold)
    hot = stage(lists.join(long, "token", "left_semi"), "neardup-hot")
    links = checked.filter("linked").select("a", "b")
    if not hot.isEmpty():
        links = links.unionByName(hot_links(hot, classes, sets, matches, threshold))
    labels = components(links, nodes)

    named = classes.join(labels, "node", "left").select(
        "set_key", "least_id", F.coalesce("label", "node").alias("label")
    )
    smallest = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = stage(named.join(smallest, "label").select("set_key", "component_id", "label"), "neardup-named")
    return (
        signed_docs.select("doc_id", "text_hash", "n_shingles", "set_key")
        .join(named, "set_key", "left")
        .select(
            "doc_id",
            "text_hash",
            "n_shingles",
            F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            "label",
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def near_duplicates(docs: DataFrame, **limits: int) -> DataFrame:
    """The columns of ``grouped`` (see there, also for ``limits``) without label."""
    return grouped(docs, **limits).drop("label")


@query("op9_minhash_near_dedup")
def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, folder, "documents")).drop("text_hash")
