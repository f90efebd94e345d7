"""Collocations, mixing and hard negatives against brute force, on the small tables and on odd rows."""

import collections
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mirador.llm import collocations, hattrie, mixing, negatives

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module", params=["documents", "odd_documents", "no_documents"])
def docs(request):
    return request.getfixturevalue(request.param)


# HAT-trie


@pytest.mark.parametrize("size, number, vocabulary, most", [(2, 1000, 50, 100), (3, 200_000, 4000, 50_000), (5, 200_000, 6, 60_000)])
def test_trie_counts_like_a_dictionary(size, number, vocabulary, most):
    ids = np.random.default_rng(1).zipf(1.3, number) % vocabulary + 1
    keys = np.stack([ids[i : number - size + 1 + i] for i in range(size)]).astype(np.uint64)
    trie = hattrie.HatTrie(size, most)
    got = collections.Counter()
    for held, counts in [*trie.add(keys), *trie.rest()]:
        assert (hattrie.in_order(held) == np.arange(len(counts))).all()  # a run is sorted
        for key, n in zip(zip(*held.tolist()), counts.tolist()):
            got[key] += n
    assert got == collections.Counter(zip(*keys.tolist()))


def test_trie_bursts_one_first_word():
    """All phrases under one word: the trie grows below it."""
    ids = np.arange(1, 100_001)
    trie = hattrie.HatTrie(2)
    runs = list(trie.add(np.stack([np.full(len(ids), 7), ids]).astype(np.uint64)))
    assert any(isinstance(c, hattrie.Node) for c in trie.root.children)
    runs += trie.rest()
    assert sum(len(c) for _, c in runs) == len(ids) and all((c == 1).all() for _, c in runs)


# collocations


def phrases_by_hand(rows, min_count, longest, absorbed, most):
    total, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    found = collections.defaultdict(list)
    held = {p: n for p, n in f.items() if n >= min_count}
    inside = collections.Counter()
    for (lang, p), n in held.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                inside[lang, p[i : i + size]] = max(inside[lang, p[i : i + size]], n)
    for (lang, p), a in held.items():
        if len(p) < 2 or ((lang, p) in inside and 100 * inside[lang, p] >= absorbed * a):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]], total[lang], score))
    return sorted(
        (lang, rank, r[2].decode(), *r[3:]) for lang, rs in found.items() for rank, r in enumerate(sorted(rs)[:most], 1)
    )


@pytest.mark.parametrize("min_count, absorbed, most, trie", [(2, 100, 10**9, 1000), (5, 60, 7, 10**6)])
def test_collocations_by_hand(docs, min_count, absorbed, most, trie):
    docs = docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 40_000)  # by hand the long ones take minutes
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = collocations.collocations(docs, min_count, absorbed=absorbed, most=most, trie_phrases=trie).collect()
    assert sorted(map(tuple, got)) == phrases_by_hand(rows, min_count, 5, absorbed, most)


def test_collocations_over_slices_and_chunks(spark):
    text = "a b a b c, " * 200 + "\x01 b a\x0b a"
    docs = spark.createDataFrame([("x", text), (None, text), ("x", None), ("", "a b")], "lang string, text string").coalesce(1)
    rows = [(r.lang, r.text) for r in docs.collect()]
    got = collocations.collocations(docs, 3, chunk_tokens=300)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, 3, 5, 100, 2000)
    whole, sliced = collocations.Chunk(), collocations.Chunk(slice_bytes=50)
    for chunk in (whole, sliced):
        chunk.add("x", text.encode())
    assert (np.concatenate(whole.parts) == np.concatenate(sliced.parts)).all() and len(sliced.parts) > 20


def test_false_positives_of_the_bitmap_cost_nothing_but_work(docs):
    """With a bitmap of 64 bits nearly everything passes, and the result is the same."""
    few = docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 2000)
    want = sorted(map(tuple, collocations.collocations(few, 3).collect()))
    assert sorted(map(tuple, collocations.collocations(few, 3, bitmap_bits=6).collect())) == want


def test_cells_add_up_over_rows_and_parts():
    rng = np.random.default_rng(3)
    cells = rng.zipf(1.2, 60_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)
    want = {c for c, n in collections.Counter(cells.tolist()).items() if n >= 20}
    rows = [(r["part"], r["cells"], r["counts"]) for at in range(0, 60_000, 7000) for b in collocations.dealt(cells[at : at + 7000], 3) for r in b.to_pylist()]
    assert len({part for part, *_ in rows}) == 8
    rows = pa.Table.from_pylist([dict(zip(("part", "cells", "counts"), r)) for r in sorted(rows)])
    for at_once in (100, 10**6):
        found = [b.column("id_0").to_pylist() for b in collocations.frequent_in(iter(rows.to_batches(max_chunksize=5)), 20, at_once)]
        assert sorted(sum(found, [])) == sorted(want) and want
    assert [b.num_rows for b in collocations.frequent_in(iter([]), 20, 100)] == [0]
    odd = np.array([0, 1, 255, 256, 2**48 - 1, 2**63], dtype=np.uint64)
    assert (collocations.unpacked(collocations.packed(odd)) == odd).all()


def test_runs_add_up_over_blocks_and_parts():
    rng = np.random.default_rng(4)
    words, want, rows = rng.integers(1, 2**64, 40, dtype=np.uint64), collections.Counter(), []
    for task in range(12):
        trie = hattrie.HatTrie(3, 900)
        phrases = words[np.minimum(rng.zipf(1.3, (3, 4000)), 40) - 1]
        want.update(map(tuple, phrases.T.tolist()))
        runs = itertools.chain(trie.add(phrases), trie.rest())
        found = [r for b in collocations.blocks(runs, 2, 10**6 if task % 2 else 500) for r in b.to_pylist()]
        assert len(found) == 4 if task % 2 else 4 < len(found) < 100
        rows += [(r["part"], r["phrases"], r["counts"]) for r in found]
    rows = pa.Table.from_pylist([dict(zip(("part", "phrases", "counts"), r)) for r in sorted(rows)])
    want = sorted((*p, n) for p, n in want.items() if n >= 20)
    for at_once in (100, 10**6):
        got = [r for b in collocations.frequent_phrases(iter(rows.to_batches(max_chunksize=5)), 3, 20, at_once) for r in b.to_pylist()]
        unsigned = [(*(r[f"id_{i}"] % 2**64 for i in range(3)), r["a"]) for r in got]
        assert sorted(unsigned) == want and len(want) > 100


def test_counts_of_a_task_travel_together(documents, monkeypatch):
    """What tasks send has a row for a part of a run, not for each phrase that a task counted."""
    few, sent = documents.filter(F.length("text") < 2000), []
    repartition = type(few).repartition
    monkeypatch.setattr(type(few), "repartition", lambda rows, *by: sent.append(rows.count()) or repartition(rows, *by))
    assert collocations.collocations(few, 3).count() > 100
    assert len(sent) >= 6 and max(sent) <= 16


def test_cells_are_dealt_out_bit_by_bit(docs):
    """With a few cells at a time, many rows for a part, the result is the same."""
    few = docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 2000)
    want = sorted(map(tuple, collocations.collocations(few, 3).collect()))
    assert sorted(map(tuple, collocations.collocations(few, 3, cells_at_once=500).collect())) == want


def test_words_that_share_an_id_are_hashed_again(spark):
    """Under the first seed all words share an id; the second keeps them apart."""
    whole = collocations.word_id
    docs = spark.createDataFrame([("x", "a b a b c"), ("y", "a b a b")], "lang string, text string")
    got = collocations.collocations(docs, 2, identify=lambda lang, word, seed: whole(lang, word, seed) if seed else 5)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(docs.collect(), 2, 5, 100, 9) != []


# mixing


def quotas_by_hand(shares, seats):
    """Sainte-Laguë one seat at a time."""
    won = [0] * len(shares)
    for _ in range(seats if any(shares) else 0):
        won[max(range(len(shares)), key=lambda i: (shares[i] / (2 * won[i] + 1), -i))] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_seat_by_seat(spark, seed):
    rng = np.random.default_rng(seed)
    groups = [([int(x) for x in rng.integers(0, 50, rng.integers(1, 12))], int(rng.integers(0, 200))) for _ in range(20)]
    groups += [([5, 2, 1] * 4, 1000), ([1], 0), ([0, 0], 5), ([3, 3, 3], 4)]
    rows = [(g, k, s, seats) for g, (shares, seats) in enumerate(groups) for k, s in enumerate(shares)]
    frame = spark.createDataFrame(rows, "g int, k int, share bigint, seats bigint")
    got = {(r.g, r.k): r.quota for r in mixing.apportion(frame, ["g"], "k", "share", "seats").collect()}
    assert got == {(g, k): n for g, (shares, seats) in enumerate(groups) for k, n in enumerate(quotas_by_hand(shares, seats))}


def targets_by_hand(sizes, weights, most):
    """Reshare the excess by weight until no source is above its limit."""
    left, open_sources, target = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_sources:
        weight = sum(weights[i] for i in open_sources)
        above = {i for i in open_sources if left * weights[i] / weight >= most * sizes[i]}
        if not above:
            for i in open_sources:
                target[i] = left * weights[i] / weight
            break
        for i in above:
            target[i] = float(most * sizes[i])
            left -= target[i]
        open_sources -= above
    return target


def test_mix_of_documents(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    got = mixing.mixed(docs).collect()
    count = lambda text: len(WORDS.findall(text or ""))
    assert sorted((str(r.doc_id), r.size, str(r.source)) for r in got) == sorted(
        (str(r.doc_id), count(r.text), str(r.source)) for r in rows
    )
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(count(r.text) for r in rows if r.source == name) for name in names]
    wanted = targets_by_hand(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    for name, size, target in zip(names, sizes, wanted):
        own = [r for r in got if r.source == name]
        assert {r.source_size for r in own} == {size}
        assert all(r.target == pytest.approx(target) for r in own)
        shards = len({r.shard for r in own})
        assert abs(sum(r.taken for r in own) - target) <= 16 + 16 * (shards if target >= 2.9 * size else 0)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.passes * r.size + sum(s.words for s in r.spans)
        assert all(0 <= s.start and s.words > 0 and s.start + s.words <= r.size for s in r.spans)


def test_mix_reruns_agree_and_limits_hold(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), "abc"[i % 3] if i % 50 else None) for i in range(3000)]
    rows += [(i, "one two three", "small") for i in range(5)] + [(1, None, "empty"), (2, " ", "empty")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    first = sorted(map(tuple, mixing.mixed(docs).collect()), key=str)
    assert first == sorted(map(tuple, mixing.mixed(docs.repartition(7, "text")).collect()), key=str)
    by = collections.defaultdict(lambda: [0, 0])
    for r in mixing.mixed(docs).collect():
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert by["empty"] == [0, 0.0]
    assert by["small"] == [45, 45.0]  # weight 5 would be more than three passes
    for taken, target in by.values():
        assert abs(taken - target) <= 16


def test_mixture_texts(spark):
    rows = [(i, f"a{i} b{i}\tc{i}\n" * 9, "xy"[i % 2]) for i in range(40)] + [(7, None, None), (7, "", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    plan = {r.doc_id: r for r in mixing.mixed(docs).collect() if r.size}
    texts = collections.defaultdict(list)
    for r in mixing.mixture(docs).collect():
        texts[r.doc_id].append((r.copy, r.text))
    for i, r in plan.items():
        found = [t for _, t in sorted(texts[i])]
        assert found[: r.passes] == [rows[i][1]] * r.passes
        words = rows[i][1].split()
        assert found[r.passes :] == [" ".join(words[s.start : s.start + s.words]) for s in r.spans]


# hard negatives


def negatives_by_hand(rows):
    fine = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (label, v)
        fine[i] = min(fine.get(i, key), key)
    scaled = {i: [math.floor(256 * x) for x in v] for i, (_, v) in fine.items()}
    out = []
    for a in [i for i in fine if i % 100 == 0]:
        others = [i for i in fine if i != a and len(scaled[i]) == len(scaled[a])]
        score = {i: sum(x * y for x, y in zip(scaled[a], scaled[i])) for i in others}
        order = sorted(others, key=lambda i: (-score[i], i))
        for p in [i for i in order if fine[i][0] == fine[a][0]][:5]:
            hard = [i for i in order if fine[i][0] != fine[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(hard[:10], 1)]
    return sorted(out)


def vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    return frame.withColumns({"score": F.lit("x"), "block": F.lit(1), "rank": F.lit(0)})


@pytest.mark.parametrize("scale_of", [1.0, 1e-3, 3e4, 1e6])
@pytest.mark.parametrize("blocks", [(8192, 8192), (60, 3)])
def test_negatives_by_hand(spark, scale_of, blocks):
    rng = np.random.default_rng(5)
    rows = [(i * 10, [float(x) for x in rng.normal(size=6) * scale_of + scale_of / 2], int(rng.integers(0, 4))) for i in range(300)]
    rows += [(100, None, 1), (None, rows[0][1], 1), (7, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (8, [float("nan")] * 6, 1),
             (9, [0.0] * 6, 2), (9, [0.0] * 6, 2), (11, rows[10][1], None), (13, [float("inf")] * 6, 0),
             (15, rows[10][1], rows[10][2]), (16, rows[10][1], rows[10][2]), (17, rows[10][1], (rows[10][2] + 1) % 4),
             (20, rows[3][1], 0), (31, [1.0, 2.0], 1), (500_000, [1.0, 3.0], 1), (33, [0.5, 1.0], 2), (35, [], 1)]
    got = negatives.mined(vectors(spark, rows), F.col("vec_id") % 100 == 0, block_rows=blocks[0], anchor_rows=blocks[1])
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows)


def test_negatives_refuse_what_does_not_fit(spark):
    rows = [(0, [1e12, 1e12], 1), (1, [1e12, 1e12], 1), (2, [1.0, 1.0], 2)]
    with pytest.raises(Exception, match="64 bits"):
        negatives.mined(vectors(spark, rows), F.col("vec_id") == 0).collect()


def test_negatives_of_few_rows(spark):
    anchors = F.col("vec_id") % 100 == 0
    assert negatives.mined(vectors(spark, []), anchors).collect() == []
    assert negatives.mined(vectors(spark, [(0, [1.0], 1)]), anchors).collect() == []
    assert negatives.mined(vectors(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [-1.0], 2)]), anchors).collect() == []
    got = negatives.mined(vectors(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]), anchors).collect()
    assert list(map(tuple, got)) == [(0, 1, 1, 2, 65536, 32768)]


@pytest.mark.parametrize("least, most", [(0, 0), (-5, -5), (-(1 << 40), 1 << 20), (1 << 30, 1 << 30)])
def test_packed_products(least, most):
    rng = np.random.default_rng(2)
    rows = rng.integers(least, most + 1, (9, 4))
    anchor = rng.integers(-300, 300, 4).tolist()
    low = min(anchor)
    pack = negatives.Packed(rows, low, [x - low for x in anchor])
    got = pack.products([x - low for x in anchor], sum(x - low for x in anchor))
    assert got.tolist() == [sum(x * y for x, y in zip(anchor, r)) for r in rows.tolist()]
