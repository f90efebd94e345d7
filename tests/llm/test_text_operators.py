"""Text operators against brute force, on the small tables and on odd rows."""

import collections
import hashlib
import math
import os
import random
import re
import tracemalloc
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mirador.llm import bpe, langid, linefreq, lm, neardup, packing
from mirador.llm.trie import EliasFano, Trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", params=["documents", "odd_documents"])
def docs(request):
    return request.getfixturevalue(request.param)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def multiset(rows):
    return sorted(rows, key=str)


# byte-level BPE


def test_bpe_against_tiktoken(docs, vocabularies):
    path, pattern = vocabularies["byte_bpe_multi_50k.tiktoken"], vocabularies["pattern"]
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = bpe.round_trip(docs, path, pattern).collect()
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows_of(docs)]
    assert multiset((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got) == multiset(want)


def test_bpe_digests(spark, vocabularies):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    found = {r.doc_id: r for r in bpe.digests(docs, vocabularies["byte_bpe_multi_50k.tiktoken"], vocabularies["pattern"]).collect()}
    assert found[2].n_tokens == 0 and found[2].ids_sha256 == found[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[1].decoded_sha256 == hashlib.sha256(b"a b").hexdigest()


def test_bpe_words_of_any_shape(vocabularies):
    ranks, pattern = bpe.read_ranks(vocabularies["byte_bpe_multi_50k.tiktoken"]), vocabularies["pattern"]
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(3)
    odd = ["", "  a  b \n\n c\t d", "a\x1cb !\x1c\x1c  x", "　a  b", "it's  we'll 123\r\n\r\n  x  ", " lead", "trail ", "\n a", "\n  a", "\x85 b"]
    odd += ["=" * 200, "a" * 999, "abcabc" * 50, "é" * 40]
    odd += ["".join(rng.choice(list("abcdefgh "), size=int(n))) for n in rng.integers(1, 300, 60)]
    codec = bpe.Codec(ranks, pattern)
    ids, spelled = codec.encode(odd)
    assert spelled == [",".join(map(str, i.tolist())) for i in ids]
    assert [i.tolist() for i in ids] == [library.encode_ordinary(t) for t in odd]
    assert codec.decode(ids) == [t.encode() for t in odd]


# packing


def test_packing(docs, vocabularies):
    path = vocabularies["byte_bpe_50k.json"]
    library = Tokenizer.from_file(path)
    want, total = [], 0
    for i, t in rows_of(docs):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        start, first = 0, (len(ids) - 1) % 1024 + 1
        for n in range(-(-len(ids) // 1024)):
            stop = start + (1024 if n else first)
            want.append((i, n, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
            start = stop
        total += len(ids)
    got = packing.packed_pieces(docs, path).collect()
    assert multiset((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == multiset(want)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for content in places.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= math.ceil(total / 1024) * 1.01 + 2


def test_packing_has_added_tokens_as_the_library(spark, vocabularies):
    path = vocabularies["byte_bpe_50k.json"]
    library = Tokenizer.from_file(path)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b.", "x <|endoftext|", "<|endof text|>. <|endoftext|>."]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id int, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.packed_pieces(docs, path).collect()}
    for i, text in enumerate(texts * 3):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))
    assert 50256 in library.encode(texts[0], add_special_tokens=False).ids


def test_parts_of_texts_have_the_ids_of_the_library(vocabularies):
    """Lines, marks, contractions, white space of all kinds and added tokens, in random texts, batch by batch."""
    with open(vocabularies["byte_bpe_50k.json"], encoding="utf-8") as file:
        vocabulary = file.read()
    library, added = Tokenizer.from_str(vocabulary), packing.added_tokens(vocabulary)
    memory = packing.memory_of(vocabulary, 300)  # forgets, too
    rng = random.Random(1)
    chars = [*"abZ é漢09²\n\n\t  .,;!?#*$%&|<>()'\"-_\r\x1c\x85\xa0\u3000\u0301\U0001f600", "'s", " the", "<|endoftext|>"]
    texts = [None, "", " ", "\n", *("".join(rng.choices(chars, k=rng.randint(0, 12))) for _ in range(4000))]
    for at in range(0, len(texts), 500):
        some = pa.array(texts, pa.string()).slice(at, 500)
        ids, ends = packing.ids_of(some, memory, added, 2)
        found = [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]
        assert found == [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in some.to_pylist()]
    ids, ends = packing.ids_of(pa.array([], pa.string()), memory, added, 2)
    assert (len(ids), len(ends)) == (0, 0)


def test_a_part_is_looked_up_once_for_all_its_places(vocabularies, monkeypatch):
    """Work in Python follows the distinct parts of a batch; line ends and marks make no new words."""
    with open(vocabularies["byte_bpe_50k.json"], encoding="utf-8") as file:
        memory = packing.memory_of(file.read(), 1000)
    seen, new = [], []
    find, learn = memory.find, memory.learn
    monkeypatch.setattr(memory, "find", lambda every, times: seen.extend(every) or find(every, times))
    monkeypatch.setattr(memory, "learn", lambda some: new.extend(some) or learn(some))
    words = ["thonin", "whon", "estien", "réhean"]
    text = "".join(f" {a}. {a}*** {a},\n{b} {a}" for a in words for b in words) * 50
    ids, ends = packing.ids_of(pa.array([text] * 3), memory, None, 2)
    assert ends.tolist() == [len(ids) // 3 * k for k in (1, 2, 3)]
    assert len(seen) < 120  # 28 parts after a blank, of up to four segments; the texts have 9,600
    assert sorted(new) == sorted([*words, *(" " + w for w in words), ".", ",", "***", "\n"])
    assert memory.met[memory.places["***"]] == 3 * 50 * 16


@pytest.mark.parametrize("number", [60, 1500, 19_000, 21_000])
def test_small_and_large_tables_go_through_the_program(number, monkeypatch):
    """Most pieces are placed by configurations of the program, at any size."""
    lengths = np.minimum(np.random.default_rng(number).geometric(1 / 300, number), 1024)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    left = []
    whole = packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda rest, capacity: left.append(sum(rest.values())) or whole(rest, capacity))
    packed = packing.pack(histogram)
    assert left[0] <= (0.9 if number < 1000 else 0.6) * number
    assert sum(packed.values()) <= sum(whole(histogram, 1024).values()) * 1.005 + 1


@pytest.mark.parametrize("kind", ["uniform", "long", "short", "one"])
def test_configurations_hold_the_histogram(kind):
    rng = np.random.default_rng(1)
    lengths = {
        "uniform": rng.integers(1, 1024, 40_000), "long": rng.integers(500, 1025, 30_000),
        "short": rng.integers(1, 40, 30_000), "one": np.full(50_000, 700),
    }[kind]
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    packed = packing.pack(histogram)
    held = collections.Counter()
    for configuration, n in packed.items():
        assert sum(length * copies for length, copies in configuration) <= 1024
        for length, copies in configuration:
            held[length] += copies * n
    assert held == histogram
    assert sum(packed.values()) <= sum(packing.best_fit(histogram, 1024).values()) * 1.005 + 1


# language model


def brute_scores(rows, held, discount, prior):
    tokens = [(i, lower(t).encode().split() + [None]) for i, t in rows]
    one, two, three, pairs, kinds, firsts = (collections.Counter() for _ in range(6))
    for (_, words), out in zip(tokens, held):
        line = ["^", "^", *words]
        for u, v, w in () if out else zip(line, line[1:], line[2:]):
            one[w] += 1
            two[v, w] += 1
            firsts[v] += 1
            pairs[u, v] += 1
            kinds[u, v] += not three[u, v, w]
            three[u, v, w] += 1
    total, known = sum(one.values()), len(one)
    for (i, words), out in zip(tokens, held):
        line, base, score = ["^", "^", *words], 0.0, 0.0
        for u, v, w in zip(line, line[1:], line[2:]):
            p1 = (one[w] + 0.1) / (total + 0.1 * (known + 1))
            p2 = (two[v, w] + prior * p1) / (firsts[v] + prior)
            n = pairs[u, v]
            p3 = max(three[u, v, w] - discount, 0) / n + discount * kinds[u, v] / n * p2 if n else p2
            base, score = base + math.log10(p1), score + math.log10(p3)
        yield i, out, len(words), sum(one[w] > 0 for w in words), total, base, score


@pytest.mark.parametrize("sizes", [{}, {"chunk_tokens": 300, "shard_tokens": 1000}])
def test_lm_scores(docs, sizes):
    rows = rows_of(docs)
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for i, _ in rows]
    condition = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    paired = lambda found: sorted(map(tuple, found), key=lambda r: (str(r[:5]), r[5]))
    got = paired(lm.score(docs, condition, **sizes).collect())
    want = paired(brute_scores(rows, held, lm.DISCOUNT, lm.PRIOR))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want], rel=1e-2)


def test_lm_ids_belong_to_one_word_each():
    hashes = np.unique(np.random.default_rng(5).integers(0, 2**64, 5000, dtype=np.uint64))
    for bits in (1, 6, 12, 20, 55):
        clashes = lm.clashing(hashes, bits)
        ids = lm.ids_of(hashes, clashes, bits)
        assert len(np.unique(ids)) == len(hashes) and ids.max() < lm.BEGIN_ID
    shards = np.split(hashes, [1234, 3000])  # words on both sides of a border may agree
    clashes = np.sort(np.concatenate([lm.clashing(s, 6) for s in shards]))
    assert len(np.unique(lm.ids_of(hashes, clashes, 6))) == len(hashes)
    assert [lm.id_width(n) for n in (0, 1, 1 << 20, 1 << 30, 1 << 50)] == [1, 1, 26, 46, lm.MOST_ID_BITS]


@pytest.mark.parametrize("bits", [1, 7])
def test_lm_scores_do_not_depend_on_the_width_of_ids(docs, monkeypatch, bits):
    paired = lambda found: sorted(map(tuple, found), key=str)
    sizes = {"chunk_tokens": 300, "shard_tokens": 1000}
    want = paired(lm.score(docs, F.lit(False), **sizes).collect())
    monkeypatch.setattr(lm, "id_width", lambda n_words: bits)
    got = paired(lm.score(docs, F.lit(False), **sizes).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-12)


def test_lm_without_teachers(odd_documents):
    for r in lm.score(odd_documents, F.lit(True)).collect():
        assert r.train_tokens == r.n_known == 0 and r.score == pytest.approx(r.base_score, abs=1e-6)


def peak_of(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_lm_steps_take_little_memory_a_token():
    """Several workers of an executor hold a chunk or a shard each, beside each other."""
    rng = np.random.default_rng(11)
    n, packets, windows = 60_000, [], []
    for chunk in range(6):
        ids, codes = np.unique(rng.zipf(1.3, n) % 20_000, return_inverse=True)
        lengths, held = np.full(n // 60, 60), rng.random(n // 60) < 0.1
        windows.append((codes, lengths, held, ids, 3))
        found = lm.Windows(*windows[-1])
        counts = np.bincount(found.gram[found.trains], minlength=len(found.w))
        for shard, pairs, grams in found.packets(3):
            owner = np.searchsorted(pairs, found.gram_pair[grams])
            named, number = np.unique(np.concatenate([found.ids[x] for x in (found.u[pairs], found.v[pairs], found.w[grams])]), return_inverse=True)
            a, b = len(pairs), 2 * len(pairs)
            payload = lm.packed(lm.gaps(named), lm.gaps(number[:a]), number[a:b], number[b:], np.bincount(owner, minlength=a), counts[grams])
            packets.append((shard, chunk, payload))
    assert peak_of(lambda: lm.Windows(*windows[0])) < 90 * n
    of_one = [p for p in packets if p[0] == 1]
    table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*of_one), lm.PACKETS)], schema=lm.PACKETS)
    grams = sum(len(lm.unpacked(p[2])[-1]) for p in of_one)
    assert peak_of(lambda: lm.answer_grams(table, lm.DISCOUNT)) < 100 * grams


@pytest.mark.parametrize("size,top", [(0, 1), (1, 1), (5, 3), (1000, 10), (1000, 10**6), (3000, 2**48)])
def test_elias_fano(size, top):
    rng = np.random.default_rng(size)
    values = np.sort(rng.integers(0, top, size))
    sequence = EliasFano.of(values)
    assert (sequence.get(np.arange(size)) == values).all()
    wanted = np.concatenate([values, rng.integers(0, top + 5, 300)])
    for x, at in zip(wanted, sequence.find(wanted)):
        assert values[at] == x if at >= 0 else x not in values


def test_trie_finds_its_grams_and_no_others():
    rng = np.random.default_rng(0)
    grams = np.unique(rng.integers(0, 60, (20_000, 3)) * 7919, axis=0)
    words = np.unique(grams)
    trie = Trie(words, np.searchsorted(words, grams), [np.arange(len(grams))])

    def find(asked):
        own, number = np.arange(len(asked)), [trie.numbers(asked[:, k]) for k in range(3)]
        node = trie.children(0, np.zeros(1, dtype=np.int64), np.zeros(len(asked), dtype=np.int64), number[0])
        node = trie.children(1, node, own, number[1])
        return trie.children(2, node, own, number[2])

    assert (find(grams) == np.arange(len(grams))).all()
    asked, known = rng.integers(0, 70, (5000, 3)) * 7919, set(map(tuple, grams.tolist()))
    assert all((at >= 0) == (tuple(g) in known) for g, at in zip(asked.tolist(), find(asked)))


@pytest.mark.parametrize("top", [50, 5_000, 1 << 40])
def test_neighbours_find_their_range_once(top, monkeypatch):
    """Values that share their high bits ask for one range; what is found stays the same."""
    rng = np.random.default_rng(top)
    values = np.sort(rng.integers(0, top, 4000))
    sequence = EliasFano.of(values)
    assert np.array_equal(sequence.get(np.arange(len(values))), values)
    asked = np.sort(np.concatenate([rng.choice(values, 3000), rng.integers(0, 2 * top, 3000)]))
    ranges, zero = [], EliasFano.zero
    monkeypatch.setattr(EliasFano, "zero", lambda self, number: ranges.append(len(number)) or zero(self, number))
    found = sequence.find(asked)
    high = asked >> sequence.shift
    assert sum(ranges) <= 2 * len(np.unique(high))
    first = np.searchsorted(values, asked)
    known = np.isin(asked, values)
    assert np.array_equal(found, np.where(known, first, -1))
    mixed = rng.permutation(asked)
    assert np.array_equal(np.sort(sequence.find(mixed)), np.sort(found))


# language identification


def test_language_of_held_out_documents(documents):
    found = langid.predictions(documents, langid.learn(langid.teachers(documents)))
    rows = found.join(documents.select("doc_id", "lang"), "doc_id").filter(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)


def plain_kneser_ney(words_of, order):
    """Probability of a character after others, from the formula; words are padded with blanks."""
    models = {}
    for lang, words in words_of.items():
        grams = collections.Counter()
        for word, n in words.items():
            shown = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in word)
            for part in shown.split():
                line = " " * (order - 1) + part + " "
                for i in range(order - 1, len(line)):
                    grams[line[i - order + 1 : i + 1]] += n
        levels = [grams]
        for _ in range(order - 1):
            lower = collections.Counter()
            for gram in levels[0]:
                lower[gram[1:]] += 1
            levels.insert(0, lower)
        models[lang] = levels
    alphabet = len({g[-1] for levels in models.values() for g in levels[-1]}) + 1

    def probability(lang, context, char):
        p = 1 / alphabet
        for size, counts in enumerate(models[lang]):
            before = context[len(context) - size :]
            once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
            d = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
            seen = [n for g, n in counts.items() if g[:-1] == before]
            if seen:
                spread = 1 - sum(max(n - d, 0) for n in seen) / sum(seen)
                p = max(counts[before + char] - d, 0) / sum(seen) + spread * p
        return p

    return probability, models


def test_language_models_are_kneser_ney(spark):
    """Tables, cross-entropies and sums over the alphabet against the plain formula."""
    rng = np.random.default_rng(9)
    words_of = {
        lang: collections.Counter("".join(rng.choice(list(letters), rng.integers(1, 7))) for _ in range(120))
        for lang, letters in (("a", "xyzé"), ("b", "xyq漢"), ("c", "z"))
    }
    words_of["a"].update({"x\0y": 3, "1x": 2, "\0\0": 1, "é1": 5})
    rows = [(lang, " ".join([w] * n)) for lang, words in words_of.items() for w, n in words.items()]
    frame = langid.count_grams(spark.createDataFrame(rows, "lang string, text string"), 4).toPandas()
    models = langid.smoothed(frame, 4)
    probability, plain = plain_kneser_ney(words_of, 4)
    for word in ["x", "xyz", "zzzzz", "q", "é漢x", "unknown", "yx"]:
        logs, characters = models.log_probabilities([word])
        assert characters.tolist() == [len(word) + 1]
        line = "   " + word + " "
        for k, lang in enumerate(models.languages):
            want = sum(math.log(probability(lang, line[i - 3 : i], line[i])) for i in range(3, len(line)))
            assert logs[0, k] == pytest.approx(want, rel=1e-12)
    for lang, levels in plain.items():
        letters = {g[-1] for of in plain.values() for g in of[-1]}
        for context in {g[:-1] for g in levels[-1]} | {"   ", "qqq"}:
            # what is not in any alphabet shares one place
            assert sum(probability(lang, context, c) for c in [*letters, "unseen"]) == pytest.approx(1)


def test_grams_are_looked_up_once(monkeypatch):
    """A context is the gram one place before, and small tables give what the sparse ones give."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(1, 9))) for _ in range(400)] + ["", "a", "1a2b", "77", "ß"]
    grams = {"l1": ["  ab", " abc", "abc ", "bca ", "    "], "l2": ["   é", "  éa", " dca", "aaab", "   a"]}
    counts = pd.DataFrame([(lang, g, i + 1) for lang, gs in grams.items() for i, g in enumerate(gs)], columns=["lang", "gram", "n"])
    models = langid.smoothed(counts, 4)
    asked, find = [], langid.Models.find
    monkeypatch.setattr(langid.Models, "find", lambda self, level, wanted: asked.append(len(wanted)) or find(self, level, wanted))
    logs, sizes = models.log_probabilities(words)
    assert sum(asked) <= 4 * sizes.sum() + 3
    monkeypatch.setattr(langid, "FULL_CELLS", 0)
    sparse, _ = models.log_probabilities(words)
    assert np.array_equal(logs, sparse)
    # by hand: every context from its own characters
    points, _ = langid.spelled(words)
    back, events = langid.contexts(points, 4)
    back = [b[np.flatnonzero(events)] for b in back]
    want = np.broadcast_to(models.floor, (len(back[0]), 2)).astype(float)
    for level in range(4):
        want = want * (models.weights[level - 1].spread(find(models, level - 1, langid.hashes(back, level, skip=1)), 2) if level else models.start)
        want = want + models.shares[level].spread(find(models, level, langid.hashes(back, level + 1)), 2)
    assert np.allclose(logs.sum(axis=0), np.log(want).sum(axis=0))


def test_many_languages(spark):
    """More languages than a dense table would be made for; no limit on their number."""
    letters = [chr(0x4E00 + i) for i in range(1200)]
    rows = [(i, (c + " ") * 5, f"l{i:04d}") for i, c in enumerate(letters)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    models = langid.learn(docs)
    assert len(models.languages) > 900
    known = [i for i in range(1200) if f"l{i:04d}" in models.languages][:20]
    assert models.predict([letters[i] for i in known])[0] == [f"l{i:04d}" for i in known]


def test_language_probabilities_add_up():
    import pandas as pd

    counts = pd.DataFrame(
        [(lang, gram, n) for lang, gram, n in [("a", "   x", 5), ("a", "  xy", 4), ("a", " xy ", 4), ("a", "  x ", 1), ("b", "   y", 2), ("b", "  y ", 2)]],
        columns=["lang", "gram", "n"],
    )
    models = langid.smoothed(counts, 4)
    # the events after a blank: x, y, the blank of an empty word and one unseen letter
    total = np.zeros(2)
    for word in ("x", "y", "q"):
        logs, _ = models.log_probabilities([word])
        after, _ = models.log_probabilities([word + "q"])
        assert (logs < 0).all() and (after < 0).all()
        total += np.exp(logs[0])
    assert (total < 1).all()


def test_language_odd_rows(spark, documents, odd_documents, no_documents):
    models = langid.learn(langid.teachers(documents))
    rows = langid.predictions(odd_documents, models).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and by_id[1].rejected and by_id[1].score == 0
    assert by_id[4].lang_pred in models.languages
    assert langid.predictions(no_documents, models).count() == 0
    nothing = langid.learn(no_documents)
    assert {r.lang_pred for r in langid.predictions(odd_documents, nothing).collect()} == {"und"}
    langid.learn(odd_documents)


# quality rules


def base_rules(text):
    text = text or ""
    words = WORDS.findall(text)
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed


def test_base_rules(docs):
    got = linefreq.quality(docs).collect()
    columns = [*linefreq.COLUMNS, "base_failed"]
    want = [(i, *base_rules(t)) for i, t in rows_of(docs)]
    assert multiset((r.doc_id, *[r[c] for c in columns]) for r in got) == multiset(want)
    assert not any(r.kept for r in got if r.base_failed)


def test_line_frequency(spark):
    rng = np.random.default_rng(5)
    words = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**9, n))
    common, copy = words(60), words(60) + "\n" + words(30)
    rows = [(i, common + "\n" + words(n), "a") for i, n in enumerate([5] * 30 + [200] * 30)]  # 30 are depleted
    rows += [(100 + i, common + "\n" + words(5), "b") for i in range(5)]  # too few of this host
    rows += [(200 + i, copy, "a") for i in range(40)]  # copies count once
    rows += [(300, common.upper().replace(" ", "  ") + "\n" + words(4), "a")]  # the same line when normalised
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r.doc_id for r in linefreq.quality(docs, line_docs=20, line_share=0.0).filter("kept").collect()}
    assert kept == {0, *range(30, 60), *range(100, 105), *range(200, 240)}
    assert linefreq.quality(docs, line_docs=100, line_share=1.0).filter("kept").count() == len(rows)
    assert not {0, *range(30)} & {r.doc_id for r in linefreq.quality(docs, line_docs=20, keep_first=False).filter("kept").collect()}


def lines_by_hand(rows, line_docs, line_share, least_docs, keep_first=True):
    """removed_words and kept of each row, from plain counts."""
    rows = [(i, (t or "").encode(), h) for i, t, h in rows]
    key = lambda line: re.sub(b"[1-9]", b"0", b" ".join(line.lower().split()))
    split = lambda text: [part for part in text.split(b"\n") if part.split()]
    contents, docs, first = collections.defaultdict(set), collections.defaultdict(set), {}
    for doc_id, text, host in rows:
        content = b" ".join(text.split()).lower()
        contents[host or ""].add(content)
        for line in {key(line) for line in split(text)}:
            docs[host or "", line].add(content)
            if doc_id is not None:
                first[host or "", line] = min(first.get((host or "", line), doc_id), doc_id)
    out = []
    for doc_id, text, host in rows:
        host, removed = host or "", 0
        limit = min(line_docs, max(least_docs, line_share * len(contents[host])))
        for line in split(text):
            stays = keep_first and doc_id is not None and first[host, key(line)] == doc_id
            removed += len(line.split()) if len(docs[host, key(line)]) > limit and not stays else 0
        out.append((doc_id, removed, len(text.split()) - removed >= 0.3 * len(text.split())))
    return out


@pytest.mark.parametrize("limits", [(50, 0.1, 5, True), (8, 0.5, 2, False), (3, 0.0, 1, True)])
def test_line_frequency_by_hand(spark, data, limits):
    documents = spark.read.parquet(f"{os.path.dirname(data)}/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in documents.select("doc_id", "text", "source").collect()]
    got = linefreq.quality(documents, **dict(zip(["line_docs", "line_share", "least_docs", "keep_first"], limits))).collect()
    want = lines_by_hand(rows, *limits)
    assert sum(w[1] > 0 for w in want) > 0
    assert multiset((r.doc_id, r.removed_words, r.kept) for r in got if not r.base_failed) == multiset(
        w for w, failed in zip(want, [base_rules(t)[-1] for _, t, _ in rows]) if not failed
    )


def test_a_hot_host_and_a_small_one_lose_the_same_lines(spark):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**9, n))
    common = words(9)
    rows = [(i, common + "\n" + words(60), "small") for i in range(8)]
    rows += [(100 + i, common + "\n" + words(60), "hot") for i in range(60)]
    rows += [(1000 + i, words(60), "hot") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    removed = {r.doc_id for r in linefreq.quality(docs).filter("removed_words > 0").collect()}
    assert removed == {*range(1, 8), *range(101, 160)}


def test_line_frequency_of_template_pages(spark):
    rng = np.random.default_rng(6)
    words = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**9, n))
    template = words(60)
    rows = [(i, template + "\n" + words(5), "a") for i in range(400)]  # different pages with few words of their own
    rows += [(1000 + i, words(60), "a") for i in range(10)]
    copy = words(60)
    rows += [(2000 + i, copy.upper() if i % 2 else copy.replace(" ", "  "), "a") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r.doc_id for r in linefreq.quality(docs).filter("kept").collect()}
    assert kept == {0, *range(1000, 1010), *range(2000, 2100)}


@pytest.mark.parametrize("lookup_lines", [linefreq.LOOKUP_LINES, 0])
def test_frequent_lines_leave_the_text(spark, monkeypatch, lookup_lines):
    import corpus_pipeline

    monkeypatch.setattr(linefreq, "LOOKUP_LINES", lookup_lines)
    rng = np.random.default_rng(7)
    words = lambda n: " ".join("".join(map(chr, w)) for w in rng.integers(97, 123, (n, 9)))
    head, foot = words(8), words(4) + " 1"
    own = {i: words(60) + "\n\n  " + words(20) for i in range(60)}
    text = lambda i: f"{head.upper()}\n{own[i]}\n {foot[:-1]}{i:02d}\n{head}"
    rows = [(i, text(i), "a", len(text(i)), i) for i in own] + [(None, text(5), "a", 0, 60), (70, text(6), None, 7, 61)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars int, doc int")
    found = {r.doc: r for r in linefreq.cleaned(docs).select("text", "removed_words", "kept", "doc.doc").collect()}
    assert {k: r.text for k, r in found.items()} == {**own, 0: text(0), 60: own[5], 61: text(6)}
    assert {k: r.removed_words for k, r in found.items()} == {**dict.fromkeys(own, 21), 0: 0, 60: 21, 61: 0}
    after = corpus_pipeline.good_quality(spark, docs, "")
    assert after.schema == docs.schema
    want = {**{i: (own[i], len(own[i])) for i in own}, 0: (text(0), len(text(0))), 60: (own[5], len(own[5])), 61: (text(6), 7)}
    assert {r.doc: (r.text, r.n_chars) for r in after.collect()} == want


def test_line_frequency_empty(no_documents):
    assert linefreq.quality(no_documents).count() == 0


# near duplicates


def shingles(text):
    words = lower(text).encode().split()
    return frozenset(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows, threshold=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    owners = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            owners[x].append(k)
    tested = set()
    for own in owners.values():
        for k in own[1:]:
            for j in own[:1] if len(own) > 500 else own:
                if j < k and (j, k) not in tested:
                    tested.add((j, k))
                    common = len(sets[j] & sets[k])
                    if 100 * common >= threshold * (len(sets[j]) + len(sets[k]) - common):
                        root[top(k)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min([x for x in (least.get(top(k)), i) if x is not None], default=None)
    return multiset((i, len(s), least[top(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def test_near_duplicates(docs):
    got = neardup.near_duplicates(docs).collect()
    assert multiset((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows_of(docs))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def edited(rng, words, edits):
    words = list(words)
    for at in rng.integers(0, len(words), edits):
        words[at] = f"e{rng.integers(10**9)}"
    return " ".join(words)


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 8)
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 32)
    rng = np.random.default_rng(11)
    base = [f"b{x}" for x in rng.integers(0, 10**9, 150)]
    rows = [(int(i), edited(rng, base, int(rng.integers(0, 6)))) for i in rng.permutation(200)]
    rows += [(1000 + i, " ".join(f"u{x}" for x in rng.integers(0, 10**9, 100))) for i in range(50)]
    rows += [(2000 + i, rows[0][1]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = neardup.near_duplicates(docs).collect()
    assert multiset((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_near_duplicates_empty(no_documents):
    assert neardup.near_duplicates(no_documents).count() == 0


def test_empty_tables(no_documents, vocabularies):
    path = vocabularies["byte_bpe_multi_50k.tiktoken"]
    assert bpe.round_trip(no_documents, path, vocabularies["pattern"]).count() == 0
    assert packing.packed_pieces(no_documents, vocabularies["byte_bpe_50k.json"]).count() == 0
    assert lm.score(no_documents, F.lit(False)).count() == 0
