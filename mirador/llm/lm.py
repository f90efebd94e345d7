"""Trigram scoring with Elias-Fano tries dealt out by context.

Documents are gathered into chunks of about CHUNK_TOKENS tokens, which stay as they are: what
travels are each chunk's distinct words and distinct trigrams, packed per shard. A word shard
adds up the training counts of its words and answers every chunk with them. A gram shard holds
all trigrams of its contexts (the first two words): it merges the training counts, builds a
trie of them with quantised smoothed probabilities in memory-mapped levels, looks the grams of
every chunk up in it and answers in the order in which they came. A last step puts the answers
of each chunk together and adds up the scores of its documents.

A token w after u, v has the probability

    P(w | u v) = max(c(u v w) - D, 0) / c(u v) + D * T(u v) / c(u v) * P(w | v)
    P(w | v)   = (c(v w) + M * P(w)) / (c(v) + M)
    P(w)       = (c(w) + 0.1) / (N + 0.1 * (V + 1))

with T(u v) the distinct words seen after u v, D the discount and M the prior. Texts begin with
two marks that are never predicted and end with an end token that is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mirador.sources.tables import stage

from .registry import query, table
from .trie import Trie
from .words import GOLDEN, lean, lean_group, mix, pieces, send, texts, word_hashes

CHUNK_TOKENS = 1_500_000
SHARD_TOKENS = 3_000_000
DISCOUNT = 0.9
PRIOR = 2000.0
#: Quantised values are logarithms in steps of 1 / CODES_PER_E; 0 has the last code.
CODES_PER_E = 250.0
NOTHING = 65535

END = np.uint64(xxhash.xxh3_64_intdigest(b""))  # no word is empty
#: Ids inside tries are so many leading bits of a word's hash that about 2 ** CLASH_BITS words at most
#: share theirs, however many words there are; these have ids of their own beyond all others.
CLASH_BITS = 16
MOST_ID_BITS = 55
BEGIN_ID, PAD_ID = 1 << 56, (1 << 56) + 1  # beyond all ids
#: Sent in place of a probability: how its code differs from that of its pair, from here; 0 for none.
SENT_FROM = 1 << 14

CHUNKS = pa.schema(
    [("chunk", pa.int64()), ("n_tokens", pa.int64()), ("train_tokens", pa.int64()), ("n_words", pa.int64()),
     ("train_docs", pa.int64()), ("tokens", pa.binary()), ("words", pa.binary())]
)
CHUNKS_DDL = (
    "chunk bigint, n_tokens bigint, train_tokens bigint, n_words bigint, train_docs bigint, tokens binary, words binary"
)
PACKETS = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary())])
PACKETS_DDL = "shard bigint, chunk bigint, payload binary"
ANSWERS = pa.schema(
    [("chunk", pa.int64()), ("kind", pa.int32()), ("shard", pa.int64()), ("payload", pa.binary()), ("known", pa.int64())]
)
ANSWERS_DDL = "chunk bigint, kind int, shard bigint, payload binary, known bigint"
SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
     ("base_score", pa.float64()), ("score", pa.float64())]
)
SCORES_DDL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: small whole-number types, bytes of equal weight side by side, compressed."""
    out = [np.array([len(arrays)], dtype="<u4").tobytes()]
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
        planes = np.ascontiguousarray(a.astype(f"<u{width}")).view(np.uint8).reshape(len(a), width).T.tobytes()
        out += [np.array([len(a), width], dtype="<u8").tobytes(), planes]
    return zstandard.compress(b"".join(out), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    at, out = 4, []
    for _ in range(int(np.frombuffer(data, "<u4", 1)[0])):
        n, width = (int(x) for x in np.frombuffer(data, "<u8", 2, at))
        at += 16
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        at += n * width
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n))
    return out


def gaps(values: np.ndarray) -> np.ndarray:
    """Differences of a sorted sequence, from 0."""
    return np.diff(values, prepend=values.dtype.type(0))


def quantised(values: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        codes = np.rint(-np.log(values) * CODES_PER_E)
    return np.minimum(codes, NOTHING).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == NOTHING, 0.0, np.exp(codes / -CODES_PER_E))  # codes are not negative


def counted(codes: np.ndarray) -> np.ndarray:
    """Counts from the codes of their reciprocals."""
    return np.divide(1.0, restored(codes), out=np.zeros(len(codes)), where=codes != NOTHING)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the place of each value among them; half the memory of np.unique."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(values), dtype=np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], place


def by_use(uses: np.ndarray) -> np.ndarray:
    return np.argsort(-uses.astype(np.int64), kind="stable")


class Gathering:
    """Documents on their way to a chunk row."""

    def __init__(self) -> None:
        self.hashes, self.lengths, self.ids, self.held = [], [], [], []
        self.tokens = 0

    def add(self, hashes: np.ndarray, lengths: np.ndarray, ids: list, held: list) -> None:
        self.hashes.append(hashes)
        self.lengths.append(lengths)
        self.ids += ids
        self.held += held
        self.tokens += len(hashes)

    def row(self, chunk: int) -> pa.RecordBatch:
        import pandas as pd  # only here: workers of other operators do without its memory

        codes, distinct = pd.factorize(np.concatenate(self.hashes))
        order = np.argsort(distinct)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        codes, lengths, held = place[codes], np.concatenate(self.lengths), np.array(self.held, dtype=bool)
        trains = np.repeat(~held, lengths)
        counts = np.bincount(codes[trains], minlength=len(distinct))
        uses = np.bincount(codes, minlength=len(distinct))
        rank = np.empty(len(order), dtype=np.int64)  # frequent words have small numbers in the token line
        rank[by_use(uses)] = np.arange(len(order))
        missing = np.array([i is None for i in self.ids])
        ids = np.array([0 if i is None else i for i in self.ids], dtype=np.int64)
        row = [
            chunk, len(codes), int(trains.sum()), len(distinct), int((~held).sum()),
            packed(rank[codes], lengths, held.astype(np.int64), missing.astype(np.int64), ids.view(np.uint64)),
            packed(gaps(distinct[order]), counts, uses),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, CHUNKS)], schema=CHUNKS)


def chunked(docs: DataFrame, held_out: Column, chunk_tokens: int) -> DataFrame:
    """Documents as chunk rows: word numbers per token, and the chunk's sorted word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, open_ = TaskContext.get().partitionId(), 0, Gathering()
        for whole in batches:
            for batch in pieces(whole, "text", 4 << 20):
                split = [t.lower().split() for t in texts(batch.column("text"))]
                lengths = np.array([len(w) + 1 for w in split], dtype=np.int64)
                hashes = np.full(int(lengths.sum()), END, dtype=np.uint64)
                is_word = np.ones(len(hashes), dtype=bool)
                is_word[np.cumsum(lengths) - 1] = False
                hashes[is_word] = word_hashes([w for ws in split for w in ws])
                open_.add(hashes, lengths, batch.column("doc_id").to_pylist(), batch.column("held").to_pylist())
                if open_.tokens >= chunk_tokens:
                    yield open_.row((task << 24) + made)
                    made, open_ = made + 1, Gathering()
        if open_.tokens:
            yield open_.row((task << 24) + made)

    rows = docs.select(
        F.col("doc_id").cast("bigint"), F.coalesce(held_out, F.lit(False)).alias("held"), "text"
    )
    return rows.mapInArrow(lean(run), CHUNKS_DDL)


def word_packets(chunks: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words in zip(batch.column("chunk").to_pylist(), batch.column("words")):
                steps, counts, _ = unpacked(words.as_buffer())
                hashes = np.cumsum(steps.astype(np.uint64), dtype=np.uint64)
                cuts = np.searchsorted(shard_of(hashes, shards), np.arange(shards + 1))
                parts = [(s, a, b) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                rows = [(s, chunk, packed(gaps(hashes[a:b]), counts[a:b])) for s, a, b in parts]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PACKETS)], schema=PACKETS)

    return chunks.select("chunk", "words").mapInArrow(lean(run), PACKETS_DDL)


def id_width(n_words: int) -> int:
    """Bits of an id, so that pairs of ``n_words`` random hashes that agree in them stay few."""
    return min(MOST_ID_BITS, max(1, 2 * max(1, n_words).bit_length() - CLASH_BITS))


def clashing(hashes: np.ndarray, id_bits: int) -> np.ndarray:
    """Of a shard's sorted hashes, those that share their id, and its ends, whose neighbours are elsewhere."""
    short = hashes >> np.uint64(64 - id_bits)
    alike = short[1:] == short[:-1]
    shared = np.zeros(len(hashes), dtype=bool)
    shared[1:] |= alike
    shared[:-1] |= alike
    shared[[0, -1]] = True
    return hashes[shared]


def ids_of(hashes: np.ndarray, clashes: np.ndarray, id_bits: int) -> np.ndarray:
    """Ids of words, each its own: the leading bits of the hash, or the place among ``clashes`` beyond them."""
    ids = (hashes >> np.uint64(64 - id_bits)).astype(np.int64)
    place = np.searchsorted(clashes, hashes)
    shared = np.flatnonzero(place < len(clashes))
    shared = shared[clashes[place[shared]] == hashes[shared]]
    ids[shared] = (1 << id_bits) + place[shared]
    return ids


def answer_words(packets: pa.Table, id_bits: int) -> pa.Table:
    """Training counts of each chunk's words of one shard, and how many of all are above 0.

    One more row, of kind 3 and without a chunk, holds the shard's clashing hashes.
    """
    shard = packets.column("shard")[0].as_py()
    read = [unpacked(p.as_buffer()) for p in packets.column("payload")]
    hashes = [np.cumsum(steps.astype(np.uint64), dtype=np.uint64) for steps, _ in read]
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(totals, place, np.concatenate([c for _, c in read]).astype(np.int64))
    ends = np.cumsum([len(h) for h in hashes])
    known = [int((totals > 0).sum())] + [0] * (len(read) - 1)
    rows = [
        (chunk, 1, shard, packed(totals[place[end - len(h) : end]]), k)
        for chunk, h, end, k in zip(packets.column("chunk").to_pylist(), hashes, ends, known)
    ]
    rows.append((None, 3, shard, packed(gaps(clashing(distinct, id_bits))), 0))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), ANSWERS)], schema=ANSWERS)


class Windows:
    """The trigrams of a chunk: distinct first pairs, distinct grams, and which each place has.

    Words are numbered by their ids, ``order`` says which of the chunk's words each number is.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, held: np.ndarray, ids: np.ndarray, shards: int):
        words = len(ids)
        self.order = np.argsort(ids)
        self.ids = np.concatenate([ids[self.order], [BEGIN_ID, PAD_ID]])
        number = np.empty(words, dtype=np.int32)
        number[self.order] = np.arange(words)
        begin, pad = words, words + 1
        docs = len(lengths)
        marked = lengths + 3  # two begin marks, the tokens, one pad
        firsts = np.cumsum(marked) - marked
        line = np.full(int(marked.sum()), begin, dtype=np.int32)
        is_token = np.ones(len(line), dtype=bool)
        is_token[firsts] = is_token[firsts + 1] = is_token[firsts + marked - 1] = False
        line[is_token] = number[codes]
        line[firsts + marked - 1] = pad
        starts = np.ones(len(line), dtype=bool)
        starts[firsts + marked - 1] = starts[firsts + marked - 2] = False
        u, v, w = line[starts], line[1:][starts[:-1]], line[2:][starts[:-2]]
        del line, is_token, starts
        self.trains = np.repeat(~held, lengths + 1)
        self.predicts = w != pad
        pairs, self.pair = numbered(u * np.int64(words + 2) + v)
        del u
        self.u, self.v = (x.astype(np.int32) for x in np.divmod(pairs, words + 2))
        del pairs
        grams, self.gram = numbered(self.pair * np.int64(words + 2) + w)
        self.gram_pair, self.w = (x.astype(np.int32) for x in np.divmod(grams, words + 2))
        self.context, self.word = v, w
        del grams
        spread = mix(self.ids[self.u].astype(np.uint64) * GOLDEN ^ mix(self.ids[self.v].astype(np.uint64)))
        self.shard = shard_of(spread, shards).astype(np.int32)

    def packets(self, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Shard, pairs and grams of each, both in order."""
        pair_order = np.argsort(self.shard, kind="stable")
        pair_cuts = np.searchsorted(self.shard[pair_order], np.arange(shards + 1))
        gram_shard = self.shard[self.gram_pair]
        gram_order = np.argsort(gram_shard, kind="stable")
        gram_cuts = np.searchsorted(gram_shard[gram_order], np.arange(shards + 1))
        for s in range(shards):
            pairs, grams = pair_order[pair_cuts[s] : pair_cuts[s + 1]], gram_order[gram_cuts[s] : gram_cuts[s + 1]]
            if len(pairs):
                yield s, pairs, grams


def read_chunk(tokens: bytes, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Word numbers in the order of hashes, document lengths, which are held out, and ids."""
    codes, lengths, held, missing, ids = unpacked(tokens)
    signed = ids.astype(np.uint64).view(np.int64)
    names = [None if gone else int(i) for gone, i in zip(missing, signed)]
    return by_use(uses).astype(np.int32)[codes], lengths.astype(np.int64), held.astype(bool), names


def read_words(words: bytes, clashes: np.ndarray, id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids inside tries and uses of a chunk's words."""
    steps, _, uses = unpacked(words)
    hashes = np.cumsum(steps.astype(np.uint64), dtype=np.uint64)
    return ids_of(hashes, clashes, id_bits), uses


def homes(chunks: DataFrame, clashes: Broadcast, id_bits: int) -> DataFrame:
    """The chunks as rows beside their answers, with ids in place of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for words in batch.column("words"):
                ids, uses = read_words(words.as_buffer(), clashes.value, id_bits)
                own = np.flatnonzero(ids >> id_bits)  # all other ids are in order
                kept.append(packed(gaps(np.delete(ids, own)), uses, gaps(own), ids[own]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk"), batch.column("tokens"), pa.array(kept, pa.binary())], ["chunk", "payload", "words"]
            )

    return chunks.select("chunk", "tokens", "words").mapInArrow(lean(run), "chunk bigint, payload binary, words binary")


def grams_of(words: bytes, tokens: bytes, shards: int, clashes: np.ndarray, id_bits: int) -> Iterator[tuple[int, bytes]]:
    """Shard and payload: the distinct trigrams of a chunk."""
    word_ids, uses = read_words(words, clashes, id_bits)
    codes, lengths, held, _ = read_chunk(tokens, uses)
    found = Windows(codes, lengths, held, word_ids, shards)
    del codes
    counts = np.bincount(found.gram[found.trains], minlength=len(found.w))
    for shard, pairs, grams in found.packets(shards):
        owner = np.searchsorted(pairs, found.gram_pair[grams])
        columns = [found.ids[found.u[pairs]], found.ids[found.v[pairs]], found.ids[found.w[grams]]]
        ids, number = np.unique(np.concatenate(columns), return_inverse=True)
        a, b = len(pairs), 2 * len(pairs)
        yield shard, packed(
            gaps(ids), gaps(number[:a]), number[a:b], number[b:],
            np.bincount(owner, minlength=a), counts[grams],
        )


def gram_packets(chunks: DataFrame, shards: int, clashes: Broadcast, id_bits: int) -> DataFrame:
    """Distinct trigrams of each chunk, by the shard of their first two words.

    A task holds one chunk at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, tokens, words in zip(*(batch.column(c) for c in ("chunk", "tokens", "words"))):
                for shard, payload in grams_of(words.as_buffer(), tokens.as_buffer(), shards, clashes.value, id_bits):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard]), pa.array([chunk.as_py()]), pa.array([payload], pa.binary())], schema=PACKETS
                    )

    return chunks.select("chunk", "tokens", "words").mapInArrow(lean(run), PACKETS_DDL)


def read_grams(payload: pa.Scalar) -> list[np.ndarray]:
    """Word ids of a packet; first and second word of its pairs, third words, grams of each pair and their training counts."""
    steps, first, *rest = unpacked(payload.as_buffer())
    return [np.cumsum(steps, dtype=np.int64), np.cumsum(first, dtype=np.int32), *rest]


def answer_grams(packets: pa.Table, discount: float) -> pa.Table:
    """Look every chunk's grams of one shard up in a trie of the shard's training counts.

    Per gram, the discounted probability; per pair, its count and the back-off weight.
    """
    shard = packets.column("shard")[0].as_py()
    payloads = packets.column("payload")  # small as they are, and read anew for each step
    # training grams of all chunks, as numbers of the shard's own words
    words = np.sort(np.concatenate([read_grams(p)[0] for p in payloads]))  # of whole numbers, faster than np.unique
    words = words[np.concatenate([[True], words[1:] != words[:-1]])]
    size = len(words) + 1
    pairs, times, thirds, counts = [], [], [], []
    for ids, u, v, w, sizes, n in map(read_grams, payloads):
        number = np.searchsorted(words, ids)
        seen = n > 0
        of_pair = np.bincount(np.repeat(np.arange(len(u)), sizes)[seen], minlength=len(u))
        has = of_pair > 0
        pairs.append(number[u[has]] * size + number[v[has]])
        times.append(of_pair[has].astype(np.int32))
        thirds.append(number[w[seen]].astype(np.int32))
        counts.append(n[seen].astype(np.int32))
    pairs = np.concatenate(pairs)
    pairs, pair = numbered(pairs)
    pair = np.repeat(pair, np.concatenate(times))
    grams = pair * np.int64(size)
    del pair, times
    grams += np.concatenate(thirds)
    del thirds
    counts = np.concatenate(counts)
    order = np.argsort(grams)
    grams, n = grams[order], counts[order]
    del order, counts
    first = np.ones(len(grams), dtype=bool)
    first[1:] = grams[1:] != grams[:-1]
    starts = np.flatnonzero(first)
    count = np.add.reduceat(n, starts, dtype=np.int64) if len(starts) else np.zeros(0, dtype=np.int64)
    del n, first
    grams = grams[starts]
    del starts
    pair, w = (x.astype(np.int32) for x in np.divmod(grams, size))
    del grams
    total = np.bincount(pair, weights=count, minlength=len(pairs))
    total_code = quantised(1 / np.maximum(total, 1))
    # a product of quantised factors: the code of the probability is the sum of theirs
    part_code = np.rint(-np.log(np.maximum(count - discount, 1e-9)) * CODES_PER_E).astype(np.int32)
    part_code += total_code[pair]
    kept_code = np.maximum(part_code, 0).astype(np.uint16)
    del part_code
    spread = 1 - np.bincount(pair, weights=np.maximum(count - discount, 0) / total[pair], minlength=len(pairs))
    codes = [kept_code, total_code, quantised(np.maximum(spread, 1e-18))]
    del count, total, spread
    u, v = (x.astype(np.int32) for x in np.divmod(pairs, size))
    path = np.stack([u[pair], v[pair], w], axis=1)
    del u, v, w, pair, pairs
    trie = Trie(words, path, codes)
    del path, words, codes
    kept_codes, total_codes, spread_codes = (np.append(c, np.uint16(NOTHING)) for c in trie.codes)
    out = []
    for chunk, (ids, u, v, w, sizes, _) in zip(packets.column("chunk").to_pylist(), map(read_grams, payloads)):
        number = trie.numbers(ids)
        roots, owner = np.unique(u, return_inverse=True)  # in numbers of the packet
        top = trie.children(0, np.zeros(1, dtype=np.int64), np.zeros(len(roots), dtype=np.int64), number[roots])
        middle = trie.children(1, top, owner, number[v])
        owner = np.repeat(np.arange(len(u)), sizes)
        bottom = trie.children(2, middle, owner, number[w])
        totals = total_codes[middle].astype(np.int64)
        kept = np.where(bottom >= 0, kept_codes[bottom] - totals[owner] + SENT_FROM, 0)
        weight = np.where(middle >= 0, spread_codes[middle], 0)  # an unseen context leaves all to the next
        out.append((chunk, 2, shard, packed(kept, totals, weight), 0))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), ANSWERS)], schema=ANSWERS)


def add_up(rows: pa.Table, shards: int, train_tokens: int, known: int, train_docs: int, prior: float) -> pa.Table:
    """Scores of the documents of one chunk, from its tokens and all answers."""
    parts: dict[int, list] = {0: [], 1: [], 2: []}
    for kind, shard, k in sorted(zip(rows.column("kind").to_pylist(), rows.column("shard").to_pylist(), range(rows.num_rows))):
        parts[kind].append((shard, k))
    home = parts[0][0][1]
    payload = rows.column("payload")
    steps, uses, places, own = unpacked(rows.column("words")[home].as_buffer())
    places = np.cumsum(places, dtype=np.int64)
    word_ids = np.insert(np.cumsum(steps, dtype=np.int64), places - np.arange(len(places)), own.astype(np.int64))
    codes, lengths, held, ids = read_chunk(payload[home].as_buffer(), uses)
    counts = np.concatenate([unpacked(payload[k].as_buffer())[0] for _, k in parts[1]]).astype(np.int64)
    found = Windows(codes, lengths, held, word_ids, shards)
    kept, weight, together = np.zeros(len(found.w)), np.ones(len(found.u)), np.zeros(len(found.u))
    of_shard = {shard: k for shard, k in parts[2]}
    for shard, pairs, grams in found.packets(shards):
        sent, total_codes, weight_codes = unpacked(payload[of_shard[shard]].as_buffer())
        own = total_codes[np.searchsorted(pairs, found.gram_pair[grams])].astype(np.int64)
        kept[grams] = restored(np.where(sent > 0, sent.astype(np.int64) - SENT_FROM + own, NOTHING))
        weight[pairs] = restored(weight_codes)
        together[pairs] = counted(total_codes)
    single = (counts + 0.1) / (train_tokens + 0.1 * (known + 1))
    of_word = np.concatenate([single[found.order], [1.0, 1.0]])
    after = np.concatenate([counts[found.order], [train_docs, 0]]).astype(np.float64)  # the begin mark stands once before each text
    predicted = np.flatnonzero(found.predicts)
    word, context = found.word[predicted], found.context[predicted]
    pair_count = together[found.pair[predicted + 1]]  # the window one further starts with (v, w)
    lower = (pair_count + prior * of_word[word]) / (after[context] + prior)
    full = kept[found.gram[predicted]] + weight[found.pair[predicted]] * lower
    ends = np.cumsum(lengths)

    def per_document(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, ends - lengths)  # every document has its end token

    columns = [
        ids, held, lengths, per_document((counts[codes] > 0).astype(np.int64)),
        per_document(np.log10(single[codes])), per_document(np.log10(full)),
    ]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, SCORES)], schema=SCORES)


def score(
    docs: DataFrame,
    held_out: Column,
    discount: float = DISCOUNT,
    prior: float = PRIOR,
    chunk_tokens: int = CHUNK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``.

    ``docs``: doc_id, text; rows where ``held_out`` is true are scored but not learned from. A
    null, empty or blank text has the end token only. Rows with a null doc_id are scored and
    learned from like others; repeated rows count as often as they come. Texts are scored
    whole. Without training rows every token is unknown. An empty table gives no rows. Other
    columns are not looked at.

    Words are told apart by 64-bit hashes. Inside tries they have shorter ids, and no two words share
    one: the word shards find those whose leading bits agree, about 2 ** CLASH_BITS at most by the
    choice of the width, and these are numbered.
    """
    chunks = stage(chunked(docs, held_out, chunk_tokens), "lm-chunks")
    sizes = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "train_tokens", "n_words", "train_docs")]).first()
    word_shards = max(1, math.ceil(sizes["n_words"] / shard_tokens))
    gram_shards = max(1, math.ceil(sizes["n_tokens"] / shard_tokens))
    id_bits = id_width(sizes["n_words"])
    answers = word_packets(chunks, word_shards).groupBy("shard").applyInArrow(
        lean_group(lambda packets: answer_words(packets, id_bits)), ANSWERS_DDL
    )
    words = stage(answers, "lm-words")
    known = words.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    found = [
        np.cumsum(unpacked(r["payload"])[0].astype(np.uint64), dtype=np.uint64)
        for r in words.filter("kind = 3").select("payload").collect()
    ]
    clashes = send(docs, np.sort(np.concatenate([np.zeros(0, dtype=np.uint64), *found])))
    words = words.filter("kind = 1")
    grams = (
        gram_packets(chunks, gram_shards, clashes, id_bits)
        .groupBy("shard")
        .applyInArrow(lean_group(lambda packets: answer_grams(packets, discount)), ANSWERS_DDL)
    )
    home = homes(chunks, clashes, id_bits).select(
        "chunk", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("shard"), "payload", "words"
    )
    columns = ["chunk", "kind", "shard", "payload", F.lit(None).cast("binary").alias("words")]
    together = home.unionByName(words.select(*columns)).unionByName(grams.select(*columns))
    train_tokens, train_docs = sizes["train_tokens"], sizes["train_docs"]
    scored = together.groupBy("chunk").applyInArrow(
        lean_group(lambda rows: add_up(rows, gram_shards, train_tokens, known, train_docs, prior)), SCORES_DDL
    )
    return scored.withColumn("train_tokens", F.lit(train_tokens).cast("bigint")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored by a trigram model of nine tenths of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0)
