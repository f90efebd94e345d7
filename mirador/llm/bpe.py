"""Byte-level BPE with DuckDB recursive queries inside tasks.

Spark deals out the documents; a task cuts them into segments, takes the words (matches of
the pattern) of segments its worker has not seen, and encodes those words in one recursive
query: token-position rows are joined with the merge table, every word contracts its
leftmost pair of least rank, and a word without such a pair is done. Long words contract in
each round all places of their least pair that do not overlap, leftmost first, which takes
fewer rounds and gives the same tokens. Decoding joins (document, position, id) rows with the
vocabulary and aggregates the bytes in order.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .registry import query, table
from .segments import Memory, segments
from .words import lean, pieces, send

#: Longer words (in bytes) are contracted at all places of their least pair at once.
LONG_WORD = 48

SHORT_WORDS = """
WITH RECURSIVE step AS (
  SELECT w, i, i + 1 AS j, tok, lead(tok) OVER (PARTITION BY w ORDER BY i) AS nxt, false AS done FROM start
  UNION ALL
  (WITH live AS (SELECT * FROM step WHERE NOT done),
   low AS (SELECT w, min(merged * 1048576 + i) AS key
           FROM live JOIN merges ON pair = tok::BIGINT * 65536 + nxt GROUP BY w),
   hit AS (SELECT l.w, l.i AS here, l.j AS after, (key // 1048576)::INT AS merged
           FROM low JOIN live l ON l.w = low.w AND l.i = low.key % 1048576),
   best AS (SELECT h.*, r.j AS after_j, r.nxt AS after_nxt
            FROM hit h JOIN live r ON r.w = h.w AND r.i = h.after)
   SELECT a.w, a.i,
          CASE WHEN a.i = here THEN after_j ELSE a.j END,
          CASE WHEN a.i = here THEN merged ELSE tok END,
          CASE WHEN a.i = here THEN after_nxt WHEN a.j = here THEN merged ELSE nxt END,
          best.w IS NULL
   FROM live a LEFT JOIN best ON a.w = best.w WHERE best.w IS NULL OR a.i <> after)
)
SELECT w, tok FROM step WHERE done ORDER BY w, i
"""

LONG_WORDS = """
WITH RECURSIVE step AS (
  SELECT w, i, tok, false AS done FROM start
  UNION ALL
  (WITH pairs AS (SELECT w, i, tok, tok::BIGINT * 65536 + lead(tok) OVER (PARTITION BY w ORDER BY i) AS pair
                  FROM step WHERE NOT done),
   ranked AS (SELECT s.w, s.i, s.tok, merged FROM pairs s LEFT JOIN merges m ON m.pair = s.pair),
   low AS (SELECT *, min(merged) OVER (PARTITION BY w) AS best FROM ranked),
   runs AS (SELECT *, coalesce(merged = best, false) AS hit,
                   sum(CASE WHEN merged = best THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY i) AS run FROM low),
   odd AS (SELECT *, hit AND count(CASE WHEN hit THEN 1 END) OVER (PARTITION BY w, run ORDER BY i) % 2 = 1 AS take
           FROM runs),
   gone AS (SELECT *, lag(take, 1, false) OVER (PARTITION BY w ORDER BY i) AS eaten FROM odd)
   SELECT w, i, CASE WHEN take THEN best::INT ELSE tok END, best IS NULL FROM gone WHERE NOT eaten)
)
SELECT w, tok FROM step WHERE done ORDER BY w, i
"""

DECODE = """
SELECT doc, string_agg(chars, '' ORDER BY pos) AS decoded
FROM ids JOIN vocabulary USING (tok) GROUP BY doc
"""

OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Merge and vocabulary tables of one vocabulary in this worker's DuckDB."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb  # only here: workers of other operators do without its memory

        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        joins = [
            (ranks[t[:cut]] * 65536 + ranks[t[cut:]], rank)
            for t, rank in ranks.items()
            for cut in range(1, len(t))
            if t[:cut] in ranks and t[cut:] in ranks
        ]
        pair, merged = (np.array(c, dtype=np.int64) for c in zip(*joins))
        spill = tempfile.gettempdir()  # the task's own temporary folder
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": spill})
        self.put("merges", pair=pair, merged=merged)
        self.put(
            "vocabulary",
            tok=np.array(list(ranks.values()), dtype=np.int32),
            chars=[t.decode("latin-1") for t in ranks],  # one character per byte
        )
        self.words = Memory(self.encode_words)
        self.memory = Memory(self.encode_segments, spells=True)

    def put(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def contract(self, words: list[bytes], sql: str) -> tuple[np.ndarray, np.ndarray]:
        """Id counts and all ids in a row."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.put("start", w=owner.astype(np.int32), i=place.astype(np.int32), tok=symbols)
        found = self.db.execute(sql).fetchnumpy()
        return np.bincount(found["w"], minlength=len(words)), np.asarray(found["tok"], dtype=np.int32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [w.encode() for w in words]
        long = [k for k, w in enumerate(whole) if len(w) > LONG_WORD]
        counts, ids = self.contract([w[: 0 if len(w) > LONG_WORD else None] for w in whole], SHORT_WORDS)
        if long:
            more_counts, more = self.contract([whole[k] for k in long], LONG_WORDS)
            ids = np.insert(ids, np.repeat((np.cumsum(counts) - counts)[long], more_counts), more)
            counts[long] = more_counts
        return counts, ids

    def encode_segments(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        matches = [self.pattern.findall(s) for s in new]
        places = self.words.places_of(matches)
        joined = np.concatenate(places)
        sizes = np.concatenate([[0], np.cumsum(self.words.counts[joined])])
        ends = np.cumsum([len(p) for p in places])
        return np.diff(sizes[np.concatenate([[0], ends])]), self.words.tokens(joined)

    def encode(self, found: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Ids of each text, and the same as decimal numbers with commas between."""
        places = self.memory.places_of([segments(t) for t in found])
        spelled = self.memory.spelled.__getitem__
        return [self.memory.tokens(p) for p in places], [",".join(map(spelled, p.tolist())) for p in places]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        lengths = [len(i) for i in ids]
        total = sum(lengths)
        if not total:
            return [b""] * len(ids)
        self.put(
            "ids",
            doc=np.repeat(np.arange(len(ids), dtype=np.int32), lengths),
            pos=np.arange(total, dtype=np.int32),
            tok=np.concatenate(ids),
        )
        found = self.db.execute(DECODE).fetchall()
        self.db.execute("DROP TABLE ids")
        out = [b""] * len(ids)
        for doc, decoded in found:
            out[doc] = decoded.encode("latin-1")
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec_of(ranks: dict[bytes, int], name: str, pattern: str) -> Codec:
    if (name, pattern) not in _codecs:
        _codecs[name, pattern] = Codec(ranks, pattern)
    return _codecs[name, pattern]


def in_tasks(docs: DataFrame, path: str, pattern: str, make, schema: pa.Schema, ddl: str) -> DataFrame:
    """Run ``make(doc_ids, ids, spelled ids, decoded)`` over encoded and decoded documents.

    The vocabulary's size is that of its file, so it is sent to the workers once.
    """
    sent = send(docs, read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(sent.value, path, pattern)
        for whole in batches:
            for batch in pieces(whole, "text", 4 << 20):
                ids, spelled = codec.encode([t or "" for t in batch.column("text").to_pylist()])
                columns = make(batch.column("doc_id"), ids, spelled, codec.decode(ids))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(lean(run), ddl)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, decoded binary for every row of ``docs`` (doc_id, text).

    Null and empty texts have no ids and decode to nothing; repeated rows are encoded each; a
    null doc_id stays null; texts are encoded whole, however long. An empty table gives no
    rows. Other columns are not looked at.
    """
    make = lambda doc_ids, ids, _, decoded: [
        doc_ids.cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())
    ]
    return in_tasks(docs, path, pattern, make, OUT, "doc_id bigint, ids array<int>, decoded binary")


DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Like ``round_trip``, but only counts and digests leave the tasks."""
    sha = lambda data: hashlib.sha256(data).hexdigest()
    make = lambda doc_ids, ids, spelled, decoded: [
        doc_ids.cast(pa.int64()),
        pa.array([len(i) for i in ids], pa.int64()),
        pa.array([sha(s.encode()) for s in spelled]),
        pa.array([sha(d) for d in decoded]),
    ]
    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return in_tasks(docs, path, pattern, make, DIGESTS, ddl)


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded with the multilingual byte-level vocabulary and decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
