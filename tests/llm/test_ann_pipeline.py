import numpy as np
import pytest
from pyspark.sql import functions as F

from mirador.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int, block int, rank int"


def brute(rows, queries, k):
    fine = {}
    for i, v, *_ in rows:
        ok = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            fine[i] = min(fine.get(i, v), v)
    width = max(map(len, fine.values()), default=0)
    ids = sorted(i for i, v in fine.items() if len(v) == width)
    x = np.array([fine[i] for i in ids], dtype=np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x
    out = {}
    for q, i in enumerate(ids):
        if queries(i):
            score = x @ x[q]
            order = [j for j in np.lexsort((ids, -np.round(score, 12))) if j != q][:k]
            out[i] = [(ids[j], score[j]) for j in order]
    return out


def found(spark, rows, queries, **options):
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), queries, **options).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    return {q: [v[n] for n in sorted(v)] for q, v in got.items()}


def test_recall(spark, data):
    rows = [(r.vec_id, list(r.embedding), 0, 0, 0) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 50 == 0, 5)
    got = found(spark, rows, F.col("vec_id") % 50 == 0, block_rows=200, query_rows=4)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert hits >= 0.9 * 5 * len(want)


def test_all_codes_in_a_radius_are_found():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(500, 20))
    for substrings, radius in ((4, 3), (4, 7), (3, 0), (20, 5), (30, 2)):
        coder = ann.Coder(ann.learn_rotation(ann.unit(vectors)), substrings, radius)
        codes = coder.codes(vectors)
        index, parts = ann.Index(coder, codes), list(zip(*coder.parts(codes)))
        for q in range(0, 500, 25):
            got = set(index.within([int(v) for v in parts[q]], np.packbits(codes, axis=1)[q]))
            assert got == set(np.flatnonzero((codes != codes[q]).sum(axis=1) <= radius))


def test_odd_vectors(spark):
    good = [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [-1.0, 0.0], [2.0, 0.0], [2.0, 0.0]]
    rows = [(i, v, 0, 0, 0) for i, v in enumerate(good)]
    rows += [(i, v, 0, 0, 0) for i, v in enumerate([None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0]], 20)]
    rows += [(None, [1.0, 0.0], 0, 0, 0), (0, [1.0, 0.0], 0, 0, 0), (30, [1e-30, 1e-30], 0, 0, 0), (31, [3e38, 3e38], 0, 0, 0)]
    got = found(spark, rows, F.lit(True), k=3)
    want = brute(rows, lambda i: True, 3)
    assert set(got) == set(want) == {0, 1, 2, 3, 4, 5, 30, 31}
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    assert [i for i, _ in got[0]][:2] == [4, 5]  # ties go to the smaller id


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    normal = [(i, rng.normal(size=8).tolist(), 0, 0, 0) for i in range(40)]
    short = [(100 + i, rng.normal(size=3).tolist(), 0, 0, 0) for i in range(20)]
    stray = [(200, rng.normal(size=9).tolist(), 0, 0, 0)]
    got = found(spark, normal + short + stray, F.lit(True), k=3)
    assert set(got) == {*range(40), *range(100, 120)}
    assert all(len(v) == 3 and all((i < 100) == (q < 100) for i, _ in v) for q, v in got.items())
    assert got == found(spark, normal, F.lit(True), k=3) | found(spark, short, F.lit(True), k=3)


def test_few_vectors(spark):
    assert found(spark, [(0, [1.0], 0, 0, 0)], F.lit(True)) == {}
    assert found(spark, [], F.lit(True)) == {}
    assert len(found(spark, [(0, [1.0, 2.0], 0, 0, 0), (1, [1.0, 1.0], 0, 0, 0)], F.col("vec_id") == 1)[1]) == 1


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, data)
        assert after.columns == docs.columns
        kept[name] = {r.doc_id for r in after.select("doc_id").collect()}
        docs = after
    packed = corpus_pipeline.run(spark, data)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept["near_dedup"]
    all_ids = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}
    assert len(kept["language_id"]) >= 0.98 * len(all_ids)
    assert kept["near_dedup"] < kept["quality_rules"] < kept["language_id"] <= all_ids


def test_one_row_of_each_component(spark):
    import corpus_pipeline

    words = [[f"w{n}x{i}" for i in range(100)] for n in range(6)]
    a, b, c, d, e, f = (" ".join(w) for w in words)
    rows = [(1, a), (1, a), (1, a.upper()), (1, a + " more"), (2, a), (1, b)]  # two components of one id
    rows += [(None, c), (None, c), (None, d), (3, d), (4, e), (5, f), (5, f), (6, ""), (6, ""), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, source string")
    after = corpus_pipeline.one_of_each(spark, docs, "")
    assert after.columns == docs.columns
    left = sorted(((r.doc_id, (r.text or "")[:4].lower()) for r in after.collect()), key=str)
    want = [(1, a[:4]), (1, b[:4]), (None, c[:4]), (3, d[:4]), (4, e[:4]), (5, f[:4]), (6, ""), (7, "")]
    assert left == sorted(want, key=str)


def test_pipeline_of_odd_documents(spark, odd_documents, no_documents):
    import corpus_pipeline

    for docs, docs_given in ((odd_documents, True), (no_documents, False)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        # language ID drops what has no letters, the quality rules what has fewer than 50 words
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left == ({5} if docs_given else set())
