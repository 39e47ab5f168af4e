"""Near-duplicates: the shingle join and the embedding index against brute force."""

import random

import numpy as np
import plain
import pytest

from armwise.llm import embedding_dedup, graph, ngram_join


def result(df) -> dict:
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def edited(rng: random.Random, words: list[str], edits: int) -> list[str]:
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**9)}"
    return out


def family(seed: int) -> dict[int, str]:
    rng = random.Random(seed)
    texts: dict[int, str] = {}
    for f in range(12):
        own = [f"f{f}w{rng.randrange(60)}" for _ in range(rng.choice([5, 9, 40, 80]))]
        for _ in range(rng.choice([1, 3, 12])):
            texts[len(texts)] = " ".join(edited(rng, own, rng.choice([0, 0, 1, 1, 2, 4])))
    return texts


def test_join_matches_brute_force_on_whole_table(spark):
    docs = spark.read.parquet(f"{plain.SF}/documents.parquet")
    want = plain.joined({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    assert result(ngram_join.join(docs)) == want


@pytest.mark.parametrize("block", [2000, 5])
def test_join_matches_brute_force_near_the_bound(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # small blocks: candidates lie in several of them
    texts = family(block)
    got = result(ngram_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert got == plain.joined(texts)


def test_join_of_awkward_rows(spark):
    docs = plain.awkward(spark)
    rows = ngram_join.join(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by[i].component_id for i in (1, 2, 6, 7, 9, 10)] == [1, 1, 6, 6, 9, 9]
    assert [(by[i].n_shingles, by[i].component_id) for i in (3, 4, 5, 8)] == [(0, 3), (0, 4), (0, 5), (1, 8)]
    assert sorted(r.component_id or -1 for r in rows if r.doc_id is None) == [-1, 1]
    assert ngram_join.join(plain.empty(docs)).count() == 0


def test_one_each_keeps_the_smallest_key(spark):
    docs = plain.awkward(spark)
    kept = ngram_join.one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 8, 9, 11]
    assert sorted(r.doc_id for r in ngram_join.one_each(docs, broadcast_rows=0).collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 8, 9, 11]


@pytest.mark.parametrize("chunk", [1_000_000, 3])
def test_components_of_random_graphs(spark, monkeypatch, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    rng = random.Random(chunk)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    edges += edges[:5]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    want = plain.components({x for a, b in edges if a != b for x in (a, b)}, edges)
    assert got == want


def vectors_of(df) -> dict[int, np.ndarray | None]:
    return {r.vec_id: r.embedding for r in df.select("vec_id", "embedding").collect()}


def brute(vectors: dict) -> set[tuple[int, int]]:
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    return {(ids[i], ids[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)}


@pytest.mark.parametrize("part", [1500, 20])
def test_index_recall_and_precision(spark, monkeypatch, part):
    monkeypatch.setattr(embedding_dedup, "PART", part)  # small parts: long lists are met in blocks
    table = spark.read.parquet(f"{plain.SF_LARGER}/embeddings.parquet")
    vectors = vectors_of(table)
    links = brute(vectors)
    degree = {i: 0 for i in vectors}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    rows = embedding_dedup.near_duplicates(table).collect()
    assert sorted(r.vec_id for r in rows) == sorted(vectors)
    assert all(r.n_links <= degree[r.vec_id] and r.kept == (r.vec_id == r.component_id) for r in rows)
    assert sum(r.n_links for r in rows) >= 0.9 * 2 * len(links)
    whole = plain.components(vectors, links)
    assert all(whole[r.vec_id] == whole[r.component_id] for r in rows)


def test_index_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0]), (11, [1e-300, 1e300])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label string, node string")
    got = embedding_dedup.near_duplicates(df).collect()
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert len(got) == len(rows)
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[None][:2] == (3, 1)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9))
    assert by[10] == (1, 10, True) and by[11] == (1, 10, False)
    assert embedding_dedup.near_duplicates(plain.empty(df)).count() == 0


def test_blocks_of_unlinked_candidates_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    sizes, verify = [], ngram_join._verify

    def watched(rows, share):
        sizes.append(rows.groupBy("block").count().agg({"count": "max"}).first()[0] or 0)
        return verify(rows, share)

    monkeypatch.setattr(ngram_join, "_verify", watched)
    rng = random.Random(3)
    passages = [" ".join(f"p{i}w{j}" for j in range(9)) for i in range(12)]
    texts = {i: " ".join(rng.choice(passages) for _ in range(rng.choice([3, 4, 5]))) for i in range(400)}  # candidates of many others, linked with few
    got = result(ngram_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert got == plain.joined(texts)
    assert len(sizes) == 3 and max(sizes) <= 4 * 20  # two parts, each about BLOCK by hash


def planted(seed: int, n: int = 5000, dims: int = 64) -> np.ndarray:
    """Vectors around clusters, and partners of cosine 0.951 to 0.97 for a third of them; more of them than pivots squared."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    x = rng.normal(size=(n, dims)) + 0.5 * centres[rng.integers(0, 40, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, n - 1, 3):
        noise = rng.normal(size=dims)
        noise -= (noise @ x[i]) * x[i]
        cosine = rng.uniform(0.951, 0.97)
        x[i + 1] = cosine * x[i] + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)
    return x.astype(np.float32)


def test_recall_near_the_bound_of_a_fiftieth_against_all(spark):
    x = planted(11)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(len(x) + i, x[50 * i].tolist()) for i in range(20)]  # and some equal vectors
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    y = np.array([v for _, v in rows], np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    asked = np.arange(0, len(y), 50)
    near = y[asked] @ y.T >= 0.95
    true = near.sum(1) - 1
    found = np.array([got[i].n_links for i in asked.tolist()])
    assert len(x) > 64**2 and true.sum() > 60 and (found <= true).all()
    assert found.sum() >= 0.9 * true.sum()
    whole = plain.components(range(len(y)), [(i, j) for i, j in zip(*(z.tolist() for z in np.nonzero(np.triu(y @ y.T >= 0.95, 1))), strict=True)])
    assert all(whole[r.component_id] == whole[i] for i, r in got.items())


def test_rare_lengths_are_compared_whole(spark):
    rng = np.random.default_rng(5)
    rows = []
    for d in range(3, 90):  # more lengths than any list of common ones would hold
        v = rng.normal(size=d)
        rows += [(10 * d, v.tolist()), (10 * d + 1, (v * 3).tolist()), (10 * d + 2, (-v).tolist())]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: int(i % 10 < 2) for i in got} and len(got) == len(rows)


@pytest.mark.parametrize(("pivots", "n"), [(40, 40), (64, 400), (707, 3000), (4000, 3000)])
@pytest.mark.parametrize("dims", [64, 384])
def test_recall_of_the_rule_near_the_bound(pivots, n, dims):
    """Pairs of cosine 0.951 to 0.97 that are on one list and share enough pivots, at all numbers of pivots."""
    rng = np.random.default_rng(pivots + dims)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    sample = rng.normal(size=(min(embedding_dedup.SAMPLE, max(2 * n, pivots)), dims)).astype(np.float32)
    base = unit(rng.normal(size=(n, dims)))
    cosine = rng.uniform(0.951, 0.97, (n, 1))
    other = rng.normal(size=(n, dims))
    other = unit(other - (other * base).sum(1, keepdims=True) * base)
    chosen = embedding_dedup.choose_pivots([v.tobytes() for v in sample], pivots, "f4")
    assert len(chosen) == pivots
    a, b = embedding_dedup.describe(base, chosen), embedding_dedup.describe(cosine * base + np.sqrt(1 - cosine**2) * other, chosen)
    met = (embedding_dedup.list_keys(a, dims)[:, :, None] == embedding_dedup.list_keys(b, dims)[:, None, :]).any((1, 2))
    shared = np.array([len(set(x) & set(y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)]) >= embedding_dedup.SHARED
    assert (met & shared).mean() >= 0.9
