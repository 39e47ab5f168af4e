"""Rules, shards, mixes and archives against plain versions, and the pipeline stage by stage."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from armwise.llm import mixing, queries, quality_rules, sharding, warc


def plain_rules(text: str | None) -> tuple:
    t = text or ""
    ws = plain.WORD.findall(t)
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    again = {p for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if plain.WORD.search(x)]
    failed = len(ws) < 50 or 100 * len(again) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_rules_match_plain_counts(spark, which):
    docs = plain.awkward(spark) if which == "awkward" else spark.read.parquet(f"{plain.SF}/documents.parquet")
    rows = quality_rules.apply_rules(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == Counter((r.doc_id, *plain_rules(r.text)) for r in docs.select("doc_id", "text").collect())
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality_rules.passing(docs).count() == sum(r.kept for r in rows)
    assert quality_rules.passing(docs).columns == docs.columns
    assert quality_rules.apply_rules(plain.empty(docs)).count() == 0


def test_rules_are_one_native_projection(spark):
    plan = quality_rules.apply_rules(spark.read.parquet(f"{plain.SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def score(key: str, shard: int) -> int:
    return int(hashlib.md5(f"shard:{shard}:{key}".encode()).hexdigest()[:12], 16)


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_shards_are_those_of_the_largest_score(spark, which):
    docs = plain.awkward(spark) if which == "awkward" else spark.read.parquet(f"{plain.SF}/documents.parquet")
    rows = sharding.shard(docs, [1.0] * 8, [1.0] * 9).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    for r in rows:
        key = "\x00null" if r.doc_id is None else str(r.doc_id)
        assert r.shard == max(range(8), key=lambda s: score(key, s))
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    for s in range(8):
        mine = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert [r.doc_id for r in mine] == sorted((r.doc_id for r in mine), key=lambda k: (k is not None, k))
    assert sharding.shard(plain.empty(docs), [1.0] * 8).count() == 0


def test_shards_follow_weights(spark):
    keys = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    n = Counter(r.shard for r in sharding.shard(keys, [1.0, 2.0, 5.0]).collect())
    assert all(abs(n[s] / 20_000 - w / 8) < 0.02 for s, w in enumerate((1, 2, 5)))


@pytest.mark.parametrize("which", ["table", "larger", "awkward"])
def test_mix_meets_targets(spark, which):
    docs = plain.awkward(spark) if which == "awkward" else spark.read.parquet(f"{plain.SF if which == 'table' else plain.SF_LARGER}/documents.parquet")
    rows = mixing.mix(docs).collect()
    size: Counter = Counter()
    taken: Counter = Counter()
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
    want = plain.targets(size)
    longest, documents = max(r.size for r in rows), Counter(r.source for r in rows)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
    for s in size:
        assert abs(taken[s] - want[s]) <= (longest if which == "awkward" else max(0.01 * want[s], size[s] / documents[s]))  # one mean document where a source has few
    assert Counter(rows) == Counter(mixing.mix(docs.repartition(3)).collect())
    assert mixing.mix(plain.empty(docs)).count() == 0


def test_flight_keeps_words_and_documents():
    units = [[0.3 + 0.05 * (i % 9), 10 + i * 7 % 31, i * 2654435761, i] for i in range(200)]
    words, count = sum(u[0] * u[1] for u in units), sum(u[0] for u in units)
    flight = mixing.Flight(both=True)
    done = [x for u in units for x in flight.add(u)] + flight.open
    assert len(flight.open) <= 2 and len(done) == 200
    assert sum(u[0] * u[1] for u in done) == pytest.approx(words) and sum(u[0] for u in done) == pytest.approx(count)


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_archives_round_trip(spark, which):
    if which == "table":
        pages = spark.read.parquet(f"{plain.SF}/pages.parquet")
    else:
        rows = [(1, "http://A.b/x", "<p>ä</p>"), (2, "http://a.b/x", "<p>ä</p>"), (3, None, None), (4, "no host", ""), (None, "http://c/", "<p>ä</p>"), (2, "http://a.b/x", "<p>ä</p>"), (5, "u\r\nv", "a\r\n\r\nWARC/1.1\r\n\r\n" * 3), (6, "https://z.y/q?r=://s", "x" * 2_000_000)]
        pages = spark.createDataFrame([(*r, "d", "f") for r in rows], "page_id long, url string, html string, digest string, file string")
    source = [(r.page_id, r.html or "") for r in pages.select("page_id", "html").collect()]
    largest: dict[str, int] = {}
    for k, t in source:
        largest[t] = max(largest.get(t, -1), -1 if k is None else k)
    want = Counter()
    for k, t in source:
        again = k is not None and k != largest[t]
        want[k, len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(), "revisit" if again else "response", largest[t] if again else None] += 1
    got = warc.archive(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    ordered = sorted(got, key=lambda r: r.capture_slot)
    assert [r.capture_slot for r in ordered] == list(range(len(got)))
    keys = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in ordered]
    assert keys == sorted(keys)
    assert warc.archive(plain.empty(pages)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{plain.SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, plain.SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    flat = [Counter(tuple("null" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x) for x in r) for r in f[columns].itertuples(index=False)) for f in (got, want)]
    assert flat[0] == flat[1]


def test_pipeline_stage_by_stage(spark):
    import sentencepiece

    import corpus_pipeline
    from armwise.llm.common import written

    docs = corpus_pipeline.table(spark, plain.SF, "documents")
    columns, last = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = written(stage(spark, docs, plain.SF), name)
        after = docs.toPandas()
        if name == "quality_rules":
            assert set(after.doc_id) <= {k for k, t in zip(before.doc_id, before.text, strict=True) if not plain_rules(t)[-1]}
        if name == "ngram_join":
            least = plain.joined(dict(zip(before.doc_id, before.text, strict=True)))
            assert sorted(after.doc_id) == sorted(k for k in least if least[k][1] == k)
        if name == "cube_mix":
            assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.value_counts().max() <= 2
            last = after
        if name == "piece_codec":
            other = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
            assert sorted((k, tuple(i)) for k, i in zip(after.doc_id, after.ids, strict=True)) == sorted((k, tuple(other.encode(t))) for k, t in zip(last.doc_id, last.text, strict=True))
        else:
            assert docs.columns == columns
    assert corpus_pipeline.run(spark, plain.SF).count() == docs.count()


def test_stages_of_awkward_and_empty_tables(spark):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        docs = plain.awkward(spark)
        assert stage(spark, docs, plain.SF).count() <= 2 * docs.count()
        assert stage(spark, plain.empty(docs), plain.SF).count() == 0


def test_landing_in_levels_keeps_targets(spark, monkeypatch):
    docs = spark.read.parquet(f"{plain.SF_LARGER}/documents.parquet")
    monkeypatch.setattr(mixing, "PART", 6)  # parts leave two documents each: several levels until a source has six
    rows = mixing.mix(docs).collect()
    size: Counter = Counter()
    taken: Counter = Counter()
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
    want = plain.targets(size)
    assert len(rows) == docs.count() and all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in size)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)  # sources met by shuffle
    assert Counter(rows) == Counter(mixing.mix(docs).collect())


def test_archives_of_many_small_files_and_ranges(spark, monkeypatch):
    pages = spark.read.parquet(f"{plain.SF}/pages.parquet").unionByName(spark.createDataFrame([(10_001, "http://big.example/", "x" * 70_000), (10_002, "http://big.example/", "y" * 1_100_000), (10_003, "http://big.example/", "y" * 1_100_000)], "page_id long, url string, html string"))
    want = sorted(map(tuple, warc.archive(pages).drop("file", "file_offset").collect()), key=str)
    write = warc.write_archives
    monkeypatch.setattr(warc, "write_archives", lambda rows, path, date: write(rows, path, date, file_bytes=400_000))
    monkeypatch.setattr(warc, "RANGE", 7)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    got = warc.archive(pages)
    assert sorted(map(tuple, got.drop("file", "file_offset").collect()), key=str) == want
    assert got.select("file").distinct().count() > 6
