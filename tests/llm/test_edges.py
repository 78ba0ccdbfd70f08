"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns whose names clash with the operators' own."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keystrand.llm import decontaminate, language, lines, mixing, near_dup, pii, quality, sharding, tokens, urls
from keystrand.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog and then it runs away from the old house by the river"
LONG = " ".join(f"word{i % 977} of the long text {i}" for i in range(30_000))
NASTY = [
    (1, PROSE, "en", "web", 1),
    (1, PROSE, "en", "web", 1),
    (2, PROSE, "de", None, None),
    (3, None, "en", "web", None),
    (4, "", None, "web", 0),
    (5, " \t\r\n\x0b\x0c ", None, None, None),
    (6, LONG, "en", "books", None),
    (7, LONG + " and one more", "en", "books", None),
    (None, PROSE + " again", None, None, None),
    (None, None, None, None, None),
    (8, "a@b.co 1.2.3.4 +1 (234) 567-8901 4111 1111 1111 1111", "en", "web", None),
    (9, "żółw 東京 👍 \u2028 no break", "pl", "web", None),
    (10, "one two", "en", "web", None),
    (11, "one two", "en", "web", None),
    (12, "12345 67890 !!! ###", None, "web", None),
    (-5, PROSE.upper(), "en", "web", None),
]
#: Names that the operators use within.
CLASHES = ["n", "h1", "h2", "bands", "id", "_id", "key", "_key", "component", "a", "b", "at", "size", "draw", "s", "shard", "bucket", "gone", "mix", "mix_source", "mix_copies", "lang_text", "lettered", "lang_pred", "score", "tokens", "line", "prefix", "words", "hashes", "place", "x"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(NASTY, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PROSE), (1, PROSE), (2, None), (3, ""), (None, PROSE), (4, "one two"), (5, "never seen words in a row here at all")], "item_id long, text string")


def encoder():
    return lambda text: [ord(c) % 1000 for c in text]


OPERATORS = {
    "personal data": lambda d: pii.find(d, pii.fitted(d)),
    "token counts": lambda d: tokens.count_tokens(d, encoder, 50256),
    "quality": quality.apply_rules,
    "near copies": near_dup.classes,
    "language": language.identify,
    "shards": sharding.assign_shards,
    "lines": lines.dedup_lines,
    "mix": mixing.mix,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_row(docs, wide, none, name):
    f = OPERATORS[name]
    found = f(docs)
    rows = found.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in NASTY)
    assert Counter(map(repr, f(wide).collect())) == Counter(map(repr, rows))
    empty = f(none)
    assert empty.collect() == [] and empty.columns == found.columns


def test_near_copies_of_nasty_rows(docs):
    found = {r.doc_id: r for r in near_dup.classes(docs).collect() if r.doc_id is not None}
    assert {d: r.component_id for d, r in found.items()} == {1: -5, 2: -5, -5: -5, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, 11: 10, 12: 12}
    assert [found[d].n_shingles for d in (3, 4, 5, 10)] == [0, 0, 0, 1]
    assert all(r.kept and r.component_id is None for r in near_dup.classes(docs).filter("doc_id is null").collect())


def test_undecided_language(docs):
    found = {(r.doc_id, r.lang_pred == "und", r.score == 0) for r in language.identify(docs).collect()}
    assert {(d, True, True) for d in (3, 4, 5, 12)} <= found
    assert all(not und for d, und, _ in found if d in (1, 6, 9))


def test_leaks_of_nasty_rows(docs, wide, none, benchmark):
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found == {(1, 1), (2, 1), (-5, 1), (None, 1), (10, 4), (11, 4)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(wide, benchmark.withColumn("doc_id", F.lit("own"))).collect()} == found
    assert decontaminate.contaminated(none, benchmark).collect() == []
    assert decontaminate.contaminated(docs, benchmark.limit(0)).collect() == []


def test_leaks_in_several_blocks_of_items(docs, benchmark, monkeypatch):
    whole = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 2)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()} == whole


def test_urls_of_nasty_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://EXAMPLE.Com/de/x?y"), (6, "x://a.net"), (7, "x://a.net/"), (7, "x://a.net/"), (8, "x://ÄÖ.org/fr/\n?z"), (None, "x://example.net/en/1#2"), (9, "x://" + "long" * 3000 + ".org/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}
    assert found[1][:3] == found[2][:3] == found[3][:3] == found[4][:3] == ("", "", None)
    assert found[5] == ("example.com", "/de/x", "example.com/de/", "block")
    assert found[6][:3] == ("a.net", "", None) and found[7] == ("a.net", "/", "net/", "block")
    assert found[8][:3] == ("ÄÖ.org", "/fr/\n", "org/fr/") and found[None] == ("example.net", "/en/1", "example.net/en/", "allow")
    wide = pages.select("*", *[F.lit("own").alias(c) for c in ("host", "path", "rule", "action", "address", "score", "good", "n", "gram", "g1", "m1", "r1")])
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(wide).collect()} == found
    assert urls.filter_urls(pages).count() == len(rows)
    assert urls.filter_urls(pages.limit(0)).collect() == []


def test_token_blocks_of_any_size(spark, tmp_path):
    rows = [(i, "x" * n) for i, n in enumerate([0, 1, 7, 4, 0, 0, 33, 2, 3, 4, 5])] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    written = tokens.write_token_files(docs, encoder, 50256, f"file://{tmp_path}/flat")
    files = spark.createDataFrame([(r.file, r.length) for r in written.collect() if r.length is not None], "file string, length long")
    assert sum(r.length for r in files.collect()) == 2 * sum(len(t or "") + 1 for _, t in rows)
    for size in (2, 8, 16, 1 << 20):
        found = tokens.stitch(tokens.scan(tokens.read_ranges(files, size), 50256))
        assert Counter(r.n_tokens for r in found.collect()) == Counter(len(t or "") for _, t in rows)


@pytest.mark.parametrize("separator, dtype", [(ord("x"), "<u2"), (70_000, "<u2"), (9, "u1")])
def test_tokens_that_would_split_or_not_fit(spark, separator, dtype):
    docs = spark.createDataFrame([(1, "x\u0141")], "doc_id long, text string")
    with pytest.raises(Exception, match="is the separator .* or does not fit"):
        tokens.count_tokens(docs, encoder, separator, dtype).collect()


def test_token_files_are_deleted(spark, tmp_path, monkeypatch):
    from keystrand.plans import tables

    monkeypatch.setattr(tables, "shared_dir", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, ""), (2, "x" * 100_000)], "doc_id long, text string")
    found = tokens.count_tokens(docs, encoder, 70_000, "<u4").collect()
    assert Counter((r.doc_id, r.n_tokens) for r in found) == {(1, 3): 2, (None, 0): 1, (2, 100_000): 1}
    assert not list(tmp_path.glob("token-files-*"))


def test_token_files(spark, tmp_path):
    import numpy as np

    np.array([1, 2, 9, 9, 3, 9, 4, 5], "<u2").tofile(tmp_path / "a.bin")
    np.array([9], "<u2").tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").write_bytes(b"")
    blocks = tokens.read_token_files(spark, f"file://{tmp_path}", block_bytes=6)
    found = sorted((r.file[-5:], r.place, r.n_tokens, r.complete) for r in tokens.stitch(tokens.scan(blocks, 9)).collect())
    assert found == [("a.bin", 0, 2, True), ("a.bin", 1, 0, True), ("a.bin", 2, 1, True), ("a.bin", 3, 2, False), ("b.bin", 0, 0, True)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r.id: r.component for r in components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_repeated_windows_of_texts_of_any_length(spark):
    import random

    rng, rows = random.Random(7), []
    for n in (0, 1, 2, 3, 4, 50, 4095, 4096, 65535, 65536, 70_000):
        rows.append((n, " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(n))))
    told = {}
    for i, text in rows:
        words = text.split()
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        told[i] = len({k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if seen[w] > 1 for j in range(3)})
    found = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality.measures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: (i, n) for i, n in told.items()}


# the pipeline


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_keeps_columns(spark, docs, wide, none, tmp_path, benchmark, k):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage, last = corpus_pipeline.STAGES[k][1], k == len(corpus_pipeline.STAGES) - 1
    for table in (docs, wide, none):
        found = stage(spark, table, str(tmp_path))
        rows = found.collect()
        if last:
            assert found.columns[:-1] == table.columns and len(rows) == table.count()
        else:
            assert found.columns == table.columns and set(map(tuple, rows)) <= set(map(tuple, table.collect()))


def test_stages_decide(spark, docs, tmp_path, benchmark):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = lambda df: {r.doc_id for r in df.collect()}
    every = {r[0] for r in NASTY}
    assert ids(corpus_pipeline.known_language(spark, docs, str(tmp_path))) <= every - {3, 4, 5, 12}
    assert ids(corpus_pipeline.one_of_each(spark, docs, str(tmp_path))) == every - {1, 2, 7, 11}
    assert ids(corpus_pipeline.no_benchmark(spark, docs, str(tmp_path))) >= every - {1, 2, -5, 10, 11}
    assert not ids(corpus_pipeline.no_benchmark(spark, docs, str(tmp_path))) & {1, 2, -5, 10, 11}


def test_pipeline_equals_its_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    kept = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf_dir)
    told = Counter((r.doc_id, r.shard) for r in kept.select("doc_id", "shard").collect())
    assert told == Counter((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "shard").collect())
    assert told
