"""Rows without doc_id, rows that repeat, and columns named as results: each row counts for itself where it can."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from keystrand.llm import decontaminate, language, lines, mixing, near_dup, sharding
from keystrand.llm.copies import numbered
from keystrand.llm.graph import components, extended

SCHEMA = "doc_id long, text string, lang string, source string"
PROSE = "the quick brown fox jumps over the lazy dog and then it runs away from the old house by the river"


def test_numbers_among_alike(spark):
    rows = spark.createDataFrame([(i % 3 if i % 7 else None, "x") for i in range(400)], "k long, v string").repartition(5)
    found = Counter((r.k, r.at) for r in numbered(rows, "at", "k").collect())
    sizes = Counter(r.k for r in rows.collect())
    assert found == Counter((k, i) for k, n in sizes.items() for i in range(n))
    alone = numbered(spark.range(5), "at", "id")
    assert {tuple(r) for r in alone.collect()} == {(i, 0) for i in range(5)}


def test_a_source_of_null_ids_comes_near_its_target(spark):
    big = [(None, " ".join(["w"] * (1 + i % 9)), None, "a") for i in range(2000)] + [(None, "same words here", None, "b")] * 1000
    small = [(i, "some words of text", None, "c") for i in range(300)]
    docs = spark.createDataFrame(big + small, SCHEMA).repartition(4)
    rows = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source_size, r.target] += r.taken
        assert r.taken <= 3 * r.size
    assert len(taken) == 3 and all(abs(n - t) <= 20 for (_, t), n in taken.items())
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    whole = Counter(r.source for r in mixing.mixed_documents(docs).collect())
    assert sum(whole.values()) == sum(r.repeats for r in rows)


def test_slots_of_rows_alike(spark):
    docs = spark.createDataFrame([(None, "same", None, None)] * 3000 + [(5, "same", None, None)] * 500, SCHEMA).repartition(6)
    slots = {}
    for r in sharding.assign_shards(docs).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, slots.values())) == 3500
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_one_row_of_each_group(spark):
    rows = [(None, PROSE, "en", "web")] * 3 + [(None, PROSE + " again", "en", "web"), (None, "words of another text that stands all alone in here", "en", "web"), (7, "", "en", "a"), (8, None, "en", "a"), (9, "one more text with quite other words in it", "en", "a"), (9, "one more text with quite other words in it", "en", "a")]
    kept = near_dup.without_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    told = Counter((r.doc_id, r.text) for r in kept)
    assert told.total() == 5 and set(told.values()) == {1}
    assert sum((None, t) in told for t in (PROSE, PROSE + " again")) == 1


def test_leaks_without_ids_go(spark):
    rows = [(None, "before " + PROSE, "en", "web"), (None, "a clean text with none of that", "en", "web"), (1, PROSE, "en", "web"), (1, "clean as well under one id", "en", "web"), (None, None, None, None)]
    benchmark = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    kept = decontaminate.without_benchmark(spark.createDataFrame(rows, SCHEMA), benchmark).collect()
    assert Counter(r.text for r in kept) == Counter(["a clean text with none of that", "clean as well under one id", None])


@pytest.mark.parametrize("more", [{}, {"lang_pred": "own", "Score": 1, "predicted": 2}])
def test_predictions_beside_columns_of_their_names(spark, more):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    wide = docs.select("*", *[F.lit(v).alias(n) for n, v in more.items()])
    found = language.predict(wide, model)
    assert found.columns[: len(wide.columns)] == wide.columns and len(found.columns) == len(wide.columns) + 2
    assert {(r.doc_id, r[-2]) for r in found.collect()} == {(r.doc_id, r[-2]) for r in language.predict(docs, model).collect()}


def test_training_is_bounded_where_ids_repeat(spark):
    rows = [(3, f"wort und text nummer {i % 5}", "de", "a") for i in range(900)] + [(i, f"word and text number {i}", "en", "a") for i in range(900)]
    drawn = language._drawn(spark.createDataFrame(rows, SCHEMA), 50).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in drawn} in ({"de": 5, "en": 50}, {"en": 50})


def test_components_of_drawn_edges(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    ends = {x for a, b in edges if a != b for x in (a, b)}
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    found = {r.id: r.component for r in components(frame(edges)).collect()}
    assert found == {x: label[x] for x in ends}
    later = extended(components(frame(edges[::2])), frame(edges[1::2]))
    assert {r.id: r.component for r in later.collect()} == found


def test_lines_of_rows_without_id(spark):
    rows = [(None, "a line of its own here\nwhat every text says at last"), (None, "quite another first line\nwhat every text says at last"), (None, "a third start of a text\nand an end of its own too"), (4, "one with a number\nwhat every text says at last"), (4, "one number and two texts\nof which none is the other")]
    found = {r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("what every text says at last" in t for t in found) == 1
    assert {t.split("\n")[0] for t in found} == {t.split("\n")[0] for _, t in rows}
    assert {rows[2][1], rows[4][1]} <= found


def test_short_hashes_of_windows_are_a_first_pass_alone(spark, monkeypatch):
    from keystrand.llm import quality

    words = " ".join(f"w{i}" for i in range(900)) + " w5 w6 w7"
    docs = spark.createDataFrame([(1, words)], "doc_id long, text string")
    monkeypatch.setattr(quality, "_packed_places", lambda windows, mask: F.sequence(F.lit(0), F.size(windows) - 1))
    assert quality.measures(docs).first().n_repeat_words == 6
