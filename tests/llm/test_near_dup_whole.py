"""Near copies within hot buckets of documents that are nearly, but not enough, alike."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from keystrand.llm import near_dup

HEAVY, WORDS = 400, 200


def test_links_in_hot_buckets_are_whole(spark, monkeypatch):
    """Two texts are alike enough, and in all their buckets stand texts that come before both in every order of ids."""
    monkeypatch.setattr(near_dup, "SALTED", 3, raising=False)
    rng = random.Random(11)
    template = [f"t{i}" for i in range(WORDS)]
    put = lambda tag, at, n: " ".join(template[:at] + [f"{tag}w{j}" for j in range(n)] + template[at + n :])
    orders = spark.range(HEAVY, 20_000).select("id", F.xxhash64("id").alias("drawn"), F.xxhash64("id", F.lit(1)).alias("centre"))
    last = orders.orderBy(F.least("drawn", "centre").desc()).limit(2)
    x, y = sorted(r.id for r in last.collect())
    texts = {i: put(f"d{i}", rng.randrange(WORDS - 50), 50) for i in range(HEAVY)} | {x: put("x", 20, 9), y: put("y", 120, 9)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.classes(docs).collect()} == {i: i for i in texts} | {y: x}


def test_borderline_groups_lose_no_link(spark):
    """Groups of texts around the threshold, and trees of edits, against all pairs."""
    from tests.llm.test_queries import linked_components

    rng, texts = random.Random(3), {}
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(50):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                words[rng.randrange(60)] = f"e{rng.random()}"
            texts[len(texts)] = " ".join(words)
    tree = [[f"r{i}" for i in range(90)]]
    for _ in range(150):
        words = list(rng.choice(tree))
        words[rng.randrange(90)] = f"e{rng.random()}"
        tree.append(words)
    for words in tree:
        texts[len(texts)] = " ".join(words)
    told = linked_components(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.classes(docs).collect()} == told


def test_pairs_at_the_threshold_share_a_band():
    import numpy as np

    rng, lost = np.random.default_rng(2), 0
    for union, shared in ((4, 3), (20, 15), (80, 60), (200, 150)):
        for _ in range(500):
            every = rng.integers(0, 2**64, union, dtype=np.uint64)
            own = shared + rng.integers(0, union - shared + 1)
            a, b = np.sort(every[:own]), np.sort(np.concatenate([every[:shared], every[own:]]))
            lost += not (near_dup.band_keys(near_dup.signature(a)) == near_dup.band_keys(near_dup.signature(b))).any()
    assert lost == 0
