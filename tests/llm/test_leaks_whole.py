"""Similarities to benchmark items that share boilerplate don't depend on the blocks in which items are searched."""

from __future__ import annotations

import random

from keystrand.llm import decontaminate


def test_weights_are_of_the_whole_benchmark(spark, monkeypatch):
    rng = random.Random(5)
    plate = [f"b{i}" for i in range(30)]
    own = lambda i: [f"i{i}w{j}" for j in range(40)]
    items = [(i, " ".join(plate + own(i))) for i in range(12)]
    docs = []
    for d in range(48):
        words = items[d % 12][1].split()
        for _ in range(d // 12):
            words[rng.randrange(len(words))] = f"d{d}"
        docs.append((d, " ".join(["before"] * 9 + words + ["after"] * 9)))
    docs, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    told = lambda: {(r.doc_id, r.item_id, round(r.similarity, 9), r.first_word) for r in decontaminate.contaminated(docs, benchmark).collect()}
    whole = told()
    assert len(whole) >= 24 and any(s < 1 for _, _, s, _ in whole)
    for most in (1, 3):
        monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", most)
        assert told() == whole


def test_no_window_at_the_threshold_is_missed(spark):
    """Against all windows, without fingerprints: texts longer and shorter than items, items that share much, edits."""
    from collections import Counter
    from math import log

    rng = random.Random(9)
    plate = [f"b{i}" for i in range(25)]
    items = [(i, plate[: rng.randint(0, 25)] + [f"i{i}w{j}" for j in range(rng.randint(8, 40))]) for i in range(30)]
    docs = []
    for d in range(150):
        words = list(items[d % 30][1])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"d{d}"
        if d % 3 == 0:
            words = words[rng.randint(0, 8) :]
        docs.append((d, words if d % 5 == 0 else ["x"] * rng.randint(0, 9) + words + ["y"] * rng.randint(0, 9)))
    cut = lambda words: [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    held = Counter(s for _, w in items for s in set(cut(w)))
    weigh = lambda s: log(1 + len(items) / held[s]) if s in held else log(1 + len(items))
    told = set()
    for d, words in docs:
        own = cut(words)
        for i, item in items:
            whole = Counter(cut(item))
            size = min(sum(whole.values()), len(own))
            for k in range(len(own) - size + 1):
                window = Counter(own[k : k + size])
                both, every = sum(n * weigh(s) for s, n in (whole & window).items()), sum(n * weigh(s) for s, n in (whole | window).items())
                if size and both / every >= 0.75:
                    told.add((d, i))
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert len(told) > 40 and found <= told and len(found) >= 0.99 * len(told)


def test_many_items_and_far_windows_in_bounded_memory(monkeypatch):
    from keystrand.llm.words import text_buffers, words_of

    def find(index, text):
        import pyarrow as pa

        words = words_of(*text_buffers(pa.array([text])))
        every = words.shingles()
        return index.find(every, index.known(every))

    item = " ".join(f"w{i}" for i in range(30))
    index = decontaminate.Index(list(range(300)), [item if i == 7 else f"{i} " + item.replace("w", f"v{i}") for i in range(300)])
    text = item + " far" * 20_000 + " " + item
    most, real = [], decontaminate.signed_bits
    monkeypatch.setattr(decontaminate, "signed_bits", lambda h: most.append(len(h)) or real(h))
    assert find(index, text) == {7: (1.0, 0)} and max(most) < 2 * decontaminate.WORDS_AT_ONCE
