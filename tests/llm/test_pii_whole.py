"""E-mails written with a bracketed at, in texts with no digit and no @, and spans that reach beyond the marked windows."""

from __future__ import annotations

import re

import numpy as np
import pytest

from keystrand.llm import pii
from keystrand.llm import tagger as tagger_module
from keystrand.llm.tagger import STRIDE, Tagger, classes_of

PROSE = "the quick brown fox jumps over the lazy dog and then runs away from the old house by the river "


class Everything:
    """Takes what stands between bars for an e-mail, where a window with a mark is decoded."""

    def tags(self, texts, marks):
        out = [np.zeros(len(codes), np.int64) for codes in texts]
        for codes, own, at in zip(texts, out, marks, strict=True):
            bars = np.flatnonzero(codes == classes_of("|")[0])
            if len(at):
                own[bars[0] + 1 : bars[1]] = 2
        return out


def test_bracketed_mail_without_digit_or_at_sign(spark):
    values = ["jane.doe (at) example [dot] org", "jane.doe [at] example.org", "jane(at)example.org"]
    rows = [(i, f"{PROSE}|{v}| {PROSE}") for i, v in enumerate(values)] + [(9, PROSE), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    found = {r.doc_id: r.spans for r in pii.find(docs, Everything()).collect()}
    low = len(PROSE) + 1
    assert found == {i: f"email:{low}:{low + len(v)}" for i, v in enumerate(values)} | {9: "", 10: ""}


@pytest.fixture(scope="module")
def tagger():
    return pii.train(pii.labelled_examples([PROSE], seed=3))


def test_trained_tagger_finds_bracketed_mail(tagger):
    text = f"{PROSE}\njane.doe (at) example [dot] org\n{PROSE}"
    assert any(k == "email" for k, _, _ in pii.added_to([text], [[]], tagger)[0])


def test_values_that_patterns_miss(tagger):
    """Recall and precision on made-up values in other places than those of training."""
    told, found, right = 0, 0, 0
    examples = pii.labelled_examples([PROSE], n=200, seed=99)
    bases = [pii.base_spans(t) for t, _ in examples]
    for (_, spans), base, added in zip(examples, bases, pii.added_to([t for t, _ in examples], bases, tagger), strict=True):
        missed = {x for x in spans if not any(s < x[2] and x[1] < e for _, s, e in base)}
        told, found, right = told + len(missed), found + len(added), right + len(missed & set(added))
    assert told > 100 and right >= 0.8 * told and right >= 0.9 * found


def test_secrets_of_documents(spark):
    """The driver's documents hold secrets that no fixed pattern finds: nearly all are found, and nothing clean is."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text like '%oken = \"%' or doc_id % 50 = 7")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.find(docs, pii.fitted(docs)).collect()
    told = {(d, m.start(1), m.end(1)) for d, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    found = {(r.doc_id, *map(int, x.split(":")[1:])) for r in rows for x in r.spans.split(",") if x.startswith("secret:")}
    assert len(told) > 100 and len(told & found) >= 0.95 * len(told) and len(found - told) <= 0.02 * len(told)
    assert sum(r.n_secret for r in rows) == len(found)


def test_texts_do_not_change_those_beside_them(tagger):
    texts = ["x" * n + " 10 . 0 . 0 . 7 " + "y" * (n % 50) for n in range(0, 200, 13)] + ["", "1", "7" * 5000]
    together = tagger.tags([classes_of(t) for t in texts], [pii.marks_of(t) for t in texts])
    for t, tags in zip(texts, together, strict=True):
        assert (tagger.tags([classes_of(t)], [pii.marks_of(t)])[0] == tags).all()


def test_one_best_sequence_over_all_windows(tagger):
    """The stitched search gives the sequence of highest score by a plain search over the same emissions."""
    text = f"{PROSE} 10 . 1 . 2 . 3 and jane.doe [at] example.org {PROSE} 4111.1111.1111.1111 {PROSE}" * 3
    codes = classes_of(text)
    n = -(-len(codes) // tagger_module.STRIDE)
    padded = np.concatenate([np.zeros(tagger_module.MARGIN, np.int64), codes, np.zeros(200, np.int64)])
    scores = tagger.emissions(padded[np.arange(n)[:, None] * tagger_module.STRIDE + np.arange(tagger_module.WINDOW)]).reshape(-1, tagger.p["b"].size)
    best, back = scores[0].astype(np.float64), []
    for row in scores[1:]:
        step = best[:, None] + tagger.p["a"]
        back.append(step.argmax(axis=0))
        best = row + step.max(axis=0)
    told = [int(best.argmax())]
    for b in reversed(back):
        told.append(int(b[told[-1]]))
    assert (tagger.tags([codes], [np.arange(len(codes))])[0] == np.array(told[::-1])[: len(codes)]).mean() > 0.999


def test_spans_are_whole_beyond_marked_windows():
    class Long(Tagger):
        def emissions(self, x, batch=256):
            out = np.zeros((len(x), STRIDE, 9), np.float32)
            middle = x[:, tagger_module.MARGIN : tagger_module.MARGIN + STRIDE]
            out[..., 2] = np.where(np.isin(middle, classes_of("x5")), 50, -50)
            return out

    text = "." * 500 + "x" * 400 + "5" + "x" * 300 + "." * 500
    codes = classes_of(text)
    assert STRIDE * 3 < 300
    tags = Long(9).tags([codes], [np.array([900])])[0]
    assert (tags[500:1201] == 2).all() and not (tags[:500] == 2).any() and not (tags[1201:] == 2).any()
