"""Language identification: family first, then one-versus-one linear support vector machines within the family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrand.llm.store import bounded_batches, free, saved
from keystrand.llm.words import LOWER, text_buffers

#: The family of each language by its ISO 639-1 code; a language not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sk": "slavic",
}

DIMS = 1 << 12
PER_LANGUAGE = 300
EPOCHS = 12
UNDECIDED = "und"
#: Texts whose features, of fixed size each, stand in memory at once.
ROWS_AT_ONCE = 256


def _letters() -> np.ndarray:
    """Lower-cased letters and bytes above 0x7F as they are, everything else a space."""
    table = np.full(256, 0x20, dtype=np.uint8)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = LOWER[0x41:0x5B]
    table[0x80:] = np.arange(0x80, 0x100)
    return table


LETTERS = _letters()


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text the square roots of its hashed byte pair and triple counts, scaled to length 1."""
    out = np.zeros((len(at) - 1, DIMS), dtype=np.float32)
    for i, (low, high) in enumerate(zip(at[:-1], at[1:], strict=True)):
        b = np.concatenate([[0x20], LETTERS[data[low:high]], [0x20]]).astype(np.uint32)
        b = b[np.concatenate([[True], (b[1:] != 0x20) | (b[:-1] != 0x20)])]
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        hashed = np.concatenate([two + np.uint32(1 << 24), three]) * np.uint32(2654435761) >> np.uint32(20)
        out[i] = np.sqrt(np.bincount(hashed.astype(np.int64), minlength=DIMS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, seed: int = 1) -> np.ndarray:
    """Weights (last: bias) of a linear support vector machine for y in -1, 1: averaged subgradient steps on the hinge
    loss with both classes weighed alike."""
    rng, reg = np.random.default_rng(seed), 1e-4
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, steps = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for rows in np.array_split(order, max(1, len(order) // 32)):
            steps += 1
            wrong = y[rows] * (x[rows] @ w) < 1
            slope = reg * w - (share[rows][wrong] * y[rows][wrong]) @ x[rows][wrong] / len(rows)
            w = w - 4.0 / np.sqrt(1 + steps) * slope
            if epoch >= EPOCHS // 2:
                mean += w
    return (mean / max(1, steps - steps // 2)).astype(np.float32)


@dataclass
class Model:
    """Pairwise machines between families, and between the languages of each family."""

    families: list[str]
    members: dict[str, list[str]]
    between: dict[tuple[str, str], np.ndarray]
    within: dict[tuple[str, str], np.ndarray]

    def _vote(self, x: np.ndarray, names: list[str], machines: dict) -> tuple[np.ndarray, np.ndarray]:
        """Winner of the one-versus-one votes, ties by summed margins, and its least margin as a share of 0 to 1."""
        votes, total, least = (np.zeros((len(x), len(names))) for _ in range(3))
        least += 9
        for a, b in combinations(range(len(names)), 2):
            w = machines[names[a], names[b]]
            m = x @ w[:-1] + w[-1]
            for k, own in ((a, m), (b, -m)):
                votes[:, k] += own > 0
                total[:, k] += own
                least[:, k] = np.minimum(least[:, k], own)
        best = np.argmax(votes + 1e-3 * np.tanh(total / 10), axis=1)
        return best, 1 / (1 + np.exp(-3 * np.clip(least[np.arange(len(x)), best], -9, 9)))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, sure = self._vote(x, self.families, self.between)
        out, score = np.empty(len(x), dtype=object), np.array(sure)
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, inner = self._vote(x[rows], self.members[name], self.within)
                out[rows] = np.array(self.members[name], dtype=object)[best]
                score[rows] *= inner
        return out, score


def fit(x: np.ndarray, langs: list[str], families: dict[str, str] = FAMILIES) -> Model:
    of = np.array([families.get(v, v) for v in langs])
    langs = np.array(langs)
    names = sorted(set(of))
    members = {f: sorted(set(langs[of == f])) for f in names}
    pairs = lambda labels, found: {(a, b): fit_svm(x[np.isin(labels, (a, b))], np.where(labels[np.isin(labels, (a, b))] == a, 1.0, -1.0)) for a, b in combinations(found, 2)}
    within = {}
    for f in names:
        within |= pairs(langs, members[f])
    return Model(names, members, pairs(of, names), within)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _drawn(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, hash, text): the ``per_language`` rows of least hash of each language among those that are not held out
    and have doc_id, lang and a letter. Thresholds from the languages' counts leave about twice as many rows, which
    fold where they are alike; only these are put in order."""
    hashed = docs.select("lang", F.xxhash64("doc_id", "text").alias("hash"), "text").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull())
    counts = hashed.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("n"))
    bound = F.when(F.col("n") <= 2 * per_language, F.lit((1 << 63) - 1)).otherwise((share * F.lit(2.0**64) - F.lit(2.0**63)).cast("long"))
    bounds = saved(counts.select("_lang", bound.alias("bound")), "language-bounds")
    near = hashed.join(bounds, F.col("lang") == F.col("_lang")).filter("hash <= bound").groupBy("lang", "hash").agg(F.first("text").alias("text"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("hash"))
    return near.withColumn("place", place).filter(F.col("place") <= per_language).select("lang", "hash", "text")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on at most ``per_language`` rows of each language, drawn by a hash of doc_id and text. What reaches the driver
    is one vector of fixed size for each, whatever the length of the texts. None if there is none."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            for low in range(0, len(at) - 1, ROWS_AT_ONCE):
                high = min(len(at) - 1, low + ROWS_AT_ONCE)
                x = features(data, at[low : high + 1]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(low, high - low), batch.column("hash").slice(low, high - low), pa.array([v.tobytes() for v in x], pa.binary())], ["lang", "hash", "x"])

    rows = _drawn(docs, per_language).mapInArrow(run, "lang string, hash long, x binary").toArrow().sort_by([("lang", "ascending"), ("hash", "ascending")])
    if not len(rows):
        return None
    x = np.stack([np.frombuffer(v.as_buffer(), dtype=np.float16) for v in rows.column("x").combine_chunks()]).astype(np.float32)
    return fit(x, rows.column("lang").to_pylist())


def predicted(text: Column, model: Model | None) -> Column:
    """A struct of lang_pred and score for each text. Only texts go to Python, once, and only the answers come back.

    Null text, text without letters or no model: ``und`` and 0. The score is the family's least margin times the
    language's, each squashed to 0 to 1. Votes that tie go by summed margins, then to the first name in order. Equal
    texts are predicted alike; a long text is read whole.
    """
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            data, at = text_buffers(texts)
            langs, scores = [], [np.zeros(0)]
            for low in range(0, len(at) - 1, ROWS_AT_ONCE):
                found, score = model.predict(features(data, at[low : min(len(at) - 1, low + ROWS_AT_ONCE) + 1]))
                langs += found.tolist()
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores), pa.float64())], ["lang_pred", "score"])

    unknown = F.struct(F.lit(UNDECIDED).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return unknown
    return F.when(text.rlike(r"\p{L}"), run.asNondeterministic()(text)).otherwise(unknown)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs`` with lang_pred and score (each with underscores before it if ``docs`` has the name)."""
    bounded_batches(docs.sparkSession)
    lang, score, both = free(docs, "lang_pred"), free(docs, "score"), free(docs, "predicted")
    rows = docs.withColumn(both, predicted(F.col("text"), model))
    return rows.select(*docs.columns, F.col(both)["lang_pred"].alias(lang), F.col(both)["score"].alias(score))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``; trained on the rows that are not held out."""
    model = train(docs)
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def with_known_language(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """``docs`` without rows whose language can't be told: ``und``, or a score under ``least``; columns as they came."""
    both = free(docs, "predicted")
    bounded_batches(docs.sparkSession)
    rows = docs.withColumn(both, predicted(F.col("text"), train(docs)))
    return rows.filter((F.col(both)["lang_pred"] != UNDECIDED) & (F.col(both)["score"] >= least)).select(*docs.columns)
