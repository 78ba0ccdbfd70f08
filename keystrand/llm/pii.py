"""Personal data: fixed patterns, and a character-level BiLSTM-CRF that adds spans which the patterns miss."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.llm.store import bounded_batches
from keystrand.llm.tagger import WINDOW, Tagger, classes_of
from keystrand.llm.words import chunks, text_buffers

BASE_KINDS = ("email", "ip", "card", "phone")
#: The tagger also finds secrets: keys and tokens, for which there is no fixed pattern.
KINDS = (*BASE_KINDS, "secret")
SAMPLE = 100
CARRIER = 4000
#: What closes a sentence or a quotation and no value.
CLOSING = " \n.,;:!?\"'"
EXAMPLES = 1500
STEPS = 240

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:(?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
#: What every value holds, also those written with a bracketed at or dot.
BRACKETED = r"[\[(] ?(?:at|dot|\.) ?[\])]"
MARK = re.compile(r"[0-9@]|" + BRACKETED)
BRACKETED_BYTES = re.compile(BRACKETED.encode())
ANCHOR = np.zeros(256, dtype=bool)
ANCHOR[[*range(0x30, 0x3A), 0x40]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its test, in the order of ``BASE_KINDS``, then of place.

    Each pattern is read so that a text takes linear time: an e-mail is looked for around each @, and runs of digits
    are consumed whole, which changes no match because a match that fails at a run's start fails within it.
    """
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in NUMBERS.finditer(text):
        parts = m.group().split(".")
        if len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = "".join(DIGITS.findall(m.group()))
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.findall(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def plausible(kind: str, value: str) -> bool:
    """Whether a decoded span can be what it is taken for."""
    digits = "".join(DIGITS.findall(value))
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]{2,64} ?(?:@|[\[(] ?(?:at|@) ?[\])]) ?[^\s@]{2,}(?: ?[\[(] ?(?:dot|\.) ?[\])] ?[^\s@]+)*", value))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "secret":
        return len(value) >= 16 and len(digits) >= 4 and bool(re.fullmatch(r"(?=(?:[^A-Za-z]*[A-Za-z]){4})[A-Za-z0-9_+/=.\-]+", value))
    return 9 <= len(digits) <= 15 and len(re.findall(r"[ ().\-/]+", value)) >= 2 and not re.search(r"[^0-9 ()./+\-]", value)


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: What may stand before a secret; what closes it follows.
BEFORE_SECRETS = ('token = "', "TOKEN = '", "api_key: ", "key=", "secret ", 'password = "', "Bearer ", "")


def _value(rng: random.Random) -> tuple[str | None, str]:
    """A made-up value and its kind; None for what looks like personal data and is none."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda a, b: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(a, b)))
    kind = rng.choice(["email", "email", "ip", "ip", "card", "card", "phone", "phone", "secret", "secret", None, None, None])
    if kind == "email":
        local = w(2, 9) + rng.choice(["", "." + w(2, 6), "." + d(2), "_" + d(1)])
        host = w(3, 9) + rng.choice(["", d(1)]) + "." + rng.choice(["com", "example", "org", "net"]) + rng.choice(["", ".com", ".org"])
        return kind, local + rng.choice(["@", "@", "@", " [at] ", " (at) ", "(at)", " @ "]) + rng.choice([host, host, host.replace(".", " [dot] "), w(4, 9)])
    if kind == "ip":
        return kind, rng.choice([".", ".", ".", " . ", "[.]", ","]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = d(rng.choice([15, 15, 15, 12, 14, 18]) - 1)
        digits = next(body + c + e for c in "0" for e in "0123456789" if luhn(body + c + e))
        return kind, rng.choice(["", "", " ", "-", ".", "  "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "phone":
        a, b, c = d(3), d(3), d(4)
        return kind, rng.choice([f"+{d(1)} ({a}) {b}-{c}", f"+{d(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{d(2)}/{b} {c}", f"+{d(2)}{a}{b}{c}"])
    if kind == "secret":
        of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
        return kind, rng.choice([of("0123456789abcdef", rng.choice([32, 40, 40, 64])), of("0123456789ABCDEF", rng.choice([32, 40])), "sk-" + of(ALNUM, 32), "AKIA" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ghp_" + of(ALNUM, 36), of(ALNUM, rng.randint(20, 44))])
    return None, rng.choice([w(25, 40), d(rng.randint(1, 8)), f"{d(1)}.{d(1)}.", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"{d(3)}.{d(2)}", f"@{w(4, 8)}", f"v{d(1)}.{d(1)}.{d(2)}", f"{d(6)}x", d(16), f"www.{w(4, 12)}.com/{w(8, 20)}/{d(4)}"])


def labelled_examples(texts: list[str], n: int = EXAMPLES, seed: int = 3) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Windows of running text with labelled spans: made-up values set into pieces of ``texts``."""
    rng, out = random.Random(seed), []
    texts = [t for t in texts if t] or ["the of and "]
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW:
            carrier = rng.choice(texts)
            at = rng.randrange(len(carrier))
            piece = carrier[at : at + rng.randint(0, 40)]
            text += "" if MARK.search(piece) else piece
            text += rng.choice([" ", " ", "\n", " - ", ": ", ""]) if text and text[-1].isspace() else rng.choice([" ", " ", "\n", ": ", " | "])
            kind, value = _value(rng)
            before = rng.choice(BEFORE_SECRETS) if kind == "secret" else ""
            text += before
            if kind:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + before[-1:].strip(" =") + rng.choice([" ", "", ". ", ", ", "!! ", "### ", "\n", "%%% "])
        out.append((text, spans))
    return out


def train(examples, steps: int = STEPS) -> Tagger:
    """Fit a tagger to texts with labelled spans, in windows at random places."""
    rng = random.Random(4)
    x, y = np.zeros((len(examples), WINDOW), np.int64), np.zeros((len(examples), WINDOW), np.int64)
    for row, (text, spans) in enumerate(examples):
        tags = np.zeros(len(text), np.int64)
        for kind, start, end in spans:
            k = KINDS.index(kind)
            tags[start:end] = 2 + 2 * k
            tags[start] = 1 + 2 * k
        at = rng.randint(-20, max(0, len(text) - WINDOW + 20))
        low, high = max(0, at), min(len(text), at + WINDOW)
        x[row, low - at : high - at], y[row, low - at : high - at] = classes_of(text)[low:high], tags[low:high]
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.fit(x, y, steps)
    return tagger


def added_spans(text: str, base: list[tuple[str, int, int]], tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans that the tagger finds beside the base ones: of one kind throughout, plausible, apart from every base span."""
    kind = np.where(tags > 0, (tags + 1) // 2, 0)
    opened = (kind > 0) & ((tags % 2 == 1) | (np.concatenate([[0], kind[:-1]]) != kind))
    taken = sorted((s, e) for _, s, e in base)
    out, at = [], 0
    for start in np.flatnonzero(opened).tolist():
        end = start + 1
        while end < len(tags) and kind[end] == kind[start] and not opened[end]:
            end += 1
        while end > start and text[end - 1] in CLOSING:
            end -= 1
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        later = bisect_left(taken, (end, 0))
        clear = all(e <= start for _, e in taken[at:later])
        name = KINDS[kind[start] - 1]
        if end > start and clear and plausible(name, text[start:end]):
            out.append((name, start, end))
    return out


def marks_of(text: str) -> np.ndarray:
    """Places without which a text holds nothing: a span that :func:`plausible` lets pass has one of them."""
    return np.array([m.start() for m in MARK.finditer(text)], dtype=np.int64)


def added_to(texts: list[str], bases: list[list[tuple[str, int, int]]], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """:func:`added_spans` of some texts, whose windows go through the tagger together."""
    tags = tagger.tags([classes_of(t) for t in texts], [marks_of(t) for t in texts])
    return [added_spans(*x) for x in zip(texts, bases, tags, strict=True)]


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans) for every row of ``docs``.

    The first four counts and the hash are of the base spans; ``spans`` lists base and added ones as kind:start:end in
    code points, secrets last, and n_spans counts them. Null and empty texts have none. Only texts with a digit, an @ or
    a bracketed at or dot are read further, since every value that is let pass holds one. A long text is read whole;
    what a task holds for it grows with its length, by some ten bytes a character near such places. Repeated rows come
    out alike; other columns are not read; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    numbers = [*(f"n_{k}" for k in BASE_KINDS), "n_secret", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            for low, high in chunks(at):
                n = high - low
                counts, digest, listed = np.zeros((len(numbers), n), np.int64), [none] * n, [""] * n
                part = data[at[low] : at[high]]
                anchors = ANCHOR[part]
                anchors[[m.start() for m in BRACKETED_BYTES.finditer(part.tobytes())]] = True
                marked = np.concatenate([[0], np.cumsum(anchors)])
                edges = at[low : high + 1] - at[low]
                rows = np.flatnonzero(marked[edges[1:]] > marked[edges[:-1]]).tolist()
                texts = [data[at[low + i] : at[low + i + 1]].tobytes().decode("utf-8", "replace") for i in rows]
                bases = [base_spans(t) for t in texts]
                for i, base, added in zip(rows, bases, added_to(texts, bases, shared.value), strict=True):
                    for k, _, _ in base:
                        counts[BASE_KINDS.index(k), i] += 1
                    digest[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    listed[i] = _joined(base + added)
                    counts[-2:, i] = sum(k == "secret" for k, _, _ in added), len(base) + len(added)
                columns = dict(zip(numbers, counts, strict=True)) | {"base_sha256": digest, "spans": listed}
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, n), *(pa.array(columns[f]) for f in order)], ["doc_id", *order])

    order = [*numbers[:-2], "base_sha256", "spans", *numbers[-2:]]
    schema = "doc_id long, " + ", ".join(f"{f} {'string' if f in ('base_sha256', 'spans') else 'long'}" for f in order)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    """A tagger trained on values set into the running text of ``sample`` rows at most, those of least hash of doc_id
    and text, alike ones once; with fewer or none it is trained on the values alone. Of each such text a stretch of
    ``CARRIER`` characters from a drawn place on goes to the driver, as running text between values is all it is for.
    A threshold from the number of rows leaves about twice as many, so no more are put in order."""
    known = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    share = min(1.0, 2 * sample / max(1, known.count()))
    drawn = known.select(F.xxhash64("doc_id", "text").alias("hash"), "text").filter(F.col("hash") <= min(int(share * 2**64), 2**64 - 1) - 2**63)
    at = F.pmod(F.xxhash64("hash"), F.greatest(F.length("text") - CARRIER, F.lit(1))).cast("int") + 1
    rows = drawn.select("hash", F.substring("text", at, F.lit(CARRIER)).alias("text")).groupBy("hash").agg(F.first("text").alias("text")).orderBy("hash").limit(sample).collect()
    return train(labelled_examples([r.text for r in rows]))
