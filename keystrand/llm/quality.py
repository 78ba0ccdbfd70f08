"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as was at by be this from are or an not which have "
    "der die das und den von zu mit sich des auf für im dem nicht ein eine als auch es "
    "le la les de des et en un une du que qui dans est pour par sur au pas ce "
    "el los las y del se por con una su para al lo como más o"
).split()

#: What a stop word may end with in a text.
ENDINGS = ".,!?;:"
#: No longer word, in bytes, is a stop word; lower-casing shortens a character by two bytes at most.
LONGEST = 3 * max(len(w.encode()) for w in STOP_WORDS) // 2

#: (name, measure, least or most, bound): a document fails if a measure is beyond its bound.
THRESHOLDS: tuple[tuple[str, str, str, float], ...] = (
    ("short", "n_words", "least", 50),
    ("short_words", "mean_word", "least", 2.0),
    ("long_words", "mean_word", "most", 16.0),
    ("symbols", "symbol_ratio", "most", 0.1),
    ("shouting", "bang_ratio", "most", 0.2),
    ("stop_words", "stop_ratio", "least", 0.05),
    ("repeated_lines", "dup_line_ratio", "most", 0.3),
)


#: Texts of up to so many words sort a place with the upper bits of its window's hash in one number, as a first pass.
PACKED = ((1 << 12) - 1, (1 << 16) - 1)


def _windows(n: Column, hashes: Column) -> Column:
    """A hash for each window of three words."""
    most = F.greatest(n - 2, F.lit(0))
    pairs = F.zip_with(F.slice(hashes, 1, most), F.slice(hashes, F.lit(2), most), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(pairs, F.slice(hashes, F.lit(3), most), lambda p, c: F.xxhash64(p, c))


def _repeated(placed: Column, same, place) -> Column:
    """Sorted places of windows whose hash is that of a neighbour in ``placed``, which is sorted by hash."""
    ahead = F.slice(placed, F.lit(2), F.greatest(F.size(placed) - 1, F.lit(0)))
    steps = F.zip_with(placed, ahead, lambda x, y: F.coalesce(same(x, y), F.lit(False)))
    before = F.concat(F.array(F.lit(False)), steps)
    doubled = F.zip_with(F.zip_with(steps, before, lambda x, y: x | y), placed, lambda d, x: F.when(d, place(x)))
    return F.sort_array(F.array_compact(doubled))


def _packed_places(windows: Column, mask: Column) -> Column:
    """Places of repeated windows by a sort of plain numbers: a hash's upper 48 bits or more, then the place."""
    placed = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
    return _repeated(placed, lambda x, y: x.bitwiseXOR(y).between(0, mask), lambda x: x.bitwiseAND(mask).cast("int"))


def _whole_places(windows: Column, places: Column) -> Column:
    """Those of ``places`` whose windows' whole hashes repeat among them."""
    placed = F.sort_array(F.transform(places, lambda i: F.struct(F.get(windows, i).alias("h"), i.alias("i"))))
    return _repeated(placed, lambda x, y: x.h == y.h, lambda x: x.i)


def _covered(places: Column) -> Column:
    steps = F.zip_with(places, F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts and ratios that rules compare, for every row.

    Words are runs of characters other than space and U+0009 to U+000D, over the whole text; null text has none.
    Windows of three words are compared by hashes of 64 bits; in texts of up to 65,535 words a sort of plain numbers with
    their upper bits tells first which windows can repeat at all. Ratios over no words or no lines are 0. Repeated rows are
    measured alike; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text"), F.array_remove(F.split(text, WHITE), "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    hashed = split.withColumns({"n": F.size("words"), "hashes": F.transform("words", lambda w: F.xxhash64(w))})
    hashed = hashed.withColumn("windows", _windows(F.col("n"), F.col("hashes")))
    mask = F.when(F.col("n") <= PACKED[0], F.lit(PACKED[0]).cast("long")).otherwise(F.lit(PACKED[1]).cast("long"))
    every = F.sequence(F.lit(0), F.size("windows") - 1)
    hashed = hashed.withColumn("maybe", F.when(F.col("n") <= PACKED[1], _packed_places(F.col("windows"), mask)).otherwise(every))
    hashed = hashed.withColumn("places", _whole_places(F.col("windows"), F.col("maybe")))
    closed = lambda w: F.substring(w, -1, 1).isin(*ENDINGS)
    stops = F.size(F.filter("words", lambda w: F.when(closed(w), F.lower(F.rtrim(w, F.lit(ENDINGS))).isin(STOP_WORDS)).otherwise((F.octet_length(w) <= LONGEST) & F.lower(w).isin(STOP_WORDS))))
    counted = hashed.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("places")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_bangs"),
        stops.cast("long").alias("n_stops"),
    )
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return counted.withColumns({
        "mean_word": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "bang_ratio": F.col("n_bangs") / words,
        "stop_ratio": F.col("n_stops") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
    })


def failures(thresholds=THRESHOLDS) -> Column:
    """The names of the rules that a row of :func:`measures` fails, compiled from the table."""
    tests = [F.when(F.col(measure) < bound if side == "least" else F.col(measure) > bound, F.lit(name)) for name, measure, side, bound in thresholds]
    return F.array_compact(F.array(*tests))


def apply_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """measures with base_failed, kept and the failed rules' names. A document without words fails."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measures(docs).withColumns({"base_failed": base, "failed": failures(thresholds)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
