"""URL filter: rules by host and path, and a ratio of character Markov models (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.llm.store import saved

#: (action, host and path): the longest that fits decides.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

ORDER = 4
SMOOTHING = 4.0
MIN_COUNT = 3
BINS = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty if the url is null or has no ``://``. A-Z of the host are lower-cased."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule whose host is the url's or above it and whose path starts the url's."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: len(r[1])):
        top, slash, rest = rule.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(slash + rest)
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def _grams(texts: DataFrame, order: int, keep: tuple[str, ...]) -> DataFrame:
    """A row for each character of ``address`` with the grams of 1 to ``order`` characters that end at it."""
    marked = texts.select(*keep, F.concat(F.lit("^"), F.col("address"), F.lit("$")).alias("marked"))
    at = marked.withColumn("at", F.explode(F.sequence(F.lit(2), F.length("marked"))))
    grams = {f"g{k}": F.when(F.col("at") >= k, F.substring("marked", F.col("at") - (k - 1), F.lit(k))) for k in range(1, order + 1)}
    return at.select(*keep, *[c.alias(n) for n, c in grams.items()])


def fit_models(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio): the log of P(last character | those before) under the accepted model over that under the rejected.

    ``labelled`` has address, good and n (times seen). Counts cover all labelled rows. Each order is smoothed by the
    one below. Contexts vary in length: a gram is kept if seen ``MIN_COUNT`` times, and one that isn't is scored by its
    longest kept ending. The table grows with the input; totals of contexts are of all grams, kept or not.
    """
    wide = _grams(labelled, order, ("good", "n"))
    counts = wide.select("good", "n", F.explode(F.array(*[f"g{k}" for k in range(1, order + 1)])).alias("gram")).filter("gram is not null")
    both = counts.groupBy("gram").agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("r"))
    every = saved(both, "url-grams")
    kept = every.filter(F.col("a") + F.col("r") >= MIN_COUNT)
    model = None
    for k in range(1, order + 1):
        own = kept.filter(F.length("gram") == k).withColumns({"context": F.substring("gram", 1, k - 1), "ending": F.expr("substring(gram, 2)")})
        spread = every.filter(F.length("gram") == k).withColumn("context", F.substring("gram", 1, k - 1))
        totals = spread.groupBy("context").agg(F.sum("a").alias("ta"), F.sum("r").alias("tr")).withColumnRenamed("context", "c")
        joined = own.join(totals, F.col("context") == F.col("c"))
        if k == 1:
            below = {"pa": F.lit(1 / 256), "pr": F.lit(1 / 256)}
            joined = joined.withColumns(below)
        else:
            lower = model.filter(F.length("gram") == k - 1).select(F.col("gram").alias("e"), "pa", "pr")
            joined = joined.join(lower, F.col("ending") == F.col("e"), "left").withColumns({p: F.coalesce(p, F.lit(1 / 256)) for p in ("pa", "pr")})
        fitted = joined.select("gram", ((F.col("a") + SMOOTHING * F.col("pa")) / (F.col("ta") + SMOOTHING)).alias("pa"), ((F.col("r") + SMOOTHING * F.col("pr")) / (F.col("tr") + SMOOTHING)).alias("pr"))
        model = fitted if model is None else model.unionByName(fitted)
        model = saved(model, f"url-model-{k}")
    return model.select("gram", F.log(F.col("pa") / F.col("pr")).alias("ratio"))


def score(addresses: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """(address, score): the mean over an address's characters of the ratio of the longest known gram ending there.

    Each distinct longest gram meets the model once, and the distinct grams of each address then meet those. Neither
    join asks for a broadcast: Spark makes one only of what it knows to be small, and the scores are the same."""
    longest = F.coalesce(*[F.col(f"g{k}") for k in range(order, 0, -1)])
    rows = _grams(addresses, order, ("address",)).groupBy("address", longest.alias("longest")).agg(F.count("*").alias("times"))
    endings = rows.select("longest").distinct().select("longest", F.explode(F.transform(F.sequence(F.lit(1), F.length("longest")), lambda k: F.expr("longest").substr(F.length("longest") - k + 1, k))).alias("ending"))
    known = endings.join(model, F.col("ending") == F.col("gram")).groupBy("longest").agg(F.max_by("ratio", F.length("gram")).alias("ratio")).withColumnRenamed("longest", "_longest")
    met = rows.join(known, F.col("longest") == F.col("_longest"), "left")
    mean = F.sum(F.coalesce("ratio", F.lit(0.0)) * F.col("times")) / F.sum("times")
    return met.groupBy("address").agg(F.round(mean, 9).alias("score"))


def calibrated(labelled_scores: DataFrame, bins: int = BINS) -> float:
    """The score from which an address is accepted: the bin edge with the best sum of the rates of accepted and
    rejected addresses judged right, over all labelled rows. Takes one row a bin to the driver."""
    at = F.greatest(F.lit(-bins), F.least(F.lit(bins), F.floor(F.col("score") * bins / 2))).cast("int")
    rows = labelled_scores.groupBy(at.alias("bin")).agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("r")).orderBy("bin").collect()
    good, bad = sum(x.a for x in rows), sum(x.r for x in rows)
    if not good or not bad:
        return 0.0
    best, found, below_a, below_r = -1.0, 0.0, 0, 0
    for x in rows:
        rate = (good - below_a) / good + below_r / bad
        if rate > best:
            best, found = rate, x.bin * 2 / bins
        below_a, below_r = below_a + x.a, below_r + x.r
    return found


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages``.

    Pages that a rule decides are the labelled rows: allowed ones train the accepted model, blocked ones the rejected.
    Other pages are allowed if their score, which is normalised by length, reaches the calibrated bound. Null urls and
    urls without ``://`` have empty host and path and are scored as such. If no page or only one side is labelled,
    both models are alike or one-sided and the bound is 0. Repeated rows are judged alike; other columns are not read.
    """
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", name.alias("rule"), action.alias("action"), F.concat("host", F.lower("path")).alias("address"))
    addresses = saved(ruled.groupBy("address", (F.col("action") == "allow").alias("good")).agg(F.count("*").alias("n")), "url-addresses")
    labelled = addresses.filter("good is not null")
    model = fit_models(labelled)
    scores = saved(score(addresses.select("address").distinct(), model), "url-scores")
    bound = calibrated(labelled.join(scores, "address"))
    verdict = F.coalesce("action", F.when(F.col("score") >= bound, F.lit("allow")).otherwise(F.lit("block")))
    judged = ruled.join(scores.withColumnRenamed("address", "_address"), F.col("address") == F.col("_address"), "left")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
