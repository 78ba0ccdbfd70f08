"""The URL model holds every gram that is seen often enough, and scores by the longest known one."""

from __future__ import annotations

import math
from collections import defaultdict

import pytest

from keystrand.llm import urls


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_model_of_many_grams(spark, threshold):
    import zlib

    name = lambda i: "".join(chr(97 + (zlib.crc32(f"{i}-{k}".encode()) >> 5) % 26) for k in range(24))
    rows = [(name(i) + f"/{i % 7}", i % 3 == 0, 3 + i % 2) for i in range(8_000)]
    a, r = defaultdict(int), defaultdict(int)
    for address, good, n in rows:
        marked = f"^{address}$"
        for at in range(2, len(marked) + 1):
            for k in range(1, min(urls.ORDER, at) + 1):
                (a if good else r)[marked[at - k : at]] += n
    seen = {g for g in {*a, *r} if a[g] + r[g] >= urls.MIN_COUNT}
    assert len(seen) > 100_000
    ta, tr = defaultdict(int), defaultdict(int)
    for g in {*a, *r}:
        ta[len(g), g[:-1]] += a[g]
        tr[len(g), g[:-1]] += r[g]
    pa, pr = {}, {}
    for g in sorted(seen, key=len):
        s, at = urls.SMOOTHING, (len(g), g[:-1])
        pa[g] = (a[g] + s * pa.get(g[1:], 1 / 256)) / (ta[at] + s)
        pr[g] = (r[g] + s * pr.get(g[1:], 1 / 256)) / (tr[at] + s)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        model = urls.fit_models(spark.createDataFrame(rows, "address string, good boolean, n long"))
        found = {x.gram: x.ratio for x in model.collect()}
        assert found.keys() == seen and all(abs(v - math.log(pa[g] / pr[g])) < 1e-9 for g, v in found.items())
        asked = ["", rows[5][0], "zzzzqqqq/!!", "ab"]
        told = {}
        for address in asked:
            marked, total = f"^{address}$", 0.0
            for at in range(2, len(marked) + 1):
                ends = [marked[at - k : at] for k in range(min(urls.ORDER, at), 0, -1)]
                total += next((found[g] for g in ends if g in found), 0.0)
            told[address] = total / (len(marked) - 1)
        scores = {x.address: x.score for x in urls.score(spark.createDataFrame([(x,) for x in asked], "address string"), model).collect()}
        assert scores.keys() == told.keys() and all(abs(scores[x] - told[x]) < 1e-8 for x in told)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
