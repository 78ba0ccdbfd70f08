"""The numbered queries against their SQL or a brute-force version, over whole tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from keystrand.llm import decontaminate, language, lines, pii, queries, urls
from tests.compare import SF_DIR, of_spark, of_sql

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(name, sf_dir=SF_DIR):
    found = duckdb.sql(f"select * from read_parquet('{sf_dir}/{name}.parquet')")
    return [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]


def lowered(text):
    return re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text):
    words = WORD.findall(lowered(text))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
@pytest.mark.parametrize("sf_dir", [SMALL, SF_DIR])
def test_sql(spark, name, sf_dir):
    assert of_spark(queries.QUERIES[name](spark, sf_dir)) == of_sql(queries.ORACLE[name], sf_dir)


# personal data

#: The patterns as they are told.
TOLD = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and doubled % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def told_spans(text):
    return [(k, m.start(), m.end()) for k, p in TOLD.items() for m in re.finditer(p, text) if fits(k, m.group())]


def test_personal_data(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    rows = queries.op1_personal_data(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = told_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in TOLD]
        spans = [x for x in r.spans.split(",") if x]
        assert set(joined.split(",")) - {""} <= set(spans)
        order = [([*TOLD, "secret"].index(k), int(s)) for k, s, _ in (x.split(":") for x in spans)]
        assert order == sorted(order) and r.n_spans == len(spans) == r.n_secret + sum(not x.startswith("secret:") for x in spans)


def test_base_spans_of_hard_texts():
    hard = ["a@b@c.d", "1.2.3.4.5.6.7.8", "x@-.-", "256.1.1.1 1.2.3", "+1 (2) 3--4 5.6 7 8 9", "4111 1111 1111 1111-4111111111111111", "4111-1111-1111-1111", "a.b@c..d", "@a.b a@b.c@d.e", "é@a.b 👍 a@b.co 1.1.1.1", "0000001.2.3.00255", "+" * 50 + "1" * 30, "1-" * 200]
    for text in hard:
        assert pii.base_spans(text) == told_spans(text), text


# token counts


def test_token_counts(spark):
    import base64

    import public_tokenizers as tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encode = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    told = {r["doc_id"]: len(encode(r["text"] or "")) for r in table("documents", SMALL)}
    assert {r.doc_id: r.n_tokens for r in queries.op2_token_counts(spark, SMALL).collect()} == told


# benchmark decontamination


def test_benchmark_leaks(spark):
    docs = {r["doc_id"]: lowered(r["text"]) for r in table("documents")}
    items = {r["item_id"]: WORD.findall(lowered(r["text"])) for r in table("benchmark")}
    found = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in queries.op3_benchmark_leaks(spark, SF_DIR).collect()}
    planted = set()
    for d, text in docs.items():
        words = " " + " ".join(WORD.findall(text)) + " "
        planted |= {(d, i) for i, item in items.items() if item and " " + " ".join(item) + " " in words}
    assert planted and planted <= set(found)
    held = Counter(s for item in items.values() for s in {tuple(item[i : i + 5]) for i in range(max(1, len(item) - 4))})
    weigh = lambda s: np.log(1 + len(items) / held[s]) if s in held else np.log(1 + len(items))
    for (d, i), (share, first) in found.items():
        item, words = items[i], WORD.findall(docs[d])
        a = Counter(tuple(item[k : k + 5]) for k in range(len(item) - 4))
        window = words[first : first + len(item)]
        b = Counter(tuple(window[k : k + 5]) for k in range(len(window) - 4))
        both, every = sum((a & b)[s] * weigh(s) for s in a & b), sum((a | b)[s] * weigh(s) for s in a | b)
        assert both / every == pytest.approx(share) and share >= 0.75


def test_hamming_blocks_miss_nothing():
    rng = np.random.default_rng(1)
    index = decontaminate.Index([1], [" ".join(f"w{i}" for i in range(30))])
    group = index.groups[0]
    for _ in range(300):
        bits = np.unpackbits(group.prints[0], bitorder="little")
        bits[rng.choice(64, decontaminate.RADIUS, replace=False)] ^= 1
        near = np.packbits(bits, bitorder="little")
        assert any(group.near[block, near[block], 0] for block in range(decontaminate.BLOCKS))


# URL filter


def test_url_rules(spark):
    told = {}
    for r in table("pages"):
        url = r["url"] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = lowered(re.split(r"[/?#]", rest, maxsplit=1)[0])
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        best = None
        for act, rule in urls.RULES:
            top, _, tail = rule.partition("/")
            if (host == top or host.endswith("." + top)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
                best = (act, rule)
        told[r["page_id"]] = (host, path, best)
    rows = queries.op4_url_filter(spark, SF_DIR).collect()
    assert len(rows) == len(told)
    for r in rows:
        host, path, best = told[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None)
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")


def test_url_models_tell_sides_apart(spark):
    rules = (("block", "bad.net/"), ("allow", "good.org/"))
    rows = [(i, f"https://good.org/reading/library-{i}/chapter") for i in range(60)] + [(100 + i, f"https://bad.net/win-cash-{i}/xxx?casino") for i in range(60)]
    rows += [(1000, "https://else.org/reading/library/chapter"), (1001, "https://else.net/win-cash-now/xxx")]
    found = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert (found[1000], found[1001]) == ("allow", "block")


# near duplicates


def linked_components(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common = Counter()
    for ids in holders.values():
        common.update((a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
    label = {d: d for d in sets}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((top(a), top(b)))
            label[high] = low
    return {d: (len(s), top(d)) for d, s in sets.items()}


@pytest.mark.parametrize("sf_dir", [SMALL, SF_DIR])
def test_near_duplicates(spark, sf_dir):
    told = linked_components({r["doc_id"]: r["text"] for r in table("documents", sf_dir)})
    rows = queries.op6_near_duplicates(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == told
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


# language


def test_language(spark):
    langs = {r["doc_id"]: r for r in table("documents")}
    rows = queries.op7_language(spark, SF_DIR).collect()
    assert len(rows) == len(langs)
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        own = langs[r.doc_id]
        if r.held_out and own["lang"] and any(c.isalpha() for c in own["text"] or ""):
            total += 1
            right += r.lang_pred == own["lang"]
    assert total > 100 and right >= 0.95 * total


def test_language_ignores_columns_of_the_row(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = language.train(docs)
    turned = docs.selectExpr("doc_id", "text", "'xx' as lang", "'none' as source")
    pick = lambda df: {r.doc_id: (r.lang_pred, r.score) for r in language.predict(df, model).collect()}
    assert pick(docs) == pick(turned)


# sharding


def test_hash_tree_shards(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in table("documents")}
    rows = queries.op8_hash_tree_shards(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(docs[r.doc_id]) + 16, zlib.crc32(docs[r.doc_id]), "key")
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == 40 and max(map(len, slots.values())) < 3 * len(docs) / 40
    assert 0 < sum(r.grown_shard == 40 for r in rows) < 3 * len(docs) / 41


# line dedup


def test_line_dedup(spark):
    seen, holders, told = {}, defaultdict(list), {}
    for r in sorted(table("documents", SMALL), key=lambda r: r["doc_id"]):
        kept, removed = [], 0
        lines = [] if r["text"] is None else r["text"].split("\n")
        for k, line in enumerate(lines):
            own = frozenset(WORD.findall(lowered(line)))
            common = Counter(at for x in own for at in holders[x])
            if any(4 * n >= 3 * (len(own) + len(seen[at]) - n) for at, n in common.items()):
                removed += 1
            else:
                kept.append(line)
            if own:
                seen[r["doc_id"], k] = own
                for x in own:
                    holders[x].append((r["doc_id"], k))
        told[r["doc_id"]] = (len(lines), removed, zlib.crc32("\n".join(kept).encode()))
    found = {r.doc_id: (r.n_lines, r.n_removed, r.text_crc32) for r in queries.op9_line_dedup(spark, SMALL).collect()}
    assert sum(x[1] for x in told.values()) > 0 and found == told


def test_line_dedup_with_few_marks(spark, monkeypatch):
    """Sets that fall on the bits of settled ones aren't taken for settled."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = set(map(tuple, lines.removed_lines(docs).collect()))
    monkeypatch.setattr(lines, "MARKS", 1 << 10)
    assert set(map(tuple, lines.removed_lines(docs).collect())) == whole


def test_line_prefixes_are_sent_packed(spark):
    """What the join shuffles: a row for a bucket of a task, of 37 bytes for each prefix token; every token is there."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    none = np.zeros(1 << 10, bool)
    rows = lines._prefixes(docs, np.zeros(lines.SKETCH, np.uint8), (none, none), 5).collect()
    sets = {frozenset(WORD.findall(lowered(line))) for (text,) in docs.select("text").collect() for line in (text or "").split("\n")} - {frozenset()}
    assert len(rows) <= 5 * docs.rdd.getNumPartitions()
    assert sum(len(r.data) for r in rows) == 37 * sum(len(x) - (3 * len(x) + 3) // 4 + 1 for x in sets)


def test_line_join_follows_the_sets_of_a_group(spark, monkeypatch):
    """Variants of one line, of which many pairs are just similar and many just not: all that have a similar one before
    them are found, and the pairs held against one another follow the number of variants, not its square."""
    draw, made, saved = random.Random(3), Counter(), lines.saved

    def variant(i):
        changed = set(draw.sample(range(60), draw.randint(3, 6)))
        return [f"own{i}x{k}" if k in changed else f"word{k}" for k in range(60)]

    sets = [variant(i) for i in range(600)]
    ids = [None, -(2**63), 2**63 - 1, *draw.sample(range(-(2**61), 2**61), 297), *draw.sample(range(1000), 300)]
    placed = sorted(zip(ids, map(frozenset, sets), strict=True), key=lambda x: (x[0] is not None, x[0] or 0))
    gone = {i for k, (i, x) in enumerate(placed) if any(4 * len(x & y) >= 3 * len(x | y) for _, y in placed[:k])}

    def counted(df, name, *more):
        out = saved(df, name, *more)
        made[name] += out.count() if name == "line-pairs" else 0
        return out

    monkeypatch.setattr(lines, "saved", counted)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in zip(ids, sets, strict=True)], "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in lines.removed_lines(docs).collect()} == gone
    assert 0 < made["line-pairs"] < 12 * len(sets)



# mixing


def test_mix_comes_near_its_targets(spark):
    rows = queries.op10_source_mix(spark, SF_DIR).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        assert r.taken <= 3 * r.size
        taken[r.target, r.source_size] += r.taken
        largest[r.target, r.source_size] = max(largest[r.target, r.source_size], r.size)
    assert all(abs(n - k[0]) <= largest[k] for k, n in taken.items())
    again = {r.doc_id: r.taken for r in queries.op10_source_mix(spark, SF_DIR).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
