"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrand.llm import decontaminate, language, lines, mixing, near_dup, pii, quality, sharding, tokens, urls
from keystrand.plans import checksum_sql


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_personal_data(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fitted(docs))


def op2_token_counts(spark, sf_dir, ranks="byte_bpe_50k.tiktoken", separator=50256):
    import public_tokenizers

    encoder = tokens.bpe_encoder(spark, public_tokenizers.path(ranks), public_tokenizers.PATTERN)
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), encoder, separator)


def op3_benchmark_leaks(spark, sf_dir):
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark, sf_dir):
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark, sf_dir):
    rows = quality.apply_rules(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_near_duplicates(spark, sf_dir):
    return near_dup.classes(_table(spark, sf_dir, "documents"))


def op7_language(spark, sf_dir):
    return language.identify(_table(spark, sf_dir, "documents"))


def op8_hash_tree_shards(spark, sf_dir):
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    rows = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.crc32("text").alias("text_crc32"))


def op10_source_mix(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_QUALITY_SQL = """
with base as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents),
windows as (select r, i, (words[i], words[i + 1], words[i + 2]) as w3 from (select r, words, unnest(range(1, len(words) - 1)) as i from base)),
doubled as (select r, i from (select r, i, count(*) over (partition by r, w3) as n from windows) where n > 1),
covered as (select r, count(distinct i + k) as n from doubled, (select unnest(range(0, 3)) as k) group by r),
counted as (
  select base.r, doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
         len(lines) as n_lines, length(text) - length(replace(text, '!', '')) as n_bangs,
         len(list_filter(words, lambda w: list_contains([STOPS], lower(rtrim(w, '.,!?;:'))))) as n_stops
  from base left join covered on base.r = covered.r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or word_chars::double / greatest(n_words, 1) < 2.0
            or word_chars::double / greatest(n_words, 1) > 16.0 or n_symbols::double / greatest(n_words, 1) > 0.1
            or n_bangs::double / greatest(n_words, 1) > 0.2 or n_stops::double / greatest(n_words, 1) < 0.05
            or n_dup_lines::double / greatest(n_lines, 1) > 0.3) as kept
from counted
""".replace("STOPS", ", ".join(f"'{w}'" for w in quality.STOP_WORDS))

_MIX_SQL = """
with sized as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::bigint as size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')) || ':' || (row_number() over (partition by doc_id, coalesce(text, '')) - 1)::varchar), 1, 9))::bigint as draw
  from documents),
sources as (
  select source, sum(size)::bigint as source_size,
         [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, sum(size)::bigint * 3.0::double as most
  from sized group by source),
levelled as (
  select *, (sum(source_size::double) over () - coalesce(sum(most) over (o rows between unbounded preceding and 1 preceding), 0.0))
            / sum(weight) over (o rows between current row and unbounded following) as own,
         row_number() over o as k
  from sources window o as (order by most / weight, weight, source nulls last)),
level as (select arg_min(own, case when own * weight <= most then k else 1000000 + k end) as level from levelled),
plan as (
  select source, source_size, least(most, level * weight) as target,
         floor(least(most, level * weight) / greatest(source_size, 1)) as times
  from levelled, level),
sums as (
  select s.*, p.source_size, p.target, p.times, p.target - p.times * p.source_size as extra,
         sum(s.size) over (partition by s.source order by s.draw) as upto,
         sum(s.size) over (partition by s.source, s.draw) as tied
  from sized s join plan p on s.source is not distinct from p.source)
select doc_id, size, source_size, target,
       (size * least(times + case when upto <= extra or (upto - tied <= extra and upto + upto - tied <= 2 * extra) then 1 else 0 end, 3))::bigint as taken
from sums
"""

_NEAR_SQL = """
with recursive base as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
  from documents),
sets as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from base where len(w) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from common join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * c >= 75 * (x.n + y.n - c)),
ends as (select a, b from links union all select b, a from links),
reach as (select a as id, a as r from ends union select reach.id, ends.b from reach join ends on reach.r = ends.a),
least as (select id, min(r) as r from reach group by id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(r, d.doc_id) as component_id, coalesce(r, d.doc_id) = d.doc_id as kept
from documents d left join sizes on d.doc_id = sizes.doc_id left join least on d.doc_id = least.id
"""

def _draw_sql(path: str, weights: list[int]) -> str:
    if len(weights) == 1:
        return "0"
    digits = "('0x' || substr(md5('{}/{}:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint"
    draws = [f"-ln(({digits.format(path, child)} + 0.5::double) / {2**48}::double) / {weight}.0::double" for child, weight in enumerate(weights)]
    return f"list_transform([[{', '.join(draws)}]], lambda d: list_position(d, list_min(d)) - 1)[1]"


def _tree_sql(shards: int, region: int = sharding.REGION, rack: int = sharding.RACK) -> str:
    parts = [min(region, shards - at) for at in range(0, shards, region)]
    by_region = []
    for r, size in enumerate(parts):
        racks = [min(rack, size - at) for at in range(0, size, rack)]
        leaves = " ".join(f"when {k} then {r * region + k * rack} + {_draw_sql(f'{r}/{k}', [1] * n)}" for k, n in enumerate(racks))
        by_region.append(f"when {r} then case {_draw_sql(str(r), racks)} {leaves} end")
    return f"(case {_draw_sql('', parts)} {' '.join(by_region)} end)::int"


_SHARDS_SQL = f"""
with told as (
  select doc_id, (strlen(coalesce(text, '')) + 16)::bigint as size, {checksum_sql.crc("encode(coalesce(text, ''))")} as text_crc32
  from documents, {checksum_sql.crc_table(0xEDB88320)}),
rows as (select *, row_number() over (partition by doc_id, size, text_crc32) - 1 as copy from told),
placed as (
  select *, {_tree_sql(40)} as shard, {_tree_sql(41)} as grown_shard,
         substr(md5('slot:' || coalesce(doc_id::varchar, '') || ':' || size || ':' || text_crc32 || ':' || copy), 1, 2) as bucket
  from rows)
select doc_id, size, text_crc32, 'key' as law, shard, grown_shard,
       row_number() over (partition by shard order by bucket, doc_id nulls first, text_crc32, size, copy) - 1 as slot
from placed
"""

_LINES_SQL = f"""
with parted as (select doc_id, string_split(text, chr(10)) as parts from documents),
lines as (
  select doc_id, i, list_sort(list_distinct(list_filter(string_split_regex(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))) as s
  from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from parted)),
placed as (select doc_id, i, s, row_number() over (order by doc_id, i) as place from lines where len(s) > 0),
sets as (select s, len(s) as n, min(place) as k from placed group by s),
tokens as (select k, n, unnest(s) as w from sets),
counts as (select w, count(*) as c from tokens group by w),
ranked as (select k, n, w, row_number() over (partition by k order by c, w) as r from tokens join counts using (w)),
prefixes as (select k, n, w from ranked where r <= n - (3 * n + 3) // 4 + 1),
pairs as (
  select distinct a.k as a, b.k as b
  from prefixes a join prefixes b on a.w = b.w and a.k < b.k and 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
shared as (select b, x.n + y.n as n, len(list_intersect(x.s, y.s)) as o from pairs join sets x on x.k = a join sets y on y.k = b),
late as (select distinct b as k from shared where 4 * o >= 3 * (n - o)),
gone as (
  select doc_id, list(i) as removed
  from placed join sets on placed.s = sets.s left join late on late.k = sets.k where place <> sets.k or late.k is not null group by doc_id),
kept as (
  select parted.doc_id, coalesce(len(parts), 0) as n_lines, coalesce(len(removed), 0) as n_removed,
         case when removed is null then array_to_string(parts, chr(10))
              else array_to_string(list_transform(list_filter(range(1, len(parts) + 1), lambda i: not list_contains(removed, i)), lambda i: parts[i]), chr(10)) end as text
  from parted left join gone on parted.doc_id = gone.doc_id)
select doc_id, n_lines::bigint as n_lines, n_removed::bigint as n_removed, {checksum_sql.crc("encode(text)")} as text_crc32
from kept, {checksum_sql.crc_table(0xEDB88320)}
"""

_LONGEST_FIRST = sorted(urls.RULES, key=lambda r: len(r[1]), reverse=True)


def _rule_sql(what: int) -> str:
    fits = [(r, *r[1].partition("/")) for r in _LONGEST_FIRST]
    cases = " ".join(f"when (host = '{top}' or ends_with(host, '.{top}')) and starts_with(path, '{slash}{rest}') then '{r[what]}'" for r, top, slash, rest in fits)
    return f"case {cases} end"


def _order_sql(k: int) -> str:
    below = f"left join p{k - 1} b on substr(o.gram, 2) = b.gram" if k > 1 else ""
    pa, pr = ("coalesce(b.pa, 1 / 256::double)", "coalesce(b.pr, 1 / 256::double)") if k > 1 else ("1 / 256::double",) * 2
    s = f"{urls.SMOOTHING}::double"
    return f"""p{k} as (
  select o.gram, (o.a + {s} * {pa}) / (t.ta + {s}) as pa, (o.r + {s} * {pr}) / (t.tr + {s}) as pr
  from grams o join totals t on t.k = {k} and substr(o.gram, 1, {k - 1}) = t.context {below}
  where length(o.gram) = {k} and o.a + o.r >= {urls.MIN_COUNT})"""


_URLS_SQL = f"""
with parts as (
  select row_number() over () as row, page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
  from pages),
ruled as (select *, {_rule_sql(1)} as rule, {_rule_sql(0)} as action, host || lower(path) as address from parts),
addresses as (select address, action = 'allow' as good, count(*) as n from ruled group by all),
labelled as (select * from addresses where good is not null),
marked as (select address, '^' || address || '$' as m from (select distinct address from addresses)),
ends as (select address, m, unnest(range(2, length(m) + 1)) as stop from marked),
own as (select address, unnest([substr(m, stop - k + 1, k) for k in range(1, {urls.ORDER} + 1) if stop >= k]) as gram from ends),
grams as (
  select gram, sum(case when good then n else 0 end)::bigint as a, sum(case when good then 0 else n end)::bigint as r
  from own join labelled using (address) group by gram),
totals as (select length(gram) as k, substr(gram, 1, length(gram) - 1) as context, sum(a)::bigint as ta, sum(r)::bigint as tr from grams group by all),
{", ".join(_order_sql(k) for k in range(1, urls.ORDER + 1))},
model as ({" union all ".join(f"select gram, ln(pa / pr) as ratio from p{k}" for k in range(1, urls.ORDER + 1))}),
longest as (select address, substr(m, greatest(1, stop - {urls.ORDER - 1}), least(stop, {urls.ORDER})) as g from ends),
told as (
  select g, arg_max(ratio, length(gram)) as ratio
  from (select g, unnest([substr(g, length(g) - k + 1) for k in range(1, length(g) + 1)]) as gram from (select distinct g from longest)) join model using (gram) group by g),
scores as (select address, round(avg(coalesce(ratio, 0)), 9) as score from longest left join told using (g) group by address),
bins as (
  select greatest(-{urls.BINS}, least({urls.BINS}, floor(score * {urls.BINS} / 2)))::int as bin,
         sum(case when good then n else 0 end)::bigint as a, sum(case when good then 0 else n end)::bigint as r
  from labelled join scores using (address) group by bin),
rates as (
  select bin, sum(a) over () as good, sum(r) over () as bad,
         coalesce(sum(a) over (order by bin rows between unbounded preceding and 1 preceding), 0) as below_a,
         coalesce(sum(r) over (order by bin rows between unbounded preceding and 1 preceding), 0) as below_r
  from bins),
best as (
  select bin * 2 / {urls.BINS}::double as bound from rates where good > 0 and bad > 0
  order by (good - below_a)::double / good::double + below_r::double / bad::double desc, bin limit 1)
select page_id, host, path, rule,
       coalesce(action, case when score >= coalesce((select bound from best), 0) then 'allow' else 'block' end) as verdict, score
from ruled join scores using (address)
"""

QUERIES = {f.__name__: f for f in (op1_personal_data, op2_token_counts, op3_benchmark_leaks, op4_url_filter, op5_quality_rules, op6_near_duplicates, op7_language, op8_hash_tree_shards, op9_line_dedup, op10_source_mix)}
ORACLE = {"op4_url_filter": _URLS_SQL, "op5_quality_rules": _QUALITY_SQL, "op6_near_duplicates": _NEAR_SQL, "op8_hash_tree_shards": _SHARDS_SQL, "op9_line_dedup": _LINES_SQL, "op10_source_mix": _MIX_SQL}
