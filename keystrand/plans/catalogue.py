"""The library's queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrand.functions import checksums, text, varint
from keystrand.operators import bits, keyset, records, runs
from keystrand.plans import checksum_sql
from keystrand.sources import files

QUERIES = {}
ORACLE = {}

_NAMES_SQL = "(select distinct p_name as word from part where p_name is not null)"
_BITS_SQL = "(select o_orderkey as pos, (o_orderstatus <> 'F')::int as bit from orders)"
_WORDS_SQL = "(select distinct w as word from (select unnest(regexp_split_to_array(text, '[ \\n]')) as w from documents) where w <> '')"
_BLOBS_SQL = "(select doc_id, encode(text) as data from documents)"
_XXH64_SQL = f"""
select a.doc_id, coalesce(a.hash, 42) as seed42, b.hash as seed0
from {checksum_sql.xxh64(_BLOBS_SQL, "doc_id", "data", 42)} a join {checksum_sql.xxh64(_BLOBS_SQL, "doc_id", "data", 0)} b on a.doc_id = b.doc_id
"""
_CRC32C_SQL = f"select doc_id, {checksum_sql.crc('data')} as crc from {_BLOBS_SQL}, {checksum_sql.crc_table(checksums.CASTAGNOLI)}"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(spark, sf_dir):
    return keyset.build(_table(spark, sf_dir, "part"), "p_name")


def _bits(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_orderstatus") != "F").cast("int").alias("bit"))


# key sets


@_query(f"select word from {_WORDS_SQL} order by word")
def keyset_dump(spark, sf_dir):
    return keyset.scan(keyset.words(_table(spark, sf_dir, "documents"), "text"))


@_query(f"select count(*) as n_keys, sum(strlen(word))::bigint as key_bytes from {_WORDS_SQL}")
def keyset_stats(spark, sf_dir):
    return keyset.stats(keyset.words(_table(spark, sf_dir, "documents"), "text"))


@_query(f"select word, row_number() over (order by word) - 1 as ord from {_WORDS_SQL}")
def keyset_ordinals(spark, sf_dir):
    return keyset.ordinals(keyset.words(_table(spark, sf_dir, "documents"), "text"))


@_query(f"with probes as (select distinct substr(p_name, 1, 3) || s as probe from part, (values (''), ('zz')) t(s)) select probe, (select min(word) from {_NAMES_SQL} where word >= probe) as found from probes")
def keyset_lower_bound(spark, sf_dir):
    heads = _table(spark, sf_dir, "part").select(F.substring("p_name", 1, 3).alias("head"))
    probes = heads.select(F.explode(F.array(F.col("head"), F.concat("head", F.lit("zz")))).alias("probe")).distinct()
    return keyset.lower_bound(_names(spark, sf_dir), probes)


@_query(f"select min(word) as word from {_NAMES_SQL}")
def keyset_first(spark, sf_dir):
    return keyset.first(_names(spark, sf_dir))


@_query(f"select max(word) as word from {_NAMES_SQL}")
def keyset_last(spark, sf_dir):
    return keyset.last(_names(spark, sf_dir))


@_query("select o_orderkey::varchar as word from orders where o_orderkey::varchar >= '5' order by word limit 1")
def keyset_seek(spark, sf_dir):
    return keyset.seek(keyset.build(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k")), "k"), "5")


@_query(f"select word from {_NAMES_SQL} where starts_with(word, 's')")
def keyset_prefix(spark, sf_dir):
    return keyset.with_prefix(_names(spark, sf_dir), "s")


@_query("select c_custkey as word from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def keyset_member(spark, sf_dir):
    keys = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("word"))
    return keyset.members(keys, _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("word")))


@_query("select doc_id as word from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def keyset_missing(spark, sf_dir):
    keys = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("word"))
    return keyset.missing(keys, _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("word")))


@_query("select word from (select p_name as word from part) where word is null")
def keyset_empty_first(spark, sf_dir):
    return keyset.first(_names(spark, sf_dir).filter("word is null"))


# bit sequences


def _bit_query(name, f, value, sql):
    def run(spark, sf_dir):
        return f(_bits(spark, sf_dir), value)

    run.__name__ = name
    _query(sql)(run)


for _value, _word in ((0, "0"), (1, "1")):
    _same = f"(bit = {_value})::int"
    _other = f"(bit <> {_value})::int"
    _bit_query(f"bits_rank{_word}", bits.rank, _value, f"select pos, coalesce(sum({_same}) over (order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as rank from {_BITS_SQL}")
    _bit_query(f"bits_select{_word}", bits.select, _value, f"select row_number() over (order by pos) - 1 as i, pos from {_BITS_SQL} where bit = {_value}")
    _bit_query(f"bits_run_before{_word}", bits.run_before, _value, f"select pos, coalesce(sum({_same}) over (partition by g order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as n from (select *, coalesce(sum({_other}) over (order by pos rows between unbounded preceding and 1 preceding), 0) as g from {_BITS_SQL})")
    _bit_query(f"bits_run_from{_word}", bits.run_from, _value, f"select pos, sum({_same}) over (partition by g order by pos rows between current row and unbounded following)::bigint as n from (select *, sum({_other}) over (order by pos) - case when bit <> {_value} then 0.5 else 0 end as g from {_BITS_SQL})")


@_query(f"select pos, bit = 1 as is1 from {_BITS_SQL}")
def bits_is1(spark, sf_dir):
    return bits.is_one(_bits(spark, sf_dir))


# runs and deltas


def _runs_sql(order, value, sign, base):
    return f"""with stepped as (select {value} as v, row_number() over (order by {order}) as i, lag({value}) over (order by {order}) as p from orders),
numbered as (select v, sum(case when p is null or v <> p + ({sign}) then 1 else 0 end) over (order by i) as r from stepped)
select (r - 1)::bigint as run, {base}(v)::bigint as base, count(*) as len from numbered group by r"""


@_query(_runs_sql("o_orderstatus, o_orderkey", "o_orderkey", 1, "min"))
def runs_asc(spark, sf_dir):
    return runs.encode(_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderkey"], "o_orderkey", 1)


@_query(_runs_sql("o_orderkey", "o_custkey", -1, "max"))
def runs_desc(spark, sf_dir):
    return runs.encode(_table(spark, sf_dir, "orders"), ["o_orderkey"], "o_custkey", -1)


@_query(f"select run, k, base + k as value from (select run, base, unnest(range(len)) as k from ({_runs_sql('o_orderstatus, o_orderkey', 'o_orderkey', 1, 'min')}))")
def runs_expand(spark, sf_dir):
    return runs.expand(runs_asc(spark, sf_dir), 1)


@_query(f"select count(*) as n_runs, sum(len)::bigint as n_values, sum(5 + case when len > 1 then ceil(length(bin(len)) / 7.0) else 0 end)::bigint as n_bytes from ({_runs_sql('o_orderstatus, o_orderkey', 'o_orderkey', 1, 'min')})")
def runs_bytes(spark, sf_dir):
    return runs.encoded_bytes(runs_asc(spark, sf_dir))


_DIFFS_SQL = "(select o_orderkey as value, o_orderkey - coalesce(lag(o_orderkey) over (order by o_orderkey), 0) as diff from orders)"


@_query(f"select value, diff from {_DIFFS_SQL}")
def delta_encode(spark, sf_dir):
    return runs.differences(_table(spark, sf_dir, "orders"), "o_orderkey")


@_query("select o_orderkey as value, o_orderkey as decoded from orders")
def delta_decode(spark, sf_dir):
    return runs.undo_differences(runs.differences(_table(spark, sf_dir, "orders"), "o_orderkey"), "value")


@_query(f"select value, case when diff between 1 and 3 then diff else 0 end as unit, case when diff between 1 and 3 then null else diff end as large from {_DIFFS_SQL}")
def delta_units(spark, sf_dir):
    return runs.units(runs.differences(_table(spark, sf_dir, "orders"), "o_orderkey"), 0, 2)


@_query("select o_orderkey as value, o_orderkey as decoded from orders")
def delta_units_decode(spark, sf_dir):
    return runs.undo_units(runs.units(runs.differences(_table(spark, sf_dir, "orders"), "o_orderkey"), 1, 1), 1, 1)


@_query("select doc_id, coalesce(sum(b) over (order by doc_id), 0)::bigint as run from (select doc_id, (lag(text) over (order by doc_id) > text)::int as b from documents)")
def sorted_runs(spark, sf_dir):
    return runs.sorted_runs(_table(spark, sf_dir, "documents"), "doc_id", "text")


# encodings and strings


def _lines(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit("\t"), "c_mktsegment").alias("line"))


@_query("select substr(line, 1, instr(line, chr(9)) - 1) as key, substr(line, instr(line, chr(9)) + 1) as value from (select c_name || chr(9) || c_mktsegment as line from customer)")
def kv_split(spark, sf_dir):
    return files.pairs_of_lines(_lines(spark, sf_dir))


def _le(n):
    h = f"printf('%08X', {n})"
    return " || ".join(f"substr({h}, {at}, 2)" for at in (7, 5, 3, 1))


@_query(f"select {_le('strlen(c_name)')} || {_le('strlen(c_mktsegment)')} || hex(c_name) || hex(c_mktsegment) as packed from customer")
def kv_pack(spark, sf_dir):
    return files.pairs_of_lines(_lines(spark, sf_dir)).select(F.hex(text.packed_pair(F.col("key"), F.col("value"))).alias("packed"))


@_query("select p_partkey, hex(p_name) as hex from part")
def hex_encode(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.hex("p_name").alias("hex"))


@_query("select p_partkey, p_name as decoded from part")
def hex_decode(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", text.decoded_hex(F.hex("p_name")).cast("string").alias("decoded"))


@_query(f"select p_partkey, {_le('strlen(p_name) + 4')} || hex(p_name) as frame from part")
def hex_frame(spark, sf_dir):
    digits = F.concat(F.hex("p_name"), F.lit("A"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.hex(text.framed(text.decoded_hex(digits))).alias("frame"))


@_query("select p_partkey, reverse(p_name) as reversed from part")
def reverse_bytes(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", text.reversed_bytes(F.col("p_name")).cast("string").alias("reversed"))


@_query("select n_name || '/' || r_name as joined from nation join region on n_regionkey = r_regionkey")
def concat_strings(spark, sf_dir):
    both = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(text.joined(F.col("n_name"), F.lit("/"), F.col("r_name")).alias("joined"))


@_query("select p_partkey, translate(p_name, 'aeiou', 'AEIOU') as translated from part")
def translate_bytes(spark, sf_dir):
    table = bytes(i - 32 if chr(i) in "aeiou" else i for i in range(256))
    return _table(spark, sf_dir, "part").select("p_partkey", text.translated_bytes(F.col("p_name"), table).cast("string").alias("translated"))


@_query("select c_custkey, c_name as line, length(c_name)::int as len from customer")
def chomp_lines(spark, sf_dir):
    lines = _table(spark, sf_dir, "customer").select("c_custkey", text.chomped(F.concat("c_name", F.lit("\n"))).alias("line"))
    return lines.withColumn("len", F.length("line"))


@_query("select o_orderkey, ((o_orderkey + 63) // 64 * 64)::bigint as aligned from orders")
def align_to_64(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.aligned(F.col("o_orderkey")).cast("long").alias("aligned"))


@_query("select o_orderkey, ceil(length(bin(o_orderkey)) / 7.0)::int as n_bytes, o_orderkey as decoded from orders")
def varint_roundtrip(spark, sf_dir):
    coded = _table(spark, sf_dir, "orders").select("o_orderkey", varint.encode_varint("o_orderkey").alias("coded"))
    return coded.select("o_orderkey", F.octet_length("coded").alias("n_bytes"), varint.decode_varint("coded").alias("decoded"))


# record stores


@_query("select row_number() over (order by value) - 1 as code, value from (select distinct l_returnflag || l_linestatus as value from lineitem)")
def dict_build(spark, sf_dir):
    return records.dictionary(_table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("v")), "v")


@_query("select event_id, event_type from events")
def dict_roundtrip(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", "event_type")
    codes = records.dictionary(rows, "event_type")
    return records.decoded(records.encoded(rows, "event_type", codes), "event_type", codes)


@_query("select doc_id, strlen(text)::int as n_bytes from documents where doc_id in (select doc_id from labels)")
def record_get(spark, sf_dir):
    found = records.get(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), "doc_id")
    return found.select("doc_id", F.octet_length("text").alias("n_bytes"))


@_query("select row_number() over (order by source, doc_id) - 1 as new_id, doc_id, strlen(text)::int as n_bytes from documents")
def record_reorder(spark, sf_dir):
    found = records.reordered(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["source", "doc_id"], "doc_id")
    return found.select("new_id", "doc_id", F.octet_length("text").alias("n_bytes"))


@_query("select lang, count(*) as n_records, sum(strlen(text))::bigint as n_bytes from documents group by lang")
def store_sizes(spark, sf_dir):
    return records.sizes(_table(spark, sf_dir, "documents"), "lang", "text")


@_query("select p_name, case when strlen(p_name) = (select strlen(p_name) as l from part group by l order by count(*) desc, l limit 1) then 'fixed' else 'variable' end as route from part")
def mixed_len_route(spark, sf_dir):
    return records.fixed_or_variable(_table(spark, sf_dir, "part").select("p_name"), "p_name")


@_query("with c as (select c, count(*) as n from (select unnest(string_split(p_name, '')) as c from part) where c <> '' group by c) select count(*) as n_symbols, round(-sum(n / t * log2(n / t)), 6) as bits from c, (select sum(n) as t from c)")
def char_entropy(spark, sf_dir):
    return records.entropy(_table(spark, sf_dir, "part"), "p_name")


@_query("with c as (select c, count(*) as n from (select substr(h, i, 2) as c from (select h, unnest(range(1, length(h), 2)) as i from (select hex(encode(text)) as h from benchmark))) group by c) select count(*) as n_symbols, round(-sum(n / t * log2(n / t)), 6) as bits from c, (select sum(n) as t from c)")
def byte_entropy(spark, sf_dir):
    return records.byte_entropy(_table(spark, sf_dir, "benchmark"), "text")


@_query(f"select word, row_number() over (partition by word order by substr(word, p)) - 1 as rank, (p - 1)::bigint as at from (select word, unnest(range(1, length(word) + 1)) as p from {_NAMES_SQL})")
def suffix_array(spark, sf_dir):
    return records.suffix_array(_names(spark, sf_dir), "word")


@_query("select doc_id from documents where (doc_id % 1000 + 1000) % 1000 * 7919 % 1000 < 45")
def sample_dict(spark, sf_dir):
    return records.sample(_table(spark, sf_dir, "documents"), "doc_id", 45)


@_query("select count(*) as n_records, sum(strlen(text))::bigint as n_bytes from documents")
def count_bytes(spark, sf_dir):
    return files.count_bytes(_table(spark, sf_dir, "documents"), "text")


@_query("select l_orderkey, l_linenumber, l_shipdate from lineitem order by l_shipdate, l_orderkey, l_linenumber")
def parallel_sort(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").orderBy("l_shipdate", "l_orderkey", "l_linenumber")


# checksums


@_query(_XXH64_SQL)
def xxh64(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", checksums.xxh64(F.col("text")).alias("seed42"), checksums.xxh64(F.col("text"), 0).alias("seed0"))


@_query(_CRC32C_SQL)
def crc32c(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", checksums.crc32c(F.col("text").cast("binary")).alias("crc"))


@_query("select item_id, md5(text) as old, md5(case when item_id % 7 = 0 then text || '!' else text end) as new from benchmark where item_id % 7 = 0")
def checksum_verify(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark")
    changed = F.when(F.col("item_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return checksums.mismatches(rows, "item_id", F.md5("text"), F.md5(changed))
