"""Operators on the fixtures of FIXTURES.md and on cases that tables don't hold."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keystrand.functions import checksums, text, varint
from keystrand.operators import bits, keyset, records, runs
from keystrand.streaming import keys


def column(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_empty_key_set(spark):
    none = spark.createDataFrame([], "word string")
    assert keyset.first(none).collect() == keyset.last(none).collect() == []
    for probe in ("1", "2", "9", "\xff"):
        assert keyset.seek(none, probe).collect() == []
    probes = spark.createDataFrame([("1",), ("9",)], "probe string")
    assert column(keyset.lower_bound(none, probes), "probe", "found") == [("1", None), ("9", None)]
    assert keyset.stats(none).first() == (0, 0)
    assert keyset.ordinals(none).collect() == []


def test_keys_in_byte_order(spark):
    words = ["b", "a", "ab", "", "ż", "𝄞", "～", "Z", "a"]
    built = keyset.build(spark.createDataFrame([(w,) for w in [*words, None]], "k string"), "k")
    told = sorted(set(words), key=str.encode)
    assert [r.word for r in keyset.scan(built).collect()] == told
    assert column(keyset.ordinals(built), "ord", "word") == list(enumerate(told))
    for probe in [*told, "aa", "c", "～～", "\U0010ffff"]:
        above = [w for w in told if w.encode() >= probe.encode()]
        assert [r.word for r in keyset.seek(built, probe).collect()] == above[:1]


def test_lower_bound_finds_every_stored_word(spark):
    words = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("word"))
    found = keyset.lower_bound(words, words.select(F.col("word").alias("probe")))
    assert found.count() == 5000 and found.filter("not probe <=> found").count() == 0


def test_few_zeros_among_many_ones(spark):
    """3,276,899 bits, 0 at 588939 to 588988, else 1."""
    sequence = spark.range(3_276_899).select(F.col("id").alias("pos"), (~F.col("id").between(588_939, 588_988)).cast("int").alias("bit"))
    assert column(bits.select(sequence, 0), "i", "pos") == [(i, 588_939 + i) for i in range(50)]
    at = F.col("pos").between(588_939, 588_990)
    told = [(588_939 + i, min(i, 50)) for i in range(52)]
    assert column(bits.rank(sequence, 0).filter(at), "pos", "rank") == told
    assert column(bits.run_before(sequence, 0).filter(at), "pos", "n") == [(p, 0 if p == 588_990 else n) for p, n in told]
    late = F.col("pos").between(3_276_799, 3_276_801)
    assert column(bits.run_from(sequence, 0).filter(late), "n") == [(0,)] * 3
    assert column(bits.is_one(sequence).filter(late), "is1") == [(True,)] * 3


@pytest.mark.parametrize("value", [0, 1])
def test_bit_runs_across_ranges(spark, value):
    rng = random.Random(1)
    told, sequence = {}, []
    while len(sequence) < 400:
        sequence += [rng.randint(0, 1)] * rng.randint(1, 90)
    for i in range(len(sequence)):
        before = after = 0
        while i - before > 0 and sequence[i - before - 1] == value:
            before += 1
        while i + after < len(sequence) and sequence[i + after] == value:
            after += 1
        told[3 * i] = (before, after)
    df = spark.createDataFrame([(3 * i, b) for i, b in enumerate(sequence)], "pos long, bit int")
    assert column(bits.run_before(df, value), "pos", "n") == sorted((p, x[0]) for p, x in told.items())
    assert column(bits.run_from(df, value), "pos", "n") == sorted((p, x[1]) for p, x in told.items())


@pytest.mark.parametrize("sign", [1, -1])
def test_runs_come_back(spark, sign):
    values = [5, 6, 7, 7, 6, 5, 4, 100, 101, 3]
    rows = spark.createDataFrame(list(enumerate(values)), "seq long, v long")
    coded = runs.encode(rows, ["seq"], "v", sign)
    back = [r.value for r in runs.expand(coded, sign).orderBy("run", "k").collect()]
    assert len(back) == len(values) and back == values


@pytest.mark.parametrize("least,width", [(0, 2), (1, 1), (3, 4), (0, 8)])
def test_units_come_back(spark, least, width):
    rng = random.Random(2)
    values, at = [], 0
    for _ in range(300):
        at += rng.choice([1, 2, 3, 4, 9, 500])
        values.append((at,))
    coded = runs.units(runs.differences(spark.createDataFrame(values, "v long"), "v"), least, width)
    assert all(0 <= r.unit < 1 << width for r in coded.collect())
    assert column(runs.undo_units(coded, least, width), "value", "decoded") == [(v, v) for (v,) in values]


def test_no_rows(spark):
    rows = spark.createDataFrame([], "seq long, v long, line string")
    assert runs.encode(rows, ["seq"], "v", 1).collect() == []
    assert runs.differences(rows, "v").collect() == []
    assert runs.sorted_runs(rows, "seq", "line").collect() == []
    sequence = spark.createDataFrame([], "pos long, bit int")
    for f in (bits.rank, bits.select, bits.run_before, bits.run_from):
        assert f(sequence, 0).collect() == []


def test_sorted_runs_in_files(spark, tmp_path):
    lines = ["a", "b", "b", "a", "c", "", "z"]
    rows = spark.createDataFrame(list(enumerate(lines)), "seq long, line string")
    assert [r.run for r in runs.sorted_runs(rows, "seq", "line").orderBy("seq").collect()] == [0, 0, 0, 1, 1, 2, 2]
    runs.write_sorted_runs(rows, "seq", "line", f"{tmp_path}/runs")
    found = {}
    for part in sorted(tmp_path.glob("runs/run=*/*.txt")):
        found.setdefault(part.parent.name, []).extend(part.read_text().splitlines())
    assert list(found.values()) == [["a", "b", "b"], ["a", "c"], ["", "z"]]


def test_records_in_a_new_order(spark):
    rows = spark.createDataFrame([(3, "b", "x"), (1, "b", "y"), (2, "a", "z")], "id long, g string, body string")
    assert column(records.reordered(rows, ["g", "id"], "id"), "new_id", "id", "body") == [(0, 2, "z"), (1, 1, "y"), (2, 3, "x")]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=20))
def test_varints_come_back(spark, numbers):
    rows = spark.createDataFrame([(n,) for n in numbers], "n long")
    coded = rows.select("n", varint.encode_varint("n").alias("c"))
    for r in coded.select("n", "c", varint.decode_varint("c").alias("d")).collect():
        assert r.d == r.n and len(r.c) == max(1, -(-(r.n % 2**64).bit_length() // 7))


def test_varints_of_nothing(spark):
    row = spark.sql("select cast(null as long) n, cast('' as binary) b").select(varint.encode_varint("n"), varint.decode_varint("b"), varint.decode_varint(F.lit(None).cast("binary"))).first()
    assert tuple(row) == (None, 0, None)


def test_aligned_integers(spark):
    numbers = [0, 1, 63, 64, 65, 2**53, 2**53 + 1, 2**62 + 1, -1, -64, -65]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", text.aligned(F.col("n")).alias("a"), text.aligned(F.col("n"), 1).alias("b"))
    assert [(r.a, r.b) for r in rows.collect()] == [(-(-n // 64) * 64, n) for n in numbers]


def test_samples_of_any_ids(spark):
    rows = spark.range(-50_000, 50_000).unionByName(spark.createDataFrame([(2**63 - 1,), (-(2**63),)], "id long"))
    found = {r.id for r in records.sample(rows, "id", 45).collect()}
    assert {i for i in range(-50_000, 50_000) if i * 7919 % 1000 < 45} == found - {2**63 - 1, -(2**63)}


def test_bytes_through_a_table(spark):
    table = bytes((i * 7 + 3) % 256 for i in range(256))
    rows = spark.createDataFrame([(bytearray(range(256)),), (bytearray(),), (None,)], "b binary")
    found = [r[0] for r in rows.select(text.translated_bytes(F.col("b"), table)).collect()]
    assert [x if x is None else bytes(x) for x in found] == [bytes(range(256)).translate(table), b"", None]


def test_suffixes_of_long_texts(spark):
    texts = ["banana", "", "a" * 3000, "żó👍żó", "ab" * 500 + "a"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    found = {}
    for r in records.suffix_array(rows, "t").collect():
        found.setdefault(r.t, []).append((r.rank, r.at))
    assert found == {t: [(k, at) for k, at in enumerate(sorted(range(len(t)), key=lambda i: t[i:]))] for t in texts if t}


def test_hash_of_pieces(spark):
    import xxhash

    rows = spark.createDataFrame([([bytearray(b"ab"), None, bytearray(b"c" * 100)],), ([],), (None,)], "p array<binary>")
    told = [xxhash.xxh64_intdigest(b"ab" + b"c" * 100, 9), xxhash.xxh64_intdigest(b"", 9), None]
    found = [r[0] for r in rows.select(checksums.xxh64_of_pieces(F.col("p"), 9)).collect()]
    assert [x if x is None else x % 2**64 for x in found] == told


def test_checksums_of_every_row(spark):
    """The queries without SQL, row by row, against other implementations."""
    import xxhash

    from keystrand.plans import catalogue

    def crc(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r.doc_id: (r.seed42 % 2**64, r.seed0 % 2**64) for r in catalogue.QUERIES["xxh64"](spark, sf_dir).collect()}
    assert found == {d: (xxhash.xxh64_intdigest(t, 42), xxhash.xxh64_intdigest(t, 0)) for d, t in texts.items()}
    crcs = {r.doc_id: r.crc for r in catalogue.QUERIES["crc32c"](spark, sf_dir).collect()}
    assert len(crcs) == len(texts) and all(crcs[d] == crc(texts[d]) for d in list(texts)[:60])


def test_verified_values(spark):
    row = spark.sql("select 'v' v, 1L a, 2L b")
    assert row.select(checksums.verified(F.col("v"), F.col("a"), F.col("a"), "m")).first()[0] == "v"
    with pytest.raises(Exception, match="Old = "):
        row.select(checksums.verified(F.col("v"), F.col("a"), F.col("b"), "m")).collect()


def test_hex_digits_that_are_none(spark):
    rows = spark.createDataFrame([("0aF",), ("zz",)], "h string")
    assert [r[0] if r[0] is None else bytes(r[0]) for r in rows.select(text.decoded_hex(F.col("h"), strict=False)).collect()] == [b"\x0a", None]
    with pytest.raises(Exception, match="not hexadecimal"):
        rows.select(text.decoded_hex(F.col("h"))).collect()


def test_checksums_of_known_values(spark):
    """The published check values of CRC-32C and XXH64."""
    rows = spark.createDataFrame([("123456789",), ("",), (None,)], "t string")
    found = [tuple(r) for r in rows.select(checksums.crc32c(F.col("t").cast("binary")), checksums.xxh64(F.col("t"), 0)).collect()]
    assert found[0][0] == 0xE3069283 and found[1] == (0, 0xEF46DB3751D8E999 - 2**64)
    assert found[2][0] is None


def test_pairs_of_lines(spark):
    from keystrand.sources import files

    lines = spark.createDataFrame([("k\tv",), ("no tab",), ("",), ("a\tb\tc",), ("\tv",)], "line string")
    assert column(files.pairs_of_lines(lines), "key", "value") == [("", "v"), ("a", "b\tc"), ("k", "v"), ("no tab", "")]


def test_text_functions(spark):
    one = spark.createDataFrame([("ab\n",)], "t string")
    assert one.select(text.chomped(F.col("t")).alias("x")).first().x == "ab"
    assert bytes(one.select(text.framed(F.col("t").cast("binary")).alias("x")).first().x) == b"\x07\0\0\0ab\n"


def test_words_of_a_stream(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType().add("ts", "timestamp").add("line", "string")
    rows = spark.createDataFrame([("2026-01-01 00:00:00", "a b a"), ("2026-01-01 00:00:01", "b c ")], "ts string, line string")
    rows.select(F.col("ts").cast("timestamp"), "line").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = keys.new_words(stream, "line", "ts").writeStream.format("memory").queryName("new_words").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert column(spark.table("new_words"), "word") == [("a",), ("b",), ("c",)]
