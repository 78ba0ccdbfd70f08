"""Sources and sinks: round trips, cut files, and commands."""

from __future__ import annotations

import struct

import pytest

from keystrand.sources import files


@pytest.mark.parametrize("endian", ["little", "big"])
def test_kvbin_comes_back(spark, tmp_path, endian):
    files.register(spark)
    rows = [(b"k", b"v"), (b"", b""), (b"\0\xff", "zażółć".encode()), (b"k", b"v")]
    df = spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in rows], "key binary, value binary").repartition(2)
    df.write.format("kvbin").option("endian", endian).mode("append").save(f"{tmp_path}/kv")
    back = spark.read.format("kvbin").option("endian", endian).load(f"{tmp_path}/kv").collect()
    assert sorted((bytes(r.key), bytes(r.value)) for r in back) == sorted(rows)


def test_cut_kvbin_is_an_error(spark, tmp_path):
    files.register(spark)
    (tmp_path / "cut").write_bytes(struct.pack("<ii", 3, 3) + b"abc")
    with pytest.raises(Exception, match="cut short"):
        spark.read.format("kvbin").load(str(tmp_path / "cut")).collect()


def test_strseq(spark, tmp_path):
    files.register(spark)
    (tmp_path / "seq").write_bytes(b"\x01a\x00\x80\x01" + b"b" * 128)
    found = spark.read.format("strseq").load(str(tmp_path / "seq")).collect()
    assert [bytes(r[0]) for r in found] == [b"a", b"", b"b" * 128]


@pytest.mark.parametrize("body", [b"\x05ab", b"\x01a\x80", b"\x80"])
def test_cut_strseq_is_an_error(spark, tmp_path, body):
    files.register(spark)
    (tmp_path / "seq").write_bytes(body)
    with pytest.raises(Exception, match="cut short"):
        spark.read.format("strseq").load(str(tmp_path / "seq")).collect()


def test_lengths_below_zero_are_an_error(spark, tmp_path):
    files.register(spark)
    (tmp_path / "kv").write_bytes(struct.pack("<ii", -1, 3) + b"abc")
    with pytest.raises(Exception, match="below 0"):
        spark.read.format("kvbin").load(str(tmp_path / "kv")).collect()


def test_strseq_comes_back(spark, tmp_path):
    files.register(spark)
    rows = [b"", b"a", b"\0\xff" * 9000, b"x" * 127, b"x" * 128]
    spark.createDataFrame([(bytearray(r),) for r in rows], "data binary").repartition(2).write.format("strseq").mode("append").save(f"{tmp_path}/seq")
    assert sorted(bytes(r[0]) for r in spark.read.format("strseq").load(f"{tmp_path}/seq").collect()) == sorted(rows)


@pytest.mark.parametrize("kind", ["kvbin", "strseq"])
def test_appending_and_overwriting(spark, tmp_path, kind):
    files.register(spark)
    fields = "key binary, value binary" if kind == "kvbin" else "data binary"
    put = lambda names, mode, parts: spark.createDataFrame([tuple([bytearray(n)] * (1 + (kind == "kvbin"))) for n in names], fields).repartition(parts).write.format(kind).mode(mode).save(f"{tmp_path}/t")
    held = lambda: sorted(bytes(r[0]) for r in spark.read.format(kind).load(f"{tmp_path}/t").collect())
    put([b"a", b"b", b"c"], "append", 3)
    put([b"d"], "append", 1)
    assert held() == [b"a", b"b", b"c", b"d"]
    put([b"z"], "overwrite", 1)
    assert held() == [b"z"]


@pytest.mark.parametrize("kind", ["kvbin", "strseq"])
def test_files_are_closed_at_a_size(spark, tmp_path, kind):
    files.register(spark)
    fields = "key binary, value binary" if kind == "kvbin" else "data binary"
    names = [b"%03d" % i for i in range(50)]
    rows = spark.createDataFrame([tuple([bytearray(n)] * (1 + (kind == "kvbin"))) for n in names], fields).coalesce(1)
    rows.write.format(kind).option("maxFileBytes", "40").mode("append").save(f"{tmp_path}/t")
    written = [p for p in (tmp_path / "t").iterdir() if not p.name.startswith("_")]
    assert len(written) > 4 and all(p.stat().st_size < 60 for p in written)
    back = spark.read.format(kind).load(f"{tmp_path}/t")
    assert back.rdd.getNumPartitions() == len(written)
    assert sorted(bytes(r[0]) for r in back.collect()) == names


def test_lines_and_whole_files(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"a\r\nb\n\nc")
    assert [r.line for r in files.read_lines(spark, str(tmp_path / "t.txt")).collect()] == ["a\r", "b", "", "c"]
    assert [r.line for r in files.read_whole(spark, str(tmp_path / "t.txt")).collect()] == ["a\r\nb\n\nc"]


def test_commands(spark):
    one = spark.createDataFrame([("bb",)], "line string").coalesce(1)
    with pytest.raises(PermissionError):
        files.through_command(one, "cat")
    assert [r.line for r in files.through_command(one, "cat", allowed=True).collect()] == ["bb"]
    assert [r.line for r in files.through_command(one, "sh -c 'echo aa; cat'", allowed=True).collect()] == ["aa", "bb"]
    with pytest.raises(Exception):
        files.through_command(one, "no-such-command-here", allowed=True).collect()
