"""DuckDB SQL for check sums that it lacks, written out in full with no macro, so that one statement holds it."""

from __future__ import annotations

from functools import reduce

#: The five primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
WRAP = f"{1 << 64}::uhugeint"


def crc_table(polynomial: int) -> str:
    """A query of one row, ``crc_table``: what each byte adds to a reversed CRC of 32 bits."""
    entry = reduce(lambda x, _: f"list_transform([{x}], lambda c: xor(c >> 1, (c & 1) * {polynomial}))[1]", range(8), "b")
    return f"(select list({entry} order by b) as crc_table from (select range as b from range(256)))"


def crc(data: str) -> str:
    """The CRC of a BLOB as BIGINT, a byte at a time; stands where ``crc_table`` is a column."""
    numbers = f"list_transform(regexp_extract_all(hex({data}), '..'), lambda h: ('0x' || h)::bigint)"
    return f"xor(list_reduce({numbers}, lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295)"


def _times(x: str, y: str | int) -> str:
    return f"((({x})::uhugeint * ({y})::uhugeint) % {WRAP})"


def _plus(*xs: str | int) -> str:
    return f"(({' + '.join(f'({x})::uhugeint' for x in xs)}) % {WRAP})"


def _turned(x: str, by: int) -> str:
    return f"list_transform([{x}], lambda v: (v * {1 << by}::uhugeint) % {WRAP} + v // {1 << (64 - by)}::uhugeint)[1]"


def _round(acc: str, lane: str) -> str:
    return _times(_turned(_plus(acc, _times(lane, P2)), 31), P1)


def _little(h: str, size: int) -> str:
    """The number whose bytes ``h`` writes in hex, the least first."""
    return "('0x' || " + " || ".join(f"substr({h}, {2 * k - 1}, 2)" for k in range(size, 0, -1)) + ")::uhugeint"


def xxh64(rows: str, key: str, data: str, seed: int) -> str:
    """A query of (``key``, ``hash``): XXH64 of the BLOB ``data`` of ``rows`` as a signed integer; null stays null."""
    starts = [(seed + P1 + P2) % (1 << 64), (seed + P2) % (1 << 64), seed, (seed - P1) % (1 << 64)]
    lanes = ", ".join(f"list_reduce(lanes[{k + 1}:n // 32 * 4:4], lambda a, x: {_round('a', 'x')}, {start}::uhugeint) as a{k}" for k, start in enumerate(starts))
    joined = _plus(*(_turned(f"a{k}", by) for k, by in enumerate((1, 7, 12, 18))))
    merged = f"list_reduce([a0, a1, a2, a3], lambda h, a: {_plus(_times(f'xor(h, {_round("0", "a")})', P1), P4)}, {joined})"
    by_eight = _plus(_times(_turned(f"xor(h, {_round('0', 'x')})", 27), P1), P4)
    by_four = _plus(_times(_turned(f"xor(h, {_times(_little('tail[1:8]', 4), P1)})", 23), P2), P3)
    by_one = _times(_turned(f"xor(h, {_times('x', P5)})", 11), P1)
    last = "list_transform(regexp_extract_all(case when length(tail) >= 8 then tail[9:] else tail end, '..'), lambda x: ('0x' || x)::uhugeint)"
    mixed = "h"
    for by, prime in ((33, P2), (29, P3), (32, 1)):
        mixed = _times(f"list_transform([{mixed}], lambda v: xor(v, v // {1 << by}::uhugeint))[1]", prime)
    return f"""
(with hexed as (select {key}, octet_length({data}) as n, hex({data}) as digits from {rows}),
laned as (select {key}, n, list_transform(regexp_extract_all(digits, '.{{16}}'), lambda x: {_little('x', 8)}) as lanes, digits[n // 8 * 16 + 1:] as tail from hexed),
striped as (select {key}, n, lanes, tail, {lanes} from laned),
begun as (select {key}, n, lanes, tail, {_plus(f"case when n >= 32 then {merged} else {(seed + P5) % (1 << 64)}::uhugeint end", "n")} as h from striped),
eights as (select {key}, tail, list_reduce(lanes[n // 32 * 4 + 1:], lambda h, x: {by_eight}, h) as h from begun),
fours as (select {key}, tail, case when length(tail) >= 8 then {by_four} else h end as h from eights),
ones as (select {key}, list_reduce({last}, lambda h, x: {by_one}, h) as h from fours),
ended as (select {key}, {mixed} as h from ones)
select {key}, (case when h >= {1 << 63}::uhugeint then h::hugeint - {1 << 64}::hugeint else h::hugeint end)::bigint as hash from ended)
"""
