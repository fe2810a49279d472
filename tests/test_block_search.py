"""The search that tests pairs of blocks."""

import random

import pytest

from nearkin.operators import rangejoin


def differ(a, b):
    return sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True))


def some_hashes(rng, n):
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    out = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(n // 2)] + [(0, 0), ((1 << 64) - 1,) * 2]
    while len(out) < n:
        hi, lo = rng.choice(out)
        out.append((hi ^ rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64), lo ^ 1 << rng.randrange(64)))
    return [(signed(hi), signed(lo)) for hi, lo in out]


@pytest.mark.parametrize("least", [4096, 7, 1])
def test_blocks_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(rangejoin, "BLOCK_LEAST", least)
    rng = random.Random(least)
    a, b = some_hashes(rng, 120), some_hashes(rng, 60)
    b += a[:20]
    make = lambda rows: spark.createDataFrame([*rows, *rows[:9], (None, 1), (None, None)], "hi long, lo long")
    for within in (0, 9, 34):
        for q, s in ((a, b), (b, a), (a, a)):
            want = sorted((*x, *y, differ(x, y)) for x in set(q) for y in set(s) if differ(x, y) <= within)
            got = rangejoin.find_within(make(q), None if q is s else make(s), within, "blocks")
            assert sorted(map(tuple, got.collect())) == want
    none = make([])
    for q, s in ((none, make(a)), (make(a), none), (none, None)):
        assert rangejoin.find_within(q, s, 34, "blocks").count() == 0


def test_many_hashes_within_34_bits_are_not_sent_once_for_each_probe(spark, monkeypatch):
    monkeypatch.setattr(rangejoin, "NESTED_PAIRS", 0)  # as if there were more
    rows = spark.createDataFrame(some_hashes(random.Random(5), 200), "hi long, lo long").selectExpr("row_number() over (order by hi, lo) as id", "hi", "lo")
    found = rangejoin.similar_classes(rows, 34)
    plan = found._jdf.queryExecution().toString()
    assert "mask" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rangejoin.similar_classes(rows, 34, way="nested").collect()))
