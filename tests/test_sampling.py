"""The seeded sample against the generator run number by number, on any partitioning; ranks against sorting."""

import itertools

import pytest
from pyspark.sql import functions as F

from lonja.operators import sampling
from lonja.operators.ranks import ranked


def _generator(seed):
    state = seed
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = (state ^ state >> 15) * (1 | state) & 0xFFFFFFFF
        t = (t + (t ^ t >> 7) * (61 | t)) & 0xFFFFFFFF ^ t
        yield ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296


def test_draws(spark):
    got = [r["x"] for r in spark.range(1, 300).select("id", sampling.draw(F.col("id"), 7).alias("x")).orderBy("id").collect()]
    assert got == list(itertools.islice(_generator(7), 299))


@pytest.mark.parametrize("parts", [1, 7])
def test_sample_equals_splicing(spark, parts):
    sizes = {None: 4, "a": 1, "b": 500, "c": 10, "d": 11, "e": 3}
    rows = [(f, 1000 * i + 3 * k, "extra") for i, (f, n) in enumerate(sizes.items()) for k in range(n)]
    want, rand = [], _generator(42)
    for f in sizes:
        pool = sorted(r for g, r, _ in rows if g == f)
        for k in range(min(10, len(pool))):
            want.append((f, pool.pop(int(next(rand) * len(pool))), k + 1))
    t = spark.createDataFrame(rows, "file string, row_seq long, _n string").repartition(parts)
    got = sampling.sampled(t.withColumnRenamed("_n", "note"))
    assert got.columns == ["file", "row_seq", "note", "pick"]
    assert sorted(map(str, ((r["file"], r["row_seq"], r["pick"]) for r in got.collect()))) == sorted(map(str, want))
    assert sampling.sampled(t.limit(0)).isEmpty()


def test_ranks_in_groups(spark):
    rows = [(["x", None, "y"][min(i % 5, 2)], i * 37 % 400) for i in range(400)]
    got = ranked(spark.createDataFrame(rows, "g string, v long").repartition(5), ["g"], [F.desc("v")]).collect()
    for g in ("x", None, "y"):
        assert [r["v"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == sorted((v for h, v in rows if h == g), reverse=True)
    assert len(got) == 400
