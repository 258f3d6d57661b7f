"""A seeded sample of each file that comes out the same on any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.operators.ranks import ranked

_WORD = 0xFFFFFFFF
# The generator's step, the seed, picks of a file.
STEP, SEED, PICKS = 0x6D2B79F5, 42, 10


def _times(a: Column, b: Column) -> Column:
    """Product of two unsigned 32-bit numbers, its lower 32 bits, without passing 64 bits."""
    high = F.shiftleft((a * F.shiftrightunsigned(b, 16)).bitwiseAND(F.lit(0xFFFF).cast("bigint")), 16)
    return (a * b.bitwiseAND(F.lit(0xFFFF).cast("bigint")) + high).bitwiseAND(F.lit(_WORD))


def draw(n: Column, seed: int = SEED) -> Column:
    """The n-th number (from 1) in [0, 1) of the mulberry32 sequence: its state is seed + n steps, so any number can be had
    without those before it."""
    word = F.lit(_WORD)
    s = (F.lit(seed).cast("bigint") + _times(n.cast("bigint"), F.lit(STEP).cast("bigint"))).bitwiseAND(word)
    t = _times(s.bitwiseXOR(F.shiftrightunsigned(s, 15)), s.bitwiseOR(F.lit(1).cast("bigint")))
    t = (t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("bigint")))).bitwiseAND(word).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def sampled(rows: DataFrame, file: str = "file", order: str = "row_seq", picks: int = PICKS, seed: int = SEED) -> DataFrame:
    """rows of the sample with pick (from 1): of each file, in the order of files, ``picks`` rows without replacement, all of a
    smaller file. ``order`` is unique in a file and gives the rows' places; files of a null name come first, as one.

    A file's picks depend on the picks of the files before (a sum over files) and on its size; its k-th draw picks among the rows
    left, so a fold over the places taken before turns it into a place. Only sizes and places are joined, never a file's rows
    together."""
    placed = ranked(rows, [file], [F.col(order).asc_nulls_first()], "_place")
    sizes = placed.groupBy(file).agg(F.count("*").alias("_n")).withColumn("_take", F.least(F.col("_n"), F.lit(picks)))
    before = Window.orderBy(F.col(file).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_drawn", F.coalesce(F.sum("_take").over(before), F.lit(0)))
    sizes = sizes.withColumn("_draws", F.transform(F.sequence(F.lit(1), F.col("_take")), lambda k: F.floor(draw(F.col("_drawn") + k, seed) * (F.col("_n") - k + 1))))

    def place(taken: Column, left: Column) -> Column:
        """The place of the left-th row that is not taken."""
        at = F.aggregate(F.array_sort(taken), left, lambda o, p: F.when(p <= o, o + 1).otherwise(o))
        return F.concat(taken, F.array(at))

    taken = F.aggregate("_draws", F.array().cast("array<bigint>"), lambda t, d: place(t, d))
    picked = sizes.select(F.col(file).alias("_file"), F.posexplode(taken).alias("_k", "_at"))
    both = placed.join(picked, placed[file].eqNullSafe(picked["_file"]) & (placed["_place"] == picked["_at"] + 1))
    return both.select(*(placed[c] for c in rows.columns), (F.col("_k") + 1).alias("pick"))
