"""Import records: life cycle, profitability and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions import rules
from lonja.operators.ranks import ranked
from lonja.functions.exprs import ratio, round2


def allowed(current: Column, target: Column) -> Column:
    """The next status in order, or cancelled from any status that is not an end."""
    order = F.array(*map(F.lit, rules.STATUSES[:-1]))
    step = (F.array_position(order, target) == F.array_position(order, current) + 1) & (F.array_position(order, current) > 0)
    return ~current.isin(rules.TERMINAL) & ((target == "cancelled") | step)


def replay(events: DataFrame, key: str = "record", target: str = "target", order: str = "seq") -> DataFrame:
    """Status of each record after its events in order; events that are not allowed change nothing.

    A fold over the record's own events, which are few; they are collected sorted within one exchange by record."""
    folded = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, target))).alias("e"))
    start = F.struct(F.lit("ordered").alias("status"), F.lit(0).alias("accepted"))

    def step(acc: Column, e: Column) -> Column:
        ok = allowed(acc["status"], e[target])
        return F.struct(F.when(ok, e[target]).otherwise(acc["status"]).alias("status"), F.when(ok, acc["accepted"] + 1).otherwise(acc["accepted"]).alias("accepted"))

    return folded.select(key, F.aggregate("e", start, step).alias("s"), F.size("e").alias("n")).select(key, "s.status", F.col("s.accepted").cast("long").alias("accepted"), (F.col("n") - F.col("s.accepted")).cast("long").alias("rejected"))


def profitability(records: DataFrame) -> DataFrame:
    """Profit and return of each record; without a local price unavailable, never zero."""
    known = F.col("local_price").isNotNull()
    profit = F.when(known, round2(F.col("local_price") - F.col("landed")))
    return records.select("record", "status", "landed", "local_price", profit.alias("profit"), F.when(known, round2(ratio((F.col("local_price") - F.col("landed")) * 100, F.col("landed")))).alias("roi_pct"), F.when(known, "known").otherwise("unavailable").alias("verdict"))


def rollups(records: DataFrame) -> DataFrame:
    """Invested, profit where known, active records, and the count of each status, zero where there is none."""
    return records.agg(
        round2(F.coalesce(F.sum(F.col("landed").cast("decimal(20,2)")), F.lit(0)).cast("double")).alias("invested"),
        round2(F.coalesce(F.sum((F.col("local_price") - F.col("landed")).cast("decimal(20,2)")), F.lit(0)).cast("double")).alias("profit"),
        F.count_if(~F.col("status").isin(rules.TERMINAL)).alias("active"),
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in rules.STATUSES),
    )


def numbered(rows: DataFrame, order: str, start: int = 0, prefix: str = "IMP-", into: str = "number") -> DataFrame:
    """rows with PREFIX0001 and on in the order of a unique key, after a counter that is never used again.

    No single-task window: ranks come from stored ranges of keys, so a lost executor gives no number twice."""
    number = F.col("_rank") + start
    out = ranked(rows, [], [F.col(order).asc_nulls_last()], "_rank")
    return out.withColumn(into, F.concat(F.lit(prefix), F.lpad(number.cast("string"), F.greatest(F.lit(4), F.length(number.cast("string"))), "0"))).drop("_rank")


def board(records: DataFrame) -> DataFrame:
    """Records of each status in the fixed order of the life cycle, statuses without records included."""
    order = records.sparkSession.createDataFrame(list(enumerate(rules.STATUSES)), "position int, status string")
    n = records.groupBy("status").agg(F.count("*").alias("n"), F.min("record").alias("first_record"))
    return order.join(n, "status", "left").select("position", "status", F.coalesce("n", F.lit(0)).alias("n"), "first_record")


def relevant_date(status: Column, dates: dict[str, Column]) -> Column:
    """The date of the current status, else the latest known date before it in the life cycle."""
    order = [s for s in rules.STATUSES if s in dates]
    out = F.lit(None)
    for k, s in enumerate(order):
        out = F.when(status == s, F.coalesce(*(dates[x] for x in reversed(order[: k + 1])))).otherwise(out)
    return out


def fresh(at: Column, now: Column, seconds: int = 300) -> Column:
    """Whether a cached value is younger than its time to live."""
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(at)) < seconds, F.lit(False))
