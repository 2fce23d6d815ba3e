"""Units against dated targets: timing, counts, rates and textbooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import active_targets
from quillspan.functions.values import pct

#: Timing classes.
TIMINGS = ("before", "on_time", "after", "not_executed", "undecided")


def timing(executed: Column, start: Column, end: Column) -> Column:
    """Where a date lies in a period; a missing date is not executed, a missing bound leaves it undecided."""
    return (
        F.when(executed.isNull(), "not_executed")
        .when(start.isNull() | end.isNull(), "undecided")
        .when(executed < start, "before")
        .when(executed > end, "after")
        .otherwise("on_time")
    )


def assigned_units(units: DataFrame) -> DataFrame:
    """A row for each unit and each target it is checked for."""
    checked = F.map_filter("target_checks", lambda _, v: F.coalesce(v, F.lit(False)))
    return units.withColumn("target_no", F.explode(F.map_keys(checked)))


def last_target(targets: DataFrame) -> DataFrame:
    """One row for each page and target number: the last by ``seq``."""
    last = Window.partitionBy("page_key", "target_no").orderBy(F.desc("seq"))
    return targets.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: str, sep: str = "\n", out: str = "textbooks") -> DataFrame:
    """Different values of a key in the order they first occur, joined; blanks and ``-`` are skipped."""
    first = df.where(F.trim(F.coalesce(F.col(value), F.lit(""))).isin("", "-") == F.lit(False)).groupBy(*keys, value).agg(F.min(order).alias("_o"))
    listed = F.array_sort(F.collect_list(F.struct("_o", value)))
    return first.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x[value]), sep).alias(out))


def target_progress(targets: DataFrame, units: DataFrame) -> DataFrame:
    """Counts and rates of every target; one without units stays, with counts of 0 and no rates.

    A target is a row of its page, told by ``seq``: of several that have one number, each counts the number's
    units by its own period. Executed units of a target without a period count as after it.
    """
    on = F.map_keys(F.map_filter("target_checks", lambda _, v: F.coalesce(v, F.lit(False))))
    # Targets and units are dealt out once, by the page; what a target needs of its page's units is counted in its own row.
    own = units.groupBy("page_key").agg(F.collect_list(F.struct("row_no", "exec_date", "textbook", on.alias("on"))).alias("_u"))
    mine = F.transform(F.filter("_u", lambda u: F.array_contains(u["on"], F.col("target_no"))), lambda u: F.struct(timing(u["exec_date"], F.col("start_date"), F.col("end_date")).alias("t"), u["exec_date"], u["row_no"], u["textbook"]))

    def counted(rows: Column) -> Column:
        n = lambda *names: F.size(F.filter(rows, lambda u: u["t"].isin(*names)))
        named = F.filter(rows, lambda u: ~F.trim(F.coalesce(u["textbook"], F.lit(""))).isin("", "-"))
        books = F.array_distinct(F.transform(F.array_sort(F.transform(named, lambda u: F.struct(u["row_no"], u["textbook"]))), lambda x: x["textbook"]))
        return F.struct(
            F.size(rows).alias("units"), (F.size(rows) - n("not_executed")).alias("executed"), n("on_time").alias("on_time"), n("before").alias("before"), n("after", "undecided").alias("after"), n("not_executed").alias("not_executed"),
            F.array_max(F.transform(rows, lambda u: u["exec_date"])).alias("latest"), F.when(F.size(books) > 0, F.array_join(books, "\n")).alias("textbooks"),
        )

    out = targets.join(own, "page_key", "left").withColumn("_c", F.transform(F.array(mine), counted)[0])
    numbers, known = ["units", "executed", "on_time", "before", "after", "not_executed"], F.col("seq").isNotNull()
    counts = {n: F.coalesce(F.when(known, F.col(f"_c.{n}")), F.lit(0)) for n in numbers}  # null where a page has no units
    out = out.withColumns({**counts, "latest": F.when(known, F.col("_c.latest")), "textbooks": F.col("_c.textbooks")}).drop("_u", "_c")
    return out.withColumns({f"{n}_rate": pct(F.col(n), F.col("units")) for n in numbers[1:]})


def with_targets(progress: DataFrame, targets: DataFrame) -> DataFrame:
    """Progress rows with their target's columns; rows kept from before ``seq`` was stored take the last target of their number."""
    there = progress.where("seq is not null").join(targets.drop("target_no"), ["page_key", "seq"], "left")
    before = progress.where("seq is null").drop("seq").join(last_target(targets), ["page_key", "target_no"], "left")
    return there.unionByName(before.select(*there.columns))


#: What doesn't add up in a row of progress.
INCONSISTENT = "units <> on_time + before + after + not_executed or executed <> on_time + before + after"


def inconsistent(progress: DataFrame) -> DataFrame:
    """Rows whose counts don't add up; none are expected."""
    return progress.where(INCONSISTENT)


def delayed_targets(targets: DataFrame, default: str = "?", sep: str = ", ") -> DataFrame:
    """``page_key, delayed``: the names (else numbers) of the targets whose flag is not OK, in their order."""
    late = targets.where(F.coalesce("progress_delay", F.lit("OK")) != "OK")
    name = F.coalesce(F.nullif("target_name", F.lit("")), F.nullif("target_no", F.lit("")), F.lit(default))
    listed = F.array_sort(F.collect_list(F.struct("seq", name.alias("name"))))
    return late.groupBy("page_key").agg(F.array_join(F.transform(listed, lambda x: x["name"]), sep).alias("delayed"))


def unit_detail(units: DataFrame, pages: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each unit and checked target, ``-`` where none is checked, with the page's attributes and the timing.

    A target that has no definition leaves the unit's own timing: on time if it was executed.
    """
    fields = ("target_name", "start_date", "end_date", "progress_delay")
    listed = targets.groupBy("page_key").agg(F.collect_list(F.struct("seq", "target_no", *fields)).alias("_t"))
    joined = units.join(pages, "page_key").join(listed, "page_key", "left")  # all by the page; targets are told apart in the row
    rows = joined.withColumn("target_no", F.explode(active_targets(F.col("target_checks"))))
    rows = rows.withColumn("_l", F.get(F.sort_array(F.filter("_t", lambda x: x["target_no"] == F.col("target_no")), asc=False), F.lit(0)))  # the last by ``seq``
    rows = rows.select("*", *(F.col(f"_l.{c}").alias(c) for c in fields), F.col("_l").isNotNull().alias("_known"))
    own = F.when(F.col("exec_date").isNotNull(), "on_time").otherwise("not_executed")
    return (
        rows.withColumn("timing", F.when(F.col("_known"), timing(F.col("exec_date"), F.col("start_date"), F.col("end_date"))).otherwise(own))
        .withColumn("progress_delay", F.coalesce("progress_delay", F.lit("OK")))
        .drop("_known", "_t", "_l", "target_checks")
    )
