"""The driver's tables in the roles of the store's tables, in Spark and as SQL for the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.keys import curriculum_key
from quillspan.functions.values import is_current


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    row, page = (F.col("o_orderkey") % 50).cast("int"), F.expr("cast(o_orderkey div 50 as int)") + 1
    return j.select(
        curriculum_key(F.col("c_nationkey"), F.col("c_custkey"), F.col("o_orderpriority"), page, row).alias("page_key"), F.col("o_orderkey").alias("order_key"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("classroom"), F.col("c_nationkey").cast("string").alias("code"), F.col("c_custkey").cast("string").alias("student_id"), F.col("c_name").alias("student_name"),
        F.col("c_mktsegment").alias("grade"), F.col("o_orderstatus").alias("division"), F.col("o_orderpriority").alias("subject"), row.alias("row_index"), page.alias("page_index"), F.to_date("o_orderdate").alias("order_date"),
    )


#: The day on which targets are looked at.
TODAY = "1996-01-01"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three targets for each page: the first year, the second, and one without a period."""
    seq = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    t = overview(spark, sf_dir).select("page_key", "order_key", "order_date", seq.alias("seq"))
    return t.select(
        "page_key", "order_key", "seq", F.concat(F.lit("T"), F.col("seq")).alias("target_no"), F.concat(F.lit("target "), F.col("seq")).alias("target_name"),
        F.when(F.col("seq") < 3, F.expr("date_add(order_date, (seq - 1) * 366)")).alias("start_date"), F.when(F.col("seq") < 3, F.expr("date_add(order_date, (seq - 1) * 366 + 366 - seq)")).alias("end_date"),
        F.when((F.col("order_key") + F.col("seq")) % 5 == 0, "DELAY").otherwise("OK").alias("progress_delay"),
        (F.col("order_key") % 60 + 40).cast("string").alias("target_score"), F.when(F.col("order_key") % 4 > 0, (F.col("order_key") % 50).cast("string")).alias("current_score"),
    ).withColumns(
        {"is_current": is_current(F.lit(TODAY).cast("date"), F.col("start_date"), F.col("end_date")), "period_text": F.concat(F.date_format("start_date", "yyyy/MM/dd"), F.lit(" ~ "), F.date_format("end_date", "yyyy/MM/dd"))}
    )


def repeated_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets, and on many pages T1 once more with the third year as its period, or T2 without one."""
    t, k = targets(spark, sf_dir), F.col("order_key")
    first = t.where((F.col("seq") == 1) & (k % 2 == 0)).withColumns({"seq": F.lit(4), "target_name": F.lit("again 1"), "start_date": F.date_add("start_date", 732), "end_date": F.date_add("end_date", 732)})
    second = t.where((F.col("seq") == 2) & (k % 3 == 1)).withColumns({"seq": F.lit(5), "target_name": F.lit("again 2"), "start_date": F.lit(None).cast("date"), "end_date": F.lit(None).cast("date")})
    more = first.unionByName(second).withColumns({"is_current": F.lit(False), "period_text": F.lit(None).cast("string")})
    return t.unionByName(more)


LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def units(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """The units of all pages, or of those given, as ``overview`` has them."""
    l, o = read(spark, sf_dir, "lineitem"), (overview(spark, sf_dir) if pages is None else pages).select("page_key", "order_key")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE))
    l = l.withColumn("row_no", n).join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("order_key"))
    checks = F.create_map(F.lit("T1"), F.col("l_linenumber") % 2 == 1, F.lit("T2"), F.col("l_quantity") > 25, F.lit("T3"), F.col("l_discount") >= 0.05)
    return l.select(
        "page_key", "row_no", F.col("p_name").alias("unit_name"), F.col("p_brand").alias("textbook"), F.when(F.col("l_returnflag") != "N", F.to_date("l_shipdate")).alias("exec_date"),
        F.col("l_quantity").alias("score"), F.lit(50.0).alias("max_score"), checks.alias("target_checks"), F.col("p_type").alias("middle_unit"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("problem_code"),
        F.when(F.col("l_linenumber") == 1, F.col("p_brand")).alias("today_textbook"), F.lit("home").alias("division_text"), F.col("l_linestatus").alias("confirm_test"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: every line of a text after its first starts with a heading word by its position."""
    words = F.array(*map(F.lit, HEADS))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 1, F.concat(F.element_at(words, (i % len(HEADS)) + 1), F.lit(": "), x)).otherwise(x))
    d = read(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.col("source").alias("author"), "lang", F.array_join(lines, "\n").alias("text"), F.concat((F.col("doc_id") % 4 * 3 + 3).cast("string"), F.lit("th")).alias("grade"), F.when(F.col("doc_id") % 2 == 0, "public").otherwise("exam").alias("course"), F.when(F.col("doc_id") % 7 == 0, "summer course").otherwise("regular").alias("division"))


#: Heading words of notes and the sections they open.
HEADS = ("Writer", "Textbook", "Lesson plan", "Student", "Test", "Homework", "School", "Count", "Goal")
ALIASES = dict(zip(HEADS, ("author", "textbook", "plan", "student", "test", "homework", "school", "count", "goal"), strict=True)) | {"Text": "textbook", "Plan": "plan"}
WORDS = {"placeholder": ["-", "none", "n/a"], "status": ["the", "and"], "uncertain": ["ion", "unknown"], "school_type": ["th"], "public": ["public"], "exam": ["exam"], "seasonal": ["course"]}


def findings(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """Findings of a page by the document of its order key, of all pages or those given; lists by length, language and labels."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    pick = lambda *c: F.array_compact(F.array(*c))
    d = d.select(
        F.col("doc_id").alias("order_key"),
        pick(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("n_chars") < 200, "short")).alias("errors"), pick(F.when(F.col("quality") == 0, "poor"), F.when(F.col("lang") != "en", "foreign")).alias("warnings"),
        F.map_filter(F.create_map(*(x for k, v in (("author", F.col("source")), ("textbook", F.col("lang")), ("plan", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("plan "), F.col("doc_id")))), ("school", F.when(F.col("doc_id") % 3 == 0, "high"))) for x in (F.lit(k), v))), lambda _, v: v.isNotNull()).alias("sections"),
        F.when(F.col("doc_id") % 5 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")).alias("unclassified"), pick(F.when(F.col("n_chars") > 8000, "long")).alias("reviews"), pick(F.when(F.col("toxic") == 1, "soften"), F.when(F.col("n_chars") < 200, "extend")).alias("fix_items"),
    )
    severity = F.when(F.size("errors") > 0, "ERROR").when(F.size("reviews") > 0, "REVIEW").when(F.size("warnings") > 0, "WARNING").otherwise("PASS")
    return d.withColumn("severity", severity).join((overview(spark, sf_dir) if pages is None else pages).select("page_key", "order_key"), "order_key").drop("order_key")


SQL = """
with overview as (
  select concat_ws('_', c_nationkey, c_custkey, o_orderpriority, case when o_orderkey // 50 + 1 > 1 then o_orderkey // 50 + 1 end, o_orderkey % 50) as page_key,
    o_orderkey as order_key, case when o_orderkey % 3 = 0 then '' else n_name end as classroom, c_nationkey::varchar as code, c_custkey::varchar as student_id, c_name as student_name,
    c_mktsegment as grade, o_orderstatus as division, o_orderpriority as subject, (o_orderkey % 50)::int as row_index, (o_orderkey // 50 + 1)::int as page_index, o_orderdate::date as order_date
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
targets as (
  select page_key, order_key, seq, 'T' || seq as target_no, 'target ' || seq as target_name,
    case when seq < 3 then order_date + (seq - 1) * 366 end as start_date, case when seq < 3 then order_date + ((seq - 1) * 366 + 366 - seq) end as end_date,
    case when (order_key + seq) % 5 = 0 then 'DELAY' else 'OK' end as progress_delay, (order_key % 60 + 40)::varchar as target_score, case when order_key % 4 > 0 then (order_key % 50)::varchar end as current_score,
    coalesce(date '1996-01-01' between start_date and end_date, false) as is_current, strftime(start_date, '%Y/%m/%d') || ' ~ ' || strftime(end_date, '%Y/%m/%d') as period_text
  from overview, (values (1), (2), (3)) v(seq)),
line as (
  select *, row_number() over (partition by l_orderkey order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as row_no from lineitem),
units as (
  select page_key, row_no::int as row_no, p_name as unit_name, p_brand as textbook, case when l_returnflag <> 'N' then l_shipdate::date end as exec_date, l_quantity as score, 50.0::double as max_score,
    p_type as middle_unit, 'p' || l_partkey as problem_code, case when l_linenumber = 1 then p_brand end as today_textbook, 'home' as division_text, l_linestatus as confirm_test, l_linenumber % 2 = 1 as t1, l_quantity > 25 as t2, l_discount >= 0.05 as t3
  from line join part on l_partkey = p_partkey join overview on l_orderkey = order_key),
assigned as (
  select page_key, row_no, unit_name, textbook, exec_date, score, max_score, middle_unit, problem_code, today_textbook, division_text, confirm_test, unnest(case when t1 or t2 or t3 then list_filter([case when t1 then 'T1' end, case when t2 then 'T2' end, case when t3 then 'T3' end], lambda x: x is not null) else ['-'] end) as target_no from units),
timed as (
  select a.*, t.target_name, t.start_date, t.end_date, t.progress_delay,
    case when t.target_no is null then case when exec_date is null then 'not_executed' else 'on_time' end when exec_date is null then 'not_executed' when start_date is null or end_date is null then 'undecided'
      when exec_date < start_date then 'before' when exec_date > end_date then 'after' else 'on_time' end as timing
  from assigned a left join targets t using (page_key, target_no)),
counts as (
  select page_key, target_no, count(*) as units, count(exec_date) as executed, count(*) filter (timing = 'on_time') as on_time, count(*) filter (timing = 'before') as before,
    count(*) filter (timing in ('after', 'undecided')) as after, count(*) filter (timing = 'not_executed') as not_executed, max(exec_date) as latest
  from timed where target_no <> '-' group by all),
books as (
  select page_key, target_no, string_agg(textbook, chr(10) order by o, textbook) as textbooks from (select page_key, target_no, textbook, min(row_no) as o from timed where target_no <> '-' group by all) group by all),
progress as (
  select t.*, coalesce(units, 0)::int as units, coalesce(executed, 0)::int as executed, coalesce(on_time, 0)::int as on_time, coalesce(before, 0)::int as before, coalesce(after, 0)::int as after,
    coalesce(not_executed, 0)::int as not_executed, latest, textbooks
  from targets t left join counts using (page_key, target_no) left join books using (page_key, target_no)),
findings as (
  select page_key, errors, warnings, reviews, fix_items, source as author, lang as textbook, case when doc_id % 2 = 0 then 'plan ' || doc_id end as plan, case when doc_id % 3 = 0 then 'high' end as school, case when doc_id % 5 = 0 then lang || chr(10) || source end as loose,
    case when len(errors) > 0 then 'ERROR' when len(reviews) > 0 then 'REVIEW' when len(warnings) > 0 then 'WARNING' else 'PASS' end as severity
  from (select doc_id, source, lang, list_filter([case when toxic = 1 then 'toxic' end, case when n_chars < 200 then 'short' end], lambda x: x is not null) as errors,
      list_filter([case when quality = 0 then 'poor' end, case when lang <> 'en' then 'foreign' end], lambda x: x is not null) as warnings, list_filter([case when n_chars > 8000 then 'long' end], lambda x: x is not null) as reviews,
      list_filter([case when toxic = 1 then 'soften' end, case when n_chars < 200 then 'extend' end], lambda x: x is not null) as fix_items
    from documents left join labels using (doc_id)) join overview on order_key = doc_id)
"""

#: Targets that repeat a number, and their progress; goes on from ``SQL``.
REPEATED = """,
rtargets as (
  select * from targets
  union all select page_key, order_key, 4, target_no, 'again 1', start_date + 732, end_date + 732, progress_delay, target_score, current_score, false, null from targets where seq = 1 and order_key % 2 = 0
  union all select page_key, order_key, 5, target_no, 'again 2', null, null, progress_delay, target_score, current_score, false, null from targets where seq = 2 and order_key % 3 = 1),
rcounts as (
  select page_key, t.seq, count(*) as units, count(exec_date) as executed, count(*) filter (exec_date between t.start_date and t.end_date) as on_time, count(*) filter (exec_date < t.start_date) as before,
    count(*) filter (exec_date > t.end_date or exec_date is not null and t.start_date is null) as after, count(*) filter (exec_date is null) as not_executed, max(exec_date) as latest
  from assigned join rtargets t using (page_key, target_no) group by all),
rprogress as (
  select t.*, coalesce(units, 0)::int as units, coalesce(executed, 0)::int as executed, coalesce(on_time, 0)::int as on_time, coalesce(before, 0)::int as before, coalesce(after, 0)::int as after,
    coalesce(not_executed, 0)::int as not_executed, latest, textbooks
  from rtargets t left join rcounts using (page_key, seq) left join books using (page_key, target_no))
"""


def num_sql(v: str) -> str:
    return f"coalesce(case when {v} = floor({v}) then {v}::bigint::varchar else {v}::varchar end, '-')"


def pct_sql(a: str, b: str) -> str:
    v = f"round_even({a} / {b} * 100, 1)"
    return f"case when {b} > 0 then case when {v} = floor({v}) then {v}::bigint::varchar else {v}::varchar end else '-' end"
