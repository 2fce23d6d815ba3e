"""Registered queries on the driver's tables, each with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import keys as K
from quillspan.functions import text as X
from quillspan.functions import values as V
from quillspan.operators import backfill, order, similar, state, summary
from quillspan.operators import progress as P
from quillspan.plans import reports as R
from quillspan.plans import roles
from quillspan.plans.roles import num_sql, pct_sql, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _progress(s: SparkSession, d: str) -> DataFrame:
    return P.target_progress(roles.targets(s, d), roles.units(s, d))


_RATES = ", ".join(f"{pct_sql(n, 'units')} as {n}_rate" for n in ("executed", "on_time", "before", "after", "not_executed"))
_DATE = "coalesce(strftime({0}, '%Y/%m/%d'), '-') as {0}"


_STUDENT = "coalesce(nullif(classroom, ''), 'unknown') as classroom, student_id, grade, student_name, division, subject"


_PROGRESS = f"""select {_STUDENT}, target_no, target_name, progress_delay, {_DATE.format('start_date')}, {_DATE.format('end_date')}, coalesce(period_text, '-') as period_text, is_current,
  coalesce(textbooks, '-') as textbooks, target_score, coalesce(current_score, '-') as current_score, units, executed, on_time, before, after, not_executed, {_RATES}, {_DATE.format('latest')} from progress join overview using (page_key)"""  # fmt: skip


@query(roles.SQL + roles.REPEATED + "select page_key, seq::int as seq, target_no, units, executed, on_time, before, after, not_executed, strftime(latest, '%Y/%m/%d') as latest_text, textbooks from rprogress")
def progress_by_target(s, d):
    """Pages on which a target's number stands twice: each counts by its own period."""
    p = P.target_progress(roles.repeated_targets(s, d), roles.units(s, d))
    return p.select("page_key", "seq", "target_no", "units", "executed", "on_time", "before", "after", "not_executed", F.date_format("latest", "yyyy/MM/dd").alias("latest_text"), "textbooks")


@query(roles.SQL + _PROGRESS)
def report_progress(s, d):
    return R.report_progress(roles.overview(s, d), _progress(s, d))


_UNITS = f"""select {_STUDENT}, target_no, coalesce(target_name, '-') as target_name, coalesce(progress_delay, 'OK') as progress_delay, {_DATE.format('start_date')}, {_DATE.format('end_date')}, unit_name, middle_unit, textbook,
  problem_code, {_DATE.format('exec_date')}, timing, exec_date is not null as executed, {num_sql('score')} as score, {num_sql('max_score')} as max_score, {pct_sql('score', 'max_score')} as score_rate, coalesce(today_textbook, '-') as today_textbook,
  division_text, confirm_test from timed join overview using (page_key)"""  # fmt: skip


@query(roles.SQL + _UNITS)
def report_unit_detail(s, d):
    return R.report_units(roles.units(s, d), roles.overview(s, d), roles.targets(s, d))


@query(roles.SQL + "select target_no, timing, count(*) as n from timed where target_no <> '-' group by all")
def period_classification(s, d):
    own = P.assigned_units(roles.units(s, d)).join(roles.targets(s, d), ["page_key", "target_no"])
    return own.withColumn("timing", P.timing(F.col("exec_date"), F.col("start_date"), F.col("end_date"))).groupBy("target_no", "timing").agg(F.count(F.lit(1)).alias("n"))


@query(roles.SQL + "select page_key, target_no, textbooks from books")
def textbooks_per_target(s, d):
    return P.ordered_distinct(P.assigned_units(roles.units(s, d)), ["page_key", "target_no"], "textbook", "row_no")


@query(roles.SQL + "select page_key, target_no, units from progress where units <> on_time + before + after + not_executed or executed <> on_time + before + after")
def progress_consistency(s, d):
    return P.inconsistent(_progress(s, d)).select("page_key", "target_no", "units")


@query(roles.SQL + """, late as (select page_key, string_agg(target_name, ', ' order by seq) as delayed from targets where progress_delay <> 'OK' group by 1)
  select coalesce(nullif(classroom, ''), 'unknown') as classroom, student_name, subject, coalesce(delayed, '-') as delayed, coalesce(severity, '-') as severity,
    coalesce(nullif(array_to_string(case when len(fix_items) > 0 then fix_items else list_concat(errors, warnings) end, '; '), ''), '-') as reasons
  from overview left join late using (page_key) left join findings using (page_key) where delayed is not null or coalesce(severity, 'PASS') <> 'PASS'""")  # fmt: skip
def report_attention(s, d):
    return R.report_attention(roles.overview(s, d), roles.targets(s, d), roles.findings(s, d))


@query(roles.SQL + "select page_key, string_agg(target_name, ', ' order by seq) as delayed from targets where progress_delay <> 'OK' group by 1")
def delayed_targets(s, d):
    return P.delayed_targets(roles.targets(s, d))


_FINDINGS = f"""select {_STUDENT}, severity, coalesce(nullif(array_to_string(fix_items, chr(10)), ''), '-') as fix_items, coalesce(nullif(array_to_string(errors, chr(10)), ''), '-') as errors,
  coalesce(nullif(array_to_string(warnings, chr(10)), ''), '-') as warnings, author, coalesce(school, '-') as school, findings.textbook, coalesce(plan, '-') as plan, '-' as student, '-' as test, '-' as homework, coalesce(loose, '-') as unclassified
  from findings join overview using (page_key)"""  # fmt: skip


@query(roles.SQL + _FINDINGS)
def report_findings(s, d):
    return R.report_findings(roles.findings(s, d), roles.overview(s, d))


_SUMS = ", ".join(f"sum({m})::bigint as {m}" for m in summary.MEASURES)


@query(roles.SQL + f""", p as (select case when classroom = '' then 'unknown' else classroom end as classroom, grade, subject, student_id, progress.* exclude (page_key) from progress join overview using (page_key)),
  f as (select case when classroom = '' then 'unknown' else classroom end as classroom, grade, subject, len(errors) as e, len(warnings) as w from findings join overview using (page_key)),
  l as (select 0 as level, 'all' as value, count(distinct student_id) as students, count(*) as targets, {_SUMS} from p
    union all select 1, classroom, count(distinct student_id), count(*), {_SUMS} from p group by classroom
    union all select 2, grade, count(distinct student_id), count(*), {_SUMS} from p group by grade
    union all select 3, subject, count(distinct student_id), count(*), {_SUMS} from p group by subject),
  r as (select 0 as level, 'all' as value, sum(e)::bigint as errors, sum(w)::bigint as warnings from f union all select 1, classroom, sum(e)::bigint, sum(w)::bigint from f group by classroom
    union all select 2, grade, sum(e)::bigint, sum(w)::bigint from f group by grade union all select 3, subject, sum(e)::bigint, sum(w)::bigint from f group by subject)
  select l.*, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings from l left join r using (level, value)""")  # fmt: skip
def report_summary(s, d):
    pages = roles.overview(s, d).select("page_key", "classroom", "grade", "subject", "student_id")
    found = roles.findings(s, d).join(pages, "page_key").withColumns({"n_errors": F.size("errors"), "n_warnings": F.size("warnings")})
    return R.report_summary(_progress(s, d).join(pages, "page_key"), found)


@query("""select url, '-' as fetched_at, case when contains(url, '0') then 'detail' else 'lesson' end as kind, case when length(h) > 32000 then substr(h, 1, 32000) || '...[cut]' else h end as html,
  case when page_id % 4 = 0 then '-' else 'fetched' end as status, case when page_id % 5 = 0 then 'timeout' else '-' end as error from (select page_id, url, regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') as h from pages)""")  # fmt: skip
def report_raw_pages(s, d):
    own = {"fetched_at": F.lit(None).cast("timestamp"), "status": F.when(F.col("page_id") % 4 > 0, "fetched"), "error": F.when(F.col("page_id") % 5 == 0, "timeout")}
    return R.report_raw_pages(read(s, d, "pages").withColumns(own), detail_part="0")


@query(roles.SQL + "select page_key, row_no, unit_name, student_id, classroom from units join overview using (page_key)")
def units_with_page(s, d):
    return R.units_with_page(roles.units(s, d), roles.overview(s, d)).select("page_key", "row_no", "unit_name", "student_id", "classroom")


@query(roles.SQL + "select page_key, severity, student_id from findings join overview using (page_key)")
def findings_with_page(s, d):
    return R.findings_with_page(roles.findings(s, d), roles.overview(s, d)).select("page_key", "severity", "student_id")


@query(roles.SQL + "select page_key, row_index from overview where order_key % 4 <> 0")
def pending_pages(s, d):
    pages = roles.overview(s, d).withColumn("status", F.when(F.col("order_key") % 4 == 0, "saved").otherwise("unfetched"))
    return state.pending(roles.overview(s, d), pages).select("page_key", "row_index")


@query(roles.SQL + "select page_key, row_no, order_key % 10 = 0 as orphan from units join overview using (page_key)")
def orphan_removal(s, d):
    kept, gone = state.drop_orphans(roles.units(s, d), roles.overview(s, d).where("order_key % 10 <> 0"))
    return kept.select("page_key", "row_no", F.lit(False).alias("orphan")).unionByName(gone.select("page_key", "row_no", F.lit(True).alias("orphan")))


@query(roles.SQL + """, k as (select student_id, arg_min(classroom, (row_index, page_key)) as known from overview where classroom <> '' group by 1)
  select page_key, coalesce(known, 'unknown') as classroom from overview left join k using (student_id)""")  # fmt: skip
def classroom_backfill(s, d):
    return backfill.backfill(roles.overview(s, d), "student_id", "classroom", ["row_index", "page_key"]).select("page_key", "classroom")


@query(roles.SQL + "select page_key, (row_number() over (partition by student_id, division, subject order by page_index, row_index, page_key) - 1)::int as occurrence from overview")
def occurrence_index(s, d):
    return order.occurrence_index(roles.overview(s, d), ["student_id", "division", "subject"], ["page_index", "row_index", "page_key"]).select("page_key", "occurrence")


@query("""with l as (select user_id % 40 as walk, (event_id // 40) % 12 + 1 as page, event_type, user_id from events),
  s as (select walk, page, list_sort(list(distinct (event_type))) as s from l group by all),
  a as (select *, coalesce((s = lag(s) over (partition by walk order by page))::int, 0) as again from s),
  c as (select walk, page, max(again) over (partition by walk order by page) as cut from a)
  select walk, page, count(*) as n from l join c using (walk, page) where cut = 0 group by all""")  # fmt: skip
def repeated_listing_pages(s, d):
    e = read(s, d, "events").select((F.col("user_id") % 40).alias("walk"), F.expr("(event_id div 40) % 12 + 1").alias("page"), "event_type", "user_id")
    return order.cut_repeated_pages(e, ["walk"], "page", ["event_type"]).groupBy("walk", "page").agg(F.count(F.lit(1)).alias("n"))


@query("select l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc, l_shipdate desc) as n from lineitem) where n = 1")
def last_duplicate_wins(s, d):
    seq = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = read(s, d, "lineitem").select(F.col("l_orderkey").alias("page_key"), F.col("l_linenumber").alias("target_no"), "l_extendedprice", seq.alias("seq"))
    return P.last_target(rows).select(F.col("page_key").alias("l_orderkey"), F.col("target_no").alias("l_linenumber"), "l_extendedprice")


@query(roles.SQL + "select page_key, row_index, page_index, subject from overview")
def report_order(s, d):
    return order.report_order(roles.overview(s, d).select("page_key", "row_index", "page_index", "subject"), "page_index", "row_index")


@query("""select count(*) as total, count(*) filter (o_orderkey % 9 = 0) as unfetched, count(*) filter (o_orderkey % 9 in (2, 5)) as fetched, count(*) filter (o_orderkey % 9 = 7) as saved, count(*) filter (o_orderkey % 9 in (3, 6)) as failed from orders""")
def status_counts(s, d):
    from quillspan.schemas import STATUSES

    return summary.status_counts(read(s, d, "orders").select(F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("o_orderkey") % 9 + 1).cast("int")).alias("status")))


@query("select coalesce(event_type, 'unknown') as reason, count(*) as n from events group by all")
def retry_reasons(s, d):
    return summary.reason_counts(read(s, d, "events"), "event_type")


@query("select upper(source) as author, length(t)::int as n_chars, count(*) as copies from (select source, regexp_replace(text, '\\s', '', 'g') as t, doc_id from documents) group by source, t having count(*) >= 2 and length(t) >= 3")
def duplicates_by_author(s, d):
    return similar.copied_by_count(read(s, d, "documents"), "source", "text", least=2).select("author", F.length("t").cast("int").alias("n_chars"), "copies")


_SIMILAR = """with t as (select upper(source) as author, regexp_replace(text, '\\s', '', 'g') as t, count(*) as copies from documents group by all),
  g as (select author, t, copies, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) as g from t where length(t) >= 15),
  p as (select a.author, a.t as a, b.t as b, len(list_intersect(a.g, b.g)) as shared, len(a.g) as x, len(b.g) as y from g a join g b on a.author = b.author and a.t < b.t and 5 * least(len(a.g), len(b.g)) >= 4 * greatest(len(a.g), len(b.g))),
  q as (select author, a, b, shared / (x + y - shared) as jaccard from p where 5 * shared >= 4 * (x + y - shared))"""


@query(_SIMILAR + " select author, md5(a) as a, md5(b) as b, jaccard from q")
def similar_pairs(s, d):
    return similar.similar_pairs(similar._texts(read(s, d, "documents"), "source", "text"), shown=F.md5)


@query(_SIMILAR + """, e as (select author, a as t, b as o from q union all select author, b, a from q),
  n as (select e.author, e.t, sum(copies) as near from e join t on t.author = e.author and t.t = e.o group by all),
  f as (select t.author, t.t from t left join n using (author, t) where t.copies - 1 + coalesce(near, 0) >= 2 and length(t.t) >= 3),
  g2 as (select author, t from f union select e.author, e.o from e join f on f.author = e.author and f.t = e.t)
  select doc_id, g2.t is not null as copied from documents left join g2 on g2.author = upper(source) and g2.t = regexp_replace(text, '\\s', '', 'g')""")  # fmt: skip
def copied_texts(s, d):
    return similar.flag_similar(read(s, d, "documents"), "source", "text").select("doc_id", "copied")


#: Records in chains: each text is like the one before and the one after it and no other; some numbers are missing, so chains have one, two or four links.
_CHAIN_GAPS = (0, 1, 3, 6)


def _chains(s: SparkSession, d: str) -> DataFrame:
    """``k, author, text``: a window of 30 letters that moves on by two with every customer."""
    letter = lambda x: F.decode(F.unhex(F.hex(19968 + x % 20000)), "UTF-16BE")
    k = F.col("c_custkey")
    text = F.array_join(F.transform(F.sequence(2 * k, 2 * k + 29), letter), "")
    return read(s, d, "customer").where(~(k % 11).isin(*_CHAIN_GAPS)).select(k.alias("k"), F.concat(F.lit("n"), F.expr("c_custkey div 500")).alias("author"), text.alias("text"))


_CHAINS = f"""with recursive c as (select c_custkey as k, 'n' || (c_custkey // 500) as author, array_to_string(list_transform(range(2 * c_custkey, 2 * c_custkey + 30), lambda x: chr((19968 + x % 20000)::int)), '') as t from customer where c_custkey % 11 not in {_CHAIN_GAPS}),
  g as (select k, author, list_transform(range(1, 30), lambda i: substr(t, i, 2)) as g from c),
  e as (select a.k as a, b.k as b from g a join g b on a.author = b.author and a.k <> b.k and abs(a.k - b.k) < 15 where len(list_intersect(a.g, b.g)) * 5 >= 4 * (58 - len(list_intersect(a.g, b.g)))),
  r(k, root) as (select k, k from c union select e.b, r.root from r join e on r.k = e.a),
  w as (select k, min(root) as root from r group by 1), n as (select root, count(*) as size from w group by 1)"""


@query(_CHAINS + " select k, root, size, size >= 2 as in_2, size >= 3 as in_3, size >= 4 as in_4 from w join n using (root)")
def copied_groups(s, d):
    """Groups over any number of links, named by their smallest record, and who is in one of two, three or four records or more."""
    flagged = similar.flag_similar(_chains(s, d), least=2).withColumn("root", F.min("k").over(Window.partitionBy("copy_group")))
    return flagged.select("k", "root", F.col("copy_size").alias("size"), F.col("copied").alias("in_2"), *((F.col("copy_size") >= n).alias(f"in_{n}") for n in (3, 4)))


@query(_SIMILAR.replace("from documents group by all", "from documents where lang <> 'fr' group by all") + """, e as (select author, a as t, b as o from q union all select author, b, a from q),
  n as (select e.author, e.t, sum(copies) as near from e join t on t.author = e.author and t.t = e.o group by all),
  f as (select t.author, t.t from t left join n using (author, t) where t.copies - 1 + coalesce(near, 0) >= 2 and length(t.t) >= 3),
  g2 as (select author, t from f union select e.author, e.o from e join f on f.author = e.author and f.t = e.t),
  k as (select doc_id, lang <> 'fr' and g2.t is not null as copied from documents left join g2 on g2.author = upper(source) and g2.t = regexp_replace(text, '\\s', '', 'g'))
  select doc_id, copied, case when copied and doc_id % 3 > 0 then 'WARNING' when doc_id % 3 > 0 then 'PASS' else 'ERROR' end as severity,
    case when doc_id % 2 = 0 then case when copied then 'old,looks_copied' else 'old' end when copied then 'looks_copied' else '' end as warnings, case when copied then 'rewrite in own words' else '' end as fix_items from k""")  # fmt: skip
def copied_findings(s, d):
    k, none = F.col("doc_id"), F.array().cast("array<string>")
    own = read(s, d, "documents").withColumns({"severity": F.when(k % 3 > 0, "PASS").otherwise("ERROR"), "warnings": F.when(k % 2 == 0, F.array(F.lit("old"))).otherwise(none), "fix_items": none})
    out = similar.flag_similar(own, "source", "text", exclude=F.col("lang") == "fr")
    return out.select("doc_id", "copied", "severity", F.array_join("warnings", ",").alias("warnings"), F.array_join("fix_items", ",").alias("fix_items"))


@query("""with w as (select doc_id, list_distinct(list_transform(range(1, greatest(length(lang || source), 2)), lambda i: substr(lang || source, i, 2))) as a, list_distinct(list_transform(range(1, greatest(length(source), 2)), lambda i: substr(source, i, 2))) as b from documents)
  select doc_id, len(a)::int as n_grams, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) as jaccard from w""")  # fmt: skip
def ngram_jaccard(s, d):
    w = read(s, d, "documents").select("doc_id", similar.char_ngrams(F.concat("lang", "source")).alias("a"), similar.char_ngrams(F.col("source")).alias("b"))
    return w.select("doc_id", F.size("a").alias("n_grams"), similar.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query("""with p as (select o_orderkey, strftime(o_orderdate, '%Y/%m/%d') as day, strftime(o_orderdate::date + (o_orderkey % 500)::int, '%Y.%m.%d') as until, (o_orderkey % 4)::int as k from orders)
  select o_orderkey, case when k = 3 then '-' else day end as day, case when k < 2 or k = 2 then day end as start_text, case when k = 0 then replace(until, '.', '/') when k = 2 then day end as end_text,
    k = 0 and day <= '1996/01/01' and replace(until, '.', '/') >= '1996/01/01' or k = 2 and day = '1996/01/01' as is_current from p""")  # fmt: skip
def scalar_dates(s, d):
    o = read(s, d, "orders").withColumn("k", F.col("o_orderkey") % 4)
    day = F.date_format("o_orderdate", "yyyy/M/d")
    until = F.date_format(F.expr("date_add(to_date(o_orderdate), cast(o_orderkey % 500 as int))"), "yyyy.MM.dd")
    text = F.when(F.col("k") == 0, F.concat(day, F.lit(" ~ "), until)).when(F.col("k") == 1, F.concat(day, F.lit("~"))).when(F.col("k") == 2, day).otherwise("2026/02/30")
    o = o.withColumn("p", V.parse_period(text)).withColumn("day", V.format_date(V.parse_date(F.when(F.col("k") < 3, day).otherwise("2026/02/30"))))
    show = lambda c: F.date_format(c, "yyyy/MM/dd")
    return o.select("o_orderkey", "day", show(F.col("p.start")).alias("start_text"), show(F.col("p.end")).alias("end_text"), V.is_current(F.lit("1996-01-01").cast("date"), F.col("p.start"), F.col("p.end")).alias("is_current"))


@query(f"""select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity as score, (l_suppkey % 7)::double as max, case when l_suppkey % 7 > 0 then round_even(l_quantity / (l_suppkey % 7) * 100, 1) end as rate,
  {pct_sql('l_quantity', '(l_suppkey % 7)')} as rate_text from lineitem""")
def scalar_numbers(s, d):
    l = read(s, d, "lineitem").withColumn("p", V.parse_score(F.concat(F.lit("got "), F.col("l_quantity").cast("int").cast("string"), F.lit(" ／ "), (F.col("l_suppkey") % 7).cast("string"), F.lit(" pts"))))
    return l.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "p.score", "p.max", "p.rate", V.pct_text(F.col("p.score"), F.col("p.max")).alias("rate_text"))


@query(r"""select c_custkey, 'customer' || right(c_name, 4) as name, lower(regexp_replace(c_name, '\s', '', 'g')) as matched, c_custkey % 5 = 0 as blank, n_name as branch, length(regexp_replace(c_name, '[\s#]', '', 'g'))::int as n_effective,
  c_custkey % 6 = 0 as demo, c_custkey::varchar as id, c_name as id_name, case when c_custkey % 3 = 0 then 'DELAY' else 'OK' end as flag, case when c_custkey % 2 = 0 then 'b ' || c_custkey end as told, 'a' || chr(10) || 'b' || c_custkey as clean
  from customer join nation on c_nationkey = n_nationkey""")
def scalar_text(s, d):
    c = read(s, d, "customer").join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    both = X.split_id_name(F.concat(key.cast("string"), F.lit(" "), F.col("c_name")), detail=True)
    flag = X.split_flag_from_name(F.concat(F.col("c_name"), F.when(key % 3 == 0, "[late]").otherwise("")), "[late]", "DELAY")
    return c.select(
        "c_custkey", X.normalize_text(F.concat(F.lit(" 　customer"), F.right("c_name", F.lit(4)), F.lit("\t"))).alias("name"), X.normalize_for_match(F.col("c_name")).alias("matched"),
        X.is_blank_or_placeholder(F.when(key % 10 == 0, " N／A ").when(key % 5 == 0, "　").otherwise(F.col("c_name")), ["n/a", "-"]).alias("blank"), X.clean_branch_name(F.concat(F.lit("ACME "), F.col("n_name"), F.lit(" Acme")), "acme").alias("branch"),
        X.count_effective_chars(F.col("c_name")).alias("n_effective"), X.is_demo_name(F.when(key % 6 == 0, "demo taro").when(key % 6 == 1, "demographic x").otherwise(F.col("c_name")), "demo", "demotaro").alias("demo"),
        both["id"].alias("id"), both["name"].alias("id_name"), flag["flag"].alias("flag"),
        X.labelled_line(F.concat(F.lit("test: a\ntest："), F.when(key % 2 == 0, F.concat(F.lit("b "), key.cast("string"))).otherwise(" ")), "test").alias("told"), X.strip_control_chars(F.concat(F.lit("a\x01\n\x1fb"), key.cast("string"))).alias("clean"),
    )


@query(roles.SQL + "select page_key, case when row_index % 2 = 0 then 'http://x/' || page_key else page_key end as own_key, case when page_index > 1 then page_index else 1 end as page_from_key from overview")
def scalar_keys(s, d):
    o = roles.overview(s, d)
    url = F.when(F.col("row_index") % 2 == 0, F.concat(F.lit("http://x/"), F.col("page_key"))).otherwise("")
    return o.select("page_key", K.page_key(url, F.col("page_key")).alias("own_key"), K.page_index_from_key(F.col("page_key")).alias("page_from_key"))


@query("""select event_id, coalesce(nullif(event_type, 'click'), '-') as filled, (event_id % 3)::int as n_items, case when event_id % 3 = 0 then 'a' when event_id % 3 = 1 then 'b' else '-' end as active, event_id % 3 < 2 as any_on from events""")
def scalar_json(s, d):
    e = read(s, d, "events")
    k = F.col("event_id") % 3
    listed = F.when(k == 1, '["x"]').when(k == 2, '["x", "y"]').otherwise("not json")
    checks = X.json_bool_map(F.when(k == 0, '{"a": true, "b": false}').when(k == 1, '{"a": false, "b": true}').otherwise("{"))
    return e.select(
        "event_id", X.fill_missing(F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))).alias("filled"), F.size(X.json_list(listed)).alias("n_items"),
        F.array_join(X.active_targets(checks), ",").alias("active"), F.exists(F.map_values(checks), lambda v: v).alias("any_on"),
    )
