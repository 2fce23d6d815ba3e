"""Registered queries on sections, rules, HTML round trips, keyed state and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.text import clean_branch_name
from quillspan.operators import events as EV
from quillspan.operators import rules, sections, state
from quillspan.operators import progress as P
from quillspan.plans import html_roles, jobs, reports, roles
from quillspan.plans.queries import _FINDINGS, _PROGRESS, _UNITS, query
from quillspan.plans.roles import read
from quillspan.schemas import PAGES, STORE
from quillspan.sources import html as H
from quillspan.sources.keyed import KeyedTable
from quillspan.sources.scratch import scratch, written
from quillspan.sources.store import publish_reports, read_store, watched, write_bucketed, write_store
from quillspan.streaming.upserts import Snapshots, page_updates, stream_events, stream_merge, stream_parsed

_SECTIONS = (
    "with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents where text is not null), "
    + "h as (select doc_id, i, case when i = 0 then '' else [" + ", ".join(f"'{roles.ALIASES[h]}'" for h in roles.HEADS) + "][(case when i % 2 = 1 then i else i - 1 end) % 9 + 1] end as name, "
    + "case when i % 2 = 1 then trim(line, ' ' || chr(9)) else rtrim(line, ' ' || chr(9)) end as body from l), "
    + "s as (select doc_id, name, string_agg(body, chr(10) order by i) as text from h where trim(body, ' ' || chr(9)) <> '' group by all)"
)


def _long(df: DataFrame) -> DataFrame:
    named = df.select("doc_id", F.explode("sections").alias("name", "text"))
    return named.unionByName(df.where("size(unclassified) > 0").select("doc_id", F.lit("").alias("name"), F.array_join("unclassified", "\n").alias("text")))


@query(_SECTIONS + " select doc_id, name, text from s")
def sections_windowed(s, d):
    return _long(sections.split_sections(roles.notes(s, d), "doc_id", "text", roles.ALIASES))


@query(_SECTIONS + " select doc_id, name, text from s")
def sections_in_place(s, d):
    return _long(roles.notes(s, d).select("doc_id", sections.sections_column(F.col("text"), roles.ALIASES).alias("x")).select("doc_id", "x.*"))


_NAMES = ("author", "textbook", "plan", "student", "test", "homework", "school", "count", "goal")
_BLANK = "(lower(regexp_replace(m_{0}, '\\s', '', 'g')) in ('', '-', 'none', 'n/a'))"
_EFFECTIVE = "length(regexp_replace({0}, '[\\s・,.:;!?_*#=~\"''()\\[\\]<>|/-]', '', 'g'))"


def _rule_sql() -> str:
    blank = {n: _BLANK.format(n) for n in _NAMES}
    errors = [(f"{n}_missing", blank[n]) for n in _NAMES[:6]]
    errors.append(("textbook_status", f"not {blank['textbook']} and (contains(m_textbook, 'ion') or contains(m_textbook, 'unknown') or not (contains(m_textbook, 'the') or contains(m_textbook, 'and')))"))
    errors += [(f"{n}_short", f"not {blank[n]} and {_EFFECTIVE.format('m_' + n)} < {k}") for n, k in (("plan", 5), ("student", 3))]
    errors += [("school_last_year", f"{blank['school']} and g = 12"), ("school_public", f"{blank['school']} and g = 9 and pub"), ("school_exam", f"{blank['school']} and g = 6 and not pub")]
    errors.append(("course_count", f"seasonal and {blank['count']}"))
    doubt = f"(not {blank['school']} and (contains(m_school, 'ion') or contains(m_school, 'unknown')))"
    no_type, goal = f"(not {blank['school']} and not {doubt} and not contains(m_school, 'th'))", f"(seasonal and {blank['goal']})"
    listed = lambda xs: "list_filter([" + ", ".join(f"case when {c} then '{i}' end" for i, c in xs) + "], lambda x: x is not null)"
    has = lambda i, fix, of="errors": f"case when list_contains({of}, '{i}') then '{fix}' end"
    fixes = ", ".join([*(has(f"{n}_missing", f"add the section {n}") for n in _NAMES[:6]), has("textbook_status", "state how far the textbook is"), *(has(f"{n}_short", f"write more on {n}") for n in ("plan", "student")),
        "case when list_has_any(errors, ['school_last_year', 'school_public', 'school_exam']) then 'name the school' end", has("school_uncertain", "settle the school", "reviews"), has("course_count", "state the number of lessons")])
    pivot = ", ".join(f"coalesce(max(text) filter (name = '{n}'), '') as m_{n}" for n in _NAMES)
    return (
        _SECTIONS + f", m as (select doc_id, {pivot}, coalesce(max(1) filter (name = ''), 0) = 1 as loose from s group by 1), "
        "k as (select d.doc_id, coalesce(loose, false) as loose, " + ", ".join(f"coalesce(m_{n}, '') as m_{n}" for n in _NAMES) + ", d.doc_id % 4 * 3 + 3 as g, d.doc_id % 2 = 0 as pub, d.doc_id % 7 = 0 as seasonal, trim(regexp_replace(text, '\\s', '', 'g')) = '' as none from documents d left join m using (doc_id) where text is not null), "
        f"e as (select doc_id, none, loose, {listed(errors)} as errors, {listed([('school_uncertain', doubt)])} as reviews, {listed([('school_no_type', no_type), ('course_goal', goal)])} as w from k), "
        "f as (select *, case when loose and len(errors) + len(reviews) + len(w) > 0 then list_append(w, 'unclassified') when loose then ['unclassified_info'] else w end as warnings from e) "
        "select doc_id, case when none then 'blank' else array_to_string(errors, ',') end as errors, case when none then '' else array_to_string(reviews, ',') end as reviews, case when none then '' else array_to_string(warnings, ',') end as warnings, "
        "case when none then 'write a text' else array_to_string(list_filter([" + fixes + "], lambda x: x is not null), ',') end as fix_items, "
        "case when none then 'CRITICAL' when len(errors) > 0 then 'ERROR' when len(reviews) > 0 then 'REVIEW' when len(warnings) > 0 then 'WARNING' else 'PASS' end as severity from f"
    )


@query(_rule_sql())
def note_rules(s, d):
    n = roles.notes(s, d).withColumn("x", sections.sections_column(F.col("text"), roles.ALIASES)).select("*", "x.*")
    n = rules.section_facts(n, "sections", roles.WORDS, plain="plain")
    own = rules.section_rules(F.col("facts"), F.col("unclassified"), F.col("grade"), F.col("course"), F.col("division"), roles.WORDS, {"plan": 5, "student": 3})
    return rules.evaluate_rules(n, own, "text").select("doc_id", *(F.array_join(c, ",").alias(c) for c in ("errors", "reviews", "warnings", "fix_items")), "severity")


#: The demo student of the listing.
DEMO = "Customer#000000001"


@query(roles.SQL + f"""select * from (select page_index, (row_number() over (partition by page_index order by row_index) - 1)::int as row_index, grade, division, subject, student_id, student_name, '/detail?k=' || page_key as detail_url from overview) where student_name <> '{DEMO}'""")
def html_listing(s, d):
    parsed = H.parse_list_pages(html_roles.listing_pages(roles.overview(s, d)), demo=(DEMO, ""))
    return parsed.select("page_index", "row_index", "grade", "division", "subject", "student_id", "student_name", "detail_url")


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return H.parse_detail_pages(html_roles.detail_pages(roles.overview(s, d), roles.targets(s, d), roles.units(s, d)))


@query(roles.SQL + "select page_key, (seq - 1)::int as seq, target_no, target_name, strftime(start_date, '%Y/%m/%d') as start_text, strftime(end_date, '%Y/%m/%d') as end_text, is_current, progress_delay, target_score, coalesce(current_score, '') as current_score from targets")
def html_targets(s, d):
    t = H.explode_targets(_parsed(s, d), F.lit("1996-01-01").cast("date"))
    return t.select("page_key", "seq", "target_no", "target_name", *(F.date_format(f"{x}_date", "yyyy/MM/dd").alias(f"{x}_text") for x in ("start", "end")), "is_current", "progress_delay", "target_score", "current_score")


@query(roles.SQL + "select page_key, student_id, grade, 'Writer: ' || student_name || chr(10) || 'Test: ok' as note, 'a,b' as materials, '' as error from overview")
def html_info(s, d):
    return _parsed(s, d).select("page_key", F.element_at("info", "student").alias("student_id"), F.element_at("info", "grade").alias("grade"), "note", F.array_join("materials", ",").alias("materials"), F.coalesce("error", F.lit("")).alias("error"))


@query(roles.SQL + "select page_key, row_no, unit_name, textbook, strftime(exec_date, '%Y/%m/%d') as exec_text, score, round_even(score / 50 * 100, 1) as score_rate, middle_unit, problem_code, division_text, confirm_test, coalesce(today_textbook, '') as today_textbook, t1, t2, t3 from units")
def html_units(s, d):
    u = H.explode_units(_parsed(s, d))
    return u.select("page_key", "row_no", "unit_name", "textbook", F.date_format("exec_date", "yyyy/MM/dd").alias("exec_text"), "score", "score_rate", "middle_unit", "problem_code", "division_text", "confirm_test", F.coalesce("today_textbook", F.lit("")).alias("today_textbook"), *(F.element_at("target_checks", k).alias(k.lower()) for k in ("T1", "T2", "T3")))


@query(roles.SQL + "select page_key, classroom from overview")
def html_label_value(s, d):
    o = roles.overview(s, d)
    card = F.concat(F.lit("<table><tr><th>Day</th><td>x</td></tr></table><table class=card><tr><th>Room name</th><td>ACME "), F.col("classroom"), F.lit("</td></tr></table>"))
    return o.select("page_key", clean_branch_name(H.label_value(card, "Room", "card"), "acme").alias("classroom"))


@query(roles.SQL + "select page_key, subject, case when order_key % 2 = 0 then coalesce(nullif(classroom, ''), null) else classroom end as classroom, case when order_key % 4 = 0 then grade else grade end as grade from overview")
def completed_overview(s, d):
    o = roles.overview(s, d)
    listing = o.select("page_key", "subject", F.when(F.col("order_key") % 2 == 0, F.nullif("classroom", F.lit(""))).otherwise(F.col("classroom")).alias("classroom"), F.when(F.col("order_key") % 4 == 0, "").otherwise(F.col("grade")).alias("grade"))
    return H.complete_overview(listing, o.select("page_key", "grade", F.lit("other").alias("classroom")), "page_key")


def _pages(s: SparkSession, d: str) -> DataFrame:
    """A page for each customer, in one of four states."""
    c, k = read(s, d, "customer"), F.col("c_custkey")
    states = F.element_at(F.array(*map(F.lit, ("unfetched", "fetch_failed", "fetched", "saved"))), (k % 4 + 1).cast("int"))
    own = {"page_key": k.cast("string"), "student_name": F.col("c_name"), "classroom": F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")), "grade": F.when(k % 5 == 0, "").otherwise("g"), "status": states, "html": F.when(k % 8 == 3, "old"), "retries": (k % 3).cast("int"), "row_index": F.lit(1)}
    return c.select(*(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PAGES.fields))


_PAGES = """with pages as (select c_custkey as k, c_custkey::varchar as page_key, c_name as student_name, case when c_custkey % 3 = 0 then '' else c_mktsegment end as classroom, case when c_custkey % 5 = 0 then '' else 'g' end as grade,
  ['unfetched', 'fetch_failed', 'fetched', 'saved'][(c_custkey % 4 + 1)::int] as status, case when c_custkey % 8 = 3 then 'old' end as html, (c_custkey % 3)::int as retries from customer)"""


@query(_PAGES + """, l as (select user_id::varchar as page_key, arg_max(event_type, (ts, event_id)) as student_name from events group by 1)
  select page_key, case when l.student_name is not null and coalesce(status, 'unfetched') in ('unfetched', 'fetch_failed') then l.student_name else p.student_name end as student_name, coalesce(status, 'unfetched') as status, coalesce(retries, 0) as retries
  from pages p full join l using (page_key)""")  # fmt: skip
def state_register(s, d):
    e = read(s, d, "events").select(F.col("user_id").cast("string").alias("page_key"), *(F.col("event_type").alias(c) if c == "student_name" else F.lit(None).cast(PAGES[c].dataType).alias(c) for c in state.LISTED), "ts", "event_id")
    return state.register(_pages(s, d), e, ["ts", "event_id"]).select("page_key", "student_name", "status", "retries")


@query(_PAGES + """, u as (select user_id::varchar as page_key, arg_max(props, (ts, event_id)) as new from events where event_type in (select min(event_type) from events) group by 1)
  select page_key, case when new is null then html when status = 'saved' then coalesce(html, new) else new end as html, case when new is not null and status <> 'saved' then 'fetched' else status end as status from pages left join u using (page_key)""")  # fmt: skip
def state_fetched(s, d):
    e = read(s, d, "events")
    first = e.agg(F.min("event_type").alias("event_type"))
    u = e.join(F.broadcast(first), "event_type", "left_semi").select(F.col("user_id").cast("string").alias("page_key"), F.col("props").alias("html"), F.col("ts").alias("fetched_at"), "event_id")
    return state.apply_fetched(_pages(s, d), u, ["fetched_at", "event_id"]).select("page_key", "html", "status")


@query(_PAGES + """, u as (select user_id::varchar as page_key, arg_max(event_type, (ts, event_id)) as error, count(*)::int as n from events where value > 50 group by 1)
  select page_key, case when n is null then status else 'fetch_failed' end as status, error, (retries + coalesce(n, 0))::int as retries from pages left join u using (page_key)""")  # fmt: skip
def state_failed(s, d):
    u = read(s, d, "events").where("value > 50").select(F.col("user_id").cast("string").alias("page_key"), F.col("event_type").alias("error"), "ts", "event_id")
    return state.apply_failed(_pages(s, d), u, ["ts", "event_id"]).select("page_key", "status", "error", "retries")


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, max(event_id) filter (true) is not null as any_event from events group by 1")
def state_last_update(s, d):
    return state.last_of(read(s, d, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", F.col("event_id").isNotNull().alias("any_event"))


@query(_PAGES + """, o as (select o_orderkey, o_custkey as k, o_custkey::varchar as page_key from orders),
  t as (select page_key, 'T' || (o_orderkey % 3) as target_no, case when k % 2 = 0 then 'new' else 'old' end as target_name from o)
  select 'target' as kind, page_key, target_no || '/' || target_name as what from t
  union all select 'page', page_key, case when k % 2 = 0 and k in (select k from o) then 'saved' else status end || '/' || case when k % 2 = 0 and k in (select k from o) and k % 6 <> 0 then 'room' else classroom end from pages""")  # fmt: skip
def state_saved(s, d):
    o = read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("page_key"), F.concat(F.lit("T"), F.col("o_orderkey") % 3).alias("target_no"), F.col("o_custkey").alias("k"))
    empty = state.empty_store(s)
    cols = ["page_key", "target_no", "target_name"]
    old = o.withColumn("target_name", F.lit("old")).select(*cols)
    store = {**empty, "pages": _pages(s, d), "targets": old}
    even = o.where("k % 2 = 0")
    parsed = {"pages": even.select("page_key", F.when(F.col("k") % 3 == 0, "-").otherwise("room").alias("classroom")).distinct(), "targets": even.withColumn("target_name", F.lit("new")).select(*cols)}
    out = state.save_parsed(store, parsed)
    t = out["targets"].select(F.lit("target").alias("kind"), "page_key", F.concat_ws("/", "target_no", "target_name").alias("what"))
    return t.unionByName(out["pages"].select(F.lit("page").alias("kind"), "page_key", F.concat_ws("/", "status", "classroom").alias("what")))


@query(roles.SQL + "select page_key, target_no, units, executed, on_time, before, after, not_executed from progress")
def repaired_progress(s, d):
    """Saved pages parsed anew and counted: the repair job's chain from HTML to progress."""
    parsed = written(_parsed(s, d), "parsed")  # read twice below
    t = H.explode_targets(parsed, F.lit("1996-01-01").cast("date"))
    return P.target_progress(t, H.explode_units(parsed)).select("page_key", "target_no", "units", "executed", "on_time", "before", "after", "not_executed")


@query(_PAGES + """, e as (select user_id::varchar as page_key, event_id, case when event_type in (select min(event_type) from events) then 'fetched' when event_type in (select max(event_type) from events) and user_id % 5 > 0 then 'failed' end as kind from events),
  u as (select page_key, arg_max(kind, event_id) as last, count(*) filter (kind = 'failed')::int as failures from e where kind is not null group by 1)
  select page_key, case last when 'fetched' then case when status = 'saved' and failures = 0 then 'saved' else 'fetched' end when 'failed' then 'fetch_failed' else status end as status, (retries + coalesce(failures, 0))::int as retries from pages left join u using (page_key)""")  # fmt: skip
def stream_updates(s, d):
    """The events as a stream of updates, merged batch by batch; the result is that of one batch.

    Every fifth user has no failures: a saved page that was only fetched again stays saved; one that failed
    before is fetched.
    """
    e = read(s, d, "events")
    kinds = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    stream = s.readStream.schema(e.schema).parquet(_stream_path(s, d, e))
    u = stream.select(
        F.when(F.col("event_type") == kinds["a"], "fetched").when((F.col("event_type") == kinds["b"]) & (F.col("user_id") % 5 > 0), "failed").alias("kind"), F.col("user_id").cast("string").alias("page_key"),
        F.col("props").alias("html"), F.col("ts").alias("at"), F.col("event_type").alias("error"), F.col("event_id").alias("seq"),
    )
    start = _pages(s, d)
    snap = Snapshots(s, scratch(s, "snapshots"), s.createDataFrame([], PAGES))
    snap.write(-1, start)
    stream_merge(u, snap, page_updates, scratch(s, "offsets"), good="kind is not null").awaitTermination()
    return snap.read().select("page_key", "status", "retries")


def _stream_path(s: SparkSession, d: str, e: DataFrame) -> str:
    """A folder with the events in files, as a stream source needs one."""
    path = scratch(s, "events")
    e.write.parquet(path)
    return path


_KEPT_PAGES = "overview where order_key % 3 > 0"


def _store(s: SparkSession, d: str, targets: DataFrame | None = None) -> dict[str, DataFrame]:
    """The role tables as a store: pages of every third order are fetched and not parsed, all others saved with their rows."""
    o = roles.overview(s, d)
    waiting = F.col("order_key") % 3 == 0
    own = {"status": F.when(waiting, "fetched").otherwise("saved"), "retries": F.lit(0), "detail_url": F.lit("")}
    saved = o.where(~waiting)
    o = html_roles.detail_pages(o, roles.targets(s, d), roles.units(s, d), keep=tuple(o.columns)).withColumns(own)
    typed = lambda df, name: df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORE[name].fields))
    t, u = (roles.targets(s, d) if targets is None else targets).where(~waiting), roles.units(s, d, saved)
    return {"pages": typed(o, "pages"), "targets": typed(t, "targets"), "units": typed(u, "units"), "progress": typed(P.target_progress(t, u), "progress"), "findings": typed(roles.findings(s, d, saved), "findings")}


@query(roles.SQL + """select 'page' as kind, page_key, 'saved' as what from overview union all select 'target', page_key, target_no || '/' || target_name || '/' || progress_delay from targets
  union all select 'unit', page_key, row_no || '/' || unit_name from units union all select 'progress', page_key, target_no || '/' || units || '/' || on_time || '/' || after from progress""")  # fmt: skip
def repair_job(s, d):
    """The job itself on a store with pages that were fetched and never parsed, and with rows of a page that is gone."""
    store = _store(s, d)
    lost = store["units"].limit(1).withColumn("page_key", F.lit("gone"))
    out, _ = jobs.repair({**store, "units": store["units"].unionByName(lost)}, F.lit(roles.TODAY).cast("date"), roles.ALIASES, roles.WORDS, {"plan": 5, "student": 3})
    row = lambda name, kind, *cols: out[name].select(F.lit(kind).alias("kind"), "page_key", F.concat_ws("/", *cols).alias("what"))
    found = [row("pages", "page", "status"), row("targets", "target", "target_no", "target_name", "progress_delay"), row("units", "unit", "row_no", "unit_name"), row("progress", "progress", "target_no", "units", "on_time", "after")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(roles.SQL + "select page_key, row_no, unit_name, strftime(exec_date, '%Y/%m/%d') as exec_text, score, t1 from units where page_key in (select page_key from " + _KEPT_PAGES + ")")
def store_round_trip(s, d):
    place = scratch(s, "store")
    write_store(_store(s, d), place)
    return read_store(s, place)["units"].select("page_key", "row_no", "unit_name", F.date_format("exec_date", "yyyy/MM/dd").alias("exec_text"), "score", F.element_at("target_checks", "T1").alias("t1"))


@query(roles.SQL + _FINDINGS)
def published_findings(s, d):
    place = publish_reports({"findings": reports.report_findings(roles.findings(s, d), roles.overview(s, d))}, scratch(s, "reports"), required=("findings",))
    return s.read.parquet(f"{place}/findings")


@query(roles.SQL + f"select * from ({_UNITS} where order_key % 3 > 0) where student_name <> '{DEMO}'")
def demo_excluded_units(s, d):
    return jobs.all_reports(_store(s, d), demo_full=DEMO)["units"]


@query(roles.SQL + roles.REPEATED + f"select * from ({_PROGRESS.replace('from progress', 'from rprogress')} where overview.order_key % 3 > 0)")
def repeated_target_report(s, d):
    """The whole report on pages that repeat a target's number: a row for each target and no more."""
    return jobs.all_reports(_store(s, d, roles.repeated_targets(s, d)))["progress"]


@query(roles.SQL + """, k as (select student_id, arg_min(classroom, (row_index, page_key)) as known from overview where classroom <> '' group by 1)
  select target_no, coalesce(known, 'unknown') as classroom, count(*) as n from progress join overview using (page_key) left join k using (student_id) where overview.order_key % 3 > 0 group by all""")  # fmt: skip
def backfilled_progress(s, d):
    return jobs.all_reports(jobs.backfill_classrooms(_store(s, d)))["progress"].groupBy("target_no", "classroom").agg(F.count(F.lit(1)).alias("n"))


@query(roles.SQL + "select page_key, 'saved' as status, (select count(*) from targets t where t.page_key = o.page_key)::int as n_targets, (select count(*) from units u where u.page_key = o.page_key)::int as n_units from overview o where order_key % 3 = 0")
def stream_parsed_pages(s, d):
    """Fetched pages as a stream, parsed and saved batch by batch."""
    waiting = _store(s, d)["pages"].where("status = 'fetched'")
    source = scratch(s, "fetched")
    waiting.repartition(3).write.parquet(source)
    snaps = {name: Snapshots(s, scratch(s, f"snap-{name}"), s.createDataFrame([], schema)) for name, schema in STORE.items()}
    snaps["pages"].write(-1, s.read.parquet(source))
    stream = s.readStream.schema(PAGES).option("maxFilesPerTrigger", 2).parquet(source)
    parse = lambda df: jobs.parsed_tables(df, F.lit(roles.TODAY).cast("date"), roles.ALIASES, roles.WORDS, {"plan": 5, "student": 3})
    stream_parsed(stream, snaps, parse, scratch(s, "offsets")).awaitTermination()
    count = lambda name: snaps[name].read().groupBy("page_key").agg(F.count(F.lit(1)).cast("int").alias(f"n_{name}"))
    out = snaps["pages"].read().select("page_key", "status").join(count("targets"), "page_key", "left").join(count("units"), "page_key", "left")
    return out.fillna(0, ["n_targets", "n_units"])


#: Events of three kinds by their number: every fourth of each, the rest is none; a parse knows a room two times in three, and every other one brings HTML.
_MIXED = """, e as (select user_id::varchar as page_key, event_id as seq, event_type, props, case when event_id % 4 = 0 then 'fetched' when event_id % 4 = 1 and user_id % 5 > 0 then 'failed' when event_id % 4 = 2 and user_id % 7 > 0 then 'parsed' end as kind,
    case when event_id % 3 = 0 then '-' else 'room ' || event_id end as room, case when event_id % 8 = 2 then 'p' || event_id end as own, case when event_id % 5 = 0 then '' else 'grade ' || event_id end as g from events),
  k as (select e.*, p.status as was, max(seq) filter (kind = 'failed') over before as f, max(seq) filter (kind = 'parsed') over before as q from e join pages p using (page_key) where kind is not null window before as (partition by page_key order by seq rows between unbounded preceding and 1 preceding)),
  h as (select *, case when f is null and q is null then coalesce(was = 'saved', false) else coalesce(q, -1) > coalesce(f, -1) end as saved from k),
  u as (select page_key, arg_max(kind, seq) as last, arg_max(saved, seq) as saved, arg_max(event_type, seq) as message, count(*) filter (kind = 'failed')::int as failures,
      arg_max(case when kind = 'fetched' then props else own end, seq) filter (kind = 'fetched' and not saved or kind = 'parsed' and own is not null) as html, arg_min(props, seq) filter (kind = 'fetched') as fill,
      arg_max(room, seq) filter (kind = 'parsed' and room <> '-') as room, arg_min(g, seq) filter (kind = 'parsed' and g <> '') as g from h group by 1)"""


@query(_PAGES + _MIXED + """
  select page_key, case last when 'failed' then 'fetch_failed' when 'parsed' then 'saved' when 'fetched' then case when u.saved then 'saved' else 'fetched' end else status end as status, case when last = 'failed' then message end as error,
    (retries + coalesce(failures, 0))::int as retries, coalesce(u.html, pages.html, u.fill) as html, coalesce(room, classroom) as classroom, case when grade <> '' then grade else coalesce(u.g, grade) end as grade from pages left join u using (page_key)""")  # fmt: skip
def replayed_events(s, d):
    """Fetched, failed and parsed events of a page, mixed and in order."""
    k, u = F.col("event_id"), F.col("user_id")
    kind = F.when(k % 4 == 0, "fetched").when((k % 4 == 1) & (u % 5 > 0), "failed").when((k % 4 == 2) & (u % 7 > 0), "parsed")
    e = read(s, d, "events").withColumns({"page_key": u.cast("string"), "seq": k, "k": kind, "error": F.col("event_type"), "classroom": F.when(k % 3 == 0, "-").otherwise(F.concat(F.lit("room "), k)), "grade": F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("grade "), k))})
    e = e.withColumn("html", F.when(F.col("k") == "fetched", F.col("props")).when(k % 8 == 2, F.concat(F.lit("p"), k)))
    mixed = [EV.as_events(e.where(F.col("k") == x).drop(*(["classroom", "grade"] if x != "parsed" else [])), x) for x in EV.KINDS]
    return EV.replay(_pages(s, d), mixed[0].unionByName(mixed[1]).unionByName(mixed[2])).select("page_key", "status", "error", "retries", "html", "classroom", "grade")


_STREAMED = """, e as (select user_id::varchar as page_key, event_id as seq, event_type, case when event_id % 3 = 0 then 'fetched' when event_id % 3 = 1 and user_id % 5 > 1 then 'failed' end as kind from events),
  u as (select page_key, arg_max(kind, seq) as last, max(seq) filter (kind = 'fetched') as f, max(seq) filter (kind = 'failed') as x, arg_max(event_type, seq) filter (kind = 'failed') as message, count(*) filter (kind = 'failed')::int as failures from e where kind is not null group by 1),
  r as (select page_key, status as was, retries, u.*, status <> 'saved' and f is not null as parsed, coalesce(status <> 'saved' and f % 4 = 0, false) as broken from pages left join u using (page_key))"""


@query(_PAGES + _STREAMED + """
  select page_key, case when last is null then was when last = 'failed' then 'fetch_failed' when broken then 'parse_failed' when parsed or failures = 0 then 'saved' else 'fetched' end as status,
    case when last = 'failed' then message when last = 'fetched' and broken then '0 of the page''s parts found' end as error, (retries + coalesce(failures, 0) + broken::int)::int as retries, case when parsed and not broken then 'u' || f else '' end as units from r""")  # fmt: skip
def stream_page_events(s, d):
    """A stream of fetches, some of pages that can't be parsed, and failures: status, message, retries and children.

    A page that is saved at the start is never parsed, only fetched again.
    """
    k, u = F.col("event_id"), F.col("user_id")
    grid = F.concat(F.lit("<table class=units><tr><th>Unit<th>T1<tr><td>u"), k, F.lit("<td><input checked></table>"))
    e = read(s, d, "events").withColumns({"page_key": u.cast("string"), "seq": k, "html": F.when(k % 4 == 0, "<p>sorry").otherwise(grid), "error": F.col("event_type"), "fetched_at": F.col("ts").cast("timestamp")})
    fetched, failed = EV.as_events(e.where(k % 3 == 0).drop("error"), "fetched"), EV.as_events(e.where((k % 3 == 1) & (u % 5 > 1)).drop("html", "fetched_at"), "failed")
    source = scratch(s, "page-events")
    fetched.unionByName(failed).coalesce(1).write.parquet(source)
    tables = {name: KeyedTable(s, scratch(s, f"keyed-{name}"), schema, buckets=8) for name, schema in STORE.items()}
    tables["pages"].merge(0, _pages(s, d), lambda old: _pages(s, d))
    # Batches are numbered from 0 by the stream; the start is there before the first.
    parse = lambda df: jobs.parsed_tables(df, F.lit(roles.TODAY).cast("date"), roles.ALIASES, roles.WORDS, {"plan": 5, "student": 3}, least_parts=1)
    stream_events(s.readStream.schema(EV.EVENTS).parquet(source), tables, parse, scratch(s, "offsets"), first=1).awaitTermination()
    units = tables["units"].read().groupBy("page_key").agg(F.array_join(F.array_sort(F.collect_list("unit_name")), ",").alias("units"))
    return tables["pages"].read().join(units, "page_key", "left").select("page_key", "status", "error", "retries", F.coalesce("units", F.lit("")).alias("units"))


@query(_PAGES + ", u as (select user_id::varchar as page_key, arg_max(event_type, (ts, event_id)) as error, count(*)::int as n from events where user_id % 50 = 1 group by 1) select page_key, case when n is null then status else 'fetch_failed' end as status, (retries + coalesce(n, 0))::int as retries from pages left join u using (page_key)")
def keyed_merge(s, d):
    """A merge of a few pages' failures into a table kept in hashed partitions."""
    table = KeyedTable(s, scratch(s, "keyed"), PAGES, buckets=16)
    table.merge(0, _pages(s, d), lambda old: _pages(s, d))
    u = read(s, d, "events").where("user_id % 50 = 1").select(F.col("user_id").cast("string").alias("page_key"), F.col("event_type").alias("error"), "ts", "event_id")
    for number in (1, 1):  # delivered again, it changes nothing
        table.merge(number, u, lambda old: state.apply_failed(old, u, ["ts", "event_id"]))
    return table.read().select("page_key", "status", "retries")


@query(roles.SQL + "select count(*) as n_rows, count(*) filter (units <> on_time + before + after + not_executed or executed <> on_time + before + after) as broken from progress")
def progress_watched(s, d):
    """The metric that a job looks at before it publishes progress, taken while the table is written."""
    own, seen = watched(P.target_progress(roles.targets(s, d), roles.units(s, d)), P.INCONSISTENT)
    own.write.parquet(scratch(s, "progress"))
    return s.createDataFrame([(seen.get["rows"], seen.get["broken"])], "n_rows long, broken long")


@query(roles.SQL + "select page_key, row_no, unit_name, student_id, classroom from units join overview using (page_key)")
def bucketed_units_with_page(s, d):
    """The join of units with their pages on tables bucketed by the page key."""
    store = {"pages": roles.overview(s, d), "units": roles.units(s, d).drop("target_checks")}
    kept = write_bucketed(store, f"quillspan_{uuid.uuid4().hex}", buckets=8)
    return reports.units_with_page(kept["units"], kept["pages"]).select("page_key", "row_no", "unit_name", "student_id", "classroom")


@query(roles.SQL + f"select *, row_number() over (order by page_index, row_index, page_key, row_no, target_no) - 1 as place from ({_UNITS.replace('select ', 'select page_index, row_index, page_key, row_no, ', 1)} where order_key % 3 > 0)".replace("select *, row_number", "select * exclude (page_index, row_index, page_key, row_no), row_number"))
def ordered_unit_report(s, d):
    """A published report read back file by file, with each row's place: page by page, in the order of its units."""
    place = publish_reports({"units": jobs.all_reports(_store(s, d), ordered=True)["units"]}, scratch(s, "reports"), required=("units",))
    own = s.read.parquet(f"{place}/units").select("*", "_metadata.file_name", "_metadata.row_index")
    sizes = own.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    first = sizes.select("file_name", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return own.join(first, "file_name").withColumn("place", F.col("first") + F.col("row_index")).drop("file_name", "row_index", "first")


@query(roles.SQL + """, t as (select upper(source) as author, regexp_replace(text, '\\s', '', 'g') as t, count(*) as copies from documents join overview on order_key = doc_id where student_name <> '""" + DEMO + """' group by all),
  g as (select author, t, copies, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) as g from t where length(t) >= 15),
  p as (select a.author, a.t as a, b.t as b, len(list_intersect(a.g, b.g)) as m, len(a.g) as x, len(b.g) as y from g a join g b on a.author = b.author and a.t < b.t and 5 * least(len(a.g), len(b.g)) >= 4 * greatest(len(a.g), len(b.g))),
  q as (select author, a, b from p where 5 * m >= 4 * (x + y - m)), e as (select author, a as t, b as o from q union all select author, b, a from q),
  n as (select e.author, e.t, sum(copies) as near from e join t on t.author = e.author and t.t = e.o group by all),
  f as (select t.author, t.t from t left join n using (author, t) where t.copies - 1 + coalesce(near, 0) >= 1 and length(t.t) >= 3)
  select page_key, f.t is not null and student_name <> '""" + DEMO + """' as copied from documents join overview on order_key = doc_id left join f on f.author = upper(source) and f.t = regexp_replace(text, '\\s', '', 'g')""")  # fmt: skip
def copies_flagged_in_store(s, d):
    """Copied notes as a step of a job: findings of the store with a warning, demo students left out; groups of two or more."""
    docs = read(s, d, "documents").select(F.col("doc_id").alias("order_key"), F.create_map(F.lit("author"), "source", F.lit("student"), "text").alias("sections"))
    o = roles.overview(s, d)
    f = docs.join(o.select("page_key", "order_key"), "order_key").drop("order_key")
    empty = {"severity": F.lit("PASS"), **{c: F.array().cast("array<string>") for c in ("errors", "warnings", "reviews", "fix_items", "unclassified")}}
    store = {**state.empty_store(s), "pages": o, "findings": f.withColumns(empty)}
    return jobs.flag_copies(store, least=2, demo_full=DEMO)["findings"].select("page_key", F.array_contains("warnings", "looks_copied").alias("copied"))
