"""Events in order, keyed tables, streams that resume, progress by target, groups of copies, checked and ordered publishing."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspan.operators import events as EV
from quillspan.operators import groups, progress, similar, state
from quillspan.plans import jobs, reports
from quillspan.schemas import PAGES, STORE
from quillspan.sources import store as S
from quillspan.sources.keyed import KeyedTable
from quillspan.sources.store import Inconsistent, publish_reports, read_store, write_bucketed, write_store
from quillspan.streaming.upserts import stream_events

WORDS = {n: [] for n in ("placeholder", "status", "uncertain", "school_type", "public", "exam", "seasonal")}
ALIASES = {"Writer": "author", "Student": "student"}
GRID = "<table class=student-info><tr><th>Grade<td>9<th>Name<td>Ann</table><table class=units><tr><th>Unit<th>T1<tr><td>{}<td><input checked></table>"


def pages(spark, *rows):
    names = [f.name for f in PAGES.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], PAGES)


def events(spark, *rows):
    names = [f.name for f in EV.EVENTS.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], EV.EVENTS)


def one_by_one(page, rows):
    """The rules, an event at a time."""
    p = dict(page)
    for e in rows:
        if e["kind"] == "fetched":
            if p["status"] != "saved":
                p |= {"status": "fetched", "html": e.get("html")}
            elif p["html"] is None:
                p["html"] = e.get("html")
            p["error"] = None
        elif e["kind"] == "failed":
            p |= {"status": e.get("status") or "fetch_failed", "error": e.get("error"), "retries": p["retries"] + 1}
        else:
            p |= {"status": "saved", "error": None, "html": e.get("html") or p["html"]}
            if (e.get("classroom") or "").strip() not in ("", "-"):
                p["classroom"] = e["classroom"]
            for c in ("grade", "subject"):
                if not (p[c] or "").strip() and (e.get(c) or "").strip():
                    p[c] = e[c]
    return p


def test_replay_is_one_event_at_a_time(spark):
    r = random.Random(3)
    start = [{"page_key": f"p{i}", "status": r.choice([None, "unfetched", "fetched", "saved", "fetch_failed"]), "html": r.choice([None, "old"]), "retries": i % 3, "grade": r.choice(["", None, "g"]), "subject": "", "classroom": "c", "error": "was"} for i in range(60)]
    rows = []
    for n in range(500):
        kind = r.choice(["fetched", "failed", "parsed"])
        row = {"page_key": f"p{r.randrange(70)}", "seq": n // 2, "step": n % 2, "kind": kind}
        if kind == "fetched":
            row["html"] = r.choice([None, f"h{n}"])
        elif kind == "failed":
            row |= {"error": f"e{n}", "status": r.choice([None, "parse_failed"])}
        else:
            row |= {"html": r.choice([None, "", f"q{n}"]), "classroom": r.choice(["", "-", f"r{n}"]), "grade": r.choice([None, " ", f"g{n}"]), "subject": f"s{n}"}
        rows.append(row)
    shuffled = r.sample(rows, len(rows)) + [{"page_key": None, "seq": 1, "kind": "failed"}, {"page_key": "p1", "seq": 1, "kind": "other"}]
    got = {x.page_key: x for x in EV.replay(pages(spark, *start), events(spark, *shuffled)).collect()}
    assert len(got) == len(start)
    for page in start:
        want = one_by_one(page, [e for e in rows if e["page_key"] == page["page_key"]])
        own = got[page["page_key"]].asDict()
        assert {k: own[k] for k in want} == want, page
    # Cut into batches anywhere, the events give the same.
    first, rest = [e for e in rows if e["seq"] < 90], [e for e in rows if e["seq"] >= 90]
    twice = EV.replay(EV.replay(pages(spark, *start), events(spark, *first)), events(spark, *rest))
    assert {x.page_key: x for x in twice.collect()} == got


def test_replaced_children(spark):
    e = events(spark, {"page_key": "a", "seq": 1, "step": 1, "kind": "parsed"}, {"page_key": "a", "seq": 3, "step": 1, "kind": "parsed"}, {"page_key": "b", "seq": 2, "kind": "fetched"})
    old = spark.createDataFrame([("a", 7), ("b", 8)], "page_key string, row_no int")
    new = spark.createDataFrame([("a", 1, 1, 1), ("a", 2, 3, 1), ("a", 3, 3, 1), ("b", 9, 2, 1)], "page_key string, row_no int, event_seq long, event_step int")
    assert sorted((r.page_key, r.row_no) for r in EV.replaced(old, new, e).collect()) == [("a", 2), ("a", 3), ("b", 8)]


def files(path):
    return {(p.parent.name, p.name): p.stat().st_mtime_ns for p in path.glob("rows/bucket=*/*.parquet")}


def test_keyed_table_rewrites_touched_partitions_only(spark, tmp_path, monkeypatch):
    schema = "page_key string, n int"
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(200)], schema)
    table = KeyedTable(spark, str(tmp_path / "t"), rows.schema, buckets=16)
    assert table.read().count() == 0 and table.done() == -1
    table.merge(0, rows, lambda old: rows)
    before = files(tmp_path / "t")
    some = rows.where("page_key in ('k3', 'k77')")
    plus = lambda old: old.withColumn("n", F.when(F.col("page_key").isin("k3", "k77"), F.col("n") + 1000).otherwise(F.col("n")).cast("int"))
    for _ in range(2):  # delivered twice
        table.merge(1, some, plus)
    after = files(tmp_path / "t")
    touched = {f"bucket={r[0]}" for r in some.select(table.bucket()).distinct().collect()}
    assert 1 <= len(touched) <= 2 and {k: v for k, v in after.items() if k[0] not in touched} == {k: v for k, v in before.items() if k[0] not in touched}
    assert not {k for k in after if k[0] in touched} & set(before)
    want = {f"k{i}": i + 1000 * (i in (3, 77)) for i in range(200)}
    assert {r.page_key: r.n for r in table.read().collect()} == want
    # Broken off when the rows were complete: the next reader puts them in. A partition that is left without rows goes.
    gone = rows.where(table.bucket() == int(next(iter(touched)).split("=")[1]))
    left = {k: v for k, v in want.items() if k not in {r.page_key for r in gone.collect()}}
    monkeypatch.setattr(KeyedTable, "_put", lambda self, n: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.merge(2, gone, lambda old: old.where("false"))
    monkeypatch.undo()
    assert {r.page_key: r.n for r in table.read().collect()} == left and table.done() == 2
    # Broken off before: what is half written goes, and the merge is done anew.
    stage = tmp_path / "t" / "_merges" / "stage-3" / "rows"
    stage.mkdir(parents=True)
    table.merge(3, gone.limit(1), lambda old: gone.limit(1))
    assert table.read().count() == len(left) + 1 and not (tmp_path / "t" / "_merges" / "stage-3").exists()


def test_stream_resumes_and_keeps_failures(spark, tmp_path):
    tables = {name: KeyedTable(spark, str(tmp_path / name), schema, buckets=4) for name, schema in STORE.items()}
    start = pages(spark, *({"page_key": k, "status": "unfetched", "retries": 0, "grade": ""} for k in "abcd"))
    tables["pages"].merge(0, start, lambda old: start)
    batches = [
        [("a", 1, "fetched", GRID.format("u1")), ("b", 2, "fetched", "<p>login</p>"), ("c", 3, "failed", None), (None, 4, "fetched", "x")],
        [("a", 5, "fetched", GRID.format("again")), ("b", 6, "fetched", GRID.format("u6")), ("c", 7, "failed", None), ("a", 8, "other", None)],
        [("c", 9, "fetched", GRID.format("old")), ("c", 10, "fetched", GRID.format("u10")), ("d", 11, "fetched", "<p>"), ("d", 12, "failed", None)],
    ]
    source = tmp_path / "in"
    parsed = []

    def parse(df):
        parsed.append(sorted(r.page_key for r in df.select("page_key").collect()))
        return jobs.parsed_tables(df, F.lit("2026-01-10").cast("date"), ALIASES, WORDS, {}, least_parts=1)

    run = lambda files: stream_events(spark.readStream.schema(EV.EVENTS).option("maxFilesPerTrigger", files).parquet(str(source)), tables, parse, str(tmp_path / "cp"), str(tmp_path / "bad"), first=1).awaitTermination()
    for rows in batches:
        events(spark, *({"page_key": k, "seq": n, "kind": kind, "html": h, "error": f"e{n}" if kind == "failed" else None} for k, n, kind, h in rows)).coalesce(1).write.mode("append").parquet(str(source))
        run(1)
    assert [p for p in parsed if p] == [["a", "b"], ["b"], ["c", "d"]]  # a was saved: fetched again, not parsed again
    got = {r.page_key: (r.status, r.error, r.retries, r.grade, r.student_name) for r in tables["pages"].read().collect()}
    assert got == {"a": ("saved", None, 0, "9", "Ann"), "b": ("saved", None, 1, "9", "Ann"), "c": ("saved", None, 2, "9", "Ann"), "d": ("fetch_failed", "e12", 2, "", None)}
    assert sorted((r.page_key, r.unit_name) for r in tables["units"].read().collect()) == [("a", "u1"), ("b", "u6"), ("c", "u10")]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2
    run(9)
    assert {r.page_key: (r.status, r.error, r.retries, r.grade, r.student_name) for r in tables["pages"].read().collect()} == got


def test_repair_keeps_parse_failures(spark):
    store = {**state.empty_store(spark), "pages": pages(spark, {"page_key": "a", "status": "fetched", "retries": 1, "html": GRID.format("u") + " " * 300, "grade": "", "student_name": "Bob"}, {"page_key": "b", "status": "fetched", "retries": 1, "html": "x" * 300})}
    from unittest import mock

    real = jobs.H.parse_detail_pages
    with mock.patch.object(jobs.H, "parse_detail_pages", lambda df, **k: real(df, **k).withColumn("error", F.when(F.col("page_key") == "b", "bad page").otherwise(F.col("error")))):
        out, gone = jobs.repair(store, F.lit("2026-01-10").cast("date"), ALIASES, WORDS, {})
        again, _ = jobs.repair(out, F.lit("2026-01-10").cast("date"), ALIASES, WORDS, {})
        for s in (out, again):
            assert {(r.page_key, r.status, r.error, r.retries, r.grade, r.student_name) for r in s["pages"].collect()} == {("a", "saved", None, 1, "9", "Bob"), ("b", "parse_failed", "bad page", 2, None, None)}
    assert [(r.page_key, r.error) for r in gone["errors"].collect()] == [("b", "bad page")]


def test_progress_counts_by_target(spark):
    targets = spark.createDataFrame([("p", 0, "T1", "2024-01-01", "2024-01-31"), ("p", 1, "T1", "2024-02-01", "2024-02-28"), ("p", 2, "T2", None, None)], "page_key string, seq int, target_no string, start_date string, end_date string").withColumns({c: F.to_date(c) for c in ("start_date", "end_date")})
    units = spark.createDataFrame([("p", 1, "2024-01-10", "b", {"T1": True}), ("p", 2, "2024-02-10", "a", {"T1": True, "T2": True}), ("p", 3, None, "b", {"T1": None, "T2": False})], "page_key string, row_no int, exec_date string, textbook string, target_checks map<string,boolean>").withColumn("exec_date", F.to_date("exec_date"))
    own = progress.target_progress(targets, units)
    got = {r.seq: (r.units, r.executed, r.on_time, r.before, r.after, r.not_executed, r.textbooks) for r in own.collect()}
    assert got == {0: (2, 2, 1, 0, 1, 0, "b\na"), 1: (2, 2, 1, 1, 0, 0, "b\na"), 2: (1, 1, 0, 0, 1, 0, "a")}
    assert progress.inconsistent(own).count() == 0
    kept = own.select("page_key", "seq", "target_no", "units")
    names = targets.select("page_key", "seq", "target_no", F.concat(F.lit("n"), "seq").alias("target_name"))
    assert sorted((r.target_no, r.target_name) for r in progress.with_targets(kept, names).collect()) == [("T1", "n0"), ("T1", "n1"), ("T2", "n2")]
    old = kept.where("seq <> 0").withColumn("seq", F.lit(None).cast("int"))  # stored before places were
    assert sorted((r.target_no, r.target_name) for r in progress.with_targets(old, names).collect()) == [("T1", "n1"), ("T2", "n2")]


def test_groups(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(5, 5), (None, 1)] + [(400 + i, 401 + i) for i in range(40)]
    root = {n: n for n in range(450)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    nodes = spark.range(450).selectExpr("id as node", "id % 3 + 1 as w")
    got = {x.node: (x.root, x.size) for x in groups.group_sizes(nodes, spark.createDataFrame(edges, "a long, b long"), "w").collect()}
    sizes = {}
    for n in range(450):
        sizes[find(n)] = sizes.get(find(n), 0) + n % 3 + 1
    assert got == {n: (find(n), sizes[find(n)]) for n in range(450)}


def test_copies_in_blocks_and_chains(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 4)
    r = random.Random(6)
    texts = {"".join(r.choice("abcdefgh") for _ in range(r.randrange(20, 45))) for _ in range(60)}
    for t in list(texts):
        texts |= {t[:i] + r.choice("abc") + t[i + 1 :] for i in r.sample(range(len(t)), 2)}
    df = spark.createDataFrame([("x" if i % 3 else "y", t) for i, t in enumerate(sorted(texts))], "author string, t string")
    rows = [(a, t, {t[i : i + 2] for i in range(len(t) - 1)}) for a, t in df.collect()]
    want = {(min(s, t), max(s, t)) for a, s, g in rows for b, t, h in rows if a == b and s != t and 5 * len(g & h) >= 4 * len(g | h)}
    assert {(x.a, x.b) for x in similar.similar_pairs(df).collect()} == want and len(want) > 30
    with pytest.raises(ValueError):
        similar.similar_pairs(df, most_pairs=100)
    chain = "".join(chr(0x4E00 + i) for i in range(60))
    own = spark.createDataFrame([(i, "A", chain[2 * i : 2 * i + 30]) for i in range(6)] + [(9, "A", chain[50:] * 3), (10, "B", chain[:30])], "id int, author string, text string")
    for least, flagged in ((1, {*range(6), 9, 10}), (2, {*range(6)}), (6, {*range(6)}), (7, set())):
        got = similar.flag_similar(own, least=least).collect()
        assert {x.id for x in got if x.copied} == flagged and len({x.copy_group for x in got if x.id < 6}) == 1 and {x.copy_size for x in got if x.id < 6} == {6}


def test_sets_meet_as_packed_tiles(spark, monkeypatch):
    """Large and odd sets, a block in parts, rare and common grams: what brute force finds; nothing but numbers of a text is shuffled for its group."""
    import numpy as np

    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 2**63, 400, dtype=np.uint64))[: int(r.integers(60, 300))] for _ in range(12)]
    for x in list(sets):
        sets += [np.unique(np.concatenate([x[int(r.integers(0, 30)) :], r.integers(0, 2**63, int(r.integers(0, 12)), dtype=np.uint64)])) for _ in range(6)]
    assert all((similar._unpacked(similar._packed(x)) == x).all() for x in [*sets, np.zeros(0, np.uint64)])
    own = [set(x.tolist()) for x in sets]
    want = {(i, k) for i in range(len(own)) for k in range(i) if 5 * len(own[i] & own[k]) >= 4 * len(own[i] | own[k])}
    monkeypatch.setattr(similar, "STEP", 16)
    n, packed = np.array([len(x) for x in sets]), [similar._packed(x) for x in sets]
    pairs = [(max(a, b), min(a, b)) for k, l, _ in similar._tile(n, packed, np.ones(len(n), bool), True, False) for a, b in zip(k.tolist(), l.tolist(), strict=True)]
    right = np.arange(len(n)) % 2 == 0
    two = [(int(max(a, b)), int(min(a, b))) for k, l, _ in similar._tile(n, packed, right, False, False) for a, b in zip(k, l, strict=True)]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 50 and set(two) == {(a, b) for a, b in want if right[a] != right[b]}
    up = list(range(len(n)))
    links = [(int(a), int(b)) for k, l, _ in similar._tile(n, packed, np.ones(len(n), bool), True, True) for a, b in zip(k, l, strict=True)]
    find = lambda v: v if up[v] == v else find(up[v])
    for a, b in links:
        assert find(a) != find(b) and (max(a, b), min(a, b)) in want  # a link each, and no more
        up[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in want)
    plan = similar.flag_similar(spark.createDataFrame([(1, "a", "x" * 40)], "id int, author string, text string")).select("id", "copied")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not any(re.search(r"\b_[at]#", x) for x in plan.split("\n") if "Join" in x)


def test_demo_pages_do_not_shuffle_the_findings(spark):
    """The findings of demo students are told by their page, of which there are few; the others' texts stay where they are."""
    pages = spark.createDataFrame([("a", "Ann"), ("b", "demo x"), ("b", "demo x"), ("c", None), ("d", "Bob")], "page_key string, student_name string")
    found = spark.range(6).selectExpr("element_at(array('a', 'b', 'c', 'd', 'b', null), cast(id + 1 as int)) as page_key", "map('author', 'w', 'student', 'much the same text') as sections", "'PASS' as severity", *(f"cast(array() as array<string>) as {c}" for c in ("errors", "warnings", "reviews", "fix_items", "unclassified")))
    out = jobs.flag_copies({**state.empty_store(spark), "pages": pages, "findings": found}, least=2, demo_family="demo")["findings"]
    assert sorted((x.page_key or "", x.warnings) for x in out.collect()) == [("", ["looks_copied"]), ("a", ["looks_copied"]), ("b", []), ("b", []), ("c", ["looks_copied"]), ("d", ["looks_copied"])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.split("\n") if "Join LeftOuter" in x and "page_key" in x and "rightHint=(strategy=broadcast)" in x] and "student_name" not in plan


def test_progress_deals_targets_and_units_out_once(spark):
    day = lambda d: f"date '2026-01-{d:02}'"
    targets = spark.sql(f"select * from values ('a', 0, 'T1', {day(5)}, {day(9)}), ('a', 1, 'T2', null, null), ('a', 2, 'T1', {day(1)}, {day(4)}), ('a', null, 'T1', {day(1)}, {day(4)}), ('b', 0, 'T1', null, {day(2)}), ('c', 0, null, null, null) t(page_key, seq, target_no, start_date, end_date)")
    on = "map('T1', true, 'T2', false), map('T1', true, 'T2', true), map('T1', true, 'T9', true)".split("), ")
    units = spark.sql(f"select * from values ('a', 1, {day(4)}, 'y', {on[0]})), ('a', 2, {day(5)}, 'x', {on[1]})), ('a', 3, {day(10)}, 'y', {on[2]}), ('a', 4, cast(null as date), '-', {on[1]})), ('a', 5, null, 'z', null), ('c', 1, {day(3)}, 'w', {on[0]})) t(page_key, row_no, exec_date, textbook, target_checks)")
    out = progress.target_progress(targets, units)
    got = sorted((r.page_key, -1 if r.seq is None else r.seq, r.units, r.executed, r.on_time, r.before, r.after, r.not_executed, r.latest and r.latest.day, r.textbooks, r.executed_rate) for r in out.collect())
    assert got == [
        ("a", -1, 0, 0, 0, 0, 0, 0, None, "y\nx", None), ("a", 0, 4, 3, 1, 1, 1, 1, 10, "y\nx", 75.0), ("a", 1, 2, 1, 0, 0, 1, 1, 5, "x", 50.0), ("a", 2, 4, 3, 1, 0, 2, 1, 10, "y\nx", 75.0),
        ("b", 0, 0, 0, 0, 0, 0, 0, None, None, None), ("c", 0, 0, 0, 0, 0, 0, 0, None, None, None),
    ]
    assert not inconsistent_rows(out)
    plan = out.hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("BroadcastExchange") == 2


def inconsistent_rows(df):
    return progress.inconsistent(df).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_store_is_made_without_joining_pages_back(spark):
    from quillspan.plans import state_queries

    store = state_queries._store(spark, "/root/testdata/sf0.001")
    plans = {name: df._jdf.queryExecution().optimizedPlan().toString() for name, df in store.items()}
    assert not any("LeftSemi" in x for x in plans.values()) and plans["pages"].count("Relation [o_orderkey") == 3  # of the pages, their targets and units
    saved = {r.page_key for r in store["pages"].where("status = 'saved'").collect()}
    assert {r.page_key for r in store["targets"].collect()} == saved == {r.page_key for r in store["progress"].collect()} and {r.page_key for r in store["units"].collect()} <= saved


def test_unit_detail_meets_by_the_page_only(spark):
    day = lambda d: f"date '2026-01-{d:02}'"
    targets = spark.sql(f"select * from values ('a', 0, 'T1', 'old', {day(1)}, {day(2)}, 'OK'), ('a', 3, 'T1', 'last', {day(5)}, {day(9)}, 'DELAY'), ('a', null, 'T1', 'none', null, null, 'OK'), ('a', 1, 'T2', 'n', null, null, null) t(page_key, seq, target_no, target_name, start_date, end_date, progress_delay)")
    units = spark.sql(f"select * from values ('a', 1, {day(6)}, map('T1', true, 'T2', true)), ('a', 2, {day(4)}, map('T1', true, 'T9', true)), ('a', 3, null, map('T1', false)), ('b', 1, {day(4)}, map('T1', true)), ('x', 1, {day(4)}, map('T1', true)) t(page_key, row_no, exec_date, target_checks)")
    pages = spark.createDataFrame([("a", "Ann"), ("b", "Bob")], "page_key string, student_name string")
    out = progress.unit_detail(units, pages, targets)
    got = sorted((r.page_key, r.row_no, r.target_no, r.target_name, r.progress_delay, r.timing, r.student_name) for r in out.collect())
    assert got == [
        ("a", 1, "T1", "last", "DELAY", "on_time", "Ann"), ("a", 1, "T2", "n", "OK", "undecided", "Ann"), ("a", 2, "T1", "last", "DELAY", "before", "Ann"), ("a", 2, "T9", None, "OK", "on_time", "Ann"),
        ("a", 3, "-", None, "OK", "not_executed", "Ann"), ("b", 1, "T1", None, "OK", "on_time", "Bob"),
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "Window" not in plan and not any("target_no" in x for x in plan.split("\n") if "Join " in x)


def test_blanks_go_with_compatibility_forms(spark):
    from quillspan.functions import text

    odd = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    df = spark.createDataFrame([(t,) for t in (None, "", "a b\tc\n", "Ａ　b\u2003c", odd, "".join(map(chr, range(128))))], "t string")
    got = df.select(text.nfkc_without_blanks(F.col("t")).alias("a"), text.without_blanks(text.nfkc(F.col("t"))).alias("b")).collect()
    assert all(x.a == x.b for x in got)


def test_tables_that_break_their_rule_are_not_published(spark, tmp_path):
    path = str(tmp_path / "store")
    good = spark.createDataFrame([("a", 0, "T1", 2, 1, 1, 0, 0, 1)], "page_key string, seq int, target_no string, units int, executed int, on_time int, before int, after int, not_executed int")
    store = {**state.empty_store(spark), "progress": good}
    assert write_store(store, path)["progress"] == 1
    with pytest.raises(Inconsistent, match="1 of 2 rows of progress"):
        write_store({**store, "pages": pages(spark, {"page_key": "z"}), "progress": good.unionByName(good.withColumn("units", F.lit(9)))}, path)
    back = read_store(spark, path)
    assert back["progress"].count() == 1 and back["pages"].count() == 0 and not [p for p in (tmp_path / "store").iterdir() if p.name.startswith("_new")]


def test_reports_are_published_in_order(spark, tmp_path):
    r = random.Random(1)
    keys = [(p, n) for p in range(20) for n in range(10)]
    r.shuffle(keys)
    own = pages(spark, *({"page_key": f"{p}-{n}", "page_index": p, "row_index": n, "student_name": f"s{p}-{n}", "status": "saved"} for p, n in keys)).repartition(5)
    units = own.select("page_key", F.explode(F.array(*map(F.lit, (3, 1, 2)))).alias("row_no"), F.lit("u").alias("unit_name"), F.create_map(F.lit("T1"), F.lit(True)).alias("target_checks"))
    typed = lambda df, name: df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORE[name].fields))
    found = own.select("page_key", F.lit("PASS").alias("severity"))
    store = {**state.empty_store(spark), "pages": own, "units": typed(units.withColumn("problem_code", F.col("row_no").cast("string")), "units"), "findings": typed(found, "findings")}
    place = publish_reports(jobs.all_reports(store, ordered=True), str(tmp_path / "out"))
    read = lambda name: [x for f in sorted((tmp_path / "out" / name).glob("*.parquet")) for x in spark.read.parquet(str(f)).collect()]
    assert place == str(tmp_path / "out")
    assert [(x.student_name, x.problem_code) for x in read("units")] == [(f"s{p}-{n}", str(i)) for p, n in sorted(keys) for i in (1, 2, 3)]
    assert [x.student_name for x in read("findings")] == [f"s{p}-{n}" for p, n in sorted(keys, key=lambda x: (x[1], x[0]))]


def test_bucketed_joins_have_no_exchange(spark):
    own = pages(spark, *({"page_key": f"k{i}", "student_name": f"s{i}"} for i in range(50)))
    units = own.select("page_key", F.explode(F.array(F.lit(1), F.lit(2))).alias("row_no"))
    hint = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = write_bucketed({"pages": own, "units": units}, "quillspan_test_bucketed", buckets=4)
        joined = reports.units_with_page(kept["units"], kept["pages"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 100 and "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", hint)
        for name in ("pages", "units"):
            spark.sql(f"drop table if exists quillspan_test_bucketed_{name}")


