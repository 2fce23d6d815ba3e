"""Literal rows for functions and operators, and invariants."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillspan.functions import keys, text, values
from quillspan.operators import backfill, order, progress, rules, sections, similar, state
from quillspan.schemas import PAGES, STORE
from quillspan.sources import html
from quillspan.sources.store import publish_reports, read_store, write_store
from quillspan.streaming.upserts import Snapshots, page_updates, stream_merge, stream_parsed


def column(spark, values_, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values_)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_text(spark):
    assert column(spark, ["Ann Lee", "demo x", "", None], lambda c: text.is_demo_name(c, "demo", "")) == [False, True, False, False]
    assert column(spark, ["Ann Lee", "demo x"], lambda c: text.is_demo_name(c, "", "demox")) == [False, True] and column(spark, ["Ann"], lambda c: text.is_demo_name(c, "", "")) == [False]
    assert column(spark, [None, " Ａ　b ", "　"], text.normalize_text) == ["", "A b", ""]
    assert column(spark, ["Ａ b\tC", None], text.normalize_for_match) == ["abc", ""]
    assert column(spark, [" ｎ/A", "x", None], lambda c: text.is_blank_or_placeholder(c, ["n/a"])) == [True, False, True]
    assert column(spark, ["ACME North", "North acme", None], lambda c: text.clean_branch_name(c, "Acme")) == ["North", "North", ""]
    assert column(spark, ["a, b!", ""], text.count_effective_chars) == [2, 0]
    assert column(spark, ["demo taro", "demotaro x", "demographic y", None], lambda c: text.is_demo_name(c, "demo", "demotaro")) == [True, True, False, False]
    assert [tuple(r) for r in column(spark, ["12 Ann (an)", "Ann"], lambda c: text.split_id_name(c, detail=True))] == [("12", "Ann"), ("", "Ann")]
    assert [tuple(r) for r in column(spark, ["x[late]", "x", None], lambda c: text.split_flag_from_name(c, "[late]", "DELAY"))] == [("x", "DELAY"), ("x", "OK"), ("", "OK")]
    assert column(spark, ["t: a\nt：b ", "t:", None], lambda c: text.labelled_line(c, "t")) == ["b", None, None]
    assert column(spark, ["a\x00\tb\x1f"], text.strip_control_chars) == ["a\tb"]
    assert column(spark, ["abcdef", "ab", None], lambda c: text.clip(c, 3, "..")) == ["abc..", "ab", ""]
    assert column(spark, ['["a"]', "{", None], text.json_list) == [["a"], [], []]
    assert column(spark, ['{"a": true}', "x"], text.json_bool_map) == [{"a": True}, {}]


def test_values(spark):
    assert column(spark, ["on 2026/2/3.", "2026-02-30", "２０２６／１２／０１", "٢٠٢٦/٠٣/०९", None], values.parse_date) == [date(2026, 2, 3), None, date(2026, 12, 1), date(2026, 3, 9), None]
    got = column(spark, ["2026/1/1 ~ 2026/2/1", "2026/1/1〜", "~2026/2/1", "2026/1/1", ""], values.parse_period)
    a, b = date(2026, 1, 1), date(2026, 2, 1)
    assert [(r.start, r.end) for r in got] == [(a, b), (a, None), (None, b), (a, a), (None, None)]
    assert [tuple(r) for r in column(spark, ["4 / 7", "0／0", "x", "2.5/5"], values.parse_score)] == [(4.0, 7.0, 57.1), (0.0, 0.0, None), (None, None, None), (2.5, 5.0, 50.0)]
    df = spark.createDataFrame([(4, 5), (1, 16), (4, 7), (0, 0)], "a int, b int")
    assert [r[0] for r in df.select(values.pct_text(F.col("a"), F.col("b"))).collect()] == ["80", "6.2", "57.1", "-"]
    assert [r[0] for r in df.select(keys.curriculum_key(F.lit("c"), F.lit("s"), F.lit("m"), F.col("a"), F.col("b"))).collect()] == ["c_s_m_4_5", "c_s_m_16", "c_s_m_4_7", "c_s_m_0"]
    assert column(spark, ["c_s_m_2_5", "c_s_m_5", "c_s_a_b_5", None], keys.page_index_from_key) == [2, 1, 1, 1]


def test_progress(spark):
    t = spark.createDataFrame([("p", 1, "T1", date(2026, 1, 10), date(2026, 1, 20)), ("p", 2, "T2", None, None), ("p", 3, "T3", None, None)], "page_key string, seq int, target_no string, start_date date, end_date date")
    days = [date(2026, 1, 5), date(2026, 1, 10), date(2026, 1, 20), date(2026, 1, 21), None]
    u = spark.createDataFrame([("p", i, d, "book" if i % 2 else "-", {"T1": True, "T2": i > 3}) for i, d in enumerate(days, 1)], "page_key string, row_no int, exec_date date, textbook string, target_checks map<string,boolean>")
    got = {r.target_no: r for r in progress.target_progress(t, u).collect()}
    one = got["T1"]
    assert (one.units, one.executed, one.on_time, one.before, one.after, one.not_executed) == (5, 4, 2, 1, 1, 1)
    assert (one.executed_rate, one.on_time_rate, one.latest, one.textbooks) == (80.0, 40.0, date(2026, 1, 21), "book")
    assert (got["T2"].units, got["T2"].after, got["T2"].not_executed) == (2, 1, 1)
    assert (got["T3"].units, got["T3"].executed_rate) == (0, None)
    assert progress.inconsistent(progress.target_progress(t, u)).count() == 0


NOTE = "loose\n■ Writer: Ann\n2. [Plan]\nread on\nmore\nwriter: Bob\nPlanned things\nTest"
ALIASES = {"Writer": "author", "Plan": "plan", "Test": "test"}


def test_sections(spark):
    df = spark.createDataFrame([(1, NOTE), (2, None), (3, "Plan - x y"), (4, "  \n")], "k int, t string")
    a = {r.k: (r.sections, r.unclassified) for r in sections.split_sections(df, "k", "t", ALIASES).collect()}
    b = {r.k: (r.x.sections, r.x.unclassified) for r in df.select("k", sections.sections_column(F.col("t"), ALIASES).alias("x")).collect()}
    assert a == b
    assert a[1] == ({"author": "Ann\nBob\nPlanned things", "plan": "read on\nmore"}, ["loose"])
    assert a[2] == ({}, []) and a[3] == ({"plan": "x\ny"}, []) and a[4] == ({}, [])


def test_rules(spark):
    df = spark.createDataFrame([("", 1), ("x", 1), ("x", 2), ("x", 3), ("x", 9)], "t string, n int")
    own = [rules.Rule("e", "errors", F.col("n") == 1, "fix"), rules.Rule("e2", "errors", F.col("n") == 1, "fix"), rules.Rule("r", "reviews", F.col("n") <= 2), rules.Rule("w", "warnings", F.col("n") <= 3)]
    got = [(r.severity, r.errors, r.fix_items) for r in rules.evaluate_rules(df, own, "t").collect()]
    assert got == [("CRITICAL", ["blank"], ["write a text"]), ("ERROR", ["e", "e2"], ["fix"]), ("REVIEW", [], []), ("WARNING", [], []), ("PASS", [], [])]


def test_similar(spark):
    import random

    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef") for _ in range(60)) for _ in range(6)]
    texts = [("a b", x) for x in base for _ in range(2)] + [("AB", x[:-2] + "zz") for x in base] + [("c", base[0]), ("c", "short"), ("c", "short"), ("c", "short"), ("", "short"), (None, None)]
    df = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(texts)], "id int, author string, text string")
    flagged = {r.id for r in similar.flag_similar(df).where("copied").collect()}
    assert flagged == set(range(18)) | {19, 20, 21}
    own = similar._texts(df, "author", "text")
    pairs = {(r.a, r.b) for r in similar.similar_pairs(own).collect()}
    long = sorted({t for a, t in texts if a in ("a b", "AB")})
    grams = {t: {t[i : i + 2] for i in range(len(t) - 1)} for t in long}
    want = {(a, b) for a in long for b in long if a < b and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])}
    assert pairs == want


def test_order_and_backfill(spark):
    df = spark.createDataFrame([("s", "", 1), ("s", "B", 2), ("s", "A", 3), ("t", "-", 1), ("", "", 1), (None, "Z", 1)], "student string, room string, row int")
    got = sorted((r.student or "", r.row, r.room) for r in backfill.backfill(df, "student", "room", ["row"]).collect())
    assert got == [("", 1, "Z"), ("", 1, "unknown"), ("s", 1, "B"), ("s", 2, "B"), ("s", 3, "B"), ("t", 1, "unknown")]
    walk = spark.createDataFrame([(1, p, k) for p, ks in enumerate(["ab", "c", "c", "d"]) for k in ks], "w int, p int, k string")
    assert {r.p for r in order.cut_repeated_pages(walk, ["w"], "p", ["k"]).collect()} == {0, 1}
    assert sorted(r.occurrence for r in order.occurrence_index(df, ["student"], ["row"]).where("student = 's'").collect()) == [0, 1, 2]


def pages(spark, *rows):
    names = [f.name for f in PAGES.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], PAGES)


def test_state(spark):
    p = pages(spark, {"page_key": "a", "status": "saved", "html": "old", "retries": 0, "classroom": "r"}, {"page_key": "b", "status": "fetch_failed", "retries": 2, "grade": "g"})
    got = {r.page_key: r for r in state.apply_failed(p, spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "page_key string, error string, seq int"), ["seq"]).collect()}
    assert (got["a"].status, got["a"].error, got["a"].retries, got["b"].retries) == ("fetch_failed", "y", 2, 2)
    up = spark.createDataFrame([("a", "new", None, 1), ("b", "nb", None, 1)], "page_key string, html string, fetched_at timestamp, seq int")
    got = {r.page_key: (r.status, r.html) for r in state.apply_fetched(p, up, ["seq"]).collect()}
    assert got == {"a": ("saved", "old"), "b": ("fetched", "nb")}
    store = {**state.empty_store(spark), "pages": p, "units": spark.createDataFrame([("a", 1), ("z", 1)], "page_key string, row_no int")}
    parsed = {"pages": spark.createDataFrame([("a", "-", "g2")], "page_key string, classroom string, grade string"), "units": spark.createDataFrame([("a", 5), ("q", 9)], "page_key string, row_no int")}
    out = state.save_parsed(store, parsed)
    again = state.save_parsed(out, parsed)
    for s in (out, again):
        kept, gone = state.drop_orphans(s["units"], s["pages"])
        assert {(r.page_key, r.row_no) for r in kept.collect()} == {("a", 5)}
        assert {r.page_key for r in gone.collect()} >= {"z", "q"}
        a = s["pages"].where("page_key = 'a'").first()
        assert (a.status, a.classroom, a.grade) == ("saved", "r", "g2")
    assert {n: df.count() for n, df in state.empty_store(spark).items()} == dict.fromkeys(STORE, 0)


def test_html(spark):
    boxes = ["<input type=checkbox checked>", "<span aria-checked='true'></span>", "<div class='x checked'><input type=checkbox></div>", "<input type=checkbox>"]
    cells = "".join(f"<td>{b}" for b in boxes)
    page = f"<table class=student-info><tr><th>Student<td>7 Ann<th>Grade<td>9</table><table class='units big'><tr><th>Unit<th>T1<th>T2<th>T3<th>T4<tr><td>u &amp; v{cells}</table><script>if (a < b) '<table>'</script>"
    df = spark.createDataFrame([("a", page), ("b", None), ("c", "<table><tr")], "page_key string, html string")
    got = {r.page_key: r for r in html.parse_detail_pages(df).collect()}
    assert got["a"].info == {"student": "7 Ann", "grade": "9"} and got["a"].units[0].unit_name == "u & v"
    assert got["a"].units[0].checks == {"T1": True, "T2": True, "T3": True, "T4": False}
    assert got["b"].units == [] and got["c"].units == [] and got["b"].error is None
    card = "<table><tr><th>Day</th><td>x</td></tr><tr><th>Room</th><td>5</td></tr></table>"
    assert column(spark, [card, None], lambda c: html.label_value(c, "Room", "none")) == ["5", ""]


def test_store_and_publish(spark, tmp_path):
    path = str(tmp_path / "store")
    store = {**state.empty_store(spark), "pages": pages(spark, {"page_key": "a", "status": "saved"})}
    write_store(store, path)
    back = read_store(spark, path)
    write_store(back | {"pages": back["pages"].unionByName(pages(spark, {"page_key": "b"}))}, path)
    assert read_store(spark, path)["pages"].count() == 2
    out = str(tmp_path / "reports")
    report = spark.createDataFrame([(1, "x")], "a int, b string")
    assert publish_reports({"r": report}, out, required=("r",)) == out
    with pytest.raises(ValueError):
        publish_reports({"r": report}, out, required=("r", "s"))
    assert publish_reports({"r": report.union(report)}, out, fmt="csv", required=("r",)) == out
    assert spark.read.option("header", True).csv(f"{out}/r").count() == 2


def test_tables_that_cannot_be_replaced_stay(spark, tmp_path, monkeypatch):
    from quillspan.sources import store as S

    path = str(tmp_path / "store")
    store = {**state.empty_store(spark), "pages": pages(spark, {"page_key": "a", "status": "saved"})}
    write_store(store, path)
    real = S._fs

    def broken(spark, path):
        fs, Path = real(spark, path)

        class Store:
            def __getattr__(self, name):
                return getattr(fs, name)

            def rename(self, a, b):
                return False if a.toString().endswith("/progress") and "_new" in a.toString() else fs.rename(a, b)

        return Store(), Path

    monkeypatch.setattr(S, "_fs", broken)
    with pytest.raises(OSError):
        write_store({**store, "pages": pages(spark, {"page_key": "b"}, {"page_key": "c"})}, path)
    monkeypatch.undo()
    assert [r.page_key for r in read_store(spark, path)["pages"].collect()] == ["a"] and set(STORE) <= {p.name for p in (tmp_path / "store").iterdir()}


def test_incomplete_reports_are_not_published(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "reports")
    report = spark.createDataFrame([(1, "x"), (2, "y\nz")], "a int, b string")
    assert publish_reports({"r": report}, out, fmt="csv") == out
    monkeypatch.setattr(type(report), "count", lambda self: 0)
    with pytest.raises(OSError):
        publish_reports({"r": report}, out)
    monkeypatch.undo()
    assert spark.read.option("header", True).option("multiLine", True).csv(f"{out}/r").count() == 2 and not [p for p in tmp_path.iterdir() if ".new-" in p.name]


def test_parsed_stream_adds_up(spark, tmp_path, monkeypatch):
    """Two batches give what one gives; a page that cannot be parsed goes to the errors and the others go on."""
    from quillspan.plans import jobs

    grid = "<table class=units><tr><th>Unit<th>T1<tr><td>u<td><input checked></table>"
    rows = [{"page_key": k, "status": "fetched", "html": grid, "retries": 0} for k in "abcd"]
    source = str(tmp_path / "in")
    for part in (rows[:2], rows[2:]):
        pages(spark, *part).coalesce(1).write.mode("append").parquet(source)
    words = {n: [] for n in ("placeholder", "status", "uncertain", "school_type", "public", "exam", "seasonal")}
    calls = []

    def parse(df):
        calls.append(df.count())
        return jobs.parsed_tables(df.where("page_key <> 'd'"), F.lit("2026-01-10").cast("date"), ALIASES, words, {})[0], df.where("page_key = 'd'").select("page_key", F.lit("broken").alias("error"))

    results = []
    for name, files in (("two", 1), ("one", 9)):
        snaps = {n: Snapshots(spark, str(tmp_path / name / n), spark.createDataFrame([], schema)) for n, schema in STORE.items()}
        snaps["pages"].write(-1, pages(spark, *rows))
        stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(source)
        stream_parsed(stream, snaps, parse, str(tmp_path / name / "cp"), str(tmp_path / name / "bad")).awaitTermination()
        results.append((sorted((r.page_key, r.status) for r in snaps["pages"].read().collect()), sorted(r.page_key for r in snaps["units"].read().collect()), [r.page_key for r in spark.read.parquet(str(tmp_path / name / "bad")).collect()]))
    assert results[0] == results[1] == ([("a", "saved"), ("b", "saved"), ("c", "saved"), ("d", "fetched")], ["a", "b", "c"], ["d"])
    assert sorted(calls) == [2, 2, 4]


def test_broken_page_gives_its_message(spark, monkeypatch):
    monkeypatch.setattr(html, "detail_record", lambda h, labels: 1 / 0 if h == "bad" else {"info": [], "note": h, "materials": [], "targets": [], "units": []})
    df = spark.createDataFrame([("a", "bad"), ("b", "good")], "page_key string, html string")
    got = {r.page_key: (r.note, r.error) for r in html.parse_detail_pages(df).collect()}
    assert got["b"] == ("good", None) and got["a"][0] is None and got["a"][1].startswith("ZeroDivisionError")


def test_plain_pages_are_cut_apart(spark, monkeypatch):
    """Plain markup needs no tree of the page, and gives what the tree gives."""
    units = "<table class=units><tr><th>Unit</th><th>Info</th><th>T1</th></tr>\n<tr class='x'><td>a &amp; b</td><td>done: 1<br>part: &lt;x&gt; </td><td><input checked></td></tr></table>"
    page = "<div><p>menu</div><table class='student-info'><tr><th>Grade</th><td> 9 </td></tr></table><table class=targets><tbody><tr><td>T1</td><td>n</td></tr><tr><td>s</td></tr><tr><td>t</td></tr></tbody></table>" + units
    labels, whole = html.Labels(), html.parse
    monkeypatch.setattr(html, "parse", lambda h: 1 / 0 if "<table" in h else whole(h))
    got = html.detail_record(page, labels)
    assert got["info"] == [("grade", "9")] and [u["unit_name"] for u in got["units"]] == ["a & b"] and got["units"][0]["division_text"] == "<x>" and got["units"][0]["checks"] == [("T1", True)]
    monkeypatch.undo()
    odd = ("<!-- -->", "</tr>", "<td>", "<td/>", "<b title='</td>'>", "<table><tr><td>in</td></tr></table>", "<script><td></script>", "<", "'", "<TD>x</TD>", "<tr\n>", "<td.x>", "<table/>", "<li>", "</div>")
    pages_ = [page] + [page[:i] + x + page[i:] for x in odd for i in range(0, len(page), 23)]
    flat = [html._flat_tables(h) for h in pages_]
    assert flat[0] is not None and any(x is None for x in flat)
    own = [(html.detail_record(h, labels), html.listing_rows(h, labels), html.label_value_of(h, "Unit", "units")) for h in pages_]
    monkeypatch.setattr(html, "_flat_tables", lambda h: None)
    assert own == [(html.detail_record(h, labels), html.listing_rows(h, labels), html.label_value_of(h, "Unit", "units")) for h in pages_]


def test_listed_lessons_do_not_carry_their_page(spark):
    df = spark.createDataFrame([(1, "<table><tr><th>Student</th><th>Sheet</th></tr><tr>" + "<td>1 Ann</td>" * 6 + "</tr></table>")], "page_index int, html string")
    out = html.parse_list_pages(df)
    assert [(r.page_index, r.student_name, r.error) for r in out.collect()] == [(1, "Ann", None)]
    kept = re.findall(r"Generate explode\(.*?\), \[(.*?)\], true", out._jdf.queryExecution().executedPlan().toString())
    assert [re.sub(r"#\d+", "", x) for x in kept] == ["page_index, error"]


def test_stream_equals_batch(spark, tmp_path):
    start = pages(spark, *({"page_key": str(i), "status": "unfetched", "retries": 0} for i in range(5)))
    rows = [("fetched" if i % 3 else "failed", str(i % 5), f"h{i}", None, f"e{i}", i) for i in range(20)] + [(None, "1", None, None, None, 99)]
    schema = "kind string, page_key string, html string, at timestamp, error string, seq int"
    src = str(tmp_path / "in")
    for i in range(0, 21, 7):
        spark.createDataFrame(rows[i : i + 7], schema).coalesce(1).write.mode("append").parquet(src)
    snap = Snapshots(spark, str(tmp_path / "snap"), spark.createDataFrame([], PAGES))
    snap.write(-1, start)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    for _ in range(2):  # the second run finds nothing new
        stream_merge(stream, snap, page_updates, str(tmp_path / "cp"), good="kind is not null", rejects=str(tmp_path / "bad")).awaitTermination()
    own = {r.page_key: (r.status, r.html, r.retries) for r in snap.read().collect()}
    whole = {r.page_key: (r.status, r.html, r.retries) for r in page_updates(start, spark.createDataFrame(rows, schema).where("kind is not null")).collect()}
    assert own == whole and spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_repair_and_reports(spark, tmp_path):
    from quillspan.plans import jobs

    grid = "<table class=targets><tr><td>T1<td>mid [late]<td>2026/1/1 ~ 2026/1/31<td>80</tr><tr><td>site<td>5%</tr><tr><td>now<td>60</tr></table><table class=units><tr><th>Unit<th>Textbook<th>Score<th>Info<th>T1<tr><td>u<td>b<td>4/5<td>done: 2026/1/5<td><input checked></table>"
    page = "<table class=note-form><tr><th>Note<td>Writer: Ann<br>Plan: read all pages</table>" + grid + " " * 200
    store = {**state.empty_store(spark), "pages": pages(spark, {"page_key": "a", "status": "fetched", "html": page, "student_id": "1", "student_name": "Ann", "grade": "9"}, {"page_key": "d", "status": "saved", "student_id": "2", "student_name": "demo x"})}
    store["units"] = store["units"].unionByName(spark.createDataFrame([("lost", 1)], "page_key string, row_no int"), allowMissingColumns=True)
    words = {"placeholder": ["-"], "status": ["ok"], "uncertain": ["?"], "school_type": ["high"], "public": ["public"], "exam": ["exam"], "seasonal": ["summer"]}
    args = (F.lit("2026-01-10").cast("date"), ALIASES, words, {"plan": 5})
    out, gone = jobs.repair(store, *args)
    write_store(out, str(tmp_path / "s"))
    own = read_store(spark, str(tmp_path / "s"))
    assert {r.page_key: r.status for r in own["pages"].collect()} == {"a": "saved", "d": "saved"}
    assert [r.page_key for r in gone["units"].collect()] == ["lost"]
    again, _ = jobs.repair(own, *args)
    assert {n: df.count() for n, df in again.items()} == {n: df.count() for n, df in own.items()} == {"pages": 2, "targets": 1, "units": 1, "progress": 1, "findings": 1}
    got = jobs.all_reports(own, "demo", "demox")
    assert got["progress"].first().on_time_rate == "100" and got["attention"].first().delayed == "mid"
    assert {n: len(got[n].columns) for n in got if n != "summary"} == {"attention": 6, "progress": 28, "units": 24, "findings": 18, "raw_pages": 6}
    assert [r.html[:6] for r in got["raw_pages"].collect()] == ["<table"] and got["units"].first().timing == "on_time"
    assert got["findings"].first().severity == "ERROR" and {(r.level, r.value) for r in got["summary"].collect()} == {(0, "all"), (1, "unknown"), (2, "9")}
