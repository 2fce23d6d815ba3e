"""Page events in order: fetched, failed and parsed ones mixed, each applied to what the one before it left.

A page's events are folded one by one over a small state: the page's status, and which event's HTML it holds. The
fold sees neither HTML nor messages, only places in the order, so even a page with very many events is a short
array of numbers; texts are taken afterwards from the events that won. What doesn't depend on the order of
kinds - failures counted, blanks filled, the last message - are plain aggregates.

The rules: a fetch makes a page fetched and overwrites its HTML, unless the page is saved, which then only fills a
missing one; a failure sets its status (``fetch_failed`` or ``parse_failed``) and message and counts as a retry,
whatever the page was; a parse saves the page, overwrites HTML, time and classroom where it knows them, fills
blank attributes, and replaces all child rows. Fetches and parses clear the message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from quillspan.sources.scratch import written

#: Attributes that a parse fills where they are blank.
FILLED = ("curriculum_key", "detail_url", "code", "student_id", "student_name", "grade", "division", "subject", "school_course")
_TEXTS = (*FILLED, "classroom", "html", "status", "error")
#: An event: its page, its place in the order (``seq``, then ``step``), its kind, and what it brings. ``status`` is a failure's.
EVENTS = StructType(
    [StructField("page_key", StringType()), StructField("seq", LongType()), StructField("step", IntegerType()), StructField("kind", StringType())]
    + [StructField(c, StringType()) for c in _TEXTS]
    + [StructField("fetched_at", TimestampType())]
)
KINDS = ("fetched", "failed", "parsed")


def as_events(df: DataFrame, kind: str, step: int = 0) -> DataFrame:
    """Rows in the form of ``EVENTS``; columns that ``df`` lacks are null."""
    own = df.withColumns({"kind": F.lit(kind), "step": F.lit(step)})
    return own.select(*((F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS.fields))


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _known(c: Column) -> Column:
    return ~F.trim(F.coalesce(c, F.lit(""))).isin("", "-")


def replay(pages: DataFrame, events: DataFrame) -> DataFrame:
    """The pages after all their events, in the order of ``seq`` and ``step``; what they are without any stays as it is.

    Events of pages that aren't there, without a key, or of another kind are left out. Events of one place in the
    order are taken by kind, as listed in ``KINDS``; ``seq`` should tell them apart.
    """
    e = events.where(F.col("kind").isin(*KINDS) & F.col("page_key").isNotNull()).join(pages.select("page_key"), "page_key", "left_semi")
    code = sum((F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    e = e.withColumn("at", F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("step", F.lit(0)).alias("step"), code.alias("code")))
    parsed, failed = F.col("kind") == "parsed", F.col("kind") == "failed"
    first = {c: F.min_by(F.when(parsed, F.col(c)), F.when(parsed & ~_blank(F.col(c)), F.col("at"))).alias(f"_{c}") for c in FILLED}
    small = e.groupBy("page_key").agg(
        # What the fold looks at: the place, and whether there is HTML and a time.
        F.array_sort(F.collect_list(F.struct("at", F.col("html").isNotNull().alias("some"), (~_blank(F.col("html"))).alias("html"), F.col("fetched_at").isNotNull().alias("time")))).alias("_line"),
        F.count_if(failed).cast("int").alias("_failures"),
        F.max_by(F.struct("kind", "status", "error"), "at").alias("_last"),
        F.max_by(F.when(parsed, F.col("classroom")), F.when(parsed & _known(F.col("classroom")), F.col("at"))).alias("_classroom"),
        *first.values(),
    )
    place = "struct<seq:bigint,step:int,code:int>"
    own = pages.join(small, "page_key", "left")
    begin = F.struct(
        (F.coalesce("status", F.lit("")) == "saved").alias("saved"), F.lit(None).cast(place).alias("html_at"), F.lit(None).cast(place).alias("time_at"),
        F.col("html").isNotNull().alias("has_html"), F.col("fetched_at").isNotNull().alias("has_time"),
    )

    def step(s: Column, x: Column) -> Column:
        fetch, fail = x["at"]["code"] == 0, x["at"]["code"] == 1
        html = F.when(fail, False).when(fetch, ~s["saved"] | ~s["has_html"] & x["some"]).otherwise(x["html"])
        time = F.when(fail, False).when(fetch, ~s["saved"] | ~s["has_time"] & x["time"]).otherwise(x["time"])
        return F.struct(
            (~fail & (~fetch | s["saved"])).alias("saved"), F.when(html, x["at"]).otherwise(s["html_at"]).alias("html_at"), F.when(time, x["at"]).otherwise(s["time_at"]).alias("time_at"),
            F.when(html, x["some"]).otherwise(s["has_html"]).alias("has_html"), F.when(time, x["time"]).otherwise(s["has_time"]).alias("has_time"),
        )

    own = own.withColumn("_end", F.when(F.col("_line").isNotNull(), F.aggregate("_line", begin, step))).drop("_line")
    own = written(own, "folded")
    took = lambda name, of: e.select("page_key", F.col("at").alias(f"_{of}_at"), F.col(of).alias(name)).dropDuplicates(["page_key", f"_{of}_at"])
    out = own.withColumns({"_html_at": F.col("_end.html_at"), "_fetched_at_at": F.col("_end.time_at")})
    out = out.join(took("_html", "html"), ["page_key", "_html_at"], "left").join(took("_time", "fetched_at"), ["page_key", "_fetched_at_at"], "left")
    hit, lost = F.col("_last").isNotNull(), F.col("_last.kind") == "failed"
    status = F.when(lost, F.coalesce("_last.status", F.lit("fetch_failed"))).when(F.col("_end.saved"), "saved").otherwise("fetched")
    cols = {
        "status": F.when(hit, status).otherwise(F.col("status")), "error": F.when(lost, F.col("_last.error")).when(~hit, F.col("error")),
        "retries": F.coalesce("retries", F.lit(0)) + F.coalesce("_failures", F.lit(0)), "classroom": F.coalesce("_classroom", "classroom"),
        "html": F.when(F.col("_html_at").isNotNull(), F.col("_html")).otherwise(F.col("html")), "fetched_at": F.when(F.col("_fetched_at_at").isNotNull(), F.col("_time")).otherwise(F.col("fetched_at")),
        **{c: F.coalesce(F.when(~_blank(F.col(c)), F.col(c)), F.col(f"_{c}"), F.col(c)) for c in FILLED},
    }
    return out.withColumns(cols).select(*pages.columns)


def last_parsed(events: DataFrame) -> DataFrame:
    """``page_key, seq, step`` of each page's last parse: its child rows replace all others."""
    last = events.where("kind = 'parsed' and page_key is not null").groupBy("page_key").agg(F.max(F.struct("seq", "step")).alias("at"))
    return last.select("page_key", "at.seq", "at.step")


def replaced(child: DataFrame, new: DataFrame, events: DataFrame) -> DataFrame:
    """Child rows after the events: a parsed page has those of its last parse only. ``new`` has the child's columns, ``event_seq`` and ``event_step``."""
    last = written(last_parsed(events), "last")
    kept = child.join(last.select("page_key"), "page_key", "left_anti")
    came = new.join(last.select("page_key", F.col("seq").alias("event_seq"), F.col("step").alias("event_step")), ["page_key", "event_seq", "event_step"], "left_semi")
    return kept.unionByName(came.drop("event_seq", "event_step"), allowMissingColumns=True).select(*child.columns)
