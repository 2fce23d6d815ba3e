"""Quality rules as a short-circuit cascade.

Each rule rejects a text by some of its statistics, which are computed when a rule first asks for them.
On a sample every rule's cost (seconds a text, alone) and selectivity (share of texts it rejects) are
measured where the rows are; the rules then run in the order of rejections per second and stop at the
first rejection. A text is kept if no rule rejects it, so the order changes the time taken and never the
verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.document_stats import Stats
from quillspan.llm.shared import small_batches, texts


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Stats], bool]


#: The rules that a text must pass whatever else is asked for.
BASE = (
    Rule("few_words", lambda s: s.n_words < 50),
    Rule("repeated_words", lambda s: 100 * s.n_repeat_words > 50 * s.n_words),
)
#: Thresholds are in whole numbers, so every engine agrees on them.
RULES = (
    *BASE,
    Rule("symbols", lambda s: 10 * s.n_symbols > s.n_words),
    Rule("repeated_lines", lambda s: s.n_dup_lines >= 3 and 10 * s.n_dup_lines > 3 * len(s.lines)),
    Rule("word_length", lambda s: not 2 * s.n_words <= s.word_chars <= 12 * s.n_words),
    Rule("capitals", lambda s: 2 * s.n_upper > s.n_upper + s.n_lower),
    Rule("shouting", lambda s: 10 * s.n_shouts > s.n_words),
)


def measured_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, text_col: str = "text") -> list[str]:
    """Rule names by rejections per second on about ``sample_rows`` rows; ties and empty samples in the given order."""
    rows = docs.count()
    if not rows:
        return [r.name for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hit = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for _, found in texts(batch, "text"):
                for i, rule in enumerate(rules):
                    for text in found:
                        began = time.perf_counter()
                        hit[i] += rule.rejects(Stats(text))
                        spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": pa.array(range(len(rules)), pa.int32()), "s": spent, "hit": pa.array(hit, pa.int64())})

    some = docs.select(F.col(text_col).alias("text")).sample(min(1.0, sample_rows / rows), seed=11)
    totals = some.mapInArrow(run, "rule int, s double, hit long").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("hit").alias("hit")).collect()
    worth = {r["rule"]: r["hit"] / max(r["s"], 1e-9) for r in totals}
    return [rules[i].name for i in sorted(range(len(rules)), key=lambda i: (-worth.get(i, 0.0), i))]


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, counts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept, rejected_by`` for every row, with ``counts`` also the words' and lines' counts and ``base_failed``.

    ``rejected_by`` is the first rule that fired in the measured order. Null texts are empty and fail
    ``few_words``. Repeated rows and null ids are judged each for itself; other columns are ignored.
    """
    order = measured_order(docs, rules, sample_rows, text_col)
    steps = sorted(rules, key=lambda r: order.index(r.name))
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if counts else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in texts(batch, "text"):
                rows = []
                for text in found:
                    s = Stats(text)
                    first = next((r.name for r in steps if r.rejects(s)), None)
                    failed = [any(r.rejects(s) for r in BASE)] if counts else []
                    rows.append([*(getattr(s, n) for n in numbers), *failed, first is None, first])
                cols = list(zip(*rows, strict=True))
                kinds = [*[pa.int64()] * len(numbers), *[pa.bool_()] * (1 + counts), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    names = ["doc_id", *numbers, *["base_failed"] * counts, "kept", "rejected_by"]
    schema = "doc_id long" + "".join(f", {n} long" for n in numbers) + ", base_failed boolean" * counts + ", kept boolean, rejected_by string"
    return small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, schema)


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
g as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 2),
k as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from g),
c as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from k where n > 1) group by 1),
s as (select doc_id, len(w) as n_words, list_sum(list_transform(w, lambda x: length(x))) as word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) as up, length(regexp_replace(text, '[^a-z]', '', 'g')) as low,
        (length(text) - length(replace(text, '!!', ''))) // 2 as shouts from w),
a as (select s.*, coalesce(c.n, 0) as n_repeat_words from s left join c using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from a)
select doc_id, n_words::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines
    or not coalesce(word_chars, 0) between 2 * n_words and 12 * n_words or 2 * up > up + low or 10 * shouts > n_words) as kept
from b
"""
