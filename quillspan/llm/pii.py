"""Personal data by candidate gradient boosting, in DataFrame operations and ``pyspark.ml`` only.

Strict patterns with checks give the base spans, which always stay. Besides them, generators of high recall
propose overlapping candidates: mail addresses that are spelled out, dotted numbers with odd dots, card-like
and phone-like groups inside longer runs, and numbers with any separators. Boosted trees look at a candidate's
format (groups, separators, checksum) and its context, and an isotonic curve for each kind, fitted on other
examples, turns their margin into a probability. Candidates over their kind's threshold that touch no base span are added;
where they overlap, the likelier one stays.

The trees learn from planted spans: each of at most ``carriers`` texts, chosen by a hash, gets every known
spelling of every kind, and every decoy (dates, versions, amounts, serial numbers, wrong checksums), at a
place of its own. A candidate that is the planted span is a positive example; one of a decoy, or one that
takes too little or too much, is a negative one. Candidates that stand in the texts by themselves are no
examples: nobody knows what they are, and the base patterns' silence is no proof. So the model does not depend
on how many real spans there are, and is the same for a small table and a large one.

The trees are applied as a SQL expression inside the row, so no text is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.shared import bound, mixed_bits

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Leftmost matches; the runs are possessive and start where a run starts, so no text is read over and over.
PATTERNS = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_AT = r"(?:@|\x20?\(at\)\x20?|\x20?\[at\]\x20?|\x20at\x20|\x20@\x20)"
_DOT = r"(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20|\x20\.\x20|\[\.\]|\(\.\))"
#: Generators and the kind they propose; -1 leaves it to the number of digits.
GENERATORS = (
    (0, rf"[\p{{L}}0-9._%+-]{{1,64}}{_AT}[\p{{L}}0-9-]{{1,63}}(?:{_DOT}[\p{{L}}0-9-]{{2,63}}){{1,5}}"),
    (1, rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])"),
    (2, r"(?<![0-9])[0-9]{4}([\x20._/-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    (3, r"(?:(?<![0-9])00|\+|(?<![0-9+]))(?:[0-9]{1,3}[\x20./-])?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,3}[0-9]{2,8}){1,3}(?![0-9])"),
    (3, r"(?:(?<![0-9])00|\+|(?<![0-9+]))(?:[0-9]{1,3}[\x20./-])?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,3}[0-9]{2,8}){1,2}(?![0-9])"),
    (-1, r"\+?\(?[0-9][\x20().0-9/_-]{6,}[0-9]"),
)
FEATURES = ("kind", "gen", "size", "digits", "groups", "first", "last", "longest", "spaces", "points", "dashes", "marks", "plus", "paren", "luhn", "octets", "before", "after", "cue")
_SPAN = "struct<kind:int,start:int,end:int>"
_CANDIDATE = "struct<kind:int,start:int,end:int," + ",".join(f"{f}:int" for f in FEATURES[1:]) + ">"
#: Code points of the blocks that a text is cut into, so that what stands at a place is found without walking to it.
_PIECE = 1024


def scanned(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running sums, or maxima, of an array of numbers.

    By blocks: an array that grows by an element at a time is copied each time, so only those within a block of
    512 do, and then that of the blocks' totals.
    """
    block = 512

    def grown(a: Column) -> Column:
        return F.aggregate(a, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(merge(x, F.element_at(acc, -1))))))

    def blocks(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda i: grown(F.slice(a, i * block + 1, block)))

    def joined(parts: Column) -> Column:
        totals = grown(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, F.concat(F.array(F.lit(None).cast("int")), F.slice(totals, 1, F.size(parts) - 1)), lambda p, t: F.transform(p, lambda x: F.when(t.isNull(), x).otherwise(merge(x, t)))))

    return bound(values, lambda a: F.when(F.size(a) <= block, grown(a)).otherwise(bound(blocks(a), joined)))


def located(text: Column, pattern: str, context: int = 0) -> Column:
    """All matches as an array of ``start, end, hit``, counted in code points from 0; with a ``context``, also as many characters before it, at least, as ``near`` and the one after it as ``next``.

    Places are running sums of lengths, and context comes from the neighbouring pieces, so no text is walked for each match.
    """

    def places(pieces: Column) -> Column:
        gaps, hits = pieces["gaps"], pieces["hits"]

        def one(hit: Column, i: Column) -> Column:
            end = F.get(pieces["ends"], i)
            cols = [(end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit")]
            if context:
                back = F.greatest(i - 4, F.lit(0))  # a candidate has six characters or more
                around = F.zip_with(F.slice(gaps, back + 1, i - back), F.slice(hits, back + 1, i - back), lambda g, h: F.concat(g, h))
                near = F.concat(F.array_join(around, ""), F.get(gaps, i))
                cols += [F.right(near, F.lit(context)).alias("near"), F.substr(F.concat(F.coalesce(F.get(gaps, i + 1), F.lit("")), F.coalesce(F.get(hits, i + 1), F.lit(""))), F.lit(1), F.lit(1)).alias("next")]
            return F.struct(*cols)

        return F.transform(hits, one)

    def summed(pieces: Column) -> Column:
        lengths = F.transform(pieces["hits"], lambda h, i: F.length(F.get(pieces["gaps"], i)) + F.length(h))
        return F.struct(pieces["gaps"].alias("gaps"), pieces["hits"].alias("hits"), scanned(lengths, lambda x, y: x + y).alias("ends"))

    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return bound(bound(found, summed), places)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _octets(hit: Column) -> Column:
    """Whether each part of digits is at most 255."""
    parts = F.transform(F.split(hit, "[^0-9]+"), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def luhn_sum(digits: Column) -> Column:
    """The sum of digits from the right, every second one doubled; a multiple of 10 for a valid number."""

    def total(d: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            x = F.substr(d, i, F.lit(1)).cast("int")
            return acc + F.when(i % 2 == 0, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

        return F.when(F.length(d) > 0, F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step)).otherwise(0)

    return bound(F.reverse(digits), total)


def _card(hit: Column) -> Column:
    return bound(_digits(hit), lambda d: F.length(d).between(16, 19) & (luhn_sum(d) % 10 == 0))


def base_spans(text: Column) -> Column:
    """``array<struct<kind, start, end>>`` in the order of kind and start; ``text`` must not be null."""
    checks: tuple[Callable[[Column], Column], ...] = (lambda h: F.lit(True), _octets, _card, lambda h: F.length(_digits(h)).between(8, 15))
    present = (F.contains(text, F.lit("@")), text.rlike("[0-9]"), text.rlike("[0-9]"), F.contains(text, F.lit("+")))
    none = F.array().cast(f"array<{_SPAN}>")

    def of(kind: int) -> Column:
        good = F.filter(located(text, PATTERNS[kind]), lambda m: checks[kind](m["hit"]))
        return F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*(F.when(there, of(kind)).otherwise(none) for kind, there in enumerate(present)))


def candidates(text: Column) -> Column:
    """The generators' spans with the features of format and context, an array of structs."""
    digits = text.rlike(r"[0-9][\x20().0-9/_-]{4,}[0-9]")
    present = (text.rlike(r"@|\(at\)|\[at\]") | (F.contains(text, F.lit(" at ")) & F.contains(text, F.lit(" dot "))), text.rlike(rf"[0-9]{_DOT}[0-9]{{1,3}}{_DOT}[0-9]"), digits, digits, digits, digits)

    def sort(char: Column) -> Column:
        return F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike(r"[0-9]"), 2).when(char.rlike(r"\p{L}"), 3).when(char.rlike(r"[\"'=:]"), 4).when(char.rlike(r"[(+/_.-]"), 6).otherwise(5)

    def count(hit: Column, other: str) -> Column:
        return F.least(F.length(F.regexp_replace(hit, other, "")), F.lit(9))

    def with_features(gen: int, own_kind: int) -> Callable[[Column], Column]:
        def features(m: Column) -> Column:
            hit = m["hit"]
            groups = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))
            n = F.length(_digits(hit))
            kind = F.lit(own_kind) if own_kind >= 0 else F.when((n >= 13) & ~hit.startswith("+"), 2).otherwise(3)
            near = F.lower(m["near"])
            cue = F.when(near.rlike(r"tel|phone|call|mobil|fax|whatsapp"), 3).when(near.rlike(r"card|visa|konto|account|amex"), 2).when(near.rlike(r"mail|contact|write to"), 1).when(near.rlike(r"version|isbn|token|key|order|serial|\bid\b|\bno\b|\$|€"), 4).otherwise(0)
            size = lambda g: F.least(F.length(F.coalesce(g, F.lit(""))), F.lit(20))
            return F.struct(
                kind.cast("int").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lit(gen).alias("gen"), F.least(F.length(hit), F.lit(60)).alias("size"),
                F.least(n, F.lit(40)).alias("digits"), F.least(F.size(groups), F.lit(12)).alias("groups"), size(F.get(groups, F.lit(0))).alias("first"), size(F.get(groups, F.size(groups) - 1)).alias("last"),
                F.coalesce(F.array_max(F.transform(groups, size)), F.lit(0)).alias("longest"), count(hit, r"[^\x20]").alias("spaces"), count(hit, r"[^.]").alias("points"), count(hit, r"[^_/-]").alias("dashes"),
                F.when(hit.rlike(r"\(at\)|\[at\]|\x20at\x20|\(dot\)|\[dot\]|\x20dot\x20|\[\.\]|\(\.\)|\x20[@.]\x20"), 1).otherwise(0).alias("marks"),
                hit.startswith("+").cast("int").alias("plus"), F.contains(hit, F.lit("(")).cast("int").alias("paren"), F.when(n.between(13, 19), (luhn_sum(_digits(hit)) % 10 == 0).cast("int")).otherwise(0).alias("luhn"),
                (_octets(F.regexp_replace(hit, r"^[^0-9]+|[^0-9]+$", "")) & (n > 0)).cast("int").alias("octets"),
                sort(F.right(m["near"], F.lit(1))).alias("before"), sort(m["next"]).alias("after"), cue.alias("cue"),
            )

        return features

    none = F.array().cast(f"array<{_CANDIDATE}>")
    parts = [F.when(there, F.transform(located(text, g, 24), with_features(i, own))).otherwise(none) for i, ((own, g), there) in enumerate(zip(GENERATORS, present, strict=True))]
    return F.concat(*parts)


def _touch(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


# Spellings as templates: # is any digit, N a number up to 255, ~ a word; ABDE are the four groups of a card number
# with a right checksum and FGHI those of another, PQRS the groups of one with a wrong checksum; all else stands for
# itself. What braces enclose is planted as a span of the kind; a template without braces is a decoy.
SPELLINGS: tuple[tuple[int, str], ...] = (
    *((0, x) for x in ("{~.~@~.com}", "{~(at)~(dot)com}", "{~ (at) ~ (dot) org}", "{~[at]~[dot]net}", "{~.~ at ~ dot com}", "{~ @ ~ . com}", "{~@~(dot)co(dot)uk}", "{~ (at) ~.com}", "{~@~[.]com}")),
    *((1, x) for x in ("{N.N.N.N}", "{N[.]N[.]N[.]N}", "{N(.)N(.)N(.)N}", "{N . N . N . N}", "{N dot N dot N dot N}", "{N(dot)N(dot)N(dot)N}", "{N[.]N.N.N}")),
    *((2, x) for x in ("{ABDE}", "{ABDE} {FGHI}", "{ABDE} ####", "{A-B-D-E}", "{A.B.D.E}", "{A/B/D/E}", "{A_B_D_E}", "{A B D E} {F G H I}", "{A-B-D-E} - ##", "+# (###) ###-#### {ABDE}")),
    *((3, x) for x in ("{+# (###) ###-####}", "{(###) ###-####}", "{###-###-####}", "{###.###.####}", "{###/#######}", "{0### ######}", "{00## ### #######}", "{+# (###) ###-####} N.N.N.N", "{+## ## #### ####} {+## ## #### ####}", "{+## ### #######} ABDE", "{0##-########}", "{(0##) #### ####}")),
    *(
        (-1, x)
        for x in (
            "20##-0#-1#", "20##-0#-1# 1#:##:##", "1#.0#.20##", "1#.0#.20## - 2#.0#.20##", "0#/1#/20##", "20##/20##", "19##-20##", "#.#.##.####", "v#.##.#.#", "#.##.###", "#,###,###.##", "$ ###,###.##", "### ### ###", "## ### ###",
            "no ############", "order ##########", "id ########", "978-#-##-######-#", "##.###### ##.######", "PQRS", "P-Q-R-S", "P Q R S", "PQRS PQRS", "P.Q.R.S", "#### #### ####", "###-##-####", "##:##:## ##", "(####) ##", "### - ###", "## / ## / ##",
            "9##.4##.3##.8##", "4##[.]#[.]6##[.]9##", "~ at ~. In dot ~", "~ at ~", "@~ and @~", "~ @ #.## each", "##/####/####", "#########", "##############", "####################", "### ## # ####",
        )
    ),
)
_WORDS = ("info", "anna", "jsmith", "office", "m.weber", "mail", "acme", "example", "uni-nord", "host7", "lyceum", "server")
_BEFORE = ("", "", "", "mail ", "tel. ", "card: ", "at ", "(", '"', "server ", "")
_AFTER = ("", "", ",", ".", ")", '"', " ", ";", "", "")


def _last_id(ids: DataFrame, most: int) -> tuple[int, int | None]:
    """How many of the ``most`` smallest different ids there are, and the last of them; no text travels for it."""
    share = 50 * most / max(1, ids.count())
    for part in ids.where(F.col("id") < int(share * (1 << 64)) - (1 << 63)) if share < 1 else None, ids:
        found = part.distinct().orderBy("id").limit(most).agg(F.count(F.lit(1)), F.max("id")).first() if part is not None else (0, None)
        if found[0] == most:
            break
    return found[0], found[1]


def planted(docs: DataFrame, carriers: int, text_col: str = "text") -> DataFrame:
    """``id, form, kind, t, spans, whole``: lines with one spelling or decoy each, the spans planted and the whole stretch.

    Each of at most ``carriers`` different texts, chosen by a hash, gives a line of words for every spelling, cut
    at a place drawn from the whole text; fewer texts give several lines each, so there are as many in all.
    """

    def drawn(n: int, *of: Column, seed: int) -> Column:
        return F.pmod(mixed_bits(F.col("id"), F.col("form"), *of, seed=seed), F.lit(n)).cast("int")

    def pick(words: tuple[str, ...], *of: Column, seed: int) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), drawn(len(words), *of, seed=seed) + 1)

    def card(seed: int, right: bool) -> Column:
        d = F.concat((drawn(4, seed=seed) + 3).cast("string"), F.lpad(F.pmod(mixed_bits(F.col("id"), F.col("form"), seed=seed + 1), F.lit(10**14)).cast("string"), 14, "0"))
        return bound(d, lambda x: F.concat(x, F.pmod(F.lit(1000) - luhn_sum(F.concat(x, F.lit("0"))) + (0 if right else drawn(9, seed=seed + 2) + 1), F.lit(10)).cast("string")))

    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.xxhash64(text).alias("id"), text.alias("t"))
    n, last = _last_id(own.select("id"), carriers)
    own = own.where(F.col("id") <= F.lit(last).cast("long")).groupBy("id").agg(F.min("t").alias("t"))
    again = F.explode(F.sequence(F.lit(1), F.lit(-(-carriers // max(1, n)))))  # few texts give several lines each
    own = own.select("id", "t", again.alias("nth")).select(F.xxhash64("id", "nth").alias("id"), "t")
    spot = lambda seed: F.pmod(mixed_bits(F.col("id"), seed=seed), F.greatest(F.length("t"), F.lit(1))).cast("int") + 1
    left, right = (F.regexp_replace(F.substr(F.col("t"), spot(n), F.lit(50)), p, "") for n, p in ((1, r"^\S*\s?|[0-9@+]"), (2, r"\s?\S*$|[0-9@+]")))
    forms = [{"form": n, "kind": kind, "chars": list(x), "from": [i for i, c in enumerate(x) if c == "{"], "to": [i for i, c in enumerate(x) if c == "}"]} for n, (kind, x) in enumerate(SPELLINGS)]
    forms = F.from_json(F.lit(json.dumps(forms)), "array<struct<form:int,kind:int,chars:array<string>,`from`:array<int>,`to`:array<int>>>")
    rows = own.select("id", left.alias("l"), right.alias("r")).repartition("id").select("id", "l", "r", F.explode(forms).alias("f")).select("id", "l", "r", "f.*")
    rows = rows.withColumns({"good": card(10, True), "other": card(20, True), "wrong": card(30, False)})

    def piece(c: Column, i: Column) -> Column:
        out = F.when(c == "#", drawn(10, i, seed=40).cast("string")).when(c == "N", drawn(256, i, seed=50).cast("string")).when(c == "~", pick(_WORDS, i, seed=60)).when(c.isin("{", "}"), "")
        for name, groups in (("good", "ABDE"), ("other", "FGHI"), ("wrong", "PQRS")):
            for k, g in enumerate(groups):
                out = out.when(c == g, F.substr(F.col(name), F.lit(4 * k + 1), F.lit(4)))
        return out.otherwise(c)

    rows = rows.withColumn("pieces", F.transform("chars", piece)).withColumn("head", F.concat(F.col("l"), F.when(F.length("l") > 0, " ").otherwise(""), pick(_BEFORE, seed=70)))
    upto = lambda k: (F.length("head") + F.length(F.array_join(F.slice("pieces", F.lit(1), k), ""))).cast("int")
    spans = F.transform(F.arrays_zip("from", "to"), lambda e: F.struct(upto(e["from"]).alias("start"), upto(e["to"]).alias("end")))
    whole = F.struct(F.length("head").cast("int").alias("start"), upto(F.size("pieces")).alias("end"))
    line = F.concat(F.col("head"), F.array_join("pieces", ""), pick(_AFTER, seed=80), F.when(F.length("r") > 0, " ").otherwise(""), F.col("r"))
    return rows.select("id", "form", "kind", line.alias("t"), spans.alias("spans"), whole.alias("whole"))


@dataclass
class Model:
    """Trees as nested ``(feature, cut, left, right)`` or a leaf's value with their weights, and for each kind a rising curve of ``(margin, probability)`` steps and a threshold."""

    trees: list = field(default_factory=list)
    curves: dict[int, list[tuple[float, float]]] = field(default_factory=dict)
    thresholds: dict[int, float] = field(default_factory=dict)

    def margin(self, c: Column) -> Column:
        def tree(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            return F.when(c[FEATURES[node[0]]] <= node[1], tree(node[2])).otherwise(tree(node[3]))

        out = F.lit(0.0)
        for weight, root in self.trees:
            out = out + F.lit(weight) * tree(root)
        return out

    def probability(self, c: Column) -> Column:
        def curve(m: Column) -> Column:
            out = F.lit(0.0)
            for kind, steps in self.curves.items():
                own = F.lit(steps[0][1])
                for cut, p in steps[1:]:
                    own = F.when(m >= cut, p).otherwise(own)
                out = F.when(c["kind"] == kind, own).otherwise(out)
            return out

        return bound(self.margin(c), curve)

    def threshold(self, c: Column) -> Column:
        out = F.lit(2.0)
        for kind, cut in self.thresholds.items():
            out = F.when(c["kind"] == kind, cut).otherwise(out)
        return out


def isotonic(found: list[tuple[float, float, float]], margin_step: float = 0.05) -> list[tuple[float, float]]:
    """Rising steps ``(margin, probability)`` from counts ``(margin, all, good)``, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # first margin, all, good
    for m, n, good in sorted(found):
        blocks.append([m, n, good])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, n_, good_ = blocks.pop()
            blocks[-1][1] += n_
            blocks[-1][2] += good_
    return [(m - margin_step / 2, good / n) for m, n, good in blocks]


def _parsed(debug: str):
    """A regression tree from the text that Spark prints for it."""
    lines = [x.strip() for x in debug.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]

    def node(at: int):
        if lines[at].startswith("Predict"):
            return float(lines[at].split(":")[1]), at + 1
        f, cut = re.search(r"feature (\d+) <= ([-\d.E]+)", lines[at]).groups()
        left, at = node(at + 1)
        right, at = node(at + 1)
        return (int(f), float(cut), left, right), at

    return node(0)[0]


def examples(docs: DataFrame, carriers: int, text_col: str = "text") -> DataFrame:
    """``half, label, weight`` and the features: candidates that touch a planted span or a decoy, equal ones together as one weighted row."""
    rows = planted(docs, carriers, text_col)
    rows = rows.select("id", "form", "kind", "spans", "whole", F.explode(candidates(F.col("t"))).alias("c")).where(F.exists(F.when(F.size("spans") > 0, F.col("spans")).otherwise(F.array("whole")), lambda s: _touch(F.col("c"), s)))
    equal = F.exists("spans", lambda s: (s["start"] == F.col("c.start")) & (s["end"] == F.col("c.end"))) & (F.col("c.kind") == F.col("kind"))
    half = F.pmod(mixed_bits(F.col("id"), F.col("form"), seed=77), F.lit(2)).cast("int")
    rows = rows.select(half.alias("half"), equal.cast("double").alias("label"), *(F.col(f"c.{f}").alias(f) for f in FEATURES))
    return rows.groupBy("half", "label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def fit(docs: DataFrame, precision: float = 0.95, carriers: int = 60, trees: int = 15, depth: int = 4, text_col: str = "text") -> Model:
    """Trees, their curve and thresholds from what is planted in at most ``carriers`` texts, chosen by a hash.

    Half of the examples grow the trees; on the other half each kind gets its curve from margin to probability,
    and the lowest probability from which on at least ``precision`` of the examples are right. An empty
    table gives a model that adds nothing; any other one, however small, the same examples for each text.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = examples(docs, carriers, text_col).coalesce(1).sortWithinPartitions("half", "label", *FEATURES).persist()  # a bounded sample
    try:
        if rows.isEmpty():
            return Model()
        learned = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=5).fit(
            VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows.where("half = 0"))
        )
        model = Model([(float(w), _parsed(t.toDebugString)) for w, t in zip(learned.treeWeights, learned.trees, strict=True)])
        step = 0.05
        m = F.round(model.margin(F.struct(*FEATURES)) / step) * step
        by_kind: dict[int, list] = {}
        counts = rows.where("half = 1").groupBy("kind", m.alias("m")).agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("good"))
        for r in counts.collect():  # four kinds, some hundred steps of a margin of some trees
            by_kind.setdefault(r["kind"], []).append((r["m"], r["n"], r["good"]))
        for kind, found in by_kind.items():
            model.curves[kind] = isotonic(found, step)
            for cut, p in reversed(model.curves[kind]):
                above = [(n, good) for at, n, good in found if at >= cut]
                if p >= 0.5 and sum(g for _, g in above) >= precision * sum(n for n, _ in above):
                    model.thresholds[kind] = p
        return model
    finally:
        rows.unpersist()


def added_spans(df: DataFrame, text: str, base: str, model: Model, out: str) -> DataFrame:
    """Adds ``out``: the base spans and those the model adds, in the order of kind and start.

    Of candidates that overlap, the one of the highest probability stays, then the longer, then the earlier one.
    ``text`` must not be null. Each step is a column of its own, under the name of ``out``.
    """
    if not model.thresholds:
        return df.withColumn(out, F.col(base))
    none = F.array().cast(f"array<{_SPAN}>")

    def scored(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), model.probability(c).alias("p"), c["kind"].alias("kind"), model.threshold(c).alias("cut"))

    def best(cluster: Column) -> Column:
        ranked = F.sort_array(F.transform(cluster, lambda c: F.struct(c["p"].alias("p"), (c["end"] - c["start"]).alias("size"), (-c["start"]).alias("early"), F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")).alias("s"))), asc=False)
        return F.aggregate(ranked, none, lambda acc, x: F.when(F.exists(acc, lambda a: _touch(a, x["s"])), acc).otherwise(F.concat(acc, F.array(x["s"]))))

    df = df.withColumn(out, candidates(F.col(text))).withColumn(out, untouched(F.col(base), F.col(out)))
    df = df.withColumn(out, F.filter(F.transform(out, scored), lambda x: x["p"] >= x["cut"]))
    df = df.withColumn(out, F.when(F.size(out) > 0, clusters(F.col(out))))
    return df.withColumn(out, F.when(F.col(out).isNull(), F.col(base)).otherwise(F.array_sort(F.concat(base, F.flatten(F.transform(out, best))))))


def untouched(spans: Column, others: Column) -> Column:
    """Those of ``others`` that touch none of ``spans``, by one sorted sweep.

    Spans stand in it at their starts, the others at their ends: one of these touches a span exactly if the
    largest end of the spans before it lies behind its start.
    """

    def sweep(c: Column) -> Column:
        marks = F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("span"), s["end"].alias("until"), F.lit(None).cast(_CANDIDATE).alias("c")))
        asked = F.transform(c, lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("span"), F.lit(-1).alias("until"), x.alias("c")))

        def kept(line: Column) -> Column:
            until = scanned(F.transform(line, lambda x: x["until"]), lambda x, y: F.greatest(x, y))
            return bound(until, lambda u: F.transform(F.filter(line, lambda x, i: (x["span"] == 0) & (F.get(u, i) <= x["c"]["start"])), lambda x: x["c"]))

        return F.when((F.size(spans) == 0) | (F.size(c) == 0), c).otherwise(bound(F.array_sort(F.concat(marks, asked)), kept))

    return bound(others, sweep)


def clusters(spans: Column) -> Column:
    """The spans by start, cut into arrays wherever one begins at or behind the end of all before it."""

    def cut(line: Column) -> Column:
        def runs(ends: Column) -> Column:
            firsts = F.filter(F.sequence(F.lit(0), F.size(line) - 1), lambda i: (i == 0) | (F.get(line, i)["start"] >= F.get(ends, i - 1)))
            return bound(firsts, lambda f: F.transform(f, lambda first, j: F.slice(line, first + 1, F.coalesce(F.get(f, j + 1), F.size(line)) - first)))

        return bound(scanned(F.transform(line, lambda x: x["end"]), lambda x, y: F.greatest(x, y)), runs)

    return bound(F.array_sort(spans), cut)


def find_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` for every row: arrays of ``kind`` (a number into ``KINDS``), ``start`` and ``end`` in code points.

    Null texts count as empty. Repeated rows and null ids are searched each for itself; other columns
    are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    own = own.select("doc_id", "t", base_spans(F.col("t")).alias("base"))
    return added_spans(own, "t", "base", model, "spans").select("doc_id", "base", "spans")


def masked(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows, with personal data in their text replaced by its kind; null texts stay null, other columns stay as they are."""
    taken = {c.lower() for c in docs.columns}
    t, base, spans = (next(n for i in range(len(taken) + 1) if (n := f"{name}_{i}") not in taken) for name in ("pii_text", "pii_base", "pii_spans"))
    own = docs.withColumn(t, F.coalesce(F.col(text_col), F.lit(""))).withColumn(base, base_spans(F.col(t)))
    own = added_spans(own, t, base, model, spans)
    return own.withColumn(text_col, F.when(F.col(text_col).isNotNull(), redacted(F.col(t), F.col(spans)))).select(*docs.columns)


def is_kind(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every stretch of touching spans replaced by the first one's kind in angle brackets."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def parts(x: Column) -> Column:
        line, ends, blocks = x["line"], x["ends"], x["blocks"]

        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / _PIECE).cast("int")
            held = F.array_join(F.slice(blocks, first + 1, F.floor(b / _PIECE).cast("int") - first + 1), "")
            return F.substr(held, a % _PIECE + 1, b - a)

        def one(s: Column, i: Column) -> Column:
            before = F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
            return F.when(s["start"] < before, "").otherwise(F.concat(piece(before, s["start"]), F.element_at(names, s["kind"] + 1)))

        last = F.get(ends, F.size(line) - 1)
        return F.concat(F.array_join(F.transform(line, one), ""), piece(last, F.length(text)))

    def ended(line: Column) -> Column:
        ends = scanned(F.transform(line, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
        return F.struct(line.alias("line"), ends.alias("ends"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)).alias("blocks"))

    return F.when(F.size(spans) == 0, text).otherwise(bound(bound(ordered, ended), parts))
