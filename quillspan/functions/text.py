"""Text functions. A null text is an empty one; blanks are all Unicode white space."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space of Unicode, as the inside of a character class.
BLANK = r"\x09-\x0D\x1C-\x20\x85\xA0  -     　"
#: Where lines end.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
_NOT_ASCII = r"[^\x00-\x7F]"


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in texts.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Compatibility composition; texts in ASCII don't leave the JVM."""
    odd = text.rlike(_NOT_ASCII)
    return F.coalesce(F.when(odd, _nfkc(F.when(odd, text))).otherwise(text), F.lit(""))


@F.arrow_udf(StringType())
def _nfkc_joined(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else "".join(unicodedata.normalize("NFKC", x).split()) for x in texts.to_pylist()], pa.string())


_nfkc_joined = _nfkc_joined.asNondeterministic()  # else a filter on the text would have it made twice


def nfkc_without_blanks(text: Column) -> Column:
    """``without_blanks(nfkc(text))`` for a projection: made once a row, in one pass; texts in ASCII don't leave the JVM."""
    odd = text.rlike(_NOT_ASCII)
    return F.coalesce(F.when(odd, _nfkc_joined(F.when(odd, text))).otherwise(F.regexp_replace(text, r"[\x09-\x0D\x1C-\x20]+", "")), F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"[{BLANK}]+", "")


def normalize_text(text: Column) -> Column:
    """NFKC, stripped; null gives an empty text."""
    return strip(nfkc(text))


def normalize_for_match(text: Column) -> Column:
    """NFKC without any blanks, lower case."""
    return F.lower(without_blanks(nfkc(text)))


def matched_word(word: str) -> str:
    """A word as ``normalize_for_match`` leaves it."""
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", word)).lower()


def is_blank_or_placeholder(text: Column, words: list[str]) -> Column:
    """Whether nothing or only one of the placeholder words is there."""
    known = sorted(set(map(matched_word, words)))
    own = normalize_for_match(text)
    return (own == "") | own.isin(known) if known else own == ""


def clean_branch_name(text: Column, prefix: str) -> Column:
    """NFKC without the brand's name, whatever its case, stripped."""
    brand = re.escape(prefix)
    own = F.regexp_replace(strip(nfkc(text)), f"(?i)^{brand}[{BLANK}]*", "")
    return strip(F.regexp_replace(own, f"(?i){brand}", ""))


DECORATION = r"・,.:;!?\-_*#=~\"'()\[\]<>|/"


def count_plain_chars(text: Column, decoration: str = DECORATION) -> Column:
    """Code points that are neither blank nor decoration, of a text that is normalised already."""
    return F.length(F.regexp_replace(text, f"[{BLANK}{decoration}]", ""))


def count_effective_chars(text: Column, decoration: str = DECORATION) -> Column:
    """Code points that are neither blank nor decoration."""
    return count_plain_chars(nfkc(text), decoration)


def is_demo_name(name: Column, family: str, full: str) -> Column:
    """The family name is the demo word, or the name without blanks starts with the demo name; an empty word matches nothing."""
    own = normalize_text(name)
    first = (F.split(own, f"[{BLANK}]+")[0] == family) if family else F.lit(False)
    return first | without_blanks(own).startswith(full) if full else first


def split_id_name(text: Column, detail: bool = False) -> Column:
    """``id, name`` from ``id name``. In the detail form a blank must stand between, and bracketed readings go."""
    gap = f"[{BLANK}]+" if detail else f"[{BLANK}]*"

    def parts(own: Column) -> Column:
        code = F.regexp_extract(own, f"^([0-9A-Za-z-]+){gap}(.*)$", 1)
        rest = F.regexp_extract(own, f"^([0-9A-Za-z-]+){gap}(.*)$", 2)
        name = F.when(code == "", own).otherwise(rest)
        if detail:
            name = strip(F.regexp_replace(name, r"\([^)]*\)|\[[^\]]*\]", ""))
        return F.struct(code.alias("id"), strip(name).alias("name"))

    return F.transform(F.array(normalize_text(text)), parts)[0]  # the cell is normalised once


def split_flag_from_name(name: Column, marker: str, flag: str) -> Column:
    """``name, flag``: the marker word becomes the flag and leaves the name; without it the flag is OK."""
    own = F.coalesce(name, F.lit(""))
    return F.struct(strip(F.replace(own, F.lit(marker), F.lit(""))).alias("name"), F.when(F.contains(own, F.lit(marker)), flag).otherwise("OK").alias("flag"))


def labelled_line(text: Column, label: str) -> Column:
    """What follows ``label:`` on the last line that has it; nothing or blanks give null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?m)^[ \t]*{re.escape(label)}[ \t]*[:：][ \t]*([^\r\n]*)$"), F.lit(1))
    return F.when(F.size(found) > 0, F.nullif(strip(F.element_at(found, -1)), F.lit("")))


def strip_control_chars(text: Column) -> Column:
    """Without U+0000 to U+001F, but tab, line feed and carriage return stay."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def page_kind(url: Column, part: str, detail: str = "detail", other: str = "lesson") -> Column:
    return F.when(F.contains(F.coalesce(url, F.lit("")), F.lit(part)), detail).otherwise(other)


def clip(text: Column, most: int, marker: str) -> Column:
    """The text, cut at ``most`` code points with a marker after the cut."""
    own = F.coalesce(text, F.lit(""))
    return F.when(F.length(own) > most, F.concat(F.substring(own, 1, most), F.lit(marker))).otherwise(own)


def fill_missing(text: Column, default: str = "-") -> Column:
    return F.coalesce(F.nullif(text.cast("string"), F.lit("")), F.lit(default))


def json_list(text: Column) -> Column:
    """The strings of a JSON list; null or bad JSON give none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_bool_map(text: Column) -> Column:
    """The map of a JSON object; null or bad JSON give an empty one."""
    return F.coalesce(F.from_json(text, "map<string,boolean>"), F.create_map().cast("map<string,boolean>"))


def active_targets(checks: Column) -> Column:
    """Keys that are checked, in order; a single ``-`` if none is."""
    on = F.array_sort(F.map_keys(F.map_filter(F.coalesce(checks, F.create_map().cast("map<string,boolean>")), lambda _, v: F.coalesce(v, F.lit(False)))))
    return F.when(F.size(on) == 0, F.array(F.lit("-"))).otherwise(on)
