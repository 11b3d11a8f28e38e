"""Text shaping as column expressions: dataset clean-up, code fences, sentences, claims, bullets, questions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

#: Python's strip(): all white space, not only spaces.
_EDGES = r"^\s+|\s+$"

# Abbreviations whose points don't end a sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "vs", "etc", "inc", "ltd", "corp", "co", "st", "ave", "blvd", "rd",
    "ph.d", "m.d", "b.a", "m.a", "u.s", "u.k", "n.y", "l.a", "d.c",
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def digits_only(c: Column) -> Column:
    """Decimal digits of any script."""
    return F.regexp_replace(c, r"\P{Nd}", "")


def without_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def cased(c: Column, kind: DataType, upper: bool) -> Column:
    """Upper or lower case of a string, or of each string of a list; told apart by the schema, not by the data."""
    change = F.upper if upper else F.lower
    return F.transform(c, change) if isinstance(kind, ArrayType) else change(c)


def search(c: Column, pattern: str, group: int = 0) -> Column:
    """The match, or the value itself where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group)).otherwise(c)


def question_with_choices(question: Column, labels: Column, texts: Column) -> Column:
    return F.concat_ws(" ", question, F.array_join(F.zip_with(labels, texts, lambda a, b: F.concat(a, F.lit(") "), b)), " "))


def integer_part(c: Column) -> Column:
    """Digits before the first point."""
    return F.regexp_replace(F.split_part(c, F.lit("."), F.lit(1)), "[^0-9]", "")


def truncated(c: Column, most: int = 2000) -> Column:
    return F.substring(c, 1, most)


def parsed_list(c: Column) -> Column:
    """A list literal with single or double quotes as array<string>."""
    return F.from_json(F.regexp_replace(c, "'", '"'), "array<string>")


def parsed_cases(c: Column) -> Column:
    """Test cases in JSON; malformed input is an error, not a null."""
    return F.from_json(c, "array<struct<input:string,output:string>>", {"mode": "FAILFAST"})


def code_of(c: Column) -> Column:
    """Code inside a model's answer: the longest fenced block (the first of equals), or the text without backticks."""
    text = c
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = strip(text)
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```(?:python|py)?\s*\n(.*?)```"), F.lit(1))
    longest = F.aggregate(blocks, F.lit(""), lambda best, b: F.when(F.length(b) > F.length(best), b).otherwise(best))
    bare = strip(F.regexp_replace(text, "^`+|`+$", ""))
    return F.when(c.isNull(), "").when(~text.contains("```"), bare).when(F.size(blocks) > 0, strip(longest)).otherwise(strip(F.regexp_replace(text, "```+", "")))


#: White space after . ! or ? and before an ASCII capital, but not after an abbreviation's last point.  Points inside
#: numbers and abbreviations have no white space behind them, so they need no rule of their own.
_SENTENCE_END = rf"(?<=[.!?])(?<!(?<![\p{{L}}\p{{N}}_])(?i:{'|'.join(re.escape(x) for x in sorted(ABBREVIATIONS, key=len, reverse=True))})\.)\s+(?=[A-Z])"


def sentences(c: Column) -> Column:
    """Pieces that end in . ! or ? before white space and an ASCII capital; decimals and abbreviations don't end one."""
    return F.transform(F.split(strip(c), _SENTENCE_END), strip)


def no_claims(c: Column) -> Column:
    return c.rlike(r"(?i)###\s*none\b")


def claims(c: Column) -> Column:
    """What follows each ### marker, to the end of its line, with single spaces; none if the text says so."""
    found = F.regexp_extract_all(c, F.lit(r"(?msd)(?:^|\n)\s*###\s*(.+?)(?=\n\s*###|\n\s*$|$)"), F.lit(1))
    found = F.filter(F.transform(found, lambda x: strip(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x) > 0)
    return F.when(no_claims(c), F.array().cast("array<string>")).otherwise(found)


def bullets(c: Column) -> Column:
    """Texts of the lines that begin with a dash."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^[ \t]*-[ \t]*(.+)"), F.lit(1)), strip)


def questions(c: Column, several: bool = True) -> Column:
    """Generated questions between ### marks."""
    if not several:
        return F.array(c)
    return F.filter(F.split(c, "###"), lambda x: F.length(x) > 0)
