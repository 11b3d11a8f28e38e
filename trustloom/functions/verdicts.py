"""From what a judge wrote to a score; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of each score, in the order in which they are looked for.
TERNARY = ((0.0, ("incorrect", "not correct", "not right", "wrong")), (0.5, ("not sure", "not certain", "unsure", "uncertain")), (1.0, ("correct", "right")))
LIKERT = (
    (0.0, ("1", "completely incorrect", "not correct")), (0.25, ("2", "mostly incorrect", "somewhat correct")), (0.5, ("3", "partially correct", "moderately correct")),
    (0.75, ("4", "mostly correct", "very correct")), (1.0, ("5", "completely correct", "highly correct")),
)
CONFIDENCE = (("no chance", 0.0), ("little chance", 0.2), ("less than even", 0.4), ("fairly possible", 0.6), ("very good chance", 0.8), ("almost certain", 1.0))
SAME = ("are the same", "behave the same", "identical", "same output")
DIFFERENT = ("are different", "behave differently", "not the same", "different output")


def _first(text: Column, buckets) -> Column:
    out = F.lit(None).cast("double")
    for score, phrases in reversed(list(buckets)):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | text.contains(p)
        out = F.when(hit, F.lit(score)).otherwise(out)
    return out


def ternary(c: Column) -> Column:
    return _first(F.lower(c), TERNARY)


def binary(c: Column) -> Column:
    return _first(F.lower(c), (TERNARY[0], TERNARY[2]))


def continuous(c: Column) -> Column:
    """All digits put together, as per cent; over 100 counts as unread."""
    n = F.regexp_replace(c, "[^0-9]", "").try_cast("double")
    return F.when((n >= 0) & (n <= 100), n / 100.0)


def likert(c: Column) -> Column:
    text = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(text.rlike("^[1-5]$"), (text.try_cast("double") - 1.0) / 4.0).otherwise(_first(text, LIKERT))


def structured(c: Column) -> Column:
    """struct<answer, explanation> of a ``Score: ... Explanation: ...`` reply."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    scored, told = c.contains("Score:"), c.contains("Explanation:")
    after = F.split_part(c, F.lit("Score:"), F.lit(2))
    return F.struct(
        F.when(scored & told, strip(F.split_part(after, F.lit("Explanation:"), F.lit(1)))).when(scored, strip(after)).otherwise(c).alias("answer"),
        F.when(scored & told, strip(F.split_part(c, F.lit("Explanation:"), F.lit(2)))).otherwise(F.lit("No explanation provided")).alias("explanation"),
    )


def verbal_confidence(c: Column) -> Column:
    text = F.rtrim(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit("."))
    out = F.lit(None).cast("double")
    for phrase, score in sorted(CONFIDENCE, key=lambda x: len(x[0])):  # the longest is tried first
        out = F.when(text.contains(phrase), score).otherwise(out)
    for phrase, score in CONFIDENCE:
        out = F.when(text == phrase, score).otherwise(out)
    return out


def entails(c: Column) -> Column:
    text = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(text.startswith("yes"), 1.0).when(text.startswith("no"), 0.0).when(c.contains("yes"), 1.0).when(c.contains("no"), 0.0)


def says_yes(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).contains("yes"), F.lit(False))


def is_objective(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).contains("objective"), F.lit(False))


def equivalence(c: Column) -> Column:
    text = F.replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit("-"), F.lit(" "))
    any_of = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: text.contains(p))
    return F.when(text.contains("not equivalent"), 0.0).when(text.contains("equivalent"), 1.0).when(any_of(SAME), 1.0).when(any_of(DIFFERENT), 0.0)


def p_true(token: Column, logprob: Column) -> Column:
    text = F.lower(F.regexp_replace(token, r"^\s+|\s+$", ""))
    return F.when(text.startswith("true"), F.exp(logprob)).when(text.startswith("false"), 1.0 - F.exp(logprob))
