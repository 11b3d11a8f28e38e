"""Prompts by name, in our own words; what they ask for fits the parsers of ``text`` and ``verdicts``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINES = "Write each on a line of its own that begins with ###. If there is nothing to list, write ### NONE."

#: How an answer is taken apart, by the name of the style.
DECOMPOSITION = {
    "zhang_2025": f"List the facts that the text states, each understandable without the others. {_LINES}",
    "farquhar_2024": f"List every specific factual statement of the text, leaving none out. {_LINES}",
    "mohri_2024": f"Split the text into small independent statements that can each be true or false. {_LINES}",
    "jiang_2024": f"Rewrite the text as short atomic claims, naming their subjects instead of using pronouns. {_LINES}",
}
#: How entailment is asked for, by the name of the style.
ENTAILMENT = {
    "binary": "Does the source support the claim? Reply Yes or No.",
    "p_true": "Is it true that the source supports the claim? Reply True or False.",
    "p_false": "Is it true that the source contradicts the claim? Reply True or False.",
    "p_neutral": "Is it true that the source neither supports nor contradicts the claim? Reply True or False.",
    "nli_classification": "Does the source entail, contradict or neither entail nor contradict the claim? Reply entailment, contradiction or neutral.",
}


def decomposition(text: Column, style: str | Callable[[Column], Column] = "zhang_2025") -> Column:
    """The prompt of a named style, or of a function of the text."""
    if callable(style):
        return style(text)
    if not isinstance(style, str):
        raise TypeError("style must be a name or a function")
    if style not in DECOMPOSITION:
        raise ValueError(f"style must be one of {', '.join(DECOMPOSITION)}")
    return F.concat(F.lit(DECOMPOSITION[style] + "\n\nText:\n"), text)


def entailment(claim: Column, source: Column, style: str = "binary") -> Column:
    if style not in ENTAILMENT:
        raise ValueError(f"style must be one of {', '.join(ENTAILMENT)}")
    return F.concat(F.lit(ENTAILMENT[style] + "\n\nClaim: "), claim, F.lit("\nSource: "), source)


def reconstruction(question: Column, claims: Column) -> Column:
    """Asks for an answer from the kept claims (array<string>) alone."""
    return F.concat(F.lit("Answer the question using only these statements.\n\nQuestion: "), question, F.lit("\n"), F.array_join(F.transform(claims, lambda c: F.concat(F.lit("- "), c)), "\n"))


def merging(master: Column, sampled: Column) -> Column:
    """Asks which sampled claims the master list lacks, as a list with dashes."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(F.lit("List the new claims that the known ones don't cover, each on a line that begins with a dash.\n\nKnown:\n"), listed(master), F.lit("\n\nNew:\n"), listed(sampled))
