"""Scores of generated code: equivalence verdicts, n-gram overlap, and comparison of program output."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions.verdicts import equivalence
from trustloom.operators.pairs import ordered_pairs
from trustloom.operators.program_runner import FAILED, HUNG, outputs_agree

KEYWORDS = ("and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield")
SCORERS = {
    "white_box": ("sequence_probability", "min_probability", "mean_token_negentropy", "min_token_negentropy", "probability_margin", "monte_carlo_probability", "p_true"),
    "other": ("cosine_sim", "verbalized_confidence", "consistency_and_confidence"),
    "functional": ("functional_equivalence_rate", "functional_negentropy", "functional_sets_confidence"),
    "local": ("codebleu",),
}


def routed(names: list[str]) -> dict[str, list[str]]:
    """Scorers by family; the product of consistency and confidence brings its two factors."""
    wanted = list(names)
    if "consistency_and_confidence" in wanted:
        wanted += [x for x in ("cosine_sim", "sequence_probability") if x not in wanted]
    out = {k: [n for n in wanted if n in v] for k, v in SCORERS.items()}
    bad = [n for n in wanted if not any(n in v for v in SCORERS.values())]
    if bad:
        raise ValueError(f"{', '.join(bad)}: no such scorers")
    return out


def pair_prompt(a: Column, b: Column) -> Column:
    return F.concat(F.lit("Code A:\n"), a, F.lit("\n\nCode B:\n"), b, F.lit("\n"))


def equivalence_scores(responses: DataFrame, provider) -> DataFrame:
    """(prompt_id, i, j, score): equal texts are equivalent unasked; any other distinct pair is asked once, in one order.

    provider: (a, b) -> (a, b, raw_text).
    """
    pairs = ordered_pairs(responses).withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
    asked = provider(pairs.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    known = asked.select(F.col("a").alias("x"), F.col("b").alias("y"), equivalence(F.col("raw_text")).alias("v"))
    rows = pairs.join(known, ["x", "y"], "left")
    return rows.select("prompt_id", "i", "j", F.when(F.col("x") == F.col("y"), 1.0).otherwise(F.col("v")).alias("score"))


def code_tokens(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(r"[A-Za-z_]\w*|\d+(?:\.\d+)?|[^\w\s]"), F.lit(0))


def _bleus(pairs: DataFrame, reference: str, candidate: str, n: int) -> DataFrame:
    """Adds bleus, a struct of the plain and the weighted overlap.  No token holds a blank, so texts of tokens go to Python."""
    @F.pandas_udf("plain double, weighted double")
    def scored(r: pd.Series, c: pd.Series) -> pd.DataFrame:
        from trustloom.operators.program_grams import overlaps

        held = {}
        return pd.DataFrame([overlaps(a, b, n, KEYWORDS, held) for a, b in zip(r, c)], columns=["plain", "weighted"], dtype="float64")

    return pairs.withColumn("bleus", scored(*[F.array_join(code_tokens(F.col(x)), " ") for x in (reference, candidate)]))


def ngram_bleu(pairs: DataFrame, reference: str, candidate: str, n: int = 4, weighted: bool = False) -> DataFrame:
    """Adds bleu: geometric mean of clipped n-gram precisions (each smoothed by one), times the brevity penalty.

    weighted: unigrams that are keywords count five times.
    """
    return _bleus(pairs, reference, candidate, n).withColumn("bleu", F.col("bleus.weighted" if weighted else "bleus.plain")).drop("bleus")


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair of a prompt once, with its number; dealt by the texts too, so all tasks score, and share a large prompt."""
    return pairs.groupBy("prompt_id", "original", "sample").agg(F.count("*").alias("n"))


def _mean_by_prompt(rows: DataFrame, score: Column) -> DataFrame:
    """(prompt_id, codebleu): mean over pairs that have a score."""
    n = F.when(score.isNotNull(), F.col("n"))
    return rows.groupBy("prompt_id").agg(F.try_divide(F.sum(score * F.col("n")), F.sum(n)).alias("codebleu"))


def codebleu(pairs: DataFrame) -> DataFrame:
    """(prompt_id, codebleu): mean over pairs (prompt_id, original, sample) of plain and keyword-weighted n-gram overlap.

    These two parts need no parser, so any language will do; codebleu_of_python
    has the syntax-tree and data-flow parts too.
    """
    rows = _bleus(_distinct_pairs(pairs), "original", "sample", 4)
    return _mean_by_prompt(rows.withColumn("grams", (F.col("bleus.plain") + F.col("bleus.weighted")) / 2.0), F.col("grams"))


def output_matches(actual: Column, expected: Column) -> Column:
    """Whether two program outputs agree: line by line, exactly or as decimal numbers word by word."""
    lines = lambda c: F.transform(F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    number = lambda x: x.try_cast("decimal(38,10)")

    def line(x: Column, y: Column) -> Column:
        a, b = F.split(x, r"\s+"), F.split(y, r"\s+")
        same = F.zip_with(a, b, lambda p, q: F.coalesce(number(p) == number(q), F.lit(False)))
        return (x == y) | ((F.size(a) == F.size(b)) & F.forall(same, lambda z: z))

    a, b = lines(actual), lines(expected)
    return F.when(F.size(a) != F.size(b), False).otherwise(F.forall(F.zip_with(a, b, line), lambda z: z))


def run_cases(rows: DataFrame, timeout: float = 6.0, memory_mb: int = 1024) -> DataFrame:
    """(row_id, passed): each program (row_id, code, cases array<struct<input,output>>) run on its cases in a process of its own.

    The code is untrusted: give executors no credentials or network for this.
    """
    def run(frames):
        import resource
        import subprocess
        import sys

        def bounded():
            resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))

        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                passed = True
                for case in r.cases:
                    try:
                        done = subprocess.run([sys.executable, "-I", "-c", r.code], input=case["input"] or "", capture_output=True, text=True, timeout=timeout, preexec_fn=bounded)
                        passed = done.returncode == 0 and outputs_agree(done.stdout, case["output"] or "")
                    except subprocess.TimeoutExpired:
                        passed = False
                    if not passed:
                        break
                out.append(passed)
            yield pd.DataFrame({"row_id": frame["row_id"], "passed": out})

    return rows.mapInPandas(run, "row_id long, passed boolean")


def grade_programs(rows: DataFrame, timeout: float = 6.0, memory_mb: int = 1024) -> DataFrame:
    """(row_id, passed, error_code, error_message, n_run): each program (row_id, code, entry, cases) on its cases, until one fails.

    With an entry, the function of that name is called with JSON arguments, one
    a line of input, and must return the JSON output; without one (null or
    blank), the program reads its input and its printed output is compared.
    ``timeout`` is for each case; the process as a whole has five seconds more.
    The code is untrusted: give executors no credentials or network for this.
    Null code is an empty program; a program without cases passes.
    """
    import inspect

    from trustloom.operators import program_runner

    source = inspect.getsource(program_runner)

    def run(frames):
        import json
        import resource
        import subprocess
        import sys

        def bounded():
            resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))

        def one(r) -> dict:
            cases = [] if r.cases is None else [{"input": c["input"] or "", "output": c["output"] or ""} for c in r.cases]
            job = json.dumps({"code": r.code or "", "entry": (r.entry or "").strip(), "timeout": timeout, "cases": cases})
            try:
                done = subprocess.run([sys.executable, "-I", "-c", source], input=job, capture_output=True, text=True, timeout=timeout + 5, preexec_fn=bounded)
                return json.loads(done.stdout.rsplit("\n", 1)[-1])
            except subprocess.TimeoutExpired:
                return {"passed": False, "code": HUNG, "message": "The process hung", "n_run": None}
            except ValueError:
                return {"passed": False, "code": FAILED, "message": "The process gave no verdict", "n_run": None}

        for frame in frames:
            said = [one(r) for r in frame.itertuples(index=False)]
            yield pd.DataFrame({
                "row_id": frame["row_id"], "passed": [x["passed"] for x in said], "error_code": pd.array([x["code"] for x in said], "Int32"),
                "error_message": [x["message"] for x in said], "n_run": pd.array([x["n_run"] for x in said], "Int32"),
            })

    return rows.select("row_id", "code", "entry", "cases").mapInPandas(run, "row_id long, passed boolean, error_code int, error_message string, n_run int")


def structure_match(pairs: DataFrame, reference: str, candidate: str) -> DataFrame:
    """Adds syntax_match and flow_match of two Python programs.

    syntax_match is the share of the reference's subtrees, by kinds of nodes
    alone, that the candidate has as often; flow_match the same for steps of data
    flow, names being numbered as they appear, and 1 where the reference has
    none.  Both are null where either text isn't Python or is null.
    """
    @F.pandas_udf("syntax double, flow double")
    def matched(r: pd.Series, c: pd.Series) -> pd.DataFrame:
        from trustloom.operators.program_shape import matches

        held = {}
        return pd.DataFrame([matches(a, b, held) for a, b in zip(r, c)], columns=["syntax", "flow"], dtype="float64")

    return pairs.withColumn("m", matched(F.col(reference), F.col(candidate))).withColumns({"syntax_match": F.col("m.syntax"), "flow_match": F.col("m.flow")}).drop("m")


def codebleu_of_python(pairs: DataFrame) -> DataFrame:
    """(prompt_id, codebleu): mean over pairs (prompt_id, original, sample) of the four parts, each a quarter.

    A pair with an empty or null program has no score, and a prompt without any
    score has null.  Where a text isn't Python, its pair is scored on n-grams.
    """
    rows = structure_match(_bleus(_distinct_pairs(pairs), "original", "sample", 4), "original", "sample")
    grams = (F.col("bleus.plain") + F.col("bleus.weighted")) / 2.0
    whole = F.coalesce((grams * 2.0 + F.col("syntax_match") + F.col("flow_match")) / 4.0, grams)
    present = (F.length("original") > 0) & (F.length("sample") > 0)
    return _mean_by_prompt(rows.withColumn("whole", F.when(present, whole)), F.col("whole"))
