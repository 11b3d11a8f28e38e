"""Secret scans: fixed patterns, and character Markov models for what has no pattern.

All of it is DataFrame expressions, training included.  Two models hold how
likely one character follows another, in random strings and in ordinary
identifiers; each run inside a long token whose log-likelihood ratio is at least
``least`` is a secret, whatever it is joined to.  Log ratios are kept as whole thousandths, so sums don't depend on
their order.

Spans are in code points, end exclusive, and cover a whole match, or a run of a
token outside the base spans.  Rows: null
texts count as empty; repeated rows give repeated rows; an empty table gives no
rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns. A minimal length replaces a later test where that can't change the matches.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")

#: What the models look at: tokens of 20 characters and more.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Log-likelihood ratio that makes a secret, in nats.
LEAST = 8.0
#: Labelled strings of each kind that a model is trained on.
SAMPLES = 4000
BLOCK = 64

WORDS = """the and for with from this that have not are was will can all one new out use time data file name path user list item key
value index count size type node tree table row column query result error message request response server client session
config default option parameter argument function method class object module package import export version update create
delete insert select order group filter search find load save read write open close start stop begin end first last next
previous current total average maximum minimum length width height color image text string number integer float boolean
date hour minute second day week month year address phone email account customer product price invoice payment report
donde cuando porque entre sobre maison toujours bonjour pendant quelque zwischen immer heute strasse wieder gewesen""".split()


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _spans(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<a,b,s>> of the matches: begin, end, string; from the lengths of matches and of what lies between."""
    none = F.array().cast("array<struct<a:int,b:int,s:string>>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = _let(matches, lambda m: F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.struct(F.length(g).alias("g"), F.length(x).alias("m"), x.alias("s"))))

    # the matches are found once; blocks, which begin where the lengths before them sum to, keep
    # the work on a text with very many of them from growing with their square
    def placed(held: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int"))
        of = lambda k: F.slice(held, k * BLOCK + 1, F.lit(BLOCK))
        sizes = F.transform(blocks, lambda k: F.aggregate(of(k), F.lit(0), lambda x, p: x + p["g"] + p["m"]))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(sizes, begin, lambda x, n: F.struct((x["at"] + n).alias("at"), F.array_append(x["out"], x["at"]).alias("out")), lambda x: x["out"])

        def step(x: Column, p: Column) -> Column:
            a = x["at"] + p["g"]
            return F.struct((a + p["m"]).alias("at"), F.array_append(x["out"], F.struct(a.alias("a"), (a + p["m"]).alias("b"), p["s"].alias("s"))).alias("out"))

        return F.flatten(F.zip_with(blocks, begins, lambda k, at: F.aggregate(of(k), F.struct(at.alias("at"), none.alias("out")), step, lambda x: x["out"])))

    found = F.when(text.rlike(pattern), _let(parts, placed)).otherwise(none)
    return F.filter(found, keep) if keep is not None else found


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(text, random): n random strings and n ordinary identifiers, the same ones each time."""
    rows = spark.range(n)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    raw = F.base64(F.unhex(digest))
    length = 20 + F.col("id") % 21
    plain = F.regexp_replace(raw, "[+/=\\s]", "")
    strings = F.when(F.col("id") % 4 == 0, digest).when(F.col("id") % 4 == 1, F.upper(plain)).when(F.col("id") % 4 == 2, plain).otherwise(F.regexp_replace(raw, "\\s", ""))
    random = rows.select(F.substring(strings, F.lit(1), length).alias("text"), F.lit(True).alias("random"))
    words = F.array(*map(F.lit, WORDS))

    def word(k: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))

    four = [word(k) for k in range(4)]
    style = F.col("id") % 8
    ordinary = (
        F.when(style == 0, F.concat_ws("_", *four))
        .when(style == 1, F.concat(four[0], *[F.initcap(x) for x in four[1:]]))
        .when(style == 2, F.concat_ws("-", *four))
        .when(style == 3, F.upper(F.concat_ws("_", *four)))
        .when(style == 4, F.concat_ws("/", *four))
        .when(style == 5, F.concat(F.concat_ws("_", *four[:3]), F.lit("_"), (F.pmod(F.xxhash64("id"), F.lit(2100))).cast("string")))
        .when(style == 6, F.concat(*[F.initcap(x) for x in four]))
        .otherwise(F.concat(*four))
    )
    return random.union(rows.select(ordinary.alias("text"), F.lit(False).alias("random")))


def train(labelled: DataFrame) -> list[int]:
    """Log ratios in thousandths for each pair of symbols, by previous symbol (0: start) and next one.

    labelled: (text, random).  Only counts of pairs reach the driver, at most
    two for each pair of symbols.
    """
    symbol = F.lit(ALPHABET)
    pairs = labelled.where(F.length("text") > 0).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.struct(F.when(i > 1, F.position(F.substring("text", i - 1, F.lit(1)), symbol)).otherwise(0).alias("p"), F.position(F.substring("text", i, F.lit(1)), symbol).alias("c")))).alias("x"))
    counts = {(r.random, r.p, r.c): r.n for r in pairs.where("x.c > 0").groupBy("random", F.col("x.p").alias("p"), F.col("x.c").alias("c")).agg(F.count("*").alias("n")).collect()}
    size = len(ALPHABET)
    out = []
    for p in range(size + 1):
        totals = {kind: sum(counts.get((kind, p, c), 0) for c in range(1, size + 1)) for kind in (True, False)}
        for c in range(1, size + 1):
            # half a count for each pair keeps unseen ones possible
            likely = [math.log((counts.get((kind, p, c), 0) + 0.5) / (totals[kind] + 0.5 * size)) for kind in (True, False)]
            out.append(round(1000 * (likely[0] - likely[1])))
    return out


def secret_runs(token: Column, base: Column, model: list[int], least: int) -> Column:
    """array<struct<a,k,b>> of the runs of a token <a,b,s> whose log ratios sum to ``least`` thousandths.

    The sum starts anew where it falls to zero, by ``least`` under its peak, or
    where a base span lies; a run ends at its peak.
    """
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    none = F.array().cast("array<struct<a:int,k:int,b:int>>")

    def state(p, at, total, begin, peak, end, out) -> Column:
        return F.struct(p.alias("p"), at.alias("at"), total.alias("sum"), begin.alias("begin"), peak.alias("peak"), end.alias("end"), out.alias("out"))

    def closed(x: Column) -> Column:
        run = F.struct(x["begin"].alias("a"), F.lit(3).alias("k"), x["end"].alias("b"))
        return F.when(x["peak"] >= least, F.array_append(x["out"], run)).otherwise(x["out"])

    def of(own: Column) -> Column:
        def step(x: Column, c: Column) -> Column:
            k = F.position(c, F.lit(ALPHABET))
            total = x["sum"] + F.coalesce(F.get(table, x["p"] * len(ALPHABET) + k - 1), F.lit(0))
            taken = F.exists(own, lambda b: (b["a"] <= x["at"]) & (x["at"] < b["b"]))
            seen = F.struct(k.alias("k"), total.alias("total"), taken.alias("taken"))

            def moved(y: Column) -> Column:
                after, higher = x["at"] + 1, y["total"] > x["peak"]
                anew = state(y["k"], after, F.lit(0), after, F.lit(0), after, closed(x))
                on = state(y["k"], after, y["total"], x["begin"], F.greatest(x["peak"], y["total"]), F.when(higher, after).otherwise(x["end"]), x["out"])
                return F.when(y["taken"] | (y["total"] <= 0) | (y["total"] <= x["peak"] - least), anew).otherwise(on)

            return _let(seen, moved)

        start = state(F.lit(0), token["a"], F.lit(0), token["a"], F.lit(0), token["a"], none)
        return F.aggregate(F.split(token["s"], ""), start, step, closed)

    return _let(F.filter(base, lambda b: (b["a"] < token["b"]) & (token["a"] < b["b"])), of)


def scan(docs: DataFrame, model: list[int] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and markov: arrays of (a, k, b) with begin, number of the kind in KINDS, end; sorted."""
    model = model or train(labelled_samples(docs.sparkSession))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of(k: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["a"].alias("a"), F.lit(k).alias("k"), x["b"].alias("b")))

    long_value = lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= ASSIGN_LEAST
    base = F.array_sort(F.concat(of(0, _spans(text, ASSIGN, long_value)), of(1, _spans(text, ACCESS)), of(2, _spans(text, HEX))))
    tokens = _spans(text, TOKEN)
    rows = docs.select(F.col(id_col), base.alias("base"), tokens.alias("tokens"))
    new = F.flatten(F.transform("tokens", lambda t: secret_runs(t, F.col("base"), model, round(1000 * least))))
    return rows.select(id_col, "base", new.alias("markov"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["a"].cast("string"), x["b"].cast("string"))), ",")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size("markov").cast("long").alias("n_markov"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "markov"))).alias("spans"),
    )
