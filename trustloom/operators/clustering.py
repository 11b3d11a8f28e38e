"""Semantic clusters of a prompt's responses, their entropy, and what follows from them.

A response is compared with the first member (leader) of each cluster before
it.  It joins every cluster whose leader it is equivalent to, so clusters may
overlap, and leads a new one if there is none.  The leaders are found by a fold
over each prompt's own matrix, which has a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustloom.operators.pairs import Nli, ordered_pairs, with_nli

_WIDE = 1_000_000


def equivalences(responses: DataFrame, nli: Nli) -> DataFrame:
    """(prompt_id, i, j) with i < j where either direction's likeliest class is entailment."""
    return equivalent(with_nli(ordered_pairs(responses), "a", "b", nli))


def equivalent(pairs: DataFrame) -> DataFrame:
    """The same of ordered pairs with their probabilities."""
    return pairs.where(F.col("top_ab") | F.col("top_ba")).select("prompt_id", "i", "j")


def memberships(responses: DataFrame, edges: DataFrame, exclusive: bool = False) -> DataFrame:
    """(prompt_id, cluster_idx, resp_idx); exclusive: a response joins the first matching cluster only."""
    sizes = responses.groupBy("prompt_id").agg(F.count("*").cast("int").alias("n"))
    lists = edges.groupBy("prompt_id").agg(F.collect_set(F.col("i").cast("long") * _WIDE + F.col("j")).alias("e"))
    rows = sizes.join(lists, "prompt_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<bigint>")))

    def step(leaders, i):
        joins = F.exists(leaders, lambda x: F.array_contains(F.col("e"), x.cast("long") * _WIDE + i))
        return F.when(joins, leaders).otherwise(F.array_append(leaders, i))

    leaders = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.array().cast("array<int>"), step)
    rows = rows.withColumn("leaders", leaders).select("prompt_id", "n", "e", F.posexplode("leaders").alias("cluster_idx", "leader"))
    own = F.filter(F.sequence(F.col("leader"), F.col("n") - 1), lambda i: (i == F.col("leader")) | F.array_contains(F.col("e"), F.col("leader").cast("long") * _WIDE + i))
    found = rows.select("prompt_id", "cluster_idx", F.explode(own).alias("resp_idx"))
    if exclusive:
        found = found.groupBy("prompt_id", "resp_idx").agg(F.min("cluster_idx").alias("cluster_idx")).select("prompt_id", "cluster_idx", "resp_idx")
    return found


def representatives(members: DataFrame, responses: DataFrame) -> DataFrame:
    """(prompt_id, cluster_idx, text): the commonest text if it occurs twice, else the longest; the first of equals."""
    rows = members.join(responses.select("prompt_id", F.col("sample_idx").alias("resp_idx"), "text"), ["prompt_id", "resp_idx"])
    texts = rows.groupBy("prompt_id", "cluster_idx", "text").agg(F.count("*").alias("c"), F.min("resp_idx").alias("first"))
    top = F.max("c").over(Window.partitionBy("prompt_id", "cluster_idx"))
    ranked = texts.withColumn("key", F.when(top > 1, F.col("c")).otherwise(F.length("text")))
    best = ranked.groupBy("prompt_id", "cluster_idx").agg(F.max(F.struct("key", (-F.col("first")).alias("f"), "text"))["text"].alias("text"))
    return best


def sequence_probabilities(tokens: DataFrame, normalize: bool = True) -> DataFrame:
    """(prompt_id, resp_idx, p): length-normalised or plain probability of each response; null if a token lacks one."""
    total = F.avg("logprob") if normalize else F.sum("logprob")
    whole = F.count("*") == F.count("logprob")
    return tokens.groupBy("prompt_id", F.col("sample_idx").alias("resp_idx")).agg(F.when(whole, F.exp(total)).alias("p"))


def cluster_probabilities(members: DataFrame, p: DataFrame | None = None) -> DataFrame:
    """(prompt_id, cluster_idx, p): members' probabilities (uniform without p), renormalised over overlapping clusters."""
    if p is None:
        rows = members.withColumn("p", F.lit(1.0))
    else:
        rows = members.join(p, ["prompt_id", "resp_idx"], "left")
    by = rows.groupBy("prompt_id", "cluster_idx").agg(F.when(F.count("*") == F.count("p"), F.sum("p")).alias("p"))
    w = Window.partitionBy("prompt_id")
    whole = F.count("p").over(w) == F.count("*").over(w)
    return by.select("prompt_id", "cluster_idx", F.when(whole, F.try_divide(F.col("p"), F.sum("p").over(w))).alias("p"))


def entropy(clusters: DataFrame) -> DataFrame:
    """(prompt_id, entropy, n_sets) of cluster probabilities; null if any is missing."""
    term = F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(F.when(F.col("p") == 0, 0.0))
    return clusters.groupBy("prompt_id").agg(F.when(F.count("*") == F.count("p"), F.abs(F.sum(term))).alias("entropy"), F.count("*").alias("n_sets"))


def best_responses(clusters: DataFrame, reps: DataFrame) -> DataFrame:
    """(prompt_id, best): the representative of the first of the most probable clusters."""
    rows = clusters.join(reps, ["prompt_id", "cluster_idx"])
    return rows.groupBy("prompt_id").agg(F.max(F.struct("p", (-F.col("cluster_idx")).alias("k"), F.col("text").alias("best")))["best"].alias("best"))


def semantic_entropy(responses: DataFrame, nli: Nli, tokens: DataFrame | None = None, normalize: bool = True) -> DataFrame:
    """Discrete entropy, its confidence 1 - H / ln(m + 1), number of sets, and with tokens the probability-weighted variants."""
    members = memberships(responses, equivalences(responses, nli))
    sizes = responses.groupBy("prompt_id").agg(F.count("*").alias("n"))
    confidence = lambda c: F.when(F.col("n") > 1, 1.0 - F.col(c) / F.ln(F.col("n").cast("double"))).otherwise(1.0)
    found = entropy(cluster_probabilities(members)).select("prompt_id", F.col("entropy").alias("discrete_entropy_value"), F.col("n_sets").alias("num_semantic_set"))
    out = sizes.join(found, "prompt_id").withColumn("discrete_confidence_score", confidence("discrete_entropy_value"))
    if tokens is not None:
        weighted = entropy(cluster_probabilities(members, sequence_probabilities(tokens, normalize))).select("prompt_id", F.col("entropy").alias("tokenprob_entropy_value"))
        out = out.join(weighted, "prompt_id").withColumn("tokenprob_confidence_score", confidence("tokenprob_entropy_value"))
    return out.drop("n")


def sets_confidence(responses: DataFrame, members: DataFrame) -> DataFrame:
    """(prompt_id, semantic_sets_confidence): (m + 1 - sets) / m."""
    sizes = responses.groupBy("prompt_id").agg(F.count("*").alias("n"))
    sets = members.groupBy("prompt_id").agg(F.countDistinct("cluster_idx").alias("k"))
    return sizes.join(sets, "prompt_id").select("prompt_id", F.try_divide((F.col("n") - F.col("k")).cast("double"), (F.col("n") - 1).cast("double")).alias("semantic_sets_confidence"))


def with_best(responses: DataFrame, best: DataFrame) -> DataFrame:
    """Responses renumbered with the best one first, its first occurrence taken out of the samples; was: the old number."""
    hit = responses.join(best, "prompt_id").withColumn("hit", F.col("text") == F.col("best"))
    first = F.min(F.when(F.col("hit"), F.col("sample_idx"))).over(Window.partitionBy("prompt_id"))
    rows = hit.withColumn("lead", F.coalesce(F.col("sample_idx") == first, F.lit(False)))
    n = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.col("lead").desc(), "sample_idx")) - 1
    return rows.select("prompt_id", n.alias("sample_idx"), "text", F.col("sample_idx").alias("was"))


def semantic_density(prompts_pairs: DataFrame, p: DataFrame) -> DataFrame:
    """(prompt_id, semantic_density_value): kernel of the original-to-sample probabilities, weighted by sample probability.

    prompts_pairs: (prompt_id, resp_idx, p_contra, p_neutral).
    """
    close = F.col("p_contra") + F.col("p_neutral") * (F.sqrt(F.lit(2.0)) / 2.0) <= 1.0
    kernel = F.when(close, 1.0 - (F.col("p_contra") + F.col("p_neutral") / 2.0)).otherwise(0.0)
    rows = prompts_pairs.join(p, ["prompt_id", "resp_idx"], "left").withColumn("k", kernel)
    whole = F.count("*") == F.count("p")
    return rows.groupBy("prompt_id").agg(F.when(whole, F.try_divide(F.sum(F.col("p") * F.col("k")), F.sum("p"))).alias("semantic_density_value"))


def functional_scores(responses: DataFrame, scores: DataFrame, p: DataFrame | None = None) -> DataFrame:
    """Scores of a partition by pairwise equivalence 0 / 1 (missing scores match nothing).

    scores: (prompt_id, i, j, score) with i < j.  Adds the rate over pairs with
    the original, negentropy, sets confidence, and with p the weighted negentropy.
    """
    members = memberships(responses, scores.where("score = 1.0").select("prompt_id", "i", "j"), exclusive=True)
    sizes = responses.groupBy("prompt_id").agg(F.count("*").alias("n"))
    rate = scores.where("i = 0").groupBy("prompt_id").agg(F.avg("score").alias("functional_equivalence_rate"))
    plain = entropy(cluster_probabilities(members))
    norm = lambda c: F.when(F.col("n") > 1, 1.0 - F.col(c) / F.ln(F.col("n").cast("double"))).otherwise(1.0)
    out = sizes.join(plain, "prompt_id").join(rate, "prompt_id", "left").withColumn("functional_negentropy", norm("entropy")).withColumn("functional_sets_confidence", F.try_divide((F.col("n") - F.col("n_sets")).cast("double"), (F.col("n") - 1).cast("double")))
    if p is not None:
        weighted = entropy(cluster_probabilities(members, p)).select("prompt_id", F.col("entropy").alias("e"))
        out = out.join(weighted, "prompt_id").withColumn("functional_negentropy_whitebox", norm("e")).drop("e")
    return out.drop("n", "entropy", "n_sets")
