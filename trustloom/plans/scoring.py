"""Queries over responses, tokens and embeddings: consistency, clusters, entropy, density, token scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.operators import clustering as C
from trustloom.operators import consistency as K
from trustloom.operators import pairs as P
from trustloom.operators import token_scores as W
from trustloom.plans.registry import query
from trustloom.plans.sql import CLUSTERS, E1, R1, T1, entail, nli
from trustloom.sources import bindings as B


def char_nli(pairs):
    return B.overlap_nli(pairs, B.characters)


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


PAIRS = f"""{R1}, pr AS (
  SELECT o.prompt_id, s.sample_idx, o.text AS original, s.text AS sample, {nli('o.text', 's.text', 'ab')}, {nli('s.text', 'o.text', 'ba')}
  FROM r1 o JOIN r1 s ON o.prompt_id = s.prompt_id WHERE o.sample_idx = 0 AND s.sample_idx > 0)"""
ENTROPY = """cp AS (SELECT prompt_id, cluster_idx, count(*) AS n FROM mb GROUP BY 1, 2), cn AS (SELECT *, n / (sum(n) OVER (PARTITION BY prompt_id))::DOUBLE AS p FROM cp),
 en AS (SELECT prompt_id, abs(sum(p * ln(p))) AS h, count(*)::BIGINT AS k FROM cn GROUP BY 1)"""


@query("blackbox_scores", "J1 B1 B4 B5 B6 B7 B8 B10 P12 C1 C4 C5 C6", f"""WITH RECURSIVE {CLUSTERS}, {ENTROPY}, po AS (
  SELECT prompt_id, avg((a.text = b.text)::INT::DOUBLE) AS em FROM r1 a JOIN r1 b USING (prompt_id) WHERE a.sample_idx = 0 AND b.sample_idx > 0 GROUP BY 1
), co AS (SELECT prompt_id, avg(((1 - contra_ab) + (1 - contra_ba)) / 2) AS nc, avg((entail_ab + entail_ba) / 2) AS et FROM pr WHERE i = 0 GROUP BY 1)
SELECT prompt_id, round(em, 6) AS exact_match, round(nc, 6) AS noncontradiction, round(et, 6) AS entailment, round(1 - h / ln(6.0::DOUBLE), 6) AS semantic_negentropy, round((6 - k) / 5.0::DOUBLE, 6) AS semantic_sets_confidence
FROM en JOIN po USING (prompt_id) JOIN co USING (prompt_id)""")
def blackbox_scores(spark, d):
    r = B.responses(spark, d)
    # all pairs are looked up once; those with the original are among them
    scored = P.with_nli(P.ordered_pairs(r), "a", "b", char_nli)
    members = C.memberships(r, C.equivalent(scored))
    sizes = r.groupBy("prompt_id").agg(F.count("*").alias("n"))
    negentropy = C.entropy(C.cluster_probabilities(members)).join(sizes, "prompt_id").select("prompt_id", (1.0 - F.col("entropy") / F.ln(F.col("n").cast("double"))).alias("semantic_negentropy"))
    out = K.exact_match(r).join(K.of_pairs(scored.where("i = 0")), "prompt_id").join(negentropy, "prompt_id").join(C.sets_confidence(r, members), "prompt_id")
    return rounded(out, "exact_match", "noncontradiction", "entailment", "semantic_negentropy", "semantic_sets_confidence")


@query("exact_match", "J1 B1", f"WITH {R1} SELECT prompt_id, round(avg((a.text = b.text)::INT::DOUBLE), 6) AS exact_match FROM r1 a JOIN r1 b USING (prompt_id) WHERE a.sample_idx = 0 AND b.sample_idx > 0 GROUP BY 1")
def exact_match(spark, d):
    return rounded(K.exact_match(B.responses(spark, d)), "exact_match")


@query("ordered_pairs", "J2", f"WITH {R1} SELECT a.prompt_id, a.sample_idx AS i, b.sample_idx AS j, a.text AS a, b.text AS b FROM r1 a JOIN r1 b ON a.prompt_id = b.prompt_id AND a.sample_idx < b.sample_idx")
def ordered_pairs(spark, d):
    return P.ordered_pairs(B.responses(spark, d))


@query("nli_reuse", "J7", f"""WITH {R1}, p AS (SELECT a.prompt_id, b.sample_idx, a.text AS premise, b.text AS hypothesis FROM r1 a JOIN r1 b ON a.prompt_id = b.prompt_id WHERE a.sample_idx = 0 AND b.sample_idx > 0)
SELECT premise, hypothesis, count(*)::BIGINT AS n, round(min({entail('premise', 'hypothesis')}), 6) AS p_entail, premise < 'N' AS reused FROM p GROUP BY 1, 2""")
def nli_reuse(spark, d):
    pairs = P.original_with_samples(B.responses(spark, d)).select("prompt_id", F.col("original").alias("premise"), F.col("sample").alias("hypothesis"))
    memo = char_nli(pairs.where("premise < 'N'").select("premise", "hypothesis").distinct())
    rows = P.reuse_or_compute(pairs, memo, char_nli)
    return rows.groupBy("premise", "hypothesis").agg(F.count("*").alias("n"), F.round(F.min("p_entail"), 6).alias("p_entail"), F.first("reused").alias("reused"))


@query("cosine_similarity", "B2", f"""WITH {E1} SELECT a.prompt_id, round(avg(0.5::DOUBLE + list_cosine_similarity(a.vec, b.vec) / 2), 6) AS cosine_sim FROM e1 a JOIN e1 b ON a.prompt_id = b.prompt_id WHERE a.sample_idx = 0 AND b.sample_idx > 0 GROUP BY 1""")
def cosine_similarity(spark, d):
    return rounded(K.cosine_sim(B.embeddings(spark, d)).select(F.col("prompt_id").cast("long"), "cosine_sim"), "cosine_sim")


def token_vectors(spark, d):
    """All vectors of a label, by eights, stand for the tokens of its answers."""
    return B.embeddings(spark, d).select(F.col("prompt_id").cast("long"), F.floor(F.col("sample_idx") / 8).cast("int").alias("sample_idx"), (F.col("sample_idx") % 8).alias("token_idx"), "vec")


@query("bert_score", "B3", f"""WITH {E1}, v AS (SELECT prompt_id, sample_idx // 8 AS s, sample_idx % 8 AS t, vec FROM e1 WHERE sample_idx % 1000 < 40),
c AS MATERIALIZED (SELECT a.prompt_id, b.s, a.t AS i, b.t AS j, list_dot_product(a.vec, b.vec) AS dot FROM v a JOIN v b ON a.prompt_id = b.prompt_id WHERE a.s = 0 AND b.s > 0),
re AS (SELECT prompt_id, s, avg(m) AS rv FROM (SELECT prompt_id, s, i, max(dot) AS m FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2),
pe AS (SELECT prompt_id, s, avg(m) AS pv FROM (SELECT prompt_id, s, j, max(dot) AS m FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT prompt_id, round(sum(f) / count(f), 6) AS bert_score FROM (SELECT re.prompt_id, 2.0::DOUBLE * (pv * rv) / (pv + rv) AS f FROM re JOIN pe ON re.prompt_id = pe.prompt_id AND re.s = pe.s) GROUP BY 1""")
def bert_score(spark, d):
    return rounded(K.bert_score(token_vectors(spark, d)), "bert_score")


@query("semantic_clusters", "C1", f"WITH RECURSIVE {CLUSTERS} SELECT prompt_id, cluster_idx, resp_idx FROM mb")
def semantic_clusters(spark, d):
    r = B.responses(spark, d)
    return C.memberships(r, C.equivalences(r, char_nli))


REPS = """rt AS (SELECT m.prompt_id, m.cluster_idx, r.text, count(*) AS c, min(m.resp_idx) AS f FROM mb m JOIN r1 r ON r.prompt_id = m.prompt_id AND r.sample_idx = m.resp_idx GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, cluster_idx ORDER BY CASE WHEN mx > 1 THEN c ELSE length(text) END DESC, f) AS n FROM (SELECT *, max(c) OVER (PARTITION BY prompt_id, cluster_idx) AS mx FROM rt)),
rp AS (SELECT prompt_id, cluster_idx, text FROM rk WHERE n = 1)"""
BEST = f"{REPS}, {ENTROPY}, be AS (SELECT prompt_id, text AS best FROM (SELECT c.prompt_id, rp.text, row_number() OVER (PARTITION BY c.prompt_id ORDER BY c.n DESC, c.cluster_idx) AS n FROM cn c JOIN rp USING (prompt_id, cluster_idx)) WHERE n = 1)"


@query("cluster_representatives", "C2", f"WITH RECURSIVE {CLUSTERS}, {REPS} SELECT prompt_id, cluster_idx, text FROM rp")
def cluster_representatives(spark, d):
    r = B.responses(spark, d)
    return C.representatives(C.memberships(r, C.equivalences(r, char_nli)), r)


def best_of(r):
    members = C.memberships(r, C.equivalences(r, char_nli))
    return C.best_responses(C.cluster_probabilities(members), C.representatives(members, r))


@query("best_response", "C7", f"WITH RECURSIVE {CLUSTERS}, {BEST} SELECT prompt_id, best FROM be")
def best_response(spark, d):
    return best_of(B.responses(spark, d))


@query("use_best", "B9 B11", f"""WITH RECURSIVE {CLUSTERS}, {BEST}, hit AS (SELECT r.prompt_id, min(r.sample_idx) AS lead FROM r1 r JOIN be USING (prompt_id) WHERE r.text = be.best GROUP BY 1),
nw AS (SELECT r.prompt_id, r.text, row_number() OVER (PARTITION BY r.prompt_id ORDER BY r.sample_idx <> h.lead, r.sample_idx) - 1 AS s FROM r1 r JOIN hit h USING (prompt_id))
SELECT a.prompt_id, a.text AS response, round(avg((a.text = b.text)::INT::DOUBLE), 6) AS exact_match FROM nw a JOIN nw b USING (prompt_id) WHERE a.s = 0 AND b.s > 0 GROUP BY 1, 2""")
def use_best(spark, d):
    r = B.responses(spark, d)
    new = C.with_best(r, best_of(r))
    first = new.where("sample_idx = 0").select("prompt_id", F.col("text").alias("response"))
    return rounded(first.join(K.exact_match(new), "prompt_id"), "exact_match")


@query("semantic_entropy", "C3 C4 C5 C6 C8", f"""WITH RECURSIVE {CLUSTERS}, {T1}, {ENTROPY}, sp AS (SELECT prompt_id, sample_idx AS resp_idx, exp(avg(logprob)) AS p FROM t1 GROUP BY 1, 2),
wp AS (SELECT prompt_id, cluster_idx, sum(p) AS p FROM mb JOIN sp USING (prompt_id, resp_idx) GROUP BY 1, 2), wn AS (SELECT prompt_id, p / sum(p) OVER (PARTITION BY prompt_id) AS p FROM wp),
we AS (SELECT prompt_id, abs(sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)) AS t FROM wn GROUP BY 1)
SELECT prompt_id, round(h, 6) AS discrete_entropy_value, k AS num_semantic_set, round(1 - h / ln(6.0::DOUBLE), 6) AS discrete_confidence_score, round(t, 6) AS tokenprob_entropy_value, round(1 - t / ln(6.0::DOUBLE), 6) AS tokenprob_confidence_score
FROM en JOIN we USING (prompt_id)""")
def semantic_entropy(spark, d):
    out = C.semantic_entropy(B.responses(spark, d), char_nli, B.tokens(spark, d))
    return rounded(out, "discrete_entropy_value", "discrete_confidence_score", "tokenprob_entropy_value", "tokenprob_confidence_score")


DENSITY = """sp AS (SELECT prompt_id, sample_idx, exp(avg(logprob)) AS p FROM t1 GROUP BY 1, 2)"""


@query("semantic_density", "C9 W11", f"""WITH {PAIRS}, {T1}, {DENSITY} SELECT prompt_id, round(sum(p * CASE WHEN contra_ab + neutral_ab * (sqrt(2.0::DOUBLE) / 2) <= 1 THEN 1 - (contra_ab + neutral_ab / 2) ELSE 0 END) / sum(p), 6) AS semantic_density_value
FROM pr JOIN sp USING (prompt_id, sample_idx) GROUP BY 1""")
def semantic_density(spark, d):
    rows = P.with_nli(P.original_with_samples(B.responses(spark, d)), "original", "sample", char_nli)
    pairs = rows.select("prompt_id", F.col("sample_idx").alias("resp_idx"), F.col("contra_ab").alias("p_contra"), F.col("neutral_ab").alias("p_neutral"))
    return rounded(C.semantic_density(pairs, C.sequence_probabilities(B.tokens(spark, d))), "semantic_density_value")


def parity_verdicts(pairs):
    """A provider's verdicts on two codes: equivalent if they end alike, no answer where one begins with A."""
    said = F.when(F.col("a").startswith("A") & F.col("b").startswith("N"), "unclear").when(F.substring("a", 2, 1) == F.substring("b", 2, 1), "They are equivalent").otherwise("NOT-equivalent")
    return pairs.withColumn("raw_text", said)


CODE = f"""WITH RECURSIVE {R1}, q AS (SELECT x.prompt_id, x.sample_idx AS i, y.sample_idx AS j, least(x.text, y.text) AS a, greatest(x.text, y.text) AS b FROM r1 x JOIN r1 y ON x.prompt_id = y.prompt_id AND x.sample_idx < y.sample_idx),
sc AS (SELECT prompt_id, i, j, CASE WHEN a = b THEN 1.0::DOUBLE WHEN a LIKE 'A%' AND b LIKE 'N%' THEN NULL WHEN a[2] = b[2] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM q),
el AS (SELECT prompt_id, coalesce(list(i * 1000 + j) FILTER (score = 1), []::INT[]) AS e FROM sc GROUP BY 1),
fold AS (SELECT prompt_id, 0 AS nr, [0] AS leaders FROM el UNION ALL
  SELECT f.prompt_id, f.nr + 1, CASE WHEN len(list_filter(f.leaders, lambda z: list_contains(el.e, z * 1000 + f.nr + 1))) > 0 THEN f.leaders ELSE list_append(f.leaders, f.nr + 1) END FROM fold f JOIN el USING (prompt_id) WHERE f.nr < 5),
ld AS (SELECT prompt_id, unnest(leaders) AS leader, generate_subscripts(leaders, 1) - 1 AS k FROM fold WHERE nr = 5),
m0 AS (SELECT l.prompt_id, r.sample_idx, min(l.k) AS k FROM ld l JOIN r1 r ON r.prompt_id = l.prompt_id JOIN el ON el.prompt_id = l.prompt_id WHERE r.sample_idx = l.leader OR (r.sample_idx > l.leader AND list_contains(el.e, l.leader * 1000 + r.sample_idx)) GROUP BY 1, 2)"""


@query("code_equivalence", "C11 F2 V11", f"{CODE} SELECT prompt_id, i, j, score FROM sc")
def code_equivalence(spark, d):
    from trustloom.operators.code_scores import equivalence_scores

    return equivalence_scores(B.responses(spark, d), parity_verdicts)


@query("functional_entropy", "C10 C12 F2", f"""{CODE}, {T1}, sp AS (SELECT prompt_id, sample_idx, exp(avg(logprob)) AS p FROM t1 GROUP BY 1, 2),
kp AS (SELECT prompt_id, k, count(*) / 6.0::DOUBLE AS p, sum(p) AS w FROM m0 JOIN sp USING (prompt_id, sample_idx) GROUP BY 1, 2), kw AS (SELECT *, w / sum(w) OVER (PARTITION BY prompt_id) AS v FROM kp),
ke AS (SELECT prompt_id, abs(sum(p * ln(p))) AS h, abs(sum(CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) AS g, count(*) AS n FROM kw GROUP BY 1), ra AS (SELECT prompt_id, avg(score) AS rate FROM sc WHERE i = 0 GROUP BY 1)
SELECT prompt_id, round(rate, 6) AS functional_equivalence_rate, round(1 - h / ln(6.0::DOUBLE), 6) AS functional_negentropy, round((6 - n) / 5.0::DOUBLE, 6) AS functional_sets_confidence, round(1 - g / ln(6.0::DOUBLE), 6) AS functional_negentropy_whitebox
FROM ke JOIN ra USING (prompt_id)""")
def functional_entropy(spark, d):
    from trustloom.operators.code_scores import equivalence_scores

    r = B.responses(spark, d)
    out = C.functional_scores(r, equivalence_scores(r, parity_verdicts), C.sequence_probabilities(B.tokens(spark, d)))
    return rounded(out, "functional_equivalence_rate", "functional_negentropy", "functional_sets_confidence", "functional_negentropy_whitebox")


@query("sequence_scores", "W1 W2 W14", f"""WITH {T1} SELECT prompt_id, round(exp(avg(logprob)), 6) AS sequence_probability, round(exp(min(logprob)), 6) AS min_probability FROM t1 WHERE sample_idx = 0 GROUP BY 1""")
def sequence_scores(spark, d):
    return rounded(W.single_scores(B.tokens(spark, d)), "sequence_probability", "min_probability")


@query("sequence_scores_plain", "W1", f"""WITH {T1} SELECT prompt_id, round(exp(sum(logprob)), 6) AS sequence_probability, round(exp(min(logprob)), 6) AS min_probability FROM t1 WHERE sample_idx = 0 GROUP BY 1""")
def sequence_scores_plain(spark, d):
    return rounded(W.single_scores(B.tokens(spark, d), normalize=False), "sequence_probability", "min_probability")


@query("top_token_scores", "W3 W4 W5 W6 W7", f"""WITH {T1}, x AS (SELECT prompt_id, token_idx, list_transform(top, lambda z: exp(z)) AS e FROM t1 WHERE sample_idx = 0), y AS (SELECT prompt_id, list_transform(e, lambda z: z / list_sum(e)) AS p, list_reverse_sort(e) AS s FROM x),
w AS (SELECT prompt_id, 1 + list_sum(list_transform(p, lambda z: CASE WHEN z > 0 THEN z * ln(z) ELSE 0 END)) / ln(3.0::DOUBLE) AS n, s[1] - s[2] AS m FROM y)
SELECT prompt_id, round(avg(n), 6) AS mean_token_negentropy, round(min(n), 6) AS min_token_negentropy, round(avg(m), 6) AS probability_margin FROM w GROUP BY 1""")
def top_token_scores(spark, d):
    return rounded(W.top_scores(B.tokens(spark, d), top_k=3), "mean_token_negentropy", "min_token_negentropy", "probability_margin")


@query("text_entropy", "W3", f"""WITH {R1}, {T1}, z AS (SELECT prompt_id, text, sum(exp(logprob)) AS p FROM r1 JOIN t1 USING (prompt_id, sample_idx) WHERE token_idx = 0 GROUP BY 1, 2), s AS (SELECT *, p / sum(p) OVER (PARTITION BY prompt_id) AS q FROM z)
SELECT prompt_id, round(abs(sum(q * ln(q))), 6) AS entropy FROM s GROUP BY 1""")
def text_entropy(spark, d):
    rows = B.responses(spark, d).join(B.tokens(spark, d).where("token_idx = 0"), ["prompt_id", "sample_idx"]).select("prompt_id", "text", "logprob")
    return rounded(W.text_entropy(rows), "entropy")


@query("monte_carlo_probability", "W8", f"""WITH {T1} SELECT prompt_id, round(avg(p), 6) AS monte_carlo_probability FROM (SELECT prompt_id, sample_idx, exp(avg(logprob)) AS p FROM t1 GROUP BY 1, 2) GROUP BY 1""")
def monte_carlo_probability(spark, d):
    return rounded(W.monte_carlo(B.tokens(spark, d)), "monte_carlo_probability")


@query("consistency_and_confidence", "W9", f"""WITH {R1}, {T1}, m AS (SELECT a.prompt_id, avg((a.text = b.text)::INT::DOUBLE) AS s FROM r1 a JOIN r1 b ON a.prompt_id = b.prompt_id WHERE a.sample_idx = 0 AND b.sample_idx > 0 GROUP BY 1), p AS (SELECT prompt_id, exp(avg(logprob)) AS p FROM t1 WHERE sample_idx = 0 GROUP BY 1)
SELECT prompt_id, round(s * p, 6) AS consistency_and_confidence FROM m JOIN p USING (prompt_id)""")
def consistency_and_confidence(spark, d):
    return rounded(W.consistency_and_confidence(K.exact_match(B.responses(spark, d)), B.tokens(spark, d), "exact_match"), "consistency_and_confidence")


@query("p_true_options", "W12", f"WITH {R1} SELECT prompt_id, CASE WHEN count(DISTINCT text) > 1 THEN array_to_string(list_sort(list_distinct(list(text))), ' | ') ELSE '' END AS options FROM r1 GROUP BY 1")
def p_true_options(spark, d):
    return W.p_true_options(B.responses(spark, d))


@query("whitebox_negentropy", "W10", f"""WITH RECURSIVE {CLUSTERS}, {T1}, sp AS (SELECT prompt_id, sample_idx AS resp_idx, exp(avg(logprob)) AS p FROM t1 GROUP BY 1, 2), wp AS (SELECT prompt_id, cluster_idx, sum(p) AS p FROM mb JOIN sp USING (prompt_id, resp_idx) GROUP BY 1, 2), wn AS (SELECT prompt_id, p / sum(p) OVER (PARTITION BY prompt_id) AS p FROM wp)
SELECT prompt_id, round(1 - abs(sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)) / ln(6.0::DOUBLE), 6) AS semantic_negentropy FROM wn GROUP BY 1""")
def whitebox_negentropy(spark, d):
    out = C.semantic_entropy(B.responses(spark, d), char_nli, B.tokens(spark, d))
    return rounded(out.select("prompt_id", F.col("tokenprob_confidence_score").alias("semantic_negentropy")), "semantic_negentropy")
