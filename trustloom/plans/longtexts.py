"""Queries over long answers: claims, their support, graphs of claims, refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions import prompts
from trustloom.functions import text as T
from trustloom.operators import claim_graph as G
from trustloom.operators import longform as L
from trustloom.operators import pairs as P
from trustloom.plans.registry import query
from trustloom.plans.scoring import rounded
from trustloom.plans.sql import E1, R2, entail, words
from trustloom.sources import bindings as B


def word_nli(pairs):
    return B.overlap_nli(pairs, B.words)


def claims_of(spark, d):
    """All sentences of the long answers: of the originals, and of the samples."""
    rows = L.decomposed(B.long_responses(spark, d))
    return rows.where("sample_idx = 0"), rows.where("sample_idx > 0")


CLAIMS = f"""{R2}, dc AS (SELECT prompt_id, sample_idx, unnest(p) AS claim, (generate_subscripts(p, 1) - 1)::INT AS claim_idx FROM (
  SELECT prompt_id, sample_idx, (string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+([A-Z])', '\\1<SPLIT>\\2', 'g'), '<SPLIT>'))[1:6] AS p FROM r2)),
cl AS (SELECT prompt_id, claim_idx, claim FROM dc WHERE sample_idx = 0 AND length(claim) > 0)"""
THREE = "e AS entailment, 1 - (1 - e) * 0.6::DOUBLE AS noncontradiction, e / (e + (1 - e) * 0.6::DOUBLE) AS contrasted_entailment"
UNIT = f"""{CLAIMS}, un AS (SELECT prompt_id, claim_idx, claim, {THREE} FROM (SELECT c.prompt_id, c.claim_idx, c.claim, {entail('left(r.text, 2000)', 'c.claim', words)} AS e FROM cl c JOIN r2 r ON r.prompt_id = c.prompt_id AND r.sample_idx > 0)),
us AS (SELECT prompt_id, claim_idx, claim, avg(entailment) AS entailment, avg(noncontradiction) AS noncontradiction, avg(contrasted_entailment) AS contrasted_entailment FROM un GROUP BY 1, 2, 3)"""


def unit_scores(spark, d):
    original, _ = claims_of(spark, d)
    scores = L.unit_response(original, B.long_responses(spark, d).where("sample_idx > 0"), word_nli)
    return original.select("prompt_id", "claim_idx", "claim").join(scores, ["prompt_id", "claim_idx"])


@query("decomposed_responses", "L1 P14", f"WITH {CLAIMS} SELECT prompt_id, sample_idx, claim_idx, claim FROM dc WHERE length(claim) > 0")
def decomposed_responses(spark, d):
    a, b = claims_of(spark, d)
    return a.union(b)


@query("unit_response", "J3 L2 L6", f"WITH {UNIT} SELECT prompt_id, claim_idx, round(entailment, 6) AS entailment, round(noncontradiction, 6) AS noncontradiction, round(contrasted_entailment, 6) AS contrasted_entailment FROM us")
def unit_response(spark, d):
    return rounded(unit_scores(spark, d).drop("claim"), *L.NLI_SCORES)


@query("unit_response_verdicts", "L3 V8 J10", f"""WITH {UNIT}, c AS (SELECT prompt_id, claim_idx, (entailment > 0.4::DOUBLE)::INT::DOUBLE AS v FROM un) SELECT prompt_id, claim_idx, round(avg(v), 6) AS entailment, round(avg(v), 6) AS noncontradiction, round(avg(v), 6) AS contrasted_entailment FROM c GROUP BY 1, 2""")
def unit_response_verdicts(spark, d):
    original, _ = claims_of(spark, d)
    pairs = P.claims_with_responses(original, B.long_responses(spark, d).where("sample_idx > 0")).select("prompt_id", "claim_idx", "resp_idx", T.truncated(F.col("response")).alias("premise"), F.col("claim").alias("hypothesis"))
    cells = word_nli(pairs).withColumn("score", (F.col("p_entail") > 0.4).cast("double"))
    return rounded(L.unit_response_verdicts(P.as_matrix_cells(cells).withColumn("score", F.col("score").cast("double"))), *L.NLI_SCORES)


@query("matched_unit", "J4 L4", f"""WITH {CLAIMS}, mu AS (SELECT prompt_id, claim_idx, sample_idx, {THREE} FROM (SELECT c.prompt_id, c.claim_idx, o.sample_idx, {entail('o.claim', 'c.claim', words)} AS e FROM cl c JOIN dc o ON o.prompt_id = c.prompt_id AND o.sample_idx > 0 AND length(o.claim) > 0)),
mx AS (SELECT prompt_id, claim_idx, sample_idx, greatest(max(entailment), 0) AS entailment, greatest(max(noncontradiction), 0) AS noncontradiction, greatest(max(contrasted_entailment), 0) AS contrasted_entailment FROM mu GROUP BY 1, 2, 3)
SELECT prompt_id, claim_idx, round(avg(entailment), 6) AS entailment, round(avg(noncontradiction), 6) AS noncontradiction, round(avg(contrasted_entailment), 6) AS contrasted_entailment FROM mx GROUP BY 1, 2""")
def matched_unit(spark, d):
    original, sampled = claims_of(spark, d)
    return rounded(L.matched_unit(original, sampled, word_nli), *L.NLI_SCORES)


def claim_vectors(spark, d, per_claim):
    """All vectors of a label, by eights, stand for the tokens of its answers' claims."""
    n = F.col("sample_idx")
    return B.embeddings(spark, d).select(F.col("prompt_id").cast("long"), F.floor(n / 8).cast("int").alias("sample_idx"), F.floor(n % 8 / per_claim).cast("int").alias("claim_idx"), (n % per_claim).cast("int").alias("token_idx"), "vec")


@query("matched_cosine", "L4", f"""WITH {E1}, c AS (SELECT prompt_id, sample_idx // 8 AS s, sample_idx % 8 AS k, vec FROM e1),
b AS (SELECT x.prompt_id, x.k, y.s, greatest(max(0.5::DOUBLE + list_cosine_similarity(x.vec, y.vec) / 2), 0) AS m FROM c x JOIN c y USING (prompt_id) WHERE x.s = 0 AND y.s > 0 GROUP BY 1, 2, 3)
SELECT prompt_id, k::INT AS claim_idx, round(avg(m), 6) AS cosine_sim FROM b GROUP BY 1, 2""")
def matched_cosine(spark, d):
    return rounded(L.matched_cosine(claim_vectors(spark, d, 1)), "cosine_sim")


@query("matched_tokens", "L4", f"""WITH {E1}, c AS (SELECT prompt_id, sample_idx // 8 AS s, sample_idx % 8 // 2 AS k, sample_idx % 2 AS t, vec FROM e1),
d AS MATERIALIZED (SELECT x.prompt_id, x.k, y.s, y.k AS o, x.t AS i, y.t AS j, list_dot_product(x.vec, y.vec) AS dot FROM c x JOIN c y USING (prompt_id) WHERE x.s = 0 AND y.s > 0),
re AS (SELECT prompt_id, k, s, o, avg(m) AS r FROM (SELECT prompt_id, k, s, o, i, max(dot) AS m FROM d GROUP BY ALL) GROUP BY ALL),
pe AS (SELECT prompt_id, k, s, o, avg(m) AS p FROM (SELECT prompt_id, k, s, o, j, max(dot) AS m FROM d GROUP BY ALL) GROUP BY ALL),
b AS (SELECT prompt_id, k, s, greatest(max(2.0::DOUBLE * (p * r) / (p + r)), 0) AS m FROM re JOIN pe USING (prompt_id, k, s, o) GROUP BY 1, 2, 3)
SELECT prompt_id, k::INT AS claim_idx, round(avg(m), 6) AS bert_score FROM b GROUP BY 1, 2""")
def matched_tokens(spark, d):
    return rounded(L.matched_tokens(claim_vectors(spark, d, 2)), "bert_score")


@query("response_scores", "L5", f"WITH {UNIT} SELECT prompt_id, round(avg(entailment), 6) AS mean_entailment, round(min(entailment), 6) AS min_entailment FROM us GROUP BY 1")
def response_scores(spark, d):
    s = unit_scores(spark, d)
    out = L.response_scores(s, ["entailment"]).withColumnRenamed("entailment", "mean_entailment").join(L.response_scores(s, ["entailment"], "min").withColumnRenamed("entailment", "min_entailment"), "prompt_id")
    return rounded(out, "mean_entailment", "min_entailment")


@query("refined_responses", "L7 L8 L9 L10", f"""WITH {UNIT}, k AS (SELECT *, NOT (entailment > 0.42::DOUBLE) AS removed FROM us)
SELECT k.prompt_id, round(avg(entailment) FILTER (NOT removed), 6) AS refined_entailment, round(avg(noncontradiction) FILTER (NOT removed), 6) AS refined_noncontradiction, coalesce(string_agg(claim, ' ' ORDER BY claim_idx) FILTER (NOT removed), any_value(r.text)) AS refined_response,
  string_agg(claim_idx || ':' || removed, ',' ORDER BY claim_idx) AS claims FROM k JOIN r2 r ON r.prompt_id = k.prompt_id AND r.sample_idx = 0 GROUP BY 1""")
def refined_responses(spark, d):
    rows = L.marked(unit_scores(spark, d), "entailment", 0.42)
    original = B.long_responses(spark, d).where("sample_idx = 0")
    data = L.claims_data(rows, ["entailment"]).select("prompt_id", F.array_join(F.transform("claims_data", lambda x: F.concat_ws(":", x["claim_idx"].cast("string"), x["removed"].cast("string"))), ",").alias("claims"))
    out = L.refined(rows, ["entailment", "noncontradiction"]).join(L.rebuilt(rows, original), "prompt_id").join(data, "prompt_id")
    return rounded(out, "refined_entailment", "refined_noncontradiction")


@query("merged_claims", "L11 J5", f"""WITH {CLAIMS}, f AS (SELECT prompt_id, left(claim, 12) AS claim, min(sample_idx * 1000 + claim_idx) AS k FROM dc WHERE length(claim) > 0 GROUP BY 1, 2)
SELECT prompt_id, (row_number() OVER (PARTITION BY prompt_id ORDER BY k) - 1)::INT AS claim_idx, claim, (k // 1000)::INT AS first_sample FROM f""")
def merged_claims(spark, d):
    a, b = claims_of(spark, d)
    return L.merged_claims(a.union(b))


@query("new_claims", "J5 J6", f"""WITH {CLAIMS}, s AS (SELECT DISTINCT prompt_id, left(claim, 4) AS claim FROM dc WHERE length(claim) > 0 AND sample_idx > 0), o AS (SELECT DISTINCT prompt_id, left(claim, 4) AS claim FROM cl)
SELECT s.prompt_id, s.claim, o.claim IS NOT NULL AS original_response FROM s LEFT JOIN o ON s.prompt_id = o.prompt_id AND s.claim = o.claim""")
def new_claims(spark, d):
    a, b = claims_of(spark, d)
    new = P.new_claims(b, a)
    shared = P.flag_original(b.select("prompt_id", "claim").distinct(), a).where("original_response")
    return new.withColumn("original_response", F.lit(False)).unionByName(shared)


@query("grades_by_claim", "J8 J9 D7 V9", f"""WITH {CLAIMS}, g AS (SELECT prompt_id, claim_idx, contains(lower(claim), 'yes') AS grade FROM cl) SELECT prompt_id, string_agg(grade::VARCHAR, ',' ORDER BY claim_idx) AS grades FROM g GROUP BY 1""")
def grades_by_claim(spark, d):
    from trustloom.functions.verdicts import says_yes

    flat = claims_of(spark, d)[0].select("prompt_id", "claim_idx", says_yes(F.col("claim")).alias("grade"))
    return P.regrouped(flat).select("prompt_id", F.array_join(F.transform("grades", lambda x: x.cast("string")), ",").alias("grades"))


@query("question_answering", "L12 L13 P18", f"""WITH {UNIT}, q AS (SELECT prompt_id, claim_idx, unnest([entailment, noncontradiction]) AS score FROM us), c AS (SELECT prompt_id, claim_idx, avg(score) AS s FROM q GROUP BY 1, 2) SELECT prompt_id, round(avg(s), 6) AS score FROM c GROUP BY 1""")
def question_answering(spark, d):
    answers = unit_scores(spark, d).select("prompt_id", "claim_idx", F.posexplode(F.array("entailment", "noncontradiction")).alias("question_idx", "score"))
    return rounded(L.question_scores(answers)[1], "score")


def cells_of(spark, d):
    """Weights of claims against all responses of their prompt."""
    original, _ = claims_of(spark, d)
    pairs = P.claims_with_responses(original, B.long_responses(spark, d)).select("prompt_id", "claim_idx", "resp_idx", T.truncated(F.col("response")).alias("premise"), F.col("claim").alias("hypothesis"))
    cells = word_nli(pairs).select("prompt_id", "claim_idx", "resp_idx", F.col("p_entail").alias("w"))
    sizes = cells.groupBy("prompt_id").agg((F.max("claim_idx") + 1).alias("n_claims"), F.countDistinct("resp_idx").cast("int").alias("n_responses"))
    return cells, sizes


GRAPH = f"""{CLAIMS}, ce AS (SELECT c.prompt_id, c.claim_idx, r.sample_idx AS resp_idx, {entail('left(r.text, 2000)', 'c.claim', words)} AS w FROM cl c JOIN r2 r ON r.prompt_id = c.prompt_id),
sz AS (SELECT prompt_id, max(claim_idx) + 1 AS c, count(DISTINCT resp_idx) AS r FROM ce GROUP BY 1), ac AS (SELECT *, unnest(range(c))::INT AS claim_idx FROM sz), ed AS (SELECT * FROM ce WHERE w >= 0.5::DOUBLE)"""


@query("claim_edges", "G7", f"WITH {GRAPH} SELECT prompt_id, claim_idx, resp_idx, round(w, 6) AS w FROM ed")
def claim_edges(spark, d):
    return rounded(G.edges_of(cells_of(spark, d)[0]), "w")


@query("graph_degree", "G1", f"WITH {GRAPH}, s AS (SELECT prompt_id, claim_idx, sum(w) AS d FROM ed GROUP BY 1, 2) SELECT a.prompt_id, a.claim_idx, round(coalesce(s.d, 0) / a.r, 5) AS degree FROM ac a LEFT JOIN s ON a.prompt_id = s.prompt_id AND a.claim_idx = s.claim_idx")
def graph_degree(spark, d):
    cells, sizes = cells_of(spark, d)
    return G.degree(G.edges_of(cells), sizes)


@query("graph_closeness", "G2 G3", f"""WITH RECURSIVE {GRAPH}, ng AS (SELECT prompt_id, claim_idx AS a, (resp_idx + 1000)::INT AS b FROM ed UNION ALL SELECT prompt_id, (resp_idx + 1000)::INT, claim_idx FROM ed),
bf AS (SELECT prompt_id, claim_idx AS s, claim_idx AS v, 0 AS k FROM ac UNION SELECT bf.prompt_id, bf.s, ng.b, bf.k + 1 FROM bf JOIN ng ON ng.prompt_id = bf.prompt_id AND ng.a = bf.v JOIN sz ON sz.prompt_id = bf.prompt_id WHERE bf.k < least(sz.c, sz.r) * 2),
ds AS (SELECT prompt_id, s, v, min(k) AS k FROM bf GROUP BY 1, 2, 3), ag AS (SELECT prompt_id, s, sum(k) AS t, count(*) AS n, sum(CASE WHEN k > 0 THEN 1.0::DOUBLE / k ELSE 0 END) AS h FROM ds GROUP BY 1, 2)
SELECT a.prompt_id, a.s AS claim_idx, round(least(1.0::DOUBLE, coalesce((r + 2 * (c - 1))::DOUBLE / nullif(t, 0) * (n - 1) / nullif(c + r - 1, 0), 0)), 5) AS closeness, round(h / (r + (c - 1) / 2.0::DOUBLE), 5) AS harmonic FROM ag a JOIN sz ON a.prompt_id = sz.prompt_id""")
def graph_closeness(spark, d):
    cells, sizes = cells_of(spark, d)
    return G.closeness(G.distances(G.edges_of(cells), sizes))


@query("graph_laplacian", "G6", f"""WITH {GRAPH}, dc2 AS (SELECT prompt_id, claim_idx, sum(w) AS d FROM ed GROUP BY 1, 2), dr AS (SELECT prompt_id, resp_idx, sum(w) AS d FROM ed GROUP BY 1, 2),
en AS (SELECT prompt_id, sum(x) AS e FROM (SELECT prompt_id, d * d AS x FROM dc2 UNION ALL SELECT prompt_id, d * d FROM dr UNION ALL SELECT prompt_id, 2 * w * w FROM ed) GROUP BY 1),
lo AS (SELECT e.prompt_id, e.claim_idx, any_value(c.d) * any_value(c.d) + sum(2 * r.d * e.w + e.w * e.w) AS x FROM ed e JOIN dr r ON r.prompt_id = e.prompt_id AND r.resp_idx = e.resp_idx JOIN dc2 c ON c.prompt_id = e.prompt_id AND c.claim_idx = e.claim_idx GROUP BY 1, 2)
SELECT a.prompt_id, a.claim_idx, round(coalesce(x, 0) / e, 5) AS laplacian FROM ac a LEFT JOIN lo ON lo.prompt_id = a.prompt_id AND lo.claim_idx = a.claim_idx LEFT JOIN en ON en.prompt_id = a.prompt_id""")
def graph_laplacian(spark, d):
    cells, sizes = cells_of(spark, d)
    return G.laplacian(G.edges_of(cells), sizes)


@query("graph_iterated", "G4 G5")
def graph_iterated(spark, d):
    cells, sizes = cells_of(spark, d)
    return G.iterated(G.edges_of(cells), sizes)


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query("long_text_prompts", "L13 L14 D9", f"""WITH {R2} SELECT prompt_id, {_q(prompts.DECOMPOSITION['mohri_2024'] + chr(10) * 2 + 'Text:' + chr(10))} || text AS decomposition, {_q(prompts.ENTAILMENT['binary'] + chr(10) * 2 + 'Claim: ')} || left(text, 20) || chr(10) || 'Source: ' || text AS entailment,
 'Write a question whose answer is stated by: ' || left(text, 20) AS question FROM r2 WHERE sample_idx = 0""")
def long_text_prompts(spark, d):
    text, claim = F.col("text"), F.substring("text", 1, 20)
    rows = B.long_responses(spark, d).where("sample_idx = 0")
    return rows.select("prompt_id", prompts.decomposition(text, "mohri_2024").alias("decomposition"), prompts.entailment(claim, text).alias("entailment"), L.question_prompt(claim).alias("question"))
