"""Scorers as objects: names in, one plan out.

Each takes canonical tables (see ``trustloom.sources.bindings``) and providers,
and returns a Result: a DataFrame with a column for each score asked for, and
what it was made with.  Only the sub-plans of the scores asked for are built.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.operators import calibration as Cal
from trustloom.operators import claim_graph as G
from trustloom.operators import clustering as C
from trustloom.operators import code_scores as Code
from trustloom.operators import consistency as K
from trustloom.operators import ensemble as E
from trustloom.operators import judging as J
from trustloom.operators import longform as L
from trustloom.operators import pairs as P
from trustloom.operators import token_scores as W
from trustloom.sources.datasets import regrouped_samples, singular


@dataclass
class Result:
    data: DataFrame
    metadata: dict = field(default_factory=dict)

    def to_df(self) -> DataFrame:
        return singular(self.data)


def _known(names: list[str], allowed: tuple[str, ...]) -> list[str]:
    bad = [n for n in names if n not in allowed]
    if bad:
        raise ValueError(f"{', '.join(bad)}: not among {', '.join(allowed)}")
    return names


def _joined(base: DataFrame, parts: list[DataFrame]) -> DataFrame:
    for p in parts:
        base = base.join(p, "prompt_id", "left")
    return base


class SamplingScorer:
    """Scores from sampled responses alone."""

    DEFAULT = ("semantic_negentropy", "noncontradiction", "exact_match", "cosine_sim")
    ALL = ("semantic_negentropy", "semantic_sets_confidence", "noncontradiction", "entailment", "exact_match", "cosine_sim", "bert_score")

    def __init__(self, scorers: list[str] | None = None, nli: P.Nli | None = None, use_best: bool = True, return_responses: str = "all"):
        self.scorers = _known(list(scorers or self.DEFAULT), self.ALL)
        if nli is None and set(self.scorers) - {"exact_match", "cosine_sim", "bert_score"}:
            raise ValueError("these scores need an entailment provider")
        if return_responses not in ("all", "raw", "none"):
            raise ValueError("return_responses must be all, raw or none")
        self.nli, self.use_best, self.return_responses = nli, use_best, return_responses

    def score(self, responses: DataFrame, embeddings: DataFrame | None = None, token_vectors: DataFrame | None = None) -> Result:
        s, parts = set(self.scorers), []
        out = responses.select("prompt_id").distinct()
        if s & {"semantic_negentropy", "semantic_sets_confidence"}:
            members = C.memberships(responses, C.equivalences(responses, self.nli))
            if "semantic_negentropy" in s:
                sizes = responses.groupBy("prompt_id").agg(F.count("*").alias("n"))
                value = F.when(F.col("n") > 1, 1.0 - F.col("entropy") / F.ln(F.col("n").cast("double"))).otherwise(1.0)
                parts.append(C.entropy(C.cluster_probabilities(members)).join(sizes, "prompt_id").select("prompt_id", value.alias("semantic_negentropy")))
            if "semantic_sets_confidence" in s:
                parts.append(C.sets_confidence(responses, members))
            if self.use_best:  # what follows compares with the best response
                best = C.best_responses(C.cluster_probabilities(members), C.representatives(members, responses))
                swapped = C.with_best(responses, best)
                if embeddings is not None:
                    moved = swapped.select("prompt_id", F.col("was").alias("sample_idx"), F.col("sample_idx").alias("now"))
                    embeddings = embeddings.join(moved, ["prompt_id", "sample_idx"]).select("prompt_id", F.col("now").alias("sample_idx"), "vec")
                responses = swapped.select("prompt_id", "sample_idx", "text")
        if s & {"noncontradiction", "entailment"}:
            parts.append(K.consistency(responses, self.nli).select("prompt_id", *[c for c in ("noncontradiction", "entailment") if c in s]))
        if "exact_match" in s:
            parts.append(K.exact_match(responses))
        if "cosine_sim" in s:
            if embeddings is None:
                raise ValueError("cosine_sim needs embeddings")
            parts.append(K.cosine_sim(embeddings))
        if "bert_score" in s:
            if token_vectors is None:
                raise ValueError("bert_score needs token vectors")
            parts.append(K.bert_score(token_vectors))
        if self.return_responses == "all":
            parts.insert(0, regrouped_samples(responses))
        elif self.return_responses == "raw":
            parts.insert(0, responses.where("sample_idx = 0").select("prompt_id", F.col("text").alias("response")))
        return Result(_joined(out, parts), {"scorers": self.scorers})


class TokenScorer:
    """Scores from token log-probabilities, of the original response or of samples too."""

    ALL = ("sequence_probability", "min_probability", "mean_token_negentropy", "min_token_negentropy", "probability_margin", "monte_carlo_probability", "consistency_and_confidence", "semantic_negentropy", "semantic_density")

    def __init__(self, scorers: list[str] | None = None, nli: P.Nli | None = None, normalize: bool = True, top_k: int = W.TOP_K):
        if scorers and "normalized_probability" in scorers:
            raise ValueError("normalized_probability is now sequence_probability with normalize=True")
        self.scorers = _known(list(scorers or ("sequence_probability", "min_probability")), self.ALL)
        self.nli, self.normalize, self.top_k = nli, normalize, top_k

    def score(self, tokens: DataFrame, responses: DataFrame | None = None, similarity: DataFrame | None = None) -> Result:
        s = set(self.scorers)
        out, parts = tokens.select("prompt_id").distinct(), []
        pick = lambda df, *names: df.select("prompt_id", *[c for c in names if c in s])
        if s & {"sequence_probability", "min_probability"}:
            parts.append(pick(W.single_scores(tokens, self.normalize), "sequence_probability", "min_probability"))
        if s & {"mean_token_negentropy", "min_token_negentropy", "probability_margin"}:
            parts.append(pick(W.top_scores(tokens, self.top_k), "mean_token_negentropy", "min_token_negentropy", "probability_margin"))
        if "monte_carlo_probability" in s:
            parts.append(W.monte_carlo(tokens))
        if "consistency_and_confidence" in s:
            parts.append(W.consistency_and_confidence(similarity, tokens))
        if "semantic_negentropy" in s:
            found = C.semantic_entropy(responses, self.nli, tokens, self.normalize)
            parts.append(found.select("prompt_id", F.col("tokenprob_confidence_score").alias("semantic_negentropy")))
        if "semantic_density" in s:
            parts.append(DensityScorer(self.nli, self.normalize).score(responses, tokens).data.withColumnRenamed("semantic_density_value", "semantic_density"))
        return Result(_joined(out, parts), {"scorers": self.scorers, "normalize": self.normalize})


class EntropyScorer:
    def __init__(self, nli: P.Nli, normalize: bool = True):
        self.nli, self.normalize = nli, normalize

    def score(self, responses: DataFrame, tokens: DataFrame | None = None) -> Result:
        return Result(C.semantic_entropy(responses, self.nli, tokens, self.normalize), {"normalize": self.normalize})


class DensityScorer:
    def __init__(self, nli: P.Nli, normalize: bool = True):
        self.nli, self.normalize = nli, normalize

    def score(self, responses: DataFrame, tokens: DataFrame) -> Result:
        rows = P.with_nli(P.original_with_samples(responses), "original", "sample", self.nli)
        pairs = rows.select("prompt_id", F.col("sample_idx").alias("resp_idx"), F.col("contra_ab").alias("p_contra"), F.col("neutral_ab").alias("p_neutral"))
        return Result(C.semantic_density(pairs, C.sequence_probabilities(tokens, self.normalize)), {"normalize": self.normalize})


class JudgePanel:
    """Several judges, each with a template of its own or all with one."""

    def __init__(self, judges: list, template: str | dict = "true_false_uncertain", explain: bool = False):
        self.judges, self.explain = judges, explain
        self.templates = template if isinstance(template, dict) else dict.fromkeys(judges, template)
        for t in self.templates.values():
            J.instruction(t)

    def score(self, raw: DataFrame) -> Result:
        parts = None
        for judge in self.judges:
            one = J.scored(raw.where(F.col("judge_id") == judge), self.templates[judge], self.explain)
            parts = one if parts is None else parts.unionByName(one)
        out = J.panel(parts.select("prompt_id", "judge_id", "score"), self.judges)
        if self.explain:
            told = parts.groupBy("prompt_id").pivot("judge_id", self.judges).agg(F.first("explanation"))
            out = out.join(told.toDF("prompt_id", *[f"judge_{k + 1}_explanation" for k in range(len(self.judges))]), "prompt_id")
        return Result(out, {"templates": self.templates})


class ScoreEnsemble:
    """A weighted mean of component scores and a threshold, tuned on graded prompts."""

    def __init__(self, components: list[str], weights: list[float] | None = None, threshold: float = 0.5):
        if len(components) < 1 or len(set(components)) != len(components):
            raise ValueError("components must be different names")
        self.components, self.threshold = components, threshold
        self.weights = E.normalized_weights(weights, len(components))

    @classmethod
    def default(cls) -> ScoreEnsemble:
        return cls(list(E.DEFAULT_WEIGHTS), list(E.DEFAULT_WEIGHTS.values()))

    def _weights(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.components, self.weights)), "scorer string, weight double")

    def score(self, wide: DataFrame) -> Result:
        scores = E.ensemble_scores(E.long_scores(wide, self.components), self._weights(wide.sparkSession))
        return Result(wide.join(scores, "prompt_id"), {"weights": self.weights, "threshold": self.threshold})

    def tune(self, graded: DataFrame, objective: str = "fbeta_score", beta: float = 1.0, weight_steps: int = 100, trials: int = 100, thresh_objective: str = "fbeta_score") -> ScoreEnsemble:
        """graded: component columns and correct.  Two or three components search a full grid, more search step by step.

        An objective with a threshold finds it together with the weights; for any
        other, the threshold is tuned to ``thresh_objective`` afterwards.
        """
        for o in (objective, thresh_objective):
            if o not in E.OBJECTIVES:
                raise ValueError(f"objective must be one of {', '.join(E.OBJECTIVES)}")
        if thresh_objective not in E.WITH_THRESHOLD:
            raise ValueError(f"thresh_objective must be one of {', '.join(E.WITH_THRESHOLD)}")
        if len(self.components) < 2:
            raise ValueError("tuning needs two components")
        spark, k = graded.sparkSession, len(self.components)
        names, thresholds = [f"w{n}" for n in range(k)], E.grid(graded.sparkSession, 0.01, 0.01, 99, "threshold")
        if k > 3:
            self.weights, found, _ = E.searched_weights(graded, self.components, objective, thresholds if objective in E.WITH_THRESHOLD else None, beta, trials)
            self.threshold = self.threshold if found is None else found
        else:
            if k == 2:
                rows = [(x / (weight_steps - 1), 1 - x / (weight_steps - 1)) for x in range(weight_steps)]
            else:
                n = min(weight_steps, 31) - 1
                rows = [(a / n, b / n, (n - a - b) / n) for a in range(n + 1) for b in range(n + 1 - a)]
            weights = spark.createDataFrame(rows, ", ".join(f"{x} double" for x in names))
            if objective in E.WITH_THRESHOLD:
                best = E.tuned_weights_and_threshold(graded, self.components, weights, names, thresholds, objective, beta).first()
                self.threshold = best.threshold
            else:
                measure = {"roc_auc": E.auc, "average_precision": E.average_precision, "log_loss": E.log_loss, "brier_score": E.brier}[objective](E.combined(graded, self.components, weights, names), names)
                order = F.col(objective).desc_nulls_last() if E.OBJECTIVES[objective] else F.col(objective).asc_nulls_last()
                best = measure.orderBy(order, *names).first()
            self.weights = [float(best[x]) for x in names]
        if objective not in E.WITH_THRESHOLD:
            one = spark.createDataFrame([tuple(self.weights)], ", ".join(f"{x} double" for x in names))
            row = E.best_threshold(E.combined(graded, self.components, one, names), thresholds, thresh_objective, beta).first()
            self.threshold = self.threshold if row is None or row.threshold is None else row.threshold
        return self

    def settings(self) -> dict:
        return {"components": self.components, "weights": self.weights, "thresh": self.threshold}

    @classmethod
    def of_settings(cls, held: dict) -> ScoreEnsemble:
        return cls(held["components"], held["weights"], held["thresh"])

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.settings(), f)

    @classmethod
    def load(cls, path: str) -> ScoreEnsemble:
        with open(path, encoding="utf-8") as f:
            return cls.of_settings(json.load(f))

    def report(self, spark: SparkSession) -> DataFrame:
        return E.weight_report(self._weights(spark))


class LongTextScorer:
    """Claims of long answers scored against samples, with an optional removal of doubtful ones."""

    def __init__(self, nli: P.Nli, mode: str = "unit_response", scorers: list[str] | None = None, aggregation: str = "mean", refine_by: str | None = None, threshold: float = L.THRESHOLD):
        self.scorers = L.checked(mode, list(scorers or ["entailment"]))
        self.nli, self.mode, self.aggregation, self.refine_by, self.threshold = nli, mode, aggregation, refine_by, threshold

    def score(self, responses: DataFrame, claims: DataFrame | None = None, embeddings: DataFrame | None = None, token_vectors: DataFrame | None = None) -> Result:
        """embeddings, token_vectors: vectors of claims and of their tokens, for cosine_sim and bert_score of mode matched_unit."""
        claims = L.decomposed(responses) if claims is None else claims
        original = claims.where("sample_idx = 0")
        rows = original.select("prompt_id", "claim_idx", "claim")
        if self.mode == "unit_response":
            rows = rows.join(L.unit_response(original, responses.where("sample_idx > 0"), self.nli), ["prompt_id", "claim_idx"])
        elif set(self.scorers) & set(L.NLI_SCORES):
            rows = rows.join(L.matched_unit(original, claims.where("sample_idx > 0"), self.nli), ["prompt_id", "claim_idx"])
        for name, given, of in (("cosine_sim", embeddings, L.matched_cosine), ("bert_score", token_vectors, L.matched_tokens)):
            if name in self.scorers:
                if given is None:
                    raise ValueError(f"{name} needs {'embeddings' if name == 'cosine_sim' else 'token_vectors'}")
                rows = rows.join(of(given), ["prompt_id", "claim_idx"], "left")
        first = responses.where("sample_idx = 0")
        parts = [L.response_scores(rows, self.scorers, self.aggregation)]
        rows = L.marked(rows, self.refine_by or self.scorers[0], self.threshold)
        if self.refine_by:
            parts += [L.refined(rows, self.scorers, self.aggregation), L.rebuilt(rows, first)]
        parts.append(L.claims_data(rows, self.scorers))
        return Result(_joined(first.select("prompt_id", F.col("text").alias("response")), parts), {"mode": self.mode, "aggregation": self.aggregation, "response_refinement_threshold": self.threshold})


class LongTextQuestions:
    """Claims scored by how consistently questions about them are answered."""

    def __init__(self, scorer: SamplingScorer, column: str, aggregation: str = "mean"):
        self.scorer, self.column, self.aggregation = scorer, column, aggregation

    def score(self, answers: DataFrame) -> Result:
        """answers: (prompt_id, claim_idx, question_idx, sample_idx, text); each question is a prompt of its own."""
        key = F.struct("prompt_id", "claim_idx", "question_idx")
        asked = answers.select(key.alias("prompt_id"), "sample_idx", "text")
        found = self.scorer.score(asked).data.select("prompt_id.prompt_id", "prompt_id.claim_idx", "prompt_id.question_idx", F.col(self.column).alias("score"))
        claims, response = L.question_scores(found, self.aggregation)
        data = claims.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("claim_idx", "score"))).alias("claims_data"))
        return Result(response.join(data, "prompt_id"), {"aggregation": self.aggregation})


class LongTextGraph:
    """Claims of all responses, merged, scored by their place in the graph of claims and responses."""

    METRICS = ("degree", "closeness", "harmonic", "laplacian", "betweenness", "pagerank")

    def __init__(self, nli: P.Nli, aggregation: str = "mean", threshold: float = G.THRESHOLD):
        self.nli, self.aggregation, self.threshold = nli, aggregation, threshold

    def score(self, responses: DataFrame, claims: DataFrame | None = None) -> Result:
        claims = L.decomposed(responses) if claims is None else claims
        master = P.flag_original(L.merged_claims(claims), claims.where("sample_idx = 0"))
        pairs = P.claims_with_responses(master, responses).select("prompt_id", "claim_idx", "resp_idx", F.col("response").alias("premise"), F.col("claim").alias("hypothesis"))
        known = self.nli(pairs.select("premise", "hypothesis").distinct())
        cells = pairs.join(known, ["premise", "hypothesis"]).select("prompt_id", "claim_idx", "resp_idx", F.col("p_entail").alias("w"))
        sizes = master.groupBy("prompt_id").agg(F.count("*").cast("int").alias("n_claims")).join(responses.groupBy("prompt_id").agg(F.count("*").cast("int").alias("n_responses")), "prompt_id")
        rows = master.join(G.all_metrics(cells, sizes, self.threshold), ["prompt_id", "claim_idx"])
        scores = L.response_scores(rows.where("original_response"), list(self.METRICS), self.aggregation)
        data = rows.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("claim_idx", "claim", "original_response", *self.METRICS))).alias("claims_data"))
        return Result(scores.join(data, "prompt_id"), {"aggregation": self.aggregation})


class CodeScorer:
    """Scores of generated programs."""

    def __init__(self, scorers: list[str], equivalence_provider=None, language: str = "python"):
        self.routes, self.scorers, self.provider, self.language = Code.routed(scorers), scorers, equivalence_provider, language

    def score(self, responses: DataFrame, tokens: DataFrame | None = None, embeddings: DataFrame | None = None, confidence: DataFrame | None = None) -> Result:
        """confidence: (prompt_id, verbalized_confidence), of a judge."""
        parts = []
        if self.routes["functional"]:
            found = C.functional_scores(responses, Code.equivalence_scores(responses, self.provider))
            parts.append(found.select("prompt_id", *self.routes["functional"]))
        if self.routes["local"]:
            parts.append((Code.codebleu_of_python if self.language == "python" else Code.codebleu)(P.original_with_samples(responses)))
        other = self.routes["other"]
        similarity = K.cosine_sim(embeddings) if embeddings is not None and "cosine_sim" in other else None
        if similarity is not None:
            parts.append(similarity)
        if "consistency_and_confidence" in other:
            parts.append(W.consistency_and_confidence(similarity, tokens))
        if "verbalized_confidence" in other:
            parts.append(confidence)
        white = [s for s in self.routes["white_box"] if s != "p_true"]
        if white:
            parts.append(TokenScorer(white).score(tokens).data)
        return Result(_joined(responses.select("prompt_id").distinct(), parts), {"scorers": self.scorers})


Calibrator = Cal.Calibrator
