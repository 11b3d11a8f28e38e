"""Spark-native analytics for measuring how far generated text can be trusted."""

from trustloom.plans.api import (
    Calibrator,
    CodeScorer,
    DensityScorer,
    EntropyScorer,
    JudgePanel,
    LongTextGraph,
    LongTextQuestions,
    LongTextScorer,
    Result,
    SamplingScorer,
    ScoreEnsemble,
    TokenScorer,
)

__all__ = ["Calibrator", "CodeScorer", "DensityScorer", "EntropyScorer", "JudgePanel", "LongTextGraph", "LongTextQuestions", "LongTextScorer", "Result", "SamplingScorer", "ScoreEnsemble", "TokenScorer"]
