"""Boolean rule learning as distributed DataFrame queries.

Learn a disjunction of conjunctions from labelled 0/1 feature vectors, classify
batch and streaming DataFrames with it, and keep it as tables.
"""

from clauseforge.errors import (
    EmptySideError,
    IncompleteModelError,
    InconsistentDataError,
    NoProgressError,
    RuleLearningError,
)
from clauseforge.plans.learner import fit, fit_labelled, learn_term
from clauseforge.plans.model import RuleModel, load_model

__all__ = [
    "EmptySideError",
    "IncompleteModelError",
    "InconsistentDataError",
    "NoProgressError",
    "RuleLearningError",
    "RuleModel",
    "fit",
    "fit_labelled",
    "learn_term",
    "load_model",
]
