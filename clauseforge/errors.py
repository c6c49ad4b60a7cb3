"""Named failures of training and classification."""


class RuleLearningError(Exception):
    """Base class of everything this package raises on its own."""


class EmptySideError(RuleLearningError, ValueError):
    """The positive or the negative side has no rows."""


class InconsistentDataError(RuleLearningError):
    """A chosen literal removes no negative, as when a vector carries both labels."""


class NoProgressError(RuleLearningError):
    """A finished term covers none of the remaining positives."""


class IncompleteModelError(ValueError):
    """A saved model whose writing did not end."""
