"""Errors, one for each part of the engine; each carries the one that caused it."""


class EngineError(Exception):
    """Anything that goes wrong in the engine."""


class LoadingError(EngineError):
    """Listing, reading or preparing data."""


class AnalysisError(EngineError):
    """Correlation, leakage, stability or selection."""


class ClassifierError(EngineError):
    """Building, tuning or fitting a classifier."""


class EvaluationError(EngineError):
    """Metrics and cross-validation."""


class PipelineError(EngineError):
    """A run as a whole."""
