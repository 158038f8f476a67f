"""Errors that a user can cause; the command line turns them into exit code 2."""


class AnalysisError(Exception):
    """Base of all errors of this library."""


class RepositoryNotFound(AnalysisError):
    """The root to analyse is no directory."""


class ConfigurationError(AnalysisError):
    """A setting, a baseline or a suppression is not valid."""


class MissingBackend(AnalysisError):
    """An optional model backend is not installed."""


class IndexUnavailable(AnalysisError):
    """There is no vector index for this model."""
