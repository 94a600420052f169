"""Errors of the library."""


class FeatureLengthVaryError(ValueError):
    """Series that must be of one length are not."""


class NoTimeSeriesFeatureError(ValueError):
    """A column that must be a time series is none."""


class NoCategoriesError(ValueError):
    """No categories are given or fitted."""


class NoMatchingCategoryError(ValueError):
    """A row has a value outside the known categories."""


class FeatureNotFoundError(KeyError):
    """A named column does not exist."""


class InvalidUriSchemeError(ValueError):
    """Only file URIs can be read."""


class UnsupportedFileTypeError(ValueError):
    """No reader for this kind of file."""


class NotFittedError(RuntimeError):
    """A transform is used before it is fitted."""


class Finished(Exception):
    """An environment has no further data."""


class StopLearning(Exception):
    """A learner wants no further data."""


class TestFailed(AssertionError):
    """A model contradicts a predicate; counterexamples has the rows."""

    __test__ = False

    def __init__(self, message: str, counterexamples: list) -> None:
        super().__init__(message)
        self.counterexamples = counterexamples
