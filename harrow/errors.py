"""Typed errors; callers can catch :class:`HarrowError` for all of them."""


class HarrowError(Exception):
    """Base of all errors raised on purpose."""


class ConfigurationError(HarrowError, ValueError):
    """An option is out of range or options contradict each other."""


class SourceError(HarrowError):
    """A corpus or query file is missing or malformed."""


class IndexError_(HarrowError):
    """A table of the index is missing or has another shape."""


class EmbeddingError(HarrowError):
    """A text can't be embedded."""


class RateLimitError(EmbeddingError):
    """A single request exceeds the token budget."""


class ClusteringError(HarrowError, ValueError):
    """Too few vectors, or no usable number of clusters."""


class GenerationError(HarrowError):
    """An answer generator failed."""


class EvaluationError(HarrowError):
    """The evaluation set can't be used."""
