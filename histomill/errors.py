"""Typed errors. Messages say what was asked for and what there is."""

from __future__ import annotations

import difflib
from collections.abc import Iterable


class AnalysisError(Exception):
    """Base of all errors of this package."""


class MissingRegionError(AnalysisError):
    """A region column (tissue, background) is absent."""


class MissingSpatialError(AnalysisError):
    """Coordinates are absent."""


class NotPreprocessedError(AnalysisError):
    """A step needs normalised values."""


class NoClustersError(AnalysisError):
    """A cluster column is absent."""


class NoEmbeddingError(AnalysisError):
    """An embedding column is absent."""


class InsufficientSamplesError(AnalysisError):
    """Too few samples for the test."""


class InvalidParameterError(AnalysisError, ValueError):
    """A parameter has a value that makes no sense."""


class FileFormatError(AnalysisError, ValueError):
    """A file cannot be read as the table it should be."""


class NetworkError(AnalysisError):
    """A remote service did not answer."""


class PseudoreplicationWarning(UserWarning):
    """Pixels were tested as if they were independent samples."""


def listing(names: Iterable, limit: int = 8) -> str:
    """The first names, and how many more there are."""
    names = [str(n) for n in names]
    more = f" and {len(names) - limit} more" if len(names) > limit else ""
    return (", ".join(names[:limit]) or "none") + more


def suggest(name: str, names: Iterable) -> str:
    """A hint at the closest name, or nothing."""
    close = difflib.get_close_matches(str(name), [str(n) for n in names], 1)
    return f" Did you mean '{close[0]}'?" if close else ""


def require_column(columns: Iterable[str], name: str, error: type[AnalysisError] = InvalidParameterError) -> None:
    columns = list(columns)
    if name not in columns:
        raise error(f"There is no column '{name}'.{suggest(name, columns)} Columns: {listing(columns)}.")
