"""Region analytics for sequencing data on Spark."""

from __future__ import annotations

__version__ = "0.1.0"
__all__ = ["AlignedSegment", "AlignmentFile", "VariantFile", "VariantRecord", "__version__", "version"]


def version() -> str:
    return __version__


def __getattr__(name: str):
    """The file objects, imported when they are first asked for: tasks need not load them."""
    if name in __all__:
        from . import api

        return getattr(api, name)
    raise AttributeError(name)
