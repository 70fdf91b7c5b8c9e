"""Every query of the engine over the given tables, with its ANSI SQL counterpart."""

from cargolume.catalog.registry import ORACLES, QUERIES
from cargolume.catalog import (  # noqa: F401  (importing registers the queries)
    detection,
    merging,
    models,
    operations,
    quality,
    retrieval,
    streams,
    validation,
)

__all__ = ["ORACLES", "QUERIES"]
