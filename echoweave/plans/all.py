"""Every registered query of the library, without the training-data operators."""

from . import catalogs, clusters, live, results, texts, timelines, vectors  # noqa: F401  importing them registers their queries
from .registry import QUERIES, SQL  # noqa: F401
