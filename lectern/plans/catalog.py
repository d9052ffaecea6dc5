"""Queries over the given tables, and their SQL."""

from . import evaluation, protocol, reports, splitting, texts, vectoring  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
