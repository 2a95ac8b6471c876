"""Queries over the sample tables, one or more for each operator."""

from manyfold.queries import claims, pictures, ranges, stores, studies  # noqa: F401
from manyfold.queries.registry import ORACLES, QUERIES  # noqa: F401
