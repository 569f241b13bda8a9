"""Imports every module that registers queries."""

from catalog import analyses, clusters, community, distances, relational  # noqa: F401
from catalog.base import ORACLES, QUERIES  # noqa: F401
