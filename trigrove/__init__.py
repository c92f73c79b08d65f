"""Typo-tolerant search and learned ranking over catalogs of named items, on Spark."""

from trigrove.model import UNIX, WINDOWS, Profile
from trigrove.operators.index import LookupTables
from trigrove.plans.search import search

__all__ = ["LookupTables", "Profile", "UNIX", "WINDOWS", "search"]
