"""The function catalog: names of the contract language to Spark column builders."""

from . import collections, conversion, core, dates, statistics, strings  # noqa: F401  (they register themselves)
from .registry import NAMES, call, names

__all__ = ["NAMES", "call", "names"]
