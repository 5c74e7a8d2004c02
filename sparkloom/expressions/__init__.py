"""The contract expression language: text or JSON nodes to Spark columns."""

from .build import Scope, Value, column_of, value_of
from .parse import ExpressionError, parse

__all__ = ["ExpressionError", "Scope", "Value", "column_of", "parse", "value_of"]
