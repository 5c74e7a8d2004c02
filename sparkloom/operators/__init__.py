"""Dataset actions: each takes (frames, target, parameters, context) and returns the frames it changes."""

from . import aggregate, fields, joins, relational, reshape, sampling, windows  # noqa: F401  (they register themselves)
from .registry import ACTIONS, ActionError, Context, apply, apply_all

__all__ = ["ACTIONS", "ActionError", "Context", "apply", "apply_all"]
