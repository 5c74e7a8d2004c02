"""Contracts: documents, checks, runs, rules, lineage and compatibility."""

from .contract import ContractError, load, run, validate
from .rules import RuleViolation, check_rules

__all__ = ["ContractError", "RuleViolation", "check_rules", "load", "run", "validate"]
