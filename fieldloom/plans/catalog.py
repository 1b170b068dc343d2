"""All registered queries: importing the operator modules fills the registry."""

from fieldloom.operators import config, evaluation, extraction, features, jobs, metrics, mining, relational, runs, sequence, services, statistics, tables, walk, windows  # noqa: F401
from fieldloom.plans.registry import ORACLE, QUERIES
from fieldloom.streaming import learning, worker  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
