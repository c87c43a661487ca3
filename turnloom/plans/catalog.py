"""Imports every module that registers queries."""

from turnloom.plans import (  # noqa: F401
    annotation, bags, consistency, distributions, networks, prediction, sequences, testing,
)
from turnloom.plans.registry import QUERIES, oracles  # noqa: F401
