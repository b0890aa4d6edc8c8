"""All registered queries (importing the modules fills the registry)."""

from . import backtests, delivery, inputs, training  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
