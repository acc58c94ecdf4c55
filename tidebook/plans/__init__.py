"""Registered queries over the market tables."""

from . import crossroots, desk, fills, inference, logs, models, quoters, stateful, tape, tapes, walkforward
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "crossroots", "desk", "fills", "inference", "logs", "models", "quoters", "stateful", "tape", "tapes", "walkforward"]
