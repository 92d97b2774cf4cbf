"""Whole queries: the marts, ranked tables and comparisons."""

from wicketworks.plans.build import build_marts, open_lattices, open_marts
from wicketworks.plans.comparison import compare_players, compare_seasons
from wicketworks.plans.leaderboard import leaderboard, selection, top_players
from wicketworks.plans.marts import batting_mart, bowling_mart

__all__ = [
    "batting_mart",
    "bowling_mart",
    "build_marts",
    "compare_players",
    "compare_seasons",
    "leaderboard",
    "open_lattices",
    "open_marts",
    "selection",
    "top_players",
]
