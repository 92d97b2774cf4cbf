"""Small hand-written ball tables."""

from __future__ import annotations

from wicketworks.schema import DELIVERIES, MATCHES

PLAIN = {
    "match_id": 1,
    "inning": 1,
    "over": 1,
    "batsman": "Striker",
    "non_striker": "Partner",
    "bowler": "Bowler",
    "batsman_runs": 0,
    "extra_runs": 0,
    "total_runs": None,
    "dismissal_kind": "",
    "player_dismissed": "",
}


def ball(n: int = 1, **changes) -> list[dict]:
    """``n`` equal balls. Total runs follow from the other two unless given."""
    row = {**PLAIN, **changes}
    if "total_runs" not in changes and row["batsman_runs"] is not None:
        row["total_runs"] = row["batsman_runs"] + row["extra_runs"]
    return [row] * n


def out(kind: str = "bowled", player: str = "Striker", **changes) -> list[dict]:
    return ball(dismissal_kind=kind, player_dismissed=player, **changes)


def deliveries(spark, *groups):
    rows = [tuple(row[name] for name in DELIVERIES.names) for group in groups for row in group]
    return spark.createDataFrame(rows, DELIVERIES)


def matches(spark, seasons=None):
    return spark.createDataFrame(list((seasons or {1: 2008, 2: 2008, 3: 2008}).items()), MATCHES)


def dicts(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]


def one(df) -> dict:
    rows = dicts(df)
    assert len(rows) == 1, rows
    return rows[0]

PLAYERS = ("batsman", "non_striker", "bowler", "player_dismissed")


def in_one_table(cases: dict[str, list[dict]]) -> list[dict]:
    """All cases in one list, the players of each renamed to ``case:player``."""
    return [
        {**row, **{role: f"{case}:{row[role]}" for role in PLAYERS if row[role]}}
        for case, rows in cases.items()
        for row in rows
    ]


def by_player(df, player: str) -> dict[tuple[str, str], dict]:
    """Rows by player and stage."""
    rows = dicts(df)
    found = {(r[player], r["stage"]): r for r in rows}
    assert len(found) == len(rows)
    return found
