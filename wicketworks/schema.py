"""Tables, fixed values and the description of the two marts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

DELIVERIES = T.StructType(
    [
        T.StructField("match_id", T.LongType()),
        T.StructField("inning", T.IntegerType()),
        T.StructField("over", T.IntegerType()),
        T.StructField("batsman", T.StringType()),
        T.StructField("non_striker", T.StringType()),
        T.StructField("bowler", T.StringType()),
        T.StructField("batsman_runs", T.IntegerType()),
        T.StructField("extra_runs", T.IntegerType()),
        T.StructField("total_runs", T.IntegerType()),
        T.StructField("dismissal_kind", T.StringType()),
        T.StructField("player_dismissed", T.StringType()),
    ]
)

# `id` is the key of the table: unique and never null.
MATCHES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("season", T.IntegerType()),
    ]
)

BOWLING_MART = T.StructType(
    [
        T.StructField("bowler", T.StringType()),
        T.StructField("inning", T.IntegerType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("balls", T.LongType()),
        T.StructField("overs", T.DoubleType()),
        T.StructField("dotballs", T.LongType()),
        T.StructField("maiden", T.LongType()),
        T.StructField("bat_runs", T.LongType()),
        T.StructField("extra_runs", T.LongType()),
        T.StructField("wickets", T.LongType()),
        T.StructField("matches", T.LongType()),
        T.StructField("fivewicket", T.LongType()),
        T.StructField("fourwicket", T.LongType()),
        T.StructField("bow_avg", T.DoubleType()),
        T.StructField("economy", T.DoubleType()),
        T.StructField("per_dotball", T.DoubleType()),
        T.StructField("stage", T.StringType()),
    ]
)

BATTING_MART = T.StructType(
    [
        T.StructField("batsman", T.StringType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("inning", T.IntegerType()),
        T.StructField("dismissed", T.LongType()),
        T.StructField("innings_played", T.LongType()),
        T.StructField("not_out", T.LongType()),
        T.StructField("runs_made", T.LongType()),
        T.StructField("balls_faced", T.LongType()),
        T.StructField("maximum_score", T.LongType()),
        T.StructField("centuries", T.LongType()),
        T.StructField("half_centuries", T.LongType()),
        T.StructField("boundries", T.LongType()),
        T.StructField("sixes", T.LongType()),
        T.StructField("batting_avg", T.DoubleType()),
        T.StructField("strike_rate", T.DoubleType()),
        T.StructField("stage", T.StringType()),
    ]
)

# Fixed values ---------------------------------------------------------------

MAX_EXCLUDED_OVERS = 25
MAX_EXCLUDED_BALLS_FACED = 90
BALLS_PER_OVER = 6
PAGE_SIZE = 10
TOP_SIZE = 6

# Dismissals credited to the bowler.
CREDITED_DISMISSALS = (
    "caught",
    "bowled",
    "lbw",
    "caught and bowled",
    "stumped",
    "hit wicket",
)

# The same list, as positions among the kinds in order of first appearance.
CREDITED_POSITIONS = (2, 3, 5, 6, 7, 9)

# Phases of an innings: name -> (first over, last over); no last over for Death.
STAGES = {
    "Powerplay": (1, 6),
    "Middle": (7, 15),
    "Death": (16, None),
}

# What a request may ask for.
STAGE_CHOICES = {
    "Complete (1-20)": None,
    "Powerplay (1-6)": "Powerplay",
    "Middle (7-15)": "Middle",
    "Death (16-20)": "Death",
}
INNING_CHOICES = {
    "1": 1,
    "2": 2,
    "1 & 2": None,
}

DEFAULT_SEASON = 2008
DEFAULT_STAGE = "Complete (1-20)"
DEFAULT_INNING = "1 & 2"
DEFAULT_BOWLERS = ("Harbhajan Singh", "A Mishra")
DEFAULT_PARAMETERS = ("overs", "wickets")

# Columns shown for each metric.
BOWLING_PRESETS = {
    "overs": ("overs", "maiden", "bat_runs", "extra_runs", "wickets", "matches", "bow_avg", "economy"),
    "maiden": ("overs", "maiden", "per_dotball", "bat_runs", "extra_runs", "matches", "bow_avg", "economy"),
    "bat_runs": ("overs", "maiden", "per_dotball", "bat_runs", "extra_runs", "matches", "bow_avg", "economy"),
    "extra_runs": ("overs", "maiden", "bat_runs", "extra_runs", "wickets", "matches", "bow_avg", "economy"),
    "wickets": ("overs", "maiden", "per_dotball", "wickets", "fivewicket", "fourwicket", "matches", "bow_avg"),
    "fivewicket": ("overs", "maiden", "per_dotball", "wickets", "fivewicket", "fourwicket", "matches", "bow_avg"),
    "fourwicket": ("overs", "maiden", "wickets", "fivewicket", "fourwicket", "matches", "bow_avg", "economy"),
    "bow_avg": ("overs", "maiden", "bat_runs", "extra_runs", "wickets", "matches", "bow_avg", "economy"),
    "economy": ("overs", "maiden", "bat_runs", "extra_runs", "wickets", "matches", "bow_avg", "economy"),
    "per_dotball": ("overs", "maiden", "per_dotball", "wickets", "fivewicket", "matches", "bow_avg", "economy"),
}

BATTING_COLUMNS = (
    "runs_made",
    "balls_faced",
    "maximum_score",
    "centuries",
    "half_centuries",
    "batting_avg",
    "strike_rate",
    "boundries",
    "sixes",
)
BATTING_METRICS = (
    "runs_made",
    "balls_faced",
    "maximum_score",
    "centuries",
    "half_centuries",
    "boundries",
    "sixes",
    "batting_avg",
    "strike_rate",
)


@dataclass(frozen=True)
class Ratio:
    """``top / bottom * times``, a metric that is recomputed after every roll-up."""

    name: str
    top: str
    bottom: str
    times: int = 1


@dataclass(frozen=True)
class Discipline:
    """What the request functions must know about a mart."""

    player: str
    measures: tuple[str, ...]
    ratios: tuple[Ratio, ...]
    presets: dict[str, tuple[str, ...]]
    default_metric: str
    fallback_metric: str
    maxima: tuple[str, ...] = ()
    tenths: tuple[str, ...] = ()
    inning_only: tuple[str, ...] = ()

    @property
    def metrics(self) -> tuple[str, ...]:
        return tuple(self.presets)

    def metric(self, name: str) -> str:
        """The metric a request means; an unknown name means the fallback."""
        return name if name in self.presets else self.fallback_metric


BOWLING = Discipline(
    player="bowler",
    measures=(
        "balls",
        "overs",
        "dotballs",
        "maiden",
        "bat_runs",
        "extra_runs",
        "wickets",
        "matches",
        "fivewicket",
        "fourwicket",
    ),
    ratios=(
        Ratio("bow_avg", "bat_runs", "wickets"),
        Ratio("economy", "bat_runs", "overs"),
        Ratio("per_dotball", "dotballs", "balls", 100),
    ),
    presets=BOWLING_PRESETS,
    default_metric="wickets",
    fallback_metric="fivewicket",
    tenths=("overs",),
)

BATTING = Discipline(
    player="batsman",
    measures=(
        "dismissed",
        "innings_played",
        "not_out",
        "runs_made",
        "balls_faced",
        "maximum_score",
        "centuries",
        "half_centuries",
        "boundries",
        "sixes",
    ),
    ratios=(
        Ratio("batting_avg", "runs_made", "dismissed"),
        Ratio("strike_rate", "runs_made", "balls_faced", 100),
    ),
    presets={metric: BATTING_COLUMNS for metric in BATTING_METRICS},
    default_metric="batting_avg",
    fallback_metric="strike_rate",
    maxima=("maximum_score",),
    # Left out when the stages are rolled up as well.
    inning_only=("innings_played",),
)
