"""DuckDB SQL for the registered queries.

The statistics are written as one table per measure, joined in the end, and the joins of balls,
matches and exclusion lists come first. The library adds up first and joins later, so the two agree
only if both are right.
"""

from __future__ import annotations

from wicketworks.checks.views import sql_missing_views, sql_views

_CREDITED = "('caught', 'bowled', 'lbw', 'caught and bowled', 'stumped', 'hit wicket')"
_STAGE = (
    "case when over < 7 then 'Powerplay' when over > 6 and over < 16 then 'Middle' "
    "when over > 15 then 'Death' end as stage"
)

_FACTS = f"""with {sql_views()},
combined as (
  select d.match_id, inning, over, batsman, non_striker, bowler, batsman_runs, extra_runs, total_runs,
    dismissal_kind, player_dismissed, season
  from deliveries d join matches m on d.match_id = m.id)"""

_BOWLER_EXCLUSIONS = """bowler_volume as (
  select bowler, season, count(*) as balls, concat(bowler, season) as combine, count(*) / 6.0::double as overs
  from combined group by bowler, season),
bowler_exclusions as (select * from bowler_volume where overs <= 25)"""

_BATSMAN_EXCLUSIONS = """batsman_volume as (
  select batsman, season, count(*) as ballsfaced,
    case when count(batsman_runs) = count(*) then sum(batsman_runs)::bigint end as runs
  from combined group by batsman, season),
batsman_exclusions as (
  select *, concat(batsman, season) as combine_batsman from batsman_volume where ballsfaced <= 90)"""

_BOWLING_FACTS = f"""{_FACTS}, {_BOWLER_EXCLUSIONS},
qualified as (
  select * from combined c
  where not exists (select 1 from bowler_exclusions x where x.combine = concat(c.bowler, c.season)))"""

_BATTING_FACTS = f"""{_FACTS}, {_BATSMAN_EXCLUSIONS},
qualified as (
  select * from combined c
  where not exists (
    select 1 from batsman_exclusions x where x.combine_batsman = concat(c.batsman, c.season)))"""

_STAGED = f"facts as (select *, {_STAGE} from qualified)"
_UNSTAGED = "facts as (select * from qualified)"


def _tenth(value: str) -> str:
    """The tenth nearest to a stored number of 0 or more, ties to even, in whole numbers of 2 ** -62."""
    unit = "4611686018427387904::hugeint"
    scaled = f"try_cast(({value})::double * 4611686018427387904 as hugeint) * 10"
    whole, twice = f"({scaled}) // {unit}", f"(({scaled}) % {unit}) * 2"
    up = f"case when {twice} > {unit} or {twice} = {unit} and ({whole}) % 2 = 1 then 1 else 0 end"
    return f"case when isfinite(({value})::double) then (({whole}) + {up})::double / 10 else ({value})::double end"


def _bowling_tables(facts: str, k: str) -> str:
    return f"""{_BOWLING_FACTS}, {facts},
balls as (select {k}, count(*) as balls, count(*) / 6.0::double as overs from facts group by {k}),
dots as (select {k}, count(*) as dotballs from facts where total_runs = 0 group by {k}),
maidens as (
  select {k}, count(*) as maiden
  from (
    select {k}, match_id, over, sum(total_runs) as runsgiven, count(*) as n
    from facts group by {k}, match_id, over)
  where runsgiven = 0 and n > 5 group by {k}),
runs as (
  select {k}, sum(batsman_runs)::bigint as bat_runs, sum(extra_runs)::bigint as extra_runs
  from facts group by {k}),
wickets as (
  select {k}, count(*) as wickets from facts where dismissal_kind in {_CREDITED} group by {k}),
played as (select {k}, count(distinct match_id) as matches from facts group by {k}),
per_match as (
  select {k}, match_id, count(*) as n from facts where dismissal_kind in {_CREDITED}
  group by {k}, match_id),
fives as (select {k}, count(*) as fivewicket from per_match where n > 4 group by {k}),
fours as (select {k}, count(*) as fourwicket from per_match where n > 3 group by {k}),
merged as (
  select * from balls full join dots using ({k}) full join maidens using ({k}) full join runs using ({k})
  full join wickets using ({k}) full join played using ({k}) full join fives using ({k})
  full join fours using ({k})),
mart as (
  select {k}, balls, {_tenth("overs")} as overs, coalesce(dotballs, 0) as dotballs,
    coalesce(maiden, 0) as maiden, bat_runs, extra_runs, coalesce(wickets, 0) as wickets, matches,
    coalesce(fivewicket, 0) as fivewicket, coalesce(fourwicket, 0) as fourwicket,
    {_tenth("coalesce(bat_runs::double / wickets, 0)")} as bow_avg,
    {_tenth("coalesce(bat_runs::double / overs, 0)")} as economy,
    {_tenth("coalesce((dotballs::double / balls) * 100, 0)")} as per_dotball
  from merged)"""


def _batting_tables(facts: str, k: str) -> str:
    others = k.replace("batsman, ", "")
    excluded = (
        "not exists (select 1 from batsman_exclusions x where x.combine_batsman = concat(p.batsman, p.season))"
    )
    return f"""{_BATTING_FACTS}, {facts},
at_strike as (select {k}, match_id, count(*) as innings from facts group by {k}, match_id),
off_strike as (
  select non_striker as batsman, {others}, match_id, count(*) as innings
  from facts group by non_striker, {others}, match_id),
played as (
  select * from (
    select {k}, count(distinct match_id) as innings_played
    from (select * from at_strike union all by name select * from off_strike) group by {k}) p
  where {excluded}),
dismissals as (
  select * from (
    select player_dismissed as batsman, {others}, count(*) as dismissed
    from facts where player_dismissed <> '' group by player_dismissed, {others}) p
  where {excluded}),
not_outs as (
  select {k}, dismissed, innings_played, innings_played - dismissed as not_out
  from dismissals right join played using ({k})),
runs as (select {k}, sum(batsman_runs)::bigint as runs_made from facts group by {k}),
faced as (select {k}, count(*) as balls_faced from facts group by {k}),
scores as (select {k}, match_id, sum(batsman_runs)::bigint as score from facts group by {k}, match_id),
highest as (select {k}, max(score) as maximum_score from scores group by {k}),
hundreds as (select {k}, count(*) as centuries from scores where score > 99 group by {k}),
fifties as (
  select {k}, count(*) as half_centuries from scores where score > 49 and score < 100 group by {k}),
fours as (select {k}, count(*) as boundries from facts where batsman_runs = 4 group by {k}),
sixers as (select {k}, count(*) as sixes from facts where batsman_runs = 6 group by {k}),
merged as (
  select * from not_outs full join runs using ({k}) full join faced using ({k}) full join highest using ({k})
  full join hundreds using ({k}) full join fifties using ({k}) full join fours using ({k})
  full join sixers using ({k})),
filled as (
  select {k}, coalesce(dismissed, 0) as dismissed, coalesce(innings_played, 0) as innings_played,
    coalesce(not_out, 0) as not_out, coalesce(runs_made, 0) as runs_made,
    coalesce(balls_faced, 0) as balls_faced, coalesce(maximum_score, 0) as maximum_score,
    coalesce(centuries, 0) as centuries, coalesce(half_centuries, 0) as half_centuries,
    coalesce(boundries, 0) as boundries, coalesce(sixes, 0) as sixes
  from merged),
mart as (
  select *,
    case when dismissed = 0 then 0 else {_tenth("runs_made::double / dismissed")} end as batting_avg,
    case when balls_faced = 0 then 0
      else {_tenth("(runs_made::double / balls_faced) * 100")} end as strike_rate
  from filled)"""


# With values missing. A key that is missing is a key like others, a sum with a missing value is missing, and 0 in a mart, where missing
# innings and seasons are 0 too. Joins would lose the missing keys, so the measures are stacked and grouped.

_MISSING_FACTS = f"""with {sql_views()},
{sql_missing_views()},
combined as (select d.*, m.season from missing_deliveries d join missing_matches m on d.match_id = m.id),
staged as (select *, {_STAGE} from combined)"""


def _strict(column: str) -> str:
    return f"case when count({column}) = count(*) then sum({column})::bigint end"


def _short(player: str, rule: str) -> str:
    return f"""short as (select {player} as player, season from combined group by all having {rule}),
kept as (
  select s.* from staged s
  where not exists (select 1 from short x where x.player is not distinct from s.{player}
    and x.season is not distinct from s.season) and stage is not null)"""


_BOWLING_MISSING = f"""{_MISSING_FACTS},
{_short("bowler", "count(*) / 6.0 <= 25")},
overs as (
  select bowler, inning, season, stage, match_id, over, count(*) as n, {_strict("total_runs")} as given
  from kept group by all),
hauls as (
  select bowler, inning, season, stage, match_id, count(*) as n from kept where dismissal_kind in {_CREDITED} group by all),
stacked as (
  select bowler, inning, season, stage, count(*) as balls, count(*) filter (total_runs = 0) as dotballs,
    {_strict("batsman_runs")} as bat_runs, {_strict("extra_runs")} as extra_runs, count(distinct match_id) as matches
  from kept group by all
  union all by name
  select bowler, inning, season, stage, count(*) as maiden from overs where given = 0 and n > 5 group by all
  union all by name
  select bowler, inning, season, stage, sum(n)::bigint as wickets, count(*) filter (n > 4) as fivewicket,
    count(*) filter (n > 3) as fourwicket
  from hauls group by all),
filled as (
  select bowler, coalesce(inning, 0)::int as inning, coalesce(season, 0)::int as season, stage, max(balls) as balls,
    coalesce(max(dotballs), 0) as dotballs, coalesce(max(maiden), 0) as maiden, coalesce(max(bat_runs), 0) as bat_runs,
    coalesce(max(extra_runs), 0) as extra_runs, coalesce(max(wickets), 0) as wickets, max(matches) as matches,
    coalesce(max(fivewicket), 0) as fivewicket, coalesce(max(fourwicket), 0) as fourwicket
  from stacked s group by bowler, s.inning, s.season, stage)
select *, {_tenth("balls / 6.0::double")} as overs,
  case when wickets = 0 then 0 else {_tenth("bat_runs::double / wickets")} end as bow_avg,
  {_tenth("bat_runs::double / (balls / 6.0::double)")} as economy, {_tenth("(dotballs::double / balls) * 100")} as per_dotball
from filled"""

_BATTING_MISSING = f"""{_MISSING_FACTS},
{_short("batsman", "count(*) <= 90")},
crease as (
  select batsman, inning, season, stage, match_id from kept
  union select non_striker, inning, season, stage, match_id from kept),
scores as (
  select batsman, inning, season, stage, match_id, {_strict("batsman_runs")} as score from kept group by all),
stacked as (
  select batsman, inning, season, stage, count(*) as innings_played from crease group by all
  union all by name
  select player_dismissed as batsman, inning, season, stage, count(*) as dismissed from kept where player_dismissed <> '' group by all
  union all by name
  select batsman, inning, season, stage, {_strict("batsman_runs")} as runs_made, count(*) as balls_faced,
    count(*) filter (batsman_runs = 4) as boundries, count(*) filter (batsman_runs = 6) as sixes
  from kept group by all
  union all by name
  select batsman, inning, season, stage, case when count(score) = count(*) then max(score) end as maximum_score,
    count(*) filter (score > 99) as centuries, count(*) filter (score between 50 and 99) as half_centuries
  from scores group by all),
merged as (
  select batsman, inning, season, stage, max(innings_played) as innings_played, max(dismissed) as out, max(runs_made) as runs,
    max(balls_faced) as faced, max(maximum_score) as best, max(centuries) as hundreds, max(half_centuries) as fifties,
    max(boundries) as fours, max(sixes) as sixers
  from stacked group by all having max(innings_played) is not null),
filled as (
  select batsman, coalesce(inning, 0)::int as inning, coalesce(season, 0)::int as season, stage, coalesce(out, 0) as dismissed,
    innings_played, coalesce(innings_played - out, 0) as not_out, coalesce(runs, 0) as runs_made, coalesce(faced, 0) as balls_faced,
    coalesce(best, 0) as maximum_score, coalesce(hundreds, 0) as centuries, coalesce(fifties, 0) as half_centuries,
    coalesce(fours, 0) as boundries, coalesce(sixers, 0) as sixes
  from merged m
  where not exists (select 1 from short x where x.player is not distinct from m.batsman and x.season is not distinct from m.season))
select *, case when dismissed = 0 then 0 else {_tenth("runs_made::double / dismissed")} end as batting_avg,
  case when balls_faced = 0 then 0 else {_tenth("(runs_made::double / balls_faced) * 100")} end as strike_rate
from filled"""


_BOWLING_KEYS = "bowler, inning, season"
_BATTING_KEYS = "batsman, inning, season"
_BOWLING = _bowling_tables(_STAGED, _BOWLING_KEYS + ", stage")
_BATTING = _batting_tables(_STAGED, _BATTING_KEYS + ", stage")

_BOWLING_SUMS = """sum(balls)::bigint as balls, sum(overs::decimal(18, 1))::double as overs,
    sum(dotballs)::bigint as dotballs, sum(maiden)::bigint as maiden, sum(bat_runs)::bigint as bat_runs,
    sum(extra_runs)::bigint as extra_runs, sum(wickets)::bigint as wickets,
    sum(matches)::bigint as matches, sum(fivewicket)::bigint as fivewicket,
    sum(fourwicket)::bigint as fourwicket"""
_BATTING_SUMS = """sum(dismissed)::bigint as dismissed, {innings}sum(not_out)::bigint as not_out,
    sum(runs_made)::bigint as runs_made, sum(balls_faced)::bigint as balls_faced,
    max(maximum_score)::bigint as maximum_score, sum(centuries)::bigint as centuries,
    sum(half_centuries)::bigint as half_centuries, sum(boundries)::bigint as boundries,
    sum(sixes)::bigint as sixes"""
_INNINGS_SUM = "sum(innings_played)::bigint as innings_played, "


def _bowling_rollup(source: str, keys: str, rounded: bool = True) -> str:
    def shown(ratio: str) -> str:
        return _tenth(ratio) if rounded else ratio

    return f"""select *, {shown('bat_runs::double / wickets::double')} as bow_avg,
    {shown('bat_runs::double / overs')} as economy,
    {shown('(dotballs::double / balls::double) * 100')} as per_dotball
  from (select {keys}, {_BOWLING_SUMS} from {source} group by {keys})"""


def _batting_rollup(source: str, keys: str, innings: bool) -> str:
    sums = _BATTING_SUMS.format(innings=_INNINGS_SUM if innings else "")
    return f"""select *, {_tenth("runs_made::double / dismissed::double")} as batting_avg,
    {_tenth("(runs_made::double / balls_faced::double) * 100")} as strike_rate
  from (select {keys}, {sums} from {source} group by {keys})"""


def _inning_step(name: str, season: int, inning: int | None) -> str:
    """CTE text from ``mart`` to ``by_inning``."""
    base = _BOWLING if name == "bowling" else _BATTING
    if inning:
        step = f"select * from mart where season = {season} and inning = {inning}"
    elif name == "bowling":
        step = _bowling_rollup(f"mart where season = {season}", "bowler, stage")
    else:
        step = _batting_rollup(f"mart where season = {season}", "batsman, stage", True)
    return f"{base},\nby_inning as ({step})"


def _stage_step(name: str, season: int, inning: int | None, stage: str | None) -> str:
    """CTE text from ``mart`` to ``chosen``."""
    if stage:
        step = f"select * from by_inning where stage = '{stage}'"
    elif name == "bowling":
        step = _bowling_rollup("by_inning", "bowler")
    else:
        step = _batting_rollup("by_inning", "batsman", False)
    return f"{_inning_step(name, season, inning)},\nchosen as ({step})"


def _lattice(name: str) -> str:
    """All requests at once: stages as they are and added up, of each inning and of all."""
    base, player = (_BOWLING, "bowler") if name == "bowling" else (_BATTING, "batsman")

    def rollup(source: str, keys: str, whole: bool) -> str:
        return _bowling_rollup(source, keys) if name == "bowling" else _batting_rollup(source, keys, whole)

    labels = "case stage when 'Powerplay' then 'Powerplay (1-6)' when 'Middle' then 'Middle (7-15)' else 'Death (16-20)' end"
    return f"""{base},
staged as (
  select * exclude (inning), inning::varchar as inning_choice from mart where inning in (1, 2)
  union all by name
  select *, '1 & 2' as inning_choice from ({rollup("mart", f"{player}, season, stage", True)})),
complete as ({rollup("staged", f"{player}, season, inning_choice", False)})
select *, {labels} as stage_choice from staged
union all by name
select *, 'Complete (1-20)' as stage_choice from complete"""


def _request(name: str, season: int, inning: int | None = None, stage: str | None = None) -> str:
    return f"{_stage_step(name, season, inning, stage)}\nselect * from chosen"


def _order(metric: str, player: str) -> str:
    return f"order by case when isnan({metric}::double) then null else {metric} end desc nulls last, {player}"


_BOWLING_COLUMNS = {
    "overs": "bowler, overs, maiden, bat_runs, extra_runs, wickets, matches, bow_avg, economy",
    "maiden": "bowler, overs, maiden, per_dotball, bat_runs, extra_runs, matches, bow_avg, economy",
    "bat_runs": "bowler, overs, maiden, per_dotball, bat_runs, extra_runs, matches, bow_avg, economy",
    "extra_runs": "bowler, overs, maiden, bat_runs, extra_runs, wickets, matches, bow_avg, economy",
    "wickets": "bowler, overs, maiden, per_dotball, wickets, fivewicket, fourwicket, matches, bow_avg",
    "fivewicket": "bowler, overs, maiden, per_dotball, wickets, fivewicket, fourwicket, matches, bow_avg",
    "fourwicket": "bowler, overs, maiden, wickets, fivewicket, fourwicket, matches, bow_avg, economy",
    "bow_avg": "bowler, overs, maiden, bat_runs, extra_runs, wickets, matches, bow_avg, economy",
    "economy": "bowler, overs, maiden, bat_runs, extra_runs, wickets, matches, bow_avg, economy",
    "per_dotball": "bowler, overs, maiden, per_dotball, wickets, fivewicket, matches, bow_avg, economy",
}
_BATTING_SHOWN = (
    "batsman, runs_made, balls_faced, maximum_score, centuries, half_centuries, batting_avg, strike_rate, "
    "boundries, sixes"
)
_BATTING_METRICS = _BATTING_SHOWN.split(", ")[1:]


def _board(
    name: str, metric: str, season: int = 2008, inning: int | None = None, stage: str | None = None
) -> str:
    player = "bowler" if name == "bowling" else "batsman"
    columns = _BOWLING_COLUMNS[metric] if name == "bowling" else _BATTING_SHOWN
    chosen = _stage_step(name, season, inning, stage)
    return f"{chosen}\nselect {columns} from chosen {_order(metric, player)}"


def _top6(name: str, metric: str) -> str:
    player = "bowler" if name == "bowling" else "batsman"
    chosen = _stage_step(name, 2008, None, None)
    return f"{chosen}\nselect {player}, {metric} from chosen {_order(metric, player)} limit 6"


def _compare(columns: str) -> str:
    rolled = _bowling_rollup("mart", "bowler, season", rounded=False)
    return f"""{_BOWLING},
seasons as ({rolled})
select {columns} from (select * replace (season::varchar as season) from seasons)
where bowler = 'Bowler 5' or bowler = 'Bowler 21'"""


def _select(tables: str, columns: str, source: str) -> str:
    return f"{tables}\nselect {columns} from {source}"


def statements() -> dict[str, str]:
    kb, kt = _BOWLING_KEYS + ", stage", _BATTING_KEYS + ", stage"
    bowling_volume = f"{_FACTS}, {_BOWLER_EXCLUSIONS}"
    batting_volume = f"{_FACTS}, {_BATSMAN_EXCLUSIONS}"
    seen = "seen as (select dismissal_kind, min(rowno) as first_row from deliveries group by dismissal_kind)"
    sql = {
        "combined_facts": _select(_FACTS, "*", "combined"),
        "bowler_volume": _select(bowling_volume, "*", "bowler_volume"),
        "bowler_exclusions": _select(bowling_volume, "*", "bowler_exclusions"),
        "bowler_qualified": _select(_BOWLING_FACTS, "*", "qualified"),
        "batsman_volume": _select(batting_volume, "*", "batsman_volume"),
        "batsman_exclusions": _select(batting_volume, "*", "batsman_exclusions"),
        "batsman_qualified": _select(
            _BATTING_FACTS, "*, concat(batsman, season) as combine_batsman", "qualified"
        ),
        "dismissal_first_seen": f"with {sql_views()}, {seen}\nselect dismissal_kind, first_row from seen",
        "dismissal_credited_by_position": f"""with {sql_views()}, {seen}
select dismissal_kind, position::int as position
from (
  select dismissal_kind, row_number() over (order by first_row, dismissal_kind) as position from seen)
where position in (2, 3, 5, 6, 7, 9)""",
        "bowling_balls": _select(_BOWLING, "*", "balls"),
        "bowling_dots": _select(_BOWLING, "*", "dots"),
        "bowling_maidens": _select(_BOWLING, "*", "maidens"),
        "bowling_runs": _select(_BOWLING, "*", "runs"),
        "bowling_wickets": _select(_BOWLING, "*", "wickets"),
        "bowling_matches": _select(_BOWLING, "*", "played"),
        "bowling_five": _select(_BOWLING, "*", "fives"),
        "bowling_four": _select(_BOWLING, "*", "fours"),
        "bowling_merge_all": _select(_BOWLING, "*", "merged"),
        "bowling_summary": _select(_bowling_tables(_UNSTAGED, _BOWLING_KEYS), "*", "mart"),
        "bowling_stage_union": _select(_BOWLING, "*", "mart"),
        "bowling_mart": _select(_BOWLING, "*", "mart"),
        "batting_striker_appearances": _select(_BATTING, "*", "at_strike"),
        "batting_non_striker_appearances": _select(_BATTING, "*", "off_strike"),
        "batting_appearances": _select(_BATTING, "*", "played"),
        "batting_dismissals": _select(_BATTING, "*", "dismissals"),
        "batting_not_outs": _select(_BATTING, "*", "not_outs"),
        "batting_runs_balls": _select(_BATTING, "*", f"runs full join faced using ({kt})"),
        "batting_boundaries": _select(_BATTING, "*", f"fours full join sixers using ({kt})"),
        "batting_highest": _select(_BATTING, "*", "highest"),
        "batting_milestones": _select(_BATTING, "*", f"hundreds full join fifties using ({kt})"),
        "batting_merge_all": _select(_BATTING, "*", "merged"),
        "batting_summary": _select(_batting_tables(_UNSTAGED, _BATTING_KEYS), "*", "mart"),
        "batting_stage_union": _select(_BATTING, "*", "mart"),
        "batting_mart": _select(_BATTING, "*", "mart"),
        "bowling_lattice": _lattice("bowling"),
        "batting_lattice": _lattice("batting"),
        "batsman_volume_missing": f"""{_MISSING_FACTS}
select batsman, season, count(*) as ballsfaced, {_strict("batsman_runs")} as runs from combined group by batsman, season""",
        "bowling_mart_missing": _BOWLING_MISSING,
        "batting_mart_missing": _BATTING_MISSING,
        "leaderboard_bowling_inning_1_powerplay": _board("bowling", "economy", 2009, 1, "Powerplay"),
        "leaderboard_batting_inning_2_middle": _board("batting", "strike_rate", 2009, 2, "Middle"),
        "page_2_bowling": _board("bowling", "wickets") + " limit 10 offset 10",
        "page_2_batting": _board("batting", "batting_avg") + " limit 10 offset 10",
        "bowler_compare_p1": _compare("bowler, season, overs, wickets"),
        "bowler_compare_same_parameter": _compare("bowler, season, economy"),
        "bowler_compare_p2": _compare("*"),
        "seasons": f"{_FACTS}\nselect distinct season from combined",
        "bowler_choices": _select(_BOWLING, "bowler", "mart"),
        "bowler_choices_distinct": _select(_BOWLING, "distinct bowler", "mart"),
        "top6_bowling_unknown_metric": _top6("bowling", "fivewicket"),
        "top6_batting_unknown_metric": _top6("batting", "strike_rate"),
    }
    for name, metrics in (("bowling", list(_BOWLING_COLUMNS)), ("batting", _BATTING_METRICS)):
        for metric in metrics:
            sql[f"leaderboard_{name}_{metric}"] = _board(name, metric)
            sql[f"top6_{name}_{metric}"] = _top6(name, metric)
        for label, inning in (("1", 1), ("2", 2), ("all", None)):
            sql[f"{name}_inning_{label}"] = f"{_inning_step(name, 2008, inning)}\nselect * from by_inning"
        for stage in ("Powerplay", "Middle", "Death"):
            sql[f"{name}_stage_{stage.lower()}"] = _request(name, 2009, None, stage)
        sql[f"{name}_complete"] = _request(name, 2008)
        sql[f"{name}_complete_inning_1"] = _request(name, 2009, 1)
        sql[f"{name}_inning_2_death"] = _request(name, 2009, 2, "Death")
    return sql
