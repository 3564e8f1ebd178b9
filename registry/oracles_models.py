"""DuckDB statements for the models, marts, reports and checks.

Written independently of the Spark models: running totals and same-age counts are correlated
subqueries here, de-duplication is DISTINCT ON, the unpivot is a lateral VALUES list.
"""

from __future__ import annotations

from careerline.sources.seeds import TOURNEY_LEVELS
from registry import raw_tables

_GIVEN = {t: t for t in ("orders", "customer", "supplier", "nation")}


def _values(rows: list[tuple]) -> str:
    def text(value: object) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        return f"'{value}'" if isinstance(value, str) else str(value)

    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


PREFIX = f"""
with raw_matches as ({raw_tables.MATCHES.format(**_GIVEN)}),
raw_players as ({raw_tables.PLAYERS.format(**_GIVEN)}),
raw_rankings as ({raw_tables.RANKINGS.format(**_GIVEN)}),
roster as (
    select cast(a as bigint) as player_id, b as display_name, c as cohort,
           cast(e as integer) as colour_slot
    from (values {_values(raw_tables.ROSTER)}) v(a, b, c, e)
),
levels as (
    select * from (values {_values(TOURNEY_LEVELS)})
        v(tourney_level, level_name, is_grand_slam)
),
m as (
    select tourney_id || '-' || match_num as match_id, tourney_id,
           case tourney_name when 'Us Open' then 'US Open' else tourney_name end as tourney_name,
           case when surface <> '' then surface end as surface,
           upper(tourney_level) as tourney_level,
           make_date(cast(tourney_date[1:4] as int), cast(tourney_date[5:6] as int),
                     cast(tourney_date[7:8] as int)) as tourney_date,
           try_cast(match_num as integer) as match_num, round as round_code,
           try_cast(best_of as integer) as best_of, score,
           try_cast(minutes as integer) as minutes,
           try_cast(winner_id as bigint) as winner_id, try_cast(loser_id as bigint) as loser_id,
           try_cast(winner_rank as integer) as winner_rank,
           try_cast(loser_rank as integer) as loser_rank,
           try_cast(winner_rank_points as integer) as winner_rank_points,
           try_cast(loser_rank_points as integer) as loser_rank_points,
           regexp_matches(upper(score), 'RET|W/O|DEF') as is_incomplete,
           _source_file
    from raw_matches
    where not (raw_matches.winner_id is null or raw_matches.loser_id is null)
),
typed_p as (
    select try_cast(player_id as bigint) as id,
           trim(concat(name_first, ' ', name_last)) as player_name,
           case when hand <> '' then hand end as hand,
           cast(try_strptime(dob, '%Y%m%d') as date) as date_of_birth,
           case when ioc <> '' then ioc end as country_code,
           try_cast(height as integer) as height_cm
    from raw_players
),
p as (
    select distinct on (id) id as player_id, player_name, hand, date_of_birth, country_code,
           height_cm
    from typed_p where id is not null
    order by id, player_name, date_of_birth nulls last, country_code nulls last,
             hand nulls last, height_cm nulls last
),
typed_r as (
    select cast(strptime(ranking_date, '%Y%m%d') as date) as ranking_date,
           try_cast(rank as integer) as ranking, try_cast(player as bigint) as player_id,
           try_cast(points as integer) as ranking_points
    from raw_rankings
),
r as (
    select distinct on (ranking_date, player_id) *
    from typed_r where player_id is not null and ranking is not null
    order by ranking_date, player_id, ranking, ranking_points desc nulls last
),
pm as (
    select m.match_id || '-' || side.player_id as player_match_id,
           m.match_id, m.tourney_id, m.tourney_name, m.tourney_date, m.surface, m.tourney_level,
           m.round_code, m.best_of, m.is_incomplete, side.player_id, side.opponent_id,
           side.player_rank, side.opponent_rank, side.is_win,
           m.tourney_level in (select tourney_level from levels where is_grand_slam)
               as is_grand_slam,
           levels.level_name, p.date_of_birth,
           (m.tourney_date - p.date_of_birth) / 365.25 as age_at_match,
           side.opponent_rank < 11 as vs_top10,
           m.round_code = 'F' and side.is_win as is_title
    from m
    cross join lateral (values (winner_id, loser_id, winner_rank, loser_rank, true),
                               (loser_id, winner_id, loser_rank, winner_rank, false))
        side(player_id, opponent_id, player_rank, opponent_rank, is_win)
    left join levels on levels.tourney_level = m.tourney_level
    left join p on p.player_id = side.player_id
),
dim as (
    select p.player_id, p.player_name, ifnull(roster.display_name, p.player_name) as display_name,
           roster.cohort, roster.colour_slot,
           p.player_id in (select player_id from roster) as is_focus_player,
           p.hand, p.date_of_birth, p.country_code, p.height_cm
    from p left join roster on roster.player_id = p.player_id
),
no1 as (
    select r.ranking_date, r.player_id, dim.display_name,
           (r.ranking_date - dim.date_of_birth) / 365.25 as age_at_ranking
    from r, dim where dim.player_id = r.player_id and r.ranking = 1
),
slams as (
    select pm.tourney_date, cast(year(pm.tourney_date) as integer) as season, pm.tourney_name,
           pm.surface, pm.player_id, dim.display_name, dim.cohort,
           round(pm.age_at_match, 2) as age_at_title
    from pm, dim
    where dim.player_id = pm.player_id and pm.is_title and pm.tourney_level = 'G'
),
counted as (
    select pm.*, cast(floor(age_at_match) as integer) as age_year
    from pm where is_incomplete = false and tourney_level in ('G', 'M', 'F', 'A', 'O')
),
ages as (
    select c.player_id, d.display_name, d.cohort, d.colour_slot, c.age_year,
           count(*) as matches,
           cast(sum(case when is_win then 1 else 0 end) as bigint) as wins,
           cast(sum(case when vs_top10 then 1 else 0 end) as bigint) as matches_vs_top10,
           cast(sum(case when vs_top10 and is_win then 1 else 0 end) as bigint) as wins_vs_top10,
           cast(sum(case when is_title then 1 else 0 end) as bigint) as titles,
           cast(sum(case when is_title and is_grand_slam then 1 else 0 end) as bigint)
               as slam_titles
    from counted c join dim d on d.player_id = c.player_id
    where d.is_focus_player
    group by c.player_id, d.display_name, d.cohort, d.colour_slot, c.age_year
),
ages_weeks as (
    select ages.*, (select count(*) from no1 where no1.player_id = ages.player_id
                    and floor(no1.age_at_ranking) = ages.age_year) as weeks_at_no1
    from ages
),
curves as (
    select a.player_id, a.display_name, a.cohort, a.colour_slot, a.age_year, a.matches, a.wins,
           a.matches_vs_top10, a.wins_vs_top10, a.titles, a.slam_titles,
           round(a.wins / a.matches, 4) as win_pct,
           case when a.matches_vs_top10 > 0
                then round(a.wins_vs_top10 / a.matches_vs_top10, 4) end as win_pct_vs_top10,
           a.weeks_at_no1,
           cast(sum(e.titles) as bigint) as cum_titles,
           cast(sum(e.slam_titles) as bigint) as cum_slam_titles,
           cast(sum(e.weeks_at_no1) as bigint) as cum_weeks_at_no1
    from ages_weeks a join ages_weeks e
      on e.player_id = a.player_id and e.age_year <= a.age_year
    group by all
),
newcomers as (
    select player_id, display_name,
           ((select max(tourney_date) from pm) - date_of_birth) / 365.25 as today_age
    from dim where cohort = 'New generation'
),
grid as (
    select n.display_name as anchor, n.today_age, d.player_id, d.display_name, d.cohort
    from newcomers n join dim d on d.player_id = n.player_id or d.cohort = 'Big 3'
),
grid_counts as (
    select grid.*,
           (select count(*) from counted c where c.player_id = grid.player_id
               and c.age_at_match <= grid.today_age and c.is_title and c.is_grand_slam) as slam_n,
           (select count(*) from counted c where c.player_id = grid.player_id
               and c.age_at_match <= grid.today_age and c.is_title) as title_n,
           (select count(*) from counted c where c.player_id = grid.player_id
               and c.age_at_match <= grid.today_age and c.is_win) as win_n,
           (select count(*) from counted c where c.player_id = grid.player_id
               and c.age_at_match <= grid.today_age) as match_n,
           (select count(*) from no1 where no1.player_id = grid.player_id
               and no1.age_at_ranking <= grid.today_age) as week_n
    from grid
),
pace as (
    select anchor as compared_at_age_of, round(today_age, 1) as age, display_name as player_name,
           cohort, slam_n as slam_titles, title_n as titles, win_n as match_wins,
           case when match_n > 0 then round(win_n / match_n, 3) end as win_pct,
           week_n as weeks_at_no1
    from grid_counts
),
scalps as (
    select pm.tourney_id, pm.player_id, count(*) as scalp_n,
           array_to_string(list(dim.display_name || ' (' || pm.round_code || ')'
               order by pm.tourney_date, pm.round_code, dim.display_name), ', ') as scalp_list
    from pm join dim on dim.player_id = pm.opponent_id and dim.cohort = 'Big 3'
    where pm.is_win and pm.tourney_level = 'G'
    group by pm.tourney_id, pm.player_id
),
era as (
    select f.tourney_date, cast(year(f.tourney_date) as integer) as season, f.tourney_name,
           f.surface, f.player_id, w.display_name as champion,
           ifnull(w.cohort, 'Other') as champion_group, l.display_name as final_opponent,
           ifnull(s.scalp_n, 0) as big3_wins_in_run, s.scalp_list as big3_beaten
    from pm f
    join dim w on w.player_id = f.player_id
    join dim l on l.player_id = f.opponent_id
    left join scalps s on s.tourney_id = f.tourney_id and s.player_id = f.player_id
    where f.is_title and f.tourney_level = 'G' and year(f.tourney_date) >= 2005
),
h2h as (
    select a.display_name as player, a.cohort, b.display_name as opponent, count(*) as matches,
           cast(sum(if(c.is_win, 1, 0)) as bigint) as wins, round(avg(if(c.is_win, 1, 0)), 3) as win_pct,
           cast(sum(if(c.is_grand_slam, 1, 0)) as bigint) as slam_matches,
           cast(sum(if(c.is_grand_slam and c.is_win, 1, 0)) as bigint) as slam_wins,
           cast(sum(if(c.is_grand_slam and c.round_code = 'F', 1, 0)) as bigint) as slam_finals,
           cast(sum(if(c.is_grand_slam and c.is_title, 1, 0)) as bigint) as slam_finals_won
    from counted c
    join roster a on a.player_id = c.player_id and a.cohort in
        ('New generation', 'Big 3 era challengers')
    join roster b on b.player_id = c.opponent_id and b.cohort = 'Big 3'
    group by a.display_name, a.cohort, b.display_name
),
series as (
    select player_id, display_name, cohort, age_year, metric, value, sample, matches, wins,
           titles, slam_titles
    from curves cross join lateral (values
        ('cum_slam_titles', cast(cum_slam_titles as double), 1000000),
        ('win_pct', win_pct, matches),
        ('win_pct_vs_top10', win_pct_vs_top10, matches_vs_top10),
        ('cum_weeks_at_no1', cast(cum_weeks_at_no1 as double), 1000000)) v(metric, value, sample)
    where value is not null
),
exported as (
    select * from series
    where sample >= 10
      and (metric like 'cum%' or cohort is null or cohort <> 'Big 3 era challengers')
)
"""

SERIES_COLUMNS = "player_id, display_name, age_year, value, matches, wins, titles, slam_titles"

FACT_AFTER_REFRESH = """,
target as (
    select pm.* replace ('Unknown' as surface) from pm where tourney_date <= date '2011-01-31'
),
source as (select * from pm where tourney_level <> 'X'),
refreshed as (
    select * from source
    where tourney_date + 365 >= (select max(tourney_date) from target)
)
select * from refreshed
union all
select * from target t
where not exists (select 1 from refreshed n where n.player_match_id = t.player_match_id)
"""

MODEL_ORACLES = {
    "hot_players": """select player_id, count(*) as n, (select count(*) from pm) as total
        from pm group by player_id having count(*) >= 0.02 * (select count(*) from pm)""",
    "winners_spread": """select winner_id as player_id, match_id, player_name, country_code
        from m left join p on winner_id = player_id""",
    "raw_table_counts": """select (select count(*) from raw_matches) as matches,
        (select count(*) from raw_players) as players,
        (select count(*) from raw_rankings) as rankings""",
    "stg_matches": "select * from m",
    "stg_players": "select * from p",
    "stg_rankings": "select * from r",
    "int_player_matches": "select * from pm",
    "dim_players": "select * from dim",
    "fct_player_matches": FACT_AFTER_REFRESH,
    "fct_full_refresh": "select * from pm where tourney_level <> 'X'",
    "mart_no1_weeks": "select * from no1",
    "mart_slam_titles": "select * from slams",
    "mart_age_curves": "select * from curves",
    "mart_pace_comparison": "select * from pace",
    "mart_big3_era_slams": "select * from era",
    "mart_vs_big3_h2h": "select * from h2h",
    "report_headline": """
        select own.compared_at_age_of,
               format('{}: Grand Slams at {:.1f}', own.compared_at_age_of, own.age) as label,
               own.slam_titles, best.player_name as best_player,
               best.slam_titles as best_slam_titles,
               format('{:+d} vs {} at the same age', own.slam_titles - best.slam_titles,
                      best.player_name) as delta
        from pace own
        join (select distinct on (compared_at_age_of) * from pace where cohort = 'Big 3'
              order by compared_at_age_of, slam_titles desc, player_name) best
          on best.compared_at_age_of = own.compared_at_age_of
        where own.player_name = own.compared_at_age_of""",
    "report_anchor_count":
        "select count(distinct compared_at_age_of) as anchors from pace",
    "report_same_age_table": """select compared_at_age_of, player_name as "Player",
        slam_titles as "Slams", titles as "Titles", match_wins as "Wins", win_pct as "Win %",
        weeks_at_no1 as "Weeks at No. 1" from pace""",
    "report_pace_bars":
        "select compared_at_age_of, age, player_name, slam_titles from pace",
    "report_curve_table":
        "select * from curves where display_name in ('Bravo', 'Delta', 'Golf')",
    "report_focus_slots": "select display_name, colour_slot from curves group by 1, 2",
    "report_era_split": """select count(*) as all_titles,
        cast(sum(if(champion_group = 'Big 3', 1, 0)) as bigint) as big3_titles,
        cast(sum(if(champion_group = 'Big 3', 0, 1)) as bigint) as other_titles from era""",
    "report_other_champions": """
        select champion, count(*) as titles,
               cast(sum(if(big3_wins_in_run > 0, 1, 0)) as bigint) as via_big3,
               cast(sum(if(big3_wins_in_run > 0, 0, 1)) as bigint) as without_big3,
               count(*) || '  (' || sum(if(big3_wins_in_run > 0, 1, 0))
                   || ' beating a Big 3 player)' as label
        from era where champion_group <> 'Big 3' group by champion""",
    "report_other_titles": """select season, tourney_name, champion, final_opponent, big3_beaten
        from era where champion_group <> 'Big 3'""",
    "report_challenger_finals": """
        select player, cast(sum(slam_finals) as bigint) as slam_finals,
               cast(sum(slam_finals_won) as bigint) as slam_finals_won,
               cast(sum(slam_finals - slam_finals_won) as bigint) as slam_finals_lost,
               'won ' || sum(slam_finals_won) || ' of ' || sum(slam_finals) as label
        from h2h where cohort = 'Big 3 era challengers' group by player""",
    "report_head_to_head_table": """select player as "Player", opponent as "Opponent",
        matches as "Matches", wins as "Wins", win_pct as "Win %", slam_finals as "Slam finals",
        slam_finals_won as "Slam finals won" from h2h""",
    "report_all_titles": """select tourney_date as "Date", tourney_name as "Tournament",
        surface as "Surface", display_name as "Champion", ifnull(cohort, 'Other') as "Group",
        age_at_title as "Age" from slams""",
    "report_cutoff_caption": """
        select (select count(*) from slams where cohort = 'Big 3') as big3_slams,
               strftime(max(tourney_date), '%d %b %Y') as data_to from pm""",
    "check_unique": """select player_id as key, count(*) as n from raw_players
        where player_id is not null group by player_id having count(*) > 1""",
    "check_not_null":
        "select match_id, winner_id, loser_id from m where winner_id is null",
    "check_accepted_values": """select surface as value, count(*) as n from m
        where surface not in ('Hard', 'Clay', 'Grass', 'Carpet') group by surface""",
    "check_relationships": """select player_id as value, count(*) as n from pm
        where player_id is not null and player_id not in (select player_id from p)
        group by player_id""",
    "check_unique_combination": """select ranking_date || '-' || player as key, count(*) as n
        from raw_rankings group by 1 having count(*) > 1""",
    "check_report": """
        select c.name as check_name, if(c.name like '%player_id.relationships', 'warn', 'error') as severity, c.failures
        from (
            select 'stg_matches.match_id.not_null' as name, count(*) - count(match_id) as failures from m
            union all select 'stg_matches.tourney_date.not_null', count(*) - count(tourney_date) from m
            union all select 'stg_matches.winner_id.not_null', count(*) - count(winner_id) from m
            union all select 'stg_matches.loser_id.not_null', count(*) - count(loser_id) from m
            union all select 'stg_matches.surface.accepted_values', count(*) from m
                where surface not in ('Hard', 'Clay', 'Grass', 'Carpet')
            union all select 'stg_matches.match_id.unique', count(*) from
                (select match_id from m where match_id is not null group by match_id having count(*) > 1)
            union all select 'stg_matches.tourney_level.relationships', count(distinct tourney_level) from m
                where tourney_level not in (select tourney_level from levels)
            union all select 'stg_players.player_id.unique', count(player_id) - count(distinct player_id) from p
            union all select 'stg_players.player_id.not_null', count(*) - count(player_id) from p
            union all select 'stg_rankings.ranking_date.not_null', count(*) - count(ranking_date) from r
            union all select 'stg_rankings.ranking_date+player_id.unique_combination', count(*) from
                (select ranking_date || '-' || player_id from r group by 1 having count(*) > 1)
            union all select 'int_player_matches.player_match_id.not_null', count(*) - count(player_match_id) from pm
            union all select 'int_player_matches.player_id.not_null', count(*) - count(player_id) from pm
            union all select 'int_player_matches.player_match_id.unique', count(*) from
                (select player_match_id from pm where player_match_id is not null group by 1 having count(*) > 1)
            union all select 'int_player_matches.player_id.relationships', count(distinct player_id) from pm
                where player_id is not null and player_id not in (select player_id from p)
            union all select 'int_player_matches.match_id.one_of_each', count(*) from
                (select match_id from pm group by match_id having count(*) <> 2 or sum(if(is_win, 1, 0)) <> 1)
            union all select 'dim_players.player_id.unique', count(player_id) - count(distinct player_id) from dim
            union all select 'dim_players.player_id.not_null', count(*) - count(player_id) from dim
            union all select 'fct_player_matches.player_match_id.unique', count(*) from
                (select player_match_id from pm where player_match_id is not null group by 1 having count(*) > 1)
            union all select 'fct_player_matches.player_match_id.not_null', count(*) - count(player_match_id) from pm
            union all select 'mart_age_curves.player_id+age_year.unique_combination', count(*) from
                (select player_id || '-' || age_year from curves group by 1 having count(*) > 1)
            union all select 'mart_age_curves.win_pct.not_null', count(*) - count(win_pct) from curves
            union all select 'mart_big3_era_slams.champion.not_null', count(*) - count(champion) from era
        ) c""",
    "pace_in_order": """select *, row_number() over (order by compared_at_age_of nulls last, cohort desc nulls last, slam_titles desc nulls last,
        player_name nulls last) as position from pace""",
    "curves_in_order": """select *, row_number() over (order by player_id nulls last, age_year nulls last) as position
        from curves""",
}

for _metric in ("cum_slam_titles", "win_pct", "win_pct_vs_top10", "cum_weeks_at_no1"):
    MODEL_ORACLES[f"report_series_{_metric}"] = (
        f"select {SERIES_COLUMNS} from series where metric = '{_metric}' and sample >= 5"
    )
    MODEL_ORACLES[f"report_exported_series_{_metric}"] = (
        f"select {SERIES_COLUMNS} from exported where metric = '{_metric}'"
    )
    MODEL_ORACLES[f"report_line_ends_{_metric}"] = f"""
        select display_name, max(age_year) as age_year, arg_max(value, age_year) as value
        from exported where metric = '{_metric}' group by display_name"""

MODEL_ORACLES = {name: PREFIX + text for name, text in MODEL_ORACLES.items()}
