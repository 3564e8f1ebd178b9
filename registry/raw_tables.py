"""Raw text tables of a results feed, derived from the given tables.

Every order becomes a match and two ranking rows; every customer and every supplier becomes a
player row (ids below the number of suppliers are therefore re-used for two persons). Nothing is
filtered or sampled, so the work grows with the tables. The case expressions only decide what a
row looks like: a few players hold a large part of all rows (player 1 the largest), some ids
are not in the player master, some values are blank, missing or unreadable.

The text is valid in Spark and DuckDB alike, so both sides of a comparison read the same input.
"""

from __future__ import annotations

# Focus players of the derived feed.
ROSTER = [
    (0, "Alpha", "Big 3", 1),
    (1, "Bravo", "Big 3", 2),
    (2, "Charlie", "Big 3", 3),
    (3, "Delta", "New generation", 4),
    (4, "Echo", "New generation", 5),
    (5, "Foxtrot", "Big 3 era challengers", 6),
    (6, "Golf", "Big 3 era challengers", 7),
]

_DAY_TEXT = "cast(year({0}) * 10000 + month({0}) * 100 + day({0}) as string)"

# Orders as meetings of two players.
MEETINGS = """
select k, pri, d, price, w,
       case when w < 7 and k % 2 = 0 then (w + 1 + k % 5) % 7
            when w >= 7 and k % 5 = 0 then k % 7
            else w + 1 + k % 37 end as l
from (
    select o_orderkey as k, substr(o_orderpriority, 1, 1) as pri, o_totalprice as price,
           cast(cast(o_orderdate as date) + interval 3500 days as date) as d,
           case when k0 % 3 <> 0 then o_custkey when k0 % 2 = 0 then 1 else k0 % 7 end as w
    from (select o_orderkey as k0, * from {orders}) numbered
) drawn
"""

MATCHES = f"""
select 'T' || cast(cast((k - k % 256) / 256 as bigint) as string) as tourney_id,
       case k % 4 when 0 then 'Us Open' when 1 then 'Wimbledon'
                  when 2 then 'Roland Garros' else 'Australian Open' end as tourney_name,
       case when k % 997 = 5 then 'Sand' when k % 13 = 0 then ''
            else case k % 4 when 0 then 'Hard' when 1 then 'Grass'
                            when 2 then 'Clay' else 'Carpet' end end as surface,
       case when k % 29 = 0 then 'X' when k % 17 = 0 then 'd' when k % 23 = 0 then 'O'
            else case pri when '1' then 'G' when '2' then 'M' when '3' then 'A'
                          when '4' then 'C' else 'F' end end as tourney_level,
       {_DAY_TEXT.format('d')} as tourney_date,
       cast(k as string) as match_num,
       case when k % 4999 = 17 then 'Q' || cast(w as string) else cast(w as string) end as winner_id,
       case when k % 6007 = 11 then cast(null as string) else cast(l as string) end as loser_id,
       case when k % 13 = 5 then '' else cast(k % 89 + 1 as string) end as winner_rank,
       cast(k % 5000 as string) as winner_rank_points,
       case when k % 13 = 6 then cast(null as string)
            else cast((k * 7) % 97 + 1 as string) end as loser_rank,
       cast((k * 7) % 4000 as string) as loser_rank_points,
       case when k % 19 = 0 then '6-3 RET' when k % 23 = 1 then cast(null as string)
            when k % 31 = 0 then 'W/O' when k % 37 = 0 then '6-1 Def.'
            else '6-4 6-4' end as score,
       case when pri = '1' then '5' else '3' end as best_of,
       case when k % 11 < 2 then 'F' when k % 11 < 4 then 'SF' when k % 11 < 6 then 'QF'
            when k % 11 = 6 then 'R16' when k % 11 = 7 then 'R32' when k % 11 < 10 then 'R64'
            else 'R128' end as round,
       case when k % 41 = 0 then 'abc' when k % 43 = 0 then '95.5'
            else cast(60 + k % 180 as string) || '.0' end as minutes,
       'atp_matches_' || cast(year(d) as string) || '.csv' as _source_file
from ({MEETINGS}) meetings
"""

_BIRTH = "cast(date '1977-08-01' + interval '1' day * ((p.id * 997) % 4000) as date)"

PLAYERS = f"""
select cast(p.id as string) as player_id, p.first as name_first, p.last as name_last,
       case p.id % 3 when 0 then 'R' when 1 then 'L' else '' end as hand,
       case when p.id >= 7 and p.id % 13 = 12 then '19000000'
            when p.id >= 7 and p.id % 17 = 16 then ''
            else {_DAY_TEXT.format(_BIRTH)} end as dob,
       n.n_name as ioc,
       case when p.id % 7 = 6 then '' else cast(165 + p.id % 40 as string) || '.0' end as height
from (
    select c_custkey as id, c_mktsegment as first, c_name as last, c_nationkey as nation
    from {{customer}}
    union all
    select s_suppkey, 'FOUNDRY', s_name, s_nationkey from {{supplier}}
) p
left join {{nation}} n on n.n_nationkey = p.nation
"""

_WEEK_TEXT = _DAY_TEXT.format("cast(date_trunc('week', d) as date)")

RANKINGS = f"""
select {_WEEK_TEXT} as ranking_date,
       case when k % 4999 = 3 then 'NR' else cast((k * 13) % 53 + 1 as string) end as rank,
       cast(w as string) as player,
       cast(cast(floor(price) as bigint) as string) as points
from ({MEETINGS}) winners
union all
select {_WEEK_TEXT}, cast((k * 7) % 97 + 1 as string), cast(l as string),
       cast(k % 700 as string)
from ({MEETINGS}) losers
"""
