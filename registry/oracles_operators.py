"""DuckDB statements for the operator queries."""

from __future__ import annotations

_LINES = """
lines as (
    select distinct on (l_orderkey, l_linenumber) * from lineitem
    order by l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity,
             l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
)"""


def _trades(lines: str) -> str:
    return f"""
deals as (
    select o_orderkey || '-' || l_linenumber as trade_id, l_quantity, l_returnflag,
           c_nationkey as buyer, s_nationkey as seller
    from {lines}, orders, customer, supplier
    where l_orderkey = o_orderkey and o_custkey = c_custkey and l_suppkey = s_suppkey
),
trades as (
    select trade_id, l_quantity, l_returnflag, buyer as nation, seller as partner,
           true as is_buyer from deals
    union all
    select trade_id, l_quantity, l_returnflag, seller, buyer, false from deals
)"""


_FILES = """
versions as (
    select o_orderkey // 20000 as number, o_orderkey, 'now' as version,
           o_orderkey || ',' || o_custkey || ',' || o_orderpriority as line
    from orders
    union all
    select o_orderkey // 20000, o_orderkey, 'before',
           o_orderkey || ',' || o_custkey || ','
               || if(o_orderkey // 20000 % 3 = 1, 'unknown', o_orderpriority)
    from orders where o_orderkey // 20000 % 5 <> 4
),
lines as (
    select number, version, strlen(line) + 1 as bytes,
           cast(cast('0x' || substr(sha256(line), 1, 15) as bigint) as hugeint) as h,
           cast(cast('0x' || substr(sha256(line), 16, 15) as bigint) as hugeint) as g,
           row_number() over (partition by number, version order by o_orderkey) - 1 as place
    from versions
),
digests as (
    select 'orders_' || number || '.csv' as source_file, version,
           'lines-1:' || sha256(sum(bytes) || '-' || count(*) || '-' || sum(h) || '-' || sum(g)
                                || '-' || sum(h * place) || '-' || sum(g * place)) as file_hash
    from lines group by number, version
),
plan as (
    select n.source_file,
           case when b.file_hash is null then 'loaded'
                when b.file_hash = n.file_hash then 'skipped' else 'reloaded' end as outcome
    from digests n
    left join digests b on b.source_file = n.source_file and b.version = 'before'
    where n.version = 'now'
)"""

OPERATOR_ORACLES = {
    "keep_first_lineitem": f"""with {_LINES}
        select * replace (cast(l_shipdate as date) as l_shipdate) from lines""",
    "keep_best_rank_per_period": """
        select strftime(o_orderdate, '%Y%m') as month, o_custkey,
               arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as o_orderkey,
               max(o_totalprice) as o_totalprice
        from orders group by 1, 2""",
    "two_sided_trade": f"with {_LINES}, {_trades('lines')} select * from trades",
    "trade_balance_check": f"""with {_trades('lineitem')}
        select trade_id, count(*) as n, cast(sum(if(is_buyer, 1, 0)) as bigint) as n_true
        from trades group by trade_id having n <> 2 or n_true <> 1""",
    "tenure_at_order": """
        with starts as (
            select o_custkey, min(cast(o_orderdate as date)) as first_day
            from orders group by o_custkey
        ),
        yearly as (
            select o.o_custkey,
                   cast(floor((cast(o.o_orderdate as date) - first_day) / 365.25) as integer)
                       as tenure_year,
                   count(*) as orders,
                   cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents
            from orders o join starts using (o_custkey) group by 1, 2
        )
        select a.o_custkey, a.tenure_year, a.orders, a.cents,
               cast(sum(b.orders) as bigint) as cum_orders, cast(sum(b.cents) as bigint) as cum_cents
        from yearly a join yearly b
          on b.o_custkey = a.o_custkey and b.tenure_year <= a.tenure_year
        group by all""",
    "conditional_counts_by_segment": """
        select c_mktsegment, count(*) as orders,
               count(*) filter (o_orderpriority = '1-URGENT') as urgent,
               count(*) filter (o_orderstatus = 'O') as open,
               round(avg(if(o_orderpriority = '1-URGENT', 1, 0)), 4) as urgent_share
        from orders join customer on c_custkey = o_custkey group by c_mktsegment""",
    "same_tenure_pace": """
        with placed as (
            select n_nationkey, n_name, r_name, cast(o_orderdate as date) as day, o_totalprice,
                   o_orderkey, o_orderpriority
            from orders, customer, nation, region
            where o_custkey = c_custkey and c_nationkey = n_nationkey
              and n_regionkey = r_regionkey
        ),
        members as (
            select n_nationkey, n_name, r_name, min(day) as first_day,
                   cast(arg_max(day, (o_totalprice, o_orderkey)) - min(day) as integer) as tenure
            from placed group by all
        )
        select a.n_name as anchor, a.tenure, b.n_name as name,
               (select count(*) from placed p where p.n_nationkey = b.n_nationkey
                and p.day - b.first_day <= a.tenure) as orders,
               (select count(*) from placed p where p.n_nationkey = b.n_nationkey
                and p.day - b.first_day <= a.tenure and o_orderpriority = '1-URGENT') as urgent
        from members a join members b
          on a.r_name = 'ASIA' and (b.r_name = 'EUROPE' or b.n_nationkey = a.n_nationkey)""",
    "nation_head_to_head": f"""with {_LINES}, {_trades('lines')}
        select a.n_name as own, b.n_name as other, count(*) as lines,
               cast(sum(if(is_buyer, 1, 0)) as bigint) as bought,
               cast(sum(if(is_buyer and l_returnflag = 'R', 1, 0)) as bigint) as returned,
               round(avg(if(is_buyer, 1, 0)), 3) as bought_share
        from trades, nation a, nation b, region ra, region rb
        where trades.nation = a.n_nationkey and trades.partner = b.n_nationkey
          and a.n_regionkey = ra.r_regionkey and ra.r_name = 'AFRICA'
          and b.n_regionkey = rb.r_regionkey and rb.r_name = 'AMERICA'
        group by a.n_name, b.n_name""",
    "ordered_list_per_group": """
        select user_id, day, count(*) as kinds,
               string_agg(event_type || ' (' || n || ')', ', ' order by since, event_type) as trail
        from (select user_id, cast(ts as date) as day, event_type, count(*) as n,
                     min(ts) as since
              from events group by 1, 2, 3) kinds
        group by user_id, day""",
    "trailing_365_upsert": """
        with now_rows as (
            select o_orderkey, cast(o_orderdate as date) as o_orderdate, o_orderpriority,
                   o_orderstatus
            from orders
        ),
        target as (
            select * replace ('unknown' as o_orderpriority) from now_rows
            where o_orderdate <= date '2001-03-31'
        ),
        refreshed as (
            select * from now_rows where o_orderstatus <> 'P'
              and o_orderdate + 365 >= (select max(o_orderdate) from target)
        )
        select * from refreshed union all
        select * from target where o_orderkey not in (select o_orderkey from refreshed)""",
    "file_fingerprints": f"""with {_FILES}
        select source_file, file_hash from digests where version = 'now'""",
    "load_plan_outcomes": f"with {_FILES} select source_file, outcome from plan",
    "load_summary": f"""with {_FILES}
        select outcome, (select count(*) from plan where plan.outcome = o.outcome) as files
        from (values ('skipped'), ('loaded'), ('reloaded')) o(outcome)""",
    "manifest_upsert": """
        select 'atp_matches_' || year(o_orderdate) || '.csv' as source_file, count(*) as row_count,
               if(year(o_orderdate) >= 2000, 'now', 'before') as loaded
        from orders where year(o_orderdate) >= 2000 or o_orderstatus <> 'P'
        group by year(o_orderdate)""",
    "classified_files": """
        with named as (
            select case when o_orderstatus = 'O' then 'atp_matches_' || year(o_orderdate) || '.csv'
                        when o_orderstatus = 'F' then 'atp_rankings_'
                            || substr(cast(year(o_orderdate) as varchar), 3, 1) || '0s.csv'
                        when o_orderpriority = '1-URGENT' then 'atp_players.csv'
                        else 'atp_matches_doubles_' || year(o_orderdate) || '.csv' end
                       as source_file
            from orders
        )
        select source_file, count(*) as n,
               case when source_file like '%rankings%' then 'rankings'
                    when source_file like '%players%' then 'players' else 'matches' end as entity
        from named
        where source_file not like '%doubles%'
          and not (source_file like '%matches%' and source_file < 'atp_matches_1998')
        group by source_file""",
    "orders_in_order": """
        select o_orderkey, o_orderpriority, row_number() over (order by o_orderpriority nulls last,
            o_totalprice desc nulls last, o_orderkey nulls last) as position from orders""",
    "insert_by_name": """
        select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey,
               if(o_orderdate >= timestamp '1998-01-01', o_orderstatus, null) as o_orderstatus,
               o_orderpriority
        from orders""",
    "csv_round_trip": """
        select doc_id, lang, source, text, length(text) as n_chars, md5(text) as text_md5
        from documents""",
    "csv_round_trip_in_splits": "select doc_id, lang, source, nullif(text, '') as text from documents",
    "text_typing": """
        with t as (
            select o_orderkey, o_totalprice, o_orderdate, o_orderstatus,
                   case when o_orderstatus = 'F' then o_orderkey || '.0'
                        when o_orderstatus = 'P' then o_orderkey || '.5'
                        when o_orderpriority = '5-LOW' then 'n/a'
                        when o_orderpriority = '2-HIGH' then ''
                        else ' ' || o_orderkey || ' ' end as number,
                   if(o_orderstatus = 'O', o_orderpriority, null) as priority
            from orders
        )
        select o_orderkey, try_cast(number as integer) as whole,
               try_cast(number as bigint) as long_whole,
               cast(o_orderdate as date) as day,
               case when o_orderstatus <> 'P' then cast(o_orderdate as date) end as shaky_day,
               case when o_orderstatus <> 'F' then o_orderstatus end as status,
               trim(concat(priority, ' ', case when o_orderstatus <> 'F' then o_orderstatus end))
                   as name,
               o_orderkey || '-' || priority as key,
               priority ilike '%urg%' or priority ilike '%low%' as marked,
               upper(priority) as upper_priority,
               replace(priority, 'LOW', 'Low') as renamed,
               round(o_totalprice / 7, 2) as share,
               strftime(o_orderdate, '%d %b %Y') as label,
               format('{:+d}', 50000 - o_orderkey) as gap
        from t""",
    "null_logic_flags": """
        select lang, count(*) as documents, count(*) filter (quality = 1) as good,
               count(*) filter (quality <> 1) as bad, count(quality) as labelled,
               count(*) filter (quality = 1 and toxic = 0) as usable,
               count(*) filter (toxic = 1) as toxic,
               count(*) filter (quality is distinct from 1) as kept
        from documents left join labels using (doc_id) group by lang""",
    "first_and_last_per_group": """
        select user_id, arg_min(event_id, (ts, event_id)) as first_event,
               arg_min(event_type, (ts, event_id)) as first_type,
               arg_max(event_id, (ts, event_id)) as last_event,
               arg_max(event_type, (ts, event_id)) as last_type
        from events group by user_id""",
    "era_split_share": """
        select count(*) as orders, count(*) filter (o_orderpriority = '1-URGENT') as urgent,
               count(distinct o_orderstatus) as states,
               max(cast(o_orderdate as date)) as newest,
               round(avg(if(o_orderpriority = '1-URGENT', 1, 0)), 4) as urgent_share
        from orders where o_orderdate >= timestamp '1998-01-01'""",
    "accepted_flags": """
        select l_returnflag as value, count(*) as n from lineitem
        where l_returnflag <> 'A' and l_returnflag <> 'N' group by l_returnflag""",
    "orphan_suppliers": """
        select o_custkey as value, count(*) as n from orders
        where o_custkey not in (select s_suppkey from supplier) group by o_custkey""",
}
