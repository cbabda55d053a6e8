"""Named queries over the test tables: each is asked through the engine, most with SQL to hold it against.

REL holds relational queries: the text between bdrel( and ), and the DuckDB SQL where it differs."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, cast
from .operators import array as ops
from .operators import kv
from .plans import telemetry
from .session import shared_dir, written
from .sources import api, binary, files
from .streaming import windows

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
_REV = "l_extendedprice * (1 - l_discount)"

REL: dict[str, str | tuple[str, str]] = {
    "tpch_q1": f"""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, round(sum({_REV}), 2) as sum_disc_price,
        round(sum({_REV} * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
        from lineitem where l_shipdate <= date '1998-12-01' - interval '65' day group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""",
    "tpch_q3": f"""select l_orderkey, round(sum({_REV}), 2) as revenue, o_orderdate from customer, orders, lineitem
        where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15'
        group by l_orderkey, o_orderdate order by revenue desc, o_orderdate, l_orderkey limit 10""",
    "tpch_q4": """select o_orderpriority, count(*) as order_count from orders where o_orderdate >= date '1997-07-01' and o_orderdate < date '1997-07-01' + interval '3' month
        and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate) group by o_orderpriority order by o_orderpriority""",
    "tpch_q5": f"""select n_name, round(sum({_REV}), 2) as revenue from customer, orders, lineitem, supplier, nation, region
        where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey
        and r_regionkey = 1 and o_orderdate >= date '1996-01-01' and o_orderdate < date '1996-01-01' + interval '2' year group by n_name order by revenue desc""",
    "tpch_q6": """select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-01-01' + interval '1' year
        and l_discount between 0.06 - 0.011 and 0.06 + 0.011 and l_quantity < 24""",
    "tpch_q7": f"""select supp_nation, cust_nation, l_year, round(sum(volume), 2) as revenue from (select n1.n_name as supp_nation, n2.n_name as cust_nation, extract(year from l_shipdate) as l_year, {_REV} as volume
        from supplier, lineitem, orders, customer, nation n1, nation n2 where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey
        and ((n1.n_name = 'NATION_1' and n2.n_name = 'NATION_2') or (n1.n_name = 'NATION_2' and n2.n_name = 'NATION_1'))) as shipping
        group by supp_nation, cust_nation, l_year order by supp_nation, cust_nation, l_year""",
    "tpch_q8": f"""select o_year, round(sum(case when nation = 'NATION_3' then volume else 0 end) / sum(volume), 6) as mkt_share from (select extract(year from o_orderdate) as o_year, {_REV} as volume, n2.n_name as nation
        from part, supplier, lineitem, orders, customer, nation n1, nation n2, region where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey
        and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and s_nationkey = n2.n_nationkey and p_type = 'ECONOMY') as all_nations group by o_year order by o_year""",
    "tpch_q10": f"""select c_custkey, c_name, round(sum({_REV}), 2) as revenue, c_acctbal, n_name from customer, orders, lineitem, nation where c_custkey = o_custkey and l_orderkey = o_orderkey
        and o_orderdate >= date '1996-10-01' and o_orderdate < date '1996-10-01' + interval '3' month and l_returnflag = 'R' and c_nationkey = n_nationkey
        group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20""",
    "tpch_q11": f"""select l_partkey as ps_partkey, round(sum({_REV}), 2) as value from lineitem, supplier, nation where l_suppkey = s_suppkey and s_nationkey = n_nationkey and n_nationkey < 5 group by l_partkey
        having sum({_REV}) > (select sum({_REV}) * 0.002 from lineitem, supplier, nation where l_suppkey = s_suppkey and s_nationkey = n_nationkey and n_nationkey < 5) order by value desc, ps_partkey""",
    "tpch_q12": """select l_returnflag, sum(case when o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH' then 1 else 0 end) as high_line_count,
        sum(case when o_orderpriority <> '1-URGENT' and o_orderpriority <> '2-HIGH' then 1 else 0 end) as low_line_count from orders, lineitem where o_orderkey = l_orderkey and l_returnflag in ('A', 'R')
        and l_shipdate > o_orderdate and l_shipdate >= date '1997-01-01' and l_shipdate < date '1998-01-01' group by l_returnflag order by l_returnflag""",
    "tpch_q13": """select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left outer join orders on c_custkey = o_custkey and o_orderpriority not like '%LOW%'
        group by c_custkey) as c_orders group by c_count order by custdist desc, c_count desc""",
    "tpch_q14": f"""select round(100.00 * sum(case when p_type like 'PROMO%' then {_REV} else 0 end) / sum({_REV}), 6) as promo_revenue from lineitem, part where l_partkey = p_partkey and l_shipdate >= date '1997-09-01'
        and l_shipdate < date '1997-09-01' + interval '1' month""",
    "tpch_q15": f"""with revenue as (select l_suppkey as supplier_no, round(sum({_REV}), 2) as total_revenue from lineitem where l_shipdate >= date '1997-01-01' and l_shipdate < date '1997-01-01' + interval '3' month group by l_suppkey)
        select s_suppkey, s_name, total_revenue from supplier, revenue where s_suppkey = supplier_no and total_revenue = (select max(total_revenue) from revenue) order by s_suppkey""",
    "tpch_q16": """select p_brand, p_type, p_size, count(distinct l_suppkey) as supplier_cnt from lineitem, part where p_partkey = l_partkey and p_type not like 'MEDIUM%' and p_size in (3, 9, 14, 19, 23, 36, 45, 49)
        and l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) group by p_brand, p_type, p_size order by supplier_cnt desc, p_brand, p_type, p_size""",
    "tpch_q17": """select round(sum(l_extendedprice) / 7.0, 2) as avg_yearly from lineitem, part where p_partkey = l_partkey and p_size < 10 and l_quantity < (select 0.4 * avg(l_quantity) from lineitem where l_partkey = p_partkey)""",
    "tpch_q18": """select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) as qty from customer, orders, lineitem where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 200)
        and c_custkey = o_custkey and o_orderkey = l_orderkey group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice order by o_totalprice desc, o_orderdate, o_orderkey limit 100""",
    "tpch_q19": f"""select round(sum({_REV}), 2) as revenue from lineitem, part where (p_partkey = l_partkey and p_type = 'SMALL' and l_quantity between 1 and 11 and p_size between 1 and 15)
        or (p_partkey = l_partkey and p_type = 'LARGE' and l_quantity between 10 and 20 and p_size between 1 and 30) or (p_partkey = l_partkey and p_type = 'PROMO' and l_quantity between 20 and 30 and p_size between 1 and 45)""",
    "tpch_q20": """select s_suppkey, s_name from supplier where s_suppkey in (select l_suppkey from lineitem where l_partkey in (select p_partkey from part where p_type like 'LARGE%') group by l_suppkey having sum(l_quantity) > 50) order by s_suppkey""",
    "tpch_q21": """select s_name, count(*) as numwait from supplier, lineitem l1, orders where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F' and l1.l_shipdate > o_orderdate
        and exists (select 1 from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
        and not exists (select 1 from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_shipdate < l1.l_shipdate) group by s_name order by numwait desc, s_name limit 100""",
    "tpch_q22": """select c_nationkey, count(*) as numcust, round(sum(c_acctbal), 2) as totacctbal from customer where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0.00)
        and not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= date '1999-01-01') group by c_nationkey order by c_nationkey""",
    "tpch_q2": """select s_acctbal, s_name, n_name, p_partkey from (select distinct l_partkey, l_suppkey from lineitem) ps, part, supplier, nation, region where p_partkey = l_partkey and s_suppkey = l_suppkey and p_size = 15
        and s_nationkey = n_nationkey and n_regionkey = r_regionkey and s_acctbal = (select max(s2.s_acctbal) from lineitem l2, supplier s2 where l2.l_partkey = p_partkey and s2.s_suppkey = l2.l_suppkey)
        order by s_acctbal desc, n_name, s_name, p_partkey limit 100""",
    "tpch_q9": f"""select nation, o_year, round(sum(amount), 2) as sum_profit from (select n_name as nation, extract(year from o_orderdate) as o_year, {_REV} - 10 * l_quantity as amount from part, supplier, lineitem, orders, nation
        where s_suppkey = l_suppkey and p_partkey = l_partkey and o_orderkey = l_orderkey and s_nationkey = n_nationkey and p_type like '%MO%') as profit group by nation, o_year order by nation, o_year desc""",
    "scan_seq": "select r_regionkey, r_name from region",
    "scan_alias_filter": "select n.n_name from nation n where n.n_regionkey = 2 and n.n_nationkey between 3 and 20",
    "scan_cte": "with big as (select o_custkey, o_totalprice from orders where o_totalprice > 100000), few as (select * from big where o_custkey < 50) select o_custkey, count(*) as n from few group by o_custkey",
    "scan_values": "select k, v from (values (1, 'a'), (2, 'b'), (3, null)) as t(k, v)",
    "project_expressions": "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net, -l_quantity as neg, l_linenumber % 3 as rest from lineitem",
    "filter_boolean": "select p_partkey from part where (p_size > 40 or p_brand = 'Brand#11') and not p_type = 'PROMO'",
    "filter_between": "select o_orderkey from orders where o_totalprice between 1000 and 50000 and o_orderkey not between 10 and 300",
    "filter_in": "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey not in (1, 2, 3)",
    "filter_null": "select e.event_id from (select event_id, case when event_type = 'click' then null else value end as v from events) e where e.v is null",
    "filter_like": ("select p_partkey from part where p_type ~~ 'S%' and p_name !~~ '%9'", "select p_partkey from part where p_type like 'S%' and p_name not like '%9'"),
    "filter_regex": ("select p_partkey from part where p_name ~ '[13]$' and p_type ~* '^small|^large' and p_brand !~ '5' and p_brand !~* 'BRAND#4'",
        "select p_partkey from part where regexp_matches(p_name, '[13]$') and regexp_matches(p_type, '^small|^large', 'i') and not regexp_matches(p_brand, '5') and not regexp_matches(p_brand, 'BRAND#4', 'i')"),
    "filter_text_match": ("select doc_id from documents where text @@ to_tsquery('the')", "select doc_id from documents where list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 'the')"),
    "filter_in_subquery": "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)",
    "filter_exists": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')",
    "filter_any": ("select p_partkey from part where p_retailprice > any (select p_retailprice from part where p_size = 50) and p_size = some (select n_nationkey from nation)",
        "select p_partkey from part where p_retailprice > (select min(p_retailprice) from part where p_size = 50) and p_size in (select n_nationkey from nation)"),
    "filter_all": ("select p_partkey from part where p_retailprice >= all (select p_retailprice from part where p_size = 7)", "select p_partkey from part where p_retailprice >= (select max(p_retailprice) from part where p_size = 7)"),
    "filter_scalar_subquery": "select o_orderkey from orders where o_totalprice > (select 1.5 * avg(o_totalprice) from orders)",
    "join_inner": "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 150000",
    "join_left": "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 300000",
    "join_right": "select c_custkey, o_orderkey from orders right join customer on c_custkey = o_custkey and o_orderstatus = 'P'",
    "join_full": "select a.n_name as left_name, b.n_name as right_name from (select * from nation where n_nationkey < 15) a full join (select * from nation where n_nationkey > 10) b on a.n_nationkey = b.n_nationkey",
    "join_semi": ("select s_suppkey from supplier left semi join lineitem on s_suppkey = l_suppkey and l_quantity > 49", "select s_suppkey from supplier semi join lineitem on s_suppkey = l_suppkey and l_quantity > 49"),
    "join_anti": ("select c_custkey from customer left anti join orders on c_custkey = o_custkey", "select c_custkey from customer anti join orders on c_custkey = o_custkey"),
    "join_not_in": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)",
    "join_cross": "select r_name, n_name from region cross join nation where n_nationkey < 3",
    "join_theta": "select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey",
    "join_self": "select a.s_suppkey as s1, b.s_suppkey as s2 from supplier a, supplier b where a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey",
    "join_natural": "select r_name, n_name from (select r_regionkey as k, r_name from region) natural join (select n_regionkey as k, n_name from nation)",
    "join_using": "select k, r_name, n_name from (select r_regionkey as k, r_name from region) a join (select n_regionkey as k, n_name from nation) b using (k)",
    "join_lateral": "select r_regionkey, n from region, lateral (select count(*) as n from nation where n_regionkey = r_regionkey) t",
    "agg_group": "select p_brand, p_type, count(*) as n, min(p_retailprice) as lo, max(p_retailprice) as hi, sum(p_size) as size from part group by p_brand, p_type",
    "agg_expression_key": "select extract(year from o_orderdate) as y, o_totalprice > 100000 as big, count(*) as n from orders group by extract(year from o_orderdate), o_totalprice > 100000",
    "agg_having": "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12 and min(o_totalprice) < 50000",
    "agg_distinct": "select count(distinct o_custkey) as custs, count(distinct o_orderstatus) as states, count(*) as n from orders",
    "agg_scalar": "select round(sum(l_extendedprice), 2) as s, round(avg(l_discount), 6) as a, count(*) as n from lineitem",
    "agg_stats": "select p_type, round(stddev_samp(p_retailprice), 4) as sd, round(stddev_pop(p_size), 6) as sp, round(var_samp(p_size), 6) as v, round(var_pop(p_size), 6) as vp, round(corr(p_size, p_retailprice), 6) as c, round(covar_pop(p_size, p_retailprice), 3) as cp, round(covar_samp(p_size, p_retailprice), 3) as cs from part group by p_type",
    "agg_regression": "select p_type, round(regr_slope(p_retailprice, p_size), 6) as slope, round(regr_intercept(p_retailprice, p_size), 4) as icept, round(regr_r2(p_retailprice, p_size), 6) as r2, regr_count(p_retailprice, p_size) as n, round(regr_avgx(p_retailprice, p_size), 6) as ax, round(regr_avgy(p_retailprice, p_size), 4) as ay from part group by p_type",
    "agg_bool_bit": "select n_regionkey, bool_and(n_nationkey > 3) as ba, bool_or(n_nationkey > 20) as bo, bit_and(n_nationkey) as bta, bit_or(n_nationkey) as bto, bit_xor(n_nationkey) as bx from nation group by n_regionkey",
    "agg_every": ("select n_regionkey, every(n_nationkey < 24) as e from nation group by n_regionkey", "select n_regionkey, bool_and(n_nationkey < 24) as e from nation group by n_regionkey"),
    "agg_collect": ("select n_regionkey, concat_ws(',', sort_array(array_agg(n_name))) as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey"),
    "agg_string": ("select n_regionkey, string_agg(n_name, ';') within group (order by n_name) as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ';' order by n_name) as names from nation group by n_regionkey"),
    "agg_percentile": ("select p_type, percentile_cont(0.5) within group (order by p_retailprice) as med, percentile_disc(0.25) within group (order by p_size) as q1 from part group by p_type",
        "select p_type, quantile_cont(p_retailprice, 0.5) as med, quantile_disc(p_size, 0.25)::double as q1 from part group by p_type"),
    "agg_filter": "select o_orderstatus, count(*) filter (where o_totalprice > 100000) as big, count(*) as n from orders group by o_orderstatus",
    "agg_rollup": "select p_brand, p_type, count(*) as n, grouping(p_type) as g from part group by rollup (p_brand, p_type)",
    "agg_cube": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)",
    "agg_gsets": "select o_orderstatus, o_orderpriority, sum(o_custkey) as s from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())",
    "agg_nested": "select avg_n, count(*) as n from (select n_regionkey, round(avg(n_nationkey), 3) as avg_n from nation group by n_regionkey) as t group by avg_n",
    "agg_ratio": "select o_orderstatus, round(100 * sum(case when o_totalprice > 150000 then o_totalprice else 0 end) / sum(o_totalprice), 6) as share from orders group by o_orderstatus",
    "distinct_rows": "select distinct o_orderstatus, o_orderpriority from orders",
    "distinct_on": ("select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey",
        "select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey"),
    "win_row_number": "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders",
    "win_rank": "select p_partkey, rank() over (partition by p_type order by p_size) as r, dense_rank() over (partition by p_type order by p_size) as d, round(percent_rank() over (partition by p_type order by p_size), 8) as p, round(cume_dist() over (partition by p_type order by p_size), 8) as c from part",
    "win_lag_lead": "select o_orderkey, lag(o_orderkey, 1) over (partition by o_custkey order by o_orderdate, o_orderkey) as before, lead(o_orderkey, 2, -1) over (partition by o_custkey order by o_orderdate, o_orderkey) as after from orders",
    "win_first_last": "select o_orderkey, first_value(o_orderkey) over w as f, last_value(o_orderkey) over w as l, nth_value(o_orderkey, 2) over w as n2 from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following)",
    "win_rows_frame": "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as moving from orders",
    "win_range_frame": "select p_partkey, count(*) over (partition by p_type order by p_size range between 3 preceding and 2 following) as n, sum(p_size) over (partition by p_type order by p_size range between unbounded preceding and current row) as s from part",
    "win_ntile": "select c_custkey, ntile(4) over (partition by c_mktsegment order by c_acctbal, c_custkey) as quartile from customer",
    "sort_nulls": ("select event_id, v from (select event_id, case when event_type = 'click' then null else event_id % 7 end as v from events) t order by v desc, event_id limit 50",
        "select event_id, v from (select event_id, case when event_type = 'click' then null else event_id % 7 end as v from events) t order by v desc nulls first, event_id limit 50"),
    "sort_nulls_asc": ("select event_id, v from (select event_id, case when event_type = 'click' then null else event_id % 7 end as v from events) t order by v, event_id limit 50",
        "select event_id, v from (select event_id, case when event_type = 'click' then null else event_id % 7 end as v from events) t order by v nulls last, event_id limit 50"),
    "limit_offset": "select o_orderkey from orders order by o_orderkey limit 10 offset 20",
    "limit_null": ("select n_nationkey from nation order by n_nationkey limit null", "select n_nationkey from nation"),
    "limit_all": ("select n_nationkey from nation order by n_nationkey limit all offset 3", "select n_nationkey from nation order by n_nationkey offset 3"),
    "topk": "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 25",
    "union_all": "select n_nationkey as k from nation union all select r_regionkey from region",
    "union": "select n_regionkey as k from nation union select r_regionkey from region",
    "intersect": "select o_custkey as k from orders intersect select c_custkey from customer where c_acctbal < 0",
    "except": "select c_custkey as k from customer except select o_custkey from orders",
    "intersect_all": "select n_regionkey as k from nation intersect all select k from (values (1), (1), (2), (9)) t(k)",
    "except_all": "select n_regionkey as k from nation except all select r_regionkey from region",
    "fn_string": "select n_nationkey, upper(n_name) || '-' || lower(n_name) as a, substring(n_name from 1 for 3) as b, length(n_name) as c, replace(n_name, 'NATION', 'n') as d, trim('  x ') as e, lpad(cast(n_nationkey as varchar(3)), 4, '0') as f, strpos(n_name, '_') as g, reverse(n_name) as h from nation",
    "fn_date": "select o_orderkey, extract(year from o_orderdate) as y, extract(month from o_orderdate) as m, date_part('day', o_orderdate) as d, extract(quarter from o_orderdate) as q, date_trunc('month', o_orderdate) as t, o_orderdate + interval '1' month as later from orders",
    "fn_math": ("select p_partkey, abs(10 - p_size) as a, ceil(p_retailprice) as b, floor(p_retailprice) as c, round(sqrt(p_size), 6) as d, p_size ^ 2 as e, mod(p_size, 7) as f, sign(p_size - 25) as g, round(ln(p_size), 6) as h, round(exp(p_size / 50.0), 6) as i from part",
        "select p_partkey, abs(10 - p_size) as a, ceil(p_retailprice)::bigint as b, floor(p_retailprice)::bigint as c, round(sqrt(p_size), 6) as d, power(p_size, 2) as e, mod(p_size, 7) as f, sign(p_size - 25)::double as g, round(ln(p_size), 6) as h, round(exp(p_size / 50.0), 6) as i from part"),
    "fn_bitwise": ("select n_nationkey & 6 as a, n_nationkey | 8 as b, n_nationkey # 5 as c from nation", "select n_nationkey & 6 as a, n_nationkey | 8 as b, xor(n_nationkey, 5)::bigint as c from nation"),
    "fn_json": ("select event_id, props ->> 'k' as k, props::json #>> '{k}' as p, props -> 'k' as j from events where (props ->> 'k')::int > 50",
        "select event_id, props->>'$.k' as k, props->>'$.k' as p, cast(props->'$.k' as varchar) as j from events where (props->>'$.k')::int > 50"),
    "fn_json_group": ("select props ->> 'k' as k, count(value) as n from events group by props ->> 'k'", "select props->>'$.k' as k, count(value) as n from events group by 1"),
    "fn_case": "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as a, case p_type when 'PROMO' then 1 else 0 end as b, coalesce(null, p_brand) as c, nullif(p_size, 10) as d, greatest(p_size, 25) as e, least(p_size, 25) as f from part",
    "fn_cast": "select p_partkey, cast(p_retailprice as int) as a, p_size::varchar(10) as b, '12'::int + p_size as c, cast('1999-01-02' as date) as d from part",
    "fn_width_bucket": ("select width_bucket(p_retailprice, 900, 2000, 10) as b, count(*) as n from part group by width_bucket(p_retailprice, 900, 2000, 10)",
        "select case when p_retailprice < 900 then 0 when p_retailprice >= 2000 then 11 else cast(floor((p_retailprice - 900) / 110) as bigint) + 1 end as b, count(*) as n from part group by 1"),
    "fn_integer_division": ("select n_nationkey div 4 as q, mod(n_nationkey, 4) as r from nation", "select n_nationkey // 4 as q, mod(n_nationkey, 4) as r from nation"),
    "fn_split": ("select doc_id, size(split(text, ' ')) as n from documents", "select doc_id, len(string_split(text, ' ')) as n from documents"),
    "fn_division": ("select n_nationkey, n_nationkey / 4 as q, (n_nationkey + 7) / (n_regionkey + 1) / 2 as r, (0 - n_nationkey) / 4 as m, cast(n_nationkey / 4.0 as double precision) as f, cast(n_nationkey as double precision) / 4 as g from nation",
        "select n_nationkey, n_nationkey // 4 as q, (n_nationkey + 7) // (n_regionkey + 1) // 2 as r, -(n_nationkey // 4) as m, cast(n_nationkey / 4.0 as double) as f, cast(n_nationkey as double) / 4 as g from nation"),
    "fn_division_group": ("select p_size / 10 as tens, count(*) as n, sum(p_size) / count(*) as mean from part group by p_size / 10", "select p_size // 10 as tens, count(*) as n, cast(sum(p_size) // count(*) as bigint) as mean from part group by 1"),
    "fn_age": ("select o_orderkey, extract(year from age(cast('2002-03-01' as timestamp), o_orderdate)) as y, extract(month from age(cast('2002-03-01' as timestamp), o_orderdate)) as m, extract(day from age(cast('2002-03-01' as timestamp), o_orderdate)) as d from orders",
        "select o_orderkey, extract(year from age(timestamp '2002-03-01', o_orderdate)) as y, extract(month from age(timestamp '2002-03-01', o_orderdate)) as m, extract(day from age(timestamp '2002-03-01', o_orderdate)) as d from orders"),
    "fn_to_char": ("select event_id, to_char(ts, 'YYYY-MM-DD HH24:MI:SS') as t, to_char(ts, 'DD/MM/YY') as d from events", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as t, strftime(ts, '%d/%m/%y') as d from events"),
    "fn_similar": ("select p_partkey from part where p_type similar to '(SMALL|LARGE)%' and p_name similar to '%[13]_'", "select p_partkey from part where regexp_full_match(p_type, '(SMALL|LARGE).*') and regexp_full_match(p_name, '.*[13].')"),
    "filter_tsquery": ("select doc_id from documents where to_tsvector('english', text) @@ to_tsquery('english', 'the & !(of | and) | with')",
        "select doc_id from (select doc_id, regexp_split_to_array(lower(text), '[^a-z0-9]+') as w from documents) where list_contains(w, 'the') and not (list_contains(w, 'of') or list_contains(w, 'and')) or list_contains(w, 'with')"),
    "agg_json": ("select n_regionkey, json_agg(n_name order by n_name desc) as names from nation group by n_regionkey", "select n_regionkey, cast(to_json(list(n_name order by n_name desc)) as varchar) as names from nation group by n_regionkey"),
    "agg_ordered": ("select o_custkey, string_agg(cast(o_orderkey as varchar(20)), ',' order by o_totalprice desc, o_orderkey) as keys, try_element_at(array_agg(o_orderkey order by o_orderdate, o_orderkey) filter (where o_orderstatus <> 'P'), 1) as first from orders group by o_custkey",
        "select o_custkey, string_agg(cast(o_orderkey as varchar), ',' order by o_totalprice desc, o_orderkey) as keys, list(o_orderkey order by o_orderdate, o_orderkey) filter (where o_orderstatus <> 'P')[1] as first from orders group by o_custkey"),
    "agg_xml": ("select n_regionkey, xmlagg('<n>' || n_name || '</n>' order by n_name) as doc from nation group by n_regionkey", "select n_regionkey, string_agg('<n>' || n_name || '</n>', '' order by n_name) as doc from nation group by n_regionkey"),
    "pivot": ("select * from (select o_orderstatus, o_orderpriority, 1 as one from orders) pivot (sum(one) as n for o_orderstatus in ('F' as f, 'O' as o, 'P' as p))",
        "select o_orderpriority, sum(case when o_orderstatus = 'F' then 1 end) as f, sum(case when o_orderstatus = 'O' then 1 end) as o, sum(case when o_orderstatus = 'P' then 1 end) as p from orders group by 1"),
    "cte_recursive": "with recursive t(n) as (select 1 union all select n + 1 from t where n < 20) select n from t",
    "subquery_from": "select k, n * 2 as n2 from (select o_custkey as k, count(*) as n from orders group by o_custkey) as q where n > 5",
    "subquery_correlated": "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n from customer",
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark)
    e.register_folder(sf_dir, TABLES)
    return e


def _relational(sql: str):
    return lambda spark, sf_dir: engine(spark, sf_dir).query(f"bdrel({sql})")


def _asked(text: str):
    return lambda spark, sf_dir: engine(spark, sf_dir).query(text)


# arrays

_PART = "bdcast(bdrel(select p_partkey % 40 as i, p_size as j, max(p_retailprice) as v, count(*) as n from part group by p_partkey % 40, p_size), arr_part, '<v:double,n:int64>[i=0:39,40,0,j=1:50,50,0]', array)"
_NATION = "bdcast(bdrel(select n_regionkey, n_nationkey, n_name from nation), arr_nation, '<n_name:string>[n_regionkey=0:*,100,0,n_nationkey=0:*,100,0]', array)"
_REGION = "bdcast(bdrel(select r_regionkey, r_name from region), arr_region, '<r_name:string>[r_regionkey=0:*,100,0]', array)"
_A = "select p_partkey % 40 as i, p_size as j, max(p_retailprice) as v, count(*) as n from part group by 1, 2"

ASKED: dict[str, tuple[str, str | None]] = {
    "arr_scan": (f"bdarray(scan({_PART}))", f"select i, j, v, n from ({_A})"),
    "arr_filter": (f"bdarray(filter({_PART}, v > 1200 and i < 20))", f"select * from ({_A}) where v > 1200 and i < 20"),
    "arr_project": (f"bdarray(project({_PART}, v))", f"select i, j, v from ({_A})"),
    "arr_apply": (f"bdarray(apply({_PART}, w, v * 2, k, iif(j > 25, 1, 0)))", f"select i, j, v, n, v * 2 as w, case when j > 25 then 1 else 0 end as k from ({_A})"),
    "arr_redimension": (f"bdarray(redimension(apply({_PART}, q, i * 100 + j), <v:double,n:int64>[q=0:*,1000,0]))", f"select i * 100 + j as q, v, n from ({_A})"),
    "arr_redimension_max": (f"bdarray(redimension({_PART}, <v:double>[i=0:*,1000,0], 'max'))", f"select i, max(v) as v from ({_A}) group by i"),
    "arr_aggregate": (f"bdarray(aggregate({_PART}, sum(n) as s, count(*), max(n), i))", f"select i, sum(n) as s, count(*) as count, max(n) as n_max from ({_A}) group by i"),
    "arr_aggregate_scalar": (f"bdarray(aggregate({_PART}, count(v), min(v) as lo, median(v) as m))", f"select 0 as i, count(v) as v_count, min(v) as lo, median(v) as m from ({_A})"),
    "arr_aggregate_stats": (f"bdrel(select j, round(sd, 6) as sd, round(a, 6) as a, d, p from bdcast(bdarray(aggregate({_PART}, stdev(v) as sd, avg(v) as a, mad(n) as d, prod(n) as p, j)), t, '(j bigint, sd double precision, a double precision, d double precision, p double precision)', relational))",
        f"select j, round(stddev_samp(v), 6) as sd, round(avg(v), 6) as a, mad(n) as d, product(n) as p from ({_A}) group by j"),
    "arr_cross_join": (f"bdarray(cross_join({_NATION} as a, {_REGION} as b, a.n_regionkey, b.r_regionkey))", "select n_regionkey, n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey"),
    "arr_product": (f"bdarray(cross_join({_NATION} as a, {_REGION} as b))", "select n_regionkey, n_nationkey, n_name, r_regionkey, r_name from nation cross join region"),
    "arr_window_1d": (f"bdarray(window({_PART}, 0, 0, 3, 2, sum(n) as s, count(v) as c))", f"select i, j, sum(n) over w as s, count(v) over w as c from ({_A}) window w as (partition by i order by j range between 3 preceding and 2 following)"),
    "arr_window_2d": (f"bdarray(window({_PART}, 1, 1, 0, 2, sum(n) as s, max(v) as m))", f"select a.i, a.j, sum(b.n) as s, max(b.v) as m from ({_A}) a join ({_A}) b on b.i between a.i - 1 and a.i + 1 and b.j between a.j and a.j + 2 group by 1, 2"),
    "arr_sort": (f"bdarray(sort(project({_PART}, v), v))", f"select row_number() over (order by v, i, j) - 1 as n, v from ({_A})"),
    "arr_between": (f"bdarray(between({_PART}, 5, 10, 15, 30))", f"select * from ({_A}) where i between 5 and 15 and j between 10 and 30"),
    "arr_subarray": (f"bdarray(subarray({_PART}, 5, 10, 15, 30))", f"select i - 5 as i, j - 10 as j, v, n from ({_A}) where i between 5 and 15 and j between 10 and 30"),
    "arr_slice": (f"bdarray(slice({_PART}, i, 7))", f"select j, v, n from ({_A}) where i = 7"),
    "arr_regrid": (f"bdarray(regrid({_PART}, 10, 5, sum(n) as s, max(v) as m))", f"select i // 10 as i, (j - 1) // 5 + 1 as j, sum(n) as s, max(v) as m from ({_A}) group by 1, 2"),
    "arr_merge": (f"bdarray(merge(filter({_PART}, i < 5), {_PART.replace('arr_part', 'arr_other').replace('max(p_retailprice)', 'min(p_retailprice)')}))",
        f"select i, j, case when i < 5 then v else lo end as v, n from (select p_partkey % 40 as i, p_size as j, max(p_retailprice) as v, min(p_retailprice) as lo, count(*) as n from part group by 1, 2)"),
    "arr_distinct": (f"bdarray(distinct(project({_PART}, n)))", f"select row_number() over (order by n) - 1 as i, n from (select distinct n from ({_A}))"),
    "arr_transpose": (f"bdarray(transpose({_PART}))", f"select j, i, v, n from ({_A})"),
    "arr_unpack": (f"bdarray(unpack({_PART}, k))", f"select row_number() over (order by i, j) - 1 as k, i, j, v, n from ({_A})"),
    "arr_cumulate": (f"bdarray(cumulate({_PART}, sum(n) as s, max(n) as m, count(*) as c, j))", f"select i, j, sum(n) over w as s, max(n) over w as m, count(*) over w as c from ({_A}) window w as (partition by i order by j)"),
    "arr_cumulate_1d": (f"bdarray(cumulate(project(unpack({_PART}, k), n), sum(n) as s))", f"select k, sum(n) over (order by k) as s from (select row_number() over (order by i, j) - 1 as k, n from ({_A}))"),
    "arr_variable_window": (f"bdarray(variable_window({_PART}, j, 2, 1, sum(n) as s))", f"select i, j, sum(n) over (partition by i order by j rows between 2 preceding and 1 following) as s from ({_A})"),
    "arr_variable_window_1d": (f"bdarray(variable_window(project(unpack({_PART}, k), n), k, 1, 3, max(n) as m))", f"select k, max(n) over (order by k rows between 1 preceding and 3 following) as m from (select row_number() over (order by i, j) - 1 as k, n from ({_A}))"),
    "arr_rank": (f"bdarray(rank({_PART}, v, i))", f"select i, j, v, rank() over (partition by i order by v) as v_rank from ({_A})"),
    "arr_rank_all": (f"bdarray(rank({_PART}, n))", f"select i, j, n, rank() over (order by n) as n_rank from ({_A})"),
    "arr_substitute": (f"bdarray(substitute(apply({_PART}, q, iif(n > 2, null, n)), build(<w:int64>[x=0:0,1,0], -7), q))", f"select i, j, v, n, case when n > 2 then -7 else n end as q from ({_A})"),
    "arr_thin": (f"bdarray(thin({_PART}, 4, 3, 1, 2))", f"select (i - 4) // 3 as i, (j - 1) // 2 as j, v, n from ({_A}) where i >= 4 and (i - 4) % 3 = 0 and (j - 1) % 2 = 0"),
    "arr_xgrid": (f"bdarray(xgrid(aggregate({_PART}, sum(n) as s, i), 3))", f"select i * 3 + k as i, s from (select i, sum(n) as s from ({_A}) group by i) cross join (select unnest([0, 1, 2]) as k)"),
    "arr_reshape": (f"bdarray(reshape({_PART}, <v:double,n:int64>[a=0:9,10,0,b=0:199,200,0]))", f"select (i * 50 + j - 1) // 200 as a, (i * 50 + j - 1) % 200 as b, v, n from ({_A})"),
    "arr_build": ("bdarray(build(<w:int64>[x=0:9,10,0,y=2:4,3,0], x * 10 + y))", "select x, y, x * 10 + y as w from (select unnest(range(10)) as x) cross join (select unnest([2, 3, 4]) as y)"),
    "arr_uniq": (f"bdarray(uniq(project(unpack({_PART}, k), n)))", f"select row_number() over (order by k) - 1 as i, n from (select k, n, lag(n) over (order by k) as p from (select row_number() over (order by i, j) as k, n from ({_A}))) where p is null or p <> n"),
    "arr_quantile": (f"bdarray(aggregate({_PART}, quantile(v, 0.25) as q, approxdc(n) as d, i))", f"select i, quantile_cont(v, 0.25) as q, count(distinct n) as d from ({_A}) group by i"),
    "arr_aggregate_ends": (f"bdrel(select i, f, l, round(x, 4) as x from bdcast(bdarray(aggregate({_PART}, first_value(v) as f, last_value(v) as l, var(v) as x, i)), t, '(i bigint, f double precision, l double precision, x double precision)', relational))",
        f"select i, arg_min(v, j) as f, arg_max(v, j) as l, round(var_samp(v), 4) as x from ({_A}) group by i"),
    "cast_array_rel_flat": (f"bdrel(select v, n from bdcast(bdarray(filter({_PART}, j > 10)), a, '(v double precision, n bigint)', relational))", f"select v, n from ({_A}) where j > 10"),
    "cast_rel_array": ("bdarray(scan(bdcast(bdrel(select o_orderkey, o_totalprice, o_orderdate from orders), o, '<o_totalprice:double,o_orderdate:datetime>[o_orderkey=0:*,1000,0]', array)))",
        "select o_orderkey, o_totalprice, date_trunc('second', o_orderdate) as o_orderdate from orders"),
    "cast_array_rel": (f"bdrel(select i, count(*) as n, max(v) as m from bdcast(bdarray(filter({_PART}, j > 10)), a, '(i bigint, j bigint, v double precision, n bigint)', relational) group by i)", f"select i, count(*) as n, max(v) as m from ({_A}) where j > 10 group by i"),
    "cast_rel_kv": ("bdtext({'op': 'scan', 'table': 'kv', 'range': {'start': ['3', '', ''], 'end': ['7', '', '']}})".replace("'kv'", "'kv'"), None),
    "nested_three_level": (f"bdrel(select t.i, t.w, r.r_name from bdcast(bdarray(aggregate(apply({_PART}, w, v + n), max(w) as w, i)), t, '(i bigint, w double precision)', relational) t join region r on t.i = r.r_regionkey where t.w > 0)",
        f"select i, max(v + n) as w, r_name from ({_A}) join region on i = r_regionkey group by i, r_name"),
    "catalog_objects": ("bdcatalog(select count(*) as n from catalog.objects where name <> 'x')", "select 14 as n"),
    "catalog_islands": ("bdcatalog(islands (scope_name))", "select unnest(['RELATIONAL', 'ARRAY', 'TEXT', 'API', 'STREAM']) as scope_name"),
}
del ASKED["cast_rel_kv"]

_KV = "SELECT CAST(n_nationkey AS VARCHAR) AS row, c AS cf, q AS cq, v AS value FROM (SELECT n_nationkey, '1' AS c, 'n_nationkey' AS q, CAST(n_nationkey AS VARCHAR) AS v FROM nation UNION ALL SELECT n_nationkey, '2', 'n_name', n_name FROM nation UNION ALL SELECT n_nationkey, '3', 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation)"
_WORDS = "SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2"


def _kv_engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine(spark, sf_dir)
    e.register("kv", kv.to_kv(e.catalog.relation("nation"), ["n_nationkey"]))
    return e


def kv_full_scan(spark, sf_dir):
    return _kv_engine(spark, sf_dir).query("bdtext({ 'op':'scan', 'table':'kv' })")


def kv_range_scan(spark, sf_dir):
    return _kv_engine(spark, sf_dir).query("bdtext({ 'op':'scan', 'table':'kv', 'range':{ 'start':['12','',''], 'end':['2','2',''] } })")


def kv_aggregate(spark, sf_dir):
    return _kv_engine(spark, sf_dir).query("bdtext({'op':'aggregate','table':'kv','function':'count','by':['cq']})")


def cast_kv_rel(spark, sf_dir):
    return _kv_engine(spark, sf_dir).query("bdrel(select n_regionkey, count(*) as n, max(n_name) as m from bdcast(bdtext({'op':'scan','table':'kv'}), t, '(n_nationkey int, n_name varchar(25), n_regionkey int)', relational) group by n_regionkey)")


def cast_kv_range_rel(spark, sf_dir):
    return _kv_engine(spark, sf_dir).query("bdrel(select n_nationkey, n_name, n_regionkey from bdcast(bdtext({'op':'scan','table':'kv','range':{'start':['1','',''],'end':['2','','']}}), t, '(n_nationkey int, n_name varchar(25), n_regionkey int)', relational))")


def cast_rel_kv(spark, sf_dir):
    return cast(engine(spark, sf_dir).catalog.relation("nation"), "relational", "text", "n_nationkey")


def _terms(name):
    return lambda spark, sf_dir: kv.terms(engine(spark, sf_dir).catalog.relation("documents"), "doc_id", "text")[name]


def kv_move(spark, sf_dir):
    """What a table shows while it moves: half of the rows are new, a few of the old were updated or deleted."""
    n = engine(spark, sf_dir).catalog.relation("nation")
    return kv.moved(n.where("n_nationkey < 5"), n.where("n_nationkey >= 5"), n.where("n_nationkey = 7"), n.where("n_nationkey > 20"))


def api_flatten(spark, sf_dir):
    """Responses that a table holds, flattened by executors."""
    e = engine(spark, sf_dir).catalog.relation("events")
    held = e.select("event_id", F.concat(F.lit('{"data":['), "props", F.lit("]}")).alias("response"))
    return api.flatten_column(held, "response", "k int", "data")


def api_call(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.apis.add("weather", "now", fixture='{"result": {"list": [{"t": 1.5, "city": "a"}, {"t": null, "city": "b", "n": 3}]}}')
    return e.query("bdapi({'name': 'weather', 'endpoint': 'now', 'query': {'q': 'x'}, 'result-key': 'result.list'})")


def _readings(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.apis.add("meter", "all", fixture='{"list": [{"pos": 0, "v": 1.5, "who": "a"}, {"pos": 2, "v": 2.5, "who": "b"}, {"pos": 5, "v": null, "who": "c"}]}')
    return e


_METER = "bdapi({'name': 'meter', 'endpoint': 'all', 'query': {}, 'result-key': 'list'})"
_METERED = "(VALUES (0, 1.5::DOUBLE, 'a'), (2, 2.5, 'b'), (5, NULL, 'c')) m(pos, v, who)"


def cast_api_array(spark, sf_dir):
    return _readings(spark, sf_dir).query(f"bdarray(filter(bdcast({_METER}, m, '<v:double,who:string>[pos=0:*,100,0]', array), pos > 0))")


def cast_api_kv(spark, sf_dir):
    e = _readings(spark, sf_dir)
    return cast(e.query(_METER), "api", "text", "pos")


def union_islands(spark, sf_dir):
    """Rows of an array and of a key-value table in one relational union."""
    return _kv_engine(spark, sf_dir).query(f"""bdrel(select k, 'array' as src from bdcast(bdarray(aggregate({_PART}, max(n) as m, i)), a, '(k bigint, m bigint)', relational) union all
        select n_nationkey, 'kv' from bdcast(bdtext({{'op':'scan','table':'kv'}}), t, '(n_nationkey int, n_name varchar(25), n_regionkey int)', relational))""")


def table_made(spark, sf_dir):
    """SELECT INTO writes a table that later queries name, and an array that is stored is one."""
    e = engine(spark, sf_dir)
    e.query("bdrel(select o_custkey, count(*) as n into busy from orders group by o_custkey having count(*) > 11)")
    e.query(f"bdarray(store(aggregate({_PART}, sum(n) as s, i), sums))")
    return e.query("bdrel(select b.o_custkey, b.n, t.s from busy b join bdcast(bdarray(scan(sums)), t, '(i bigint, s bigint)', relational) on b.n = t.i)")


def _binary(source: str, target: str):
    """A table through files of two binary formats and back."""

    def run(spark, sf_dir):
        df = engine(spark, sf_dir).query("bdrel(select event_id, cast(event_id % 2 = 0 as boolean) as even, case when event_type = 'click' then null else value end as v, cast(user_id as int) as u, ts, cast(ts as date) as day, nullif(event_type, 'view') as kind from events)")
        return binary.from_binary(binary.transformed(binary.to_binary(df, source), df.schema, source, target), df.schema, target)

    return run


_EVENTS = "select event_id, event_id % 2 = 0 as even, case when event_type = 'click' then null else value end as v, cast(user_id as int) as u, ts, cast(ts as date) as day, nullif(event_type, 'view') as kind from events"


def jdbc_round_trip(spark, sf_dir):
    """A table through another SQL engine, the embedded one that Spark ships with, read back in parts; its files are in the driver's temp folder."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    atexit.register(shutil.rmtree, folder := tempfile.mkdtemp(prefix="spanisle-"), ignore_errors=True)
    url = f"jdbc:derby:directory:{folder}/moved;create=true"
    df = engine(spark, sf_dir).query("bdrel(select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as timestamp) as o_orderdate from orders)")
    files.write_jdbc(df, url, "moved", "overwrite")
    back = files.read_jdbc(spark, url, "moved", "O_ORDERKEY", 0, 20_000, 3)
    return back.toDF(*(c.lower() for c in back.columns))


def _counts():
    return {"n": F.count("*"), "total": F.round(F.sum("value"), 2)}


def stream_tumbling(spark, sf_dir):
    return windows.tumbling(engine(spark, sf_dir).catalog.relation("events"), "ts", "1 hour", _counts(), ["event_type"], "10 minutes")


def stream_sliding(spark, sf_dir):
    return windows.sliding(engine(spark, sf_dir).catalog.relation("events"), "ts", "2 hours", "1 hour", _counts(), ["event_type"], "10 minutes")


def stream_session(spark, sf_dir):
    return windows.session(engine(spark, sf_dir).catalog.relation("events"), "ts", "30 minutes", {"n": F.count("*")}, ["user_id"], "10 minutes")


def stream_procedure(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.register_procedure("spenders", ["int", "string"], "select user_id, count(*) as n from events where event_type = :p2 group by user_id having count(*) >= :p1")
    return e.query("bdstream(spenders, 2, 'purchase')")


def stream_drain(spark, sf_dir):
    """A table as a stream, drained to another table, which is read."""
    made = written(engine(spark, sf_dir).query("bdrel(select event_id, user_id, value from events where event_type = 'purchase')"))
    out = f"{shared_dir(spark)}/spanisle-tables/{uuid.uuid4().hex}"
    stream = windows.read(spark, made.inputFiles()[0].rsplit("/", 1)[0], made.schema)
    windows.drain(stream, windows.to_parquet(f"{out}/rows"), f"{out}/state", None).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_id", "user_id", "value")


def alert_delivery(spark, sf_dir):
    """What a client that asks is told of an alert on counts by type."""
    e = engine(spark, sf_dir)
    client = e.alerts.register("counts")
    e.alerts.sink(client.alert)(e.query("bdrel(select event_type, count(*) as n from events group by event_type having count(*) > 10)"), 0)
    told = json.loads(e.alerts.status(client.id))["data"]
    return spark.createDataFrame([(r["event_type"], r["n"]) for r in told], "event_type string, n long")


def telemetry_distance(spark, sf_dir):
    """Distances between the signatures of three queries."""
    e = engine(spark, sf_dir)
    texts = [f"bdrel({sql})" for sql in ("select count(*) from orders where o_custkey = 1", "select count(*) from orders where o_custkey = 2", REL["join_inner"])]
    s = [telemetry.signature(t, "relational", e.query(t), TABLES) for t in texts]
    return spark.createDataFrame([(i, j, float(s[i].distance(s[j]))) for i in range(3) for j in range(3)], "a int, b int, distance double")


_WINDOW = "SELECT {b} AS window_start, {b} + INTERVAL {s} AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM {t} GROUP BY 1, 2, 3"
FUNCTIONS = {
    "kv_full_scan": (kv_full_scan, _KV),
    "kv_range_scan": (kv_range_scan, f"SELECT * FROM ({_KV}) WHERE row >= '12' AND (row < '2' OR (row = '2' AND cf < '2'))"),
    "kv_aggregate": (kv_aggregate, f"SELECT cq, count(*) AS value FROM ({_KV}) GROUP BY 1"),
    "cast_rel_kv": (cast_rel_kv, _KV),
    "cast_kv_rel": (cast_kv_rel, "select n_regionkey, count(*) as n, max(n_name) as m from nation group by 1"),
    "cast_kv_range_rel": (cast_kv_range_rel, "select n_nationkey, n_name, n_regionkey from nation where cast(n_nationkey as varchar) >= '1' and cast(n_nationkey as varchar) < '2'"),
    "cast_api_array": (cast_api_array, f"SELECT * FROM {_METERED} WHERE pos > 0"),
    "cast_api_kv": (cast_api_kv, f"SELECT CAST(pos AS VARCHAR) AS row, '1' AS cf, 'pos' AS cq, CAST(pos AS VARCHAR) AS value FROM {_METERED} UNION ALL SELECT CAST(pos AS VARCHAR), '2', 'v', CAST(v AS VARCHAR) FROM {_METERED} WHERE v IS NOT NULL UNION ALL SELECT CAST(pos AS VARCHAR), '3', 'who', who FROM {_METERED}"),
    "union_islands": (union_islands, f"select distinct i as k, 'array' as src from ({_A}) union all select n_nationkey, 'kv' from nation"),
    "table_made": (table_made, f"select o_custkey, b.n, s from (select o_custkey, count(*) as n from orders group by 1 having count(*) > 11) b join (select i, sum(n)::bigint as s from ({_A}) group by i) t on b.n = t.i"),
    "jdbc_round_trip": (jdbc_round_trip, "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate from orders"),
    "binary_copy_cells": (_binary("copy", "cells"), _EVENTS),
    "binary_cells_copy": (_binary("cells", "copy"), _EVENTS),
    "d4m_edge": (_terms("edge"), f"SELECT CAST(doc_id AS VARCHAR) AS row, '' AS cf, 'word|' || w AS cq, CAST(n AS VARCHAR) AS value FROM ({_WORDS})"),
    "d4m_transpose": (_terms("transpose"), f"SELECT 'word|' || w AS row, '' AS cf, CAST(doc_id AS VARCHAR) AS cq, CAST(n AS VARCHAR) AS value FROM ({_WORDS})"),
    "d4m_degree": (_terms("degree"), f"SELECT 'word|' || w AS row, '' AS cf, 'degree' AS cq, CAST(count(*) AS VARCHAR) AS value FROM ({_WORDS}) GROUP BY w"),
    "d4m_text": (_terms("text"), "SELECT CAST(doc_id AS VARCHAR) AS row, '' AS cf, 'text' AS cq, text AS value FROM documents WHERE text IS NOT NULL"),
    "atomic_move": (kv_move, "SELECT * FROM nation WHERE n_nationkey <> 7 AND n_nationkey <= 20"),
    "api_flatten": (api_flatten, "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events"),
    "api_call": (api_call, "SELECT * FROM (VALUES (1.5::DOUBLE, 'a', CAST(NULL AS INTEGER)), (NULL, 'b', 3)) t(t, city, n)"),
    "stream_tumbling": (stream_tumbling, _WINDOW.format(b="time_bucket(INTERVAL 1 HOUR, ts)", s="1 HOUR", t="events")),
    "stream_sliding": (stream_sliding, _WINDOW.format(b="b", s="2 HOUR", t="(SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS b FROM events)")),
    "stream_session": (stream_session, """SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n FROM
        (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"""),
    "stream_procedure": (stream_procedure, "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 2"),
    "stream_drain": (stream_drain, "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'"),
    "alert_delivery": (alert_delivery, "SELECT event_type, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 10"),
    # (2 * trees + predicates + literals + 2 * objects) / 6: 0 and 1 differ in their one literal alone; from them to 2 it takes 3 edits of
    # 4 nodes, a predicate and a literal, and one object of two has no partner; from 2 its first object takes the partner of the second
    "telemetry_distance": (telemetry_distance, """SELECT a, b, CAST(d AS DOUBLE) / 6 AS distance FROM (VALUES (0, 0, 0), (0, 1, 1), (0, 2, 4.5), (1, 0, 1), (1, 1, 0), (1, 2, 4.5), (2, 0, 5.5), (2, 1, 5.5), (2, 2, 0)) t(a, b, d)"""),
}


def queries() -> dict:
    out = {n: _relational(q if isinstance(q, str) else q[0]) for n, q in REL.items()}
    out |= {n: _asked(q) for n, (q, _) in ASKED.items()}
    return out | {n: f for n, (f, _) in FUNCTIONS.items()}


def oracle() -> dict[str, str]:
    out = {n: q if isinstance(q, str) else q[1] for n, q in REL.items()}
    return out | {n: o for d in (ASKED, FUNCTIONS) for n, (_, o) in d.items() if o}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query(f"bdrel({REL['tpch_q1']})")
