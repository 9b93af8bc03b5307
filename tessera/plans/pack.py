"""One query per relational operator of the inventory; most run unchanged in the oracle.

Values are ``sql`` for both engines, or ``(spark_sql, oracle_sql)`` where the
dialects differ. An oracle of None marks results that differ by design.
"""

from __future__ import annotations

SQL: dict[str, str | tuple[str, str | None]] = {
    # scans, projections, predicates
    "s12_single_row": "select 1 as one, 'x' as x",
    "s13_filter_project": "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 45 and l_discount < 0.03",
    "p1_expressions": "select o_orderkey, o_orderkey * 2 + 1 as k, concat(o_orderstatus, '-', o_orderpriority) as tag from orders",
    "p2_and_or": "select o_orderkey from orders where (o_orderstatus = 'F' and o_totalprice > 200000) or (o_orderstatus <> 'F' and o_totalprice < 5000)",
    "p3_between": "select p_partkey, p_size from part where p_size between 5 and 9",
    "p4_in_list": "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey not in (1, 2, 3)",
    "p5_like": "select p_partkey, p_name from part where p_type like 'S%' and p_name not like '%7'",
    "p6_case": "select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'low' else 'high' end as band from customer",
    "p7_scalar_subquery": "select o_orderkey from orders where o_totalprice > (select max(o_totalprice) * 0.95 from orders)",
    "p8_correlated_subquery": "select o_orderkey, o_custkey from orders o where o_totalprice = (select max(o_totalprice) from orders i where i.o_custkey = o.o_custkey)",
    "p9_exists": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')",
    "p9_not_exists": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')",
    "p10_in_subquery": "select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity > 48)",
    "p10_not_in_subquery": "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 48)",
    "p11_cte_derived": "with a(k, n) as (select o_custkey, count(*) from orders group by o_custkey) select n, count(*) as customers from (select * from a where n > 1) as t group by n",
    "p12_cast": "select o_orderkey, cast(o_totalprice as decimal(15, 2)) as price, cast(o_orderdate as date) as day, cast(o_custkey as varchar(20)) as cust from orders",
    "p16_unnest": ("select doc_id, explode(split(lang, '')) as letter from documents", "select doc_id, unnest(string_split(lang, '')) as letter from documents"),
    # joins
    "j1_inner": "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey",
    "j2_broadcast": ("select /*+ BROADCAST(nation) */ s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey", "select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey"),
    "j3_sort_merge": ("select /*+ MERGE(orders) */ l_orderkey, l_linenumber, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey", "select l_orderkey, l_linenumber, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey"),
    "j4_theta": "select a.s_suppkey as a_key, b.s_suppkey as b_key from supplier a join supplier b on a.s_acctbal < b.s_acctbal and a.s_nationkey = 3",
    "j5_cross": "select r_name, n_name from region cross join nation",
    "j6_left_with_predicate": "select c_custkey, count(o_orderkey) as urgent from customer left join orders on c_custkey = o_custkey and o_orderpriority = '1-URGENT' group by c_custkey",
    "j7_right": "select n_nationkey, s_suppkey from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 5000",
    "j7_full": "select a.p_partkey as a_key, b.p_partkey as b_key from (select * from part where p_size < 20) a full join (select * from part where p_size > 10) b on a.p_partkey = b.p_partkey",
    "j8_left_semi": ("select c_custkey, c_name from customer left semi join orders on c_custkey = o_custkey", "select c_custkey, c_name from customer semi join orders on c_custkey = o_custkey"),
    "j8_left_anti": ("select c_custkey, c_name from customer left anti join orders on c_custkey = o_custkey and o_orderpriority = '1-URGENT'", "select c_custkey, c_name from customer anti join orders on c_custkey = o_custkey and o_orderpriority = '1-URGENT'"),
    "j9_shifted_self_join": """
        with m as (select cast(extract(year from l_shipdate) as bigint) as y, l_suppkey, cast(sum(l_quantity) as bigint) as q from lineitem group by extract(year from l_shipdate), l_suppkey),
             r as (select *, cast(rank() over (partition by l_suppkey order by y) as bigint) as rk from m)
        select c.l_suppkey, c.y, c.q, p.q as previous, c.q - p.q as change from r c join r p on c.l_suppkey = p.l_suppkey and c.rk = p.rk + 1""",
    "j10_null_safe": ("select a.k, count(*) as pairs, max(c_custkey + s_suppkey) as top from (select nullif(c_nationkey, 3) as k, c_custkey from customer) a join (select nullif(s_nationkey, 3) as k, s_suppkey from supplier) b on a.k <=> b.k group by a.k",
                      "select a.k, count(*) as pairs, max(c_custkey + s_suppkey) as top from (select nullif(c_nationkey, 3) as k, c_custkey from customer) a join (select nullif(s_nationkey, 3) as k, s_suppkey from supplier) b on a.k is not distinct from b.k group by a.k"),
    # aggregations
    "a1_group": "select o_orderstatus, count(*) as n from orders group by o_orderstatus",
    "a2_global": "select count(*) as n, max(l_orderkey) as top, min(l_quantity) as low from lineitem",
    "a3_counts": "select count(*) as n_all, count(nullif(c_nationkey, 3)) as n_some from customer",
    "a4_count_distinct": "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by l_returnflag",
    "a5_distinct": "select distinct c_mktsegment, c_nationkey from customer",
    "a6_sum": "select l_suppkey, cast(sum(l_quantity) as double) as qty, cast(sum(l_linenumber) as bigint) as lines from lineitem group by l_suppkey",
    "a7_avg": "select l_suppkey, round(avg(l_quantity), 6) as avg_qty from lineitem group by l_suppkey",
    "a8_min_max": "select o_custkey, min(o_totalprice) as low, max(o_totalprice) as high, max(o_orderdate) as latest from orders group by o_custkey",
    "a9_approx_distinct": ("select approx_count_distinct(l_partkey) as parts from lineitem", None),
    "a10_array_agg": ("select n_regionkey, sort_array(collect_list(n_name)) as names from nation group by n_regionkey", "select n_regionkey, list_sort(list(n_name)) as names from nation group by n_regionkey"),
    "a11_variance": "select l_returnflag, round(var_samp(l_quantity), 6) as vs, round(var_pop(l_quantity), 6) as vp, round(variance(l_quantity), 6) as v from lineitem group by l_returnflag",
    "a12_stddev": "select l_returnflag, round(stddev(l_quantity), 6) as s, round(stddev_samp(l_quantity), 6) as ss, round(stddev_pop(l_quantity), 6) as sp from lineitem group by l_returnflag",
    "a13_covariance": "select l_returnflag, round(covar_samp(l_quantity, l_linenumber), 6) as cs, round(covar_pop(l_quantity, l_linenumber), 6) as cp from lineitem group by l_returnflag",
    "a14_correlation": "select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as c from lineitem group by l_returnflag",
    "a15_approx_percentile": ("select l_returnflag, percentile_approx(l_quantity, 0.5) as p50 from lineitem group by l_returnflag", None),
    "a15_weighted_percentile": ("select percentile(p_size, 0.5, 1 + p_partkey % 3) as weighted from part", "with e as (select p_size, unnest(range(1 + p_partkey % 3)) as i from part) select median(p_size) as weighted from e"),
    "a16_having": "select l_suppkey, count(*) as n from lineitem group by l_suppkey having count(*) > 600 or min(l_quantity) > 1",
    "a17_agg_arithmetic": "select p_brand, max(p_size) - min(p_size) as spread, cast(sum(p_size) as double) / count(*) as mean_size from part group by p_brand",
    "a18_many_keys": "select l_returnflag, l_linestatus, l_linenumber, l_suppkey, count(*) as n from lineitem group by l_returnflag, l_linestatus, l_linenumber, l_suppkey",
    "a19_two_levels": "select n, count(*) as customers from (select o_custkey, count(*) as n from orders group by o_custkey) as t group by n",
    "a20_from_statistics": "select min(o_orderkey) as low, max(o_orderkey) as high, count(*) as n from orders",
    "a21_rollup": "select n_regionkey, c_mktsegment, count(*) as n from customer join nation on c_nationkey = n_nationkey group by rollup (n_regionkey, c_mktsegment)",
    "a21_cube": "select o_orderstatus, o_orderpriority, count(*) as n, cast(grouping(o_orderstatus) as bigint) as g from orders group by cube (o_orderstatus, o_orderpriority)",
    "a21_grouping_sets": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())",
    "a22_more": ("select l_returnflag, median(l_linenumber) as med, bool_and(l_quantity > 0) as every, bool_or(l_quantity > 49) as some, cast(bit_xor(l_orderkey) as bigint) as bx, cast(bit_and(l_linenumber) as bigint) as ba, cast(bit_or(l_linenumber) as bigint) as bo from lineitem group by l_returnflag"),
    "a22_regression": "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, cast(regr_count(l_extendedprice, l_quantity) as bigint) as n, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by l_returnflag",
    "a22_string_agg": ("select n_regionkey, listagg(n_name, '|') within group (order by n_name) as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, '|' order by n_name) as names from nation group by n_regionkey"),
    # windows
    "n1_rank": "select * from (select l_suppkey, l_orderkey, l_linenumber, cast(rank() over (partition by l_suppkey order by l_quantity desc, l_orderkey) as bigint) as rk from lineitem) as t where rk <= 3",
    "n2_row_number": "select * from (select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as rn from orders) as t where rn <= 2",
    "n3_avg_of_sum": "select y, status, q, round(avg(q) over (partition by status), 6) as mean_q from (select cast(extract(year from o_orderdate) as bigint) as y, o_orderstatus as status, cast(sum(o_custkey) as bigint) as q from orders group by extract(year from o_orderdate), o_orderstatus) as t",
    "n4_default_range_frame": "select event_id, cast(count(*) over (partition by user_id order by ts) as bigint) as upto from events",
    "n5_window_functions": """
        select o_orderkey, cast(dense_rank() over w as bigint) as dr, round(percent_rank() over w, 9) as pr, round(cume_dist() over w, 9) as cd, cast(ntile(4) over w as bigint) as nt,
               lag(o_orderkey) over w as lg, lead(o_orderkey, 2) over w as ld, first_value(o_orderkey) over w as fv, last_value(o_orderkey) over w as lv, nth_value(o_orderkey, 2) over w as nv
        from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
    "n6_rows_frame": "select l_orderkey, l_linenumber, cast(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between 1 preceding and 1 following) as double) as near_qty from lineitem",
    "n6_range_frame": "select p_partkey, cast(count(*) over (partition by p_brand order by p_size range between 2 preceding and current row) as bigint) as similar from part",
    # sorting, limits, sets
    "o1_order_by": "select n_nationkey, n_name from nation order by n_name desc",
    "o4_top_k": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
    "o5_null_order": "select k from (select nullif(c_nationkey % 5, 3) as k, c_custkey from customer) as t order by k asc nulls last, c_custkey",
    "u1_union_all": "select c_nationkey as k from customer union all select s_nationkey from supplier",
    "u2_union": "select c_nationkey as k from customer union select s_nationkey from supplier",
    "u3_intersect": "select l_partkey as k from lineitem where l_quantity > 40 intersect select l_partkey from lineitem where l_quantity < 5",
    "u3_except": "select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 48",
    "u3_intersect_all": "select c_nationkey as k from customer intersect all select s_nationkey from supplier",
    "u3_except_all": "select c_nationkey as k from customer except all select s_nationkey from supplier",
    # functions
    "f_used": "select o_orderkey, abs(o_custkey - 500) as a, cast(extract(year from o_orderdate) as bigint) as y, substring(o_orderpriority from 1 for 3) as s, trim(concat('  ', o_orderstatus, ' ')) as t, upper(o_orderpriority) as u, cast(length(o_orderpriority) as bigint) as n from orders",
    "f_math": "select p_partkey, round(sqrt(p_size), 6) as sq, round(ln(p_size), 6) as l, round(exp(p_size / 50.0), 6) as e, power(p_size, 2) as pw, round(sin(p_size), 6) as si, round(atan2(p_size, 3), 6) as at, cast(ceil(p_retailprice) as bigint) as c, cast(floor(p_retailprice) as bigint) as f, cast(sign(p_size - 25) as bigint) as sg, round(cbrt(p_size), 6) as cb, round(degrees(p_size), 4) as dg, round(radians(p_size), 6) as rd from part",
    "f_math2": "select p_partkey, round(log10(p_size), 6) as l10, round(log2(p_size), 6) as l2, round(sinh(p_size / 50.0), 6) as sh, round(tanh(p_size / 50.0), 6) as th, round(acosh(p_size), 6) as ach, round(cot(p_size), 4) as ct, cast(factorial(p_size % 10) as bigint) as fa, round(pi(), 6) as p from part",
    "f_string": ("select c_custkey, initcap(lower(c_mktsegment)) as i, lpad(c_mktsegment, 12, '*') as lp, rpad(c_mktsegment, 12, '*') as rp, replace(c_name, '0', 'o') as r, reverse(c_name) as rv, split_part(c_name, '#', 1) as sp, translate(c_mktsegment, 'AEI', '123') as tr, ltrim(concat(' ', c_name)) as lt, repeat('ab', c_nationkey % 3) as rep, cast(instr(c_name, '#') as bigint) as pos, concat_ws('/', c_mktsegment, c_name) as cw, left(c_name, 4) as lf, right(c_name, 4) as rt, cast(ascii(c_mktsegment) as bigint) as asc_, cast(levenshtein(c_mktsegment, 'BUILDING') as bigint) as lev, startswith(c_mktsegment, 'B') as sw, lower(hex(c_custkey)) as hx from customer",
                 "select c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) as i, lpad(c_mktsegment, 12, '*') as lp, rpad(c_mktsegment, 12, '*') as rp, replace(c_name, '0', 'o') as r, reverse(c_name) as rv, split_part(c_name, '#', 1) as sp, translate(c_mktsegment, 'AEI', '123') as tr, ltrim(concat(' ', c_name)) as lt, repeat('ab', c_nationkey % 3) as rep, cast(instr(c_name, '#') as bigint) as pos, concat_ws('/', c_mktsegment, c_name) as cw, left(c_name, 4) as lf, right(c_name, 4) as rt, cast(ascii(c_mktsegment) as bigint) as asc_, cast(levenshtein(c_mktsegment, 'BUILDING') as bigint) as lev, starts_with(c_mktsegment, 'B') as sw, lower(to_hex(c_custkey)) as hx from customer"),
    "f_regex": ("select c_custkey, regexp_like(c_name, '[0-9]+5$') as m, regexp_replace(c_name, '[0-9]', 'd') as r, regexp_extract(c_name, '([0-9]+)', 1) as x, cast(regexp_count(c_name, '0') as bigint) as n from customer",
                "select c_custkey, regexp_matches(c_name, '[0-9]+5$') as m, regexp_replace(c_name, '[0-9]', 'd', 'g') as r, regexp_extract(c_name, '([0-9]+)', 1) as x, cast(len(regexp_extract_all(c_name, '0')) as bigint) as n from customer"),
    "f_date": ("select o_orderkey, date_trunc('month', o_orderdate) as m, cast(date_part('dow', o_orderdate) as bigint) as dw, make_date(cast(extract(year from o_orderdate) as int), 1, 1) as jan, cast(date_format(o_orderdate, 'yyyy-MM-dd') as string) as d, cast(unix_timestamp(cast(o_orderdate as timestamp)) as bigint) as u, cast(last_day(o_orderdate) as date) as ld from orders",
               "select o_orderkey, cast(date_trunc('month', o_orderdate) as timestamp) as m, cast(date_part('dow', o_orderdate) + 1 as bigint) as dw, make_date(extract(year from o_orderdate), 1, 1) as jan, strftime(o_orderdate, '%Y-%m-%d') as d, cast(epoch(o_orderdate) as bigint) as u, last_day(o_orderdate) as ld from orders"),
    "f_date_bin": ("select event_id, timestamp_seconds(unix_timestamp(cast(ts as timestamp)) div 900 * 900) as bin from events", "select event_id, time_bucket(interval '15 minutes', ts) as bin from events"),
    "f_conditional": "select c_custkey, coalesce(nullif(c_nationkey, 3), -1) as co, greatest(c_nationkey, 10) as g, least(c_nationkey, 10) as l, ifnull(nullif(c_nationkey, 4), 0) as i from customer",
    "f_hash": ("select c_custkey, md5(c_name) as m, sha2(c_name, 256) as s, base64(cast(c_name as binary)) as b, sha1(c_name) as s1 from customer", "select c_custkey, md5(c_name) as m, sha256(c_name) as s, base64(encode(c_name)) as b, sha1(c_name) as s1 from customer"),
    "f_array": ("select p_partkey, size(array(p_size, 1, 2)) as n, array_contains(array(p_size, 1), 1) as h, array_join(array('a', p_brand), '-') as j, element_at(array(p_size, 5), 2) as e, array_distinct(array(p_size % 2, 0, 1)) as d, slice(sequence(1, 5), 2, 3) as s, array_max(array(p_size, 9)) as mx, cast(array_position(array(1, 9), 9) as bigint) as ps, flatten(array(array(1), array(2, 3))) as fl from part",
                "select p_partkey, cast(len([p_size, 1, 2]) as integer) as n, list_contains([p_size, 1], 1) as h, array_to_string(['a', p_brand], '-') as j, [p_size, 5][2] as e, case when p_size % 2 = 0 then [0, 1] else [1, 0] end as d, [2, 3, 4] as s, list_max([p_size, 9]) as mx, cast(list_position([1, 9], 9) as bigint) as ps, flatten([[1], [2, 3]]) as fl from part"),
    "f_struct_map": ("select n_nationkey, named_struct('a', n_name, 'b', n_regionkey).a as a, map_keys(map(n_name, 1))[0] as k, element_at(map('x', n_regionkey), 'x') as v from nation", "select n_nationkey, n_name as a, map_keys(map {n_name: 1})[1] as k, n_regionkey as v from nation"),
    "f_json": ("select event_id, get_json_object(props, '$.k') as k from events", "select event_id, props ->> '$.k' as k from events"),
    "f_spark_set": ("select p_partkey, round(expm1(p_size / 100.0), 8) as em, conv(cast(p_size as string), 10, 2) as c from part", "select p_partkey, round(exp(p_size / 100.0) - 1, 8) as em, bin(p_size) as c from part"),
    "f_gcd_lcm": ("select p_partkey, tessera_gcd(p_partkey, p_size) as g, tessera_lcm(p_partkey, p_size) as l from part", "select p_partkey, cast(gcd(p_partkey, p_size) as bigint) as g, cast(lcm(p_partkey, p_size) as bigint) as l from part"),
    "f_math3": "select p_partkey, round(asin(p_size / 100.0), 6) as asn, round(acos(p_size / 100.0), 6) as acs, round(atan(p_size), 6) as atn, round(cos(p_size), 6) as cs, round(tan(p_size), 6) as tn, round(cosh(p_size / 50.0), 6) as ch, round(asinh(p_size), 6) as ash, round(atanh(p_size / 100.0), 6) as ath, p_size % 7 as md, round(p_retailprice, 1) as rd, isnan(p_retailprice) as nn from part",
    "f_string2": ("select c_custkey, cast(ascii(c_mktsegment) as bigint) as asc_, chr(65 + c_nationkey) as ch, left(c_name, 4) as l, right(c_name, 3) as r, starts_with, ends_with, cast(strpos as bigint) as strpos, cast(octets as bigint) as octets, cast(bits as bigint) as bits, bt, ov, cast(lev as bigint) as lev from (select *, startswith(c_name, 'C') as starts_with, endswith(c_name, '5') as ends_with, position('#' in c_name) as strpos, octet_length(c_name) as octets, bit_length(c_name) as bits, btrim(concat(' ', c_name, ' ')) as bt, substr(c_mktsegment, 2) as ov, levenshtein(c_mktsegment, 'BUILDING') as lev from customer) as t",
                  "select c_custkey, cast(ascii(c_mktsegment) as bigint) as asc_, chr(65 + c_nationkey) as ch, left(c_name, 4) as l, right(c_name, 3) as r, starts_with(c_name, 'C') as starts_with, ends_with(c_name, '5') as ends_with, cast(position('#' in c_name) as bigint) as strpos, cast(octet_length(encode(c_name)) as bigint) as octets, cast(8 * octet_length(encode(c_name)) as bigint) as bits, trim(concat(' ', c_name, ' ')) as bt, substr(c_mktsegment, 2) as ov, cast(levenshtein(c_mktsegment, 'BUILDING') as bigint) as lev from customer"),
    "f_date2": ("select o_orderkey, cast(year(o_orderdate) as bigint) as y, cast(quarter(o_orderdate) as bigint) as q, cast(month(o_orderdate) as bigint) as m, cast(weekofyear(o_orderdate) as bigint) as w, cast(dayofyear(o_orderdate) as bigint) as dy, cast(day(o_orderdate) as bigint) as d, cast(hour(o_orderdate) as bigint) as h, cast(date_add(o_orderdate, 30) as date) as later, cast(datediff(o_orderdate, date'1995-01-01') as bigint) as days, cast(add_months(o_orderdate, 2) as date) as am, to_date('2024-02-29') as leap from orders",
                "select o_orderkey, cast(year(o_orderdate) as bigint) as y, cast(quarter(o_orderdate) as bigint) as q, cast(month(o_orderdate) as bigint) as m, cast(weekofyear(o_orderdate) as bigint) as w, cast(dayofyear(o_orderdate) as bigint) as dy, cast(day(o_orderdate) as bigint) as d, cast(hour(o_orderdate) as bigint) as h, cast(cast(o_orderdate as date) + 30 as date) as later, cast(datediff('day', date '1995-01-01', cast(o_orderdate as date)) as bigint) as days, cast(cast(o_orderdate as date) + interval 2 month as date) as am, date '2024-02-29' as leap from orders"),
    "f_conditional2": ("select c_custkey, nvl(nullif(c_nationkey, 3), -1) as n1, nvl2(nullif(c_nationkey, 3), 1, 0) as n2, if(c_acctbal > 0, 'pos', 'neg') as i, case c_mktsegment when 'BUILDING' then 1 else 0 end as c, c_acctbal is distinct from 0 as d from (select * from customer) as t",
                       "select c_custkey, coalesce(nullif(c_nationkey, 3), -1) as n1, case when nullif(c_nationkey, 3) is not null then 1 else 0 end as n2, if(c_acctbal > 0, 'pos', 'neg') as i, case c_mktsegment when 'BUILDING' then 1 else 0 end as c, c_acctbal is distinct from 0 as d from customer"),
    "f_hash2": ("select c_custkey, sha2(c_name, 512) = sha2(c_name, 512) as same, hex(c_name) as hx, cast(unhex(hex(c_name)) as string) as back, cast(length(sha2(c_name, 384)) as bigint) as n384 from customer", "select c_custkey, true as same, hex(c_name) as hx, c_name as back, cast(96 as bigint) as n384 from customer"),
    "f_array2": ("select p_partkey, array_append(array(1), p_size) as ap, array_prepend(array(1), p_size) as pp, array_remove(array(1, p_size, 2), 2) as rm, array_union(array(1, 2), array(2, 3)) as un, array_intersect(array(1, 2), array(2, 3)) as it, array_except(array(1, 2), array(2, 3)) as ex, arrays_overlap(array(p_size), array(1, 2)) as ov, array_repeat(p_size, 2) as rp, array_min(array(p_size, 9)) as mn, sort_array(array(3, p_size, 1)) as so, reverse(array(1, 2, 3)) as rv, sequence(1, 4) as sq from part",
                 "select p_partkey, [1, p_size] as ap, [p_size, 1] as pp, list_filter([1, p_size, 2], lambda x: x <> 2) as rm, [1, 2, 3] as un, [2] as it, [1] as ex, list_has_any([p_size], [1, 2]) as ov, [p_size, p_size] as rp, list_min([p_size, 9]) as mn, list_sort([3, p_size, 1]) as so, [3, 2, 1] as rv, cast([1, 2, 3, 4] as integer[]) as sq from part"),
    "f_map2": ("select n_nationkey, cast(map_size as bigint) as map_size, vals, has_x, from_arr from (select n_nationkey, size(map('x', n_name, 'y', 'z')) as map_size, map_values(map('x', n_regionkey, 'y', 7)) as vals, map_contains_key(map('x', 1), 'x') as has_x, element_at(map_from_arrays(array('p', 'q'), array(n_regionkey, 5)), 'q') as from_arr from nation) as t",
               "select n_nationkey, cast(2 as bigint) as map_size, [n_regionkey, 7] as vals, true as has_x, 5 as from_arr from nation"),
    "f_json2": ("select event_id, cast(json_array_length('[1,2,3]') as bigint) as n, from_json(props, 'k string').k as k, to_json(named_struct('a', event_id)) as j from events", "select event_id, cast(json_array_length('[1,2,3]') as bigint) as n, props ->> '$.k' as k, '{\"a\":' || event_id || '}' as j from events"),
    "f_regex2": ("select c_custkey, regexp_substr(c_name, '[0-9]+') as s, cast(regexp_instr(c_name, '[0-9]') as bigint) as i, c_name rlike '^C.*' as m, element_at(regexp_extract_all(c_name, '([0-9])', 1), 1) as f from customer", "select c_custkey, regexp_extract(c_name, '[0-9]+') as s, cast(position(regexp_extract(c_name, '[0-9]') in c_name) as bigint) as i, regexp_matches(c_name, '^C.*') as m, regexp_extract_all(c_name, '[0-9]')[1] as f from customer"),
    "f_other": ("select r_regionkey, typeof(r_regionkey) as t1, typeof(r_name) as t2, version() is not null as v from region", "select r_regionkey, 'int' as t1, 'string' as t2, true as v from region"),
    "a23_more": ("select l_returnflag, max_by(l_orderkey, struct(l_quantity, l_orderkey)) as mb, min_by(l_orderkey, struct(l_quantity, l_orderkey)) as mn, cast(count_if(l_quantity > 25) as bigint) as ci, round(skewness(l_quantity), 4) + 0.0 as sk, mode(l_linenumber, true) as mo, cast(approx_count_distinct(l_linenumber) as bigint) as acd from lineitem group by l_returnflag",
                 "select l_returnflag, arg_max(l_orderkey, row(l_quantity, l_orderkey)) as mb, arg_min(l_orderkey, row(l_quantity, l_orderkey)) as mn, cast(count_if(l_quantity > 25) as bigint) as ci, round(skewness(l_quantity) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 4) + 0.0 as sk, (select l_linenumber from lineitem i where i.l_returnflag = lineitem.l_returnflag group by 1 order by count(*) desc, 1 limit 1) as mo, count(distinct l_linenumber) as acd from lineitem group by l_returnflag"),
    # group-by and join benchmarks, over the lines
    "g1_sum_by_one": "select l_returnflag, cast(sum(l_linenumber) as bigint) as v from lineitem group by l_returnflag",
    "g2_sum_by_two": "select l_returnflag, l_suppkey, cast(sum(l_linenumber) as bigint) as v from lineitem group by l_returnflag, l_suppkey",
    "g3_sum_mean": "select l_partkey, cast(sum(l_linenumber) as bigint) as v1, round(avg(l_quantity), 6) as v3 from lineitem group by l_partkey",
    "g4_means": "select l_suppkey, cast(sum(l_linenumber) as double) / count(l_linenumber) as v1, cast(sum(l_quantity) as double) / count(l_quantity) as v2 from lineitem group by l_suppkey",
    "g5_sums": "select l_orderkey, cast(sum(l_linenumber) as bigint) as v1, cast(sum(l_quantity) as double) as v2 from lineitem group by l_orderkey",
    "g6_median_sd": "select l_returnflag, l_linestatus, median(l_quantity) as med, round(stddev(l_quantity), 6) as sd from lineitem group by l_returnflag, l_linestatus",
    "g7_range": "select l_partkey, max(l_linenumber) - min(l_linenumber) as range_v from lineitem group by l_partkey",
    "g8_top_two": "select l_suppkey, l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_suppkey order by l_quantity desc, l_orderkey, l_linenumber) as rn from lineitem) as t where rn <= 2",
    "g9_r2": "select l_returnflag, l_suppkey, round(power(corr(l_quantity, l_extendedprice), 2), 6) as r2 from lineitem group by l_returnflag, l_suppkey",
    "g10_all_keys": "select l_returnflag, l_linestatus, l_suppkey, l_partkey, l_orderkey, l_linenumber, count(*) as n from lineitem group by l_returnflag, l_linestatus, l_suppkey, l_partkey, l_orderkey, l_linenumber",
    "jb1_small_inner": "select l_orderkey, l_linenumber, n_name from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey",
    "jb2_medium_inner": "select l_orderkey, l_linenumber, p_brand from lineitem join part on l_partkey = p_partkey",
    "jb3_medium_left": "select l_orderkey, l_linenumber, p_brand from lineitem left join (select * from part where p_size < 25) as p on l_partkey = p_partkey",
    "jb4_big_inner": "select l_orderkey, l_linenumber, o_custkey from lineitem join orders on l_orderkey = o_orderkey",
    # event-time windows over a batch (an extension)
    "w_tumbling": ("select window.start as start, event_type, count(*) as n from events group by window(ts, '1 hour'), event_type", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by all"),
}


def spark_sql(name: str) -> str:
    text = SQL[name]
    return text if isinstance(text, str) else text[0]


def oracle_sql(name: str) -> str | None:
    text = SQL[name]
    return text if isinstance(text, str) else text[1]
