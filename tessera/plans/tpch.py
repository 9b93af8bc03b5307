"""The 22 decision-support queries, adapted to the columns of the test tables.

Money is summed in whole cents (or ten-thousandths), so results do not depend
on the order of additions. Part-supplier pairs, absent from the tables, are
derived from the lines; predicates on absent columns use stand-ins.
"""

from __future__ import annotations

CENTS = "cast(round({0} * 100) as bigint)"
PRICE, DISCOUNT, TAX = (CENTS.format(c) for c in ("l_extendedprice", "l_discount", "l_tax"))
#: Revenue in ten-thousandths of the currency.
REVENUE = f"{PRICE} * (100 - {DISCOUNT})"
MONEY = f"cast(sum({REVENUE}) as double) / 10000"
PARTSUPP = (
    "(select distinct l_partkey as ps_partkey, l_suppkey as ps_suppkey, (l_partkey * 7 + l_suppkey * 13) % 1000 + 1 as ps_supplycost, "
    "(l_partkey * 3 + l_suppkey * 5) % 9999 as ps_availqty from lineitem)"
)

SQL: dict[str, str] = {
    "tpch_q01": f"""
        select l_returnflag, l_linestatus, cast(sum(l_quantity) as double) as sum_qty, cast(sum({PRICE}) as double) / 100 as sum_base_price,
               {MONEY} as sum_disc_price, cast(sum({REVENUE} * (100 + {TAX})) as double) / 1000000 as sum_charge,
               round(avg(l_quantity), 6) as avg_qty, cast(sum({DISCOUNT}) as double) / 100 / count(*) as avg_disc, count(*) as count_order
        from lineitem where l_shipdate <= date '2001-09-02' group by l_returnflag, l_linestatus""",
    "tpch_q02": f"""
        with ps as {PARTSUPP}
        select s_acctbal, s_name, n_name, p_partkey, p_brand, ps_supplycost
        from part join ps on p_partkey = ps_partkey join supplier on s_suppkey = ps_suppkey
             join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        where p_size between 10 and 20 and p_type like '%ARD' and r_name = 'EUROPE'
          and ps_supplycost = (select min(ps2.ps_supplycost) from ps as ps2 join supplier as s2 on s2.s_suppkey = ps2.ps_suppkey
                               join nation as n2 on s2.s_nationkey = n2.n_nationkey join region as r2 on n2.n_regionkey = r2.r_regionkey
                               where r2.r_name = 'EUROPE' and ps2.ps_partkey = p_partkey)
        order by s_acctbal desc, n_name, s_name, p_partkey limit 100""",
    "tpch_q03": f"""
        select l_orderkey, {MONEY} as revenue, o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
        where c_mktsegment = 'BUILDING' and o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15'
        group by l_orderkey, o_orderdate order by revenue desc, o_orderdate, l_orderkey limit 10""",
    "tpch_q04": """
        select o_orderpriority, count(*) as order_count from orders
        where o_orderdate >= date '1996-07-01' and o_orderdate < date '1996-07-01' + interval '3' month
          and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate + interval '60' day)
        group by o_orderpriority""",
    "tpch_q05": f"""
        select n_name, {MONEY} as revenue
        from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey
             join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        where r_name = 'ASIA' and o_orderdate >= date '1996-01-01' and o_orderdate < date '1998-01-01' group by n_name""",
    "tpch_q06": f"""
        select cast(sum({PRICE} * {DISCOUNT}) as double) / 10000 as revenue from lineitem
        where l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01' and l_discount between 0.045 and 0.075 and l_quantity < 24""",
    "tpch_q07": f"""
        select n1.n_name as supp_nation, n2.n_name as cust_nation, cast(extract(year from l_shipdate) as bigint) as l_year, {MONEY} as revenue
        from supplier join lineitem on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
             join nation n1 on s_nationkey = n1.n_nationkey join nation n2 on c_nationkey = n2.n_nationkey
        where ((n1.n_name = 'NATION_1' and n2.n_name = 'NATION_2') or (n1.n_name = 'NATION_2' and n2.n_name = 'NATION_1'))
          and l_shipdate between date '1995-01-01' and date '2000-12-31'
        group by n1.n_name, n2.n_name, extract(year from l_shipdate)""",
    "tpch_q08": f"""
        select o_year, cast(sum(case when nation = 'NATION_3' then volume else 0 end) as double) / cast(sum(volume) as double) as mkt_share
        from (select cast(extract(year from o_orderdate) as bigint) as o_year, {REVENUE} as volume, n2.n_name as nation
              from part join lineitem on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join orders on l_orderkey = o_orderkey
                   join customer on o_custkey = c_custkey join nation n1 on c_nationkey = n1.n_nationkey join region on n1.n_regionkey = r_regionkey
                   join nation n2 on s_nationkey = n2.n_nationkey
              where r_name = 'AMERICA' and o_orderdate between date '1995-01-01' and date '1998-12-31' and p_type = 'ECONOMY') as all_nations
        group by o_year""",
    "tpch_q09": f"""
        with ps as {PARTSUPP}
        select nation, o_year, cast(sum(amount) as double) / 10000 as sum_profit
        from (select n_name as nation, cast(extract(year from o_orderdate) as bigint) as o_year,
                     {REVENUE} - ps_supplycost * 100 * cast(l_quantity as bigint) as amount
              from part join lineitem on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join ps on ps_suppkey = l_suppkey and ps_partkey = l_partkey
                   join orders on o_orderkey = l_orderkey join nation on s_nationkey = n_nationkey
              where p_name like '%a%') as profit
        group by nation, o_year""",
    "tpch_q10": f"""
        select c_custkey, c_name, {MONEY} as revenue, c_acctbal, n_name
        from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey
        where o_orderdate >= date '1996-10-01' and o_orderdate < date '1997-01-01' and l_returnflag = 'R'
        group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20""",
    "tpch_q11": f"""
        with ps as {PARTSUPP}
        select ps_partkey, cast(sum(ps_supplycost * ps_availqty) as bigint) as value
        from ps join supplier on ps_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where n_name in ('NATION_1', 'NATION_2', 'NATION_3')
        group by ps_partkey
        having sum(ps_supplycost * ps_availqty) > (select sum(ps_supplycost * ps_availqty) * 0.001 from ps join supplier on ps_suppkey = s_suppkey
                                                   join nation on s_nationkey = n_nationkey where n_name in ('NATION_1', 'NATION_2', 'NATION_3'))""",
    "tpch_q12": """
        select l_returnflag, cast(sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as bigint) as high_line_count,
               cast(sum(case when o_orderpriority not in ('1-URGENT', '2-HIGH') then 1 else 0 end) as bigint) as low_line_count
        from orders join lineitem on o_orderkey = l_orderkey
        where l_returnflag in ('A', 'R') and l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01' group by l_returnflag""",
    "tpch_q13": """
        select c_count, count(*) as custdist
        from (select c_custkey, count(o_orderkey) as c_count from customer left join orders on c_custkey = o_custkey and o_orderpriority not like '%URGENT%'
              group by c_custkey) as c_orders
        group by c_count""",
    "tpch_q14": f"""
        select 100.0 * cast(sum(case when p_type like 'PROMO%' then {REVENUE} else 0 end) as double) / cast(sum({REVENUE}) as double) as promo_revenue
        from lineitem join part on l_partkey = p_partkey where l_shipdate >= date '1996-09-01' and l_shipdate < date '1996-09-01' + interval '1' month""",
    "tpch_q15": f"""
        with revenue as (select l_suppkey as supplier_no, sum({REVENUE}) as total from lineitem
                         where l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-01-01' + interval '3' month group by l_suppkey)
        select s_suppkey, s_name, cast(total as double) / 10000 as total_revenue from supplier join revenue on s_suppkey = supplier_no
        where total = (select max(total) from revenue)""",
    "tpch_q16": f"""
        with ps as {PARTSUPP}
        select p_brand, p_type, p_size, count(distinct ps_suppkey) as supplier_cnt from ps join part on p_partkey = ps_partkey
        where p_brand <> 'Brand#45' and p_type not like 'MEDIUM%' and p_size in (49, 14, 23, 45, 19, 3, 36, 9)
          and ps_suppkey not in (select s_suppkey from supplier where s_acctbal < 0)
        group by p_brand, p_type, p_size""",
    "tpch_q17": f"""
        select cast(sum({PRICE}) as double) / 700 as avg_yearly from lineitem join part on p_partkey = l_partkey
        where p_type = 'PROMO' and l_quantity < (select 0.5 * avg(l2.l_quantity) from lineitem as l2 where l2.l_partkey = p_partkey)""",
    "tpch_q18": """
        select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, cast(sum(l_quantity) as double) as sum_qty
        from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey
        where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 200)
        group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice order by o_totalprice desc, o_orderdate, o_orderkey limit 100""",
    "tpch_q19": f"""
        select {MONEY} as revenue from lineitem join part on p_partkey = l_partkey
        where (p_type = 'SMALL' and l_quantity between 1 and 11 and p_size between 1 and 15)
           or (p_type = 'MEDIUM' and l_quantity between 10 and 20 and p_size between 1 and 30)
           or (p_type = 'LARGE' and l_quantity between 20 and 30 and p_size between 1 and 45)""",
    "tpch_q20": f"""
        with ps as {PARTSUPP}
        select s_name, n_name from supplier join nation on s_nationkey = n_nationkey
        where s_suppkey in (select ps_suppkey from ps where ps_partkey in (select p_partkey from part where p_type like 'STANDARD%')
                              and ps_availqty > (select 0.5 * sum(l_quantity) from lineitem where l_partkey = ps_partkey and l_suppkey = ps_suppkey
                                                 and l_shipdate >= date '1996-01-01' and l_shipdate < date '1999-01-01'))""",
    "tpch_q21": """
        select s_name, count(*) as numwait from supplier join lineitem l1 on s_suppkey = l1.l_suppkey join orders on o_orderkey = l1.l_orderkey
        where o_orderstatus = 'F' and l1.l_shipdate > o_orderdate + interval '60' day
          and exists (select 1 from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
          and not exists (select 1 from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_shipdate > o_orderdate + interval '60' day)
        group by s_name order by numwait desc, s_name limit 100""",
    "tpch_q22": """
        select cntrycode, count(*) as numcust, cast(sum(cents) as double) / 100 as totacctbal
        from (select substring(c_name from 10 for 2) as cntrycode, cast(round(c_acctbal * 100) as bigint) as cents, c_custkey, c_acctbal from customer
              where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0.0)
                and not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate > date '2000-06-01')) as custsale
        group by cntrycode""",
}
