"""Ad-hoc SELECT statements over the star schema; the same text runs on both sides.

Each statement ends in a bounded report of its own, so the row limit does not decide which rows are returned.
"""

from __future__ import annotations

from retrievo.operators.guarded import guarded_select, render_rows
from retrievo.plans.registry import register

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

STATEMENTS = {
    "guarded_join_agg": """
SELECT n.n_name, count(*) AS n_orders, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name HAVING count(*) > 10""",
    "guarded_semi_anti": """
SELECT c.c_mktsegment, count(*) AS customers, round(avg(c.c_acctbal), 4) AS mean_balance FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
GROUP BY c.c_mktsegment""",
    "guarded_rollup": """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping(l_linestatus) AS level
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "guarded_window": """
SELECT brand, kind, revenue, place FROM (SELECT brand, kind, revenue,
    rank() OVER (PARTITION BY brand ORDER BY revenue DESC, kind) AS place
  FROM (SELECT p.p_brand AS brand, p.p_type AS kind, round(sum(l.l_extendedprice), 2) AS revenue
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand, p.p_type) sums) ranked
WHERE place <= 2""",
    "guarded_setops": """
SELECT nationkey, origin FROM (SELECT c_nationkey AS nationkey, 'customer' AS origin FROM customer
  UNION SELECT s_nationkey, 'supplier' FROM supplier) u
WHERE nationkey IN (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
EXCEPT SELECT n_nationkey, 'supplier' FROM nation WHERE n_regionkey = 0""",
    "guarded_topk": """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""",
}


def _loader(sf_dir: str, name: str):
    return lambda session: session.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark, sf_dir, sql):
    return guarded_select(spark, sql.strip(), {t: _loader(sf_dir, t) for t in TABLES})


def _register(name: str, sql: str) -> None:
    register(name, sql)(lambda spark, sf_dir: run(spark, sf_dir, sql))


for _name, _sql in STATEMENTS.items():
    _register(_name, _sql)


@register("guarded_rows", f"""
SELECT 'o_orderkey: ' || o_orderkey || chr(10) || 'o_custkey: ' || o_custkey || chr(10) AS row
FROM ({STATEMENTS['guarded_topk']})""")
def guarded_rows(spark, sf_dir):
    return render_rows(run(spark, sf_dir, STATEMENTS["guarded_topk"]).select("o_orderkey", "o_custkey"))
