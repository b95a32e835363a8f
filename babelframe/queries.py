"""The reference operators as queries over the driver's tables, with the SQL that DuckDB checks them by.

A query is (SQL in a dialect, the dialect, and DuckDB's SQL where it differs). Sums of floating numbers are rounded,
since their last digits depend on the order of addition.
"""

from __future__ import annotations

import sqlite3
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import REFERENCE, Dialect, load_dialect
from .plans.store import shared_folder, store
from .session import Engine
from .sources.catalog import Catalog
from .sources.tables import EVENT_TYPES, event_table, json_tables, literal_table, sqlite_tables
from .sql.passes import limit_with_ties

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass
class Case:
    sql: str
    oracle: str | None = None
    dialect: Dialect | str = REFERENCE
    semantics: dict = field(default_factory=dict)
    engine: dict = field(default_factory=dict)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        d = load_dialect(self.dialect) if isinstance(self.dialect, str) else self.dialect
        if self.semantics:
            d = d.with_semantics(**self.semantics)
        return Engine(spark, d, Catalog.parquet(spark, sf_dir, TABLES), **self.engine).sql(self.sql)

    @property
    def check(self) -> str:
        return self.oracle or self.sql


C = Case
CASES: dict[str, Case] = {
    "flagship_pricing_summary": C("""
SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""),
    # --- R, P: scan, project, filter
    "scan_region": C("SELECT * FROM region"),
    "scan_alias_star": C("SELECT n.* FROM nation AS n"),
    "project_arith": C("SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount) * (1 + l_tax) - 1.5, 4) AS charge FROM lineitem"),
    "project_unary": C("SELECT o_orderkey, -o_totalprice AS neg, +o_custkey AS same FROM orders"),
    "concat": C("SELECT c_custkey, c_name || '/' || c_mktsegment AS label, c_custkey || ':' || c_nationkey AS k FROM customer", "SELECT c_custkey, c_name || '/' || c_mktsegment AS label, CAST(c_custkey AS VARCHAR) || ':' || CAST(c_nationkey AS VARCHAR) AS k FROM customer"),
    "case_bucket": C("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS bucket, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders"),
    "cast_kinds": C("SELECT p_partkey, CAST(p_size AS VARCHAR) AS t, CAST(p_retailprice AS TEXT) = '' AS e, CAST(p_name AS INT) AS bad, CAST(p_partkey AS DOUBLE) AS d, CAST(p_size AS BOOLEAN) AS b FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS t, false AS e, TRY_CAST(p_name AS BIGINT) AS bad, CAST(p_partkey AS DOUBLE) AS d, CAST(p_size AS BOOLEAN) AS b FROM part"),
    "cast_text_timestamp": C("SELECT CAST('2024-02-29 10:11:12' AS TIMESTAMP) AS ts, CAST('2024-02-29' AS DATE) AS d, CAST('x' AS DATE) AS bad, r_regionkey FROM region", "SELECT TIMESTAMP '2024-02-29 10:11:12' AS ts, DATE '2024-02-29' AS d, CAST(NULL AS DATE) AS bad, r_regionkey FROM region"),
    "filter_cmp": C("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 150000 AND o_orderdate < DATE '1997-01-01' AND o_orderstatus <> 'P' AND o_orderkey != 7"),
    "in_list": C("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)"),
    "not_in_list": C("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (0, 3)"),
    "in_list_null": C("SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (0, NULL) OR n_regionkey IN (1, NULL)"),
    "between": C("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20"),
    "not_between": C("SELECT p_partkey FROM part WHERE p_retailprice NOT BETWEEN 950.5 AND 1500"),
    "like": C("SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%ROM%' OR p_name LIKE '_a%'"),
    "not_like": C("SELECT p_partkey FROM part WHERE NOT p_type LIKE '%ALL' AND p_name NOT LIKE 'c%'"),
    "ilike": C("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%build%'"),
    "is_null": C("SELECT e.event_id, e.value IS NULL AS no_value FROM events e WHERE e.props IS NOT NULL"),
    "null_safe_eq": C("SELECT a.n_nationkey, NULLIF(a.n_regionkey, 1) IS NOT DISTINCT FROM NULL AS same, NULLIF(a.n_regionkey, 1) IS DISTINCT FROM 2 AS differ FROM nation a"),
    "and_or_not": C("SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal < 0 OR s_nationkey = 3) AND (s_nationkey > 10 OR s_acctbal > 5000)"),
    "mod": C("SELECT o_orderkey, o_orderkey % 7 AS m, MOD(-o_orderkey, 7) AS n, o_orderkey % 0 AS z FROM orders", "SELECT o_orderkey, o_orderkey % 7 AS m, (-o_orderkey) % 7 AS n, CAST(NULL AS BIGINT) AS z FROM orders"),
    "div_null_on_zero": C("SELECT o_orderkey, o_totalprice / (o_custkey % 3) AS q FROM orders", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice / (o_custkey % 3) END AS q FROM orders"),
    "int_div_promote": C("SELECT n_nationkey, n_nationkey / 2 AS q FROM nation"),
    "int_div_truncate": C("SELECT n_nationkey, (n_nationkey - 10) / 3 AS q FROM nation", "SELECT n_nationkey, CAST(trunc((n_nationkey - 10) / 3.0) AS BIGINT) AS q FROM nation", semantics={"integer_division": "truncate"}),
    "div_inf": C("SELECT s_suppkey, (s_acctbal - 5000.0) / (0.0 * s_nationkey) > 1000000 AS up FROM supplier", "SELECT s_suppkey, s_acctbal > 5000.0 AS up FROM supplier", semantics={"division_by_zero": "inf"}),
    "literals": C("SELECT 1 AS i, 1.5 AS f, 1e2 AS e, 'it''s' AS s, TRUE AS t, NULL AS n, DATE '2020-02-29' AS d, r_regionkey FROM region", "SELECT CAST(1 AS BIGINT) AS i, CAST(1.5 AS DOUBLE) AS f, CAST(100 AS DOUBLE) AS e, 'it''s' AS s, TRUE AS t, NULL AS n, DATE '2020-02-29' AS d, r_regionkey FROM region"),
    # --- J: joins
    "join_inner": C("SELECT o.o_orderkey, c.c_name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey"),
    "join_left": C("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000"),
    "join_right": C("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT OUTER JOIN customer c ON o.o_custkey = c.c_custkey"),
    "join_full": C("SELECT a.n_name AS x, b.s_name AS y FROM nation a FULL JOIN supplier b ON a.n_nationkey = b.s_nationkey AND b.s_acctbal > 4000"),
    "join_cross": C("SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "join_theta": C("SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey"),
    "join_theta_left": C("SELECT a.r_regionkey AS x, b.n_nationkey AS y FROM region a LEFT JOIN nation b ON a.r_regionkey > b.n_regionkey + 2"),
    "join_theta_full": C("SELECT a.r_regionkey AS x, b.n_nationkey AS y FROM region a FULL JOIN nation b ON a.r_regionkey > b.n_regionkey + 2"),
    "join_mixed": C("SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_extendedprice * 3 > o.o_totalprice"),
    "join_using": C("SELECT k, o_orderkey, c_name FROM (SELECT o_custkey AS k, o_orderkey FROM orders) AS o JOIN (SELECT c_custkey AS k, c_name FROM customer) AS c USING (k)"),
    "join_using_full": C("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) AS x FULL JOIN (SELECT r_regionkey + 3 AS k, r_name AS b FROM region) AS y USING (k)"),
    "join_self": C("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_three": C("SELECT r.r_name, COUNT(*) AS n, ROUND(SUM(c.c_acctbal), 2) AS bal FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name"),
    "join_semi": C("SELECT c.c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey)"),
    "join_anti": C("SELECT c.c_custkey FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", "SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey AND o.o_totalprice > 300000)"),
    "join_semi_theta": C("SELECT r.r_regionkey FROM region r LEFT SEMI JOIN nation n ON n.n_regionkey > r.r_regionkey + 1", "SELECT r.r_regionkey FROM region r WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey > r.r_regionkey + 1)"),
    "join_star_first_wins": C("SELECT * FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS w FROM region) b ON a.k = b.k", "SELECT a.k, a.v, b.w FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS w FROM region) b ON a.k = b.k"),
    "derived_table": C("SELECT t.seg, t.n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) AS t WHERE t.n > 10"),
    # --- A: aggregates
    "count_star": C("SELECT COUNT(*) AS n FROM lineitem"),
    "count_col": C("SELECT COUNT(value) AS n, COUNT(*) AS every FROM events"),
    "sum_avg_min_max": C("SELECT ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_quantity), 6) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi, SUM(l_linenumber) AS k FROM lineitem", "SELECT ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_quantity), 6) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi, CAST(SUM(l_linenumber) AS BIGINT) AS k FROM lineitem"),
    "group_by": C("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"),
    "group_two_keys": C("SELECT l_returnflag, l_linenumber, MAX(l_tax) AS m FROM lineitem GROUP BY l_returnflag, l_linenumber"),
    "group_expr": C("SELECT DATE_TRUNC('month', o_orderdate) AS m, COUNT(*) AS n FROM orders GROUP BY DATE_TRUNC('month', o_orderdate)", "SELECT CAST(DATE_TRUNC('month', o_orderdate) AS TIMESTAMP) AS m, COUNT(*) AS n FROM orders GROUP BY 1"),
    "group_alias": C("SELECT SUBSTR(o_orderpriority, 1, 1) AS p, COUNT(*) AS n FROM orders GROUP BY p ORDER BY p"),
    "group_null": C("SELECT NULLIF(n_regionkey, 2) AS k, COUNT(*) AS n FROM nation GROUP BY NULLIF(n_regionkey, 2)"),
    "having": C("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 3 AND MAX(c_acctbal) > 5000"),
    "having_global": C("SELECT COUNT(*) AS n FROM nation HAVING COUNT(*) > 1000"),
    "count_distinct": C("SELECT COUNT(DISTINCT l_suppkey) AS s, COUNT(DISTINCT l_returnflag) AS r FROM lineitem"),
    "sum_distinct": C("SELECT SUM(DISTINCT l_linenumber) AS s, AVG(DISTINCT l_linenumber) AS a, MIN(DISTINCT l_tax) AS m FROM lineitem", "SELECT CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s, AVG(DISTINCT l_linenumber) AS a, MIN(DISTINCT l_tax) AS m FROM lineitem"),
    "count_distinct_null_included": C("SELECT COUNT(DISTINCT NULLIF(n_regionkey, 1)) AS n FROM nation", "SELECT COUNT(DISTINCT NULLIF(n_regionkey, 1)) + 1 AS n FROM nation", semantics={"count_distinct_null": "included"}),
    "agg_filter": C("SELECT o_orderstatus, ROUND(SUM(o_totalprice) FILTER (WHERE o_custkey > 50), 2) AS s, COUNT(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 100000) AS d FROM orders GROUP BY o_orderstatus"),
    "count_filter": C("SELECT COUNT(*) FILTER (WHERE value > 50) AS n FROM events"),
    "global_empty": C("SELECT COUNT(*) AS n, COUNT(r_name) AS c, SUM(r_regionkey) AS s, MAX(r_name) AS m FROM region WHERE r_regionkey < 0", "SELECT COUNT(*) AS n, COUNT(r_name) AS c, CAST(SUM(r_regionkey) AS BIGINT) AS s, MAX(r_name) AS m FROM region WHERE r_regionkey < 0"),
    "sum_empty_zero": C("SELECT SUM(r_regionkey) AS s FROM region WHERE r_regionkey < 0", "SELECT CAST(0 AS BIGINT) AS s", semantics={"sum_of_empty_returns_null": False}),
    "agg_arith": C("SELECT l_suppkey, ROUND(SUM(l_extendedprice) - SUM(l_extendedprice * l_discount), 2) AS net, COUNT(*) * 2 + 1 AS odd FROM lineitem GROUP BY l_suppkey"),
    "order_by_aggregate": C("SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY COUNT(*) DESC, c_nationkey LIMIT 5"),
    # --- W: windows
    "w_row_number": C("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders"),
    "w_rank": C("SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS d FROM part"),
    "w_rank_text": C("SELECT n_nationkey, RANK() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r FROM nation"),
    "w_lag_lead": C("SELECT o_orderkey, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, LEAD(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders"),
    "w_first_last": C("SELECT o_orderkey, FIRST_VALUE(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f, LAST_VALUE(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders"),
    "w_partition_sum": C("SELECT l_orderkey, l_linenumber, ROUND(SUM(l_quantity) OVER (PARTITION BY l_orderkey), 2) AS s, COUNT(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"),
    "w_running": C("SELECT l_orderkey, l_linenumber, ROUND(SUM(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 2) AS s, ROUND(AVG(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 6) AS a, MIN(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS lo, MAX(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS hi, COUNT(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem"),
    "w_running_peers": C("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS n FROM orders"),
    "w_frame_knob_rows": C("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey) AS n FROM orders", semantics={"window_default_frame": "rows_unbounded_to_current"}),
    "w_frame_knob_whole": C("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS n FROM orders", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders", semantics={"window_default_frame": "rows_unbounded_to_unbounded"}),
    "w_mixed_order": C("SELECT p_partkey, ROW_NUMBER() OVER (PARTITION BY p_size ORDER BY p_brand DESC, p_partkey ASC) AS rn FROM part"),
    "w_rows_frame": C("SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders"),
    "w_range_frame": C("SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM part"),
    "w_groups_frame": C("SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part"),
    "w_ignore_nulls": C("SELECT event_id, LAST_VALUE(NULLIF(event_type, 'click') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events", "SELECT event_id, LAST_VALUE(NULLIF(event_type, 'click') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events", engine={}),
    "w_over_agg": C("SELECT c_mktsegment, c_nationkey, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY c_mktsegment) AS seg, RANK() OVER (PARTITION BY c_mktsegment ORDER BY COUNT(*) DESC) AS r FROM customer GROUP BY c_mktsegment, c_nationkey", "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n, CAST(SUM(COUNT(*)) OVER (PARTITION BY c_mktsegment) AS BIGINT) AS seg, RANK() OVER (PARTITION BY c_mktsegment ORDER BY COUNT(*) DESC) AS r FROM customer GROUP BY c_mktsegment, c_nationkey"),
    "w_filter_derived": C("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) AS t WHERE rn = 1"),
    "w_qualify": C("SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    # --- O: order, limit
    "topk": C("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "limit_offset": C("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 5"),
    "nulls_first": C("SELECT n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 2) ASC NULLS FIRST, n_nationkey LIMIT 6"),
    "nulls_last": C("SELECT n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 2) DESC NULLS LAST, n_nationkey LIMIT 6"),
    "nulls_default": C("SELECT n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 2) DESC, n_nationkey LIMIT 6", "SELECT n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 2) DESC NULLS FIRST, n_nationkey LIMIT 6"),
    "order_unselected": C("SELECT p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 9"),
    "order_expr_alias": C("SELECT p_partkey, p_size * 2 AS d FROM part ORDER BY d DESC, p_partkey + 0 LIMIT 9"),
    "fetch_first": C("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 3 ROWS FETCH NEXT 4 ROWS ONLY;", 'SELECT c_custkey AS "C_CUSTKEY" FROM customer ORDER BY c_custkey LIMIT 4 OFFSET 3', dialect="bracket_oracle_pg"),
    "with_ties": C("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC LIMIT 3 WITH TIES", "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, RANK() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 3"),
    "distinct": C("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "distinct_order": C("SELECT DISTINCT p_size FROM part ORDER BY p_size DESC LIMIT 5"),
    # --- T: set operations
    "union_all": C("SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region"),
    "union": C("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region"),
    "union_widen": C("SELECT r_regionkey AS k FROM region UNION ALL SELECT s_acctbal FROM supplier"),
    "intersect": C("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "intersect_all": C("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    "except": C("SELECT n_nationkey AS k FROM nation EXCEPT SELECT n_regionkey FROM nation"),
    "except_all": C("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "setop_nulls": C("SELECT NULLIF(n_regionkey, 1) AS k FROM nation INTERSECT SELECT NULLIF(r_regionkey, 1) FROM region"),
    "setop_default_all": C("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", semantics={"set_op_default": "all"}),
    "precedence_ansi": C("SELECT r_regionkey AS k FROM region UNION ALL SELECT n_regionkey FROM nation INTERSECT SELECT n_nationkey FROM nation", "(SELECT r_regionkey AS k FROM region UNION ALL SELECT n_regionkey FROM nation) INTERSECT SELECT n_nationkey FROM nation"),
    "precedence_tight": C("SELECT r_regionkey AS k FROM region UNION ALL SELECT n_regionkey FROM nation INTERSECT SELECT n_nationkey FROM nation", "SELECT r_regionkey AS k FROM region UNION ALL (SELECT n_regionkey FROM nation INTERSECT SELECT n_nationkey FROM nation)", semantics={"set_op_precedence": "except_intersect_tighter"}),
    "setop_order_limit": C("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region ORDER BY k DESC LIMIT 5"),
    # --- Q: CTEs and subqueries
    "cte": C("WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT COUNT(*) AS n FROM big WHERE s > 500000"),
    "cte_multi": C("WITH a AS (SELECT n_nationkey, n_regionkey FROM nation), b AS (SELECT n_regionkey, COUNT(*) AS n FROM a GROUP BY n_regionkey) SELECT r_name, n FROM b JOIN region ON n_regionkey = r_regionkey"),
    "cte_twice": C("WITH t AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation) SELECT a.k AS x, b.k AS y FROM t a JOIN t b ON a.r = b.r AND a.k + 5 = b.k"),
    "recursive_union_all": C("WITH RECURSIVE t AS (SELECT r_regionkey AS k, 0 AS depth FROM region WHERE r_regionkey = 0 UNION ALL SELECT k + 1, depth + 1 FROM t WHERE depth < 12) SELECT k, depth FROM t", "WITH RECURSIVE t(k, depth) AS (SELECT CAST(r_regionkey AS BIGINT), CAST(0 AS BIGINT) FROM region WHERE r_regionkey = 0 UNION ALL SELECT k + 1, depth + 1 FROM t WHERE depth < 12) SELECT k, depth FROM t"),
    "recursive_union": C("WITH RECURSIVE t AS (SELECT n_regionkey AS k FROM nation UNION SELECT (k * 3 + 1) % 11 FROM t) SELECT k FROM t", "WITH RECURSIVE t(k) AS (SELECT CAST(n_regionkey AS BIGINT) FROM nation UNION SELECT (k * 3 + 1) % 11 FROM t) SELECT k FROM t"),
    "recursive_tree": C("WITH RECURSIVE t AS (SELECT n_nationkey AS id, n_name AS path FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.path || '/' || n.n_name FROM nation n JOIN t ON n.n_nationkey / 2.0 >= t.id AND n.n_nationkey / 2.0 < t.id + 1 AND n.n_nationkey > t.id) SELECT id, path FROM t", "WITH RECURSIVE t(id, path) AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.path || '/' || n.n_name FROM nation n JOIN t ON n.n_nationkey / 2.0 >= t.id AND n.n_nationkey / 2.0 < t.id + 1 AND n.n_nationkey > t.id) SELECT id, path FROM t"),
    "scalar_subquery": C("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)"),
    "scalar_subquery_select": C("SELECT r_regionkey, (SELECT COUNT(*) FROM nation) AS n, (SELECT MAX(n_name) FROM nation WHERE n_nationkey < 0) AS none FROM region"),
    "exists": C("SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)"),
    "not_exists": C("SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND o.o_totalprice > 250000)"),
    "exists_uncorrelated": C("SELECT r_regionkey FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 20)"),
    "in_subquery": C("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "not_in_subquery": C("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT n_regionkey FROM nation)"),
    "not_in_subquery_null": C("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(s_nationkey, s_nationkey) FROM supplier)"),
    "corr_scalar": C("SELECT c.c_custkey, (SELECT MAX(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c"),
    "corr_scalar_filter": C("SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE l.l_quantity > (SELECT AVG(x.l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)"),
    "corr_in": C("SELECT c.c_custkey FROM customer c WHERE c.c_nationkey IN (SELECT s.s_nationkey FROM supplier s WHERE s.s_acctbal > c.c_acctbal)"),
    "lateral_top1": C("SELECT c.c_custkey, t.o_orderkey FROM customer c JOIN LATERAL (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 1) AS t ON TRUE"),
    "lateral_left": C("SELECT n.n_nationkey, t.m FROM nation n LEFT JOIN LATERAL (SELECT MAX(s.s_acctbal) AS m FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS t ON TRUE"),
    # --- F: functions
    "f_text": C("SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l, LENGTH(p_name) AS n, CONCAT(p_brand, '-', p_type) AS c, TRIM('  x ' || p_brand || '  ') AS t, SUBSTR(p_name, 2, 3) AS s, REPLACE(p_type, 'A', '') AS r FROM part", "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l, LENGTH(p_name) AS n, p_brand || '-' || p_type AS c, TRIM('  x ' || p_brand || '  ') AS t, SUBSTR(p_name, 2, 3) AS s, REPLACE(p_type, 'A', '') AS r FROM part"),
    "f_choice": C("SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), -1) AS c, IF(n_regionkey = 2, 'two', n_name) AS i, GREATEST(n_nationkey, n_regionkey, 5) AS g, LEAST(n_nationkey, NULLIF(n_regionkey, 0)) AS l FROM nation", "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), -1) AS c, CASE WHEN n_regionkey = 2 THEN 'two' ELSE n_name END AS i, GREATEST(n_nationkey, n_regionkey, 5) AS g, LEAST(n_nationkey, NULLIF(n_regionkey, 0)) AS l FROM nation"),
    "f_math": C("SELECT s_suppkey, ABS(s_acctbal) AS a, ROUND(s_acctbal, 1) AS r, FLOOR(s_acctbal) AS f, CEIL(s_acctbal) AS c, MOD(s_suppkey, 4) AS m, ROUND(POWER(s_suppkey, 0.5), 6) AS p FROM supplier"),
    "f_date_part": C("SELECT o_orderkey, DATE_PART('year', o_orderdate) AS y, EXTRACT('month', o_orderdate) AS m, DATE_PART('day', o_orderdate) AS d, DATE_PART('dow', o_orderdate) AS w, DATE_PART('doy', o_orderdate) AS n, DATE_PART('hour', o_orderdate) AS h FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, isodow(o_orderdate) AS w, dayofyear(o_orderdate) AS n, hour(o_orderdate) AS h FROM orders"),
    "f_date_trunc": C("SELECT event_id, DATE_TRUNC('hour', ts) AS h, DATE_TRUNC('day', ts) AS d, DATE_TRUNC('year', CAST(ts AS DATE)) AS y FROM events", "SELECT event_id, DATE_TRUNC('hour', ts) AS h, CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS d, CAST(DATE_TRUNC('year', ts) AS DATE) AS y FROM events"),
    "f_date_add": C("SELECT o_orderkey, DATE_ADD(CAST(o_orderdate AS DATE), 45) AS a, DATE_SUB(CAST(o_orderdate AS DATE), 45) AS b, DATE_ADD(o_orderdate, 2) AS c FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 45 AS a, CAST(o_orderdate AS DATE) - 45 AS b, o_orderdate + INTERVAL 2 DAY AS c FROM orders"),
    "f_date_diff": C("SELECT o_orderkey, DATE_DIFF('day', o_orderdate, DATE '1998-12-01') AS d, DATE_DIFF(DATE '1998-12-01', o_orderdate) AS e, DATE_DIFF('month', o_orderdate, DATE '1998-12-01') AS m, DATE_DIFF('year', o_orderdate, DATE '1998-12-01') AS y FROM orders", "SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '1998-12-01') AS d, date_diff('day', TIMESTAMP '1998-12-01', o_orderdate) AS e, date_diff('month', o_orderdate, TIMESTAMP '1998-12-01') AS m, date_diff('year', o_orderdate, TIMESTAMP '1998-12-01') AS y FROM orders"),
    "f_like_function": C("SELECT p_partkey FROM part WHERE LIKE(p_type, '%ECO%') OR ILIKE(p_name, 'L%')", "SELECT p_partkey FROM part WHERE p_type LIKE '%ECO%' OR p_name ILIKE 'l%'"),
    "f_aliases": C("SELECT n_nationkey, UCASE(n_name) AS u, LEN(n_name) AS l, NVL(NULLIF(n_regionkey, 1), 9) AS v, SUBSTRING(n_name, 1, 2) AS s, IIF(n_regionkey > 2, 1, 0) AS i, CEILING(n_nationkey) AS c FROM nation", "SELECT n_nationkey, UPPER(n_name) AS u, LENGTH(n_name) AS l, COALESCE(NULLIF(n_regionkey, 1), 9) AS v, SUBSTR(n_name, 1, 2) AS s, CASE WHEN n_regionkey > 2 THEN 1 ELSE 0 END AS i, n_nationkey AS c FROM nation"),
    "f_extras": C("SELECT l_returnflag, ROUND(STDDEV(l_quantity), 6) AS sd, CONCAT_WS('-', l_returnflag, l_linestatus) AS w FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    # --- X: extension lanes
    "x_function": C("SELECT c_custkey, SEGMENT_CODE(c_mktsegment) AS code FROM customer", "SELECT c_custkey, LOWER(SUBSTR(c_mktsegment, 1, 3)) AS code FROM customer", engine={"functions": {"SEGMENT_CODE": lambda a, s: F.lower(F.substring(a[0], 1, 3))}}),
    "x_effect_ci_eq": C("SELECT c_custkey FROM customer WHERE c_mktsegment = 'building'", "SELECT c_custkey FROM customer WHERE LOWER(c_mktsegment) = 'building'", engine={"effects": {"text_eq": lambda a, b, s: F.lower(a) == F.lower(b)}}),
    # --- dialects: surface and meaning
    "d_alien": C("SELECT n_name, n_regionkey::TEXT + '!' AS t FROM nation WHERE n_name LIKE '%a%' ORDERED BY n_name OFFSET 1 ROWS FETCH NEXT 5 ROWS ONLY", "SELECT n_name, CAST(n_regionkey AS VARCHAR) || '!' AS t FROM nation WHERE n_name ILIKE '%a%' ORDER BY n_name LIMIT 5 OFFSET 1", dialect="aggressive_alien"),
    "d_fetch_filter": C("FETCH o_orderstatus, COUNT(*) AS n FROM orders FILTER o_totalprice > 1000 PARTITION BY o_orderstatus", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus", dialect="mariadb_bigquery_oracle_rows"),
    "d_tsql": C("SELECT [c_name] + '/' + c_mktsegment AS t FROM customer WHERE c_mktsegment LIKE 'build%'", "SELECT c_name || '/' || c_mktsegment AS t FROM customer WHERE c_mktsegment ILIKE 'build%'", dialect="tsql_ish"),
    "d_postgres": C("SELECT n_nationkey, n_nationkey / 4 AS q FROM nation", "SELECT n_nationkey, n_nationkey // 4 AS q FROM nation", dialect="postgres_clone"),
    "d_sqlite_truthy": C("SELECT n_nationkey FROM nation WHERE n_regionkey ORDER BY n_nationkey", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 0", dialect="sqlite_clone"),
    "d_sample_tight": C("SELECT c_custkey FROM customer ORDER BY c_custkey SAMPLE 5;", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5", dialect="clickhouse_oracle_samplelimit"),
    "d_head": C("SELECT UNIQUE n_regionkey FROM nation ORDER BY n_regionkey | HEAD 3;", 'SELECT DISTINCT n_regionkey AS "N_REGIONKEY" FROM nation ORDER BY n_regionkey LIMIT 3', dialect="informix_firebird_firstn"),
    "d_spaceship": C("SELECT n_nationkey FROM nation WHERE n_regionkey MOD 3 <=> 1;", "SELECT n_nationkey FROM nation WHERE n_regionkey % 3 = 1", dialect="hive_teradata_nullsafe_wild"),
    "d_subtract_sort": C("SELECT n_nationkey FROM nation SUBTRACT SELECT n_regionkey FROM nation;", "SELECT n_nationkey FROM nation EXCEPT SELECT n_regionkey FROM nation", dialect="bigquery_server_maria_pipeorder"),
    "d_link_joins": C("SELECT n.n_name, r.r_name FROM nation n LEFT LINK region r ON n.n_regionkey = r.r_regionkey", "SELECT n.n_name, r.r_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey", dialect="postgres_sqlite_server_inside"),
    "d_convert": C("SELECT CONVERT(n_nationkey, CHAR) AS t FROM nation WHERE n_name <=> 'FRANCE' OR 1;", "SELECT CAST(n_nationkey AS VARCHAR) AS t FROM nation", dialect="moderate_mysql_loose"),
    "d_like_insensitive": C("SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'BUILD%'", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%'", semantics={"like_case_sensitive": False}),
    "d_upper_fold": C("SELECT n_nationkey AS key FROM nation;", 'SELECT n_nationkey AS "KEY" FROM nation', dialect="db2_snowflake_sqlite_rangefold"),
    # --- the published bench shapes on the events table
    "b_count_filtered": C("SELECT COUNT(*) AS n FROM events WHERE event_type = 'purchase'"),
    "b_top_groups": C("SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10"),
    "b_count_distinct": C("SELECT COUNT(DISTINCT user_id) AS users FROM events"),
    "b_year_substring": C("SELECT SUBSTRING(CAST(ts AS VARCHAR), 1, 4) AS year, COUNT(*) AS n FROM events WHERE event_type = 'click' GROUP BY year ORDER BY year"),
    "b_having_top": C("SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id HAVING COUNT(*) >= 3 ORDER BY n DESC, user_id LIMIT 20"),
    "b_like_or": C("SELECT COUNT(*) AS hits FROM events WHERE props LIKE '%a%' OR props LIKE '%z%' OR event_type LIKE 'p%'"),
    "b_case_buckets": C("SELECT CASE WHEN value > 100 THEN 'large' WHEN value > 10 THEN 'small' ELSE 'none' END AS bucket, COUNT(*) AS n FROM events GROUP BY bucket ORDER BY n DESC, bucket"),
    "b_in_subquery": C("SELECT event_type, COUNT(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90) AND event_type <> 'purchase' GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10"),
    "b_row_number": C("SELECT user_id, event_id FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) AS t WHERE rn = 1 ORDER BY user_id LIMIT 10"),
    "b_cte": C("WITH u AS (SELECT user_id, COUNT(*) AS c FROM events GROUP BY user_id) SELECT COUNT(*) AS active FROM u WHERE c >= 5"),
    "b_union": C("SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'click'"),
    "b_sum_arith": C("SELECT user_id, ROUND(SUM(value), 2) AS a, COUNT(*) AS b, ROUND(SUM(value) - COUNT(*), 2) AS net FROM events GROUP BY user_id ORDER BY net DESC, user_id LIMIT 10"),
    "b_month_buckets": C("SELECT SUBSTRING(CAST(ts AS VARCHAR), 1, 7) AS month, COUNT(*) AS n FROM events GROUP BY month ORDER BY month"),
    "b_distinct_pairs": C("SELECT DISTINCT event_type, user_id FROM events ORDER BY event_type, user_id"),
    "b_distinct_per_group": C("SELECT user_id, COUNT(DISTINCT event_type) AS kinds FROM events GROUP BY user_id ORDER BY kinds DESC, user_id LIMIT 20"),
}


def _parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S2: a table through the Parquet sink and back, in the shared folder."""
    return store(Catalog.parquet(spark, sf_dir, TABLES).get("supplier"))[0]


def _literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: an in-memory table with an explicit schema, joined with a stored one."""
    grades = literal_table(spark, [(0, "low", None), (1, "mid", 1.5), (2, "high", 2)], {"k": "INT", "grade": "TEXT", "w": "FLOAT"})
    catalog = Catalog.parquet(spark, sf_dir, TABLES)
    catalog.put("grades", grades)
    return Engine(spark, REFERENCE, catalog).sql("SELECT n_name, grade, w FROM nation JOIN grades ON n_regionkey = k")


def _sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5: nation through a SQLite file on the driver."""
    rows = [tuple(r) for r in Catalog.parquet(spark, sf_dir, TABLES).get("nation").collect()]  # 25 rows
    with tempfile.TemporaryDirectory() as d:
        con = sqlite3.connect(f"{d}/n.db")
        con.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey BIGINT)")
        con.executemany("INSERT INTO nation VALUES (?, ?, ?)", rows)
        con.commit()
        con.close()
        return Engine(spark, REFERENCE, sqlite_tables(spark, f"{d}/n.db")).sql("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey")


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6: region as a line of a JSON-tables file."""
    df = Catalog.parquet(spark, sf_dir, TABLES).get("region")
    row = F.array(F.col("r_regionkey").cast("string"), F.col("r_name"))
    line = df.agg(F.collect_list(row).alias("rows")).select(F.to_json(F.struct(F.lit("t").alias("id"), F.array(F.lit("key"), F.lit("name")).alias("header"), F.array(F.lit("real"), F.lit("text")).alias("types"), "rows")))
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    line.write.text(path)
    return json_tables(spark, path)["t"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7: the seeded event generator."""
    return Engine(spark, REFERENCE, {"github_events": event_table(spark, 5000)}).sql("SELECT event_type, COUNT(*) AS n, SUM(additions) AS a, MIN(created_at) AS first FROM github_events GROUP BY event_type")


def _events_sql() -> str:
    draw = lambda salt, n: f"CAST('0x' || substr(md5('219:{salt}:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % {n}"
    upto, kinds = 0, []
    for name, weight in EVENT_TYPES.items():
        upto += weight
        kinds.append(f"WHEN pick < {upto} THEN '{name}'")
    return f"""
SELECT event_type, COUNT(*) AS n, CAST(SUM(CASE WHEN event_type IN ('PushEvent', 'PullRequestEvent') THEN additions ELSE 0 END) AS BIGINT) AS a, MIN(created_at) AS first
FROM (SELECT CASE {" ".join(kinds)} END AS event_type, additions, strftime(TIMESTAMP '2015-01-01' + to_days(CAST(d AS INTEGER)) + to_seconds(s), '%Y-%m-%d %H:%M:%S') AS created_at
      FROM (SELECT {draw("type", upto)} AS pick, {draw("additions", 400)} AS additions, {draw("day", 11 * 365)} AS d, {draw("second", 86400)} AS s
            FROM (SELECT range AS id FROM range(5000))))
GROUP BY event_type"""


CASES |= {
    "w_lag_default": C("SELECT o_orderkey, LAG(NULLIF(o_custkey % 3, 0), 1, 99) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS b, LAG(o_custkey, 2, -1) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS b2 FROM orders"),
    "w_lead_default": C("SELECT o_orderkey, LEAD(NULLIF(o_custkey % 3, 0), 1, 99) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS b, LEAD(o_custkey, 3, o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS b3 FROM orders"),
    "w_lag_ignore_nulls_2": C(
        "SELECT o_orderkey, LAG(NULLIF(o_custkey % 3, 0), 2) IGNORE NULLS OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS a, LEAD(NULLIF(o_custkey % 3, 0), 2, 99) IGNORE NULLS OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS b FROM orders",
        "SELECT o_orderkey, LAG(NULLIF(o_custkey % 3, 0), 2 IGNORE NULLS) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS a, LEAD(NULLIF(o_custkey % 3, 0), 2, 99 IGNORE NULLS) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS b FROM orders",
    ),
    "corr_scalar_group": C("SELECT c_custkey, (SELECT SUM(o_shippriority_free) FROM (SELECT o_custkey, 1 AS o_shippriority_free FROM orders) AS o WHERE o.o_custkey = c.c_custkey GROUP BY o.o_custkey) AS n FROM customer c", "SELECT c_custkey, (SELECT CAST(SUM(1) AS BIGINT) FROM orders o WHERE o.o_custkey = c.c_custkey GROUP BY o.o_custkey) AS n FROM customer c"),
    "recursive_beside_cte": C("WITH RECURSIVE base AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1), r AS (SELECT k, 1 AS d FROM base UNION ALL SELECT k + 100, d + 1 FROM r WHERE d < 4), t AS (SELECT d, COUNT(*) AS n FROM r GROUP BY d) SELECT d, n FROM t", "WITH RECURSIVE base AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1), r AS (SELECT k, CAST(1 AS BIGINT) AS d FROM base UNION ALL SELECT k + 100, d + 1 FROM r WHERE d < 4), t AS (SELECT d, COUNT(*) AS n FROM r GROUP BY d) SELECT d, n FROM t"),
    "f_date_diff_units": C(
        "SELECT " + ", ".join(f"DATE_DIFF('{u}', TIMESTAMP '2024-01-31 22:30:15', ts) AS {u}s" for u in ("second", "minute", "hour", "day", "week", "month", "quarter", "year")) + ", event_id FROM events",
        "SELECT "
        + ", ".join(f"CAST(trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-31 22:30:15')) / {n}000000.0) AS BIGINT) AS {u}s" for u, n in (("second", 1), ("minute", 60), ("hour", 3600)))
        + ", date_diff('day', DATE '2024-01-31', CAST(ts AS DATE)) AS days, CAST(trunc(date_diff('day', DATE '2024-01-31', CAST(ts AS DATE)) / 7.0) AS BIGINT) AS weeks, date_diff('month', DATE '2024-01-31', CAST(ts AS DATE)) AS months, CAST(trunc(date_diff('month', DATE '2024-01-31', CAST(ts AS DATE)) / 3.0) AS BIGINT) AS quarters, date_diff('year', DATE '2024-01-31', CAST(ts AS DATE)) AS years, event_id FROM events",
    ),
    "f_date_trunc_time": C("SELECT event_id, DATE_TRUNC('hour', ts) AS h, DATE_TRUNC('minute', ts) AS m, DATE_TRUNC('second', ts) AS s, DATE_TRUNC('day', ts) AS d, DATE_TRUNC('week', ts) AS w FROM events", "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS m, CAST(date_trunc('second', ts) AS TIMESTAMP) AS s, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, CAST(date_trunc('week', ts) AS TIMESTAMP) AS w FROM events"),
    "join_anti_theta": C("SELECT n_nationkey FROM nation LEFT ANTI JOIN region ON n_regionkey > r_regionkey + 1", "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE n_regionkey > r_regionkey + 1)"),
    "x_effect_neq": C("SELECT n_nationkey FROM nation WHERE n_name <> 'x'", "SELECT n_nationkey FROM nation WHERE lower(n_name) <> 'x'", engine={"effects": {"text_neq": lambda a, b, s: F.lower(a) != F.lower(b)}}),
    "w_global_aggregates": C("SELECT n_nationkey, COUNT(*) OVER () AS n, ROUND(AVG(n_regionkey) OVER (), 6) AS a, MIN(n_name) OVER () AS lo FROM nation"),
    "top_n": C("SELECT TOP 4 c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 4", dialect=REFERENCE.with_surface(limit_syntax="top_n")),
    "try_cast": C("SELECT TRY_CAST(p_name AS INT) AS bad, TRY_CAST(p_size AS TEXT) AS t, p_partkey FROM part", "SELECT TRY_CAST(p_name AS BIGINT) AS bad, CAST(p_size AS VARCHAR) AS t, p_partkey FROM part"),
    "x_pass_ties": C("SELECT p_partkey FROM part ORDER BY p_size LIMIT 2", "SELECT p_partkey FROM (SELECT p_partkey, RANK() OVER (ORDER BY p_size) AS r FROM part) WHERE r <= 2", engine={"passes": [limit_with_ties]}),
    "x_operator": C("SELECT n_nationkey, DOUBLED(n_regionkey) AS d FROM nation", "SELECT n_nationkey, n_regionkey * 2 AS d FROM nation", engine={"operators": {"DOUBLED": lambda a, s: a[0] * 2}}),
    "x_effect_like": C("SELECT n_nationkey FROM nation WHERE n_name LIKE 'N'", "SELECT n_nationkey FROM nation WHERE starts_with(n_name, 'N')", engine={"effects": {"text_in_pattern": lambda x, p, s, cs: F.startswith(x, p)}}),
    "w_ntile": C("SELECT o_orderkey, NTILE(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS q FROM orders"),
    "a_group_concat": C("SELECT o_orderstatus, LENGTH(GROUP_CONCAT(o_orderpriority)) AS n, LENGTH(GROUP_CONCAT(DISTINCT o_orderpriority, '; ')) AS d, LENGTH(STRING_AGG(o_orderpriority, '') FILTER (WHERE o_custkey % 2 = 0)) AS f FROM orders GROUP BY o_orderstatus"),
    "f_choice_more": C(
        "SELECT n_nationkey, NVL2(NULLIF(n_regionkey, 1), 'has', 'none') AS v, DECODE(n_regionkey, 0, 'zero', 2, 'two', 'other') AS d, DECODE(NULLIF(n_regionkey, 1), NULL, 'null', 3, 'three') AS e FROM nation",
        "SELECT n_nationkey, CASE WHEN n_regionkey <> 1 THEN 'has' ELSE 'none' END AS v, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 2 THEN 'two' ELSE 'other' END AS d, CASE WHEN n_regionkey = 1 THEN 'null' WHEN n_regionkey = 3 THEN 'three' END AS e FROM nation",
    ),
    "f_text_more": C(
        "SELECT p_partkey, INSTR(p_name, 'e') AS i, TO_DATE('1996-02-29') AS d, TO_DATE(p_name) AS bad, TYPEOF(p_size) AS k, TYPEOF(p_name) AS t FROM part",
        "SELECT p_partkey, INSTR(p_name, 'e') AS i, DATE '1996-02-29' AS d, CAST(NULL AS DATE) AS bad, 'int' AS k, 'text' AS t FROM part",
    ),
    "div_error": C("SELECT s_suppkey, s_acctbal / (s_nationkey + 1) AS q FROM supplier", semantics={"division_by_zero": "error"}),
    "w_no_order": C("SELECT n_nationkey, SUM(n_nationkey) OVER () AS s, MAX(n_name) OVER (PARTITION BY n_regionkey) AS m FROM nation", "SELECT n_nationkey, CAST(SUM(n_nationkey) OVER () AS BIGINT) AS s, MAX(n_name) OVER (PARTITION BY n_regionkey) AS m FROM nation"),
}

#: Sources and sinks: (query, DuckDB's SQL or None).
SOURCES = {
    "source_parquet_round_trip": (_parquet_round_trip, "SELECT * FROM supplier"),
    "source_literal": (_literal, "SELECT n_name, grade, w FROM nation JOIN (VALUES (0, 'low', CAST(NULL AS DOUBLE)), (1, 'mid', 1.5), (2, 'high', 2.0)) AS g(k, grade, w) ON n_regionkey = k"),
    "source_sqlite": (_sqlite, "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, COUNT(*) AS n FROM nation GROUP BY 1"),
    "source_json_tables": (_json, "SELECT CAST(r_regionkey AS DOUBLE) AS key, r_name AS name FROM region"),
    "source_event_generator": (_events, _events_sql()),
}
