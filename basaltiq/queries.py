"""The registered queries of the relational engine, each with its SQL for an independent engine.

Where both engines take the same text, one text serves; where their syntax or
types differ, the two texts stand side by side. Operators that have a function
here are called through it, statements that write through the engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import compat as C
from .operators import relational as R
from .plans.engine import Connection, Engine
from .sources import entities, journal, jsondocs, modeldsl

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FLAGSHIP = """SELECT n_name, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'F' GROUP BY n_name HAVING COUNT(*) > 10 ORDER BY revenue DESC, n_name LIMIT 10"""

_queries: dict[str, Callable] = {}
_oracles: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    e = Engine(spark)
    for n in names:
        e.register(n, load(spark, sf_dir, n))
    return e


def both(name: str, sql: str, oracle: str | None = None, *params) -> None:
    """A query through the engine's SQL; the oracle's text is the same unless given."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    _queries[name] = lambda spark, sf_dir: engine(spark, sf_dir, *used).query(sql, *params)
    _oracles[name] = oracle or sql


def frame(oracle: str | None):
    """A query in DataFrame form, with the oracle's text."""

    def put(f):
        _queries[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = oracle
        return f

    return put


both("flagship", FLAGSHIP)

# scans and sources
both("scan_all", "SELECT * FROM nation")
both("point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
both("range_gt", "SELECT o_orderkey FROM orders WHERE o_orderkey > 59000")
both("range_ge_lt", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
both("range_between", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 300")
both("values_row", "SELECT 1 AS one, 'x' AS two")
both("derived_table", "SELECT a.k, a.n FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) AS a WHERE a.n > 3")
both("cte_simple", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey")
both("cte_chained", "WITH a AS (SELECT n_nationkey, n_regionkey FROM nation), b AS (SELECT n_regionkey, COUNT(*) AS n FROM a GROUP BY n_regionkey) SELECT r_name, n FROM b JOIN region ON r_regionkey = n_regionkey")
both("cte_columns", "WITH t(k, label) AS (SELECT n_nationkey, n_name FROM nation) SELECT k, label FROM t WHERE k < 5")
both("recursive_seq", "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 120) SELECT n FROM s")
both("recursive_hierarchy", "WITH RECURSIVE h(k, up, depth) AS (SELECT o_orderkey, o_orderkey DIV 2, 1 FROM orders WHERE o_orderkey = 1 UNION ALL SELECT o.o_orderkey, o.o_orderkey DIV 2, h.depth + 1 FROM orders o JOIN h ON o.o_orderkey DIV 2 = h.k WHERE h.depth < 6 AND o.o_orderkey > 1) SELECT k, up, depth FROM h", "WITH RECURSIVE h(k, up, depth) AS (SELECT o_orderkey, o_orderkey // 2, 1 FROM orders WHERE o_orderkey = 1 UNION ALL SELECT o.o_orderkey, o.o_orderkey // 2, h.depth + 1 FROM orders o JOIN h ON o.o_orderkey // 2 = h.k WHERE h.depth < 6 AND o.o_orderkey > 1) SELECT k, up, depth FROM h")

# projection, filter, predicates
both("project_expr", "SELECT p_partkey, p_size * 2 + 1 AS twice, p_size - 3 AS less FROM part")
both("filter_and_or_not", "SELECT p_partkey FROM part WHERE (p_size > 40 OR p_brand = 'Brand#11') AND NOT p_size = 45")
both("compare_all", "SELECT c_custkey, c_acctbal >= 0 AS ge, c_acctbal < 1000 AS lt, c_nationkey <> 3 AS ne, c_nationkey <= 9 AS le FROM customer")
both("like", "SELECT c_custkey FROM customer WHERE c_name LIKE '%00_1%'")
both("not_like", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT LIKE 'B%'")
both("ilike", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%'")
both("not_ilike", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT ILIKE '%ER%'")
both("between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
both("not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20")
both("in_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)")
both("not_in_list_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality NOT IN (0, NULL) OR l.quality IN (1, NULL)")
both("is_null", "SELECT d.doc_id, l.toxic IS NULL AS missing, l.toxic IS NOT NULL AS there FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
both("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT MAX(o_orderkey) - 50 FROM orders)")
both("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
both("not_in_subquery", "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT l.doc_id FROM labels l WHERE l.doc_id IS NOT NULL)")
both("exists", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000)")
both("not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
both("exists_uncorrelated", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_name = 'none')")
both("parentheses", "SELECT p_partkey, (p_size + 1) * (p_size - 1) AS v FROM part WHERE ((p_size) > (10))")
both("params", "SELECT p_partkey FROM part WHERE p_size > $1 AND p_brand = $2", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_brand = 'Brand#13'", 10, "Brand#13")
both("case_and_distinct_from", "SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'yes' WHEN l.toxic = 0 THEN 'no' ELSE 'none' END AS said, l.toxic IS DISTINCT FROM 1 AS other, d.lang || '-' || d.source AS tag FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
LABELLED = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"

# joins
both("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000")
both("join_left", f"SELECT d.doc_id, l.toxic FROM {LABELLED}")
both("join_right", "SELECT d.doc_id, l.toxic FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
both("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey * 40")
both("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
both("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
both("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
both("join_left_theta", "SELECT r.r_regionkey AS r, n.n_nationkey AS n FROM region r LEFT JOIN nation n ON n.n_nationkey > r.r_regionkey + 20")
both("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
both("join_multi", "SELECT r_name, COUNT(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
both("join_using", "SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)")
both("join_on_timestamp", "SELECT COUNT(*) AS n FROM orders JOIN lineitem ON o_orderdate = l_shipdate AND o_orderkey = l_orderkey")


@frame("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    return R.join(c, o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@frame("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    return R.join(c, o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@frame("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_guarded(spark, sf_dir):
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    return R.guarded_join(n, r, n.n_regionkey == r.r_regionkey, 1000).select("n_name", "r_name")


@frame("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic IS NOT NULL)")
def not_in_null_blind(spark, sf_dir):
    d, l = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").filter("toxic is not null").select(F.col("doc_id").alias("k"))
    return R.not_in_subquery(d, d.doc_id, l, blind=True).select("doc_id")


# aggregates
both("group_by", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY l_returnflag, l_linestatus")
both("group_by_null", f"SELECT l.toxic AS toxic, COUNT(*) AS n FROM {LABELLED} GROUP BY l.toxic")
both("global_agg", "SELECT COUNT(*) AS n, MIN(l_quantity) AS least, MAX(l_quantity) AS most FROM lineitem")
both("agg_empty", "SELECT COUNT(*) AS n, SUM(o_orderkey) AS s, AVG(o_totalprice) AS a, MIN(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS s, AVG(o_totalprice) AS a, MIN(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0")
both("count_star", "SELECT COUNT(*) AS n FROM lineitem")
both("count_col", f"SELECT COUNT(l.toxic) AS n, COUNT(*) AS every FROM {LABELLED}")
both("count_distinct", "SELECT COUNT(DISTINCT o_custkey) AS n, COUNT(DISTINCT o_orderdate) AS days FROM orders")
both("sum_int", "SELECT o_orderstatus, SUM(o_orderkey) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(SUM(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
both("sum_distinct", "SELECT SUM(DISTINCT l_linenumber) AS s FROM lineitem", "SELECT CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem")
both("avg", "SELECT p_brand, AVG(p_size) AS a FROM part GROUP BY p_brand")
both("avg_distinct", "SELECT AVG(DISTINCT p_size) AS a FROM part")
both("min_max_text", "SELECT MIN(c_name) AS a, MAX(c_mktsegment) AS b, MIN(c_acctbal) AS c FROM customer")
both("having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) BETWEEN 12 AND 30")
both("agg_in_expr", "SELECT p_brand, SUM(p_size) / COUNT(*) AS mean, MAX(p_size) - MIN(p_size) AS spread FROM part GROUP BY p_brand")
both("group_by_expr", "SELECT p_size % 7 AS r, COUNT(*) AS n FROM part GROUP BY p_size % 7")
both("rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")


@frame("SELECT COALESCE(CAST(SUM(o_orderkey) AS BIGINT), 0) AS s FROM orders WHERE o_orderkey < 0")
def sum_empty_is_zero(spark, sf_dir):
    return load(spark, sf_dir, "orders").filter("o_orderkey < 0").agg(C.sum0(F.col("o_orderkey")).alias("s"))


# windows
RANK = "RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC)"
both("row_number", "SELECT conv_id, turn, CAST(ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS n FROM conversations")
both("rank", f"SELECT p_partkey, CAST({RANK} AS BIGINT) AS r FROM part")
both("rank_top", f"SELECT * FROM (SELECT p_partkey, p_brand, CAST({RANK} AS BIGINT) AS r FROM part) x WHERE r <= 2")
both("window_in_expr", "SELECT p_partkey, CAST(ROW_NUMBER() OVER (ORDER BY p_retailprice, p_partkey) * 10 + 1 AS BIGINT) AS a, CAST(RANK() OVER (ORDER BY p_size) AS BIGINT) AS b FROM part")
both("window_more", "SELECT p_partkey, CAST(DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d, LAG(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS prev, LEAD(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS next, FIRST_VALUE(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS first, CAST(NTILE(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS quarter FROM part")
both("window_frame", "SELECT p_partkey, CAST(SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, COUNT(*) OVER (PARTITION BY p_brand) AS n FROM part")


@frame(f"SELECT doc_id, CAST(ROW_NUMBER() OVER (PARTITION BY lang ORDER BY toxic DESC NULLS FIRST, doc_id ASC NULLS LAST) AS BIGINT) AS n FROM (SELECT d.doc_id, d.lang, l.toxic FROM {LABELLED}) x")
def window_null_order(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.row_number().over(R.window(["lang"], [("toxic", True), ("doc_id", False)])).cast("bigint").alias("n"))


# sort, limit, distinct
both("order_multi", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand ASC, p_size DESC, p_partkey LIMIT 40")
both("order_expr", "SELECT p_partkey FROM part ORDER BY p_size * -1, p_partkey LIMIT 25")
both("order_alias_ordinal", "SELECT p_partkey, p_size + 1 AS bigger FROM part ORDER BY bigger DESC, 1 LIMIT 25")
both("limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")
both("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
both("offset_only", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
both("distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
both("distinct_null", f"SELECT DISTINCT l.toxic, l.quality FROM {LABELLED}")


@frame(f"SELECT d.doc_id, l.toxic FROM {LABELLED} ORDER BY l.toxic ASC NULLS LAST, d.doc_id ASC LIMIT 300")
def order_nulls(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "toxic")
    return R.top(d, [("toxic", False), ("doc_id", False)], 300)


@frame(f"SELECT d.doc_id, l.toxic FROM {LABELLED} ORDER BY l.toxic DESC NULLS FIRST, d.doc_id ASC LIMIT 30 OFFSET 10")
def order_nulls_desc(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "toxic")
    return R.top(d, [("toxic", True), ("doc_id", False)], 30, 10)


@frame("SELECT o_custkey, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) x WHERE n = 1")
def distinct_on(spark, sf_dir):
    return R.distinct_on(load(spark, sf_dir, "orders"), ["o_custkey"], [("o_totalprice", True), ("o_orderkey", False)]).select("o_custkey", "o_orderkey")


# set operations
both("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
both("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
both("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
both("intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier")
both("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
both("set_chain", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000 UNION ALL SELECT r_regionkey FROM region")


@frame("WITH RECURSIVE r(k) AS (SELECT 1 UNION SELECT (k * 3) % 50 FROM r) SELECT CAST(k AS BIGINT) AS k FROM r")
def recursive_distinct(spark, sf_dir):
    return R.recursive(spark, spark.range(1, 2).toDF("k"), lambda d: d.select(F.pmod(F.col("k") * 3, F.lit(50)).cast("bigint")))


# scalar functions
both("int_div", "SELECT o_orderkey, (0 - o_orderkey) DIV 7 AS q FROM orders", "SELECT o_orderkey, (0 - o_orderkey) // 7 AS q FROM orders")
both("modulo", "SELECT o_orderkey, (0 - o_orderkey) % 7 AS r FROM orders")
both("mixed_arith", "SELECT p_partkey, p_size + 0.5E0 AS a, -p_size AS b, p_size * 2 - p_partkey AS c FROM part")
both("null_arith", f"SELECT d.doc_id, l.toxic + 1 AS a, l.toxic * NULL AS b FROM {LABELLED}", f"SELECT d.doc_id, l.toxic + 1 AS a, CAST(NULL AS INTEGER) AS b FROM {LABELLED}")
both("upper", "SELECT c_custkey, UPPER(c_mktsegment) AS u FROM customer")
both("lower", "SELECT c_custkey, LOWER(c_name) AS u FROM customer")
both("coalesce", f"SELECT d.doc_id, COALESCE(l.toxic, l.quality, -1) AS v FROM {LABELLED}")
both("now_not_null", "SELECT n_nationkey, NOW() IS NOT NULL AS there FROM nation")
both("version_not_null", "SELECT VERSION() IS NOT NULL AS there")
both("json_arrow", "SELECT event_id, props -> 'k' AS k FROM events", "SELECT event_id, CAST(props -> 'k' AS VARCHAR) AS k FROM events")
both("json_arrow_text", "SELECT event_id, props ->> 'k' AS k FROM events WHERE props ->> 'k' IS NOT NULL")
both("json_chain", """SELECT n_nationkey, '{"a":{"b":[7,8]}}' -> 'a' -> 'b' ->> 1 AS v, '{"a":1}' ->> 'z' AS none FROM nation""")
both("cast_text_date", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS t, CAST(o_orderdate AS DATE) AS d, CAST('12' AS INT) + 1 AS n FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS t, CAST(o_orderdate AS DATE) AS d, CAST('12' AS INT) + 1 AS n FROM orders")
both("array_index", "SELECT vec_id, embedding[0] AS a, ARRAY[3, 4][1] AS b FROM embeddings", "SELECT vec_id, embedding[1] AS a, 4 AS b FROM embeddings")


@frame("SELECT doc_id, strlen(text) AS bytes, length(text) AS chars FROM documents")
def length_bytes(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", C.length_bytes(F.col("text")).alias("bytes"), F.length("text").cast("bigint").alias("chars"))


@frame(f"SELECT d.doc_id FROM {LABELLED} WHERE NOT COALESCE(l.quality = 1, FALSE)")
def two_valued_not(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return d.filter(~C.eq2v(F.col("quality"), F.lit(1))).select("doc_id")


# views, definitions, writes, transactions
def stated(name: str, tables: tuple, statements: list, sql: str, oracle: str) -> None:
    """A query after statements of the engine."""

    def run(spark, sf_dir):
        e = engine(spark, sf_dir, *tables)
        for s in statements:
            e.execute(s)
        return e.query(sql)

    _queries[name] = run
    _oracles[name] = oracle


EVERY_NATION = "SELECT n_nationkey AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS r FROM nation"
MAKE = ["CREATE TABLE t (k INTEGER PRIMARY KEY, name TEXT NOT NULL, r INTEGER DEFAULT 7)", "INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation"]
LONG = EVERY_NATION.replace("n_nationkey AS k", "CAST(n_nationkey AS BIGINT) AS k")
stated("view_scan", ("customer",), ["CREATE VIEW rich (id, bal) AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000"], "SELECT id, bal FROM rich", "SELECT c_custkey AS id, c_acctbal AS bal FROM customer WHERE c_acctbal > 9000")
stated("view_replace", ("region",), ["CREATE VIEW v AS SELECT 1 AS x", "CREATE OR REPLACE VIEW v AS SELECT r_name AS x FROM region"], "SELECT x FROM v", "SELECT r_name AS x FROM region")
stated("insert_values", (), ["CREATE TABLE t (id INTEGER, x FLOAT, s TEXT)", "INSERT INTO t VALUES (1, 1.5, 'a'), (-2, 3, NULL)"], "SELECT * FROM t", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(1.5 AS DOUBLE), 'a'), (-2, 3, NULL)) v(id, x, s)")
stated("insert_select", ("nation",), MAKE, "SELECT * FROM t", LONG)
stated("insert_defaults", (), ["CREATE TABLE t (id INTEGER, v INTEGER DEFAULT 7, s TEXT)", "INSERT INTO t (s, id) VALUES ('a', 1), ('b', 2)"], "SELECT * FROM t", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(7 AS BIGINT), 'a'), (2, 7, 'b')) v(id, v, s)")
stated("update_expr", ("nation",), [*MAKE, "UPDATE t SET r = r * 10 + k, name = LOWER(name) WHERE k % 2 = 0"], "SELECT * FROM t", f"SELECT k, CASE WHEN k % 2 = 0 THEN LOWER(name) ELSE name END AS name, CASE WHEN k % 2 = 0 THEN r * 10 + k ELSE r END AS r FROM ({LONG}) x")
stated("delete_where", ("nation",), [*MAKE, "DELETE FROM t WHERE r = 1 OR name LIKE 'A%'"], "SELECT * FROM t", f"SELECT * FROM ({LONG}) x WHERE NOT (r = 1 OR name LIKE 'A%')")
stated("alter_add_column", ("nation",), [*MAKE, "ALTER TABLE t ADD COLUMN flag BOOLEAN DEFAULT true"], "SELECT * FROM t", f"SELECT *, TRUE AS flag FROM ({LONG}) x")
stated("alter_drop_column", ("nation",), [*MAKE, "ALTER TABLE t DROP COLUMN r"], "SELECT * FROM t", f"SELECT k, name FROM ({LONG}) x")
stated("alter_rename_column", ("nation",), [*MAKE, "ALTER TABLE t RENAME COLUMN name TO label"], "SELECT * FROM t", f"SELECT k, name AS label, r FROM ({LONG}) x")
stated("rename_table", ("nation",), [*MAKE, "ALTER TABLE t RENAME TO u"], "SELECT * FROM u", LONG)
stated("create_drop_if", ("region",), ["CREATE TABLE a (x INTEGER)", "CREATE TABLE IF NOT EXISTS a (y TEXT)", "DROP TABLE IF EXISTS b", "INSERT INTO a VALUES (1)"], "SELECT * FROM a", "SELECT CAST(1 AS BIGINT) AS x")
stated("create_index", ("nation",), [*MAKE, "CREATE UNIQUE INDEX i ON t (name)"], "SELECT * FROM t WHERE name = 'CHINA' OR k = 3", f"SELECT * FROM ({LONG}) x WHERE name = 'CHINA' OR k = 3")
stated("txn_commit", ("nation",), [*MAKE, "BEGIN", "UPDATE t SET r = 0 WHERE k < 5", "DELETE FROM t WHERE k > 20", "COMMIT"], "SELECT * FROM t", f"SELECT k, name, CASE WHEN k < 5 THEN 0 ELSE r END AS r FROM ({LONG}) x WHERE k <= 20")
stated("txn_rollback", ("nation",), [*MAKE, "BEGIN", "DELETE FROM t WHERE k > 2", "ROLLBACK"], "SELECT * FROM t", LONG)
stated("coercion", (), ["CREATE TABLE t (i INTEGER, d DATE, ts TIMESTAMP, a INTEGER[], j JSON, b BOOL)", "INSERT INTO t VALUES (3.9, '2024-02-03', '2024-02-03T04:05:06', '{1,2,3}', '{\"k\": 1}', true)"], "SELECT i, d, CAST(ts AS STRING) AS ts, a[2] AS third, j ->> 'k' AS k, b FROM t", "SELECT CAST(3 AS BIGINT) AS i, DATE '2024-02-03' AS d, '2024-02-03 04:05:06' AS ts, CAST(3 AS BIGINT) AS third, '1' AS k, TRUE AS b")


def refused(name: str, tables: tuple, statements: list, last: str) -> None:
    """One row: the kind of error that the last statement meets, and the rows of t after it."""

    def run(spark, sf_dir):
        e = engine(spark, sf_dir, *tables)
        for s in statements:
            e.execute(s)
        try:
            e.execute(last)
            kind = "none"
        except Exception as x:  # noqa: BLE001  its kind is the result
            kind = type(x).__name__
        return e.query(f"SELECT '{kind}' AS error, COUNT(*) AS n FROM t")

    _queries[name] = run
    _oracles[name] = "SELECT 'ConstraintViolation' AS error, COUNT(*) AS n FROM nation"


refused("pk_violation", ("nation",), MAKE, "INSERT INTO t VALUES (3, 'again', 1)")
refused("not_null_violation", ("nation",), MAKE, "INSERT INTO t (k) VALUES (99)")
refused("unique_violation", ("nation",), [*MAKE, "CREATE UNIQUE INDEX i ON t (name)"], "UPDATE t SET name = 'x' WHERE k < 3")
refused("check_violation", ("nation",), ["CREATE TABLE t (k INTEGER CHECK (k >= 0), name TEXT)", "INSERT INTO t SELECT n_nationkey, n_name FROM nation"], "INSERT INTO t VALUES (-1, 'x')")
refused("fk_insert", ("nation", "region"), ["CREATE TABLE p (id INTEGER PRIMARY KEY)", "INSERT INTO p SELECT r_regionkey FROM region", "CREATE TABLE t (k INTEGER, r INTEGER REFERENCES p(id))", "INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation"], "INSERT INTO t VALUES (99, 77)")
refused("fk_restrict", ("nation", "region"), ["CREATE TABLE p (id INTEGER PRIMARY KEY)", "INSERT INTO p SELECT r_regionkey FROM region", "CREATE TABLE t (k INTEGER, r INTEGER REFERENCES p(id))", "INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation"], "DELETE FROM p WHERE id = 1")


refused("check_in_update", ("nation",), ["CREATE TABLE t (k INTEGER CHECK (k >= 0), name TEXT)", "INSERT INTO t SELECT n_nationkey, n_name FROM nation"], "UPDATE t SET k = k - 3")
stated("names_in_any_case", ("nation",), [*MAKE, "SELECT COUNT(*) FROM T", "INSERT INTO T VALUES (100, 'x', 1)", "UPDATE T SET R = 5 WHERE K = 100"], "SELECT COUNT(*) AS n, MAX(T.K) AS k, SUM(r) AS r FROM T", "SELECT COUNT(*) + 1 AS n, CAST(100 AS BIGINT) AS k, CAST(SUM(n_regionkey) + 5 AS BIGINT) AS r FROM nation")
stated("delete_by_subquery", ("nation", "region"), [*MAKE, "DELETE FROM t WHERE r IN (SELECT r_regionkey FROM region WHERE r_name < 'B')"], "SELECT * FROM t", f"SELECT * FROM ({LONG}) x WHERE r NOT IN (SELECT r_regionkey FROM region WHERE r_name < 'B')")
stated("update_by_subquery", ("nation", "region"), [*MAKE, "UPDATE t SET r = (SELECT MAX(r_regionkey) FROM region) + k WHERE k > (SELECT AVG(r_regionkey) FROM region)"], "SELECT * FROM t", f"SELECT k, name, CASE WHEN k > (SELECT AVG(r_regionkey) FROM region) THEN (SELECT MAX(r_regionkey) FROM region) + k ELSE r END AS r FROM ({LONG}) x")
stated("cte_hides_a_table", ("nation",), MAKE, "WITH t AS (SELECT * FROM t WHERE k < 9), u AS (SELECT k FROM t) SELECT COUNT(*) AS n FROM u", "SELECT COUNT(*) AS n FROM nation WHERE n_nationkey < 9")
stated("view_over_a_view", ("nation",), [*MAKE, "CREATE VIEW a AS SELECT k, r FROM t WHERE k > 3", "CREATE VIEW b AS SELECT r, COUNT(*) AS n FROM a GROUP BY r", "DELETE FROM t WHERE k = 4"], "SELECT r, n FROM b", "SELECT CAST(n_regionkey AS BIGINT) AS r, COUNT(*) AS n FROM nation WHERE n_nationkey > 4 GROUP BY n_regionkey")


def kind_of(run) -> str:
    """The kind of error that run() meets."""
    try:
        run()
    except Exception as x:  # noqa: BLE001  its kind is the result
        return type(x).__name__
    return "none"


@frame(f"SELECT 'ExecutionError' AS error, x.* FROM ({LONG}) x")
def ddl_beside_a_transaction(spark, sf_dir):
    """A table that the open transaction has written keeps its definition, and none of the rows written get out."""
    e = engine(spark, sf_dir, "nation")
    for s in (*MAKE, "BEGIN", "DELETE FROM t WHERE k > 2"):
        e.execute(s)
    kind = kind_of(lambda: e.execute("ALTER TABLE t ADD COLUMN x INTEGER"))
    return e.query(f"SELECT '{kind}' AS error, * FROM t")


@frame("SELECT 'a' AS who, COUNT(*) AS n, 'TableNotFound' AS foreign_table FROM nation UNION ALL SELECT 'b', COUNT(*), 'TableNotFound' FROM region")
def engines_are_apart(spark, sf_dir):
    a, b = engine(spark, sf_dir, "nation"), engine(spark, sf_dir, "region")
    a.execute("CREATE TABLE t AS SELECT * FROM nation")
    b.execute("CREATE TABLE t AS SELECT * FROM region")
    b.query("SELECT * FROM t")
    kinds = [kind_of(lambda: a.query("SELECT * FROM region").count()), kind_of(lambda: b.query("SELECT * FROM nation").count())]
    ask = "SELECT '%s' AS who, COUNT(*) AS n, '%s' AS foreign_table FROM t"
    return a.query(ask % ("a", kinds[0])).union(b.query(ask % ("b", kinds[1])))


@frame("SELECT 'ConstraintViolation' AS error, (SELECT COUNT(*) FROM region) - 1 AS parents, COUNT(*) AS children FROM nation WHERE n_regionkey > 0")
def fk_at_commit(spark, sf_dir):
    """One connection deletes a parent, the other adds its child; the second COMMIT is refused."""
    e = engine(spark, sf_dir, "nation", "region")
    for s in ("CREATE TABLE p (id INTEGER PRIMARY KEY)", "INSERT INTO p SELECT r_regionkey FROM region", "CREATE TABLE t (k INTEGER, r INTEGER REFERENCES p(id))", "INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey > 0"):
        e.execute(s)
    a, b = Connection(e), Connection(e)
    for c, s in ((a, "BEGIN"), (b, "BEGIN"), (a, "DELETE FROM p WHERE id = 0"), (b, "INSERT INTO t VALUES (99, 0)"), (a, "COMMIT")):
        c.execute(s)
    kind = kind_of(lambda: b.execute("COMMIT"))
    return e.query(f"SELECT '{kind}' AS error, (SELECT COUNT(*) FROM p) AS parents, COUNT(*) AS children FROM t")


@frame("SELECT COUNT(*) AS freed, CAST(0 AS BIGINT) AS later FROM region")
def vacuum_frees_versions(spark, sf_dir):
    """One update for each region: as many versions are freed, those that a fork holds not before it is gone."""
    e = engine(spark, sf_dir, "nation", "region")
    for s in MAKE:
        e.execute(s)
    e.vacuum()
    for r in range(load(spark, sf_dir, "region").count()):
        e.execute(f"UPDATE t SET r = r + {r}")
    freed = e.vacuum()
    return spark.createDataFrame([(freed, e.vacuum())], "freed long, later long")


@frame("SELECT o_orderkey, (o_orderkey + 9007199254740993) // 1 AS one, (0 - o_orderkey - 9007199254740993) // 3 AS third FROM orders")
def int_div_above_doubles(spark, sf_dir):
    k = F.col("o_orderkey") + F.lit(9007199254740993)
    return load(spark, sf_dir, "orders").select("o_orderkey", C.int_div(k, F.lit(1)).alias("one"), C.int_div(-k, F.lit(3)).alias("third"))


@frame(f"SELECT d.doc_id FROM {LABELLED} WHERE l.quality NOT IN (SELECT toxic FROM labels WHERE toxic = 1)")
def not_in_subquery_ansi(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    d = load(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return R.not_in_subquery(d, F.col("quality"), labels.filter("toxic = 1").select(F.col("toxic").alias("s"))).select("doc_id")


@frame("SELECT n_regionkey AS r, CAST(MAX(n_nationkey) - MIN(n_nationkey) AS BIGINT) AS width FROM nation GROUP BY n_regionkey")
def registered_aggregate(spark, sf_dir):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def width(x):
        return int(x.max() - x.min())

    width.__annotations__ = {"x": pd.Series, "return": int}  # as types, not as texts
    e = engine(spark, sf_dir, "nation")
    e.register_function("key_width", pandas_udf(width, "bigint"), "bigint")
    return e.query("SELECT n_regionkey AS r, key_width(n_nationkey) AS width FROM nation GROUP BY n_regionkey")


@frame("SELECT 'nation' AS table_name, COUNT(*) AS n FROM nation UNION ALL SELECT 't', COUNT(*) FROM nation WHERE n_nationkey < 7")
def system_storage(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.execute("CREATE TABLE t AS SELECT * FROM nation WHERE n_nationkey < 7")
    return e.query("SELECT table_name, rows AS n FROM system_storage_metrics")


@frame(f"SELECT 'parent' AS who, COUNT(*) AS n FROM nation UNION ALL SELECT 'child', COUNT(*) FROM nation WHERE n_nationkey >= 10")
def fork_isolation(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.execute(MAKE[0])
    e.execute(MAKE[1])
    child = e.fork()
    child.execute("DELETE FROM t WHERE k < 10")
    a = child.query("SELECT 'child' AS who, COUNT(*) AS n FROM t")
    return e.query("SELECT 'parent' AS who, COUNT(*) AS n FROM t").union(a)


@frame("SELECT 'Conflict' AS error, CAST(1 AS BIGINT) AS r")
def txn_conflict(spark, sf_dir):
    e = Engine(spark)
    e.execute("CREATE TABLE t (k INTEGER, r INTEGER)")
    e.execute("INSERT INTO t VALUES (1, 0)")
    a, b = Connection(e), Connection(e)
    a.execute("BEGIN")
    b.execute("BEGIN")
    a.execute("UPDATE t SET r = 1")
    b.execute("UPDATE t SET r = 2")
    a.execute("COMMIT")
    try:
        b.execute("COMMIT")
        kind = "none"
    except Exception as x:  # noqa: BLE001  its kind is the result
        kind = type(x).__name__
    return e.query(f"SELECT '{kind}' AS error, r FROM t")


@frame("SELECT TRUE AS has_plan")
def explain(spark, sf_dir):
    plan = engine(spark, sf_dir, "nation").query("EXPLAIN SELECT * FROM nation WHERE n_nationkey = 3")
    return plan.agg(F.max(F.col("plan").contains("Filter")).alias("has_plan"))


@frame("SELECT * FROM (VALUES ('CREATE', CAST(1 AS BIGINT)), ('INSERT', 2), ('SELECT', 1)) v(statement_type, n)")
def system_metrics(spark, sf_dir):
    e = Engine(spark)
    for s in ("CREATE TABLE t (x INTEGER)", "INSERT INTO t VALUES (1)", "INSERT INTO t VALUES (2)", "SELECT * FROM t"):
        e.execute(s)
    return e.query("SELECT * FROM system_query_metrics").groupBy("statement_type").agg(F.count(F.lit(1)).alias("n"))


# documents, schema language, journal
@frame("SELECT * FROM (VALUES ('id', 'INTEGER', FALSE), ('a', 'FLOAT', FALSE), ('b', 'TEXT', FALSE), ('c', 'JSON', TRUE), ('d', 'TEXT', TRUE)) v(name, type, nullable)")
def json_infer(spark, sf_dir):
    docs = jsondocs.documents(spark, '[{"id": 1, "a": 1, "b": true, "c": {"x": 1}}, {"id": 2, "a": 2.5, "b": "t", "d": null}]')
    return spark.createDataFrame(jsondocs.infer(docs), "name string, type string, nullable boolean")


@frame("SELECT CAST(event_id AS BIGINT) AS event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events")
def json_typed(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long").alias("r")).select("event_id", "r.k")


@frame("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x'), (2, 'new')) v(id, s)")
def json_crud(spark, sf_dir):
    e = Engine(spark)
    c = jsondocs.Collections(e)
    c.create("docs", '[{"id": 1, "s": "x"}, {"id": 2, "s": "y"}, {"id": 3, "s": "z"}]')
    c.update("docs", '[{"id": 2, "s": "new"}]')
    c.delete("docs", [3])
    return e.query("SELECT id, s FROM docs")


@frame("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'users'), (1, 'posts')) v(place, name)")
def model_dsl(spark, sf_dir):
    made = modeldsl.statements("struct posts { id: integer pk, author: users, title: text not_null }\nstruct users { id: integer pk, email: text unique }")
    e = Engine(spark)
    for s in made:
        e.execute(s)
    return spark.createDataFrame([(i, n) for i, n in enumerate(e.tables)], "place long, name string")


@frame("SELECT user_id, event_id AS seq, event_type AS state FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) x WHERE n = 1")
def journal_latest(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return journal.latest(e, "user_id")


@frame("SELECT CAST(user_id AS VARCHAR) AS entity, CAST(props ->> 'k' AS BIGINT) AS k FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) x WHERE n = 1")
def journal_projection(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("entity"), F.lit("upsert").alias("kind"), F.col("props").alias("payload"))
    return journal.projection(e, {"k": "bigint"}).drop("seq")


@frame("SELECT date_trunc('hour', ts) AS hour, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def window_hourly(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


# entities kept by a journal
def event_journal(spark, sf_dir):
    """Events as commands to their users: one in three expects a version, one in four has a scope key."""
    e = load(spark, sf_dir, "events")
    expected = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 7)
    scope = F.when(F.col("event_id") % 4 == 0, F.col("event_type"))
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("entity"), F.lit("upsert").alias("kind"), expected.alias("expected"), scope.alias("scope"), F.col("props").alias("payload"))


@frame("""WITH RECURSIVE c AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS entity, CASE WHEN event_id % 3 = 0 THEN event_id % 7 END AS expected,
  CASE WHEN event_id % 4 = 0 THEN event_type END AS scope, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT entity, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST([] AS VARCHAR[]) AS seen, CAST(0 AS BIGINT) AS version, '' AS status FROM (SELECT DISTINCT entity FROM c) x
  UNION ALL SELECT entity, n, seq, CASE WHEN status = 'applied' AND scope IS NOT NULL THEN list_append(seen, scope) ELSE seen END, CASE WHEN status = 'applied' THEN version + 1 ELSE version END, status
  FROM (SELECT c.entity, c.n, c.seq, s.seen, s.version, c.scope, CASE WHEN c.scope IS NOT NULL AND list_contains(s.seen, c.scope) THEN 'replay' WHEN c.expected IS NOT NULL AND c.expected <> s.version THEN 'conflict' ELSE 'applied' END AS status
    FROM s JOIN c ON c.entity = s.entity AND c.n = s.n + 1) y)
SELECT entity, seq, status, version FROM s WHERE n > 0""")
def journal_outcomes(spark, sf_dir):
    return journal.outcomes(event_journal(spark, sf_dir)).select("entity", "seq", "status", "version")


@frame("SELECT CAST(user_id AS VARCHAR) AS entity, MAX(event_id) AS seq FROM events GROUP BY user_id")
def journal_compaction(spark, sf_dir):
    j = event_journal(spark, sf_dir)
    snapshot = entities.compacted(None, j.filter("seq <= 500"))
    return entities.compacted(snapshot, entities.tail(j, 500)).select("entity", "seq")


@frame("""SELECT user_id, CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split('user' || chr(1) || CAST(user_id AS VARCHAR), ''),
  lambda x: CAST(CASE WHEN x = chr(1) THEN 255 ELSE ord(x) END AS HUGEINT))), lambda h, b: (xor(h, b) * CAST(1099511628211 AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT)) % 12 AS INTEGER) AS shard FROM events""")
def shard_routing(spark, sf_dir):
    return load(spark, sf_dir, "events").select("user_id", entities.shard_of(F.lit("user"), F.col("user_id").cast("string"), 12).alias("shard"))


@frame("SELECT event_id, CASE WHEN event_type = 'click' THEN 'missing z' WHEN event_type = 'view' THEN 'type of k' WHEN event_type = 'error' THEN 'unexpected k' WHEN event_type = 'signup' THEN 'root' END AS fault FROM events")
def payload_contract(spark, sf_dir):
    p = F.col("props")
    broken = F.when(F.col("event_type") == "signup", entities.payload_fault(F.concat(F.lit("["), p, F.lit("]")), {}))
    for event, required, optional, extra in (("click", {"z": "integer"}, {}, True), ("view", {"k": "text"}, {}, True), ("error", {}, {"z": "text"}, False)):
        broken = broken.when(F.col("event_type") == event, entities.payload_fault(p, required, optional, extra))
    return load(spark, sf_dir, "events").select("event_id", broken.otherwise(entities.payload_fault(p, {"k": "float"}, {"z": "null"}, False)).alias("fault"))


def event_outbox(spark, sf_dir):
    status = F.when(F.col("event_type").isin("click", "error"), "dispatched").otherwise("pending")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("outbox_id"), F.col("event_id").alias("seq"), status.alias("status"), F.col("ts").alias("created"))


@frame("SELECT user_id AS outbox_id, seq, created FROM (SELECT user_id, event_id AS seq, ts AS created, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) x WHERE n = 1 AND event_type NOT IN ('click', 'error')")
def outbox_pending(spark, sf_dir):
    return entities.pending(event_outbox(spark, sf_dir)).select("outbox_id", "seq", "created")


@frame("SELECT user_id AS outbox_id, 'dispatched' AS status FROM (SELECT user_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) x WHERE n = 1 AND event_type NOT IN ('click', 'error') AND user_id % 2 = 0")
def outbox_dispatch(spark, sf_dir):
    box = event_outbox(spark, sf_dir)
    return entities.dispatched(box, box.filter("outbox_id % 2 = 0").select("outbox_id")).select("outbox_id", "status")


def two_states(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return c.filter("c_custkey % 3 > 0"), c.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)


@frame("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal ELSE c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 2 = 0")
def restore_skip(spark, sf_dir):
    return entities.restored(*two_states(spark, sf_dir), "c_custkey", "skip")


@frame("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 2 = 0")
def restore_overwrite(spark, sf_dir):
    return entities.restored(*two_states(spark, sf_dir), "c_custkey", "overwrite")


@frame("SELECT 'Conflict' AS error")
def restore_conflict(spark, sf_dir):
    try:
        entities.restored(*two_states(spark, sf_dir), "c_custkey")
        kind = "none"
    except Exception as x:  # noqa: BLE001  its kind is the result
        kind = type(x).__name__
    return spark.createDataFrame([(kind,)], "error string")


def customer_batch(spark, sf_dir):
    """Customers of version 1, without every fifth, and a batch that creates those and changes others."""
    c = load(spark, sf_dir, "customer").select("c_custkey", F.lit(1).cast("long").alias("version"), "c_name", "c_acctbal")
    k = F.col("c_custkey")
    op = F.when(k % 5 == 0, "create").when(k % 5 == 1, "update").when(k % 5 == 2, "patch").when(k % 5 == 3, "delete")
    changes = c.select("c_custkey", op.alias("op"), F.when(k % 5 == 1, 1).cast("long").alias("expected"), F.lit(None).cast("string").alias("c_name"), F.lit(0.5).alias("c_acctbal"))
    return c.filter(k % 5 > 0), changes.filter("op IS NOT NULL")


@frame("SELECT c_custkey, CAST(CASE WHEN c_custkey % 5 IN (1, 2) THEN 2 ELSE 1 END AS BIGINT) AS version, CASE WHEN c_custkey % 5 IN (2, 4) THEN c_name END AS c_name, CASE WHEN c_custkey % 5 = 4 THEN c_acctbal ELSE 0.5 END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 3")
def batch_writes(spark, sf_dir):
    return entities.batched(*customer_batch(spark, sf_dir), "c_custkey")


@frame("SELECT * FROM (VALUES ('exists', 'ConstraintViolation'), ('missing', 'ExecutionError'), ('twice', 'Conflict'), ('version', 'Conflict')) v(what, error)")
def batch_conflicts(spark, sf_dir):
    rows, changes = customer_batch(spark, sf_dir)
    one = changes.filter("op = 'update'")
    tries = {"exists": one.withColumn("op", F.lit("create")), "missing": changes.filter("op = 'create'").withColumn("op", F.lit("patch")), "twice": one.unionByName(one), "version": one.withColumn("expected", F.lit(9).cast("long"))}
    out = []
    for what, batch in tries.items():
        try:
            entities.batched(rows, batch, "c_custkey")
            out.append((what, "none"))
        except Exception as x:  # noqa: BLE001  its kind is the result
            out.append((what, type(x).__name__))
    return spark.createDataFrame(out, "what string, error string")


@frame("SELECT c_custkey, c_acctbal * 2 AS balance, 'new' AS state FROM customer")
def schema_migration(spark, sf_dir):
    steps = {1: lambda d: d.withColumnRenamed("c_acctbal", "balance"), 2: lambda d: d.withColumn("balance", F.col("balance") * 2).withColumn("state", F.lit("new"))}
    return entities.migrated(load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 1, steps, 3)


@frame("SELECT event_id FROM events WHERE NOT (event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-20' - INTERVAL 5 DAY)")
def prune_stale(spark, sf_dir):
    items = load(spark, sf_dir, "events").withColumn("touches", F.col("event_id") % 3).withColumnRenamed("ts", "created")
    return entities.pruned(items, F.lit("2024-01-20").cast("timestamp_ntz"), "5 DAY").select("event_id")


@frame("""SELECT event_id, CASE WHEN event_id % 2 = 0 AND (ts <= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY OR n <= hot - 50) THEN 'cold'
  WHEN event_id % 2 = 1 AND event_id % 3 = 0 AND ts <= TIMESTAMP '2024-01-31' - INTERVAL 25 DAY THEN 'gone' WHEN event_id % 2 = 0 THEN 'hot' ELSE 'cold' END AS place
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id % 2 ORDER BY ts) AS n, COUNT(*) OVER (PARTITION BY event_id % 2) AS hot FROM events) x""")
def lifecycle(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "hot").otherwise("cold").alias("place"), F.col("ts").alias("accessed"), (F.col("event_id") % 3).alias("touches"))
    return entities.maintained(e, F.lit("2024-01-31").cast("timestamp_ntz"), "20 DAY", "25 DAY", 50, True, "event_id").select("event_id", "place")


@frame("SELECT n_nationkey, 'invert' AS \"function\", CASE WHEN n_nationkey = 0 THEN 'failed: division by zero' ELSE 'invoked' END AS status, CASE WHEN n_nationkey > 0 THEN CAST(100 // n_nationkey AS VARCHAR) END AS result FROM nation")
def bulk_invocation(spark, sf_dir):
    def invert(n):
        if n == 0:
            raise ZeroDivisionError("division by zero")
        return 100 // n

    return entities.invoked(load(spark, sf_dir, "nation"), "invert", {"invert": invert}, "n_nationkey", "n_nationkey")


@frame("SELECT n_nationkey, n_nationkey * 2 + 1 AS odd, CASE WHEN n_name LIKE 'A%' THEN 1 ELSE 0 END AS a FROM nation")
def registered_function(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.register_function("odd_of", lambda n: None if n is None else 2 * n + 1, "bigint")
    e.register_syntax(lambda sql: sql.replace("STARTS WITH 'A'", "LIKE 'A%'"))
    return e.query("SELECT n_nationkey, odd_of(n_nationkey) AS odd, CASE WHEN n_name STARTS WITH 'A' THEN 1 ELSE 0 END AS a FROM nation")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries["flagship"](spark, sf_dir)


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
