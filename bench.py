"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, medians of warm runs in seconds."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))

QUERIES = {
    "scan_filter_eq": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_partkey = 77",
    "equi_join": "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "group_by": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q, AVG(l_extendedprice) AS a FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_by_many": "SELECT l_partkey, SUM(l_extendedprice) AS s FROM lineitem GROUP BY l_partkey",
    "window_rank": "SELECT COUNT(*) AS n FROM (SELECT RANK() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) x WHERE r <= 3",
    "sort_limit": "SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey LIMIT 100",
    "distinct_count": "SELECT COUNT(DISTINCT l_partkey) AS n FROM lineitem",
    "set_except": "SELECT COUNT(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) x",
    "semi_join": "SELECT COUNT(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "json_filter": "SELECT COUNT(*) AS n FROM events WHERE get_json_object(props, '$.k') = '7'",
    "recursive_cte": "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 50) SELECT SUM(n) AS s FROM s",
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from basaltiq import queries
    from basaltiq.plans.engine import Engine

    db = Engine(spark)
    for t in sorted(os.listdir(SF_DIR)):
        if t.endswith(".parquet"):
            db.register(t.removesuffix(".parquet"), spark.read.parquet(f"{SF_DIR}/{t}"))

    def timed(run):
        times = []
        for _ in range(RUNS + 1):
            t = time.perf_counter()
            run()
            times.append(time.perf_counter() - t)
        return round(statistics.median(times[1:]), 4)

    found = {name: timed(lambda s=sql: db.query(s).collect()) for name, sql in QUERIES.items()}
    found["flagship"] = timed(lambda: queries.flagship(spark, SF_DIR).collect())
    rows = db.query("SELECT COUNT(*) FROM lineitem").first()[0]
    # the engine's own tables, of 50,000 and 10,000 rows: inserted, looked up, updated, joined, vacuumed
    for s in ("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT, email TEXT UNIQUE)", "CREATE TABLE bills (id INTEGER PRIMARY KEY, user_id INTEGER, amount FLOAT)"):
        db.execute(s)

    def once(sql):
        t = time.perf_counter()
        db.execute(sql)
        return round(time.perf_counter() - t, 4)

    found["engine_insert_50k"] = once("INSERT INTO users SELECT id, 'n' || id, id || '@x' FROM range(50000)")
    db.execute("INSERT INTO bills SELECT id, id * 5, id * 1.5 FROM range(10000)")
    found["engine_point_lookup"] = timed(lambda: db.query("SELECT name FROM users WHERE id = $1", 4321).collect())
    found["engine_join_50k_10k"] = timed(lambda: db.query("SELECT COUNT(*) FROM users u JOIN bills b ON u.id = b.user_id").collect())
    db.execute("VACUUM")
    found["engine_update_one"] = timed(lambda: db.execute("UPDATE users SET name = 'x' WHERE id = 77"))
    t = time.perf_counter()
    freed = db.execute("VACUUM").affected
    found["engine_vacuum"] = round(time.perf_counter() - t, 4)
    print(json.dumps({"metric": "sum of median warm query times", "value": round(sum(v for k, v in found.items() if not k.startswith("engine_")), 4), "unit": "sec", "queries": found, "sf": os.path.basename(SF_DIR.rstrip("/")), "lineitem_rows": rows, "master": f"local[{CPUS}]", "runs": RUNS, "versions_freed": freed}))
    spark.stop()


if __name__ == "__main__":
    main()
