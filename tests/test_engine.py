import pytest
from basaltiq import errors as E
from basaltiq.functions import compat as C
from basaltiq.operators import relational as R
from basaltiq.plans.engine import Connection, Engine
from basaltiq.plans.sqlfront import first_statement, split_top, translate
from basaltiq.sources import entities, journal, jsondocs, modeldsl
from basaltiq.streaming import streams
from pyspark.sql import functions as F


@pytest.fixture
def db(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE emp (id INTEGER PRIMARY KEY, name TEXT NOT NULL, salary INTEGER, dep TEXT)")
    e.execute("INSERT INTO emp VALUES (1, 'Mira', 4100, 'lab'), (2, 'Tomas', 3900, 'port'), (3, 'Ilse', NULL, 'lab'), (4, 'Juno', 5200, 'lab'), (5, 'Pavel', NULL, 'port')")
    return e


def values(df):
    return [tuple(r) for r in df.collect()]


def test_translate():
    assert translate("a->'x'->>'y' = $2") == """get_json_object(a, "$['x']['y']") = :p2"""
    assert translate("f(b, c) -> 0") == 'get_json_object(f(b, c), "$[0]")'
    assert translate("'a->b' || ARRAY[1, 2][0]") == "'a->b' || array(1, 2)[0]"
    assert first_statement("SELECT ';'; DROP TABLE x") == "SELECT ';'"
    assert split_top("a, f(b, c), 'd,e'") == ["a", "f(b, c)", "'d,e'"]
    with pytest.raises(E.ParseError):
        translate("$3", 2)


def test_null_order(db):
    df = db.query("SELECT id, salary FROM emp")
    assert [r.id for r in R.sort(df, ("salary", False), ("id", False)).collect()] == [2, 1, 4, 3, 5]
    assert [r.id for r in R.sort(df, ("salary", True), ("id", False)).collect()] == [3, 5, 4, 1, 2]


def test_in_list_nulls(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE t (id INTEGER, v INTEGER)")
    e.execute("INSERT INTO t VALUES (1, 10), (2, 20), (3, NULL)")
    assert values(e.query("SELECT id FROM t WHERE v IN (NULL, 10)")) == [(1,)]
    assert values(e.query("SELECT id FROM t WHERE v NOT IN (NULL, 30)")) == []


def test_distinct_and_rank(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE t (v INTEGER)")
    e.execute("INSERT INTO t VALUES (4), (9), (4), (4), (7), (9), (2)")
    assert values(e.query("SELECT COUNT(DISTINCT v), SUM(DISTINCT v) FROM t")) == [(4, 22)]
    assert sorted(values(e.query("SELECT v, RANK() OVER (ORDER BY v) FROM t"))) == [(2, 1), (4, 2), (4, 2), (4, 2), (7, 5), (9, 6), (9, 6)]


def test_writes(db):
    assert db.execute("UPDATE emp SET salary = salary + $1 WHERE dep = $2", 5, "lab").affected == 3
    assert values(db.query("SELECT salary FROM emp WHERE id = 3")) == [(None,)]
    assert db.execute("UPDATE emp SET dep = 'it''s' WHERE name = 'Tomas'").affected == 1
    assert values(db.query("SELECT dep FROM emp WHERE id = 2")) == [("it's",)]
    assert db.execute("DELETE FROM emp WHERE salary > 5200").affected == 1
    assert db.stats("emp")["rows"] == 4
    assert db.execute("DELETE FROM emp WHERE salary = 1").affected == 0


@pytest.mark.parametrize(
    "sql, kind",
    [
        ("INSERT INTO emp VALUES (1, 'x', 1, 'x')", E.ConstraintViolation),
        ("INSERT INTO emp (id) VALUES (9)", E.ConstraintViolation),
        ("INSERT INTO emp (id, id) VALUES (9, 9)", E.ParseError),
        ("INSERT INTO emp (nope) VALUES (9)", E.ColumnNotFound),
        ("INSERT INTO emp VALUES (1)", E.ExecutionError),
        ("SELECT * FROM nope", E.TableNotFound),
        ("SELECT nope FROM emp", E.ColumnNotFound),
        ("CREATE TABLE emp (x INTEGER)", E.TableExists),
        ("CREATE TABLE z (x DECIMAL)", E.Unsupported),
        ("SELEC 1", E.Unsupported),
        ("SELECT FROM WHERE", E.EngineError),
        ("DROP TABLE nope", E.TableNotFound),
        ("COMMIT", E.ExecutionError),
    ],
)
def test_errors(db, sql, kind):
    with pytest.raises(kind):
        db.execute(sql)
    assert db.stats("emp")["rows"] == 5


def test_transactions(db):
    a, b = Connection(db), Connection(db)
    a.execute("BEGIN")
    a.execute("INSERT INTO emp VALUES (6, 'F', 1, 'x')")
    assert values(a.query("SELECT COUNT(*) FROM emp")) == [(6,)]
    assert values(b.query("SELECT COUNT(*) FROM emp")) == [(5,)]
    b.execute("INSERT INTO emp VALUES (7, 'G', 1, 'x')")
    a.execute("COMMIT")  # both only appended
    assert values(db.query("SELECT COUNT(*) FROM emp")) == [(7,)]
    a.execute("BEGIN")
    with pytest.raises(E.ExecutionError):
        a.execute("BEGIN")
    assert a.tx is None  # an error rolls back
    a.execute("ROLLBACK")
    a.execute("BEGIN")
    a.execute("DELETE FROM emp WHERE id = 1")
    b.execute("UPDATE emp SET salary = 0 WHERE id = 1")
    with pytest.raises(E.Conflict):
        a.execute("COMMIT")
    assert values(db.query("SELECT salary FROM emp WHERE id = 1")) == [(0,)]
    a.execute("BEGIN")
    a.execute("INSERT INTO emp VALUES (8, 'H', 1, 'x')")
    b.execute("INSERT INTO emp VALUES (8, 'I', 1, 'x')")
    with pytest.raises(E.ConstraintViolation):
        a.execute("COMMIT")


def test_fork_and_views(db):
    db.execute("CREATE VIEW eng (id) AS SELECT id FROM emp WHERE dep = 'lab'")
    child = db.fork()
    child.execute("DELETE FROM emp WHERE id = 1")
    assert values(child.query("SELECT COUNT(*) FROM eng")) == [(2,)]
    assert values(db.query("SELECT COUNT(*) FROM eng")) == [(3,)]
    db.execute("DROP VIEW eng")
    db.execute("DROP VIEW IF EXISTS eng")


def test_foreign_keys(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT)")
    e.execute("CREATE TABLE posts (id INTEGER, user_id INTEGER REFERENCES users(id))")
    e.execute("INSERT INTO users VALUES (1, 'a'), (2, 'b')")
    e.execute("INSERT INTO posts VALUES (1, 1), (2, NULL)")
    for bad in ("INSERT INTO posts VALUES (3, 9)", "DELETE FROM users WHERE id = 1", "UPDATE users SET id = 5 WHERE id = 1", "UPDATE posts SET user_id = 7"):
        with pytest.raises(E.ConstraintViolation):
            e.execute(bad)
    assert e.execute("DELETE FROM users WHERE id = 2").affected == 1


def test_types(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE t (u UUID, f FLOAT, a TEXT[])")
    e.execute("INSERT INTO t VALUES ('550E8400-E29B-41D4-A716-446655440000', 2, '[x, y]')")
    assert values(e.query("SELECT * FROM t")) == [("550e8400-e29b-41d4-a716-446655440000", 2.0, ["x", "y"])]
    with pytest.raises(E.EngineError):
        e.execute("INSERT INTO t VALUES ('nope', 1, '[]')")


def test_compat(spark):
    df = spark.createDataFrame([(7, -2, 1.0, 0.0, None)], "a long, b long, x double, z double, n long")
    got = df.select(C.int_div(F.col("a"), F.col("b")), C.float_div(F.col("x"), F.col("z")), C.eq2v(F.col("n"), F.col("a")), C.truthy(F.col("n"), "bigint"), C.close(F.col("x"), F.lit(1.0))).first()
    assert tuple(got) == (-3, float("inf"), False, False, True)


def test_recursion_has_a_bound(spark):
    with pytest.raises(E.ExecutionError):
        R.recursive(spark, spark.range(1).toDF("k"), lambda d: d.select(F.col("k") + 1), most=3)
    with pytest.raises(E.ExecutionError):
        R.guarded_join(spark.range(100), spark.range(100).toDF("j"), F.col("id") == F.col("j"), 100)


def test_documents(spark):
    c = jsondocs.Collections(Engine(spark))
    assert c.create("d", '[{"id": 1, "n": 1}, {"id": 2, "n": 2.5, "o": {"a": [1]}}]') == 2
    assert c.read("d", "SELECT id, o FROM d ORDER BY id") == '[{"id":1,"o":null},{"id":2,"o":"{\\"a\\":[1]}"}]'
    assert c.update("d", '[{"id": 1, "n": 9}]') == 1 and c.delete("d", [2]) == 1 and c.list() == ["d"]
    for bad, kind in (("SELECT 1; DROP TABLE d", E.Unsupported), ("DELETE FROM d", E.Unsupported), ("SELECT * FROM other", E.Unsupported)):
        with pytest.raises(kind):
            c.read("d", bad)
    with pytest.raises(E.ColumnNotFound):
        c.update("d", '[{"id": 1, "zzz": 9}]')
    with pytest.raises(E.ParseError):
        c.create("e", '{"id": 1}')
    with pytest.raises(E.ParseError):
        c.create("1; x", "[]")


def test_schema_language():
    made = modeldsl.statements("struct a { id: int pk, b: b }\nstruct b { id: int pk, s: text unique not_null }")
    assert made == ["CREATE TABLE b (id INT PRIMARY KEY, s TEXT NOT NULL UNIQUE)", "CREATE TABLE a (id INT PRIMARY KEY, b_id INT REFERENCES b(id))"]
    for bad in ("struct a { x: b }\nstruct b { y: a }", "strukt a {}", "struct a { x }"):
        with pytest.raises(E.ParseError):
            modeldsl.statements(bad)


def test_journal(spark):
    rows = [(1, "a", "upsert", 0, "s1", '{"v":1}'), (2, "a", "upsert", 0, "s2", '{"v":2}'), (3, "a", "upsert", 0, "s1", '{"v":3}'), (4, "a", "upsert", 1, None, '{"v":4}'), (5, "b", "upsert", None, None, '{"v":5}'), (6, "b", "delete", 1, None, None)]
    j = spark.createDataFrame(rows, journal.RECORD)
    assert sorted((r.entity, r.seq, r.version) for r in journal.applied(j).collect()) == [("a", 1, 1), ("a", 4, 2), ("b", 5, 1), ("b", 6, 2)]
    assert values(journal.projection(j, {"v": "int"})) == [("a", 4, 4)]
    assert values(journal.pages(journal.latest(j), "entity", 0, 1).select("entity")) == [("a",)]


def test_outcomes(spark):
    rows = [(1, "a", "upsert", 5, "s", "x"), (2, "a", "upsert", 0, "s", "y"), (3, "a", "upsert", None, "s", "z"), (4, "a", "upsert", 1, None, None), (5, None, "upsert", 0, "s", "n"), (6, None, "upsert", None, "s", "n")]
    got = {r.seq: (r.status, r.version) for r in journal.outcomes(spark.createDataFrame(rows, journal.RECORD)).collect()}
    # a conflict doesn't use up its scope key; a null entity is an entity
    assert got == {1: ("conflict", 0), 2: ("applied", 1), 3: ("replay", 1), 4: ("applied", 2), 5: ("applied", 1), 6: ("replay", 1)}
    assert journal.outcomes(spark.createDataFrame([], journal.RECORD)).count() == 0


def test_shards(spark):
    def fnv(*parts):
        h = entities.FNV_BASIS
        for b in b"\xff".join(p.encode() for p in parts):
            h = (h ^ b) * entities.FNV_PRIME % (1 << 64)
        return h

    names = ["", "a", "é漢字", "x" * 3000]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for shards in (1, 7, 1024, 2**31 - 1):
        assert values(df.select(entities.shard_of(F.lit("t"), F.col("n"), shards))) == [(fnv("t", n) % shards,) for n in names]
    assert values(df.limit(1).select(entities.shard_of(F.lit("t"), F.col("n"), 0))) == [(0,)]
    assert entities.leaders(3, "d", {1: "e"}) == ["d", "e", "d"]
    with pytest.raises(E.ExecutionError):
        entities.leaders(3, "d", {3: "e"})


def test_payload_contract(spark):
    cases = [('{"a": 1}', None), ('{"a": 1.5}', "type of a"), ('{"a": null}', "type of a"), ("{}", "missing a"), ("[1]", "root"), ("{", "root"), (None, "root"), ('{"a": 2, "f": 3}', None), ('{"a": 2, "f": "x"}', "type of f"), ('{"a": 1, "q": 0, "b": 0}', "unexpected b"), ('{"a": {"x": 1}}', "type of a")]
    df = spark.createDataFrame(cases, "p string, want string")
    got = df.select("p", "want", entities.payload_fault(F.col("p"), {"a": "integer"}, {"f": "float"}, extra=False).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert values(df.limit(1).select(entities.payload_fault(F.lit("[1]"), {}, root="array"))) == [(None,)]
    with pytest.raises(E.ExecutionError):
        entities.payload_fault(F.col("p"), {"a": "int"})


def test_smallest(spark):
    numbers = [-(2**63), -5, -5, -1, 0, 0, 3, 2**40, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    for k in range(1, len(numbers) + 1):
        assert entities.smallest(df, F.col("n"), k) == (numbers[k - 1], numbers.index(numbers[k - 1]))


def test_lifecycle_and_outbox(spark):
    items = spark.sql("SELECT CAST(id AS STRING) AS entity, 'hot' AS place, TIMESTAMP '2024-01-01' AS accessed, 0 AS touches FROM range(10)")
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    left = entities.maintained(items, now, "1 DAY", "1 DAY", max_hot=4)
    assert left.filter("place = 'hot'").count() == 4  # though all are equally idle
    assert entities.maintained(left, now, "1 DAY", "1 HOUR").filter("place = 'gone'").count() == 6
    box = spark.createDataFrame([("m", 1, "pending", 1), ("n", 2, "pending", 2), ("n", 3, "dispatched", 2)], "outbox_id string, seq long, status string, created long")
    sent = entities.dispatched(box, spark.createDataFrame([("m",), ("n",), ("m",)], "outbox_id string"))
    assert values(sent) == [("m", 4, "dispatched", 1)]
    assert entities.pending(box.unionByName(sent)).isEmpty()
    with pytest.raises(E.ExecutionError):
        entities.dispatched(box, spark.createDataFrame([("o",)], "outbox_id string"))
    with pytest.raises(E.Conflict):
        entities.restored(items, items.limit(1), "entity")
    with pytest.raises(E.ExecutionError):
        entities.migrated(items, 1, {}, 2)


def test_change_log(spark, tmp_path):
    log = journal.ChangeLog(spark, str(tmp_path / "log"))
    e = Engine(spark, log)
    e.execute("CREATE TABLE t (k INTEGER)")
    e.execute("INSERT INTO t VALUES (1), (2)")
    e.execute("INSERT INTO t VALUES (3)")
    e.execute("DELETE FROM t WHERE k = 1")
    e.execute("BEGIN")
    e.execute("UPDATE t SET k = k * 10")
    e.execute("COMMIT")
    back = journal.ChangeLog(spark, str(tmp_path / "log")).recover()
    assert sorted(values(back["t"])) == [(20,), (30,)]
    e.execute("CREATE TABLE u (k INTEGER)")
    e.execute("INSERT INTO u VALUES (7)")
    e.checkpoint()
    reopened = journal.ChangeLog(spark, str(tmp_path / "log"))
    reopened.append("t", "insert", back["t"].limit(1))
    assert reopened.recover()["t"].count() == 3 and values(reopened.recover()["u"]) == [(7,)]
    # rows written by a commit that never reached the manifest don't count
    back["t"].write.parquet(str(tmp_path / "log/data/99999999-lost"))
    reopened.commit([("u", "drop", None)])
    assert {n: d.count() for n, d in journal.ChangeLog(spark, str(tmp_path / "log")).recover().items()} == {"t": 3}


def test_batch(spark):
    table = spark.createDataFrame([(1, 3, "a"), (2, 1, "b")], "id long, version long, v string")
    shape = "id long, op string, expected long, v string"
    batch = lambda *rows: entities.batched(table, spark.createDataFrame(rows, shape), "id")
    assert sorted(values(batch((1, "patch", 3, None), (3, "create", None, "c"), (2, "delete", None, None)))) == [(1, 4, "a"), (3, 1, "c")]
    assert sorted(values(batch())) == sorted(values(table))
    for rows, kind in (([(None, "create", None, "x")], E.ConstraintViolation), ([(3, "grow", None, "x")], E.ExecutionError), ([(3, "create", None, "x"), (3, "create", None, "x")], E.Conflict), ([(4, "delete", None, None), (1, "update", 3, "z")], E.ExecutionError)):
        with pytest.raises(kind):
            batch(*rows)


def test_definitions_are_logged(spark, tmp_path):
    e = Engine(spark, journal.ChangeLog(spark, str(tmp_path / "log")))
    for sql in ("CREATE TABLE a (k INTEGER)", "CREATE TABLE b (k INTEGER)", "CREATE TABLE c (k INTEGER)", "INSERT INTO a VALUES (1)", "ALTER TABLE a ADD COLUMN v INTEGER DEFAULT 5", "INSERT INTO a VALUES (2, 6)", "ALTER TABLE a RENAME TO d", "DROP TABLE b"):
        e.execute(sql)
    back = journal.ChangeLog(spark, str(tmp_path / "log")).recover()
    assert sorted(back) == ["c", "d"]
    assert sorted(values(back["d"])) == [(1, 5), (2, 6)] and back["c"].columns == ["k"] and back["c"].isEmpty()


def test_spaced(spark):
    docs = spark.range(0, 1000, 1, 7)
    assert [r[0] for r in jsondocs.spaced(docs, 100).orderBy("id").collect()] == list(range(0, 1000, 10))
    assert [jsondocs.spaced(docs, n).count() for n in (0, 1, 3, 999, 1000, 2000)] == [0, 1, 3, 999, 1000, 1000]
    docs = jsondocs.documents(spark, "[" + ",".join(f'{{"id": {i}, "a": {i}{".5" if i == 150 else ""}}}' for i in range(200)) + "]")
    assert jsondocs.infer(docs, "sampled") == [("id", "INTEGER", False), ("a", "FLOAT", False)]


def test_streams(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    live = streams.read_stream(spark, str(tmp_path / "in"), events.schema)
    q = streams.windowed(live, "ts", "1 day", "1 hour", "event_type").writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT SUM(n) AS n FROM daily").first().n == events.count()
    rows = [(1, "a", "upsert", 0, None, "x"), (2, "a", "upsert", 1, None, "y")]
    spark.createDataFrame(rows, journal.RECORD).write.parquet(str(tmp_path / "j"))
    live = streams.read_stream(spark, str(tmp_path / "j"), spark.createDataFrame(rows, journal.RECORD).schema)
    q = streams.latest_state(live, str(tmp_path / "state")).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.payload for r in spark.read.parquet(str(tmp_path / "state/0")).collect()] == ["y"]


def test_system_tables(db):
    assert db.query("SELECT * FROM system_metrics").count() >= 4
    assert {r.table_name for r in db.query("SELECT * FROM system_storage_metrics").collect()} == {"emp"}
    assert db.query("EXPLAIN SELECT * FROM emp WHERE id = 1").count() > 3
    db.execute("VACUUM")


def test_llm_is_optional():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['basaltiq.llm'] = None; import __spark_entry__ as e; assert 'flagship' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    import os

    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_errors_of_names_functions_and_grouping(db):
    for sql, kind in (("SELECT nope(id) FROM emp", E.EngineError), ("SELECT dep, salary, COUNT(*) FROM emp GROUP BY dep", E.EngineError), ("SELECT * FROM nowhere", E.TableNotFound), ("DROP VIEW nowhere", E.TableNotFound)):
        with pytest.raises(kind):
            db.query(sql).collect()
    db.execute("CREATE VIEW v AS SELECT id FROM emp")
    db.execute("DROP VIEW v")
    with pytest.raises(E.TableNotFound):
        db.query("SELECT * FROM v")


def test_a_name_in_a_text_or_a_column_is_not_a_table(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE word (word TEXT, n INTEGER)")
    e.execute("INSERT INTO word VALUES ('word', 1), ('other', 2)")
    assert values(e.query("SELECT word.word, n FROM word WHERE word = 'word'")) == [("word", 1)]
    assert values(e.query("SELECT w.word FROM (SELECT word FROM word ORDER BY n DESC) w LIMIT 1")) == [("other",)]


def test_forks_do_not_see_later_tables(db):
    child = db.fork()
    db.execute("CREATE TABLE later AS SELECT * FROM emp")
    with pytest.raises(E.TableNotFound):
        child.query("SELECT * FROM later")
    child.execute("UPDATE emp SET salary = 0")
    assert db.vacuum() == 1  # the empty emp of CREATE; the fork still holds the version that it has replaced for itself alone
    assert values(db.query("SELECT SUM(salary) FROM emp")) == [(13200,)]
    assert values(child.query("SELECT SUM(salary) FROM emp")) == [(0,)]


def test_vacuum_leaves_caches_and_open_transactions(db):
    kept = db.spark.range(10).cache()
    kept.count()
    c = Connection(db)
    c.execute("BEGIN")
    c.query("SELECT * FROM emp")
    for i in range(20):
        db.execute(f"UPDATE emp SET salary = {i}")
    freed = db.vacuum()
    assert freed == 20  # the empty emp, and what the updates left, but for the version that c has pinned
    assert kept.storageLevel.useMemory
    assert values(c.query("SELECT COUNT(salary) FROM emp")) == [(3,)]
    c.execute("ROLLBACK")
    assert db.vacuum() == 1 and db.vacuum() == 0
    assert values(db.query("SELECT SUM(salary) FROM emp")) == [(95,)]


def test_inserts_add_and_are_gathered(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v INTEGER)")
    for i in range(40):
        e.execute("INSERT INTO t VALUES ($1, $2)", i, i * i)
    assert values(e.query("SELECT COUNT(*), SUM(v) FROM t")) == [(40, sum(i * i for i in range(40)))]
    from basaltiq.plans.engine import PARTS, files

    assert len(files(e.tables["t"].data)) <= PARTS
    with pytest.raises(E.ConstraintViolation):
        e.execute("INSERT INTO t VALUES (7, 0)")
    with pytest.raises(E.ConstraintViolation):
        e.execute("INSERT INTO t VALUES (77, 0), (77, 1)")


def test_a_failing_log_leaves_tables_as_they_were(spark):
    class Full:
        def append(self, *_):
            raise OSError("no space")

        def commit(self, _):
            if self.armed:
                raise OSError("no space")

    log = Full()
    log.armed = False
    e = Engine(spark, log=log)
    e.execute("CREATE TABLE t (id INTEGER)")
    with pytest.raises(E.EngineError):
        e.execute("INSERT INTO t VALUES (1)")
    e.execute("BEGIN")
    e.execute("INSERT INTO t VALUES (2)")
    log.armed = True
    with pytest.raises(E.EngineError):
        e.execute("COMMIT")
    assert values(e.query("SELECT COUNT(*) FROM t")) == [(0,)]


def test_threads_keep_their_transactions(spark):
    from concurrent.futures import ThreadPoolExecutor

    e = Engine(spark)
    e.execute("CREATE TABLE t (id INTEGER)")

    def work(i):
        c = Connection(e)
        c.execute("BEGIN")
        c.execute("INSERT INTO t VALUES ($1)", i)
        mine = values(c.query("SELECT id FROM t WHERE id >= 0"))
        c.execute("ROLLBACK" if i % 2 else "COMMIT")
        return i in {r[0] for r in mine}

    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(work, range(6)))
    assert sorted(values(e.query("SELECT id FROM t"))) == [(0,), (2,), (4,)]


def test_guard_of_collections(spark):
    c = jsondocs.Collections(Engine(spark))
    c.create("docs", '[{"id": 1, "x": "a", "y": 2}, {"id": 2, "x": "b", "y": 3}]')
    c.create("secret", '[{"id": 9}]')
    for sql in ("SELECT secret.id FROM docs, secret", "SELECT * FROM docs WHERE id IN (SELECT id FROM secret)", "SELECT (SELECT MAX(id) FROM secret) AS m FROM docs", "SELECT * FROM docs NATURAL JOIN secret", "SELECT * FROM range(3)"):
        with pytest.raises(E.Unsupported):
            c.read("docs", sql)
    assert c.read("docs", "SELECT id FROM Docs WHERE y > (SELECT MIN(y) FROM docs)") == '[{"id":2}]'
    assert c.update("docs", '[{"id": 1, "x": null}]') == 1
    assert c.read("docs", "SELECT id, x, y FROM docs WHERE id = 1") == '[{"id":1,"x":null,"y":2}]'
