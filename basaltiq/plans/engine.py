"""The engine: SQL over versioned tables, with constraints, transactions and forks.

A table is a chain of immutable DataFrame versions; a statement that writes
makes a new version. A fork copies the names to versions, which is O(tables).
A transaction pins the versions at BEGIN, works on its own, and at COMMIT its
new versions take their places: tables that it only appended to are rebased on
what others appended meanwhile, tables that it rewrote must be unchanged, and
foreign keys are checked again where the other side has changed. Definitions
are not part of transactions: they change the committed tables at once, and not
one that the open transaction has written.

Names of a statement are bound as CTEs over views whose own names no other
engine knows, and which are gone when the statement is analysed.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
import weakref
from collections import deque
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as tp
from ..errors import ColumnNotFound, Conflict, ConstraintViolation, EngineError, ExecutionError, ParseError, TableExists, TableNotFound, TypeMismatch, Unsupported
from ..session import cut
from .sqlfront import cut_keyword, first_statement, split_top, tokens, translate

SYSTEM = ("system_metrics", "system_query_metrics", "system_memory_metrics", "system_storage_metrics")
KEPT_QUERIES = 1000
RECURSION = "500"


@dataclass(frozen=True)
class ColumnMeta:
    name: str
    type: str
    nullable: bool = True
    primary: bool = False
    unique: bool = False
    default: str | None = None
    check: str | None = None
    references: tuple[str, str] | None = None


@dataclass(frozen=True)
class Table:
    columns: tuple[ColumnMeta, ...]
    data: DataFrame
    version: int = 0
    indexes: tuple[tuple[str, str, bool], ...] = ()

    def column(self, name: str) -> ColumnMeta:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise ColumnNotFound(name)


@dataclass
class Result:
    """Rows of a query, or the number of rows that a statement wrote."""

    rows: DataFrame | None = None
    affected: int = 0


@dataclass
class Transaction:
    base: dict[str, Table]
    tables: dict[str, Table]
    appended: dict[str, list[DataFrame]] = field(default_factory=dict)
    rewritten: set[str] = field(default_factory=set)

    @property
    def written(self) -> set[str]:
        return {*self.appended, *self.rewritten}


#: an INSERT adds its rows beside those there are; after this many the table is written as one
PARTS = 32


class Versions:
    """What an engine and its forks share: who uses versions, and which were replaced."""

    def __init__(self):
        self.users: weakref.WeakSet = weakref.WeakSet()
        self.replaced: list[Table] = []


def files(df: DataFrame) -> set[str]:
    """The checkpoint files that a DataFrame reads."""
    out, todo = set(), [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.nodeName() in ("LogicalRDD", "Scan ExistingRDD") or node.getClass().getSimpleName() == "LogicalRDD":
            file = node.rdd().getCheckpointFile()
            if file.isDefined():
                out.add(file.get())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


class Engine:
    def __init__(self, spark: SparkSession, log=None, versions: Versions | None = None):
        self.spark = spark
        self.versions = versions or Versions()
        self.versions.users.add(self)
        self.open: weakref.WeakSet = weakref.WeakSet()  # connections with transactions of their own
        self.lock = threading.RLock()
        self.tables: dict[str, Table] = {}
        self.views: dict[str, str] = {}
        self.metrics: deque = deque(maxlen=KEPT_QUERIES)
        self.counts = {"statements": 0, "errors": 0}
        self.tx: Transaction | None = None
        self.log = log
        self.syntax: list = []

    # names

    @property
    def visible(self) -> dict[str, Table]:
        return self.tx.tables if self.tx else self.tables

    def table(self, name: str) -> Table:
        return self.visible[self.named(name)]

    def named(self, name: str, names: dict | None = None) -> str:
        """The name as it was created; SQL may spell it in any case."""
        names = self.visible if names is None else names
        name = name.strip().strip('`"').split(".")[-1]
        if name in names:
            return name
        for known in names:
            if known.lower() == name.lower():
                return known
        raise TableNotFound(name)

    def taken(self, name: str) -> bool:
        return name.lower() in {n.lower() for n in (*self.tables, *self.views)}

    def register(self, name: str, df: DataFrame) -> None:
        """A table over any DataFrame, such as one that reads Parquet."""
        if self.taken(name):
            raise TableExists(name)
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "FLOAT", "float": "FLOAT", "string": "TEXT", "boolean": "BOOLEAN", "date": "DATE"}
        self.tables[name] = Table(tuple(ColumnMeta(f.name, kinds.get(f.dataType.simpleString(), "TIMESTAMP" if "timestamp" in f.dataType.simpleString() else "TEXT")) for f in df.schema), df)

    def fork(self) -> Engine:
        """An independent engine over the same versions; open transactions of the parent are not seen."""
        child = Engine(self.spark, versions=self.versions)
        child.tables, child.views, child.syntax = dict(self.tables), dict(self.views), list(self.syntax)
        return child

    def stats(self, name: str) -> dict:
        t = self.table(name)
        return {"rows": t.data.count(), "columns": [c.name for c in t.columns], "version": t.version, "indexes": [i[0] for i in t.indexes]}

    def register_function(self, name: str, function, returns: str) -> None:
        """A Python function for SQL, by name; values come in Arrow batches. A pandas UDF, aggregates among them, is registered as it is."""
        made = function if hasattr(function, "evalType") else F.udf(function, returns, useArrow=True)
        self.spark.udf.register(name, made)

    def register_syntax(self, rewrite) -> None:
        """A function from SQL text to SQL text, applied to each statement before others that were registered later."""
        self.syntax.append(rewrite)

    # statements

    def query(self, sql: str, *params) -> DataFrame:
        r = self.execute(sql, *params)
        if r.rows is None:
            raise ExecutionError("not a query")
        return r.rows

    def execute(self, sql: str, *params) -> Result:
        """Runs the first statement of sql; one at a time, whatever the thread."""
        with self.lock:
            return self._execute(sql, params)

    def _execute(self, sql: str, params) -> Result:
        for rewrite in self.syntax:
            sql = rewrite(sql)
        text, began = first_statement(sql), time.time()
        head = text.split(None, 1)[0].upper() if text else ""
        error = None
        try:
            return self._run(head, text, params)
        except Exception as e:
            error = str(e).splitlines()[0][:200] if str(e) else type(e).__name__
            self.counts["errors"] += 1
            if self.tx:
                self.tx = None  # an error inside a transaction rolls it back
            if isinstance(e, EngineError):
                raise
            raise self._translated(e) from e
        finally:
            self.counts["statements"] += 1
            self.metrics.append((self.counts["statements"], int(began * 1000), (time.time() - began) * 1000, head, text, error))

    @staticmethod
    def _translated(e: Exception) -> EngineError:
        name = getattr(e, "getCondition", lambda: None)() or ""
        for part, kind in (("PARSE", ParseError), ("TABLE_OR_VIEW_NOT_FOUND", TableNotFound), ("UNRESOLVED_COLUMN", ColumnNotFound), ("DATATYPE_MISMATCH", TypeMismatch), ("CAST_INVALID", TypeMismatch), ("UNSUPPORTED", Unsupported)):
            if part in name:
                return kind(str(e).splitlines()[0])
        return ExecutionError(str(e).splitlines()[0] if str(e) else type(e).__name__)

    def _run(self, head: str, text: str, params) -> Result:
        two = " ".join(text.split()[:2]).upper()
        if head in ("SELECT", "WITH", "VALUES", "("):
            return Result(self._select(text, params))
        if head == "INSERT":
            return self._insert(text, params)
        if head == "UPDATE":
            return self._update(text, params)
        if head == "DELETE":
            return self._delete(text, params)
        if head == "EXPLAIN":
            rest = re.sub(r"(?is)^EXPLAIN\s+(ANALYZE\s+)?", "", text)
            plan = self._select(rest, params)._jdf.queryExecution().toString()
            return Result(self.spark.createDataFrame([(line,) for line in plan.splitlines()], "plan string"))
        if head in ("BEGIN", "START"):
            return self._begin()
        if head in ("COMMIT", "END"):
            return self._commit()
        if head == "ROLLBACK":
            self.tx = None
            return Result()
        if head == "VACUUM":
            return Result(affected=self.vacuum())
        if two in ("CREATE TABLE",):
            return self._create_table(text)
        if two == "DROP TABLE":
            return self._drop(text, self.tables, "TABLE")
        if two in ("CREATE VIEW", "CREATE OR"):
            return self._create_view(text)
        if two == "DROP VIEW":
            return self._drop(text, self.views, "VIEW")
        if two in ("CREATE INDEX", "CREATE UNIQUE"):
            return self._create_index(text)
        if two == "ALTER TABLE":
            return self._alter(text)
        raise Unsupported(text[:60])

    # queries

    def _used(self, sql: str) -> list[str]:
        """Names of tables, system tables and views that the words of sql may mean, each after those that it needs."""
        known = {n.lower(): n for n in (*SYSTEM, *self.visible, *self.views)}
        out: list[str] = []

        def visit(text: str, above: tuple) -> None:
            for word in {t.split(".")[-1].strip('`"').lower() for t in tokens(text)} & known.keys():
                name = known[word]
                if name in self.views and name not in above:
                    visit(self.views[name], (*above, name))
                if name not in out and name not in above[-1:]:
                    out.append(name)

        visit(sql, ())
        return out

    def _bound(self, sql: str, args: dict | None) -> DataFrame:
        """sql, analysed with the engine's names as CTEs before its own."""
        used, made, ctes = self._used(sql), [], []
        # a CTE of the statement's own hides a table, but may read it
        own = {m.strip('`"').lower() for m in re.findall(r'(?is)(?:\bWITH\s+(?:RECURSIVE\s+)?|,\s*)([\w`"]+)\s*(?:\([^()]*\))?\s+AS\s*\(', sql)}
        try:
            for name in used:
                if name in self.views:
                    ctes.append(f"`{name}` {self.views[name]}")
                    continue
                view = f"v{uuid.uuid4().hex}"
                (self._system(name) if name in SYSTEM else self.visible[name].data).createOrReplaceTempView(view)
                made.append(view)
                ctes.append(f"`{name}` AS (SELECT * FROM {view})")
            begins = re.match(r"(?is)\s*WITH\s+(RECURSIVE\s+)?", sql)
            if not ctes:
                text = sql
            elif not begins:
                text = f"WITH {', '.join(ctes)} {sql}"
            elif own & {n.lower() for n in used}:
                text = f"WITH {', '.join(ctes)} SELECT * FROM ({sql})"
            else:
                text = f"WITH {begins[1] or ''}{', '.join(ctes)}, {sql[begins.end() :]}"
            return self.spark.sql(text, args=args)
        finally:
            for view in made:
                self.spark.catalog.dropTempView(view)

    def _select(self, sql: str, params=()) -> DataFrame:
        if "RECURSIVE" in sql.upper():
            self.spark.conf.set("spark.sql.cteRecursionLevelLimit", RECURSION)
        return self._bound(translate(sql, len(params)), {f"p{i + 1}": v for i, v in enumerate(params)} or None)

    def _system(self, name: str) -> DataFrame:
        if name == "system_query_metrics":
            return self.spark.createDataFrame(list(self.metrics), "id long, timestamp_ms long, duration_ms double, statement_type string, sql string, error string")
        if name == "system_storage_metrics":
            rows = [(n, len(t.columns), t.version, len(t.indexes), t.data.count()) for n, t in self.visible.items()]
            return self.spark.createDataFrame(rows, "table_name string, columns long, version long, indexes long, rows long")
        pairs = [(k, str(v)) for k, v in self.counts.items()] + [("tables", str(len(self.tables))), ("views", str(len(self.views)))]
        if name == "system_memory_metrics":
            pairs = [(k, str(v)) for k, v in {"cached_rdds": self.spark.sparkContext._jsc.getPersistentRDDs().size()}.items()]
        return self.spark.createDataFrame(pairs, "name string, value string")

    # definitions; not part of transactions

    @staticmethod
    def _column(text: str) -> ColumnMeta:
        m = re.match(r'(?s)\s*([`"]?\w+[`"]?)\s+(DOUBLE\s+PRECISION|\w+\s*(?:\([^)]*\))?\s*(?:<[^>]*>)?\s*(?:\[\])?)(.*)$', text, re.I)
        if not m:
            raise ParseError(text)
        rest = m[3]
        check = re.search(r"(?is)\bCHECK\s*\((.*)\)", rest)
        bare = rest[: check.start()] + rest[check.end() :] if check else rest
        fk = re.search(r"(?i)\bREFERENCES\s+(\w+)\s*\(\s*(\w+)\s*\)", bare)
        default = re.search(r"(?is)\bDEFAULT\s+('(?:[^']|'')*'|[-+]?[\w.]+(?:\(\))?)", bare)
        primary = bool(re.search(r"(?i)\bPRIMARY\s+KEY\b", bare))
        return ColumnMeta(m[1].strip('`"'), tp.named(m[2]), not (primary or re.search(r"(?i)\bNOT\s+NULL\b", bare)), primary, bool(re.search(r"(?i)\bUNIQUE\b", bare)), default[1] if default else None, check[1] if check else None, (fk[1], fk[2]) if fk else None)

    def _create_table(self, text: str) -> Result:
        m = re.match(r"(?is)CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?([\w.`\"]+)\s*(?:\((.*)\)|AS\s+(.*))\s*$", text)
        if not m:
            raise ParseError(text)
        name = m[2].strip('`"').split(".")[-1]
        if self.taken(name):
            if m[1]:
                return Result()
            raise TableExists(name)
        if m[4]:
            self.register(name, cut(self._select(m[4])))
            return Result()
        columns, later = [], []
        for part in split_top(m[3]):
            (later if re.match(r"(?i)(PRIMARY|UNIQUE|CHECK|FOREIGN|CONSTRAINT)\b", part) else columns).append(part)
        metas = [self._column(c) for c in columns]
        for part in later:  # single-column keys of the table
            key = re.search(r"(?i)(PRIMARY\s+KEY|UNIQUE)\s*\(\s*(\w+)\s*\)", part)
            fk = re.search(r"(?i)FOREIGN\s+KEY\s*\(\s*(\w+)\s*\)\s*REFERENCES\s+(\w+)\s*\(\s*(\w+)\s*\)", part)
            check = re.search(r"(?is)CHECK\s*\((.*)\)", part)
            if fk:
                metas = [replace(c, references=(fk[2], fk[3])) if c.name == fk[1] else c for c in metas]
            elif key:
                primary = key[1].upper().startswith("P")
                metas = [replace(c, primary=primary or c.primary, unique=True, nullable=c.nullable and not primary) if c.name == key[2] else c for c in metas]
            elif check:
                metas[0] = replace(metas[0], check=f"({metas[0].check}) AND ({check[1]})" if metas[0].check else check[1])
        for c in metas:
            if c.references:
                self.tables[self.named(c.references[0], self.tables)].column(c.references[1])
        schema = T.StructType([T.StructField(c.name, tp.spark_type(c.type)) for c in metas])
        self.tables[name] = Table(tuple(metas), self.spark.createDataFrame([], schema))
        self._define((name, "create", self.tables[name].data))
        return Result()

    def _define(self, *changes) -> None:
        """Logs a change of definitions."""
        if self.log:
            self.log.commit(list(changes))

    def _drop(self, text: str, names: dict, kind: str) -> Result:
        m = re.match(rf"(?is)DROP\s+{kind}\s+(IF\s+EXISTS\s+)?([\w.`\"]+)\s*$", text)
        try:
            name = self.named(m[2], names)
        except TableNotFound:
            if m[1]:
                return Result()
            raise
        if names is self.tables:
            self._unwritten(name)
            self.versions.replaced.append(names[name])
        del names[name]
        if names is self.tables:
            self._define((name, "drop", None))
        return Result()

    def _create_view(self, text: str) -> Result:
        m = re.match(r"(?is)CREATE\s+(OR\s+REPLACE\s+)?VIEW\s+([\w`\"]+)\s*(\([^)]*\))?\s*AS\s+(.*)$", text)
        if not m:
            raise ParseError(text)
        name = m[2].strip('`"')
        if self.taken(name) and not (m[1] and name in self.views):
            raise TableExists(name)
        self._select(m[4])  # checked before it is kept
        self.views[name] = f"{m[3] or ''} AS ({translate(m[4])})"
        return Result()

    def _create_index(self, text: str) -> Result:
        m = re.match(r"(?is)CREATE\s+(UNIQUE\s+)?INDEX\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s+ON\s+(\w+)\s*\(\s*(\w+)\s*\)\s*$", text)
        if not m:
            raise ParseError(text)
        name = self._unwritten(m[4])
        t = self.tables[name]
        t.column(m[5])
        if any(i[0] == m[3] for i in t.indexes):
            if m[2]:
                return Result()
            raise TableExists(m[3])
        if m[1]:
            self._unique(t.data, m[5])
            t = replace(t, columns=tuple(replace(c, unique=True) if c.name == m[5] else c for c in t.columns), version=t.version + 1)
        self.tables[name] = replace(t, indexes=(*t.indexes, (m[3], m[5], bool(m[1]))))
        return Result()

    def _unwritten(self, name: str) -> str:
        """The name of a committed table, unless the open transaction has written it."""
        name = self.named(name, self.tables)
        if self.tx and name in self.tx.written:
            raise ExecutionError(f"{name} is written by the open transaction; definitions are not part of it")
        return name

    def _alter(self, text: str) -> Result:
        m = re.match(r"(?is)ALTER\s+TABLE\s+(\w+)\s+(.*)$", text)
        name, what = self._unwritten(m[1]), m[2]
        t = self.tables[name]
        if a := re.match(r"(?is)ADD\s+(?:COLUMN\s+)?(.*)$", what):
            c = self._column(a[1])
            if any(x.name == c.name for x in t.columns):
                raise ParseError(f"column {c.name} is there")
            fill = F.expr(translate(c.default)) if c.default else F.lit(None)
            new = replace(t, columns=(*t.columns, c), data=t.data.withColumn(c.name, fill.cast(tp.spark_type(c.type))))
        elif a := re.match(r"(?is)DROP\s+(?:COLUMN\s+)?(\w+)$", what):
            t.column(a[1])
            new = replace(t, columns=tuple(c for c in t.columns if c.name != a[1]), data=t.data.drop(a[1]), indexes=tuple(i for i in t.indexes if i[1] != a[1]))
        elif a := re.match(r"(?is)RENAME\s+(?:COLUMN\s+)?(\w+)\s+TO\s+(\w+)$", what):
            t.column(a[1])
            new = replace(t, columns=tuple(replace(c, name=a[2]) if c.name == a[1] else c for c in t.columns), data=t.data.withColumnRenamed(a[1], a[2]), indexes=tuple((n, a[2] if c == a[1] else c, u) for n, c, u in t.indexes))
        elif a := re.match(r"(?is)RENAME\s+TO\s+(\w+)$", what):
            if self.taken(a[1]):
                raise TableExists(a[1])
            self.tables[a[1]] = self.tables.pop(name)
            self._define((name, "drop", None), (a[1], "rename", self.tables[a[1]].data))
            return Result()
        else:
            raise Unsupported(what)
        self._define((name, "alter", new.data))
        self.versions.replaced.append(t)
        self.tables[name] = replace(new, version=t.version + 1)
        return Result()

    # writes

    def _insert(self, text: str, params) -> Result:
        m = re.match(r"(?is)INSERT\s+INTO\s+([\w.`\"]+)\s*(\([^()]*\))?\s*(VALUES|SELECT|WITH)\b(.*)$", text)
        if not m:
            raise ParseError(text)
        name, t = self.named(m[1]), self.table(m[1])
        given = [c.strip().strip('`"') for c in m[2][1:-1].split(",")] if m[2] else [c.name for c in t.columns]
        if len(set(given)) != len(given):
            raise ParseError("a column is given twice")
        given = [t.column(c).name for c in given]
        source = self._select(m[3] + m[4], params)
        if len(source.columns) != len(given):
            raise ExecutionError(f"{len(source.columns)} values for {len(given)} columns")
        source = source.toDF(*[f"_{i}" for i in range(len(given))])
        kinds = dict(source.dtypes)
        columns = []
        for c in t.columns:
            if c.name in given:
                at = f"_{given.index(c.name)}"
                columns.append(tp.coerce(F.col(at), c.type, kinds[at] == "string").alias(c.name))
            else:
                columns.append((F.expr(translate(c.default)) if c.default else F.lit(None)).cast(tp.spark_type(c.type)).alias(c.name))
        rows = cut(source.select(*columns))
        self._validate(name, t, rows, t.data, added=True)
        self._write(name, t, self._joined(t, rows), "insert", appended=rows)
        return Result(affected=rows.count())

    def _joined(self, t: Table, rows: DataFrame) -> DataFrame:
        """The table's rows and further ones, as they lie; written as one when there are too many parts."""
        data = t.data.union(rows)
        return cut(data) if len(files(data)) > PARTS else data

    def _over(self, name: str, columns: str, params) -> DataFrame:
        """`columns` of a table, in which conditions may hold parameters and subqueries."""
        return self._select(f"SELECT {columns} FROM `{name}`", params)

    def _update(self, text: str, params) -> Result:
        m = re.match(r"(?is)UPDATE\s+([\w.`\"]+)\s+SET\s+(.*)$", text)
        if not m:
            raise ParseError(text)
        name, t = self.named(m[1]), self.table(m[1])
        sets, where = cut_keyword(m[2], "WHERE")
        values = {}
        for part in split_top(sets):
            column, _, value = part.partition("=")
            values[t.column(column.strip().strip('`"')).name] = value.strip()
        given = "".join(f", {v} AS __v{i}" for i, v in enumerate(values.values()))
        marked = self._over(name, f"*, coalesce(({where or 'true'}), false) AS __hit{given}", params)
        kinds, at = dict(marked.dtypes), {c: f"__v{i}" for i, c in enumerate(values)}
        # a value is coerced, and may fail, only where it is taken
        new = [F.when(F.col("__hit"), tp.coerce(F.col(at[c.name]), c.type, kinds[at[c.name]] == "string")).otherwise(F.col(c.name)).alias(c.name) if c.name in values else F.col(c.name) for c in t.columns]
        out = cut(marked.select(*new, "__hit"))
        n = out.filter("__hit").count()
        if not n:
            return Result()
        self._validate(name, t, out.filter("__hit").drop("__hit"), out.drop("__hit"), values.keys())
        for child, c in self._children(name):
            if c.references[1] in values:
                self._restrict(t.data.join(out.select(c.references[1]), c.references[1], "left_anti"), child, c)
        self._write(name, t, out.drop("__hit"), "update")
        return Result(affected=n)

    def _delete(self, text: str, params) -> Result:
        m = re.match(r"(?is)DELETE\s+FROM\s+([\w.`\"]+)\s*(?:WHERE\s+(.*))?$", text)
        if not m:
            raise ParseError(text)
        name, t = self.named(m[1]), self.table(m[1])
        marked = self._over(name, f"*, coalesce(({m[2] or 'true'}), false) AS __hit", params)
        gone = marked.filter("__hit").drop("__hit")
        n = gone.count()
        for child, c in self._children(name):
            self._restrict(gone, child, c)
        if n:
            self._write(name, t, cut(marked.filter("NOT __hit").drop("__hit")), "delete")
        return Result(affected=n)

    def _children(self, name: str):
        return [(n, c) for n, t in self.visible.items() for c in t.columns if c.references and c.references[0].lower() == name.lower()]

    def _restrict(self, gone: DataFrame, child: str, c: ColumnMeta) -> None:
        keys = gone.select(F.col(c.references[1]).alias("__k"))
        held = self.visible[child].data
        if not held.join(keys, held[c.name] == keys["__k"], "left_semi").isEmpty():
            raise ConstraintViolation(f"{child}.{c.name} refers to rows that would go")

    @staticmethod
    def _unique(rows: DataFrame, column: str) -> None:
        if not rows.filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1").isEmpty():
            raise ConstraintViolation(f"{column} is not unique")

    @staticmethod
    def _absent(new: DataFrame, there: DataFrame, column: str) -> None:
        """No value of new is in there."""
        keys = there.select(F.col(column).alias("__k"))
        if not new.join(keys, new[column] == keys["__k"], "left_semi").isEmpty():
            raise ConstraintViolation(f"{column} is not unique")

    def _validate(self, name: str, t: Table, new: DataFrame, whole: DataFrame, touched=None, added: bool = False) -> None:
        """One aggregate for what concerns single rows, then a job for each key that was written. `whole` holds new, or with `added` the rows that were there before."""
        tests = []
        for c in t.columns:
            if not c.nullable:
                tests.append((f"{c.name} is null", F.col(c.name).isNull()))
            if c.check:
                tests.append((f"CHECK {c.check}", ~F.coalesce(F.expr(translate(c.check)), F.lit(True))))
        if tests:
            found = new.agg(*[F.coalesce(F.max(x), F.lit(False)).alias(f"x{i}") for i, (_, x) in enumerate(tests)]).first()
            for i, (what, _) in enumerate(tests):
                if found[i]:
                    raise ConstraintViolation(what)
        for c in t.columns:
            if touched is not None and c.name not in touched:
                continue
            if c.primary or c.unique:
                self._unique(new if added else whole, c.name)
                if added:
                    self._absent(new, whole, c.name)
            if c.references:
                own = c.references[0].lower() == name.lower()
                parent = (whole.union(new) if added else whole) if own else self.table(c.references[0]).data
                keys = new.filter(F.col(c.name).isNotNull()).select(F.col(c.name).alias("__k"))
                if not keys.join(parent, keys["__k"] == parent[c.references[1]], "left_anti").isEmpty():
                    raise ConstraintViolation(f"{c.name} refers to no row of {c.references[0]}")

    def _write(self, name: str, t: Table, data: DataFrame, kind: str, appended: DataFrame | None = None) -> None:
        if not self.tx and self.log:  # before any reader can see it
            self.log.append(name, kind, appended if appended is not None else data)
        self.versions.replaced.append(t)
        self.visible[name] = replace(t, data=data, version=t.version + 1)
        if self.tx:
            if appended is not None:
                self.tx.appended.setdefault(name, []).append(appended)
            else:
                self.tx.rewritten.add(name)

    # transactions

    def _begin(self) -> Result:
        if self.tx:
            raise ExecutionError("a transaction is open")
        self.tx = Transaction(dict(self.tables), dict(self.tables))
        return Result()

    def _commit(self) -> Result:
        if not self.tx:
            raise ExecutionError("no transaction is open")
        tx, self.tx = self.tx, None
        self.publish(tx)
        return Result()

    def publish(self, tx: Transaction) -> None:
        """All new versions of a transaction at once, or none; logged before they are seen."""
        ready: dict[str, Table] = {}
        for name in tx.written:
            now = self.tables.get(name)
            if now is None or now.columns != tx.base[name].columns:
                raise Conflict(name)
            if now.version == tx.base[name].version:
                ready[name] = tx.tables[name]
            elif name in tx.rewritten:
                raise Conflict(name)
            else:
                data = now.data
                for rows in tx.appended[name]:
                    for c in now.columns:
                        if c.primary or c.unique:
                            self._absent(rows, data, c.name)
                    data = data.union(rows)
                ready[name] = replace(now, data=data, version=now.version + 1)
        self._referred(tx, ready)
        if self.log:
            self.log.commit([(name, "commit", t.data) for name, t in ready.items()])
        self.versions.replaced += [self.tables[name] for name in ready]
        self.tables.update(ready)

    def _referred(self, tx: Transaction, ready: dict[str, Table]) -> None:
        """Foreign keys between a table that is published and one that others changed since BEGIN."""
        after = {**self.tables, **ready}
        for child, t in after.items():
            for c in t.columns:
                parent = next((n for n in after if c.references and n.lower() == c.references[0].lower()), None)
                if not c.references or not {child, parent} & ready.keys():
                    continue
                if parent is None:
                    raise Conflict(child)
                if all(n in tx.base and self.tables[n].version == tx.base[n].version for n in (child, parent)):
                    continue  # as the statements saw them
                keys, there = t.data.filter(F.col(c.name).isNotNull()).select(F.col(c.name).alias("__k")), after[parent].data
                if not keys.join(there, keys["__k"] == there[c.references[1]], "left_anti").isEmpty():
                    raise ConstraintViolation(f"{child}.{c.name} would refer to no row of {parent}")

    def checkpoint(self) -> None:
        """Writes every table whole to the log, which is then read from there on."""
        if not self.log:
            raise ExecutionError("the engine has no log")
        self.log.checkpoint({name: t.data for name, t in self.tables.items()})

    def vacuum(self) -> int:
        """Frees the versions that no engine of the family and no open transaction holds, their checkpoint files with them; returns how many.

        Results of earlier queries that were not yet collected hold no versions.
        """
        held: list[Table] = []
        for engine in list(self.versions.users):
            held += engine.tables.values()
            for tx in (engine.tx, *(c.tx for c in list(engine.open))):
                if tx:
                    held += [*tx.base.values(), *tx.tables.values()]
        kept = {id(t.data) for t in held}
        live = set().union(*[files(df) for df in {id(t.data): t.data for t in held}.values()]) if held else set()
        dead = {id(t.data): t for t in self.versions.replaced if id(t.data) not in kept}
        self.versions.replaced = [t for t in self.versions.replaced if id(t.data) in kept]
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for file in set().union(*[files(t.data) for t in dead.values()]) - live if dead else ():
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(conf).delete(path, True)
        return len(dead)


class Connection:
    """A second writer on the same engine, with its own transaction; statements of all connections take turns."""

    def __init__(self, engine: Engine):
        self.engine, self.tx = engine, None
        engine.open.add(self)

    def execute(self, sql: str, *params) -> Result:
        with self.engine.lock:
            self.engine.tx, held = self.tx, self.engine.tx
            self.tx = held  # while it runs, the engine's own transaction is kept here
            try:
                return self.engine.execute(sql, *params)
            finally:
                self.tx, self.engine.tx = self.engine.tx, held

    def query(self, sql: str, *params) -> DataFrame:
        return self.execute(sql, *params).rows
