"""JSON documents as tables: schema inference, CRUD, and JSON output."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFound, ExecutionError, ParseError, TableExists, TableNotFound, Unsupported
from ..session import cut

NAME = re.compile(r"[A-Za-z_]\w{0,62}")
#: fixed values: the lattice of inferred types, by Spark's own inferred ones
KIND = {"bigint": "INTEGER", "double": "FLOAT", "boolean": "BOOLEAN", "string": "TEXT", "void": "TEXT"}
SPARK = {"INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType(), "TEXT": T.StringType(), "JSON": T.StringType()}


def documents(spark: SparkSession, text: str) -> DataFrame:
    """A column `value` of JSON objects, from a JSON array of objects."""
    try:
        rows = json.loads(text)
    except ValueError as e:
        raise ParseError(str(e)) from e
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ParseError("a JSON array of objects is expected")
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")


def spaced(docs: DataFrame, most: int) -> DataFrame:
    """At most `most` rows in even steps. Places follow from the counts of partitions, without a sort."""
    if most < 1:
        return docs.limit(0)
    at = docs.withColumn("_at", F.monotonically_increasing_id())  # partition * 2**33 + place in it
    counts = at.groupBy(F.shiftright("_at", 33).alias("p")).count().collect()  # one row a partition
    total = sum(r["count"] for r in counts)
    if total <= most:
        return docs
    before, starts = 0, {}
    for r in sorted(counts):
        starts[r.p] = before - (r.p << 33)
        before += r["count"]
    shift = F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair])
    place = F.col("_at") + F.element_at(shift, F.shiftright("_at", 33))
    # the rows that begin a new one of `most` equal parts
    part = lambda x: F.floor(x * most / total)
    return at.withColumn("_place", place).filter((F.col("_place") == 0) | (part(F.col("_place")) != part(F.col("_place") - 1))).drop("_at", "_place")


def infer(docs: DataFrame, how: str = "all", sample: int = 100) -> list[tuple[str, str, bool]]:
    """(name, type, nullable) of each field: id first, then by name.

    `first` looks at one document, `sampled` at `sample` in even steps, `all` at every one. Integers widen to
    floats, anything mixed with text or booleans with numbers to text; nested values stay JSON.
    """
    rows = docs.limit(1) if how == "first" else spaced(docs, sample) if how == "sampled" else docs
    parsed = rows.select(F.try_parse_json("value").alias("v"), "value")
    if not parsed.filter("v is null").isEmpty():
        raise ParseError("not JSON")
    pairs = parsed.select(F.explode(F.expr("cast(v as map<string, variant>)")).alias("k", "x"))
    kinds = pairs.select("k", F.schema_of_variant("x").alias("t")).select("k", F.when(F.col("t").startswith("OBJECT") | F.col("t").startswith("ARRAY"), "JSON").when(F.col("t").startswith("DECIMAL") | F.col("t").isin("DOUBLE", "FLOAT"), "FLOAT").when(F.col("t") == "BIGINT", "INTEGER").when(F.col("t") == "BOOLEAN", "BOOLEAN").when(F.col("t") == "VOID", "NULL").otherwise("TEXT").alias("t"))
    got = kinds.groupBy("k").agg(F.collect_set("t").alias("ts"), F.count(F.when(F.col("t") != "NULL", 1)).alias("n")).collect()
    total = rows.count()
    out = []
    for r in got:
        ts = set(r.ts) - {"NULL"}
        kind = "TEXT" if not ts else ts.pop() if len(ts) == 1 else "FLOAT" if ts == {"INTEGER", "FLOAT"} else "TEXT"
        out.append((r.k, kind, r.n < total))
    return sorted(out, key=lambda c: (c[0] != "id", c[0]))


def typed(docs: DataFrame, schema: list[tuple[str, str, bool]]) -> DataFrame:
    fields = T.StructType([T.StructField(n, SPARK[t]) for n, t, _ in schema])
    return docs.select(F.from_json("value", fields).alias("r")).select("r.*")


class Collections:
    """Named collections of documents over an engine's tables."""

    def __init__(self, engine):
        self.engine = engine

    def _name(self, name: str) -> str:
        if not NAME.fullmatch(name):
            raise ParseError(f"not a collection name: {name}")
        return name

    def exists(self, name: str) -> bool:
        return name in self.engine.tables

    def list(self) -> list[str]:
        return sorted(self.engine.tables)

    def create(self, name: str, text: str, how: str = "all") -> int:
        if self.exists(self._name(name)):
            raise TableExists(name)
        docs = documents(self.engine.spark, text)
        data = cut(typed(docs, infer(docs, how)))
        self.engine.register(name, data)
        return data.count()

    def _table(self, name: str):
        if not self.exists(name):
            raise TableNotFound(name)
        return self.engine.tables[name]

    def read(self, name: str, sql: str | None = None) -> str:
        """Rows as a JSON array; sql may only be a SELECT over this collection."""
        self._table(name)
        sql = sql or f"SELECT * FROM {name}"
        if not re.match(r"(?is)\s*SELECT\b", sql) or ";" in sql or "--" in sql or "/*" in sql:
            raise Unsupported("only one SELECT without comments")
        # every relation that Spark's parser finds, those of subqueries too
        plan = self.engine.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
        used = {m.lower() for m in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan)}
        if used - {name.lower()} or "TableValuedFunction" in plan:
            raise Unsupported("another collection")
        return to_json(self.engine.query(sql))

    def update(self, name: str, text: str) -> int:
        """Fields of the documents given, null ones too, replace those of rows with equal id; fields that a document lacks stay."""
        t = self._table(name)
        docs = documents(self.engine.spark, text)
        schema = infer(docs)
        known = {f.name: f.dataType for f in t.data.schema}
        if extra := [n for n, _, _ in schema if n not in known]:
            raise ColumnNotFound(extra[0])
        if "id" not in [n for n, _, _ in schema]:
            raise ExecutionError("documents need an id")
        fields = T.StructType([T.StructField(n, SPARK[k]) for n, k, _ in schema])
        new = docs.select(F.from_json("value", fields).alias("r"), F.expr("map_keys(cast(parse_json(value) as map<string, variant>))").alias("__has"))
        new = new.select(*[F.col(f"r.{c}").cast(known[c]).alias(f"__{c}") for c, _, _ in schema], "__has")
        both = t.data.join(new, t.data["id"] == new["__id"], "left")
        given = {c for c, _, _ in schema}
        data = cut(both.select(*[F.when(F.array_contains("__has", c), F.col(f"__{c}")).otherwise(t.data[c]).alias(c) if c in given else t.data[c] for c in t.data.columns]))
        n = t.data.join(new, t.data["id"] == new["__id"], "left_semi").count()
        self.engine._write(name, t, data, "update")
        return n

    def delete(self, name: str, ids: list) -> int:
        t = self._table(name)
        hit = F.coalesce(F.col("id").cast("string").isin([str(i) for i in ids]), F.lit(False))
        n = t.data.filter(hit).count()
        self.engine._write(name, t, cut(t.data.filter(~hit)), "delete")
        return n

    def drop(self, name: str) -> None:
        self.engine.execute(f"DROP TABLE {name}")


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row: the distributed form of the sink."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def to_json(df: DataFrame) -> str:
    """A JSON array, for results that fit the driver."""
    return "[" + ",".join(r.value for r in to_json_rows(df).toLocalIterator()) + "]"
