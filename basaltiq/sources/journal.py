"""An append-only journal of entity records, and its folds."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "seq long, entity string, kind string, expected long, scope string, payload string"


def latest(journal: DataFrame, key: str = "entity", seq: str = "seq") -> DataFrame:
    """The last record of each entity; deletes are gone. One aggregate, combined on the map side."""
    rest = [c for c in journal.columns if c != key]
    last = journal.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(key, "r.*")
    return last.filter("kind != 'delete'") if "kind" in journal.columns else last


def outcomes(journal: DataFrame) -> DataFrame:
    """Each record with what became of it: `status` (applied, replay, conflict) and `version`, the entity's after it.

    Records of an entity are taken in the order of seq. One whose scope key
    was applied before is a replay and changes nothing; one that expects a
    version the entity hasn't got is a conflict, and may be tried again under
    the same scope key; others raise the version by one. The entity's records
    stream through one task, which holds a scope key only until its last
    record, so a hot entity needs time but no memory.
    """
    again = Window.partitionBy("entity", "scope")
    plain = journal.filter("scope IS NULL").withColumn("until", F.lit(None).cast("long"))
    scoped = journal.filter("scope IS NOT NULL").withColumn("until", F.max("seq").over(again))
    ordered = plain.unionByName(scoped).repartition("entity").sortWithinPartitions("entity", "seq")

    def run(batches):
        entity, version, open_scopes = None, 0, set()
        for batch in batches:
            status, versions = [], []
            columns = [batch.column(c).to_pylist() for c in ("entity", "seq", "expected", "scope", "until")]
            for at, seq, expected, scope, until in zip(*columns):
                if at != entity:
                    entity, version, open_scopes = at, 0, set()
                if scope is not None and scope in open_scopes:
                    status.append("replay")
                elif expected is not None and expected != version:
                    status.append("conflict")
                else:
                    version += 1
                    status.append("applied")
                    if scope is not None and until > seq:
                        open_scopes.add(scope)
                if scope is not None and until <= seq:
                    open_scopes.discard(scope)
                versions.append(version)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(status, pa.string()), pa.array(versions, pa.int64())], names=[*names, "status", "version"])

    names = journal.columns
    types = ", ".join(f"`{n}` {t}" for n, t in journal.dtypes)
    return ordered.mapInArrow(run, f"{types}, status string, version long")


def applied(journal: DataFrame) -> DataFrame:
    """The records that were applied, each with the version it made."""
    return outcomes(journal).filter("status = 'applied'").select("entity", "seq", "kind", "payload", "version")


def projection(journal: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The named fields (JSON path -> type) of the current state of each entity."""
    return latest(journal).select("entity", "seq", *[F.get_json_object("payload", f"$.{n}").cast(t).alias(n) for n, t in fields.items()])


def pages(entities: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    return entities.orderBy(F.col(order).asc_nulls_last()).offset(offset).limit(limit)


class ChangeLog:
    """Committed changes as Parquet in a folder that outlives the session.

    A commit writes the rows of each table it changed, then one file of the
    manifest; only the latter makes it visible, so a commit counts for all its
    tables or for none. An `insert` holds the rows added, other kinds the whole
    table. A checkpoint is a commit of all tables, before which nothing is read.
    """

    MANIFEST = "commit long, name string, kind string, path string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.commits = max((e.commit + 1 for e in self._entries()), default=0)

    def _entries(self) -> list:
        """The manifest since the last checkpoint, in order: one small row for each table a commit changed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        rows = self.spark.read.schema(self.MANIFEST).parquet(f"{self.folder}/manifest")
        start = rows.filter("kind = 'checkpoint'").agg(F.max("commit")).first()[0] or 0
        return rows.filter(F.col("commit") >= start).orderBy("commit", "name").collect()

    def commit(self, changes: list[tuple[str, str, DataFrame | None]]) -> None:
        """Makes changes (table, kind, rows) durable together; a `drop` has no rows."""
        if not changes:
            return
        rows = []
        for table, kind, data in changes:
            path = None if data is None else f"{self.folder}/data/{self.commits:08d}-{uuid.uuid4().hex}"
            if data is not None:
                data.write.parquet(path)
            rows.append((self.commits, table, kind, path))
        self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        self.commits += 1

    def append(self, table: str, kind: str, data: DataFrame) -> None:
        self.commit([(table, kind, data)])

    def checkpoint(self, tables: dict[str, DataFrame]) -> None:
        self.commit([(name, "checkpoint", data) for name, data in tables.items()])

    def recover(self) -> dict[str, DataFrame]:
        """The tables as of the last commit, each from one scan."""
        paths: dict[str, list[str]] = {}
        for e in self._entries():
            if e.kind == "drop":
                paths.pop(e.name, None)
            elif e.kind == "insert":
                paths.setdefault(e.name, []).append(e.path)
            else:
                paths[e.name] = [e.path]
        return {name: self.spark.read.parquet(*ps) for name, ps in paths.items()}
