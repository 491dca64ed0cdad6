"""Entities kept by a journal: routing, payload contracts, outbox, snapshots, lifecycle, bulk calls.

An entity table has one row an entity; which columns a function reads is in its
signature. Each function declares a plan and leaves its input as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Conflict, ConstraintViolation, ExecutionError
from .journal import latest

#: fixed values: offset basis and prime of 64-bit FNV-1a, and the byte between type and id
FNV_BASIS, FNV_PRIME, BETWEEN = 14695981039346656037, 1099511628211, 0xFF
LOW = (1 << 32) - 1
#: fixed values: payload types as the JSON text of a value shows them
KINDS = ("null", "boolean", "integer", "float", "text", "array", "object")


def fnv1a(*bytes_: Column) -> tuple[Column, Column]:
    """High and low half of the hash of arrays of byte values, one after the other.

    Halves of 32 bits keep every product below 2**42, so nothing overflows:
    the prime is 2**40 + 435, and h * 2**40 moves the low half up by 8 bits.
    """
    start = F.struct(F.lit(FNV_BASIS >> 32).cast("long").alias("h"), F.lit(FNV_BASIS & LOW).cast("long").alias("l"))

    def step(s, b):
        x = s.l.bitwiseXOR(b)
        low = x * (FNV_PRIME & LOW)
        high = s.h * (FNV_PRIME & LOW) + F.shiftrightunsigned(low, 32) + x * (FNV_PRIME >> 32)
        return F.struct(high.bitwiseAND(F.lit(LOW)).alias("h"), low.bitwiseAND(F.lit(LOW)).alias("l"))

    end = F.aggregate(F.concat(*bytes_), start, step)
    return end.h, end.l


def byte_values(text: Column) -> Column:
    """The UTF-8 bytes of a text as an array of longs; none for null."""
    pairs = F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("long"))


def shard_of(entity_type: Column, entity_id: Column, shards: int) -> Column:
    """The shard of an entity: FNV-1a of type, a dividing byte and id, modulo the number of shards. Shard 0 if there are none."""
    if shards == 0:
        return F.lit(0).cast("int")
    high, low = fnv1a(byte_values(entity_type), F.array(F.lit(BETWEEN).cast("long")), byte_values(entity_id))
    return (((high % shards) * ((1 << 32) % shards) + low) % shards).cast("int")


def leaders(shards: int, default: str, named: dict[int, str] | None = None) -> list[str]:
    """The leader of each shard."""
    named = named or {}
    if shards < 1 or not default.strip() or any(not 0 <= s < shards for s in named):
        raise ExecutionError("a routing table needs a shard, a default leader and leaders of shards that exist")
    return [named.get(s, default) for s in range(shards)]


def kind_of(value: Column) -> Column:
    """The payload type of a variant; null where there is none."""
    s = F.schema_of_variant(value)
    whole = s.isin("BIGINT") | s.rlike(r"^DECIMAL\(\d+,0\)$")
    return (
        F.when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(whole, "integer").when(s.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "float")
        .when(s == "STRING", "text").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")
    )


def payload_fault(payload: Column, required: dict[str, str], optional: dict[str, str] | None = None, extra: bool = True, root: str = "object") -> Column:
    """What a JSON payload breaks of its contract, null if nothing; the first fault in the order root, fields as given, extra fields.

    A float field takes any number. Null or malformed text has the wrong root.
    """
    fields = {**required, **(optional or {})}
    if bad := [k for k in (root, *fields.values()) if k not in KINDS]:
        raise ExecutionError(f"no payload types: {bad}")
    value = F.try_parse_json(payload)

    def fits(found: Column, kind: str) -> Column:
        return found.isin("integer", "float") if kind == "float" else found == kind

    fault = F.when(~F.coalesce(fits(kind_of(value), root), F.lit(False)), F.lit("root"))
    if root != "object":
        return fault
    for name, kind in fields.items():
        found = kind_of(F.try_variant_get(value, f"$['{name}']", "variant"))
        if name in required:
            fault = fault.when(found.isNull(), F.lit(f"missing {name}"))
        fault = fault.when(found.isNotNull() & ~fits(found, kind), F.lit(f"type of {name}"))
    if not extra:
        more = F.array_sort(F.array_except(F.json_object_keys(payload), F.array(*map(F.lit, fields)).cast("array<string>")))
        fault = fault.when(F.size(more) > 0, F.concat(F.lit("unexpected "), F.get(more, 0)))
    return fault


def outbox(journal: DataFrame) -> DataFrame:
    """The last record of each message of a journal with outbox_id, seq, status and created."""
    return latest(journal, "outbox_id")


def pending(journal: DataFrame) -> DataFrame:
    """Messages not yet dispatched, oldest first."""
    return outbox(journal).filter("status = 'pending'").orderBy("created", "outbox_id")


def dispatched(journal: DataFrame, ids: DataFrame) -> DataFrame:
    """The records to append when the messages of ids (outbox_id) have been sent; none for those marked before. They share one seq, as one batch."""
    now, wanted = outbox(journal), ids.select("outbox_id").distinct()
    if not (lost := wanted.join(now, "outbox_id", "left_anti").limit(1)).isEmpty():
        raise ExecutionError(f"no such message: {lost.first()[0]}")
    top = journal.agg(F.max("seq")).first()[0] or 0
    return now.join(wanted, "outbox_id", "left_semi").filter("status = 'pending'").withColumn("status", F.lit("dispatched")).withColumn("seq", F.lit(top + 1).cast(journal.schema["seq"].dataType)).select(*journal.columns)


def compacted(snapshot: DataFrame | None, journal: DataFrame) -> DataFrame:
    """A new snapshot: the last record of each entity in a snapshot and the journal written since. Deletes are gone."""
    return latest(journal if snapshot is None else snapshot.unionByName(journal))


def tail(journal: DataFrame, last_seq: int) -> DataFrame:
    """What a journal keeps once a snapshot up to last_seq is written."""
    return journal.filter(F.col("seq") > last_seq)


def restored(existing: DataFrame, snapshot: DataFrame, key: str, conflict: str = "fail") -> DataFrame:
    """A table with the rows of a snapshot. Rows with a key that exists: 'fail' raises Conflict, 'skip' keeps what exists, 'overwrite' takes the snapshot's."""
    if conflict not in ("fail", "skip", "overwrite"):
        raise ExecutionError(f"no such policy: {conflict}")
    if conflict == "fail" and not (both := snapshot.join(existing, key, "left_semi").limit(1)).isEmpty():
        raise Conflict(f"{key} {both.first()[key]} exists")
    if conflict == "overwrite":
        return existing.join(snapshot, key, "left_anti").unionByName(snapshot)
    return existing.unionByName(snapshot.join(existing, key, "left_anti"))


def batched(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table (key, version, fields) after a batch of changes (key, op, expected, the same fields), all of them or none.

    create adds a row of version 1; update sets every field, patch those that
    are not null, and both raise the version; delete removes the row. Raises
    ConstraintViolation where a created key exists or a key is null, Conflict
    where two changes meet on a key or expected isn't the version (null
    expects nothing), ExecutionError where there is nothing to change or an op
    is unknown. One join checks all of it, another writes.
    """
    fields = [c for c in table.columns if c not in (key, "version")]
    twice = changes.groupBy(key).agg(F.count(F.lit(1)).alias("times"), F.first("op").alias("op"), F.first("expected").alias("expected"))
    held_now = table.select(F.col(key).alias("_k"), F.col("version").alias("_v"))
    met = twice.join(held_now, F.col(key) == F.col("_k"), "left")
    create, there = F.col("op") == "create", F.col("_k").isNotNull()
    faults = {
        "op": ~F.coalesce(F.col("op").isin("create", "update", "patch", "delete"), F.lit(False)),
        "key": F.col(key).isNull(), "twice": F.col("times") > 1, "unique": create & there, "missing": ~create & ~there,
        "version": ~create & there & F.col("expected").isNotNull() & (F.col("expected") != F.col("_v")),
    }
    found = met.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in faults.items()]).first()
    kinds = {"op": ExecutionError, "key": ConstraintViolation, "twice": Conflict, "unique": ConstraintViolation, "missing": ExecutionError, "version": Conflict}
    for name, kind in kinds.items():
        if found[name]:
            raise kind(f"{name}: {found[name]} keys of the batch; none of it was applied")
    new = changes.select(F.col(key).alias("_k"), F.col("op").alias("_op"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    both = table.join(new, F.col(key) == F.col("_k"), "full").filter(~F.coalesce(F.col("_op") == "delete", F.lit(False)))

    def value(c: str) -> Column:
        return F.when(F.col("_op").isNull(), F.col(c)).when(F.col("_op") == "patch", F.coalesce(f"_new_{c}", c)).otherwise(F.col(f"_new_{c}")).alias(c)

    version = F.when(F.col("_op").isNull(), F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1)
    made = {key: F.coalesce(key, "_k").alias(key), "version": version.cast(table.schema["version"].dataType).alias("version")}
    return both.select(*[made.get(c, value(c) if c in fields else None) for c in table.columns])


def migrated(rows: DataFrame, version: int, steps: dict[int, Callable[[DataFrame], DataFrame]], to: int) -> DataFrame:
    """Rows of a schema version brought to another, by one step for each version in between."""
    for v in range(version, to):
        if v not in steps:
            raise ExecutionError(f"no migration from version {v}")
        rows = steps[v](rows)
    return rows


def stale(items: DataFrame, now: Column, max_age: str) -> Column:
    """Whether an item (touches, created) was never touched and is older than max_age, an interval."""
    return (F.col("touches") == 0) & (F.col("created") < now - F.expr(f"INTERVAL {max_age}"))


def pruned(items: DataFrame, now: Column, max_age: str) -> DataFrame:
    """Items without the stale ones; those with a null among the columns stay."""
    return items.filter(~F.coalesce(stale(items, now, max_age), F.lit(False)))


def smallest(df: DataFrame, value: Column, count: int) -> tuple[int, int]:
    """The count-th least value of a long column, and how many rows lie below it. Eight counts of 256 groups; no sort."""
    base, below = 0, 0
    df = df.select(value.alias("x"))
    for shift in range(56, -1, -8):
        digit = F.shiftrightunsigned("x", shift).bitwiseAND(F.lit(255))
        if shift == 56:
            digit = digit.bitwiseXOR(F.lit(128))  # signed order
        for r in sorted(df.groupBy(digit.alias("d")).count().collect()):
            if below + r["count"] >= count:
                raw = r.d ^ 128 if shift == 56 else r.d
                base |= raw << shift
                df = df.filter(digit == r.d)
                break
            below += r["count"]
    return base - (1 << 64) if base >> 63 else base, below


def maintained(items: DataFrame, now: Column, passivate_after: str, gc_after: str, max_hot: int | None = None, only_untouched: bool = False, key: str = "entity") -> DataFrame:
    """items (key, place, accessed, touches) with their place after maintenance: hot, cold, or gone.

    Hot ones idle for passivate_after turn cold, and so do the longest idle
    beyond max_hot (ties by hash of the key). Cold ones idle for gc_after go,
    but not those that turned cold just now.
    """
    idle = now - F.col("accessed")
    hot = F.col("place") == "hot"
    passive = hot & (idle >= F.expr(f"INTERVAL {passivate_after}"))
    if max_hot is not None:
        front = items.filter(hot)
        extra = front.count() - max_hot
        if extra > 0:
            micros = F.unix_micros(F.col("accessed").cast("timestamp"))
            edge, below = smallest(front, micros, extra)
            name = F.xxhash64(key)
            last, _ = smallest(front.filter(micros == edge), name, extra - below)
            passive = passive | (hot & ((micros < edge) | ((micros == edge) & (name <= last))))
    gone = (F.col("place") == "cold") & (idle >= F.expr(f"INTERVAL {gc_after}"))
    if only_untouched:
        gone = gone & (F.col("touches") == 0)
    return items.withColumn("place", F.when(passive, "cold").when(gone, "gone").otherwise(F.col("place")))


def invoked(items: DataFrame, name: str, functions: dict[str, Callable], key: str, *arguments: str) -> DataFrame:
    """key, function, status, result: a named function called for each item; a failure is the item's own outcome, not the batch's. Results are text."""
    if name not in functions:
        raise ExecutionError(f"no such function: {name}")
    call, types = functions[name], dict(items.dtypes)

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            status, result = [], []
            for row in zip(*[batch.column(1 + i).to_pylist() for i in range(len(arguments))]):
                try:
                    value = call(*row)
                    status.append("invoked")
                    result.append(None if value is None else str(value))
                except Exception as x:  # noqa: BLE001  the item's outcome
                    status.append(f"failed: {x}")
                    result.append(None)
            names = pa.array([name] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(status, pa.string()), pa.array(result, pa.string())], names=[key, "function", "status", "result"])

    return items.select(key, *arguments).mapInArrow(run, f"`{key}` {types[key]}, function string, status string, result string")
