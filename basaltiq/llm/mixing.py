"""Mixing sources to target weights, with DataFrame operations only.

Each source's texts are laid end to end and packed into blocks of `block`
tokens (words). Targets share the size of the whole by weight, none above
`most_epochs` times its source; what exceeds that is shared again by weight.
A source gets as many block slots as its target asks for, its quota. All slots
are dealt to output shards of `shard_slots` by one pseudorandom permutation, so
the counts of sources in a shard are a multinomial draw, given the quotas.
These counts say which slots exist: a source's slots are numbered through its
shards, by prefix sums of its counts. Slot j of a source takes block
perm(j mod blocks) in epoch j div blocks, where perm is a pseudorandom
permutation of the source's block indices (a swap-or-not network), so no block
is taken more than once in an epoch. Slots join blocks by (source, block).

Prefix sums have two levels, groups of bounded size and the sums of the groups,
so a source that holds a third of all rows is never one task's work.

Cases: null text has size 0; documents of size 0 take no part and have taken
0. A null source is a source of its own, last in order. A source of size 0 has
target 0. Repeated rows are documents each. A very long text is many blocks, no
text is cut short. Columns other than the named ones are never read by mix, and
kept by remix. An empty table gives no rows.
All draws depend on the rows and `seed` alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 10
SMALL = 500_000  # rows of one source each, of at most some 60 bytes and its name


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def sizes(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, size and a tie-break of each row; the only pass over the texts."""
    t = F.col(text)
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(t).alias("tie"))


def targets(rows: DataFrame, weights=(5, 2, 1), most_epochs: int = 3, block: int = 64) -> DataFrame:
    """sid, source, source_size, target, blocks, slots: one row for each source."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over one row a source
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("sid", F.row_number().over(order) - 1).withColumn("w", w).withColumn("cap", F.col("source_size") * most_epochs)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(every))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    free = F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("sid"), F.col("level").alias("level")))
    per = per.withColumn("final", F.min(free).over(every)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("w"), F.col("cap").cast("double")))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    per = per.withColumn("target", target).withColumn("blocks", blocks)
    slots = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * most_epochs)).otherwise(F.lit(0).cast("long"))
    return per.select("sid", "source", "source_size", "target", "blocks", slots.alias("slots"))


def permuted(x: Column, size: Column, *seed: Column) -> Column:
    """The image of x under a pseudorandom permutation of 0 .. size - 1: in each round of a swap-or-not network, x and its partner (a constant - x) change places or not, by a hash of the larger of the two."""

    def step(at, r):
        partner = F.pmod(F.pmod(F.xxhash64(*seed, r), size) - at, size)
        swap = F.pmod(F.xxhash64(*seed, r, F.greatest(at, partner)), F.lit(2)) == 0
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


def draws(plan: DataFrame, shard_slots: int = 1024, seed: int = 0, chunk: int = 1 << 14) -> DataFrame:
    """shard, sid, n: the draw of each output shard, how many of its slots each source has."""
    # a source's slots begin at `lower` in the line of all slots
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)  # over one row a source
    lined = plan.withColumn("lower", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn("total", F.sum("slots").over(Window.partitionBy())).filter("slots > 0")
    # in chunks, so that no row makes more than `chunk` rows; a given number of partitions isn't coalesced, however few the rows before they are exploded
    rows = lined.select("sid", "lower", "slots", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(chunk).cast("long"))).alias("from"))
    rows = rows.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid", "from")
    rows = rows.withColumn("slot", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + chunk, F.col("slots")) - 1)))
    place = permuted(F.col("lower") + F.col("slot"), F.col("total"), F.lit(seed), F.lit("shard"))
    return rows.select("sid", F.floor(place / shard_slots).alias("shard")).groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))


def running(rows: DataFrame, by: str, order: list, value: str, group) -> DataFrame:
    """rows with `before`: the sum of `value` over the rows of the same `by` that come before; `group` rises with `order` and holds a bounded number of rows."""
    rows = rows.withColumn("_g", group)
    sums = rows.groupBy(by, "_g").agg(F.sum(value).alias("_sum"))
    base = F.coalesce(F.sum("_sum").over(Window.partitionBy(by).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col(by).alias("_b"), F.col("_g").alias("_h"), base.alias("_base"))
    within = Window.partitionBy(by, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inside.join(sums, (F.col(by) == F.col("_b")) & (F.col("_g") == F.col("_h"))).withColumn("before", F.col("_base") + F.col("_in")).drop("_g", "_in", "_b", "_h", "_base")


def slots(plan: DataFrame, shard_slots: int = 1024, seed: int = 0, chunk: int = 1 << 14) -> DataFrame:
    """sid, shard, slot, epoch, block: one row for each block slot of the mix, as the draws of the shards have it."""
    drawn = held(draws(plan, shard_slots, seed, chunk))
    numbered = running(drawn, "sid", ["shard"], "n", F.floor(F.col("shard") / 4096))
    numbered = numbered.join(small(plan.select(F.col("sid").alias("s"), "blocks")), F.col("sid") == F.col("s"))
    # few rows that become many: a given number of partitions isn't coalesced
    numbered = numbered.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid", "shard")
    rows = numbered.withColumn("slot", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)))
    rows = rows.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks"))).withColumn("at", F.pmod(F.col("slot"), F.col("blocks")))
    return rows.select("sid", "shard", "slot", "epoch", permuted(F.col("at"), F.col("blocks"), F.lit(seed), F.col("sid"), F.col("epoch")).alias("block"))


def packed(rows: DataFrame, plan: DataFrame, bucket_rows: int = 2000) -> DataFrame:
    """doc_id, sid, size, tie, at (offset of its first token in its source) of each row of positive size."""
    rows = rows.filter("size > 0").join(small(plan.select("sid", F.col("source").alias("s"))), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    n = rows.count()
    bucket = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(max(1, -(-n // bucket_rows))))
    return running(rows, "sid", ["doc_id", "tie", "size"], "size", bucket).select("doc_id", "sid", "size", "tie", F.col("before").alias("at"))


def takes(docs: DataFrame, text: str, key: str, source: str, weights, most_epochs: int, block: int, seed: int):
    """The rows with their sizes, the plan, and for each piece of a document in a block: doc_id, sid, size, tie, at, words, lo (place of its first word in the document), uses."""
    rows = held(sizes(docs, text, key, source))
    plan = cut(targets(rows, weights, most_epochs, block))
    uses = slots(plan, seed=seed).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))
    spread = packed(rows, plan).withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    lo = F.greatest(F.col("at"), F.col("block") * block)
    spread = spread.withColumn("words", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - lo).withColumn("lo", lo - F.col("at"))
    # the plan's estimate of `uses` doesn't see that rows were exploded, and would broadcast them
    pieces = spread.join(uses.hint("shuffle_merge"), ["sid", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return rows, plan, pieces


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights=(5, 2, 1), most_epochs: int = 3, block: int = 64, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row of docs."""
    rows, plan, pieces = takes(docs, text, key, source, weights, most_epochs, block, seed)
    taken = pieces.groupBy("sid", "at").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum(F.col("words") * F.col("uses")).cast("long").alias("taken"))
    about = small(plan.select("sid", F.col("source").alias("s"), "source_size", "target"))
    some = taken.join(about, "sid").select("doc_id", F.col("s").alias("source"), "size", "source_size", "target", "taken")
    none = rows.filter("size = 0").join(about, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)


def remix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights=(5, 2, 1), most_epochs: int = 3, block: int = 64, seed: int = 0) -> DataFrame:
    """The text of the mix, with the columns of docs: a row for each epoch in which a document has a word in a taken block.

    In the epochs that a source's target fills, that is the whole text; in the
    last one, it is those of its words, with the white space after them, whose
    blocks were drawn. So a source's words are those of its slots, and rows whose text was cut say so by nothing but their text.
    """
    import uuid

    u = f"_{uuid.uuid4().hex[:8]}"
    _, plan, pieces = takes(docs, text, key, source, weights, most_epochs, block, seed)
    epochs = small(plan.select(F.col("sid").alias("s"), F.col("source").alias("name"), F.when(F.col("blocks") > 0, F.floor(F.col("slots") / F.col("blocks"))).otherwise(0).cast("int").alias("epochs")))
    pieces = pieces.join(epochs, F.col("sid") == F.col("s"))
    extra = F.when(F.col("uses") > F.col("epochs"), F.struct(F.col("lo").cast("int").alias("lo"), F.col("words").cast("int").alias("words")))
    each = pieces.groupBy("sid", "at").agg(*[F.first(c).alias(c) for c in ("doc_id", "name", "size", "tie", "epochs")], F.array_sort(F.collect_list(extra)).alias("extra"))
    # repeated rows are one row here, with the pieces of each
    taken = each.groupBy("doc_id", "name", "tie", "size").agg(F.first("epochs").alias("epochs"), F.count(F.lit(1)).alias("n"), F.collect_list("extra").alias("extra"))
    taken = taken.select(F.col("doc_id").alias(f"{u}i"), F.col("name").alias(f"{u}s"), F.col("tie").alias(f"{u}t"), F.col("size").alias(f"{u}z"), F.col("epochs").alias(f"{u}e"), F.col("n").alias(f"{u}n"), F.col("extra").alias(f"{u}x"))
    taken = held(taken.filter((F.col(f"{u}e") > 0) | F.exists(f"{u}x", lambda x: F.size(x) > 0)))
    both = docs.join(taken, docs[key].eqNullSafe(F.col(f"{u}i")) & docs[source].eqNullSafe(F.col(f"{u}s")) & (F.xxhash64(docs[text]) == F.col(f"{u}t")))
    if not taken.filter(F.col(f"{u}n") > 1).isEmpty():
        both = both.filter(F.col(f"{u}n") == 1).unionByName(both.filter(F.col(f"{u}n") > 1).dropDuplicates([key, source, text]))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    both = both.withColumn(f"{u}w", F.when(F.exists(f"{u}x", lambda x: F.aggregate(x, F.lit(0), lambda a, r: a + r.words).between(1, F.col(f"{u}z") - 1)), words))
    whole = lambda x: F.aggregate(x, F.lit(0), lambda a, r: a + r.words) == F.col(f"{u}z")
    cut_out = lambda x: F.array_join(F.flatten(F.transform(x, lambda r: F.slice(F.col(f"{u}w"), r.lo + 1, r.words))), "")
    parts = F.transform(F.filter(f"{u}x", lambda x: F.size(x) > 0), lambda x: F.when(whole(x), F.col(text)).otherwise(cut_out(x)))
    full = F.array_repeat(F.col(text), (F.col(f"{u}e") * F.col(f"{u}n")).cast("int"))
    out = both.withColumn(f"{u}o", F.explode(F.concat(full, parts)))
    return out.select(*[F.col(f"{u}o").alias(c) if c == text else F.col(c) for c in docs.columns])
