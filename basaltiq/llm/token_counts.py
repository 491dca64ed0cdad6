"""Token counts by a separator scan of flat, unindexed token files.

A flat file is big-endian 16-bit token ids, document after document, each
followed by the end-of-document id, with no index beside it. 0xC480 is free in
the vocabulary and its two bytes are the UTF-8 form of one character, so
Spark's own text writer lays the files down on any store, with that character
as line separator. A document starts with its id as HEAD tokens below 2**15
(sign folded in), which can't be mistaken for a separator; ids that are null
are written as HEAD tokens of 2**15 - 1.

The scan cuts each file into blocks that ignore document boundaries. For each
block numpy finds all separators at once; what is left of the first one
belongs to a document of an earlier block. A prefix scan over the blocks of a
file (windows of Spark over its small block summaries) gives each block the
position of the last separator before it, and so every document its length.

Cases: null and empty texts are documents of 0 tokens. An empty table gives no
rows. A file that doesn't end in a separator: its last tokens form a document
too. Repeated ids are counted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import scratch

#: fixed values of the file format
EOD, SEPARATOR, HEAD = 0xC480, "Ā", 5
MISSING = (1 << 15) - 1


def head(doc_id) -> list[int]:
    if doc_id is None:
        return [MISSING] * HEAD
    v = doc_id & (2**64 - 1)
    return [(v >> (15 * k)) & 0x7FFF for k in range(HEAD)]


def write_flat(docs: DataFrame, folder: str, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> None:
    """Encodes every row and writes flat files, one for each partition."""

    def run(batches):
        c = codec(path, pattern)
        if len(c.bytes_of) > EOD:
            raise ValueError("the vocabulary has no room for the separator in 16 bits")
        for batch in batches:
            out = [np.array(head(i) + (c.encode(t) if t else []), ">u2").tobytes() for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    flat = docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "value binary")
    flat.select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).text(folder)


def block_summaries(spark: SparkSession, folder: str, block: int = 1 << 20) -> DataFrame:
    """file, block, first token position, size, and separator positions of each block of `block` tokens."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer(content.as_buffer(), ">u2")
                for k, at in enumerate(range(0, len(raw), block)):
                    part = raw[at : at + block]
                    hits = np.flatnonzero(part == EOD) + at
                    heads, ends = [], [*hits.tolist()]
                    starts = [h + 1 for h in ends] if k else [0, *(h + 1 for h in ends)]
                    for s in starts:
                        first = raw[s : s + HEAD].astype(np.int64)
                        heads.append(first.tolist() if len(first) == HEAD else None)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([ends], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())), pa.array([heads], pa.list_(pa.list_(pa.int64())))], names=["file", "block", "size", "ends", "starts", "heads"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "content")
    return files.mapInArrow(run, "file string, block long, size long, ends array<long>, starts array<long>, heads array<array<long>>")


def scan(spark: SparkSession, folder: str, block: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens of each document in the flat files of a folder."""
    blocks = block_summaries(spark, folder, block)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the head of the document that is open where a block begins, and where that document began
    last = F.when(F.size("starts") > 0, F.struct(F.element_at("starts", -1).alias("s"), F.element_at("heads", -1).alias("h")))
    open_ = F.last(last, True).over(before)
    final = F.max("block").over(Window.partitionBy("file"))
    carried = blocks.withColumn("open", open_).withColumn("final", F.col("block") == final)
    # a document ends at each separator of a block and, in the last block, at the end of the file
    ends = F.when(F.col("final"), F.concat("ends", F.array("size"))).otherwise(F.col("ends"))
    begun = F.concat(F.when(F.col("open").isNull(), F.array().cast("array<struct<s:bigint,h:array<bigint>>>")).otherwise(F.array("open")), F.arrays_zip(F.col("starts").alias("s"), F.col("heads").alias("h")).cast("array<struct<s:bigint,h:array<bigint>>>"))
    docs = carried.select(F.explode(F.arrays_zip(ends.alias("e"), F.slice(begun, 1, F.greatest(F.size(ends), F.lit(0))).alias("b"))).alias("d")).select(F.col("d.e").alias("e"), F.col("d.b.s").alias("s"), F.col("d.b.h").alias("h"))
    docs = docs.filter(F.col("h").isNotNull())
    number = sum((F.shiftleft(F.col("h")[k], 15 * k) for k in range(1, HEAD)), F.col("h")[0])
    missing = F.col("h") == F.array(*[F.lit(MISSING).cast("long")] * HEAD)
    return docs.select(F.when(missing, None).otherwise(number).cast("long").alias("doc_id"), (F.col("e") - F.col("s") - HEAD).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", block: int = 1 << 20) -> DataFrame:
    """Writes flat files of all documents to the shared folder and counts them by the scan."""
    spark = docs.sparkSession
    folder = scratch(spark, "flat")
    write_flat(docs, folder, path, pattern, text, key)
    return scan(spark, folder, block)
