"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, media, mixing, near_dup, secrets, suffix_dedup, token_counts, toxicity
from .common import crc_mod, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the pattern."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.filter(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents"), with_kept=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(docs, labels.filter(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *tokenizer())


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.document_media(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), *tokenizer())


def queries() -> dict:
    own = (op1_language_id, op2_suffix_dedup, op3_near_dup, op4_permutation_index, op5_toxicity, op6_mixing, op7_bpe, op8_secrets, op9_media, op10_token_counts)
    return {f.__name__: f for f in own}


def op6_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6: all but the words taken."""
    return op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("bounded"))


def op7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7: ids decode to the text's bytes, each to one byte or more."""
    return op7_bpe(spark, sf_dir).select("doc_id", "decoded_sha256", (F.col("n_tokens") > 0).alias("some"))


def op8_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8: the base kinds."""
    return op8_secrets(spark, sf_dir).drop("spans")


def queries() -> dict:
    own = (op1_language_id, op2_suffix_dedup, op3_near_dup, op4_permutation_index, op5_toxicity, op6_mixing, op7_bpe, op8_secrets, op9_media, op10_token_counts)
    return {f.__name__: f for f in (*own, op6_targets, op7_round_trip, op8_base)}


OP2 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT r, unnest(generate_series(0, length(h) // 2 - 200)) AS pos FROM d WHERE length(h) >= 400),
w AS (SELECT s.r, s.pos, md5_number(substr(d.h, CAST(2 * s.pos + 1 AS BIGINT), 400)) AS m FROM s JOIN d USING (r)),
g AS (SELECT m FROM w GROUP BY m HAVING COUNT(*) > 1),
x AS (SELECT r, pos FROM w SEMI JOIN g USING (m)),
o AS (SELECT r, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY r ORDER BY pos) + 200 THEN 0 ELSE 1 END AS new FROM x),
n AS (SELECT r, pos, SUM(new) OVER (PARTITION BY r ORDER BY pos) AS run FROM o),
p AS (SELECT r, run, MIN(pos) AS b, MAX(pos) + 200 AS e FROM n GROUP BY r, run),
k AS (SELECT p.*, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS a FROM p),
c AS (SELECT k.r, COUNT(*) AS n_spans, SUM(k.e - k.b) AS n_removed, MAX(k.e) AS last, string_agg(substr(d.h, CAST(2 * k.a + 1 AS BIGINT), CAST(2 * (k.b - k.a) AS BIGINT)), '' ORDER BY k.b) AS kept FROM k JOIN d USING (r) GROUP BY k.r)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN c.r IS NULL THEN d.h ELSE c.kept || substr(d.h, CAST(2 * c.last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN c ON c.r = d.r"""

OP6 = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w FROM s GROUP BY source),
c AS (SELECT *, 3.0 * source_size / w AS fills, SUM(source_size) OVER () AS total FROM p),
l AS (SELECT *, (total - coalesce(SUM(3 * source_size) OVER b, 0)) / (SUM(w) OVER () - coalesce(SUM(w) OVER b, 0)) AS level FROM c WINDOW b AS (ORDER BY fills, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, fills) AS final FROM l WHERE fills >= level)
SELECT s.doc_id, s.size, l.source_size, ROUND(LEAST(CAST(3 * l.source_size AS DOUBLE), coalesce((SELECT final FROM f) * l.w, CAST(3 * l.source_size AS DOUBLE))), 3) AS target, TRUE AS bounded
FROM s JOIN l ON s.source IS NOT DISTINCT FROM l.source"""

OP7 = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256, length(coalesce(text, '')) > 0 AS some FROM documents"


def _op8() -> str:
    kinds = []
    for k, (kind, (pattern, group, least)) in enumerate(secrets.BASE.items()):
        p = "'" + pattern.replace("{24,}+", "{24,}").replace("'", "''") + "'"
        kinds.append(f"""SELECT r, {k} AS k, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, v, string_split_regex(t, {p}) AS b, {least} AS least
  FROM (SELECT r, t, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS v FROM d) WHERE len(m) > 0""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({" UNION ALL ".join(kinds)}),
y AS (SELECT r, k, kind, m[i] AS m, v[i] AS v, least, SUM(length(b[i])) OVER (PARTITION BY r, k ORDER BY i) + SUM(length(m[i])) OVER (PARTITION BY r, k ORDER BY i) AS stop FROM x),
z AS (SELECT * FROM y WHERE length(v) >= least),
a AS (SELECT r, COUNT(*) FILTER (k = 0) AS n_assign, COUNT(*) FILTER (k = 1) AS n_access, COUNT(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || CAST(stop - length(m) AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY stop - length(m), k) AS spans FROM z GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN a USING (r)"""


OP9 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT r, doc_id, octet_length(raw) AS n, greatest(64, (octet_length(raw) + 63) // 64 * 64) AS size, raw || unhex(repeat('00', CAST(greatest(64, (octet_length(raw) + 63) // 64 * 64) - octet_length(raw) AS BIGINT))) AS payload FROM d),
m AS (SELECT *, encode('P5' || chr(10) || '64 ' || (size // 64) || chr(10) || '255' || chr(10)) || payload AS media FROM p),
b AS (SELECT r, list_transform(regexp_extract_all(hex(payload), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS xs FROM p),
t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
f AS (SELECT r, CAST(list_sum(xs) AS BIGINT) AS s, CAST(list_sum(list_transform(xs, lambda x: x * x)) AS BIGINT) AS q,
  array_to_string(list_transform(range(8), lambda k: len(list_filter(xs, lambda x: x // 32 = k))), '/') AS hist,
  len(list_filter(list_zip(xs[2:], xs[:-2]), lambda z: z[1] > z[2])) AS rises,
  xor(list_reduce([4294967295] || xs[-64:], lambda c, x: xor(c // 256, t.crc[xor(c, x) % 256 + 1])), 4294967295) AS tail FROM b, t)
SELECT m.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(size AS BIGINT) AS payload_bytes, sha256(payload) AS payload_sha256, CAST(f.tail AS BIGINT) AS tail_crc32,
  CAST(octet_length(media) AS BIGINT) AS media_bytes, sha256(media) AS media_sha256, 'sum=' || f.s || ';squares=' || f.q || ';hist=' || f.hist || ';rises=' || f.rises AS feature, CAST(m.doc_id AS VARCHAR) AS caption
FROM m JOIN f USING (r)"""

#: The others use rank files, learned models, hashes of Spark or classes of links, which SQL can't express; their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_suffix_dedup": OP2, "op6_targets": OP6, "op7_round_trip": OP7, "op8_base": _op8(), "op9_media": OP9}
