import hashlib

import tracemalloc

import corpus_pipeline as P
from basaltiq.llm import common, langid, mixing, secrets
from basaltiq.llm.bpe import codec
from pyspark.sql import functions as F


def test_stages_keep_columns_and_decide(spark, small, documents):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        docs = out
    got = P.run(spark, small)
    c = codec(*P.tokenizer())
    want = sorted((r.doc_id, len(c.encode(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got.collect()) == want


def test_odd_rows(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "12 !!"), (4, "the same text of some words here"), (5, "the same text of some words here"), (6, 'a password = "abcdefghij" word', None), (7, "x " * 50_000)])
    one = P.language_id(spark, docs, "")
    assert sorted(r.doc_id for r in one.collect()) == [4, 5, 6, 7]
    two = P.near_dedup(spark, one, "")
    assert sorted(r.doc_id for r in two.collect()) == [4, 6, 7]
    three = {r.doc_id: r for r in P.secret_scan(spark, two, "").collect()}
    assert "abcdefghij" not in three[6].text and three[6].n_chars == len(three[6].text)
    assert P.mix(spark, two, "").columns == docs.columns
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_mix_stage_meets_its_targets(spark):
    """On sf0.01, from the stage's own input and output: words of each source within 2 % of its target."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = F.regexp_count("text", F.lit(mixing.WORD))
    target = {r.source: r.target for r in mixing.targets(mixing.sizes(docs)).collect()}
    got = {r.source: r.n for r in P.mix(spark, docs, "").groupBy("source").agg(F.sum(words).alias("n")).collect()}
    for source, want in target.items():
        assert abs(got[source] / want - 1) < 0.02, (source, got[source], want)


def test_language_stage_rejects_what_no_tree_knows(spark, documents):
    plain = [(i, f"the small words of some text number {i} and the others", "en") for i in range(40)]
    strange = [(100, "漢字の文章は木にない", None), (102, "the words of a text", None), (103, None, "en")]
    out = {r.doc_id: r.lang for r in P.language_id(spark, documents(plain + strange), "").collect()}
    assert out == {i: "en" for i in range(40)} | {102: "en"}
    nothing = documents([(1, "abc", None), (2, "12", None)])
    assert [(r.doc_id, r.lang) for r in P.language_id(spark, nothing, "").collect()] == [(1, None)]


def test_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "secret_scan", "mix", "encode"]
    assert langid and secrets


def test_run_lets_go_of_what_its_stages_held(spark, small):
    """The driver keeps no plan of a finished stage; what others hold stays."""
    other = common.held(spark.range(3))
    before = common.holding()
    P.run(spark, small)
    assert [id(x) for x in common.holding()] == [id(x) for x in before] and other.storageLevel != common.NOWHERE
    common.let_go()


def test_held_forgets_what_was_let_go_of_elsewhere(spark):
    common.let_go()
    common.held(spark.range(3))
    spark.catalog.clearCache()
    last = common.held(spark.range(4))
    assert common.holding() == [last]
    common.let_go()
    assert last.storageLevel == common.NOWHERE and not common.holding()


def test_plan_of_redaction_finds_runs_once(spark, documents):
    """The runs' pattern stands in the plan as often as in the plan of the spans alone."""
    docs = documents([(1, 'a password = "abcdefghij" word'), (2, None), (3, "q7Zk2Lw9Xc4Vb8Nm1Rt6Yp3Hs5Jd0Fg " * 3)])
    times = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count(secrets.RUN)
    assert times(secrets.redact(docs)) == times(secrets.spans_of(docs, "text")) > 0


def test_learning_trees_takes_bounded_memory():
    """At most 50 bytes of arrays for each byte learned from, beside the trees."""
    words = [b"%d" % (i * 7919 % 5003) for i in range(40_000)]
    texts = {g: [b" ".join(words[i::2]) * 4] for i, g in enumerate(("en", "fr"))}
    size = sum(len(t) for ts in texts.values() for t in ts)
    tracemalloc.start()
    langid.PPM(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 * size, most / size
