import collections
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import DOCS, odd_documents
from tests.llm.test_dedup import brute_components
from tests.llm.test_operators import WORD, exact, numpy_model
from tidemark.llm import minhash, mixing, pii, quality


def test_each_stage_takes_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pseudonyms", "mixing", "tokens"]
    one = quality.stage_quality(spark, docs, sf)
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(kept) and one.columns == docs.columns
    two = minhash.stage_near_duplicates(spark, one, sf)
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in minhash.near_duplicates(one).where("kept").collect()}
    three = pii.stage_pii(spark, two, sf)
    assert {(r.doc_id, r.text, r.n_chars) for r in three.collect()} == {(r.doc_id, pii.rewrite(r.text, pii.session_key(spark))[0], len(pii.rewrite(r.text, pii.session_key(spark))[0])) for r in two.collect()}
    four = mixing.stage_mix(spark, three, sf)
    want = {r.doc_id: r.copies for r in mixing.mix(three).where("copies > 0").collect()}
    assert {r.doc_id: r.n for r in four.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want and four.columns == docs.columns


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids"] and out.count() > 50


def test_run_against_plain_python(spark, sf):
    """Rejected documents by NumPy's model, groups from all pairs, ids by the tokenizer library, copies within the mix's rule."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rules, q = list(quality.votes()), quality.Quality()
    seen = quality.measured(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    cast = quality.stage(seen.select("doc_id", "n_words", "n_repeat_words", *[c.alias(k) for k, c in quality.votes().items()]), "votes").collect()
    cast = [r for r in cast if r.n_words >= q.min_words and 100 * r.n_repeat_words <= q.max_repeat_percent * r.n_words]
    *_, p = numpy_model(np.array([[r[k] for k in rules] for r in cast]), np.ones(len(cast)), q)
    kept = [r.doc_id for r, x in zip(cast, p) if x >= q.least]
    _, component = brute_components([(i, docs[i].text) for i in kept])
    leaders = sorted(i for i in kept if component[i] == i)
    text = {i: pii.rewrite(docs[i].text, pii.session_key(spark))[0] for i in leaders}
    ids = {i: exact().encode_ordinary(t) for i, t in text.items()}
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id].append(list(r.ids))
    assert set(got) <= set(leaders) and all(x == ids[i] for i, rows in got.items() for x in rows)
    words = {i: len(re.findall(WORD, t)) for i, t in text.items()}
    size = collections.Counter()
    for i in leaders:
        size[docs[i].source] += words[i]
    wanted = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(s, n) for s, n in size.items()], "source string, source_size long")).collect()}
    for s, target in wanted.items():
        own = [i for i in leaders if docs[i].source == s]
        assert all(len(got[i]) - target / size[s] < 1 and target / size[s] - len(got[i]) < 1 for i in own if words[i])
        assert abs(sum(words[i] * len(got[i]) for i in own) - target) <= max(words[i] for i in own)


def test_stages_on_odd_rows(spark):
    for docs in (odd_documents(spark, ["a b c d e f", "a b c d e f"]), spark.createDataFrame([], DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert name == "tokens" or out.columns == docs.columns
            out.collect()
