import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.conftest import odd_documents, rows_of
from tidemark.llm._words import text_parts
from tidemark.llm.toxicity import Model, Toxicity, _gradient, learn, locate, op11_toxicity, score, sentences

BAD = ["vile", "rotten", "grimxyz"]


def corpus(n=400, seed=7):
    """Sentences of neutral words; of every fourth document one sentence holds a bad word, in a long or short document."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ta", "ko", "mi", "ru", "se") for b in ("lan", "dor", "fet", "gim", "nop", "qua")]
    docs, labels = [], []
    for i in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randint(2, 9))) for _ in range(rng.choice([1, 3, 40]))]
        bad = i % 4 == 0
        if bad:
            k = rng.randrange(len(lines))
            lines[k] += " " + rng.choice([*BAD[:2], BAD[2][:4] + rng.choice(words)])
        docs.append((i, ". ".join(lines)))
        labels.append((i, int(bad), 1))
    return docs, labels


def test_learns_which_sentences_are_to_blame(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    m = learn(df.where("doc_id < 300"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int").where("doc_id < 300"))
    got = {r.doc_id: r for r in score(df, m).collect()}
    held = [i for i in range(300, 400)]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 95
    texts = dict(docs)
    worst = [texts[i][got[i].worst_start : got[i].worst_start + got[i].worst_length] for i in held if labels[i][1] and got[i].predicted]
    assert len(worst) >= 20 and sum(any(b[:4] in s for b in BAD) for s in worst) == len(worst)
    places = locate(df, m).where("doc_id >= 300").collect()
    assert all(texts[r.doc_id][r.start : r.start + r.length] == r.text for r in places)
    assert {r.doc_id for r in places} <= {i for i in held if got[i].predicted}


def test_scores_are_noisy_or(spark):
    t = Toxicity()
    m = Model(np.zeros(0, np.int64), bias=-1.0, leak=-2.0)
    df = spark.createDataFrame([(1, "One two. Three! four\nfive?"), (2, "..."), (3, None)], "doc_id long, text string")
    p, leak = 1 / (1 + math.exp(1)), 1 / (1 + math.exp(2))
    got = {r.doc_id: r for r in score(df, m, t).collect()}
    assert math.isclose(got[1].score, 1 - (1 - leak) * (1 - p) ** 4) and got[1].n_sentences == 4
    assert math.isclose(got[2].score, leak) and math.isclose(got[3].score, leak) and got[3].worst_score is None


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    bags = [(int(rng.integers(0, 2)), int(rng.integers(0, 3)), [rng.choice(5, rng.integers(1, 4), replace=False).tolist() for _ in range(rng.integers(0, 3))]) for _ in range(12)]
    w, bias, leak = rng.normal(size=5), -0.7, -1.3

    def loss(at):
        out = 0.0
        for toxic, plain, sents in bags:
            z = [at[5] + sum(at[k] for k in s) for s in sents] + [at[5]] * plain + [at[6]]
            clear = math.prod(1 / (1 + math.exp(x)) for x in z)
            out -= math.log(1 - clear) if toxic else math.log(clear)
        return out

    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([b[0] for b in bags], pa.int32()), pa.array([b[1] for b in bags], pa.int64()),
            pa.array([[len(s) for s in b[2]] for b in bags], pa.list_(pa.int32())), pa.array([[k for s in b[2] for k in s] for b in bags], pa.list_(pa.int32())),
        ],
        names=["toxic", "plain", "sizes", "words"],
    )
    out = next(iter(_gradient(w, bias, leak)(iter([batch]))))
    got = dict(zip(out.column("i").to_pylist(), [x / (1 << 24) for x in out.column("x").to_pylist()]))
    at = np.append(w, [bias, leak])
    for k in range(7):
        up, down = at.copy(), at.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert abs((loss(up) - loss(down)) / 2e-6 - got.get(k, 0.0)) < 1e-4
    assert got[7] == len(bags)


def test_sentences_and_words():
    texts = pa.array(["Ab cd. ef!", "", "...", "x\ny é-z"])
    _, _, buf, offs = next(text_parts(texts))
    row, begins, ends, of, bucket = sentences(buf, offs, Toxicity(prefixes=()))
    raw = buf.tobytes()
    assert [(int(r), raw[a:b].decode()) for r, a, b in zip(row, begins, ends)] == [(0, "Ab cd"), (0, "ef"), (3, "x"), (3, "y é-z")]
    assert np.bincount(of).tolist() == [3, 1, 1, 5] and len(bucket) == 10


def test_odd_rows_and_labels(spark):
    docs, labels = corpus(120)
    m = learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (0, 0, 1), (None, 1, 0), (1, None, 0), (5, 7, 0)], "doc_id long, toxic int, quality int"))
    odd = odd_documents(spark, ["A clean line", "so vile", "rotten rotten. fine"])
    got = score(odd.withColumn("score", F.lit("clash")), m).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert rows_of(score(odd.limit(0), m)) == []
    for kinds in ([0], [1], []):
        some = learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([x for x in labels if x[1] in kinds], "doc_id long, toxic int, quality int"))
        assert len(some.buckets) == 0 and all(0 <= r.score <= 1 for r in score(odd, some).collect())


def test_held_out_documents_of_the_tables(spark, sf):
    out = op11_toxicity(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.count() == docs.count()
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    assert out.where(F.col("held_out") != fold).count() == 0
    assert out.where((F.col("score") >= 0.5) != (F.col("predicted") == 1)).count() == 0
