"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A document is toxic if any of its sentences is, or for a reason that no sentence shows (a leak): its score is the noisy-or
1 - (1 - leak) * product(1 - sentence score). Sentence scores are logistic in the words, beginnings of words and pairs of words they hold, and the weights maximise the likelihood
of the documents' labels, so that training finds out which sentences are to blame.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import Scratch, tidy
from tidemark.llm._words import LOWER_VALUES, mix, prefix_hashes, text_parts, word_spans

#: Words are runs of ASCII letters and of bytes of other characters; sentences end at full stops, exclamation and question marks and line ends.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?\n"]] = True
UNIT = float(1 << 24)
PART_BYTES = 1 << 17  # a byte of text takes about a hundred in arrays


@dataclass(frozen=True)
class Toxicity:
    """Words, their beginnings of the lengths `prefixes` (bytes; of longer words only) and pairs of words are hashed to buckets; the `features` buckets most typical of toxic documents, that occur in `least` of them or more, get weights.

    Labels of about `labelled` documents at most, drawn by a hash, are learned from (broadcast: 16 bytes each); all their sentences are. Each of the `epochs` passes is one
    aggregation of gradients; steps are Adam's.
    """

    buckets: int = 1 << 21
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    features: int = 2048
    least: int = 3
    labelled: int = 200_000
    epochs: int = 40
    rate: float = 0.2
    l2: float = 0.05
    seed: int = 29


@dataclass
class Model:
    """Buckets, ascending, with their weights; bias of a sentence; leak (a logit) of a document. features numbers in all."""

    buckets: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -8.0
    leak: float = -7.0


def sentences(buf: np.ndarray, offs: np.ndarray, t: Toxicity) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and last byte + 1 of each sentence that has a word, and (sentence, bucket) of what it holds, once each."""
    starts, ends, first = word_spans(buf, offs, NO_LETTER)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    stops = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(STOP[buf], out=stops[1:])
    rows, at = np.repeat(np.arange(len(offs) - 1), np.diff(first)), stops[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (at[1:] != at[:-1])
    heads, of = np.flatnonzero(new), np.cumsum(new) - 1
    one, *begun = prefix_hashes(buf, starts, ends, t.prefixes, LOWER_VALUES)
    two = mix(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])[~new[1:]]
    where = np.concatenate([of, of[:-1][~new[1:]], *[of[ends - starts > k] for k in t.prefixes]])
    bucket = ((np.concatenate([one, two, *begun]) >> np.uint64(8)) % np.uint64(t.buckets)).astype(np.int64)
    return rows[heads], starts[heads], ends[np.append(heads[1:], len(starts)) - 1], where, bucket


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0)))


def _documents(t: Toxicity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many toxic and other documents of the task each bucket occurs, and, as bucket -1, how many documents there are."""
        seen, total = np.zeros((2, t.buckets), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column("toxic").to_numpy(zero_copy_only=False)
            total += np.bincount(label, minlength=2)
            for i, j, buf, offs in text_parts(batch.column("text"), PART_BYTES):
                row, _, _, of, bucket = sentences(buf, offs, t)
                kind = np.int32 if (j - i) * t.buckets < 1 << 31 else np.int64
                both = np.unique((row[of] * t.buckets + bucket).astype(kind))
                toxic = label[i:j][both // t.buckets] == 1
                for k in (0, 1):
                    found, n = np.unique(both[toxic == k] % t.buckets, return_counts=True)
                    seen[k][found] += n.astype(np.int32)
        some = np.flatnonzero(seen.any(axis=0))
        for i in range(0, len(some) + 1, 1 << 16):
            at = some[i : i + (1 << 16)]
            more = [-1] if i == 0 else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(at, more).astype(np.int64)), *[pa.array(np.append(seen[k][at], total[k : k + 1] if more else []).astype(np.int64)) for k in (1, 0)]], names=["bucket", "toxic", "other"]
            )

    return run


def choose(train: DataFrame, t: Toxicity) -> Model:
    """A model of the buckets that are most typical of toxic documents, with log odds as first weights. At most t.features rows come to the driver.

    Sentences without any of them and the leak start at chances too low to explain a label, so that words are tried first."""
    counts = train.mapInArrow(tidy(_documents(t)), "bucket bigint, toxic bigint, other bigint").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    pos, neg = (lambda r: (r.a or 0, r.b or 0))(counts.where("bucket = -1").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")).first())
    if not pos or not neg:
        return Model(np.zeros(0, np.int64), leak=7.0 if pos else -7.0)
    mean = (F.col("toxic") + F.col("other")) / float(pos + neg)
    z = (F.col("toxic") / float(pos) - F.col("other") / float(neg)) / F.sqrt(mean * (1.0 - mean + 1e-9) * (1.0 / pos + 1.0 / neg))
    odds = F.log((F.col("toxic") + 0.5) / (pos - F.col("toxic") + 0.5)) - F.log((F.col("other") + 0.5) / (neg - F.col("other") + 0.5))
    some = counts.where((F.col("bucket") >= 0) & (F.col("toxic") >= t.least)).select("bucket", z.alias("z"), odds.alias("odds")).where("z > 0")
    best = sorted(some.orderBy(F.desc("z"), "bucket").limit(t.features).collect(), key=lambda r: r.bucket)
    return Model(np.array([r.bucket for r in best], np.int64), np.array([min(4.0, max(0.0, r.odds)) for r in best]))


def _bags(t: Toxicity, m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document: toxic, number of sentences without chosen words, and of the others the numbers of their words, one after the other, with offsets."""
        slot = slots(t, m)
        for batch in batches:
            for i, j, buf, offs in text_parts(batch.column("text"), PART_BYTES):
                row, _, _, of, bucket = sentences(buf, offs, t)
                known = slot[bucket] >= 0
                both = np.unique(of[known] * len(m.buckets) + slot[bucket[known]])
                of, words = both // len(m.buckets), (both % len(m.buckets)).astype(np.int32)
                some, size = np.unique(of, return_counts=True)
                per, have = np.bincount(row, minlength=j - i), np.bincount(row[some], minlength=j - i)
                cut = np.concatenate([[0], np.cumsum(have)])
                ends = np.concatenate([[0], np.cumsum(size)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("toxic").slice(i, j - i), pa.array((per - have).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(size.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends[cut].astype(np.int32)), pa.array(words)),
                    ],
                    names=["toxic", "plain", "sizes", "words"],
                )

    return run


def _gradient(weights: np.ndarray, bias: float, leak: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The gradient of the loss of a task's documents by weights, bias and leak, and last their number, in units of 1 / UNIT, so that sums don't hang on their order."""
        grad, n = np.zeros(len(weights) + 2), 0
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) == 1
            plain = batch.column("plain").to_numpy(zero_copy_only=False).astype(float)
            sizes, words = batch.column("sizes").flatten().to_numpy(zero_copy_only=False), batch.column("words").flatten().to_numpy(zero_copy_only=False)
            per = batch.column("sizes").value_lengths().to_numpy(zero_copy_only=False)
            doc, sent = np.repeat(np.arange(len(toxic)), per), np.repeat(np.arange(len(sizes)), sizes)
            z = bias + np.bincount(sent, weights[words], minlength=len(sizes))
            clear = np.bincount(doc, softplus(z), minlength=len(toxic)) + plain * softplus(bias) + softplus(leak)  # -log of the chance of none
            # of a clean document the loss is `clear`; of a toxic one -log(1 - exp(-clear))
            pull = np.where(toxic, -1.0 / np.expm1(np.minimum(clear, 500.0)), 1.0)
            by_sentence = pull[doc] * sigmoid(z)
            grad[:-2] += np.bincount(words, by_sentence[sent], minlength=len(weights))
            grad[-2] += by_sentence.sum() + (pull * plain).sum() * sigmoid(bias)
            grad[-1] += pull.sum() * sigmoid(leak)
            n += len(toxic)
        out = np.rint(np.append(grad, n) * UNIT).astype(np.int64)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(out[some])], names=["i", "x"])

    return run


def learn(docs: DataFrame, labels: DataFrame, t: Toxicity = Toxicity()) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic 0 or 1); a doc_id with both labels counts as toxic, null ones teach nothing."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    most = max(1, known.count())
    draw = F.pmod(F.xxhash64("doc_id", F.lit(t.seed)), F.lit(1 << 40))
    few = known.where(draw < min(1.0, t.labelled / most) * (1 << 40))
    with Scratch(spark) as scratch:
        train = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "toxic")
        model = choose(train, t)
        if not len(model.buckets):
            return model
        bags = scratch.stage(train.mapInArrow(tidy(_bags(t, model)), "toxic int, plain bigint, sizes array<int>, words array<int>"), "bags")
        # small files of many tasks are read by as many tasks as run at once
        bags = bags.coalesce(max(1, spark.sparkContext.defaultParallelism, bags.rdd.getNumPartitions() // 64))
        at = np.concatenate([model.weights, [model.bias, model.leak]])
        mean, spread = np.zeros(len(at)), np.zeros(len(at))
        for k in range(1, t.epochs + 1):
            task = bags.mapInArrow(tidy(_gradient(at[:-2], float(at[-2]), float(at[-1]))), "i int, x bigint")
            sums = np.zeros(len(at) + 1)
            for r in task.groupBy("i").agg(F.sum("x").alias("x")).collect():  # a row a weight
                sums[r.i] = r.x / UNIT
            grad, n = sums[:-1], sums[-1]
            grad[:-2] += t.l2 * at[:-2]
            grad /= max(1.0, n)
            mean, spread = 0.9 * mean + 0.1 * grad, 0.99 * spread + 0.01 * grad * grad
            step = (mean / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.99**k)) + 1e-8)
            at = at - t.rate * min(1.0, 2.0 * (1 - (k - 1) / t.epochs)) * step
        return Model(model.buckets, at[:-2], float(at[-2]), float(at[-1]))


def scored(buf: np.ndarray, offs: np.ndarray, slot: np.ndarray, t: Toxicity, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte, last byte + 1 and logit of each sentence."""
    row, begins, ends, of, bucket = sentences(buf, offs, t)
    size = max(1, len(m.buckets))
    known = slot[bucket] >= 0
    both = np.unique(of[known] * size + slot[bucket[known]])
    return row, begins, ends, m.bias + np.bincount(both // size, m.weights[both % size] if len(both) else None, minlength=len(row))


def slots(t: Toxicity, m: Model) -> np.ndarray:
    """The place of each bucket among the chosen ones, else -1."""
    out = np.full(t.buckets, -1, np.int32)
    out[m.buckets] = np.arange(len(m.buckets))
    return out


def characters(buf: np.ndarray) -> np.ndarray:
    """The number of code points that begin before each byte."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def _score(t: Toxicity, m: Model, least: float | None):
    def documents(batch: pa.RecordBatch, slot: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = [n for n in batch.schema.names if n != "text"]
        for i, j, buf, offs in text_parts(batch.column("text"), PART_BYTES):
            row, begins, ends, z = scored(buf, offs, slot, t, m)
            clear = np.bincount(row, softplus(z), minlength=j - i) + softplus(m.leak)
            order = np.lexsort((begins, -z, row))
            worst = np.full(j - i, -1, np.int64)
            if len(row):
                first = np.flatnonzero(np.append(True, np.diff(row[order]) > 0))
                worst[row[order[first]]] = order[first]
            none, chars = worst < 0, characters(buf)
            at = np.maximum(worst, 0)
            pick = lambda x, kind: pa.array(x[at] if len(x) else np.zeros(j - i), kind, mask=none)
            begin, end = chars[begins] - chars[offs[row]] if len(row) else begins, chars[ends] - chars[offs[row]] if len(row) else ends
            score = pa.array(-np.expm1(-clear))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n).slice(i, j - i) for n in kept], score, pa.array((-np.expm1(-clear) >= 0.5).astype(np.int32)), pa.array(np.bincount(row, minlength=j - i).astype(np.int64)),
                    pick(begin.astype(np.int64), pa.int64()), pick((end - begin).astype(np.int64), pa.int64()), pick(sigmoid(z), pa.float64()),
                ],
                names=[*kept, "score", "predicted", "n_sentences", "worst_start", "worst_length", "worst_score"],
            )

    def offending(batch: pa.RecordBatch, slot: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, j, buf, offs in text_parts(batch.column("text"), PART_BYTES):
            row, begins, ends, z = scored(buf, offs, slot, t, m)
            number = np.arange(len(row)) - np.searchsorted(row, row)
            some = np.flatnonzero(sigmoid(z) >= least)
            chars, raw = characters(buf), buf.tobytes()
            texts = [raw[a:b] for a, b in zip(begins[some].tolist(), ends[some].tolist())]
            begin, end = chars[begins[some]] - chars[offs[row[some]]], chars[ends[some]] - chars[offs[row[some]]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i).take(pa.array(row[some])), pa.array(number[some]), pa.array(begin), pa.array(end - begin), pa.array(sigmoid(z[some])), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "sentence", "start", "length", "score", "text"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = slots(t, m)
        for batch in batches:
            yield from documents(batch, slot) if least is None else offending(batch, slot)

    return run


def score(docs: DataFrame, m: Model, t: Toxicity = Toxicity()) -> DataFrame:
    """doc_id (and held_out, if docs has it), score, predicted (1 from a score of 0.5 on), n_sentences, and the place of the worst sentence: worst_start and worst_length in
    characters, worst_score; the first of equal ones.

    A null text, or one without a word, has no sentences, the score of the leak alone and no worst sentence. Rows are judged alone: null and repeated doc_ids pass. Extra
    columns are ignored; no rows give no rows. Without labels of both kinds nothing is learned, and all scores are near 0 (near 1 if all are toxic).
    """
    keep = [c for c in ("doc_id", "held_out") if c in docs.columns]
    fields = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]
    fields += ["score double", "predicted int", "n_sentences bigint", "worst_start bigint", "worst_length bigint", "worst_score double"]
    return docs.select(*keep, "text").mapInArrow(tidy(_score(t, m, None)), ", ".join(fields))


def locate(docs: DataFrame, m: Model, t: Toxicity = Toxicity(), least: float = 0.5) -> DataFrame:
    """A row for each sentence of docs (doc_id, text) with a score of `least` or more: doc_id, sentence (its number from 0), start and length in characters, score, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(_score(t, m, least)), f"doc_id {kind}, sentence bigint, start bigint, length bigint, score double, text string")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", F.coalesce(fold == 0, F.lit(False)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold != 0)
    return score(docs, learn(docs.where("not held_out"), labels))
