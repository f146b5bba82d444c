"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation weighs their votes.

DataFrame functions only. Every measure of a text is an expression over its own row, so nothing of the texts is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import cut, stage

SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
BARE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{M}\p{N}]+(?![^\x20\x09-\x0D])"
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"  # scripts that don't part words by spaces
LONG = 7.2  # mean characters of a word
BLOCK = 1000  # words among which variety is measured


@dataclass(frozen=True)
class Quality:
    """rounds of expectation-maximisation at most, from the given start; a document is kept from a posterior of least.

    good and bad are P(a vote for quality | good or bad document, the rule votes) at the start and of a weak prior that counts as `weight`
    documents for each class and rule; the votes of all documents decide the rest, and no estimate is bounded otherwise. A document of low quality fails
    some of the rules only, so bad starts above a half.
    """

    window: int = 8
    min_words: int = 20
    max_repeat_percent: int = 30
    rounds: int = 40
    prior: float = 0.9
    good: float = 0.98
    bad: float = 0.7
    weight: float = 2.0
    settled: float = 1e-6
    least: float = 0.5


def measured(docs: DataFrame, window: int = 8) -> DataFrame:
    """docs (doc_id, text, whatever else) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and for the rules
    n_lines, n_distinct (mean of distinct words in blocks of BLOCK words, the last of them ending with the text; of a shorter text, its
    distinct words), n_unspaced (characters of scripts without spaces, counted where words are long), n_bangs, n_stops (sentence ends), n_runs (runs of
    symbols), n_bare (words without a letter or digit) and n_twice (words equal to the one before). Windows and lines are compared by 64-bit hashes within their text."""
    text = F.coalesce("text", F.lit(""))
    inner = F.btrim(text, F.lit(SPACES))
    df = docs.withColumn("_w", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE)))
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "_h": F.transform("_w", lambda w: F.xxhash64(w)),
        "_l": F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x)),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
        "n_runs": F.regexp_count(text, F.lit(SYMBOL + "+")).cast("long"),
        "n_bare": F.regexp_count(text, F.lit(BARE)).cast("long"),
        "n_bangs": ((F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("")))) / 2).cast("long"),
        "n_stops": (F.length(text) - F.length(F.replace(F.replace(F.replace(text, F.lit(".")), F.lit("!")), F.lit("?")))).cast("long"),
    }).drop("_w")
    starts = F.sequence(F.lit(0), F.col("n_words").cast("int") - window)
    each = F.transform(starts, lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(window)]))
    df = df.withColumn("_g", F.when(F.col("n_words") > window, each))
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_words") / BLOCK) - 1, F.lit(0)).cast("int"))
    first = lambda i: F.greatest(F.least(i * BLOCK, F.size("_h") - BLOCK), F.lit(0)) + 1
    distinct = F.transform(blocks, lambda i: F.size(F.array_distinct(F.slice("_h", first(i), BLOCK))))
    df = df.withColumns({
        "n_distinct": F.aggregate(distinct, F.lit(0), lambda a, x: a + x) / F.size(blocks),
        "n_unspaced": F.when(F.col("word_chars") >= LONG * F.col("n_words"), F.regexp_count(text, F.lit(UNSPACED))).otherwise(F.lit(0)).cast("long"),
        "n_twice": F.when(F.col("n_words") > 1, F.aggregate(F.zip_with(F.slice("_h", F.lit(1), F.size("_h") - 1), F.slice("_h", F.lit(2), F.size("_h") - 1), lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x))
        .otherwise(0).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_s": F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ),
    }).drop("_h", "_l", "_g")
    again = F.filter("_s", lambda s, k: F.coalesce(F.get("_s", k - 1)["x"] == s["x"], F.lit(False)) | F.coalesce(F.get("_s", k + 1)["x"] == s["x"], F.lit(False)))
    at = F.array_sort(F.transform(again, lambda s: s["i"]))
    none = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("total"))
    covered = F.aggregate(
        at, none, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(window), p - a["last"])).alias("total")), lambda a: a["total"]
    )
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_s").isNotNull(), covered), F.lit(0)).cast("long")).drop("_s")


def votes() -> dict[str, Column]:
    """Each rule votes 1 (quality), -1 (none) or 0 (it abstains)."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda c: F.col(c) / n
    variety = F.col("n_distinct") / F.least(n, F.lit(BLOCK))
    length, lines = rate("word_chars"), F.greatest(F.col("n_lines"), F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    return {
        "v_symbols": vote(rate("n_symbols") <= 0.02, rate("n_symbols") > 0.1),
        "v_runs": vote(rate("n_runs") <= 0.05, rate("n_runs") > 0.2),
        "v_bare": vote(rate("n_bare") <= 0.05, rate("n_bare") > 0.2),
        "v_twice": vote(rate("n_twice") <= 0.05, rate("n_twice") > 0.3),
        "v_length": vote(length.between(3.5, 6.5), (length < 2.5) | ((length >= LONG) & (2 * F.col("n_unspaced") < F.col("word_chars")))),
        "v_repeats": vote(rate("n_repeat_words") <= 0.05, rate("n_repeat_words") > 0.25),
        "v_lines": vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") / lines > 0.4),
        "v_variety": vote(variety >= 0.4, variety < 0.3),
        "v_bangs": vote(F.col("n_bangs") == 0, rate("n_bangs") > 0.3),
        "v_stops": vote(rate("n_stops").between(0.02, 0.3), (F.col("n_stops") == 0) & (n >= 50)),
    }


def posterior(rules: list[str], model: dict[str, float]) -> Column:
    """P(quality | votes) under the model, rules independent given the class."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r in rules:
        g, b = model[f"g_{r}"], model[f"b_{r}"]
        odds = odds + F.when(F.col(r) == 1, F.lit(math.log(g / b))).when(F.col(r) == -1, F.lit(math.log((1 - g) / (1 - b)))).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(patterns: DataFrame, rules: list[str], q: Quality) -> dict[str, float]:
    """The model of largest posterior likelihood near the start: prior, and g_<rule> and b_<rule>, the shares of votes for quality among good and bad documents.

    patterns: the rules' votes and n, how often; a row for each pattern of votes that occurs, 3**rules at most whatever the corpus. Each round is one aggregation that gives one row."""
    model = {"prior": q.prior} | {f"g_{r}": q.good for r in rules} | {f"b_{r}": q.bad for r in rules}
    for _ in range(q.rounds):
        p = patterns.withColumn("_p", posterior(rules, model))
        good, bad = F.col("n") * F.col("_p"), F.col("n") * (1 - F.col("_p"))

        def share(weight: Column, r: str, start: float) -> Column:
            of = lambda rows: F.coalesce(F.sum(F.when(rows, weight)), F.lit(0.0))
            return (of(F.col(r) == 1) + q.weight * start) / (of(F.col(r) != 0) + q.weight)

        aims = [((F.coalesce(F.sum(good), F.lit(0.0)) + q.weight * q.prior) / (F.coalesce(F.sum("n"), F.lit(0)) + q.weight)).alias("prior")]
        for r in rules:
            aims += [share(good, r, q.good).alias(f"g_{r}"), share(bad, r, q.bad).alias(f"b_{r}")]
        before, model = model, {k: min(max(v, 1e-9), 1 - 1e-9) for k, v in p.agg(*aims).first().asDict().items()}  # logarithms must exist
        if max(abs(model[k] - before[k]) for k in model) < q.settled:
            break
    return model


def judge(docs: DataFrame, q: Quality = Quality()) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in windows found twice or more. Others are
    kept if the posterior probability of quality, by the rules' votes, is `least` or more. The model is fitted to the votes of
    all rows that pass the base. A null or wordless text has measures 0 and fails. Null and repeated doc_ids are rows like any other;
    extra columns are ignored; no rows give no rows.
    """
    rules = votes()
    names = list(rules)
    failed = (F.col("n_words") < q.min_words) | (100 * F.col("n_repeat_words") > q.max_repeat_percent * F.col("n_words"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    table = measured(docs.select("doc_id", "text"), q.window).select(*base, failed.alias("base_failed"), *[c.alias(k) for k, c in rules.items()])
    table = stage(table, "quality")
    patterns = cut(table.where("not base_failed").groupBy(*names).agg(F.count("*").alias("n")).coalesce(1))
    model = fit(patterns, names, q)
    probability = posterior(names, model)
    return table.select(*base, "base_failed", (~F.col("base_failed") & (probability >= q.least)).alias("kept"), probability.alias("quality"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, q: Quality = Quality()) -> DataFrame:
    """Rows of docs that the rules keep. Texts are read twice, for the votes' counts and for the verdicts: that costs CPU, but no copy of them is written or shuffled."""
    rules = votes()
    names = list(rules)
    failed = (F.col("n_words") < q.min_words) | (100 * F.col("n_repeat_words") > q.max_repeat_percent * F.col("n_words"))
    seen = measured(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "text"), q.window)
    seen = seen.select("row", failed.alias("failed"), *[c.alias(k) for k, c in rules.items()])
    cast = stage(seen.select("failed", *names), "votes")  # grouped over the measures themselves, each would be computed many times
    counts = cut(cast.groupBy("failed", *names).agg(F.count("*").alias("n")).coalesce(1))
    model = fit(counts.where("not failed").drop("failed"), names, q)
    # a partition id isn't deterministic: the filter stays above the measures, which would else be copied into each of its terms
    judged = seen.withColumn("here", F.spark_partition_id())
    return judged.where(~F.col("failed") & (posterior(names, model) >= q.least) & (F.col("here") >= 0)).select("row.*")
