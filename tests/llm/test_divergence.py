import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_documents, rows_of
from tidemark.llm._shared import Scratch
from tidemark.llm.divergence import Audit, audit, largest

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_hand(rows, a=Audit()):
    """rows (text, lang, source), over all kept terms of every two groups."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [w.translate(LOWER) for w in WORD.findall(text or "")]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= a.least]
        own = {s: counts[x, s] for x, s in groups if x == lang}
        size = {s: sum(c[t] for t in kept) for s, c in own.items()}
        p = lambda n, total: 1 + a.unit * (n + 1) // (total + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        for s in own:
            pairs = [(-sum(f(p(own[s][t], size[s]), p(own[o][t], size[o])) for t in kept), o) for o in own if o != s]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())))]
            terms = [(t, p(own[s][t], size[s]), p(whole[t], sum(whole.values()))) for t in kept if own[s][t]]
            terms = sorted((-f(x, q), t.encode()) for t, x, q in terms if x > q)
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms[: a.ranks])]
    return sorted(out, key=str)


@pytest.mark.parametrize("a", [Audit(), Audit(ranks=5, slack=2, bits=7, width=1, few=0, salts=3, held=50)])
def test_equals_brute_force(spark, a):
    rng = random.Random(3)
    words = ["the", "The", "naïve", "Ünder", "x", "日本", "a-b", "zz9zz", " ", "é", *[f"w{'abcdefgh'[i % 8]}{'klmnop'[i // 8]}" for i in range(48)]]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", "Z", None])) for _ in range(150)]
    rows += [(None, "xx", "alone"), ("", "en", "empty"), ("12 34 --", "de", "digits"), rows[0], rows[0], ("q" * 100_000, "en", "s1")]
    df = spark.createDataFrame([(*r, i, "clash", 1) for i, r in enumerate(rows)], "text string, lang string, source string, doc_id long, term string, g int").repartition(3)
    assert rows_of(audit(df, a)) == by_hand(rows, a)


def test_ties_beyond_the_slack(spark):
    """Thousands of terms of one value, many of them with a long beginning in common; one group is small, one has no ties."""
    rng = random.Random(5)
    long = "p" * 300
    terms = [long + f"{i:05d}" for i in range(500)] + [long, long + "é", "", "a", "日"] + [f"t{i}" for i in range(300)]
    rows = [(1, t, 7) for t in terms] + [(1, "big1", 9), (1, "big0", 9), (1, "small", 1)]
    rows += [(2, f"u{i}", rng.randrange(1 << 59)) for i in range(400)] + [(3, "only", 0)]
    a = Audit(ranks=310, slack=10, bits=9, width=1)
    want = []
    for g in (1, 2, 3):
        own = sorted(((-v, t.encode()) for h, t, v in rows if h == g))[: a.ranks]
        want += [(g, t.decode(), -v, i + 1) for i, (v, t) in enumerate(own)]
    df = spark.createDataFrame(rows, "g long, term string, v long").repartition(5)
    for few in (True, False):
        with Scratch(spark) as scratch:
            assert rows_of(largest(df, few, a, scratch)) == sorted(want, key=str)


def test_counts_of_any_size(spark):
    from tidemark.llm.divergence import share

    df = spark.createDataFrame([(10**17, 10**17, 5), (0, 0, 0), (0, 0, 1)], "n long, total long, terms long")
    assert [r.p for r in df.select(share("n", "total", "terms", Audit()).alias("p")).collect()] == [1 + 10**9 * (10**17 + 1) // (10**17 + 5), None, 1 + 10**9]


def test_odd_rows(spark):
    out = audit(odd_documents(spark, ["one two", "two two", "", "one"]))
    assert out.where("part = 'pair'").count() == sum(n * (n - 1) for n in Counter(r.l for r in odd_documents(spark, ["a", "b"]).select(F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s")).distinct().collect()).values())
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert rows_of(audit(empty)) == []
