import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import DOCS, odd_documents
from tidemark.llm import minhash, substring
from tidemark.llm._words import shingles, text_parts
from tidemark.llm.components import connected_components

WORD = r"[^\x20\x09-\x0D]+"


def brute_components(docs):
    """(n_shingles, component) by doc_id, from all pairs."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = collections.defaultdict(list)
    for d, t in docs:
        w = re.findall(WORD, (t or "").translate(low))
        sets[d].append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(100 * len(x & y) >= 75 * len(x | y) > 0 for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sets, {d: find(d) for d in ids}


def near_copies(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = r.choices(words, k=40)
    base = r.choices(words, k=120)
    out = []
    for i in range(n):
        t = list(base) if i % 3 else r.choices(words, k=r.randint(3, 90)) + passage
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice(words) + str(i)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_all_pairs(spark, seed):
    docs = list(enumerate(near_copies(seed)))
    sets, want = brute_components(docs)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id][0]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_on_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    _, want = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id: r.component_id for r in minhash.op8_minhash(spark, sf).collect()} == want


def test_near_duplicates_odd_rows(spark):
    got = minhash.near_duplicates(odd_documents(spark, ["A b c d e f g", "a b c d e f G", "one two", "One two", "x"])).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert len(got) == 12
    assert by[0] == {(3, 0, True)} and by[1] == {(3, 0, False)} and by[3] == {(1, 2, False)} and by[4] == {(1, 4, True)}
    assert by[900] == by[901].__class__([(0, 900, True)]) and by[901] == {(0, 901, True)} and by[902] == {(0, 902, True)}
    assert {x[1:] for x in by[None]} == {(None, True)}


def test_near_duplicates_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_one_id_with_two_texts_is_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = minhash.near_duplicates(spark.createDataFrame([(5, a), (5, b), (1, a), (2, b), (3, "q")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 1), (1, 1), (2, 1), (3, 3)}


def test_signatures_estimate_similarity():
    import pyarrow as pa

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:300] + [f"z{i}" for i in range(60)])]
    (_, _, buf, offs), = text_parts(pa.array(texts))
    sets, ends = shingles(buf, offs, 5)
    a, b = (set(sets[x:y].tolist()) for x, y in zip(ends[:-1], ends[1:]))
    sig = minhash.signatures(sets, ends, 400)
    assert abs((sig[0] == sig[1]).mean() - len(a & b) / len(a | b)) < 0.08
    assert len(np.unique(sig[0])) > 100


def brute_removal(docs):
    words = [(d, re.findall(WORD, t or "")) for d, t in docs]
    least = {}
    for d, w in words:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def removal(df, **how):
    from pyspark.sql import functions as F

    return sorted(tuple(r) for r in substring.remove_repeated_windows(df, **how).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect())


def test_removal_on_tables_over_many_tasks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute_removal([tuple(r) for r in docs.collect()])
    assert removal(docs.repartition(7)) == want
    assert removal(docs.coalesce(1)) == want
    assert removal(docs.repartition(2), segment_windows=3000) == want  # several segments in each task


def test_removal_where_one_id_has_many_texts(spark):
    """Far more texts than a 16-bit key could tell apart, of several lengths, under one id."""
    first = " ".join(f"w{i}" for i in range(40))
    docs = [(1, first)] + [(7, " ".join(f"x{i}_{k}" for k in range(2 + i % 5)) + (" " + first if i % 3 == 0 else "")) for i in range(3000)]
    assert removal(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute_removal(docs)


def test_removal_odd_rows(spark):
    s = " ".join(f"w{i}" for i in range(20))
    docs = [(7, s), (7, s), (3, "x " + s + " y"), (9, s + " tail"), (-2, "ä " * 12), (4, None), (5, ""), (2**40, s), (3, "other text"), (11, "ä " * 30)]
    assert removal(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute_removal(docs)
    got = substring.remove_repeated_windows(odd_documents(spark, [s, s + " z"])).collect()
    assert len(got) == 9 and {r.n_removed for r in got if r.doc_id is None} == {0}
    assert removal(spark.createDataFrame([], DOCS)) == []


def test_packed_columns_return():
    x = np.array([5, -3, 0, 2**31 - 1], np.int32)
    a, b = substring.unpack(substring.pack(x, x[:0]))
    assert a.tolist() == x.tolist() and b.tolist() == []
    heads, runs = substring.of_intervals(substring.as_intervals(np.array([1, 4, 9, 300]), np.array([3, 2, 1, 5])))
    assert heads.tolist() == [1, 9, 300] and runs.tolist() == [5, 1, 5]


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)] + [(500, 500), (None, 4), (200, 300), (300, 200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.id: x.component for x in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def thue_morse(n, a="a", b="b"):
    return [b if bin(i).count("1") & 1 else a for i in range(n)]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_structured_words_and_sequences_differ(spark, n):
    """Long words of the Thue-Morse order and of its complement, and such sequences of two words, are told apart."""
    words = [f"w{i}" for i in range(12)]
    one, two = "".join(thue_morse(n)), "".join(thue_morse(n, "b", "a"))
    docs = [(0, " ".join([one, *words])), (1, " ".join([two, *words]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeated_windows(df).collect()} == {0: 0, 1: 0}
    short = spark.createDataFrame([(0, f"{one} x y"), (1, f"{two} x y"), (2, " ".join(thue_morse(n, "ping", "pong"))), (3, " ".join(thue_morse(n, "pang", "pung")))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(short).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_hashes_are_of_the_prime_field():
    from tidemark.llm import _words as w

    rng = random.Random(4)
    a, b = ([rng.randrange(w.PRIME) for _ in range(300)] + [0, 1, w.PRIME - 1, w.PRIME - 1] for _ in range(2))
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert w.times(x, y).tolist() == [i * j % w.PRIME for i, j in zip(a, b)]
    assert w.sums_modulo(x).tolist() == [sum(a[:i]) % w.PRIME for i in range(len(a) + 1)]
    base = w.BASES[1]
    assert w.window_hashes(x, 13).tolist() == [sum(a[i + k] * pow(base, k, w.PRIME) for k in range(13)) % w.PRIME for i in range(len(a) - 12)]


def test_one_doubled_id_changes_no_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    doubled = docs.unionByName(spark.createDataFrame([(3, "another text of the document " * 20)], "doc_id long, text string"))
    plain, more = (substring.remove_repeated_windows(d) for d in (docs, doubled))
    assert more.count() == docs.count() + 1
    assert {(r.doc_id, r.n_removed) for r in plain.collect()} <= {(r.doc_id, r.n_removed) for r in more.collect()}
    wide = lambda df: max(int(n) for n in re.findall(r"hashpartitioning\(bucket#\d+, (\d+)\)", df._jdf.queryExecution().toString()))
    assert wide(more) == wide(plain)
