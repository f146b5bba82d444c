"""Pseudonyms against templates whose values are known, and against inverse permutations written here."""

import hashlib
import json
import random
import re
import string

import pytest

from tidemark.llm import pii

KEY = b"a key of the test"


def undo(y, size, tweak, key=KEY):
    """The inverse of the keyed permutation, round by round from the last."""
    a = max(2, 1 << (size.bit_length() // 2))
    b = -(-size // a)
    while True:
        left, right = divmod(y, b)
        for i in range(7, -1, -1):
            own = lambda x: int.from_bytes(hashlib.blake2b(f"{tweak}|{i}|{x}".encode(), key=key, digest_size=64).digest(), "big")  # noqa: B023, E731
            if i % 2:
                right = (right - own(left)) % b
            else:
                left = (left - own(right)) % a
        y = left * b + right
        if y < size:
            return y


def luhn_ok(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def card_of(r):
    d = "".join(r.choices(string.digits, k=15))
    return next(d + c for c in string.digits if luhn_ok(d + c))


def restored(kind, v):
    """The value whose pseudonym v is."""
    if kind == "card":
        d = f"{undo(int(v[:-1]), 10**15, 'card15'):015d}"
        return next(d + c for c in string.digits if luhn_ok(d + c))
    if kind == "ip":
        return ".".join(map(str, undo(int.from_bytes(bytes(map(int, v.split("."))), "big"), 1 << 32, "ip").to_bytes(4, "big")))
    if kind == "hex":
        return f"{undo(int(v, 16), 16 ** len(v), 'hex|' + '0' * len(v)):0{len(v)}x}"
    if kind == "ssn":
        a, g, s = map(int, v.split("-"))
        x, s = divmod(undo(((a - (a > 666) - 1) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "ssn"), 9999)
        a, g = divmod(x, 99)
        return f"{a + 1 + (a + 1 >= 666):03d}-{g + 1:02d}-{s + 1:04d}"
    return v


def test_known_values_in_templates_come_back():
    r, checked = random.Random(8), 0
    make = {
        "card": lambda: card_of(r),
        "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
        "hex": lambda: "".join(r.choices("0123456789abcdef", k=r.choice([32, 40, 64]))),
        "ssn": lambda: f"{r.choice([*range(1, 666), *range(667, 900)]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}",
    }
    for _ in range(200):
        parts, values = [], []
        for _ in range(r.randint(1, 6)):
            kind = r.choice(list(make))
            values.append((kind, make[kind]()))
            parts += [r.choice(["see ", "the number is ", "\n", "x = "]), "{}", r.choice([" and", ".\n", ", so", ""]), " "]
        template = "".join(parts)
        new, n = pii.rewrite(template.format(*[v for _, v in values]), KEY)
        got = re.fullmatch("([^|]*)".join(map(re.escape, template.split("{}"))), new)
        assert n == len(values) and got
        for (kind, v), w in zip(values, got.groups()):
            assert restored(kind, w) == v and w != v
            checked += 1
    assert checked > 500


@pytest.mark.parametrize("n", [6, 64, 65, 256, 257, 300, 5000, 100_000])
def test_secrets_of_any_length_go_whole(n):
    r = random.Random(n)
    v = "".join(r.choices(string.ascii_letters + string.digits, k=n))
    for name in ("password", "PassWord", "API_KEY", "apikey", "ToKeN"):
        new, count = pii.rewrite(f"{name} = {v} end", KEY)
        w = new.removeprefix(f"{name} = ").removesuffix(" end")
        assert count == 1 and len(w) == n
        assert n < 60 or max(len(x) for x in re.findall("1+", "".join("1" if a == b else "0" for a, b in zip(v, w))) or [""]) < 8
    assert pii.rewrite(f"token: {v}", KEY)[0][7:] == w


@pytest.mark.parametrize("n", [32, 64, 65, 128, 1000])
def test_long_hexadecimal_numbers_go_whole(n):
    v = "".join(random.Random(n).choices("0123456789abcdef", k=n))
    new, count = pii.rewrite(f"sum {v}.", KEY)
    assert count == 1 and re.fullmatch(f"sum [0-9a-f]{{{n}}}\\.", new) and new != f"sum {v}."
    other = pii.rewrite(f"sum {v[:-1]}{'0' if v[-1] != '0' else '1'}.", KEY)[0]
    assert n <= 64 or sum(a == b for a, b in zip(new, other)) < 0.2 * n + 12  # each block hangs on all others


def test_the_whole_key_counts():
    long = b"k" * 64
    assert pii.rewrite("10.1.2.3", long + b"1") != pii.rewrite("10.1.2.3", long + b"2") != pii.rewrite("10.1.2.3", long)


def test_the_key_is_nowhere_to_be_read(spark):
    key = pii.session_key(spark).decode()
    assert key not in json.dumps(dict(spark.sparkContext.getConf().getAll())) and key not in str([tuple(r) for r in spark.sql("SET").collect()])
    spark.conf.set(pii.KEY_SETTING, "known-to-the-test")
    try:
        assert pii.session_key(spark) == b"known-to-the-test"
        assert "known-to-the-test" not in str([tuple(r) for r in spark.sql("SET").collect()])
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert pii.session_key(spark).decode() == key
