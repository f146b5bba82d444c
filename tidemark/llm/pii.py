"""Format-preserving pseudonyms of personal data.

A value that passes its validation is permuted by a keyed Feistel network over all values of its format, so equal values
get equal pseudonyms in every document and different ones stay different. Numbers keep their separators and get valid
check digits, dates stay dates, addresses keep their shape.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import tidy

KEY_SETTING = "spark.tidemark.pii.secret"  # by this name Spark hides its value in logs and listings
BLOCK = 64
ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ACCENTED = "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])), "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: Each kind's shape; what stands before a shape keeps a scan of long runs linear.
SHAPES = re.compile(
    r"""
    (?<![\w.+%-])(?P<email>[\w.+%-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
    |(?<![A-Za-z0-9])(?P<cloud>A[KS]IA[0-9A-Z]{16})(?![A-Za-z0-9])
    |(?<![A-Za-z0-9])(?ai:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}["']?(?P<secret>[^\s"',;]{6,})
    |(?<![A-Za-z0-9])(?P<hex>[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?=[0-9]*[a-f])[0-9a-f]{65,}|(?=[0-9]*[A-F])[0-9A-F]{65,})(?![A-Za-z0-9])
    |(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?)(?![A-Za-z0-9])
    |(?<![\w./-])(?P<date>[0-9]{4}(?P<s1>[-/.])[0-9]{2}(?P=s1)[0-9]{2}|[0-9]{2}(?P<s2>[-/.])[0-9]{2}(?P=s2)[0-9]{4})(?![\w]|[./-][0-9])
    |(?<![\w.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![\w]|\.[0-9])
    |(?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])
    |(?<![\w+])(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ ]?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])
    |(?<![0-9A-Za-z])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![0-9A-Za-z])
    """,
    re.VERBOSE,
)
SOME = re.compile(r"[0-9@=:]|A[KS]IA")


_drawn: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key in the session's setting spark.tidemark.pii.secret. Without one, a random key is drawn for this application and kept in the driver's memory only: pseudonyms then agree within it, and nobody can
    undo them later."""
    if key := spark.conf.get(KEY_SETTING, None):
        return key.encode()
    return _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32).encode())


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1: an unbalanced Feistel network, walked until the result is in range."""
    if size < 2:
        return x
    a = max(2, 1 << (size.bit_length() // 2))
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + _round(left, i, key, tweak)) % b
            else:
                left = (left + _round(right, i, key, tweak)) % a
        x = left * b + right
        if x < size:
            return x


def _round(x: int, i: int, key: bytes, tweak: str) -> int:
    key = key if len(key) <= 64 else hashlib.blake2b(key).digest()
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{i}|{x}".encode(), key=key, digest_size=64).digest(), "big")


def permute_string(s: str, key: bytes, tweak: str, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER, *ACCENTED)) -> str:
    """Each character stays in its alphabet; characters of none stay, and say to which format the string belongs. Of more than BLOCK characters, blocks are permuted forwards and
    then backwards, each under a digest of the blocks done before it, so that every character hangs on all."""
    if len(s) > BLOCK:
        blocks = [s[i : i + BLOCK] for i in range(0, len(s), BLOCK)]
        for way, order in (("on", range(len(blocks))), ("back", range(len(blocks) - 1, -1, -1))):
            seen = hashlib.blake2b(f"{len(s)}|{way}".encode(), digest_size=16)
            for i in order:
                blocks[i] = permute_string(blocks[i], key, f"{tweak}|{seen.hexdigest()}", alphabets)
                seen.update(blocks[i].encode("utf-8", "surrogatepass"))
        return "".join(blocks)
    sets = [next((a for a in alphabets if c in a), None) for c in s]
    x, size = 0, 1
    for c, a in zip(s, sets):
        if a:
            x, size = x * len(a) + a.index(c), size * len(a)
    shape = "".join(c if a is None else str(alphabets.index(a)) for c, a in zip(s, sets))
    x = permute(x, size, key, f"{tweak}|{shape}")
    out = []
    for c, a in zip(reversed(s), reversed(sets)):
        if a:
            x, k = divmod(x, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


def refill(shape: str, digits: str) -> str:
    """digits in place of shape's digits."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in shape)


def luhn(digits: str) -> int:
    """The digit that makes digits + it pass the Luhn check."""
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def email(v: str, key: bytes) -> str:
    """The local part, and of the domain all but the last label, on their own: addresses of a domain stay of one domain. Case doesn't count, and stays in place."""
    local, domain = v.rsplit("@", 1)
    head, _, top = domain.rpartition(".")
    new = f"{permute_string(ascii_lower(local), key, 'local')}@{permute_string(ascii_lower(head), key, 'domain')}.{top}"
    return "".join(n.upper() if "A" <= c <= "Z" else n for c, n in zip(v, new))


def ascii_lower(v: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in v)


def secret(v: str, key: bytes) -> str:
    return hex_number(v, key) if re.fullmatch("[0-9a-f]+|[0-9A-F]+", v) else permute_string(v, key, "secret")


def cloud(v: str, key: bytes) -> str:
    return v[:4] + permute_string(v[4:], key, "cloud", (DIGITS + UPPER,))


def hex_number(v: str, key: bytes) -> str:
    return permute_string(v, key, "hex", (DIGITS + (UPPER if v.upper() == v else LOWER)[:6],))


def iban(v: str, key: bytes) -> str | None:
    plain = v.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    new = permute_string(plain[4:], key, "iban" + plain[:2])
    it = iter(plain[:2] + iban_check(plain[:2], new) + new)
    return "".join(c if c == " " else next(it) for c in v)


def date(v: str, key: bytes) -> str | None:
    """Day before month where that is a date. A day has one pseudonym in all notations."""
    sep = re.sub("[0-9]", "", v)[0]
    n = [int(x) for x in v.split(sep)]
    orders = [(0, 1, 2)] if len(v.split(sep)[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
    for y, m, d in orders:
        try:
            day = datetime.date(n[y], n[m], n[d]).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            new = datetime.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
            out = [""] * 3
            out[y], out[m], out[d] = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
            return sep.join(out)
    return None


def ip(v: str, key: bytes) -> str | None:
    parts = [int(x) for x in v.split(".")]
    if max(parts) > 255:
        return None
    return ".".join(map(str, permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip").to_bytes(4, "big")))


def ssn(v: str, key: bytes) -> str | None:
    area, group, serial = map(int, v.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = ((area - (area > 666) - 1) * 99 + group - 1) * 9999 + serial - 1
    x, s = divmod(permute(x, 898 * 99 * 9999, key, "ssn"), 9999)
    a, g = divmod(x, 99)
    a += 1
    return f"{a + (a >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


# Country calling codes of one and of two digits; all others have three.
CODES_1 = "1 7".split()
CODES_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def country_code(digits: str) -> int:
    """How many of an international number's digits are its country's."""
    return 1 if digits[:1] in CODES_1 else 2 if digits[:2] in CODES_2 else 3


def phone(v: str, key: bytes) -> str | None:
    """A country code stays, and is known with or without a separator behind it; numbers without a code are numbers of their own."""
    digits = re.sub("[^0-9]", "", v)
    if not 9 <= len(digits) <= 15:
        return None
    code = country_code(digits) if v[0] == "+" else 0
    rest = digits[code:]
    return refill(v, digits[:code] + str(permute(int(rest), 10 ** len(rest), key, f"phone{digits[:code]}|{len(rest)}")).zfill(len(rest)))


def card(v: str, key: bytes) -> str | None:
    digits = re.sub("[^0-9]", "", v)
    if luhn(digits[:-1]) != int(digits[-1]):
        return None
    n = len(digits) - 1
    new = str(permute(int(digits[:-1]), 10**n, key, f"card{n}")).zfill(n)
    return refill(v, new + str(luhn(new)))


KINDS = {"email": email, "cloud": cloud, "secret": secret, "hex": hex_number, "iban": iban, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card}


#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for c in cs.split()
}


def ends(kind: str, v: str) -> list[int]:
    """Where the value may end, in order of trial: a shape of groups can run on into what follows. An IBAN of its country's length comes first, then the longest."""
    if kind not in ("iban", "card"):
        return [len(v)]
    at = [len(v), *[i for i in range(len(v) - 1, 12, -1) if not v[i].isalnum() and v[i - 1].isalnum()]]
    if kind == "card":
        return [i for i in at if sum(c in DIGITS for c in v[:i]) >= 13]
    return sorted(at, key=lambda i: i - v.count(" ", 0, i) != IBAN_LENGTHS.get(v[:2]))


@functools.lru_cache(maxsize=65536)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """None where the value is not valid for its kind."""
    return KINDS[kind](value, key)


def settle(text: str, m: re.Match, kind: str, key: bytes) -> tuple[int, str] | None:
    """Where m's value ends, and its pseudonym. A shortened card number gives way to a longer one that starts at a later group."""
    a, v = m.start(kind), m[kind]
    digits = lambda x: sum(c in DIGITS for c in x)
    for size in ends(kind, v):
        new = pseudonym(kind, v[:size], key)
        if new is None:
            continue
        if kind == "card" and size < len(v):
            for i in range(1, len(v)):
                later = not v[i - 1].isalnum() and SHAPES.match(text, a + i)
                if later and (w := later["card"]) and any(digits(w[:e]) > digits(v[:size]) and pseudonym(kind, w[:e], key) for e in ends(kind, w)):
                    return None
        return a + size, new
    return None


def rewrite(text: str, key: bytes) -> tuple[str, int]:
    """The text with pseudonyms, and how many."""
    if not SOME.search(text):
        return text, 0
    out, at, pos, n = [], 0, 0, 0
    while m := SHAPES.search(text, pos):
        kind = next(k for k in KINDS if m[k] is not None)
        a, b = m.span(kind)
        if (done := settle(text, m, kind, key)) is None:
            pos = a + 1 if b - a < 64 else b  # another kind may start inside
            continue
        out += [text[at:a], done[1]]
        at = pos = done[0]
        n += 1
    out.append(text[at:])
    return "".join(out), n


def _rewrite(key: bytes, count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for t in batch.column("text"):
                v = t.as_py()
                new, n = (None, 0) if v is None else rewrite(v, key)
                texts.append(new)
                counts.append(n)
            k = batch.schema.get_field_index("text")
            batch = batch.set_column(k, "text", pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "n_pseudonyms"]) if count else batch

    return run


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text with pseudonyms under the secret key, n_pseudonyms.

    Kinds: email addresses, cloud keys, named secrets, hexadecimal numbers of 32 digits or more (of more than 64 if one is a letter), IBANs, dates, IPv4 addresses, social security,
    phone and card numbers. What doesn't validate (check digits, octets, calendar, lengths) stays; of IBANs and cards that run on into
    other groups, shorter ends at a group's border are tried. A null text stays null.
    Rows are independent: null and repeated doc_ids pass; extra columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(_rewrite(key, True)), f"doc_id {kind}, text string, n_pseudonyms bigint")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet"), session_key(spark))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str, key: bytes | None = None) -> DataFrame:
    """Every row with pseudonyms in its text, by key or the session's; n_chars, if there, is the new text's length. Rows are independent: null ids and
    texts pass, repeated rows get equal texts, and no rows give no rows."""
    out = docs.mapInArrow(tidy(_rewrite(key or session_key(spark), False)), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
