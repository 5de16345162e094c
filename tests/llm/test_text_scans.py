"""Secrets, personal data and licences against plain versions of their contracts."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import licenses, pii, secrets

DIR = "/root/testdata/sf0.001"


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)).encode()).hexdigest()


def plain_secrets(x):
    x, out = x or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", x) if len(m[0]) >= 32]
    return out


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_pii(x):
    x, out = x or "", []
    of = lambda m: re.sub("[^0-9]", "", m)
    out += [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 12 <= len(of(m[0])) <= 19 and luhn(of(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(of(m[0])) <= 15]
    return out


def corpus(spark, pieces, n=120):
    random.seed(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    rows += [(5000 + i, "".join(random.choice(pieces) for _ in range(random.randint(1, 25)))) for i in range(n)]
    rows += [(9000, None), (9001, ""), (9002, "1 " * 3000), (9002, "1 " * 3000), (None, "token=abcdefgh1 a@b.co"), (9003, "é" * 20000 + " mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    return rows, df


def test_secrets(spark):
    rows, df = corpus(spark, ["pass", "Password", "=", ": ", '"', "secret", "token", "ToKen:", "apikey", "api_key", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "😀", " ", "\n", "x", "-", "ſecret=aaaaaaaaa"])
    got = sorted((r.doc_id or -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.digest(df).collect())
    want = []
    for i, x in rows:
        spans = plain_secrets(x)
        want.append((i or -1, *[sum(s[1] == k for s in spans) for k in range(3)], digest(spans)))
    assert got == sorted(want)
    assert secrets.digest(df.limit(0)).count() == 0


def test_random_strings_are_secrets_and_known_ones_are_not(spark):
    texts = ["key a8Fk29dLq0ZxP3vN7tYb5mWc end", "id 550e8400-e29b-41d4-a716-446655440000", "see org/apache/spark/sql/catalyst2/plans", "got " + "0a" * 20, "prose without any"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.digest(df).collect()}
    assert [got[i].n_random for i in range(5)] == [1, 0, 0, 0, 0] and got[0].spans == "random:4:28"
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    assert clean[0] == "key [random] end" and clean[4] == texts[4]


@pytest.mark.parametrize("alphabet", ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
@pytest.mark.parametrize("n", [20, 24, 32, 40])
def test_random_strings_of_any_alphabet_are_secrets(alphabet, n):
    enc, draw = secrets.encoder(secrets.public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(n)
    keys = ["".join(draw.choices(alphabet, k=n)) for _ in range(300)]
    assert sum(secrets.spans(f"key {k} end", enc, 1.9)[-1:] == [(4, 4 + n, "random")] for k in keys) >= 294


@pytest.mark.parametrize("run", ["PANDAS_COPY_ON_WRITE", "POP_JUMP_IF_NOT_NONE", "en-us/docs/Web/API/v2/get", "phi2_decoder_with_cache", "1777777777777777777777"])
def test_readable_identifiers_are_not_secrets(run):
    assert secrets.spans(run, secrets.encoder(secrets.public_tokenizers.path("byte_bpe_50k.tiktoken")), 1.9) == []


def test_pii_base(spark):
    rows, df = corpus(spark, ["a.b@c.d_e@f.gh", "@", " ", "1.2.3.4", "256.1.1.1", "0255.1.001.9", "+1 (234) 555-1234 ", "4111 1111 1111 1111", "5500-0000-0000-0004", "-", "9", "12", "x", "é", "😀", "\n", "+49.", "..", "00000000000000000000001.2.3.4.5"])
    got = sorted((r.doc_id or -1, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digest(df).collect())
    want = []
    for i, x in rows:
        spans = plain_pii(x)
        want.append((i or -1, *[sum(s[1] == k for s in spans) for k in range(4)], digest(spans)))
    assert got == sorted(want)


def test_pii_context(spark):
    seeds = [(i, f"call the office number +1 555 {2000000 + i} today") for i in range(30)]
    rows = [*seeds, (100, "call the office number 4455667 today"), (101, "the year 1234567 was long")]
    found = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i].n_phone == 1 for i in range(30)) and found[101].n_context == 0
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pii_context_finds_unknown_identifiers(spark):
    seeds = [(i, f"call the office number +1 555 {2000000 + i} today") for i in range(30)] + [(i, f"please write to mail box <name.{'abc'[i % 3]}{'x' * i}@site.org>, thanks") for i in range(50, 70)]
    planted = {100: ("call the office number ", "4455667", " today"), 101: ("call the office number ", "44 55 66", " today"), 102: ("please write to mail box <", "jo@localhost", ">, thanks")}
    rows = [*seeds, *((i, "".join(parts)) for i, parts in planted.items()), (103, "was it 4455667 or not"), (104, "the year 1234567 was long"), (105, "in 44 of 55")]
    found = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (before, secret, _) in planted.items():
        assert found[i].spans == f"context:{len(before)}:{len(before) + len(secret)}"
    assert found[103].spans == "context:7:14" and found[104].spans == found[105].spans == ""
    assert all(found[i].n_context == 0 for i, _ in seeds)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_licenses(spark):
    rows, df = corpus(spark, ["GNU ", "general ", "Public ", "license ", "apache ", "CC", "-", "BY ", "MIT ", "\n", "é", "x ", "cc by nc 4.0"])
    got = sorted((r.doc_id or -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(df).collect())
    want = []
    for i, x in rows:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        at, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for k in range(len(ws)):
                if ws[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        want.append((i or -1, len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.mark.parametrize("text, label", [("x Licensed under CC BY-NC 4.0. y", "cc-by-nc"), ("/* " + licenses.TEMPLATES[7][1].title() + ": */", "bsd"), ("a free text on the public domain", "")])
def test_license_templates(text, label):
    labels = licenses.scan(text, licenses.Index())[5]
    assert label in labels.split(",")


def test_random_runs_beside_base_spans():
    """Runs that a base span touches are no second finding; the others are found whatever stands around them."""
    rng = random.Random(8)
    enc = secrets.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    make = lambda letters, n: "".join(rng.choices(letters, k=n))
    pieces = []
    for _ in range(300):
        pieces.append(rng.choice(["word ", "password=" + make("abcDEF123", 12) + " ", make("0123456789abcdef", 32) + " ", "AKIA" + make("ABCDEFG2345", 16) + " ", "x " + make("qwxzkvjQWXZ0123789", 18) + " ", "y " + make("qwxzkvjQWXZKVJ", 24) + ",", make("qwxzkvj", 17) + " "]))
    text = "".join(pieces)
    found = secrets.spans(text, enc)
    base = [x for x in found if x[2] != "random"]
    runs = [m for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", text)]
    long_enough = lambda r: len(r) >= 20 or re.search("[a-zA-Z]", r) and re.search("[0-9]", r)
    want = [(m.start(), m.end(), "random") for m in runs if long_enough(m[0]) and not any(s < m.end() and m.start() < e for s, e, _ in base) and secrets.is_random(m[0], enc, 1.9)]
    assert [x for x in found if x[2] == "random"] == want and len(want) > 60


def test_pii_context_beyond_long_blanks(spark):
    gap, word = " " * 700, "o" * 500
    seeds = [(i, f"call{gap}the {word}{gap}number{gap}+1 555 {2000000 + i}{gap}today") for i in range(30)]
    rows = [*seeds, (100, f"call{gap}the {word} number{gap}4455667{gap}today"), (101, f"call the {'o' * 499} number 4455668 soon")]
    found = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100].n_context == 1 and found[101].n_context == 0


def test_pii_repeated_rows_get_equal_spans(spark):
    text = "call the office number +1 555 2000001 today"
    found = pii.digest(spark.createDataFrame([(1, text), (1, text), (1, "mail a@b.c"), (None, text)], "doc_id long, text string")).collect()
    assert sorted(r.n_phone for r in found) == [0, 1, 1, 1] and sorted(r.n_email for r in found) == [0, 0, 0, 1]


@pytest.mark.parametrize("t", range(len(licenses.TEMPLATES)))
def test_every_template_is_found_in_a_file(t):
    """With words before and after it, a few of its words changed, and blanks and marks anywhere."""
    label, text, keys = licenses.TEMPLATES[t]
    ws = text.split()
    fixed = {i for key in keys for i in range(len(ws)) if ws[i : i + len(key.split())] == key.split() for i in range(i, i + len(key.split()))}
    loose = [i for i in range(len(ws)) if i not in fixed]
    for i in loose[3 :: max(12, len(loose))]:
        ws[i] = "changed"
    file = "some code here " * 40 + ",\n * ".join(ws).upper() + " and more " * 30
    assert label in licenses.scan(file, licenses.Index())[5].split(",")


def test_parts_of_templates_are_no_licence():
    index = licenses.Index()
    for text in ("the software is provided to any person", "permission notice and conditions of the license", "redistribution of wealth in source and other forms with modification"):
        assert licenses.scan(text, index)[5] == ""
    ws = next(t[1] for t in licenses.TEMPLATES if t[0] == "zlib").split()
    random.Random(3).shuffle(ws)
    assert licenses.scan(" ".join(ws), index)[5] == ""


def test_personal_data_after_a_very_long_word(spark):
    """The words before a match are looked for from their beginnings, so a run of letters is not walked from each of them."""
    rows = [(2, "x" * 300_000 + " me@here.org " + "y" * 300_000)]
    got = pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert got.spans == "email:300001:300012" and got.n_email == 1
