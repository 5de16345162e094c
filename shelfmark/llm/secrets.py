"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A random string packs few characters into each token of a byte-pair vocabulary;
words pack many. Every run of key-like characters is encoded with a tiktoken
vocabulary, and a run with fewer than ``max_ratio`` characters a token is a
secret, with digits or without, unless it is a known digest or identifier.

Runs of at least ``least`` characters are tested, if they hold both a letter and
a digit; others of at least ``least_plain``, as shorter ones of letters alone
cannot be told from rare words.

Null and empty texts have no spans. Ids are passed through, null or repeated
ones too: one row out for each row in. Columns other than the id and the text
are not read, so their names cannot clash. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import re

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import kept, with_text

#: In the order in which spans with one start are listed; the last is the token-efficiency test's.
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")


@functools.cache
def _run(least: int) -> re.Pattern:
    return re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{least},}}")


#: Lengths of hexadecimal digests in common use (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NUMBER = re.compile(r"[0-9_+/=-]+")


def encoder(path: str) -> tiktoken.Encoding:
    return kept(_encoding, path)


def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("shelfmark", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str, enc: tiktoken.Encoding) -> bool:
    """Whether a run of characters is a digest, a UUID, a number or a readable identifier.

    An identifier is readable if words make up half of its letters and digits:
    parts of three letters or more that the vocabulary, whatever their case,
    packs into tokens of 2.5 characters or more.
    """
    if _HEXADECIMAL.fullmatch(run):
        return len(run) in DIGEST_LENGTHS
    if _UUID.fullmatch(run) or _NUMBER.fullmatch(run):
        return True
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", run)
    words = [p for p in parts if len(p) >= 3 and p.isalpha() and len(p) >= 2.5 * len(enc.encode_ordinary(f" {p.lower()}"))]
    return 2 * sum(map(len, words)) >= sum(map(len, parts))


def is_random(run: str, enc: tiktoken.Encoding, max_ratio: float) -> bool:
    """Whether a run has few characters a token and is not known."""
    return len(run) < max_ratio * len(enc.encode_ordinary(run)) and not is_known(run, enc)


def spans(text: str | None, enc: tiktoken.Encoding, max_ratio: float = 1.9, least: int = 16, least_plain: int = 20) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then kind as listed."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(x in low for x in _ASSIGN_HINTS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    base = sorted(found)
    at = furthest = 0  # base spans that start before a run ends, and where the last of them ends
    for m in _run(min(least, least_plain)).finditer(text):
        while at < len(base) and base[at][0] < m.end():
            furthest = max(furthest, base[at][1])
            at += 1
        n = len(m[0])
        long_enough = n >= least_plain or n >= least and _LETTER.search(m[0]) and _DIGIT.search(m[0])
        if m.start() >= furthest and long_enough and is_random(m[0], enc, max_ratio):
            found.append((m.start(), m.end(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def span_text(text: Column, tokenizer: str | None = None, **options) -> Column:
    """kind:start:end of every secret in a text, comma-joined; empty for none. options: those of spans."""
    path = tokenizer or "byte_bpe_50k.tiktoken"

    @F.pandas_udf("string")
    def scan(texts: pd.Series) -> pd.Series:
        enc = encoder(public_tokenizers.path(path) if "/" not in path else path)
        return pd.Series([",".join(f"{k}:{s}:{e}" for s, e, k in spans(t, enc, **options)) for t in texts], dtype=object)

    return scan(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The id and ``secrets``, an array of (kind, start, end), for each row."""
    found = docs.select(F.col(id_col), span_text(F.col(text_col), **options).alias("spans"))
    part = lambda x, i: F.split_part(x, F.lit(":"), F.lit(i))
    items = F.filter(F.split("spans", ","), lambda x: x != "")
    return found.select(id_col, "spans", F.transform(items, lambda x: F.struct(part(x, 1).alias("kind"), part(x, 2).cast("int").alias("start"), part(x, 3).cast("int").alias("end"))).alias("secrets"))


def redacted(text: str | None, enc: tiktoken.Encoding, **options) -> str | None:
    """The text with each secret replaced by ``[kind]``; overlapping spans become one."""
    found = spans(text, enc, **options)
    if not found:
        return text
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, **options) -> DataFrame:
    """docs with the secrets in the text replaced; other texts stay as they are. options: those of spans."""
    path = tokenizer or "byte_bpe_50k.tiktoken"

    def change():
        enc = encoder(public_tokenizers.path(path) if "/" not in path else path)
        return lambda texts: [redacted(t, enc, **options) for t in texts]

    return with_text(docs, text_col, change)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: counts by kind, the digest of the base spans, all spans."""
    found = find_secrets(docs)
    items = F.split("spans", ",")
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.array_join(F.filter(items, lambda x: ~x.startswith("random:")), ",")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), "spans", of("random").alias("n_random"))
