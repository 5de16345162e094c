"""Encoding and decoding against the library, on whole texts, odd texts and random ids."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from shelfmark.llm import sentence_pieces
from shelfmark.llm.sentence_pieces import SPACE

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return sentence_pieces.encoder(PATH)


def ids(own, text):
    return np.frombuffer(own.encode(text), "<i4").tolist()


ODD = ["", " ", "  ", "   a", SPACE, f"a{SPACE}{SPACE} b ", "\x00", "a\x00b", "\n\n \n", "a\r\nb\t", "=" * 99, "-" * 37 + " " * 45, " " * 300, "a" * 3000, "ab" * 700, "😀\U0010ffff", "<s></s><0x0A>", "x².»,", "ﬁé"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(own, library, text):
    assert ids(own, text) == library.encode(text)
    assert own.decode(ids(own, text)) == library.decode(library.encode(text))


def test_random_texts(own, library):
    random.seed(5)
    pieces = list(own.vocabulary.ids)
    for k in range(4000):
        if k % 4 == 0:
            text = "".join(random.choices(pieces, k=random.randint(1, 8))).replace(SPACE, random.choice([" ", SPACE]))
        elif k % 4 == 1:
            text = "".join(random.choices(" -=*/#_.ab\n\t", k=random.randint(1, 60)))
        elif k % 4 == 2:
            text = "".join(random.choices("etaoinshrdlu ", k=random.randint(1, 60)))
        else:
            text = "".join(chr(random.choice([random.randint(32, 126), random.randint(160, 0x2FFF), random.randint(0x3000, 0xD7FF), random.randint(0x10000, 0x10FFFF)])) for _ in range(random.randint(1, 20)))
        assert ids(own, text) == library.encode(text), repr(text)


def test_random_ids(own, library):
    random.seed(6)
    for _ in range(4000):
        some = [random.choice([random.randint(0, 300), random.randint(0, 31999)]) for _ in range(random.randint(0, 8))]
        assert own.decode(some) == library.decode(some), some


def test_positions_are_taken_back(own):
    """Longest pieces alone would be wrong for many words, so that the walk back is in use."""
    v = own.vocabulary
    words = ["".join(random.Random(i).choices("etaoinshr", k=9)) for i in range(300)]
    longest = [[i for _, (i, _) in v.automaton.iter_long(w)] for w in words]
    assert sum(a != sentence_pieces.backtrack(w, v) for a, w in zip(longest, words)) > 100
    assert all(v.merged(w) == [v.texts[i] for i in sentence_pieces.backtrack(w, v)] for w in words)


def test_bounded_memory_changes_nothing(library):
    small = sentence_pieces.Encoder(PATH, most=1000)
    texts = [f"wort{i} word{i % 7} mot." for i in range(200)]
    assert [np.frombuffer(x, "<i4").tolist() for x in small.batch(texts)] == library.encode(texts)
    assert small.held <= 1000 + 200 * 300


def test_tables(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(None, "null id"), (7, None), (7, ""), (7, "again"), (7, "again")] + [(1000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' AS ids", "'clash' AS decoded")
    want = []
    for i, t in docs:
        found = library.encode(t or "", add_eos=True)
        want.append((i, len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(library.decode(found).encode()).hexdigest()))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in sentence_pieces.digest(df).collect()), key=key) == sorted(want, key=key)
    encoded = sentence_pieces.encode(df, end=False)
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in encoded.collect()) == sorted((i or 0, tuple(library.encode(t or ""))) for i, t in docs)
    back = sentence_pieces.decode(encoded)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, library.decode(library.encode(t or ""))) for i, t in docs)
    empty = df.filter("false")
    assert sentence_pieces.digest(empty).count() == 0 and sentence_pieces.decode(sentence_pieces.encode(empty)).count() == 0
