"""Mixing, packing, language model, toxicity and the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import language_model, mixing, packing, queries, toxicity
from shelfmark.llm.attention import Attention
from shelfmark.llm.boosting import Isotonic

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def odd(spark, documents):
    more = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "src0", 0), (None, "a b c", "en", None, 5), (9002, "x " * 5000, "en", "src0", 1), (9002, "x " * 5000, "en", "src0", 1)], documents.schema)
    return documents.union(more)


def test_mixing_equals_sql(spark, documents):
    con = duckdb.connect()
    docs = odd(spark, documents)
    con.register("documents", docs.toArrow())
    fix = lambda rows: sorted(tuple(-1.0 if v is None or v != v else round(float(v), 6) for v in r) for r in rows)
    names = ["doc_id", "size", "source_size", "target", "taken"]
    tree = sorted((str(r.doc_id), r.shards) for r in mixing.digest(docs).collect())
    assert tree == sorted(map(lambda r: (str(r[0]), r[1]), con.sql(f"SELECT doc_id, shards FROM ({queries.ORACLES['op4_mixing']})").fetchall()))
    got = [tuple(r[c] for c in names) for r in mixing.digest(docs).collect()]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLES['op4_mixing']})").fetchall()
    assert sorted(map(str, fix(got))) == sorted(map(str, fix(want)))
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r[2], r[3]][0] += r[4]
        assert r[4] <= 2 * r[1]
    assert all(abs(taken - target) <= 1 for (_, target), (taken, _) in by.items())
    assert mixing.digest(docs.limit(0)).count() == 0


def test_shards_draw_whole_mix(spark, documents):
    plan = mixing.mix_plan(documents).collect()
    assert all(sum(d["words"] for d in r.draws) == r.taken for r in plan)
    assert len({d["shard"] for r in plan for d in r.draws}) == 16
    for depth in (1, 6):  # however the tree splits the quotas, its shards' counts are the quotas
        other = mixing.mix_plan(documents, depth=depth).collect()
        assert sorted((r.doc_id, r.taken) for r in other) == sorted((r.doc_id, r.taken) for r in plan)
        assert all(0 <= d["shard"] < 1 << depth for r in other for d in r.draws)
    assert [mixing.tree_depth(n) for n in (0, 1 << 18, (1 << 18) + 1, 1 << 40)] == [4, 4, 5, 16]


def test_mixed_documents_meet_their_targets(spark, documents):
    sized = documents.withColumn("words", mixing.word_count(F.col("text")))
    of = {r.source: r for r in sized.groupBy("source").agg(F.sum("words").alias("all"), F.max("words").alias("most")).collect()}
    targets = {r.source: r.target for r in mixing.mix_plan(documents, keep=("source",)).select(F.col("kept_source").alias("source"), "target").distinct().collect()}
    mixed = mixing.mix_documents(documents)
    got = {r.source: r.taken for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("taken")).collect()}
    assert all(abs(got.get(s, 0) - t) <= of[s].most / 2 + 1 for s, t in targets.items())
    assert mixed.rdd.getNumPartitions() == 16


def test_taken_is_what_the_shards_draw(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "split_quotas", lambda units, depth, seed: units.withColumn("shard", F.lit(0)).limit(0))
    assert {r.taken for r in mixing.digest(documents).collect()} == {0}


def test_frequent_subwords_keep_classes_of_their_own():
    counts = np.arange(language_model.IDS, 0, -1) ** 2
    group = language_model.classes(counts, 128, 64)
    assert group.max() + 1 == 192 and len(set(group[:128])) == 128 and not set(group[:128]) & set(group[128:])
    follow = np.random.default_rng(1).poisson(3, (language_model.IDS, 129))
    group = language_model.classes(counts, 128, 64, follow)
    assert len(set(group[:128])) == 128 and 128 <= group[128:].min() and group.max() < 192


def test_pairs_count_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = ["alpha Beta gamma " * 900, "one", "", None, "x" * 20_000]
    df = spark.createDataFrame([(i, i, False, t) for i, t in enumerate(texts)], "row long, doc_id long, held_out boolean, text string")
    texts += ["A\u00a0B\u2028c \x1cd", "alpha\r\n\tbeta"]
    df = spark.createDataFrame([(i, i, False, t) for i, t in enumerate(texts)], df.schema)
    rows = language_model.encode_texts(df, path, {b"beta": 1.0}).filter("ids is not null")
    enc, want = language_model.subwords(path), Counter()
    for t in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        ids = [i for w in re.split(r"[\x20\x09-\x0D]+", low) if w for i in enc.encode_ordinary(" " + w)] + [language_model.END]
        want.update(zip([language_model.END, *ids], ids))
    assert {(r.before, r.id): r.c for r in language_model.pair_counts(rows, flush=100).collect()} == want


def test_padded_windows_hold_whole_texts():
    texts = [np.arange(1, 151), np.array([7])]
    before, after, real = language_model.padded(texts, 64)
    assert after[real].tolist() == [*range(1, 151), 7]
    assert before[real].tolist() == [language_model.END, *range(1, 150), language_model.END]


def test_shares_in_classes_add_up(spark):
    rng = np.random.default_rng(4)
    pairs = spark.createDataFrame(pd.DataFrame({"before": rng.integers(0, 90, 4000), "id": rng.integers(0, 90, 4000), "c": rng.integers(1, 50, 4000)}), "before int, id int, c long").groupBy("before", "id").agg(F.sum("c").alias("c"))
    m = language_model.learn_counts(pairs.cache(), window=64, own=8, shared=6, rows=16, slots=1 << 12)
    ids = np.arange(language_model.IDS)
    for before in (3, 77, 50_000):
        share = np.exp(m.in_class(np.full(len(ids), before), ids).astype(float))
        assert np.allclose(np.bincount(m.group, share, 14), 1, atol=1e-3)
        assert abs(np.exp(m.attention.base[m.row[before]]).sum() - 1) < 1e-3


def test_model_beats_subword_unigram_and_counts(spark, monkeypatch):
    """On held-out texts, whole; the unigram of the same subwords is what the model would be without any context, the counts what it would be without attention."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_model.score_documents(docs).filter("held_out").toPandas()
    enc, counts = language_model.subwords(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), np.zeros(language_model.IDS)
    rows = [(r.held, language_model.encoded((r.text or "").encode(), enc)) for r in docs.select("text", language_model.held_out(F.col("doc_id")).alias("held")).collect()]
    for out, ids in rows:
        counts += 0 if out else np.bincount(ids, minlength=language_model.IDS)
    unigram = np.log10((counts + 1) / (counts.sum() + language_model.IDS))
    plain = sum(unigram[ids].sum() for out, ids in rows if out)
    assert held["score"].sum() > 0.75 * plain  # log10, so less is worse: a quarter of the loss must go

    def silent(texts, model, rounds):
        model.attention.weights["out"][:] = 0
        return model

    monkeypatch.setattr(language_model, "train", silent)
    by_counts = language_model.score_documents(docs).filter("held_out").toPandas()
    assert held["score"].sum() > 0.985 * by_counts["score"].sum()
    both = held.merge(by_counts, on="doc_id")
    assert (both["score_x"] > both["score_y"]).mean() > 0.8


def test_every_training_text_is_learned_from_once(spark, monkeypatch):
    """Over tasks and rounds; a subword that no task met keeps a vector of zeros."""
    rng = np.random.default_rng(8)
    texts = [(i, rng.integers(0, 60, rng.integers(1, 200)).astype("<u2").tobytes()) for i in range(300)]
    df = spark.createDataFrame(texts, "row long, ids binary").repartition(6)
    group = np.minimum(np.arange(language_model.IDS), 8)
    m = language_model.Model(group, group, np.log(np.full((9, 9), 1 / 9)), np.zeros(language_model.IDS, np.float32), np.zeros((9, 9), np.float32), np.full(64, 0xFFFFFFFF, np.uint32), np.zeros(64, np.float32), 64)
    seen = []

    class Counted(language_model.Learned):
        def __init__(self, *args):
            super().__init__(*args)
            seen.append(self)

    monkeypatch.setattr(language_model, "Learned", Counted)
    language_model.train(df, m, 3, task_tokens=1000)
    before = [np.concatenate([[language_model.END], np.frombuffer(raw, "<u2")[:-1]]) for _, raw in texts]
    assert (sum(x.uses for x in seen) == np.bincount(np.concatenate(before), minlength=language_model.IDS)).all()
    assert sum(x.windows[0] for x in seen) == sum(-(-len(b) // 64) for b in before)
    assert np.abs(m.attention.own[:60]).max(axis=1).all() and not m.attention.own[60 : language_model.END].any()


def test_packing_round_trip(spark, documents):
    docs = odd(spark, documents)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in docs.collect()}
    rows = packing.pack_documents(docs, group_tokens=1 << 16).collect()
    seq, per = defaultdict(list), defaultdict(int)
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seq[r.sequence_id].append((r.offset, r.length))
        per[r.doc_id] += r.length
    assert all(per[i] == len(x) * (2 if i == 9002 else 1) for i, x in ids.items())
    for pieces in seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(per.values()) >= 0.9 * 2048 * len(seq)


def test_encoder_on_odd_texts():
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello, World. it's can't. A.B.c ... x.. y,. É. é. ß, naïve.  ́ a b\x1cc <|endoftext|> İ 123. 4,5 `~ \r\n\t", "a.\nb,", "日本語. 中文, ÷. a÷. b", "don't. 'S ﬁ. ǅ K"]
    for text, raw in zip(texts, enc.batch(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_with_few_words_kept():
    """Words that move between the halves of the cache, and marks, digits and special tokens in any order, are encoded as the tokenizer does."""
    import random

    draw = random.Random(3)
    bits = [*"abzß÷×éÉ'<>|.,!? \n\t\u0338\u030109-_&*#", "<|endoftext|>", "'s", "'re", "</w>", " ", "a.", "don't", "|> ", "word, ", "word**"]
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 30))) for _ in range(6000)]
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), most=1 << 18)
    for first in range(0, len(texts), 300):
        part = texts[first : first + 300]
        told = enc.tokenizer.encode_batch(part, add_special_tokens=False)
        assert enc.batch(part) == [np.array(x.ids, dtype="<u4").tobytes() for x in told]
    assert len(enc.known) + len(enc.older) < 2000


def test_plain_words_are_encoded_without_rules():
    """Words of letters, digits and marks get the tokenizer's ids from its merges alone."""
    from types import SimpleNamespace

    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    text = "hello naïve straße ÿä achßung a1b2-- 4047054433953522 ägeö;x Hello"
    told = enc.tokenizer.encode(text, add_special_tokens=False).ids
    enc.tokenizer = SimpleNamespace(encode_batch_fast=lambda texts, **_: [] if not texts else 1 / 0)
    assert np.frombuffer(enc.batch([text])[0], "<u4").tolist() == told


def test_attention_gradients():
    rng = np.random.default_rng(0)
    m = Attention(np.log(rng.dirichlet(np.ones(7), 7)), np.array([0, 1, 2, 3, 4, 5, 6, 6, 5]), width=4, window=6)
    m.weights = {k: w.astype(np.float64) * 3 for k, w in m.weights.items()}
    m.own = rng.standard_normal((9, 4))
    x, y, rows = (rng.integers(0, n, (3, 6)) for n in (9, 7, 7))
    real = np.ones((3, 6), bool)
    _, grads, some, own = m.gradients(x, rows, y, real)
    grads["own"] = np.zeros_like(m.own)
    grads["own"][some] = own
    for name, w in [*m.weights.items(), ("own", m.own)]:
        i = (m.group[x[0, 0]], 0) if name == "embed" else (x[0, 0], 0) if name == "own" else (0,) * w.ndim
        w[i] += 1e-4
        up = m.gradients(x, rows, y, real)[0]
        w[i] -= 2e-4
        down = m.gradients(x, rows, y, real)[0]
        w[i] += 1e-4
        assert abs((up - down) / 2e-4 - grads[name][i]) < 1e-5


def test_windows_score_each_token_once():
    rng = np.random.default_rng(2)
    group, row = rng.integers(0, 9, language_model.IDS), rng.integers(0, 20, language_model.IDS)
    share, off = rng.standard_normal(language_model.IDS).astype(np.float32), rng.standard_normal((20, 9)).astype(np.float32)
    m = language_model.Model(group, row, np.log(rng.dirichlet(np.ones(9), 20)), share, off, np.full(64, 0xFFFFFFFF, np.uint32), np.zeros(64, np.float32), 64)
    end = language_model.END
    ids = np.append(rng.integers(0, end, 150), end)
    got = language_model.score_texts([ids, np.array([end])], m, 16)
    line = np.concatenate([[end], ids])
    want = 0.0
    for i in range(1, len(line)):
        begin = (i - 1) // 48 * 48 - 16
        place = i - 1 - begin
        inputs, real = np.zeros((1, 64), np.int64), np.zeros((1, 64), bool)
        start = max(0, begin)
        inputs[0, start - begin : place + 1] = line[start:i]
        real[0, start - begin : place + 1] = True
        want += m.attention.log_probs(inputs, np.full((1, 64 - place), row[line[i - 1]]), real, np.full((1, 64 - place), group[line[i]]), place)[0, 0]
        want += share[line[i]] + off[row[line[i - 1]], group[line[i]]]
    assert abs(got[0] - want / math.log(10)) < 1e-2 and np.isfinite(got[1])


def test_language_model_base(spark, documents):
    docs = odd(spark, documents).filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in language_model.score_documents(docs, common=500).collect()}
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [""]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        ws = words(t)
        assert abs(got[i].base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert got[i].score < 0
    assert language_model.score_documents(docs.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.score_documents(odd(spark, docs), labels).collect()}
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(g.held_out for g, _ in held) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.7) for g in got.values())
    caught = sum(g.predicted for g, t in held if t == 1)
    assert caught >= 0.6 * sum(t == 1 for _, t in held) and sum(g.predicted for g, t in held if t == 0) <= 0.02 * len(held)
    assert toxicity.score_documents(docs.limit(3), labels.limit(0)).count() == 3


def test_isotonic():
    f = Isotonic().fit(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    y = f(np.linspace(0, 5, 20))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1


def test_repeated_rows_spread_over_groups(spark):
    """A hundred thousand copies of one row, and rows without an id, are dealt like any others."""
    copies = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("alpha beta gamma").alias("text"))
    nameless = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rows = packing.pack_documents(copies.union(nameless), group_tokens=1 << 13)
    groups = rows.groupBy((F.col("sequence_id") / (1 << 32)).cast("long").alias("g")).agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).toPandas()
    assert groups["n"].sum() >= 120_000 and len(groups) > 40 and groups["n"].max() <= 1.5 * groups["n"].mean()
    tokens = len(packing.word_encoder(public_tokenizers.path("word_bpe_49k.json")).batch(["alpha beta gamma"])[0]) // 4 + 1
    assert groups["tokens"].sum() == 100_000 * tokens + 20_000
    few = packing.pack_documents(nameless, group_pieces=1 << 10).select("length", F.shiftright("sequence_id", 32).alias("g"))
    groups = few.groupBy("g").count().toPandas()  # pieces of one token: far fewer than a group's tokens
    assert len(groups) == 20 and groups["count"].sum() == 20_000 and groups["count"].max() < 1.5 * (1 << 10)


def test_odd_input_of_models(spark, documents):
    """Columns with clashing names, a very long text, null ids, repeated rows and no rows at all."""
    clash = ["row", "ids", "word", "c", "base", "score", "n_tokens", "src", "hash", "block", "size", "part", "g", "start", "length", "y", "id"]
    docs = odd(spark, documents.limit(40)).union(spark.createDataFrame([(9003, "word " * 60_000 + "z" * 50_000, "en", "src1", 1)], documents.schema)).withColumns({c: F.lit("x") for c in clash})
    labels = spark.read.parquet(f"{DIR}/labels.parquet").withColumns({c: F.lit("x") for c in ("text", "score", "y")})
    n = docs.count()
    scored = language_model.score_documents(docs).collect()
    assert len(scored) == n and all(np.isfinite(r.score) and r.score < 0 for r in scored)
    by = Counter((r.doc_id, r.n_tokens) for r in scored)
    assert by[9002, 5001] == 2 and by[9003, 60_002] == 1 and by[None, 4] == 1
    assert mixing.digest(docs).count() == n and toxicity.score_documents(docs, labels).count() == n
    assert {r.doc_id for r in packing.pack_documents(docs).collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    none, unlabelled = docs.limit(0), labels.limit(0)
    for found in (packing.pack_documents(none), toxicity.score_documents(none, labels), toxicity.score_documents(none, unlabelled), mixing.mix_documents(none), language_model.score_documents(none)):
        assert found.count() == 0


def test_packing_sends_small_batches_and_restores_the_setting(spark, documents, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    real = packing.cut
    monkeypatch.setattr(packing, "cut", lambda df, tag: seen.append(spark.conf.get(key)) or real(df, tag))
    packing.pack_documents(documents.limit(5))
    assert seen == ["1024"] and spark.conf.get(key) == before
