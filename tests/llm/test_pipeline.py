"""Every stage of the pipeline against a plain version of it, on what the stage before kept."""

import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shelfmark.llm import mixing, secrets, toxicity

DIR = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_toxicity(spark, docs, rows):
    model = toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    return [r for r in rows if model.score([r.text or ""])[0] < 0.7]


def plain_dedup(rows):
    sets, group = [shingles(r.text) for r in rows], list(range(len(rows)))
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, s in enumerate(sets):
        for j, same in Counter(j for g in s for j in holders[g] if j > i).items():
            if 100 * same >= 75 * (len(s) + len(sets[j]) - same):
                group[root(j)] = root(i)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    away = {r.doc_id for i, r in enumerate(rows) if r.doc_id is not None and r.doc_id != least[root(i)]}
    return [r for r in rows if r.doc_id not in away]


def plain_secrets(rows):
    enc = secrets.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = []
    for r in rows:
        text = secrets.redacted(r.text, enc)
        out.append((r.doc_id, text, r.lang, r.source, r.n_chars if text == r.text else len(text)))
    return out


def plain_mix(docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    drawn = con.sql(f"SELECT doc_id, size, shards FROM ({mixing.ORACLE})").fetchall()
    out = Counter()
    for doc, size, shards in drawn:
        n = sum(2 * int(x.split(":")[1]) >= size for x in shards.split(",") if x)
        if n:
            out[doc] += n
    return out


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.limit(20).collect()}
    near = [(9600 + i, " ".join([*t.split(" ")[:-1], "other"]), "en", "src0", len(t)) for i, t in texts.items() if len(t.split(" ")) > 60]
    odd = [(9500, "plain words and token = 'abcdefgh12345678' here", "en", "src0", 47), (9501, None, None, None, None), (9502, "", "en", "src1", 0), (None, "one two three", None, "src2", 13), (9503, "twice " * 9, "en", "src1", 54), (9503, "twice " * 9, "en", "src1", 54)]
    return docs.union(spark.createDataFrame(near + odd, docs.schema))


def test_stages_equal_plain_versions(spark, documents):
    docs, out, rows = documents, {}, {"": documents.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "dedup", "secrets", "mix", "pack"]
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stage(spark, docs, DIR).cache()
        rows[name] = docs.collect()
        if name != "pack":
            assert docs.columns == documents.columns
    same = lambda got, want: Counter(map(tuple, got)) == Counter(map(tuple, want))
    assert same(rows["toxicity"], plain_toxicity(spark, documents, rows[""])) and {9501, 9502, 9503, None} <= {r.doc_id for r in rows["toxicity"]}
    assert same(rows["dedup"], plain_dedup(rows["toxicity"])) and len(rows["dedup"]) < len(rows["toxicity"])
    assert same(rows["secrets"], plain_secrets(rows["dedup"])) and "abcdefgh12345678" not in next(r.text for r in rows["secrets"] if r.doc_id == 9500)
    assert Counter(r.doc_id for r in rows["mix"]) == plain_mix(out["secrets"])
    assert {tuple(r) for r in rows["mix"]} <= {tuple(r) for r in rows["secrets"]}
    t, tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in rows["mix"]:
        tokens[r.doc_id] += len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
    packed = Counter()
    for r in rows["pack"]:
        packed[r.doc_id] += r.length
    assert packed == tokens


def test_run_writes_and_reads_between_stages(spark):
    found = corpus_pipeline.run(spark, DIR)
    assert found.columns[:3] == ["doc_id", "start", "length"] and found.count() > 0


def test_stages_on_no_rows(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.count() == 0


def test_a_worker_keeps_one_operators_tokenizer():
    """Workers outlive stages: what one stage loads goes when the next one loads its own or asks for room."""
    import gc
    import weakref

    import public_tokenizers

    from shelfmark.llm import common, packing, secrets

    path = public_tokenizers.path("word_bpe_49k.json")
    packing_encoder = weakref.ref(packing.word_encoder(path))
    assert packing.word_encoder(path) is packing_encoder()
    secrets.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    gc.collect()
    assert packing_encoder() is None
    packing_encoder = weakref.ref(packing.word_encoder(path))
    common.release()
    gc.collect()
    assert packing_encoder() is None
