"""Language-model scores: a causal self-attention model on subword ids, and word counts.

Texts are lower-cased (A-Z) and their words, each with one blank before it,
encoded once with a byte-level vocabulary; a text ends with the end id, which
also stands before its first token.

Learning, from all documents that are not held out: the counts of words, and the
counts of pairs of subwords that follow each other. Subwords fall into classes:
the most frequent have one of their own, the others are grouped by what follows
them. A token's probability is its class's times its share of its class after
the subword before it. The class's logits are its log share after that subword
(or after its class, where the subword is rare) plus what one head of causal
self-attention over the window's subword ids adds. The head learns from every
window of every training document, once: documents are dealt to rounds, in each
round a task goes through its own in buffers of a bounded number of tokens, and
the tasks' weights are averaged before the next, a subword's vector by how often
each task met it; so counts and training both grow with the corpus.

A text is scored in windows that overlap by ``overlap`` tokens; each token
counts once, in the window where it has at least that many before it (or the
whole text so far).

The base score is an add-one unigram score of words. Words beyond the
``common`` most frequent ones are looked up by a join.

Null and empty texts are the end token alone. Rows with a null id are scored
and learned from. Repeated rows count and are scored each on their own. Without
any training text all counts are 0 and the model is near uniform. Only the id
and the text are read. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.attention import Adam, Attention
from shelfmark.llm.common import cut, frequent, give_back, stretches

#: Ids of the vocabulary, and the one that ends a text.
IDS, END = 50_257, 50_256
END_ID = np.array([END], "<u2").tobytes()


@functools.cache
def subwords(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: The id of a line break, which stands in no word.
BREAK = 198


def word_ids(words: list[bytes], enc: tiktoken.Encoding) -> list[bytes]:
    """The ids (16 bits each) of every word with a blank before it, many words in one call."""
    if not words:
        return []
    texts = [" " + w.decode("utf-8", "replace") for w in words]
    ids = enc.encode_to_numpy("\n".join(texts), disallowed_special=()).astype("<u2")
    ends = np.flatnonzero(ids == BREAK)
    if len(ends) + 1 != len(words):  # a word with a blank of its own beyond ASCII
        return [enc.encode_to_numpy(t, disallowed_special=()).astype("<u2").tobytes() for t in texts]
    raw = ids.tobytes()
    return [raw[2 * a : 2 * b] for a, b in zip([0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)])]


def encoded(text: bytes, enc: tiktoken.Encoding) -> np.ndarray:
    """The ids of a text in UTF-8, and the end id."""
    return np.frombuffer(b"".join(word_ids(words_of(text), enc)) + END_ID, "<u2")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased; bytes are split at exactly the six blanks of ASCII."""
    return text.lower().split()


def word_counts(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """(word, c) over the texts, words in UTF-8; the end of a text counts as the empty word."""

    def batch_of(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for _, texts in stretches(batch.column("text")):
                for text in texts:
                    seen.update(words_of(text))
                seen[b""] += len(texts)
                if len(seen) > flush:
                    yield batch_of(seen)
                    seen.clear()
        if seen:
            yield batch_of(seen)

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, ids binary, word binary"


#: Stands for the end of a text among its words; no text in UTF-8 holds this byte.
STOP = b"\xff"


class Lookup:
    """Of known words the base score and the ids, by numbers."""

    def __init__(self, known: dict[bytes, float], tokenizer: str):
        words = [w for w in known if w]
        ids = [*word_ids(words, subwords(tokenizer)), END_ID]
        self.number = {w: i for i, w in enumerate([*words, STOP])}
        self.logs = np.array([*(known[w] for w in words), known.get(b"", 0.0)])
        self.end_known = b"" in known
        self.sizes = np.array([len(x) // 2 for x in ids])
        self.ids = np.frombuffer(b"".join(ids), "<u2")

    def read(self, texts: list[bytes], enc: tiktoken.Encoding) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], list[bytes], np.ndarray]:
        """For texts in UTF-8: tokens, known tokens and base score of each, its ids, and all other words with the places of their texts."""
        words = (b" \xff ".join(texts) + b" \xff").lower().split()
        number = np.fromiter(map(self.number.get, words, itertools.repeat(-1)), np.int64, len(words))
        stop = len(self.logs) - 1
        ends = np.flatnonzero(number == stop)
        first = np.concatenate([[0], ends[:-1] + 1])
        at = np.flatnonzero(number < 0)
        other = [words[i] for i in at]
        fresh = {w: i for i, w in enumerate(dict.fromkeys(other), len(self.logs))}
        raw = word_ids(list(fresh), enc)
        number[at] = [fresh[w] for w in other]
        sizes = np.concatenate([self.sizes, np.array([len(x) // 2 for x in raw], np.int64)])
        flat = np.concatenate([self.ids, np.frombuffer(b"".join(raw), "<u2")])
        logs = np.concatenate([self.logs, np.zeros(len(raw))])
        lengths = sizes[number]
        done = np.cumsum(lengths)
        start = (np.cumsum(sizes) - sizes)[number] - (done - lengths)
        ids = flat[np.repeat(start, lengths) + np.arange(done[-1])]
        known = number < stop + self.end_known
        text_of = np.searchsorted(ends, at)
        if not self.end_known:
            other, text_of = other + [b""] * len(texts), np.concatenate([text_of, np.arange(len(texts))])
        stops = [0, *(2 * done[ends]).tolist()]
        line = ids.tobytes()
        return ends - first + 1, np.add.reduceat(known.astype(np.int64), first), np.add.reduceat(logs[number], first), [line[a:b] for a, b in zip(stops, stops[1:])], other, text_of


def encode_texts(rows: DataFrame, tokenizer: str, known: dict[bytes, float]) -> DataFrame:
    """Two kinds of rows: each text's ids with the base score of its known words, and its other words, each as often as it occurs."""
    shared = rows.sparkSession.sparkContext.broadcast(Lookup(known, tokenizer))
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in ENCODED.split(", ")]

    def batch_of(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) if n in columns else pa.nulls(rows, kinds[k]) for n, k in fields], [n for n, _ in fields])

    def encode(batches):
        lookup, enc = shared.value, subwords(tokenizer)
        for batch in batches:
            row, doc, out_of = (batch.column(c) for c in ("row", "doc_id", "held_out"))
            for first, texts in stretches(batch.column("text")):
                n = len(texts)
                n_tokens, n_known, base, ids, other, at = lookup.read(texts, enc)
                yield batch_of(n, row=row.slice(first, n), doc_id=doc.slice(first, n), held_out=out_of.slice(first, n), n_tokens=n_tokens, known=n_known, base=base, ids=ids)
                if other:
                    yield batch_of(len(other), row=row.slice(first, n).to_numpy()[at], word=other)

    return rows.mapInArrow(encode, ENCODED)


def pair_counts(texts: DataFrame, flush: int = 1 << 22) -> DataFrame:
    """(before, id, c): how often each id follows each other in (ids); the end id stands before a text."""

    def batch_of(held):
        pairs, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array((pairs >> 16).astype(np.int32)), pa.array((pairs & 0xFFFF).astype(np.int32)), pa.array(c.astype(np.int64))], ["before", "id", "c"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for _, some in stretches(batch.column("ids")):
                ids = np.frombuffer(b"".join(some), "<u2").astype(np.uint32)
                # a text ends with the end id, so in a row of texts every token has the one before it in front
                held.append(np.concatenate([[np.uint32(END)], ids[:-1]]).astype(np.uint32) << np.uint32(16) | ids)
                size += len(ids)
                if size >= flush:
                    yield batch_of(held)
                    held, size = [], 0
        if size:
            yield batch_of(held)

    return texts.select("ids").mapInArrow(count, "before int, id int, c long").groupBy("before", "id").agg(F.sum("c").alias("c"))


def one_count(pairs: DataFrame, name: str) -> np.ndarray:
    """How often each id occurs in the column, from the pairs' counts."""
    found = pairs.groupBy(name).agg(F.sum("c").alias("c")).toPandas()  # at most one row an id
    out = np.zeros(IDS, np.int64)
    out[found[name]] = found["c"]
    return out


def table_counts(pairs: DataFrame, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How often a subword of each column follows one of each row, given the row and the column of every id."""
    shape = int(rows.max()) + 1, int(columns.max()) + 1

    def count(batches):
        total = np.zeros(shape[0] * shape[1], np.int64)
        for batch in batches:
            before, after, c = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("before", "id", "c"))
            total += np.bincount(rows[before] * shape[1] + columns[after], c, len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "c"])

    found = pairs.mapInArrow(count, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toPandas()  # at most one row a cell
    out = np.zeros(shape[0] * shape[1])
    out[found["cell"]] = found["c"]
    return out.reshape(shape)


def clustered(follow: np.ndarray, weight: np.ndarray, groups: int, rounds: int = 12) -> np.ndarray:
    """A group for each row of a table of counts: k-means over what follows, by the leading directions of the square roots of shares."""
    share = np.sqrt((follow + 0.05) / (follow + 0.05).sum(axis=1, keepdims=True))
    share -= np.average(share, axis=0, weights=weight)
    _, directions = np.linalg.eigh((share * weight[:, None]).T @ share)
    points = share @ directions[:, -8:]
    centres = points[np.argsort(-weight, kind="stable")[:groups]]
    for _ in range(rounds):
        group = np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)
        total = np.bincount(group, weight, len(centres))
        sums = np.stack([np.bincount(group, weight * x, len(centres)) for x in points.T], axis=1)
        centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-9)[:, None], centres)
    return group


def classes(counts: np.ndarray, own: int, shared: int, follow=None) -> np.ndarray:
    """Class of each id: the most frequent have their own. follow gives, for groups of ids, what follows each group."""
    order = np.argsort(-counts, kind="stable")
    group = np.empty(len(counts), np.int64)
    group[order[:own]] = np.arange(own)
    rest = order[own:]
    mass = np.cumsum(counts[rest] + 1.0)
    group[rest] = own + np.minimum(shared - 1, (mass / mass[-1] * shared).astype(np.int64))
    if follow is not None:
        some = rest[counts[rest] > 0]
        if len(some) > 4 * shared:
            group[rest] = own + shared - 1  # never seen: the last one
            group[some] = own + clustered(follow[some], counts[some].astype(float), shared - 1)
    return group


class Model:
    """All that scoring needs, of a size that depends on the vocabulary and on parameters alone."""

    def __init__(self, group: np.ndarray, row: np.ndarray, base: np.ndarray, share: np.ndarray, off: np.ndarray, slots: np.ndarray, values: np.ndarray, window: int):
        self.group, self.row = group.astype(np.int32), row.astype(np.int32)
        self.share, self.off, self.slots, self.values = share, off, slots, values
        self.attention = Attention(base, self.group, window=window)

    def in_class(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log share of ids in their classes after the ids before them."""
        key = before.astype(np.uint32)
        key <<= np.uint32(16)
        key |= ids.astype(np.uint32)
        at = slot_of(key, len(self.slots))
        out = self.share[ids]
        cell = self.row[before]
        cell *= np.int32(self.off.shape[1])
        cell += self.group[ids]
        out += self.off.ravel()[cell]
        hit = np.flatnonzero(self.slots[at] == key)
        out[hit] = self.values[at[hit]]
        return out


def slot_of(key: np.ndarray, slots: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - slots.bit_length() + 1)


def learn_counts(pairs: DataFrame, window: int, own: int, shared: int, rows: int, slots: int) -> Model:
    """The model before its attention is trained, from a written table of pair counts.

    Of the subwords before, the ``rows`` most frequent have a row of their own
    in the table of classes, the others share their class's. Of the pairs after
    such a subword, one for each of ``slots`` hash slots is kept, the most frequent.
    """
    counts = one_count(pairs, "id")
    before = one_count(pairs, "before")
    first = classes(counts, own, shared)
    group = classes(counts, own, shared, table_counts(pairs, np.arange(IDS), np.minimum(first, own)) if counts.any() else None)
    n = own + shared
    total = np.bincount(group, counts + 1.0, n)
    share = np.log((counts + 1.0) / total[group]).astype(np.float32)
    row = rows + group
    top = np.argsort(-before, kind="stable")[:rows]
    top = top[before[top] > 0]
    row[top] = np.arange(len(top))
    seen = table_counts(pairs, row, np.append(group[:-1], group[-1])) if counts.any() else np.zeros((rows + n, n))
    seen = np.pad(seen, ((0, rows + n - seen.shape[0]), (0, n - seen.shape[1])))
    # class rows hold all subwords of the class, those with a row of their own too
    np.add.at(seen, rows + group[top], seen[: len(top)])
    unigram = (total + 0.5) / (total + 0.5).sum()
    wide = (seen[rows:] + 20 * unigram) / (seen[rows:].sum(axis=1, keepdims=True) + 20)
    base = np.concatenate([np.zeros((rows, n)), wide])
    base[: len(top)] = (seen[: len(top)] + 20 * wide[group[top]]) / (seen[: len(top)].sum(axis=1, keepdims=True) + 20)
    base[len(top) : rows] = unigram
    kept = kept_pairs(pairs, top, slots)
    key = (kept["before"].to_numpy(np.uint32) << np.uint32(16)) | kept["id"].to_numpy(np.uint32)
    c = kept["c"].to_numpy(float)
    in_table = np.zeros((rows + n, n))
    np.add.at(in_table, (row[kept["before"]], group[kept["id"]]), c)
    prior = 5.0
    off = np.log(prior / (in_table + prior)).astype(np.float32)
    table, values = np.full(slots, 0xFFFFFFFF, np.uint32), np.zeros(slots, np.float32)
    at = slot_of(key, slots)
    table[at] = key
    values[at] = np.log((c + prior * np.exp(share[kept["id"]])) / (in_table[row[kept["before"]], group[kept["id"]]] + prior))
    return Model(group, row, np.log(base), share, off, table, values, window)


def kept_pairs(pairs: DataFrame, top: np.ndarray, slots: int) -> pd.DataFrame:
    """(before, id, c): of the most frequent pairs after a subword of top the most frequent of each slot, at most ``slots`` rows."""
    wanted = np.zeros(IDS, bool)
    wanted[top] = True
    found = frequent(pairs, "c", slots).toPandas()  # at most ``slots`` rows
    found = found[wanted[found["before"]]].sort_values(["c", "before", "id"], ascending=[False, True, True])
    key = (found["before"].to_numpy(np.uint32) << np.uint32(16)) | found["id"].to_numpy(np.uint32)
    return found[~pd.Series(slot_of(key, slots), index=found.index).duplicated()]


def padded(texts: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids before, ids, and which positions are real, of consecutive windows over texts' ids; each token is a target once."""
    counts = [-(-len(t) // window) for t in texts]
    before, after = np.zeros((2, sum(counts) * window), np.uint16)
    real = np.zeros(sum(counts) * window, bool)
    at = 0
    for t, n in zip(texts, counts):
        before[at : at + len(t)] = np.concatenate([[END], t[:-1]])
        after[at : at + len(t)] = t
        real[at : at + len(t)] = True
        at += n * window
    return before.reshape(-1, window), after.reshape(-1, window), real.reshape(-1, window)


WEIGHTS = "part int, branch int, sums binary, counts binary"


class Learned:
    """How far weights moved, times how often they were used, and how often: all but own vectors at once, these for each subword."""

    def __init__(self, size: int, width: int, parts: int = 64):
        self.moved, self.windows = np.zeros(size), np.zeros(1)
        self.own, self.uses = np.zeros((IDS, width)), np.zeros(IDS)
        self.ranges = np.array_split(np.arange(IDS), parts)

    def pieces(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(sums, counts) of each part, as views."""
        return [(self.moved, self.windows), *((self.own[r[0] : r[-1] + 1], self.uses[r[0] : r[-1] + 1]) for r in self.ranges)]

    def rows(self) -> pa.RecordBatch:
        sums, counts = zip(*self.pieces())
        return pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.nulls(len(sums), pa.int32()), pa.array([x.tobytes() for x in sums]), pa.array([x.tobytes() for x in counts])], ["part", "branch", "sums", "counts"])


def added(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one part as one."""
    total = [functools.reduce(np.add, (np.frombuffer(raw) for raw in pdf[c])).tobytes() for c in ("sums", "counts")]
    return pd.DataFrame([(pdf["part"].iat[0], pdf["branch"].iat[0], *total)], columns=["part", "branch", "sums", "counts"])


def train(texts: DataFrame, model: Model, rounds: int, task_tokens: int = 1 << 19, batch: int = 32) -> Model:
    """The model after every text of (row, ids) was learned from once, in one of the rounds.

    A task learns from at least about ``task_tokens`` tokens, if there are as many, and holds about as many at a time.
    """
    tokens = texts.agg(F.coalesce(F.sum(F.octet_length("ids") / 2), F.lit(0))).first()[0]
    tasks = max(1, int(tokens) // (rounds * task_tokens))
    start = model.attention
    for step in range(rounds):

        def learn(batches):
            own = Attention(start.base, start.group, window=start.window).load(start.flat(), start.own.copy())
            adam = Adam(own, 0.01 / (1 + step))
            done = Learned(len(start.flat()), start.own.shape[1])

            def learn_from(held: list[np.ndarray]) -> None:
                before, after, real = padded(held, own.window)
                order = np.random.default_rng(3).permutation(len(before))
                for at in range(0, len(order), batch):
                    some = order[at : at + batch]
                    adam.learn(before[some], model.row[before[some]], model.group[after[some]], real[some])
                done.windows += len(before)
                np.add(done.uses, np.bincount(before[real], minlength=IDS), out=done.uses)

            held, size = [], 0
            for some in batches:
                for _, raw in stretches(some.column("ids")):
                    held += [np.frombuffer(x, "<u2") for x in raw]
                    size += sum(map(len, raw)) // 2
                    if size >= task_tokens:
                        learn_from(held)
                        held, size = [], 0
            if held:
                learn_from(held)
            if done.windows:
                done.moved += (own.flat() - start.flat()) * done.windows
                done.own += (own.own - start.own) * done.uses[:, None]
                yield done.rows()
            give_back()

        part = texts.filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == step).select("ids").coalesce(tasks)
        found = part.mapInArrow(learn, WEIGHTS).withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(64)))
        found = found.groupBy("part", "branch").applyInPandas(added, WEIGHTS).groupBy("part").applyInPandas(added, WEIGHTS).toPandas()  # a row a part
        if len(found):
            total = Learned(len(start.flat()), start.own.shape[1])
            pieces = total.pieces()
            for r in found.itertuples():
                for to, raw in zip(pieces[r.part], (r.sums, r.counts)):
                    to += np.frombuffer(raw).reshape(to.shape)
            start.load(start.flat() + total.moved / total.windows, start.own + total.own / np.maximum(total.uses, 1)[:, None])
    return model


def score_texts(ids: list[np.ndarray], model: Model, overlap: int, block: int = 48) -> np.ndarray:
    """log10 probability of each text, given its ids with the end id last."""
    window = model.attention.window
    step = window - overlap
    lengths = np.array([len(i) for i in ids], np.int64)
    # every text in a row: overlap blanks, the end id that stands before it, its ids, blanks up to the next window's end
    room = overlap + 1 + -(-lengths // step) * step
    base = np.cumsum(room) - room
    line = np.full(int(room.sum()) + 1, END, np.uint16)
    for at, i in zip(base, ids):
        line[at + overlap + 1 : at + overlap + 1 + len(i)] = i
    group, row = model.group[line], model.row[line]
    inside = model.in_class(line[:-1], line[1:])
    n_windows = -(-lengths // step)
    text = np.repeat(np.arange(len(ids)), n_windows)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    begin = base[text] + turn * step  # the window's inputs start here; the first overlap of them are context alone
    totals = np.zeros(len(ids))
    inputs, rows = (np.lib.stride_tricks.sliding_window_view(x, window) for x in (line, row))
    targets, shares = np.lib.stride_tricks.sliding_window_view(group, step), np.lib.stride_tricks.sliding_window_view(inside, step)
    offset = np.arange(step)
    real = np.arange(window) >= overlap
    for early in (True, False):  # only a text's first window begins before it
        chosen = np.flatnonzero((turn == 0) == early)
        for at in range(0, len(chosen), block):
            some = chosen[at : at + block]
            here = begin[some]
            known = np.broadcast_to(real, (len(some), window)) if early else None
            log_p = model.attention.log_probs(inputs[here], rows[here, overlap:], known, targets[here + overlap + 1], overlap)
            log_p += shares[here + overlap]
            log_p[turn[some, None] * step + offset >= lengths[text[some], None]] = 0
            totals += np.bincount(text[some], log_p.sum(axis=1, dtype=np.float64), len(ids))
    return totals / np.log(10)


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = 64,
    overlap: int = 16,
    own: int = 128,
    shared: int = 63,
    rows: int = 8192,
    slots: int = 1 << 20,
    rounds: int = 4,
    common: int = 1 << 18,
) -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``rounds``: in as many parts the training documents are learned from, each
    once, with the tasks' weights averaged after each part.
    ``own`` and ``shared``: classes of one subword and of several. More of them
    score better and cost in proportion (held-out log10 a word of 1,000 and of
    10,000 documents: -4.14 and -4.02 with 32 + 32, -4.08 and -3.96 with
    128 + 63; -4.07 and -4.19 for the base score).
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    documents = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    counts = cut(word_counts(documents.filter("not held_out")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = frequent(counts, "c", common).toPandas()  # bounded by common
    known = dict(zip(map(bytes, top["word"]), np.log10(top["c"].to_numpy() + 1.0).tolist()))
    texts = cut(encode_texts(documents.withColumn("row", F.monotonically_increasing_id()), path, known), "encoded")
    learned = texts.filter("ids is not null and not held_out")
    pairs = cut(pair_counts(learned), "pairs")
    model = train(learned, learn_counts(pairs, window, own, shared, rows, slots), rounds)
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared_model.value
        for batch in batches:
            meta = batch.drop_columns(["ids"])
            for first, some in stretches(batch.column("ids"), 1 << 18):
                found = score_texts([np.frombuffer(raw, "<u2") for raw in some], model, overlap)
                part = meta.slice(first, len(some))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [*part.schema.names, "score"])

    meta = [c.split(" ")[0] for c in SCORED.split(", ")][:-1]
    scored = texts.filter("ids is not null").select(*meta, "ids").mapInArrow(score, SCORED)
    tail = texts.filter("word is not null").select("row", "word").join(counts, "word").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("*").alias("more_known"))
    floor = float(np.log10(total + distinct + 1.0))
    return scored.join(tail, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
    )
