"""Cost-balanced packing of documents into token sequences.

Documents are encoded, cut into pieces of at most a sequence's length, and the
pieces are dealt by hash into groups of a bounded number of tokens and of pieces. Within a
group, in descending length, each piece goes to the sequence of lowest cost
that still has room; the cost of a piece of n tokens is ``n + n * n / length``,
the linear and the quadratic part of attention within a document. A group opens
as many sequences as its tokens fill; pieces that then fit nowhere are cut at
the room that is left, so almost no padding remains.

Pieces are dealt into groups by a hash that takes in their place in the table
of pieces, so repeated rows and rows without an id spread like any others.

A null or empty text is the end token alone. Repeated rows are packed each on
their own. Null ids are packed too. Columns other than the id and the text are
not read. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from shelfmark.llm.common import cut, give_back, kept, small_batches, stretches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks in parallel

_LETTERS = r"a-z\xdf-\xf6\xf8-\xff"
#: Punctuation between a letter and white space is a token of its own, so the word before it can be looked up alone (a bar may end a special token and stays).
_MARK = re.compile(rf"([!-/:-@\[-`{{}}~])(?<=[{_LETTERS}].)([!-/:-@\[-`{{}}~]*)(?=[ \n])")
#: What the vocabulary's rules cut into runs of letters, single digits and runs of other characters, as none can begin a contraction or a special token.
_PLAIN = re.compile(rf"[{_LETTERS}]+")
_SIMPLE = re.compile(rf"[{_LETTERS}0-9!-&(-/:;=-@\[-`{{-~]+")
_RUN = re.compile(rf"[{_LETTERS}]+|[0-9]|[!-/:-@\[-`{{-~]+")


def byte_letters() -> dict[int, str]:
    """What byte-level vocabularies write for each byte, blanks unchanged: itself where it can be printed, else a letter from 256 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(others)} | {0x20: " "}


_LETTER_OF = byte_letters()


def byte_level(text: str) -> str:
    """A text as byte-level vocabularies write it, words still between blanks."""
    return text if text.isascii() else text.encode("utf-8").decode("latin-1").translate(_LETTER_OF)


class WordEncoder:
    """Ids of whole texts, from the ids of their words, which are kept.

    The vocabulary ends every word with a mark, so pieces between blanks are
    encoded on their own, and many plain words in one call; its rules leave
    these words as they are, so its merges are applied to them without the rules.
    Of the words' ids about ``most`` bytes are kept, in two halves: when the
    newer one is full it becomes the older one, and words met again move from
    there to the newer.
    """

    def __init__(self, path: str, most: int = 64 << 20):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        self.ends = np.array([t.endswith("</w>") for t, _ in vocabulary])
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        letters = [c for c in map(chr, range(0x21, 0x100)) if _RUN.fullmatch(c)]
        every = " ".join([*letters, *(a + b for a in letters for b in letters if _PLAIN.fullmatch(a + b))])
        self.bare = self.merges.encode(byte_level(every)).ids == self.tokenizer.encode(every, add_special_tokens=False).ids
        self.most = most
        self.held = 0
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}

    def encode_all(self, words: list[str]) -> np.ndarray:
        """Ids of plain words and of runs of other ones, one after the other."""
        texts = [" ".join(words[i : i + 4096]) for i in range(0, len(words), 4096)]
        found = self.merges.encode_batch_fast(list(map(byte_level, texts))) if self.bare else self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([np.zeros(0, "<u4"), *(np.array(e.ids, dtype="<u4") for e in found)])

    def learn(self, words: list[bytes]) -> None:
        """Keep the ids of distinct words that are not among the newer ones."""
        self.held += sum(map(len, words)) * 2 + 150 * len(words)
        plain, simple, runs, rest = [], [], [], []
        for raw in words:
            if (ids := self.older.get(raw)) is not None:
                self.known[raw] = ids
            elif _PLAIN.fullmatch(word := raw.decode("utf-8", "surrogatepass")):
                plain.append((raw, word))
            elif _SIMPLE.fullmatch(word):
                simple.append(raw)
                runs.append(_RUN.findall(word))
            else:
                rest.append((raw, word))
        plain, said = map(list, zip(*plain)) if plain else ([], [])
        last = np.array([1] * len(plain) + [len(r) for r in runs], np.int64)
        ids = self.encode_all([*said, *itertools.chain.from_iterable(runs)])
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        raw = ids.tobytes()
        if len(ends) != last.sum():
            raise ValueError("the vocabulary does not end every word with a mark")
        ends = ends[np.cumsum(last) - 1].tolist()
        self.known.update(zip([*plain, *simple], map(raw.__getitem__, map(slice, [0, *ends], ends))))
        for (raw, _), e in zip(rest, self.tokenizer.encode_batch_fast([w for _, w in rest], add_special_tokens=False)):
            self.known[raw] = np.array(e.ids, dtype="<u4").tobytes()

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        found = list(map(self.known.get, words))
        if None in found:
            new = [w for w, x in zip(words, found) if x is None]
            if self.held + sum(map(len, new)) * 2 + 150 * len(new) > self.most // 2:
                self.known, self.older, self.held = {b"": b""}, self.known, 0
            self.learn(new)
            get = self.known.get
            found = [get(w) if x is None else x for w, x in zip(words, found)]
        return found

    def batch(self, texts) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, in UTF-8 or a string; null is empty."""
        marked = []
        for text in texts:
            raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
            low = raw.lower().decode("utf-8", "surrogatepass")
            marked.append(_MARK.sub(r" \1\2", low).replace("\n", " ").encode("utf-8", "surrogatepass"))
        split = pc.split_pattern(pa.array(marked, pa.large_binary()), " ")
        words = split.flatten().dictionary_encode()
        ids = self.ids_of(words.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        word = words.indices.to_numpy()
        lengths = sizes[word]
        done = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        place = np.repeat((np.cumsum(sizes) - sizes)[word] - done[:-1], lengths)
        place += np.arange(len(place))
        line = flat[place].tobytes()
        stops = (4 * done[split.offsets.to_numpy()]).tolist()
        return [line[i:j] for i, j in zip(stops, stops[1:])]


def word_encoder(path: str) -> WordEncoder:
    return kept(WordEncoder, path)


def pack(lengths: list[int], size: int, grain: int = 1) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(item, start in it, length, sequence, offset) for items of at most size tokens, cut at multiples of grain, and the number of sequences.

    A tree over the room that is left, each leaf a heap of (cost, sequence),
    gives the cheapest sequence with enough room in logarithmic time.
    """
    import heapq

    width = 1 << size.bit_length()
    least = [(float("inf"), -1)] * (2 * width)
    heaps: list[list] = [[] for _ in range(size + 1)]
    used = [0] * max(1, -(-sum(lengths) // size))
    cost = [0.0] * len(used)

    def lift(room: int) -> None:
        i = room + width
        least[i] = heaps[room][0] if heaps[room] else (float("inf"), -1)
        while i > 1:
            i >>= 1
            least[i] = min(least[2 * i], least[2 * i + 1])

    def cheapest(room: int) -> int:
        best, lo, hi = (float("inf"), -1), room + width, 2 * width
        while lo < hi:
            if lo & 1:
                best = min(best, least[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, least[hi])
            lo, hi = lo >> 1, hi >> 1
        return best[1]

    heaps[size] = [(0.0, s) for s in range(len(used))]
    lift(size)
    out = []

    def put(item: int, start: int, n: int, s: int) -> None:
        room = size - used[s]
        heapq.heappop(heaps[room])
        lift(room)
        out.append((item, start, n, s, used[s]))
        used[s] += n
        cost[s] += n + n * n / size
        heapq.heappush(heaps[room - n], (cost[s], s))
        lift(room - n)

    left = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if (s := cheapest(lengths[item])) >= 0:
            put(item, 0, lengths[item], s)
        else:
            left.append(item)
    for item in left:  # cut at the room that is left, largest first
        start = 0
        while start < lengths[item]:
            room = next((r for r in range(size, 0, -1) if heaps[r]), 0)
            rest = lengths[item] - start
            n = rest if rest <= room else room - room % grain
            if not n:
                used.append(0)
                cost.append(0.0)
                heapq.heappush(heaps[size], (0.0, len(used) - 1))
                lift(size)
                continue
            put(item, start, n, heaps[room][0][1])
            start += n
    return out, len(used)


def combined(blocks: list[int], sizes: list[int]) -> int:
    """CRC-32 of a concatenation, from the CRC-32 and the length in bytes of its parts."""
    total = 0
    for crc, n in zip(blocks, sizes):
        total = _shift(total, n) ^ crc
    return total


@functools.lru_cache(4096)
def _matrix(n: int) -> tuple[int, ...]:
    """What n zero bytes do to each bit of a CRC-32 without its inversions."""
    zeros = bytes(n)
    nothing = zlib.crc32(zeros, 0)
    return tuple(zlib.crc32(zeros, 1 << k) ^ nothing for k in range(32))


def _shift(crc: int, n: int) -> int:
    rows, out, k = _matrix(n), 0, 0
    while crc:
        if crc & 1:
            out ^= rows[k]
        crc >>= 1
        k += 1
    return out


PIECES = "doc_id long, start long, length long, doc_tokens long, crcs array<long>"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, size: int, grain: int) -> DataFrame:
    """Pieces of at most size tokens, each with the CRC-32 of every ``grain`` of its ids, so that it can be cut there later."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches):
        enc = word_encoder(tokenizer)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, texts in stretches(batch.column("text")):
                rows = []
                for doc, raw in zip(ids[first : first + len(texts)], enc.batch(texts)):
                    raw += end
                    n = len(raw) // 4
                    for at in range(0, n, size):
                        here = raw[4 * at : 4 * (at + size)]
                        rows.append((doc, at, len(here) // 4, n, [zlib.crc32(here[i : i + 4 * grain]) for i in range(0, len(here), 4 * grain)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        give_back()

    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, PIECES)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    size: int = 2048,
    grain: int = 64,
    group_tokens: int = 1 << 24,
    group_pieces: int = 1 << 17,
) -> DataFrame:
    """Every piece of every document and its place in a sequence.

    ``grain``: pieces are cut only at multiples of it. ``group_tokens``
    and ``group_pieces``: about as many tokens, and no more than about as many
    pieces, are packed together in one task, whatever the input's size.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    with small_batches(docs.sparkSession):
        pieces = cut(encode_pieces(docs, id_col, text_col, path, end_id, size, grain), "pieces")
    total, count = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-total // group_tokens), -(-count // group_pieces))

    def place(key, pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        doc, start, length, tokens, crcs = (pdf[c].tolist() for c in ("doc_id", "start", "length", "doc_tokens", "crcs"))
        rows = []
        for item, first, n, s, offset in pack(length, size, grain)[0]:
            parts = range(first, first + n, grain)
            crc = combined([int(crcs[item][i // grain]) for i in parts], [4 * min(grain, first + n - i) for i in parts])
            rows.append((doc[item], start[item] + first, n, crc, tokens[item], (group << 32) + s, offset))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")]).astype({"doc_id": "Int64"})

    place_of = F.xxhash64("doc_id", "start", "length", F.monotonically_increasing_id())
    return pieces.withColumn("g", F.pmod(place_of, F.lit(groups))).groupBy("g").applyInPandas(place, PACKED)
