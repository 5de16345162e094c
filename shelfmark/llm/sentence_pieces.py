"""Encoding with a SentencePiece vocabulary of merge (BPE) type, and decoding.

A sequence of pieces is the merge encoding of a text exactly if each piece by
itself, and each two that follow each other, are the merge encoding of their
own text: merges are taken by score and then from the left, so what happens in
two neighbouring pieces depends on these two alone. The encoder therefore walks
through a text once. An Aho-Corasick automaton gives the longest piece that
starts at each position; it is taken if it agrees with the piece before it,
which merging the two anew decides; else the next shorter one is tried, and
where none is left the piece before it is taken back and the position is marked
in a field of failed positions, which is never reached again, as a text's
beginning has one encoding only. The steps thus grow with the text's length.

Characters that are no piece stand alone and become the pieces of their bytes.
Texts are encoded in parts that no piece of the vocabulary crosses, and parts
that come again are looked up.

A null or empty text has no pieces but the end's, and decodes to the empty text.
Bytes that are no UTF-8 are read as U+FFFD. Ids are passed through, null or
repeated ones too: one row out for each row in. Columns other than the id and
the text are not read, so their names cannot clash. An empty table gives an
empty table.
"""

from __future__ import annotations

import codecs
import functools
import re
from array import array

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import give_back, stretches

SPACE = "▁"


class Vocabulary:
    """The pieces of a model file, and what the encoder and the decoder look up in them.

    The file is read by its library; encoding and decoding are done here. Files
    whose text rules are others than a leading mark and marks for blanks, or that
    lack pieces for bytes, are refused.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        probe = "  Aé ﬁ\t①  x "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE) or any(map(model.is_unused, ids)):
            raise ValueError("only vocabularies that keep texts as they are, but for marks in place of blanks, are supported")
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.ids = {self.pieces[i]: i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.scores = {piece: model.get_score(i) for piece, i in self.ids.items()}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in ids if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no piece for some byte")
        self.end = model.eos_id()
        one = {i: bytes([b]) for b, i in self.bytes.items()}
        silent = {i: b"" if model.is_control(i) else " ⁇ ".encode() for i in ids if model.is_control(i) or model.is_unknown(i)}
        self.surfaces = [one.get(i, silent.get(i, self.pieces[i].replace(SPACE, " ").encode())) for i in ids]
        self.silent = {i for i in silent if model.is_control(i)}
        self.single = set(one)
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        whole = {p for p in self.ids if self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in whole:
            self.automaton.add_word(p, (self.ids[p], len(p)))
        self.automaton.make_automaton()
        # By number of a piece: its text, its length, the longest shorter piece that it begins with (-1 for none). Characters
        # that are no piece get numbers of their own beyond the vocabulary's when they are met.
        self.texts = list(self.pieces)
        self.sizes = [len(p) for p in self.pieces]
        self.shorter = [next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in whole), -1) for p in self.pieces]
        self.alone: dict[str, int] = {}
        apart = [c for c in "\n\t\r" if not any(c in pair for pair in self.inner)]
        #: A character that no longer piece holds, if blanks part texts as well: parts can be joined with it to be encoded in one go.
        self.mark = None if any(a != SPACE and b == SPACE for a, b in self.inner) or "\n" not in apart else "\n"
        self.parts = re.compile(self.part_pattern("".join(apart)) if self.mark else r"(?s:.+)")
        self.agreed: dict[int, bool] = {}

    def part_pattern(self, stop: str) -> str:
        """Pattern of the parts of a text: a part ends before blanks, at characters that no longer piece holds, and after word characters that no piece lets others follow."""
        word = re.compile(r"\w")
        bound = {a for a, b in self.inner if word.match(a) and not word.match(b) and b != SPACE}
        held = "".join(map(re.escape, sorted(bound)))
        letters = rf"[^\W{held}]"
        others = rf"(?:[^\w{SPACE}{stop}]|[{held}])" if held else rf"[^\w{SPACE}{stop}]"
        return f"[{stop}]|{SPACE}+{others}*{letters}*|{others}+{letters}*|{letters}+"

    def number(self, char: str) -> int:
        """The number of a character that is no piece."""
        if char not in self.alone:
            self.alone[char] = len(self.texts)
            self.texts.append(char)
            self.sizes.append(1)
            self.shorter.append(-1)
        return self.alone[char]

    def merged(self, text: str) -> list[str]:
        """Merge encoding by its definition: the pair of highest score, of these the leftmost, until none is a piece."""
        parts = list(text)
        score = lambda i: self.scores.get(parts[i] + parts[i + 1], -np.inf)
        scores = [score(i) for i in range(len(parts) - 1)]
        while scores and (best := max(scores)) > -np.inf:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            for k in (i - 1, i):
                if 0 <= k < len(scores):
                    scores[k] = score(k)
        return parts

    def agree(self, a: int, b: int, most: int = 400_000) -> bool:
        """Whether two pieces that follow each other stay as they are when their text is merged anew; ``most`` answers are kept."""
        one, two = self.texts[a], self.texts[b]
        answer = one[-1] + two[0] not in self.inner or self.merged(one + two) == [one, two]
        if len(self.agreed) >= most:
            self.agreed.clear()
        self.agreed[a << 32 | b] = answer
        return answer


def backtrack(text: str, vocabulary: Vocabulary) -> list[int]:
    """The merge encoding of a text, as numbers of pieces; characters that are no piece stand alone."""
    sizes, shorter, agreed, agree = vocabulary.sizes, vocabulary.shorter, vocabulary.agreed, vocabulary.agree
    longest = [-1] * len(text)
    for end, (piece, n) in vocabulary.automaton.iter(text):  # ends ascend, so the last piece of a start is its longest
        longest[end + 1 - n] = piece
    failed = bytearray(len(text) + 1)
    taken: list[int] = []
    at, before = 0, -1
    while at < len(text):
        piece = longest[at]
        if piece < 0:
            piece = vocabulary.number(text[at])
        while True:
            while piece >= 0:
                if not failed[at + sizes[piece]]:
                    if before < 0:
                        break
                    answer = agreed.get(before << 32 | piece)
                    if answer or answer is None and agree(before, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                break
            if not taken:
                raise ValueError("no sequence of pieces agrees with itself")
            failed[at] = 1
            at -= sizes[taken[-1]]
            piece = shorter[taken.pop()]
            before = taken[-1] if taken else -1
        taken.append(piece)
        at += sizes[piece]
        before = piece
    return taken


class Encoder:
    """Ids of whole texts, from the ids of their parts, of which about ``most`` bytes are kept."""

    def __init__(self, path: str, most: int = 128 << 20):
        self.vocabulary = Vocabulary(path)
        self.most = most
        self.held = 0
        self.known: dict[str, bytes] = {}

    def plain(self, numbers: list[int]) -> bytes:
        """Little-endian 32-bit ids of pieces by number; other characters become the ids of their bytes."""
        v = self.vocabulary
        if numbers and max(numbers) >= len(v.pieces):
            numbers = [i for x in numbers for i in ([x] if x < len(v.pieces) else [v.bytes[b] for b in v.texts[x].encode()])]
        return array("i", numbers).tobytes()

    def learn(self, parts: list[str]) -> None:
        """Encode parts and keep their ids; many of them are encoded in one go."""
        v = self.vocabulary
        size = sum(map(len, parts)) * 3 + 200 * len(parts)
        if self.held + size > self.most:
            self.known, self.held = {}, 0
        self.held += size
        whole = [p for p in parts if p == v.mark or v.mark is None]
        for p in whole:
            self.known[p] = self.plain(backtrack(p, v))
        rest = [p for p in parts if p not in self.known]
        if rest:
            numbers = backtrack(v.mark.join(rest), v)
            mark = v.ids.get(v.mark, v.alone.get(v.mark))
            ends = [i for i, x in enumerate(numbers) if x == mark] + [len(numbers)]
            self.known.update(zip(rest, map(self.plain, map(numbers.__getitem__, map(slice, [0, *(e + 1 for e in ends)], ends)))))

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text without the end's."""
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[bytes]:
        v = self.vocabulary
        split = [v.parts.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        found = [list(map(self.known.get, parts)) for parts in split]
        new = {p for parts, ids in zip(split, found) if None in ids for p, x in zip(parts, ids) if x is None}
        if new:
            self.learn(list(new))
            for i, ids in enumerate(found):
                if None in ids:
                    found[i] = [self.known[p] if x is None else x for p, x in zip(split[i], ids)]
        return [b"".join(ids) for ids in found]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the leading mark goes, bytes that are no UTF-8 become U+FFFD one by one."""
        v = self.vocabulary
        raw = list(map(v.surfaces.__getitem__, ids))
        first = next((i for i, x in enumerate(ids) if x not in v.silent), None)
        if first is not None and ids[first] not in v.single and v.pieces[ids[first]].startswith(SPACE):
            raw[first] = raw[first][1:]
        try:
            return b"".join(raw).decode()
        except UnicodeDecodeError:
            return b"".join(raw).decode(errors="shelfmark_each_byte")


def _each_byte(error: UnicodeError):
    return "�", error.start + 1


@functools.cache
def encoder(path: str) -> Encoder:
    codecs.register_error("shelfmark_each_byte", _each_byte)
    return Encoder(path)


def _path(model: str | None) -> str:
    return model or public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, end: bool = True, decoded: bool = False) -> DataFrame:
    """The id and ``ids`` of every text, with the end id if ``end``; with ``decoded`` also the text that these ids decode to."""
    path = _path(model)
    source = docs.select(id_col, F.col(text_col).cast("string").alias("_text"))
    shape = docs.select(id_col).withColumn("ids", F.lit(None).cast("array<int>"))
    if decoded:
        shape = shape.withColumn("decoded", F.lit(None).cast("string"))
    names = shape.columns

    def run(batches):
        enc = encoder(path)
        last = np.array([enc.vocabulary.end] if end else [], dtype="<i4").tobytes()
        for batch in batches:
            keys = batch.column(0)
            for first, texts in stretches(batch.column(1)):
                rows = [ids + last for ids in enc.batch([t.decode(errors="replace") for t in texts])]
                values = np.frombuffer(b"".join(rows), dtype="<i4")
                ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
                columns = [keys.slice(first, len(rows)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))]
                if decoded:
                    columns.append(pa.array([enc.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    return source.mapInArrow(run, shape.schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """The id and ``text`` of every row of ids; null is no ids, an id beyond the vocabulary is an error."""
    path = _path(model)
    source = encoded.select(id_col, F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("_ids"))
    shape = encoded.select(id_col).withColumn("text", F.lit(None).cast("string"))
    names = shape.columns

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([enc.decode(ids) for ids in part.column(1).to_pylist()], pa.string())], names)

    return source.mapInArrow(run, shape.schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: number of ids, digest of the ids, digest of the text that they decode to."""
    found = encode(docs, decoded=True)
    listed = F.translate(F.to_json("ids"), ",[]", " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
