"""Byte-level BPE, encoded by one walk over a trie of words, and decoded.

Any prefix of a word has an encoding of its own, and the encoding of the word is determined by the last token
of each of its prefixes: if the last token of a prefix is t, what comes before t is encoded as the prefix without
t is. So the distinct words of many documents make one trie, and a depth-first walk works out the last token of
every node once, whatever the number of words that share it: of the tokens that end there, the one that may follow
the last token of the node where it starts. Where tokens can have begun is handed down with it. Sorted words are
the trie in depth-first order, each a branch from the one before, so its nodes are never held all at once. Two tokens may follow one another if merging their
joined bytes gives just these two; that is decided by undoing their merges from the latest back, and failing if
the bytes at the seam would have merged before. A word's ids are read off from its node upwards.

Texts are first cut at the added tokens, then into words as the tokenizer's file says. The pattern's classes follow the
Unicode version of ``regex``; texts with code points that version knows and the tokenizer's may not (unassigned in
Python's own table) are cut by the tokenizers library, so words are always its words. The merges are done here.

Memory in a task: the words of ``SLICE`` characters of text (a longer text is taken in runs of ``RUN`` words), the path to
one node of their trie, and words kept from earlier slices, two generations of ``KEPT_BYTES`` each. No shuffle, nothing is written or sent to the driver.

Defined results: null is the empty text, which has no tokens; repeated rows are encoded alike; other columns are
ignored, whatever their names; an empty table gives no rows. Files whose model is not plain byte-level BPE are refused.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

SLICE, RUN, DEEP, KEPT_BYTES, KEPT_PAIRS, ROWS = 1 << 20, 100_000, 1_000, 32 << 20, 1 << 18, 500

#: Fixed: how the byte-level pre-tokenizer cuts a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in the file: itself if it shows, else the next from U+0100."""
    shown = [b for r in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(r[0], r[1] + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def branches(words: Iterable[bytes]) -> Iterator[tuple[bytes, int]]:
    """A trie of the distinct words in depth-first order: each word with the depth at which its branch leaves the one before.

    What a word shares with its predecessor is the path of nodes already walked; the rest are its own new nodes.
    """
    before = b""
    for word in sorted(set(words)):
        shared = len(before)
        if not word.startswith(before):
            shared = 0
            while before[shared] == word[shared]:
                shared += 1
        yield word, shared
        before = word


class Vocabulary:
    """Tokens and merges of a tokenizer file."""

    def __init__(self, path: str):
        file = _file(path)
        model, pre = file["model"], file["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        flags = [a["content"] for a in file["added_tokens"] if a["single_word"] or a["lstrip"] or a["rstrip"]]
        if model["type"] != "BPE" or odd or flags or file["normalizer"] or not pre or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError(f"{path} is not plain byte-level BPE: {odd or flags or pre}")
        self.path, chars = path, _byte_chars()
        as_bytes = lambda s: bytes(chars[c] for c in s)
        self.added = {a["content"]: a["id"] for a in file["added_tokens"]}
        ids = {as_bytes(s): i for s, i in model["vocab"].items() if s not in self.added}
        self.bytes_of = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.added.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair: (rank, token)
        self.halves: dict[int, tuple[int, int, int]] = {}  # token: (rank, left, right)
        usable = {ids[bytes([b])] for b in range(256)}
        for rank, pair in enumerate(model["merges"]):
            left, right = (ids[as_bytes(s)] for s in (pair.split(" ") if isinstance(pair, str) else pair))
            token = ids[self.bytes_of[left] + self.bytes_of[right]]
            self.merge.setdefault((left, right), (rank, token))
            # a token counts if its own bytes merge to it: its halves do, and don't merge across before
            if token not in self.halves and left in usable and right in usable and self._stay_apart(left, right, rank):
                self.halves[token] = (rank, left, right)
                usable.add(token)
        self.ids = {b: i for b, i in ids.items() if i in usable}
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        #: every beginning of a token, with the token's id if it is one, else -1
        self.prefixes = {b[:k]: -1 for b in self.ids for k in range(1, len(b))} | self.ids
        self._pairs: dict[tuple[int, int], bool] = {}

    def _stay_apart(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge across the seam of ``a`` and ``b`` comes before rank ``before``, however far both are undone."""
        while True:
            across = self.merge.get((a, b))
            if across and across[0] < before:
                return False
            left, right = self.halves.get(a), self.halves.get(b)
            if not left and not right:
                return True
            # undo the later merge; of the same merge twice, the right one, which came second
            if left and (not right or left[0] > right[0]):
                before, a = left[0], left[2]
            else:
                before, b = right[0] + 0.5, right[1]  # an equal merge further left would have come first

    def may_follow(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= KEPT_PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self._stay_apart(a, b)
        return known

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, ids) of every distinct word, by one depth-first walk over their trie.

        For each node on the present path: the last token of its prefix, and where tokens may have begun that go on below
        it. The latter are kept to depth ``DEEP``; words that share more are walked again from there.
        """
        last, open_ = [-1], [[]]
        for word, shared in branches(words):
            shared = min(shared, len(open_) - 1)
            del last[shared + 1 :], open_[shared + 1 :]
            begun = open_[shared]
            for end in range(shared + 1, len(word) + 1):
                begun, token = self.step(word, end, begun, last)
                last.append(token)
                if end <= DEEP:
                    open_.append(begun)
            out, end, size = [], len(word), self.size
            while end:
                out.append(last[end])
                end -= size[last[end]]
            yield word, out[::-1]

    def step(self, word: bytes, end: int, begun: list[int], last: list[int]) -> tuple[list[int], int]:
        """Of the starts ``begun`` above the node ``word[:end]`` and the one at it, those still open; and the node's last token."""
        starts: list[int] = []
        found = -1
        prefixes, pairs = self.prefixes, self._pairs
        for start in (*begun, end - 1):  # the longest first
            token = prefixes.get(word[start:end])
            if token is not None:
                starts.append(start)
                if token >= 0 and found < 0:
                    fits = not start or pairs.get((last[start], token))
                    if fits or (fits is None and self.may_follow(last[start], token)):
                        found = token
        return starts, found


class Encoder:
    """Texts to ids, keeping the ids of words met before within a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.words = vocabulary, regex.compile(WORDS)
        self.at_added = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.added, key=len, reverse=True))) if vocabulary.added else None
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before
        self.kept_bytes, self._foreign = 0, {}
        self.packed = {i: i.to_bytes(4, "little") for i in vocabulary.bytes_of}

    def _has_foreign(self, text: str) -> bool:
        if text.isascii():
            return False
        seen = self._foreign
        for c in set(text):
            if c not in seen:
                seen[c] = unicodedata.category(c) == "Cn"
            if seen[c]:
                return True
        return False

    def _units(self, text: str) -> list[str]:
        """Stretches of the text that are cut into words each by itself.

        A single blank between two other characters that aren't white space begins a word whatever comes before it,
        so a stretch may begin there; most are one word with its blank.
        """
        pieces = text.split(" ")
        out = [pieces[0]]
        open_ = not pieces[0] or pieces[0][-1].isspace()  # what comes before the blank joins on to it
        for i, piece in enumerate(pieces[1:]):
            if not piece:
                out[-1] += " "
                open_ = True
            else:
                if (open_ and (i or out[0])) or piece[0].isspace():
                    out[-1] += " " + piece
                else:
                    out.append(" " + piece)
                open_ = piece[-1].isspace()
        return out

    def _runs(self, text: str) -> Iterator[list[str] | bytes]:
        """Units of the text, and the ids of what is no unit (added tokens, words of the library), in order."""
        at = 0
        for m in self.at_added.finditer(text) if self.at_added else ():
            yield from self._between(text[at : m.start()])
            yield self.packed[self.vocabulary.added[m.group()]]
            at = m.end()
        yield from self._between(text[at:] if at else text)

    def _between(self, text: str) -> Iterator[list[str] | bytes]:
        if self._has_foreign(text):
            yield self._join([text[a:b] for _, (a, b) in _library(self.vocabulary.path).pre_tokenizer.pre_tokenize_str(text)])
        elif len(text) <= SLICE:
            yield self._units(text)
        else:
            found = (m.group() for m in self.words.finditer(text))
            while run := list(islice(found, RUN)):
                yield self._join(run)

    def _age(self) -> None:
        if self.kept_bytes > KEPT_BYTES:
            self.older, self.kept, self.kept_bytes = self.kept, {}, 0

    def _join(self, words: list[str]) -> bytes:
        self._age()
        self._learn_words(set(words))
        return b"".join([self.kept[w] for w in words])

    def _unknown(self, texts: set[str]) -> set[str]:
        """Those of which neither generation knows the ids; what only the older knows joins the younger."""
        missing = texts - self.kept.keys()
        for text in missing & self.older.keys():
            self._keep(text, self.older[text])
        return missing - self.kept.keys()

    def _learn_words(self, words: set[str]) -> None:
        for word, ids in self.vocabulary.encode_words([w.encode() for w in self._unknown(words)]):
            self._keep(word.decode(), b"".join([self.packed[i] for i in ids]))

    def _keep(self, text: str, ids: bytes) -> None:
        self.kept[text] = ids
        self.kept_bytes += len(text) + len(ids) + 180  # the two objects and their place in the table

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        slice_, size = [], 0
        for text in texts:
            slice_.append(list(self._runs(text)))
            size += len(text)
            if size > SLICE:
                yield from self._slice(slice_)
                slice_, size = [], 0
        yield from self._slice(slice_)

    def _slice(self, texts: list[list[list[str] | bytes]]) -> Iterator[bytes]:
        self._age()
        kept = self.kept
        cut = {u: self.words.findall(u) for u in self._unknown({u for runs in texts for run in runs if isinstance(run, list) for u in run})}
        self._learn_words({w for words in cut.values() for w in words})
        for unit, words in cut.items():
            if unit not in kept:
                self._keep(unit, b"".join([kept[w] for w in words]))
        for runs in texts:
            yield b"".join([run if isinstance(run, bytes) else b"".join([kept[u] for u in run]) for run in runs])


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(Vocabulary(path))


@lru_cache(maxsize=1)
def _table(path: str) -> dict[int, bytes]:
    file, chars = _file(path), _byte_chars()
    added = {a["id"]: a["content"].encode() for a in file["added_tokens"]}
    return {i: bytes(chars[c] for c in s) for s, i in file["model"]["vocab"].items() if i not in added} | added


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ROWS`` rows at a time, so that what is given back is never a whole batch at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each text; ``ids`` is binary, four little-endian bytes a token (see :func:`token_ids`).

    ``path`` names a tokenizer file that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)  # kept by the worker for its next task
        for batch in _small(batches):
            ids = pa.array(encoder.encode(t.as_py() for t in batch.column("text")), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the text that its ``ids`` stand for; bytes that aren't UTF-8 become U+FFFD, unknown ids nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for batch in _small(batches):
            texts = [None if i is None else b"".join([table.get(t, b"") for t in np.frombuffer(i, "<u4").tolist()]).decode("utf-8", "replace") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{fields}, decoded string")


def token_ids(ids: Column) -> Column:
    """A binary column of ids as an array of longs."""
    token = lambda i: F.conv(F.hex(F.concat(*[F.substr(ids, 4 * i + k, F.lit(1)) for k in (4, 3, 2, 1)])), 16, 10).cast("long")
    n = F.length(ids) / 4
    return F.when(n == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), token))
