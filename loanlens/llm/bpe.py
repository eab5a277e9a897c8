"""Byte-pair encoding and decoding (operator 9).

A word's symbols form a doubly linked list.  A priority queue holds the
merge rank of every adjacent pair; the lowest rank (then the leftmost place)
is merged first, its neighbours' new pairs are queued, and entries whose pair
has changed meanwhile are skipped when they come up.  Decoding concatenates
vocabulary strings, by the separator of a tokenizers file without decoder.

The vocabulary is a tokenizers JSON file of the ``word_bpe_49k.json`` kind:
NFC, white space to one space, lower case; a splitting pattern whose matches
are the words; bytes written as letters; ``</w>`` after a word's last
symbol; special tokens cut out of the raw text first.  Truncation and
padding are not used.

A text is encoded piece by piece between white space, which gives the same
ids since no word spans white space.  Workers remember pieces and words they
have encoded (bounded numbers); no row leaves its task, so nothing shuffles.

Cases: null text is empty: no ids, empty decoded text; one very long word
costs n log n in its length; repeated rows and ids each give a row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, remembers, text_of
from .words import WORD_END, WordRules, byte_letters

CACHE_PIECES = 150_000         # pieces a worker remembers; then it starts anew
CACHE_WORDS = 300_000          # likewise, words
SEPARATOR = " "                # between vocabulary strings, as without a decoder


class Bpe:
    _loaded: dict = {}

    def __init__(self, path: str):
        self.rules = WordRules(path)
        if not self.rules.known_kind:
            raise ValueError(f"{path}: not a vocabulary of words with word ends")
        spec = self.rules.spec
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = self.rules.special
        self.strings = {i: s for s, i in {**self.vocab, **self.special}.items()}
        self.by_rank = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in spec["model"]["merges"]]
        # a pair of ids (each below 2^20) as one integer -> rank
        self.rank_of = {a << 20 | b: rank for rank, (a, b, _) in enumerate(self.by_rank)}
        del spec["model"]["merges"]           # only ranks are looked up
        letters = byte_letters()
        self.inner = [self.vocab[letters[b]] for b in range(256)]
        self.final = [self.vocab[letters[b] + WORD_END] for b in range(256)]
        self.word_ids: dict[str, array] = {}
        self.pieces: dict[str, tuple[str, str]] = {}

    @classmethod
    def load(cls, path: str) -> "Bpe":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge pairs by rank until none is left; changes ``symbols``."""
        n = len(symbols)
        rank_of, by_rank = self.rank_of, self.by_rank
        queue = []                            # rank and place in one integer
        a = symbols[0]
        for i in range(1, n):
            b = symbols[i]
            rank = rank_of.get(a << 20 | b)
            if rank is not None:
                queue.append(rank << 32 | i - 1)
            a = b
        if not queue:
            return symbols
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            a, b, merged = by_rank[entry >> 32]
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue                      # stale: the pair has changed
            symbols[i], symbols[j] = merged, -1
            right = after[i] = after[j]
            if right >= 0:
                before[right] = i
                rank = rank_of.get(merged << 20 | symbols[right])
                if rank is not None:
                    push(queue, rank << 32 | i)
            left = before[i]
            if left >= 0:
                rank = rank_of.get(symbols[left] << 20 | merged)
                if rank is not None:
                    push(queue, rank << 32 | left)
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> array:
        ids = self.word_ids.get(word)
        if ids is None:
            raw = word.encode("utf-8", "replace")
            symbols = [self.inner[b] for b in raw]
            symbols[-1] = self.final[raw[-1]]
            ids = array("i", self.merge(symbols))
            if len(self.word_ids) >= CACHE_WORDS:
                self.word_ids.clear()
            self.word_ids[word] = ids
        return ids

    def _piece(self, piece: str) -> list[int]:
        return [i for w in self.rules.words(piece) for i in self._word(w)]

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        ids: list[int] = []
        for part in self.rules.cut.split(text):
            if part in self.special:
                ids.append(self.special[part])
            else:
                for piece in self.rules.between(part):
                    ids.extend(self._piece(piece))
        return ids

    def decode(self, ids: list[int]) -> str:
        return SEPARATOR.join([self.strings[i] for i in ids if i in self.strings])

    def round_trip(self, text: str) -> tuple[str, str]:
        """``(ids joined by one space, decoded text)`` of a text, by remembered pieces."""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        known, found = self.pieces, []
        for part in self.rules.cut.split(text):
            if part in self.special:
                found.append((str(self.special[part]), part))
                continue
            row = self.rules.between(part)
            for piece in row:
                if piece not in known:
                    ids = self._piece(piece)
                    known[piece] = " ".join(map(str, ids)), self.decode(ids)
            found.extend([known[p] for p in row])
        # a piece without any word (none exists for this vocabulary) adds nothing
        return (" ".join([a for a, _ in found if a]), SEPARATOR.join([b for a, b in found if a]))


remembers(__name__, Bpe._loaded.clear)


def _digests(path: str):
    def run(batches):
        bpe = Bpe.load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                counts, id_sums, text_sums = [], [], []
                for text in rows.column(1).to_pylist():
                    ids, decoded = bpe.round_trip(text)
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    id_sums.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sums.append(hashlib.sha256(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()),
                     pa.array(text_sums, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _tokens(path: str):
    def run(batches):
        bpe = Bpe.load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                ids = [bpe.encode(t) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                    names=["doc_id", "n_tokens", "token_ids"])
    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("body"))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, token_ids`` of every row."""
    return _rows(docs, id_col, text_col).mapInArrow(
        lean(_tokens(tokenizer_path)), "doc_id long, n_tokens long, token_ids array<int>")


def decode(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, token_ids`` (null ids: empty text)."""
    def run(batches):
        bpe = Bpe.load(tokenizer_path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])
    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, then decode, every row."""
    return _rows(docs, id_col, text_col).mapInArrow(
        lean(_digests(tokenizer_path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
