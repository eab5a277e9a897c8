"""Token ids as ORC files (operator 1).

Documents are range-partitioned on their id and sorted inside each file, so
the files in name order hold the ids in ascending order.  Each task encodes
its rows with a ``tokenizers`` vocabulary and Spark's ORC writer stores
``doc_id, part, pos, start_in_part, n_tokens, token_ids``: integer columns
in run-length encoding, a row index every ``row_index_stride`` rows and a
Bloom filter on ``doc_id``.  Stripes are the unit of parallel reads; a filter
on ``doc_id`` prunes files and stripes by their statistics and row groups by
index and Bloom filter.

Encoding a text equals encoding its words one after the other when the
tokenizer's pre-tokenizer drops white space and marks word ends (as that of
``word_bpe_49k.json`` does).  Words repeat, so each worker keeps the ids of the
words it has seen (it starts anew after ``CACHE_WORDS``) and hands only new
words to the library.  Texts that hold a special token's
string or code points newer than Python's Unicode tables, and all texts under
a vocabulary of another kind, are encoded whole.

Cases: null text is empty and gets the end id alone; a null id sorts first;
repeated ids are ordered by text, and the rows of one id (or of none) are
parted among files by how their texts begin; an empty table gives an empty folder of
files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, partitions, remembers, text_of
from .words import WordRules, byte_letters

END_ID = 2
RANGE_LETTERS = 64             # of a text in a range's bounds, which the driver holds
CACHE_WORDS = 700_000          # words a worker remembers; then it starts anew
STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 1000
BLOOM_FPP = 0.01
_SCHEMA = ("doc_id long, part int, pos long, start_in_part long, n_tokens long, token_ids array<int>")


class _Ragged:
    """Id sequences one after the other; ``starts[n]:starts[n + 1]`` is number n."""

    def __init__(self):
        self.ids, self.starts = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.count = self.used = 0

    def append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while self.count + len(lengths) + 1 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * len(self.starts))
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts[self.count + 1:self.count + 1 + len(lengths)] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.count += len(lengths)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of ``numbers`` joined, and where each ends."""
        first = self.starts[numbers]
        lengths = self.starts[numbers + 1] - first
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(first - (ends - lengths), lengths)], ends


class _Numbers(dict):
    """A number for each word, in the order of their first lookups."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def take_new(self) -> list[str]:
        """The words numbered since the last call, in the order of their numbers."""
        new, self.new = self.new, []
        return new


class PieceEncoder:
    """Encodes texts with a tokenizers file; remembers the ids of words."""

    _loaded: dict = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.rules = WordRules(path)
        # texts with one of these are encoded whole
        self.special = re.compile("|".join(map(re.escape, self.rules.special)) or "(?!)")
        self.letters = byte_letters()
        self.forget()

    @classmethod
    def load(cls, path: str) -> "PieceEncoder":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def forget(self) -> None:
        self.number = _Numbers()
        self.ids = _Ragged()

    def _learn(self, words: list[str]) -> None:
        # words are cut and normalised: the library's model alone has to encode
        # them, their bytes written as letters
        tokenize = self.tokenizer.model.tokenize
        ids, lengths = [], []
        for w in words:
            found = tokenize(w if w.isascii() and w.isprintable()
                             else w.encode("utf-8", "replace").decode("latin-1").translate(self.letters))
            lengths.append(len(found))
            ids.extend([t.id for t in found])
        self.ids.append(np.array(ids, np.int32), np.array(lengths, np.int64))

    def encode_joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the bounds of each text in them."""
        if len(self.number) > CACHE_WORDS:
            self.forget()
        whole = [not self.rules.known_kind or self.special.search(t) is not None or self.rules.unknown(t)
                 for t in texts]
        rows = [[] if odd else self.rules.words(t) for t, odd in zip(texts, whole)]
        upto = np.cumsum([0, *map(len, rows)])
        # one lookup a word; an unknown one gets the next number and is learned below
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(rows)), np.int64, upto[-1])
        try:
            self._learn(self.number.take_new())
        except BaseException:
            self.forget()      # numbers without ids
            raise
        ids, ends = self.ids.take(numbers)
        bounds = np.concatenate([[0], ends])[upto]
        if True in whole:
            parts = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) if odd else ids[a:b]
                     for t, odd, a, b in zip(texts, whole, bounds, bounds[1:])]
            ids, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, bounds

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, bounds = self.encode_joined(texts)
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


remembers(__name__, PieceEncoder._loaded.clear)


def _encode_part(tokenizer_path: str, end_id: int | None):
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encoder = PieceEncoder.load(tokenizer_path)
        pos = start = 0
        for batch in batches:
            # a few texts at a time keep the working set small
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                ids, bounds = encoder.encode_joined(piece.column(1).to_pylist())
                if end_id is not None:
                    ids = np.insert(ids, bounds[1:], end_id)
                    bounds = bounds + np.arange(len(bounds))
                n, lengths = piece.num_rows, np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.full(n, part, np.int32)),
                     pa.array(pos + np.arange(n)), pa.array(start + bounds[:-1]), pa.array(lengths),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "part", "pos", "start_in_part", "n_tokens", "token_ids"])
                pos += n
                start += int(bounds[-1])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int | None = END_ID, files: int | None = None,
                 stripe_bytes: int = STRIPE_BYTES, row_index_stride: int = ROW_INDEX_STRIDE,
                 bloom_fpp: float = BLOOM_FPP) -> None:
    """Encode every text and write ORC files under ``path`` (``files`` of them,
    by default the session's number of shuffle partitions)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("body"))
    # in the order of (doc_id, body): the text's beginning parts the rows of one id among files
    (rows.repartitionByRange(files or partitions(docs.sparkSession), "doc_id", F.substring("body", 1, RANGE_LETTERS))
     .sortWithinPartitions("doc_id", "body")
     .mapInArrow(lean(_encode_part(tokenizer_path, end_id)), _SCHEMA)
     .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", bloom_fpp)
     .option("orc.create.index", "true").option("orc.row.index.stride", row_index_stride)
     .option("orc.stripe.size", stripe_bytes).option("compression", "zstd").orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filter on ``doc_id`` for a pruned read."""
    return spark.read.schema(_SCHEMA).orc(path)


def _crc32(batches):
    for batch in batches:
        ids = batch.column(batch.num_columns - 1)
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        bounds = ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(crc, pa.int64())],
            names=["doc_id", "part", "pos", "start_in_part", "n_tokens", "ids_crc32"])


def digest(tokens: DataFrame) -> DataFrame:
    """Per document of ``read_tokens``: ``doc_id, start, n_tokens, ids_crc32, part, pos``.

    ``start`` counts the ids of all documents before it: the totals of the
    earlier files (one row per file) plus the writer's count inside the file."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row per file
    offsets = totals.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0).cast("long")).alias("before"))
    rows = tokens.mapInArrow(lean(_crc32), "doc_id long, part int, pos long, start_in_part long, n_tokens long, "
                                     "ids_crc32 long")
    return (rows.join(offsets, "part")
            .select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"),
                    "n_tokens", "ids_crc32", "part", "pos"))
