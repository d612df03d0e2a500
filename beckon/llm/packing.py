"""Best-fit decreasing packing of token sequences.

Documents are tokenized where they are.  What decides the packing is how many
pieces there are of each length: at most ``seq_len`` numbers, whatever the corpus.
Best-fit decreasing runs over them with runs of equal bins in place of single bins
and a segment tree over remaining capacities, which finds the tightest open bin in
logarithmic time.  It gives ranges of ranks per length; each piece finds its place
from its rank among the pieces of its length.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from beckon.llm.common import parts_for, stored

#: The tokenizer's words that a worker keeps.
CACHE_WORDS = 400_000
#: Pieces that are ranked in one task.
RANK_ROWS = 200_000
END_ID = 1
RESULTS = ("doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")


#: Printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 bytes stand
#: for themselves, the others for the characters from 256 on.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: chr(b) for b in _PLAIN} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_PROBES = ["Straße", "ÉTÉ", "tokenization", "ab", "ñandú"]


class WordTokenizer(dict):
    """Token ids of texts as little-endian unsigned 32-bit numbers, by cached words.

    For tokenizers whose tokens never hold white space and whose normaliser looks at
    no neighbour across it, a text's ids are those of its words, one after another.
    A word of letters with a final full stop or comma is those of both parts.  Words of
    Latin letters go straight to the vocabulary's model, lower-cased, where probes show
    that this is what the whole tokenizer does.  The dict maps words to ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.direct = [self._letters(w) for w in _PROBES] == [self._ids(w) for w in _PROBES]

    def _ids(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _letters(self, word: str) -> bytes | None:
        """Ids of a word of Latin letters; None for other words."""
        low = (word if word.isascii() else unicodedata.normalize("NFC", word)).lower()
        if not low.isalpha() or max(low) > "\u024f":
            return None
        if not low.isascii():
            low = "".join(map(_BYTES.__getitem__, low.encode()))
        ids = [t.id for t in self.model.tokenize(low)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if text[-1] in ".," and text[:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            low = word.lower()
            if self.direct and low != word and text.isascii() and text.isalpha():
                ids = self[low]
            else:
                ids = (self._letters(text) if self.direct else None) or self._ids(text)
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Bytes are split at ASCII white space alone; other kinds are for the tokenizer to drop."""
        if len(self) > CACHE_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.encode().split()))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a process, so that a worker's tasks share its words."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenized_pieces(docs: DataFrame, path: str, seq_len: int, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): each text's ids, then ``END_ID``, cut."""
    fields = [*docs.select("doc_id").schema.fields, T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    end = struct.pack("<I", END_ID)
    step = 4 * seq_len

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from beckon.llm.packing import worker_tokenizer  # the module's, which outlives the task

        tokenizer = worker_tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[list] = [[] for _ in fields]
                texts = [x or "" for x in part["text"].to_pylist()]
                for doc, text in zip(part["doc_id"].to_pylist(), texts):
                    ids = tokenizer.encode(text) + end
                    for k, i in enumerate(range(0, len(ids), step)):
                        own = ids[i:i + step]
                        for column, value in zip(rows, (doc, k, i // 4, len(own) // 4, zlib.crc32(own), own)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, types)], [f.name for f in fields])

    types = [to_arrow_type(f.dataType) for f in fields]
    return docs.select("doc_id", "text").mapInArrow(cut, T.StructType(fields))


class Capacities:
    """Segment tree over remaining capacities; a leaf is set where an open bin has it."""

    def __init__(self, largest: int):
        self.leaves = 1 << largest.bit_length()
        self.set = bytearray(2 * self.leaves)

    def put(self, capacity: int, there: bool) -> None:
        i = capacity + self.leaves
        self.set[i] = there
        while i > 1:
            i //= 2
            self.set[i] = self.set[2 * i] | self.set[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """Smallest capacity of ``length`` or more that an open bin has."""
        i = length + self.leaves
        while not self.set[i]:
            while i & 1:  # a right child: nothing further right below its parent
                i //= 2
            if i == 0:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.set[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_plan(counts: dict[int, int], seq_len: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for ``counts`` pieces of each length.

    Rows ``(length, rank, pieces, per_bin, bin, offset)``: pieces of that length with
    ranks from ``rank`` on fill bins from ``bin`` on, ``per_bin`` in each from
    ``offset``.  The tightest bin of capacity c takes c // length equal pieces in a
    row, since with one more piece it is tighter still; so bins with equal contents
    are handled together and the result is that of placing single pieces.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # capacity -> (first bin, bins)
    tree = Capacities(seq_len)
    plan, bins = [], 0

    def add(capacity: int, first: int, many: int) -> None:
        if capacity and many:
            runs.setdefault(capacity, []).append((first, many))
            tree.put(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                many = -(-left // (seq_len // length))
                add(seq_len, bins, many)
                bins += many
                continue
            first, many = runs[capacity].pop()
            if not runs[capacity]:
                tree.put(capacity, False)
            per = capacity // length
            for per, use in ((per, min(many, left // per)), (left % per, 1)):
                if use and per and many and left >= per * use:
                    plan.append((length, rank, per * use, per, first, seq_len - capacity))
                    rank, left = rank + per * use, left - per * use
                    add(capacity - per * length, first, use)
                    first, many = first + use, many - use
            add(capacity, first, many)
    return plan


def pack(docs: DataFrame, path: str, seq_len: int = 4096, with_ids: bool = False) -> DataFrame:
    """``RESULTS``: every piece of every document with its sequence and place.

    A null or empty text is one piece that holds ``END_ID`` alone; longer documents
    than ``seq_len`` are cut, nothing else is.  Repeated rows are packed as often as
    they occur; ids may be null.  Other input columns are not read.  With ``with_ids``
    the pieces' ids come along, as little-endian unsigned 32-bit numbers.  Pieces are
    written once to the shared folder, so texts are tokenized once.
    """
    pieces = stored(tokenized_pieces(docs, path, seq_len, with_ids), "pieces")
    counts = dict(pieces.groupBy("length").count().collect())  # at most seq_len rows
    plan = best_fit_plan(counts, seq_len)
    spark = docs.sparkSession
    # Rank of a piece among those of its length: hashed parts of bounded size, then offsets.
    parts = parts_for(sum(counts.values()), RANK_ROWS)
    order = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    keyed = pieces.withColumn("__order", order).withColumn("__part", F.pmod("__order", F.lit(parts)))
    before = keyed.groupBy("length", "__part").count().selectExpr(
        "length AS __length", "__part AS __of",
        "sum(count) OVER (PARTITION BY length ORDER BY __part) - count AS __before")
    ranked = keyed.withColumn("__row", F.expr(
        "row_number() OVER (PARTITION BY length, __part ORDER BY __order, doc_id, piece)"))
    if parts > 1:
        ranked = ranked.join(before, (F.col("length") == F.col("__length")) & (
            F.col("__part") == F.col("__of"))).drop("__length", "__of")
    else:
        ranked = ranked.withColumn("__before", F.lit(0))
    rows: dict[int, list[tuple]] = {}
    for length, *rest in plan:
        rows.setdefault(length, []).append(tuple(rest))
    schema = ("__length long, __runs array<struct<rank: long, pieces: long, per: long, bin: long, start: long>>")
    table = spark.createDataFrame(list(rows.items()), schema)
    placed = (
        ranked.withColumn("__rank", F.col("__before") + F.col("__row") - 1)
        # One row a length: the size is bounded by seq_len, not by the corpus.
        .join(F.broadcast(table), F.col("length") == F.col("__length"))
        .withColumn("__run", F.expr(
            "element_at(filter(__runs, r -> __rank >= r.rank AND __rank < r.rank + r.pieces), 1)"))
        .withColumn("__nth", F.expr("__rank - __run.rank"))
        .withColumn("sequence_id", F.expr("__run.bin + __nth DIV __run.per"))
        .withColumn("offset", F.expr("__run.start + (__nth % __run.per) * length")))
    return placed.select([c for c in RESULTS if c in placed.columns])
