"""Words one letter apart, by bitsets over positions and letters, and their root forms.

Two words are near if one letter inserted, deleted or replaced turns one into the other.
Cut a word of ``size`` letters into three pieces: one edit leaves two of them as they
are.  So words are put into blocks by what is left of them without one piece (counted
from both ends, so that a word of one letter more meets them), and the letters that a
block agrees on are left out of the search.  Over the rest of a block's words an index
holds a bitset per (position, letter); a word walks through its letters and carries the
sets of all words that agree so far without an error, with one replaced, one inserted
and one deleted letter at once.  Blocks with too many words are cut further, to pieces of
one letter, after which the alphabet bounds them; nothing is ever compared pair by pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import parts_for, stored

#: Words of a block beyond which it is cut to pieces of one letter.
BLOCK = 4096
#: Entries of words in blocks that one call searches, distinct words counted at once in a task.
ENTRIES, COUNTED = 60_000, 200_000
RESULTS = ("word", "form", "root", "n", "n_near", "form_n")

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def damaged(run: str, seed: int, every: int | None) -> str:
    """The run without one letter, if ``every`` divides its checksum, which goes on from ``seed``."""
    if every:
        code = zlib.crc32(run.encode(), seed)
        if code % every == 0:
            at = code % len(run)
            return run[:at] + run[at + 1:]
    return run


def count_words(docs: DataFrame, letters: int = 7, every: int | None = None, least: int = 2) -> DataFrame:
    """``word, n``: words of ``letters`` letters or more that occur ``least`` times or more.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF of the whole text, with A-Z
    lower-cased.  With ``every``, a run loses the letter at ``h % length`` where ``every``
    divides ``h``, the unsigned CRC-32 of ``<doc_id>:<run>``; a null id counts as empty.
    """
    # A longer run is found whole, a shorter one can't give a word.
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{letters},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for name, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                seed = zlib.crc32(f"{name}:".encode())
                for run, n in Counter(runs.findall(text)).items():
                    word = damaged(run if run.islower() else run.translate(_LOWER), seed, every)
                    if len(word) >= letters:
                        found[word] += n
                if len(found) >= COUNTED:
                    yield _counts(found)
                    found = Counter()
        if found:
            yield _counts(found)

    named = docs.where("text IS NOT NULL").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return (named.mapInArrow(count, "word string, n long").groupBy("word")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def _counts(found: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])


class PositionIndex:
    """Bitsets over some words: which have a letter at a position, which have a length.

    Bit k stands for the k-th word.
    """

    def __init__(self, words: list[str]):
        self.all = (1 << len(words)) - 1
        self.letters: dict[tuple[int, str], int] = defaultdict(int)
        self.lengths: dict[int, int] = defaultdict(int)
        for k, word in enumerate(words):
            bit = 1 << k
            self.lengths[len(word)] |= bit
            for at, letter in enumerate(word):
                self.letters[at, letter] |= bit

    def near(self, word: str) -> tuple[int, int, int, int, int]:
        """Words by one replaced letter, one letter more, one less; words that begin with
        all of ``word``, and with all of it but the last letter."""
        letters = self.letters
        same, before = self.all, self.all
        replaced = longer = shorter = 0
        for at, letter in enumerate(word):
            here, ahead = letters.get((at, letter), 0), letters.get((at + 1, letter), 0)
            behind = letters.get((at - 1, letter), 0)
            longer = (longer | same) & ahead
            shorter = shorter & behind | same
            replaced = replaced & here | same & ~here
            before, same = same, same & here
        n, lengths = len(word), self.lengths
        return (replaced & lengths.get(n, 0), (longer | same) & lengths.get(n + 1, 0),
                shorter & lengths.get(n - 1, 0), same, before)


def near_in_block(words: list[str], size: int, first: int, end: int) -> list[int]:
    """Bitset of near words for each word of a block.

    The words have ``size`` letters or one more, and agree on the first ``first`` and on
    the last ``size - end``.  Two longer words meet in another block.  A pair that agrees
    in several ways is left to the block with the last free piece, so it counts once.
    """
    free = [w[first:len(w) - size + end] for w in words]
    index, width = PositionIndex(free), end - first
    found = []
    for rest in free:
        replaced, longer, shorter, same, before = index.near(rest)
        if len(rest) == width:
            found.append(replaced | (longer & ~same if end < size else longer))
        else:
            found.append(shorter & ~before if end < size else shorter)
    return found


def _key(word: Column, size: Column, first: Column, end: Column) -> Column:
    return F.xxhash64(size, first, end, F.substring(word, F.lit(1), first),
                      F.substring(word, F.length(word) - size + end + 1, size - end))


def _entries(words: DataFrame) -> DataFrame:
    """A row per word, size and free piece: ``word, n, size, first, end, key``."""
    sized = words.withColumn("size", F.explode(F.array(F.length("word"), F.length("word") - 1))).where("size > 0")
    third = "int((size + 1) div 3)"
    bounds = [("0", third), (third, f"size - {third}"), (f"size - {third}", "size")]
    pieces = F.array(*[F.struct(F.expr(a).cast("int").alias("first"), F.expr(b).cast("int").alias("end"))
                       for a, b in bounds])
    free = sized.withColumn("piece", F.explode(pieces)).select(
        "word", "n", "size", "piece.first", "piece.end").where("first < size")  # not the empty piece of one letter
    return free.withColumn("key", _key(*map(F.col, ("word", "size", "first", "end"))))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` for the words of ``word, n`` that have near ones.

    ``best`` is the near word of largest ``n``, of equal ones the first in code-point order.
    """
    entries = _entries(words)
    sizes = stored(entries.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "spelling-blocks")
    of = sizes.select(F.col("key").alias("of"), "many")
    met = entries.join(of, F.col("key") == F.col("of")).drop("of")
    if sizes.where(F.col("many") > BLOCK).isEmpty():
        met = met.select("word", "n", "size", "first", "end", "key")
    else:
        # Of a large block's free piece, each letter in turn is left free alone.
        met = met.withColumn("letter", F.explode(F.when(
            F.col("many") <= BLOCK, F.array(F.lit(-1))).otherwise(F.expr("sequence(first, end - 1)"))))
        alone = F.col("letter") >= 0
        met = met.select(
            "word", "n", "size", F.when(alone, F.col("letter")).otherwise(F.col("first")).alias("first"),
            F.when(alone, F.col("letter") + 1).otherwise(F.col("end")).alias("end"), F.col("key").alias("whole"))
        met = met.withColumn("key", _key(*map(F.col, ("word", "size", "first", "end")))).drop("whole")
    total = sizes.agg(F.sum("many")).first()[0] or 0
    buckets = parts_for(total, ENTRIES)

    def search(table: pa.Table) -> pa.Table:
        columns = [table[c].to_pylist() for c in ("word", "n", "size", "first", "end")]
        blocks = defaultdict(list)
        for word, n, size, first, end in zip(*columns):
            # The letters themselves, so that equal hashes mix nothing up.
            blocks[size, first, end, word[:first], word[len(word) - size + end:]].append((-n, word))
        out = []
        for (size, first, end, _, _), block in blocks.items():
            if len(block) > 1:
                block.sort()  # the best word has the lowest bit
                for (_, word), near in zip(block, near_in_block([w for _, w in block], size, first, end)):
                    if near:
                        best = block[(near & -near).bit_length() - 1]
                        out.append((word, near.bit_count(), best[0], best[1]))
        return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(
            (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "rank", "best"])

    found = (met.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "word", "n", "size", "first", "end")
             .groupBy("bucket").applyInArrow(search, "word string, n_near long, rank long, best string"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("rank", "best")).alias("top"))
            .select("word", "n_near", (-F.col("top.rank")).alias("best_n"), F.col("top.best").alias("best")))


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """All words of ``word, n`` (distinct) with ``form, root, n_near, form_n``.

    A word's form is its best near word, if that is ``times`` as frequent at least; the
    root is where forms lead to, the word itself where it has none.  Null and empty words
    go; other columns are ignored; an empty table gives no rows.  Runs jobs at once.
    """
    words = stored(words.where("word <> ''").select("word", "n"), "spelling-words")
    near = near_words(words).withColumnRenamed("word", "of")
    forms = words.join(near, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(F.col("best_n") >= times * F.col("n"), F.col(c)).alias(a)
          for c, a in (("best", "form"), ("best_n", "form_n"))])
    forms = stored(forms, "spelling-forms")
    # Forms grow in frequency, so there is no circle and steps double until none is left.
    ways = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = ways.select(F.col("word").alias("by"), F.col("root").alias("to"))
        ways = stored(ways.join(on, F.col("root") == F.col("by"), "left").select(
            "word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "spelling-ways")
        if ways.where("moved").isEmpty():
            break
        ways = ways.drop("moved")
    ends = ways.select(F.col("word").alias("of"), "root")
    return forms.join(ends, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
