"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent character n-grams.  A
document's most frequent n-grams are ranked the same way and compared with each
profile by out-of-place distance; the nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beckon.llm.common import bounded_sample_each, without

#: Fixed parameters: longest n-gram and n-grams in a profile.
LONGEST, PROFILE = 3, 300
#: Most rows that a language's profile is learned from.
FIT_ROWS = 4000
#: Characters that are counted at once, which bounds a task's memory for very long texts.
CHUNK = 1 << 20
RESULTS = ("lang_pred", "score")


def letters(text: str) -> np.ndarray:
    """Code points of a lower-cased text; whatever is no letter is a blank, runs squeezed.

    One blank stands before and one after each word.  Empty without a letter.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = points > 127
    keep = ((points >= 97) & (points <= 122))
    if wide.any():
        found, back = np.unique(points[wide], return_inverse=True)
        keep[wide] = np.array([chr(p).isalpha() for p in found])[back]
    if not keep.any():
        return np.empty(0, np.int64)
    points = np.where(keep, points, 32).astype(np.int64)
    use = keep.copy()
    use[1:] |= keep[:-1]  # one blank after each word
    points = points[use]
    return np.pad(points, (1, int(points[-1] != 32)), constant_values=32)


def ngram_counts(text: str, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's n-grams of 1 to ``longest`` characters.

    A code holds 21 bits a character.  Blanks alone are no n-gram.
    """
    points = letters(text)
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for start in range(0, len(points), CHUNK):
        part = points[start:start + CHUNK + longest - 1]
        found, grams = [], part
        for n in range(1, longest + 1):
            if n > 1:
                if len(part) < n:
                    break
                grams = (grams[:len(part) - n + 1] << 21) | part[n - 1:]
            own = grams[:CHUNK]
            found.append(own[own != 32] if n == 1 else own)
        new, times = np.unique(np.concatenate(found), return_counts=True)
        if start:
            both = np.concatenate((codes, new))
            codes, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, np.concatenate((counts, times))).astype(np.int64)
        else:
            codes, counts = new, times
    return codes, counts


def ranking(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, most frequent first, ties to the smaller code."""
    if len(codes) > 4 * size:  # a full sort is not needed
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    """Rank of each n-gram in each language's profile."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.codes = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in self.langs])
                               if profiles else np.empty(0, np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, x in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, profiles[x])] = np.arange(len(profiles[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language and 1 - distance / largest distance; ``und`` and 0 without a letter."""
        if not text or not self.langs:
            return "und", 0.0
        codes, counts = ngram_counts(text)
        if not len(codes):
            return "und", 0.0
        own = ranking(codes, counts)
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = -1
        there = self.ranks[:, at]
        out = np.where(there < 0, PROFILE, np.abs(there - np.arange(len(own)))).sum(1)
        best = int(out.argmin())
        return self.langs[best], float(1 - out[best] / (PROFILE * len(own)))


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Profiles:
    """Profiles from rows of ``text, lang``; rows with a null in either are left out.

    At most ``rows`` rows a language are used, those with the smallest hash of text and language,
    so equal inputs give equal profiles.  Counts are taken where the rows are; what
    reaches the driver is ``PROFILE`` n-grams a language.
    """
    sample = bounded_sample_each(
        labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang"),
        rows, F.struct("text", "lang"), "lang").repartition(8, "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                codes, counts = ngram_counts(text)
                mine = total.setdefault(lang, {})
                for c, n in zip(codes.tolist(), counts.tolist()):
                    mine[c] = mine.get(c, 0) + n
        for lang, mine in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(mine)), pa.array(mine.keys(), pa.int64()),
                 pa.array(mine.values(), pa.int64())], ["lang", "code", "n"])

    counts = (sample.mapInArrow(count, "lang string, code long, n long")
              .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    top = counts.selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY n DESC, code) AS place")
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.where(F.col("place") <= PROFILE).collect(), key=lambda r: (r.lang, r.place)):
        profiles.setdefault(r.lang, []).append(r.code)
    return Profiles(profiles)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """All documents with ``lang_pred`` and ``score`` (0 to 1).

    Whole texts are read.  A null text or one without a letter is ``und`` with score
    0; ties go to the first language by name.  Repeated rows get the same result, and
    input columns named like a result are replaced.
    """
    df = without(docs, RESULTS)
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(x.as_py()) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()),
                 pa.array([s for _, s in found], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"])

    return df.mapInArrow(label, schema)


def with_letter(docs: DataFrame) -> DataFrame:
    """Documents whose text has a letter, those that ``identify`` can give a language."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(len(letters(x.as_py() or ""))) for x in batch["text"]], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
