"""Toxic passages as maximal scoring segments.

Token scores are log-odds of toxic against other labelled texts with an informative
Dirichlet prior, counted by the texts that hold a word or a word's beginning, so that
one text full of a word proves little and inflected forms count together.  Tokens count
whose likelihood ratio chance reaches once in 10,000, however many rows are labelled.  A linear scan finds every maximal scoring segment of a text; an
extreme-value law, fitted on the texts that are not toxic, says how often chance
gives such segments in a text of that length, and the segments' evidence is summed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beckon.llm.common import bounded_sample, without

TOKEN = re.compile(r"\w+")
#: Most labelled rows that the model is fitted on.
FIT_ROWS = 20_000
#: Tokens in the model, those with the largest |z|, and the |z| that chance exceeds once in 10,000 (one side).
TOKENS, LEAST_Z = 20_000, 3.72
#: What a token without evidence costs a segment.
DRIFT = 0.25
#: Lengths of the word beginnings that count as tokens too, longest first.
STEMS = (6, 5, 4)
#: The prior: so much in proportion to a token's share of all, and so much for each.
PRIOR, FLOOR = 500.0, 0.5
RESULTS = ("score", "predicted", "passages")


@dataclass
class Model:
    """Token scores and the calibration of segment scores."""

    scores: dict[str, float] = field(default_factory=dict)  # a beginning ends in "*"
    rate: float = 1.0      # lambda of the extreme-value law
    scale: float = 0.1     # K of the extreme-value law
    centre: float = 1.0    # evidence at which the score is 1/2
    slope: float = 1.0

    def probability(self, evidence: float) -> float:
        x = self.slope * (evidence - self.centre)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last, score)`` in one pass.

    ``hits`` are the tokens with a score of their own, by place; those between cost
    ``drift`` each.  Each new positive token is a candidate, merged with an earlier
    one while that raises the score on both sides (Ruzzo and Tompa).
    """
    found: list[list] = []  # first, last, sum before, sum up to its end
    total, after = 0.0, 0
    for at, score in hits:
        total -= drift * (at - after)
        after = at + 1
        start, total = total, total + score
        if score <= 0:
            continue
        new = [at, at, start, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right in found]


def evidence(text: str | None, model: Model) -> tuple[float, list[tuple[int, int, float]], int]:
    """Summed evidence of a text's segments, the segments, and the number of tokens.

    With r segments the normalised scores are summed and ln r! is added (the law of
    sums of the r best); the best r counts.  0 without a segment.
    """
    words = TOKEN.findall(text.lower()) if text else []
    known = {w: s for w in set(words) if (s := _own_score(w, model.scores)) is not None}
    if not any(s > 0 for s in known.values()):
        return 0.0, [], len(words)
    hits = [(i, s) for i, s in enumerate(map(known.get, words)) if s is not None]
    found = segments(hits)
    chance = math.log(max(1.0, model.scale * len(words)))
    best = total = 0.0
    for r, score in enumerate(sorted((x[2] for x in found), reverse=True), 1):
        total += model.rate * score - chance + math.log(r)
        best = max(best, total)
    return best, found, len(words)


def tokens_of(text: str) -> set[str]:
    """A text's distinct words and, ending in ``*``, their beginnings."""
    words = set(TOKEN.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _own_score(word: str, scores: dict[str, float]) -> float | None:
    """Score of a word, else of its longest known beginning."""
    score = scores.get(word)
    for k in STEMS:
        if score is None and len(word) > k:
            score = scores.get(word[:k] + "*")
    return score


def log_odds(toxic: int, other: int, n_toxic: int, n_other: int) -> float:
    """Log-odds of a token, for its counts and those of all tokens."""
    prior = FLOOR + PRIOR * (toxic + other) / (n_toxic + n_other)
    one, two = toxic + prior, other + prior
    return math.log(one / (n_toxic + PRIOR - one)) - math.log(two / (n_other + PRIOR - two))


def significance(toxic: Column, other: Column, share: float) -> Column:
    """Signed root of a token's likelihood ratio against the toxic ``share`` of all tokens.

    About normal where chance alone deals the token out, also for few counts: the prior
    stays out of it, so tokens that only toxic texts hold show in small tables too.
    """
    n = (toxic + other).cast("double")
    parts = [F.when(x > 0, x * F.log(x / (n * F.lit(p)))).otherwise(0.0) for x, p in ((toxic, share), (other, 1 - share))]
    return F.signum(toxic - n * F.lit(share)) * F.sqrt(F.greatest(2 * (parts[0] + parts[1]), F.lit(0.0)))


def fit(labelled: DataFrame, rows: int = FIT_ROWS, tokens: int = TOKENS) -> Model:
    """A model from rows of ``text, toxic``; rows with a null label are left out.

    At most ``rows`` labelled rows are used, those with the smallest hash, and at
    most ``tokens`` tokens kept.  Without both classes the model finds nothing.
    """
    sample = bounded_sample(labelled.where("toxic IS NOT NULL").select("text", "toxic"),
                            rows, F.struct("text", "toxic")).repartition(16, F.xxhash64("text"))
    sample = sample.withColumn("text", F.coalesce("text", F.lit("")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                mine = both[1 if toxic == 1 else 0]
                for w in tokens_of(text):
                    mine[w] = mine.get(w, 0) + 1
        for toxic, mine in enumerate(both):
            yield pa.RecordBatch.from_arrays(
                [pa.array(mine.keys(), pa.string()), pa.array([toxic] * len(mine), pa.int32()),
                 pa.array(mine.values(), pa.int64())], ["token", "toxic", "n"])

    counts = (sample.mapInArrow(count, "token string, toxic int, n long").groupBy("token")
              .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
                   F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")))
    a, b = counts.agg(F.sum("a"), F.sum("b")).first()
    if not a or not b:
        return Model()
    z = F.round(significance(F.col("a"), F.col("b"), a / (a + b)), 9)
    top = counts.withColumn("z", z).where(F.abs("z") >= LEAST_Z).orderBy(
        F.desc(F.abs("z")), "token").limit(tokens).collect()
    model = Model({r.token: log_odds(r.a, r.b, a, b) - DRIFT for r in top})
    if not any(s > 0 for s in model.scores.values()):
        return model
    chances = {r.token: (r.b + FLOOR) / (b + PRIOR) for r in top}
    model.rate = _rate([(chances[t], s) for t, s in model.scores.items()])
    _calibrate(model, sample)
    return model


def _rate(scored: list[tuple[float, float]]) -> float:
    """Positive root of E[exp(rate * score)] = 1 under the texts that are not toxic."""
    rest = 1 - sum(p for p, _ in scored)
    value = lambda x: rest * math.exp(-x * DRIFT) + sum(p * math.exp(x * s) for p, s in scored) - 1
    low, high = 1e-3, 1e-3
    while value(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return max(low, 1e-3)


def _calibrate(model: Model, sample: DataFrame) -> None:
    """K from segments in texts that are not toxic; then the evidence that best parts the classes."""
    positive = sorted(s for s in model.scores.values() if s > 0)
    level = positive[len(positive) // 2]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                _, found, size = evidence(text, model)
                rows.append((size, int(toxic == 1), sorted(x[2] for x in found)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["n", "toxic", "found"])

    rows = sample.mapInArrow(scan, "n long, toxic int, found array<double>").collect()  # FIT_ROWS at most
    clean = [r for r in rows if not r.toxic]
    many = sum(s >= level for r in clean for s in r.found) + 0.5
    model.scale = many / (max(1, sum(r.n for r in clean)) * math.exp(-model.rate * level))

    def total(r) -> float:
        chance, best, run = math.log(max(1.0, model.scale * r.n)), 0.0, 0.0
        for k, s in enumerate(reversed(r.found), 1):
            run += model.rate * s - chance + math.log(k)
            best = max(best, run)
        return best

    points = sorted((total(r), r.toxic) for r in rows)
    wrong = best = sum(1 - t for _, t in points)  # all called toxic
    model.centre = points[0][0] - 1.0
    for i, (x, toxic) in enumerate(points):
        wrong += 1 if toxic else -1
        if (i + 1 == len(points) or points[i + 1][0] > x) and wrong <= best:
            best, model.centre = wrong, (x + (points[i + 1][0] if i + 1 < len(points) else x + 2)) / 2


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """All documents with ``score`` (0 to 1), ``predicted`` (0/1) and ``passages``.

    ``passages`` are the segments that chance gives less than once in 20 texts of the
    length: first and last token, score and expected number.  Null and empty texts
    have none and get the score of no evidence.  Repeated rows get the same result;
    input columns named like a result are replaced.
    """
    df = without(docs, RESULTS)
    passage = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()),
                            T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType()),
                           T.StructField("passages", T.ArrayType(passage))])
    arrow = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()),
                                ("score", pa.float64()), ("expected", pa.float64())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, passages = [], []
            for x in batch["text"]:
                text = x.as_py()
                total, found, size = evidence(text, model)
                scores.append(model.probability(total))
                kept = []
                for first, last, s in found:
                    expected = model.scale * size * math.exp(-model.rate * s)
                    if expected < 0.05:
                        kept.append({"first": first, "last": last, "score": s, "expected": expected})
                passages.append(kept)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()),
                 pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, arrow)],
                [*batch.schema.names, "score", "predicted", "passages"])

    return df.mapInArrow(label, schema)
