"""Removal of repeated byte strings by content-defined phrases of the corpus.

A rolling hash over ``GRAM`` bytes triggers phrases: every ``length``-byte window
belongs to the (leftmost) smallest hash in it, and neighbouring windows with the same
trigger are one phrase, their bytes together.  Equal windows have equal triggers at
equal places, so only phrases with equal triggers need comparing.  The dictionary
holds distinct phrases with their counts.  A phrase that occurs twice is repeated as a
whole.  For others the dictionary's suffixes, cut at ``length`` bytes, are classed by
fingerprint: classes of two or more are repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import parts_for, stored, without

LENGTH, GRAM = 200, 32
#: Bytes hashed at once; bytes of texts of which phrases are counted together; entries of a bucket.
CHUNK, BATCH, ENTRIES = 1 << 18, 8 << 20, 500_000
#: Phrases of a trigger that meet in one call.
PHRASES = 5000
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")

_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)
_POWERS: dict[str, np.ndarray] = {}
_PLACE = np.uint64((1 << 24) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n at least."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashed:
    """Bytes with polynomial sums, for the hash of any part."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(max(len(data) + 1, 2 * CHUNK))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[:len(data)], out=self.sums[1:])

    def part(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.down[start])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by prefix and suffix minima of blocks."""
    n = len(keys)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = keys
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of ``(text, offset, bytes)`` of about ``CHUNK``; long texts overlap by a window."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK):
            part = text[at:at + CHUNK + length - 1]
            if len(part) >= length:
                if size + len(part) > 2 * CHUNK and group:
                    yield group
                    group, size = [], 0
                group.append((i, at, part))
                size += len(part)
    if group:
        yield group


def phrases(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Arrays ``text, start, windows, trigger, phrase`` of all phrases of the texts."""
    found: list[list[np.ndarray]] = [[] for _ in range(5)]
    for group in _pieces(texts, length):
        sizes = np.array([len(p) for _, _, p in group])
        data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        hashed = Hashed(data)
        grams = hashed.part(np.arange(len(data) - GRAM + 1), GRAM)
        # Hash above, place below: the minimum tells the leftmost place.
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        triggers = (_least(keys, length - GRAM + 1) & _PLACE).astype(np.int64)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(group)), sizes)[:len(triggers)]
        inside = np.arange(len(triggers)) + length <= ends[owner]
        new = np.ones(len(triggers), bool)
        new[1:] = (triggers[1:] != triggers[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(new & inside)
        places = np.flatnonzero(inside)
        runs = np.diff(np.append(np.searchsorted(places, starts), len(places)))
        trigger = triggers[starts]
        whole = hashed.part(starts, runs + (length - 1))
        whole = _mix(whole ^ _mix(runs.astype(np.uint64) * np.uint64(1 << 20) + (trigger - starts).astype(np.uint64)))
        first = ends - sizes
        columns = (np.array([i for i, _, _ in group])[owner[starts]],
                   starts - first[owner[starts]] + np.array([at for _, at, _ in group])[owner[starts]],
                   runs, grams[trigger].view(np.int64), whole.view(np.int64))
        for out, column in zip(found, columns):
            out.append(column)
    return [np.concatenate(c) if c else np.empty(0, np.int64) for c in found]


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts with their ids, in groups of about ``BATCH`` bytes."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for c, text in zip(batch["c"].to_pylist(), batch["text"]):
            data = text.as_py().encode()
            ids.append(c)
            texts.append(data)
            size += len(data)
            if size > BATCH:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def repeated_phrases(texts: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """``c, start, windows, trigger, phrase, whole`` of phrases whose trigger occurs again.

    ``texts`` has ``c, text``.  Entries go packed to buckets of triggers.  Where a
    group of texts holds a trigger several times, its phrases are known to be
    repeated; they need no bucket, and one entry for each phrase that the group holds
    twice, or for the trigger, tells the others.  So a bucket gets few entries a
    trigger and group, however frequent it is.
    """
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in _batched(batches):
            text, start, many, trigger, phrase = phrases(data, length)
            if not len(text):
                continue
            c = np.array(ids, np.int64)[text]
            turn = np.lexsort((phrase, trigger))
            c, start, many, trigger, phrase = (x[turn] for x in (c, start, many, trigger, phrase))
            new_t = np.concatenate(([True], trigger[1:] != trigger[:-1]))
            new_p = new_t | np.concatenate(([True], phrase[1:] != phrase[:-1]))
            in_t = np.bincount(np.cumsum(new_t) - 1)[np.cumsum(new_t) - 1]
            in_p = np.bincount(np.cumsum(new_p) - 1)[np.cumsum(new_p) - 1]
            # 0: alone, 1: its trigger is here again, 2: it is here again itself.
            kind = np.where(in_p > 1, 2, np.where(in_t > 1, 1, 0))
            send = (kind == 0) | ((kind == 2) & new_p) | ((kind == 1) & new_t)
            entries = np.stack((trigger, phrase, c, start, many, kind))
            place = (trigger.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            rows, blobs, done = [], [], []
            turn = np.flatnonzero(send)[np.argsort(place[send], kind="stable")]
            cuts = np.searchsorted(place[turn], np.arange(buckets + 1))
            for b in range(buckets):
                if cuts[b] < cuts[b + 1]:
                    rows.append(b)
                    blobs.append(entries[:, turn[cuts[b]:cuts[b + 1]]].tobytes())
                    done.append(False)
            if (kind > 0).any():
                rows.append(int(ids[0] % buckets))
                blobs.append(entries[:, kind > 0].tobytes())
                done.append(True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array(done), pa.array(blobs, pa.binary())],
                ["bucket", "done", "entries"])

    names = ["c", "start", "windows", "trigger", "phrase", "whole"]

    def meet(bucket: pa.Table) -> pa.Table:
        parts: tuple[list, list] = ([], [])
        for done, blob in zip(bucket["done"].to_pylist(), bucket["entries"]):
            parts[done].append(np.frombuffer(blob.as_py(), np.int64).reshape(6, -1))
        out = []
        if parts[0]:
            trigger, phrase, c, start, many, kind = np.concatenate(parts[0], axis=1)
            turn = np.lexsort((phrase, trigger))
            trigger, phrase, c, start, many, kind = (x[turn] for x in (trigger, phrase, c, start, many, kind))
            new_t = np.concatenate(([True], trigger[1:] != trigger[:-1]))
            new_p = new_t | np.concatenate(([True], phrase[1:] != phrase[:-1]))
            # An entry for the trigger alone says nothing about its own phrase's count.
            in_t = np.bincount(np.cumsum(new_t) - 1, 1 + kind)[np.cumsum(new_t) - 1]
            in_p = np.bincount(np.cumsum(new_p) - 1, 1 + (kind == 2))[np.cumsum(new_p) - 1]
            keep = (kind == 0) & (in_t > 1)
            out.append([x[keep] for x in (c, start, many, trigger, phrase)] + [in_p[keep] > 1])
        for trigger, phrase, c, start, many, kind in parts[1]:
            out.append([c, start, many, trigger, phrase, kind == 2])
        return pa.table([pa.array(np.concatenate([o[i] for o in out])) if out else pa.array([], t)
                         for i, t in enumerate([pa.int64()] * 5 + [pa.bool_()])], names)

    return (texts.mapInArrow(deal, "bucket int, done boolean, entries binary").groupBy("bucket")
            .applyInArrow(meet, "c long, start long, windows long, trigger long, phrase long, whole boolean"))


def _window_hashes(parts: list[bytes], length: int) -> np.ndarray:
    """Fingerprints of all windows of all parts, in order; about ``CHUNK`` bytes are hashed at once."""
    sizes = np.array([len(p) for p in parts])
    found = []
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(parts))):
        hashed = Hashed(np.frombuffer(b"".join(parts[a:b]), np.uint8))
        many = sizes[a:b] - (length - 1)
        # A window starts as many bytes late as the parts before it have bytes without a window.
        start = np.arange(many.sum()) + np.repeat(np.arange(b - a) * (length - 1), many)
        found.append(hashed.part(start, length).view(np.int64))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _repeated_windows(texts: DataFrame, length: int) -> DataFrame:
    """``trigger, phrase, offsets``: which windows of dictionary phrases are in two or more of them.

    ``texts`` has ``text`` and ``reps``, the dictionary phrases that it stands for.
    Phrases of a trigger meet in a bucket of triggers; what has so many phrases that a
    call would not be bounded meets window by window instead.
    """
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            for text, reps in zip(batch["text"], batch["reps"]):
                data = text.as_py().encode()
                for r in reps.as_py() or []:
                    rows[0].append(r["trigger"])
                    rows[1].append(r["phrase"])
                    rows[2].append(data[r["start"]:r["start"] + r["windows"] + length - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())],
                ["trigger", "phrase", "bytes"])

    def prints(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, phrase number and offset of every window of every phrase."""
        many = np.array([len(p) for p in parts]) - (length - 1)
        own = np.repeat(np.arange(len(parts)), many)
        offset = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        return _window_hashes(parts, length), own, offset

    def meet(bucket: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], []]
        trigger, phrase = bucket["trigger"].to_numpy(), bucket["phrase"].to_numpy()
        window, own, offset = prints([x.as_py() for x in bucket["bytes"]])
        turn = np.argsort(window, kind="stable")
        same = window[turn][1:] == window[turn][:-1]
        again = np.zeros(len(window), bool)
        again[turn[1:]] |= same
        again[turn[:-1]] |= same
        own, offset = own[again], offset[again]
        cuts = np.searchsorted(own, np.arange(len(phrase) + 1))
        for i in np.unique(own):
            for column, value in zip(rows, (trigger[i], phrase[i], offset[cuts[i]:cuts[i + 1]].astype(np.int32))):
                column.append(value)
        return pa.table([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()),
                         pa.array(rows[2], pa.list_(pa.int32()))], ["trigger", "phrase", "offsets"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                window, own, offset = prints([x.as_py() for x in part["bytes"]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window), *[pa.array(part[c].to_numpy()[own]) for c in ("trigger", "phrase")],
                     pa.array(offset.astype(np.int32))], ["window", "trigger", "phrase", "offset"])

    spelled = stored(texts.where("size(reps) > 0").select("text", "reps").mapInArrow(
        spell, "trigger long, phrase long, bytes binary"), "substring-spelled")
    large = stored(spelled.groupBy(F.col("trigger").alias("large")).count().where(
        F.col("count") > PHRASES).select("large"), "substring-large")
    buckets = parts_for(spelled.count(), 4 * PHRASES)
    small = (spelled.join(large, F.col("trigger") == F.col("large"), "left_anti")
             .groupBy(F.pmod("trigger", F.lit(buckets)).alias("bucket"))
             .applyInArrow(meet, "trigger long, phrase long, offsets array<int>"))
    rows = spelled.join(large, F.col("trigger") == F.col("large"), "left_semi").mapInArrow(
        spread, "window long, trigger long, phrase long, offset int")
    # A window is in a phrase once, so least and greatest phrase tell whether it is in several.
    again = rows.groupBy("window").agg(F.min("phrase").alias("x"), F.max("phrase").alias("y")).where("x <> y")
    return small.union(rows.join(again.select("window"), "window").groupBy("trigger", "phrase").agg(
        F.sort_array(F.collect_list("offset")).alias("offsets")))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All documents with ``n_bytes, n_removed, n_spans, kept_sha256`` and ``spans``.

    Removed is every byte that a ``length``-byte string covers which also starts
    anywhere else, in the same or another document, equal texts included; matches do
    not cross documents and are judged on the input.  ``spans`` are the maximal
    removed runs (first byte, bytes).  A null text is empty.  Texts are known by
    64-bit hashes, as are windows.  Repeated rows are documents like others; input
    columns named like a result are replaced.  Runs jobs at once; texts are moved once,
    and those with repeats once more.
    """
    docs = without(docs, RESULTS)
    text = F.coalesce(F.col("text"), F.lit(""))
    coded = docs.select(F.xxhash64(text).alias("c"), text.alias("text"))
    total = coded.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = parts_for(2 * total // (length - GRAM), ENTRIES)
    found = stored(repeated_phrases(coded, buckets, length), "substring-phrases")
    book = found.groupBy("trigger", "phrase").agg(
        ((F.count("*") > 1) | F.max("whole")).alias("all"), F.min(F.struct("c", "start", "windows")).alias("rep"))
    book = stored(book, "substring-dictionary")
    # Only where a trigger has a phrase that occurs once do its phrases' windows matter.
    open_ = book.where("NOT all").select("trigger").distinct()
    reps = (book.join(open_, "trigger").groupBy(F.col("rep.c").alias("c"))
            .agg(F.collect_list(F.struct("rep.start", "rep.windows", "trigger", "phrase")).alias("reps")))
    held = stored(found.select("c").distinct().join(reps, "c", "left"), "substring-texts")
    affected = stored(coded.join(held.withColumnRenamed("c", "of"), F.col("c") == F.col("of")).drop("of")
                      .dropDuplicates(["c"]), "substring-affected")
    offsets = stored(_repeated_windows(affected, length), "substring-offsets")
    marks = (found.join(book.where("all").select("trigger", "phrase"), ["trigger", "phrase"])
             .select("c", "start", "windows", F.lit(None).cast("array<int>").alias("offsets")))
    some = (found.join(book.where("NOT all").select("trigger", "phrase"), ["trigger", "phrase"], "left_semi")
            .join(offsets, ["trigger", "phrase"]).select("c", "start", "windows", "offsets"))
    spans = marks.union(some).distinct().groupBy("c").agg(
        F.collect_list(F.struct("start", "windows", "offsets")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for c, text, marks in zip(batch["c"].to_pylist(), batch["text"], batch["marks"]):
                data = text.as_py().encode()
                change = np.zeros(len(data) + 1, np.int64)
                for m in marks.as_py():
                    if m["offsets"] is None:
                        change[m["start"]] += 1
                        change[m["start"] + m["windows"] + length - 1] -= 1
                    else:
                        at = m["start"] + np.array(m["offsets"])
                        np.add.at(change, at, 1)
                        np.add.at(change, at + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                runs = [{"start": int(a), "bytes": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]
                for column, value in zip(rows, (c, int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            run = pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), run, pa.string()))],
                ["c", "removed", "spans", "sha"])

    cuts = stored(affected.select("c", "text").join(spans, "c").mapInArrow(
        cut, "c long, removed long, spans array<struct<start: long, bytes: long>>, sha string"), "substring-cuts")
    # Digests of whole texts come before the join, so that it moves texts only if they are asked for.
    docs = (docs.withColumn("__c", F.xxhash64(text)).withColumn("n_bytes", F.octet_length(text).cast("long"))
            .withColumn("__sha", F.sha2(text.cast("binary"), 256)))
    cuts = cuts.toDF("__of", "__removed", "__spans", "__kept")
    return (
        docs.join(cuts, F.col("__c") == F.col("__of"), "left")
        .withColumn("n_removed", F.coalesce("__removed", F.lit(0)).cast("long"))
        .withColumn("n_spans", F.when(F.col("__removed") > 0, F.size("__spans")).otherwise(0).cast("long"))
        .withColumn("kept_sha256", F.coalesce("__kept", "__sha"))
        .withColumn("spans", F.coalesce("__spans", F.array().cast("array<struct<start: bigint, bytes: bigint>>")))
        .drop("__c", "__sha", "__of", "__removed", "__spans", "__kept"))
