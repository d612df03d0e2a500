"""Which sets share tokens with other sets: packed entries, met in buckets of tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Rows of packed entries: 0 for (token, set), 1 for counts that are settled.
PACKED = "bucket int, kind int, entries binary"


def pack(keys: np.ndarray, tokens: np.ndarray, own: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries of a batch of distinct sets: ``tokens`` of the sets ``keys[own]``.

    A token that several sets of the batch share counts for them at once and goes on
    as one entry with set 0, so a bucket gets one entry a token and batch at most,
    however frequent the token is.
    """
    found, first, back, many = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
    local = np.bincount(own[many[back] > 1], minlength=len(keys))
    who = np.where(many > 1, 0, keys[own[first]])
    place = (found.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    turn = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[turn], np.arange(buckets + 1))
    rows = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    blobs = [np.stack((found[turn[cuts[b]:cuts[b + 1]]], who[turn[cuts[b]:cuts[b + 1]]])).tobytes() for b in rows]
    kinds = [0] * len(rows)
    if (local > 0).any():
        rows.append(int(keys[0] % buckets))
        kinds.append(1)
        blobs.append(np.stack((keys[local > 0], local[local > 0])).tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())],
        ["bucket", "kind", "entries"])


def meet(bucket: pa.Table, parts_of_keys: int) -> pa.Table:
    """Counts of tokens that sets share with others, packed again for parts of the keys."""
    parts: tuple[list, list] = ([], [])
    for kind, blob in zip(bucket["kind"].to_pylist(), bucket["entries"]):
        parts[kind].append(np.frombuffer(blob.as_py(), np.int64).reshape(2, -1))
    found = parts[1]
    if parts[0]:
        tokens, who = np.concatenate(parts[0], axis=1)
        turn = np.argsort(tokens, kind="stable")
        tokens, who = tokens[turn], who[turn]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        sizes = np.diff(np.append(starts, len(tokens)))
        # Copies of a set in several batches do not share with each other.
        low, high = np.minimum.reduceat(who, starts), np.maximum.reduceat(who, starts)
        several = np.repeat(low != high, sizes) & (who != 0)
        found = [*found, np.stack(np.unique(who[several], return_counts=True))]
    keys, counts = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    place = (keys.view(np.uint64) % np.uint64(parts_of_keys)).astype(np.int64)
    rows = np.unique(place)
    return pa.table([pa.array(rows.astype(np.int32)), pa.array([1] * len(rows), pa.int32()), pa.array(
        [np.stack((keys[place == b], counts[place == b])).tobytes() for b in rows], pa.binary())],
        ["bucket", "kind", "entries"])


def total(part: pa.Table) -> pa.Table:
    """``key, shared``: the counts of a part's sets, summed."""
    keys, counts = np.concatenate(
        [np.frombuffer(x.as_py(), np.int64).reshape(2, -1) for x in part["entries"]], axis=1)
    found, back = np.unique(keys, return_inverse=True)
    return pa.table([pa.array(found), pa.array(np.bincount(back, counts).astype(np.int64))], ["key", "shared"])
