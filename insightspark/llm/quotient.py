"""Counting quotient filters as sorted arrays: built per partition, merged without loss.

A 64-bit fingerprint is cut into a bucket (its top bits, chosen for the whole table), a quotient and a
remainder. A filter holds, for one bucket, which quotients occur, where the run of each ends, the remainders in
sorted order and a counter for every remainder met more than once. Quotient and remainder give the fingerprint
back, so filters with different quotient sizes merge exactly: by their sorted remainders, counters added.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BBBxII")  # bucket bits, quotient bits, bytes of a remainder, entries, entries with a counter


def build(prints: np.ndarray, counts: np.ndarray, bucket_bits: int) -> bytes:
    """Encode sorted distinct fingerprints of one bucket with their counts."""
    n = len(prints)
    q = max(1, int(n - 1).bit_length())
    rest_bits = 64 - bucket_bits - q
    body = prints & np.uint64((1 << (64 - bucket_bits)) - 1)
    quotients = (body >> np.uint64(rest_bits)).astype(np.int64)
    occupied = np.zeros(1 << q, np.uint8)
    occupied[quotients] = 1
    run_ends = np.ones(n, np.uint8)
    run_ends[:-1] = quotients[1:] != quotients[:-1]
    width = (rest_bits + 7) // 8
    remainders = (body & np.uint64((1 << rest_bits) - 1)).view(np.uint8).reshape(n, 8)[:, :width]
    many = np.nonzero(counts > 1)[0]
    return b"".join([
        _HEAD.pack(bucket_bits, q, width, n, len(many)), np.packbits(occupied).tobytes(), np.packbits(run_ends).tobytes(), np.ascontiguousarray(remainders).tobytes(),
        many.astype("<u4").tobytes(), counts[many].astype("<u8").tobytes()])


def entries(blob: bytes, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints and counts of an encoded filter."""
    bucket_bits, q, width, n, n_many = _HEAD.unpack_from(blob)
    at = _HEAD.size
    size = ((1 << q) + 7) // 8
    occupied = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=1 << q)
    at += size
    size = (n + 7) // 8
    run_ends = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=n)
    at += size
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    runs = np.concatenate([[0], np.cumsum(run_ends)[:-1]]).astype(np.int64)
    quotients = np.nonzero(occupied)[0][runs].astype(np.uint64)
    prints = (quotients << np.uint64(64 - bucket_bits - q)) | wide.view(np.uint64).reshape(n)
    if bucket_bits:
        prints |= np.uint64(bucket) << np.uint64(64 - bucket_bits)
    counts = np.ones(n, np.int64)
    many = np.frombuffer(blob, "<u4", n_many, at)
    counts[many] = np.frombuffer(blob, "<u8", n_many, at + 4 * n_many)
    return prints, counts


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted entries, adding the counters of equal fingerprints."""
    prints = np.concatenate([p for p, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(prints, kind="stable")  # timsort: the sorted runs are merged, not sorted anew
    prints, counts = prints[order], counts[order]
    starts = np.nonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))[0]
    return prints[starts], np.add.reduceat(counts, starts)
