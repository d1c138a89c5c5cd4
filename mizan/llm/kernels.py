"""Vectorised text kernels over Arrow string columns (numpy only).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never
uses those bytes inside a longer sequence, so the kernels work on the bytes of
a whole Arrow batch at once and never build Python strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Seeds of the hash family. They only need to be odd and fixed for all runs.
BYTE_SEED, WORD_BASE, SEQ_BASE = 20_240_607, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Alphabet:
    """Which bytes make words, and a random number for each, 0 for the others."""

    def __init__(self, is_word: np.ndarray, lower: bool, seed: int = BYTE_SEED):
        self.is_word = is_word
        self.table = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=U64)
        self.table[~is_word] = 0
        if lower:
            self.table[65:91] = self.table[97:123]


def _without(separators) -> np.ndarray:
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    return is_word


EXACT = Alphabet(_without(_SEPARATORS), lower=False)
LOWER = Alphabet(_without(_SEPARATORS), lower=True)
#: Runs of letters and digits, whatever marks stand between them; A-Z lower-cased.
LETTERS = Alphabet(_without(b for b in range(128) if not chr(b).isalnum()), lower=True)
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """WORD_BASE ** i for i < n, modulo 2**64; the table grows on demand."""
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 4096), WORD_BASE, U64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offs is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(buf: np.ndarray, offsets: np.ndarray, alphabet: Alphabet = EXACT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and first word of every document (len + 1)."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = alphabet.is_word[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, alphabet: Alphabet = EXACT) -> np.ndarray:
    """A 64-bit hash of every word's bytes, case as the alphabet has it."""
    if not len(starts):
        return np.zeros(0, U64)
    span = np.diff(np.append(starts, ends[-1]))
    at = np.arange(starts[0], ends[-1], dtype=np.int64) - np.repeat(starts, span)
    values = alphabet.table[buf[starts[0] : ends[-1]]]
    values *= powers(int(span.max()) + 1)[at]
    sums = np.add.reduceat(values, starts - starts[0])
    return mix(sums + (ends - starts).astype(U64) * U64(SEQ_BASE))


def sequence_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """For every i with k items from i on: a 64-bit hash of h[i:i+k], in order."""
    if len(h) < k:
        return np.zeros(0, U64)
    n = len(h) - k + 1
    out, done, block, width, factor = np.zeros(n, U64), 0, h, 1, SEQ_BASE
    scale = 1
    while True:  # by doubling: block[i] hashes h[i:i+width]
        if k & width:
            out += block[done : done + n] * U64(scale)
            done += width
            scale = scale * factor % 2**64
        if done == k:
            return mix(out)
        block = block[:-width] + block[width:] * U64(factor)
        factor = factor * factor % 2**64
        width *= 2


def window_owner(first_word: np.ndarray, k: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Document of each window start, and which windows lie in one document."""
    owner = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    n = max(0, n_words - k + 1)
    return owner[:n], owner[:n] == owner[k - 1 : k - 1 + n]


def shingle_sets(column, k: int = 5, alphabet: Alphabet = LOWER) -> list[np.ndarray]:
    """Distinct k-word shingle hashes of each text, sorted.

    A text with fewer than k words has its whole word sequence as one shingle;
    one without words has none.
    """
    buf, offsets = text_bytes(column)
    starts, ends, first = words(buf, offsets)
    h = word_hashes(buf, starts, ends, alphabet)
    seq = sequence_hashes(h, k)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(seq[a : b - k + 1]))
        elif b > a:
            out.append(sequence_hashes(h[a:b], int(b - a)) ^ U64(b - a))
        else:
            out.append(np.zeros(0, U64))
    return out


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for every i; by doubling."""
    width, out = 1, x
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - width : w - width + len(x) - w + 1])


def text_batches(batches, max_bytes: int = 4 << 20):
    """Arrow record batches cut so that each holds about max_bytes of text.

    One text may be longer than that; then it is a batch of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.nbytes
        step = max(1, int(batch.num_rows * max_bytes / max(size, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
