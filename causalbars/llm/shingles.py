"""Word shingles of whole texts as sets of 64-bit hashes, a batch at a time."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

_U = np.uint64
_P, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (_P, pow(_P, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _word_hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of words that stand one after the other in ``data``: a polynomial in the bytes, moved to the word's start."""
    size = max(1 << 20, 1 << int(len(data)).bit_length())
    up, down = _powers(size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])
    starts = np.concatenate([np.zeros(1, ends.dtype), ends[:-1]])
    return mix((total[ends] - total[starts]) * down[np.minimum(starts, size - 1)] + (ends - starts).astype(np.uint64))


def _sets(words: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes from its words' hashes."""
    out, at = [], 0
    if len(words) >= k:
        grams = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            grams += words[j : len(words) - k + 1 + j] * _U(pow(_P, k - j, 1 << 64))
        grams = mix(grams)
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(grams[at : at + n - k + 1]))
        elif n:
            whole = sum((int(w) * pow(_P, 2 * j + 1, 1 << 64) for j, w in enumerate(words[at : at + n])), n)
            out.append(mix(np.array([whole & _MASK], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def shingle_sets(texts, k: int = 5, group: int = 1 << 20) -> list[np.ndarray]:
    """For an Arrow array of strings: A-Z lower-cased, split at ASCII white space, sorted distinct hashes of ``k``-word
    shingles; of fewer words one hash of them all; of none, and of null, an empty array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    sizes = np.asarray(pc.binary_length(texts))
    out, lo = [], 0
    while lo < len(texts):  # groups of texts of about a megabyte
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), group, side="right")))
        pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(lo, hi - lo)))
        counts, words = np.asarray(pieces.value_lengths(), np.int64), pieces.flatten()
        lens = np.asarray(pc.binary_length(words), np.int64)
        if (lens == 0).any():  # at the ends of a text
            owner = np.repeat(np.arange(len(counts)), counts)[lens > 0]
            counts = np.bincount(owner, minlength=len(counts))
            words = words.filter(pa.array(lens > 0))
            lens = lens[lens > 0]
        joined = pa.concat_arrays([words.cast(pa.large_binary())])
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(joined) else np.empty(0, np.uint8)
        out += _sets(_word_hashes(data, offsets[1:] - offsets[0]) if len(joined) else np.empty(0, np.uint64), counts, k)
        lo = hi
    return out


def signature(tokens: np.ndarray) -> str:
    """128 bits of a set, as hexadecimal text."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest()
