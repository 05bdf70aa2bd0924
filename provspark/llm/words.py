"""Words of many texts at once: bounds and 64-bit hashes from their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from provspark.llm.common import U64, mix, powers

#: Odd multiplier of the rolling hash, and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@dataclass
class Words:
    start: np.ndarray  # place of the first byte in the batch
    end: np.ndarray  # behind the last byte
    hash: np.ndarray
    first: np.ndarray  # per document its first word; one more at the end


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums of byte * BASE ** place over the first 0 .. n bytes; (P[e] - P[s]) / BASE ** s depends on raw[s:e] alone."""
    out = np.zeros(len(raw) + 1, U64)
    term = raw.astype(U64)
    term += U64(1)
    term *= powers(BASE, len(raw))[: len(raw)]
    np.cumsum(term, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end] per span; equal bytes have equal hashes wherever they stand."""
    value = (sums[end] - sums[start]) * powers(INVERSE, len(sums))[start]
    return mix(value ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


def split(raw: np.ndarray, offsets: np.ndarray, normal: np.ndarray) -> Words:
    """``normal`` gives each byte's form within a word, 0 for a byte that parts words."""
    form = normal[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = form != 0
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    begins[cut] = inside[1:-1][cut]  # a document's end parts words too
    ends[cut - 1] = inside[1:-1][cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashed = span_hash(prefix_sums(form), start, end) if len(start) else np.zeros(0, U64)
    return Words(start, end, hashed, np.searchsorted(start, offsets))


def hash_of(word: bytes) -> int:
    raw = np.frombuffer(word, np.uint8)
    return int(span_hash(prefix_sums(raw), np.array([0]), np.array([len(raw)]))[0])


def letters() -> np.ndarray:
    """ASCII letters, lower-cased, and every byte of other characters make words."""
    normal = np.arange(256, dtype=np.uint8)
    normal[ord("A") : ord("Z") + 1] += 32
    normal[:128][[not chr(b).isalpha() for b in range(128)]] = 0
    return normal


def unspaced() -> np.ndarray:
    """Everything but space and 0x09-0x0D makes words, A-Z lower-cased. Byte 0 is a part of words too: it stands as 0xFF."""
    normal = np.arange(256, dtype=np.uint8)
    normal[ord("A") : ord("Z") + 1] += 32
    normal[0] = 0xFF  # never a byte of UTF-8
    normal[[0x20, *range(0x09, 0x0E)]] = 0
    return normal


def alphanumeric() -> np.ndarray:
    """ASCII letters, lower-cased, digits and every byte of other characters make words."""
    normal = letters()
    normal[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
    return normal
