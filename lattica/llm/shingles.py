"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes of text that are hashed in one go (a longer text is one go of its own).
GO_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, GO_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 4 * GO_BYTES:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of the text it stands in (texts end with a line feed)."""
    raw = np.frombuffer(joined, np.uint8)
    stops = np.flatnonzero((raw == 32) | (raw == 10))
    starts = np.concatenate(([0], stops[:-1] + 1))
    texts = np.cumsum(raw[stops] == 10) - (raw[stops] == 10)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), dtype=np.uint64)))
    hashes = mix((sums[stops] - sums[starts]) * _powers(_INVERSE, len(raw))[starts])
    real = stops > starts
    return hashes[real], texts[real]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of ``words`` words.

    Words are what white space separates, in lower case. A text with fewer words is one shingle;
    one with none (or a null) has no shingle.
    """
    out: list[np.ndarray] = []
    go: list[bytes] = []
    held = 0
    for i, text in enumerate(texts):
        go.append(" ".join(text.lower().split()).encode("utf-8", "replace") + b"\n" if text else b"\n")
        held += len(go[-1])
        if held >= GO_BYTES or i == len(texts) - 1:
            out.extend(_shingle_go(go, words))
            go, held = [], 0
    return out


def _shingle_go(go: list[bytes], words: int) -> list[np.ndarray]:
    hashes, of = _word_hashes(b"".join(go))
    counts = np.bincount(of, minlength=len(go))
    factors = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    n = len(hashes) - words + 1
    if n > 0:
        runs = np.zeros(n, np.uint64)
        for j in range(words):
            runs += hashes[j : n + j] * factors[j]
        runs = mix(runs)
        runs, runs_of = runs[of[:n] == of[words - 1 :]], of[:n][of[:n] == of[words - 1 :]]
    else:
        runs, runs_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.searchsorted(runs_of, np.arange(len(go) + 1))
    word_ends = np.concatenate(([0], np.cumsum(counts)))
    out = []
    for i in range(len(go)):
        if counts[i] >= words:
            out.append(np.unique(runs[ends[i] : ends[i + 1]]))
        elif counts[i]:
            own = hashes[word_ends[i] : word_ends[i + 1]]
            out.append(mix((own * factors[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class MinHash:
    """``bands`` times ``rows`` minima of a set, and one key for each band."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        k = np.arange(1, bands * rows + 1, dtype=np.uint64)
        self.factors = mix(k * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
        self.terms = mix(k * np.uint64(0xA24BAED4963EE407))
        self.weights = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 256):
            part = shingles[at : at + 256]
            np.minimum(out, (self.factors[:, None] * part + self.terms[:, None]).min(axis=1), out=out)
        return (out >> np.uint64(32)).astype(np.uint32)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """Keys of the bands, of signatures in rows; a key holds the number of its band."""
        parts = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        return mix((parts * self.weights).sum(axis=2, dtype=np.uint64) ^ mix(np.arange(1, self.bands + 1, dtype=np.uint64))).astype(np.int64)


def fingerprint(shingles: np.ndarray) -> int:
    """64 bits of a set of shingles, as a signed number."""
    if not len(shingles):
        return 0
    return int(mix(np.bitwise_xor.reduce(mix(shingles), keepdims=True) + np.array([len(shingles)], np.uint64) * np.uint64(_BASE)).astype(np.int64)[0])
