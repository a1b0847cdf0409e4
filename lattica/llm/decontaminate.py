"""Benchmark decontamination by q-gram lemma filtering.

An item of the benchmark is searched in windows. If a window of m characters occurs in a text
with at most e edits, the two share at least m + 1 - q (e + 1) q-grams whose diagonals (place in
the text less place in the window) differ by at most e. Shared q-grams are therefore counted in
diagonal bands of width 2 (e + 1), of which each overlaps the next by half, so that one band has
them all; windows whose count meets the bound, wherever in the item they start, are verified by an
edit-distance alignment that stays within the band. A window that needs d edits tells that none of
the next d - e - 1 starts can do with e.

Texts are compared in lower case, with every run of other characters than letters and digits as
one space. An item shorter than a window is one window with fewer edits; one that gets no edit
must stand as whole words, and one too short for a q-gram is only found in a text that is nothing
else. The benchmark is dealt into slices of bounded size; the index of a slice is built in
each worker, and every text is held against every slice.
"""

from __future__ import annotations

import math
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import slices, worker_keeps

Q = 10
WINDOW = 96
#: One edit is allowed for so many characters of a window.
EDIT_CHARS = 14
#: Shared q-grams that are worked on at once; beyond that texts or items are taken in parts.
MOST_HITS = 1 << 20
#: Characters of the parts of one text then, and by how much they overlap.
SEGMENT, OVERLAP = 4096, 2 * WINDOW
#: Characters of the benchmark in one slice: what a worker's index holds at most.
SLICE_CHARS = 2_000_000
#: Characters of text that are hashed in one go.
GO_CHARS = 1 << 18
BITMAP_BITS = 22

_OTHER = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q characters from each place on."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(4)]
    two = codes[:-1] * base[0] + codes[1:]
    four = two[:-2] * base[1] + two[2:]
    eight = four[:-4] * base[2] + four[4:]
    ten = eight[:n] * base[1] + two[8 : 8 + n]
    return (ten ^ (ten >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def aligned(pattern: np.ndarray, text: np.ndarray, first: int, last: int, edits: int) -> int:
    """Fewest edits that turn the pattern into some part of the text.

    Only cells on the diagonals ``first - edits`` to ``last + edits`` are worked out, so that a
    number above ``edits`` may be too large.
    """
    low, width = first - edits, last - first + 2 * edits + 1
    far = len(pattern) + len(text) + 1
    steps = np.arange(width)
    place = low + steps  # column of the row's cells: characters of text before the cell
    row = np.where((place >= 0) & (place <= len(text)), 0, far)
    padded = np.concatenate((np.zeros(1, np.uint32), text, np.zeros(1, np.uint32)))
    for i, c in enumerate(pattern):
        place = low + i + 1 + steps
        inside = (place >= 0) & (place <= len(text))
        same = (place >= 1) & inside & (padded[np.clip(place, 0, len(text))] == c)
        step = np.where(place >= 1, row + ~same, far)  # along the diagonal
        step = np.minimum(step, np.append(row[1:], far) + 1)  # a character of the pattern is left out
        step = np.where(inside, step, far)
        row = np.minimum.accumulate(step - steps) + steps  # characters of the text are put in
        row = np.where(inside, row, far)
    return int(row.min())


def part(codes: np.ndarray, begin: int, end: int, lo: int, hi: int) -> np.ndarray:
    """``codes[begin:end]`` with zeros, which match nothing, for all outside of ``lo`` to ``hi``."""
    out = np.zeros(end - begin, np.uint32)
    a, b = max(lo, begin), min(hi, end)
    if a < b:
        out[a - begin : b - begin] = codes[a:b]
    return out


def edits_allowed(chars: int) -> int:
    """One in ``EDIT_CHARS``, but no more than leave a shared q-gram by the lemma."""
    m = min(chars, WINDOW)
    return max(0, min(m // EDIT_CHARS, m // Q - 1))


class Index:
    """Items of one slice: ``(item_id, text)`` pairs."""

    def __init__(self, items: list[tuple[int, str]]):
        normal = [(i, t, edits_allowed(len(t))) for i, t in ((i, normalise(t)) for i, t in items)]
        padded = [(i, t if e else f" {t} ", e) for i, t, e in normal if t]  # without edits: whole words
        self.whole: dict[str, list[int]] = {}
        for i, t, _ in padded:
            if len(t) < Q:
                self.whole.setdefault(t, []).append(i)
        kept = [(i, t, e) for i, t, e in padded if len(t) >= Q]
        self.items = [(i, _codes(t)) for i, t, _ in kept]
        self.edits = np.array([e for *_, e in kept], np.int64)
        self.size = np.array([min(len(t), WINDOW) for _, t, _ in kept], np.int64)
        hashes = [gram_hashes(c) for _, c in self.items]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.grams, self.n = np.unique(every[order], return_counts=True)
        self.item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        self.place = np.concatenate([np.arange(len(h)) for h in hashes])[order] if hashes else order
        #: Of each posting the q-gram and the item, in order.
        self.posting = np.repeat(np.arange(len(self.grams)), self.n) * max(1, len(hashes)) + self.item
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[(self.grams >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True

    def windows(self, item: int) -> list[int]:
        return list(range(max(1, len(self.items[item][1]) - WINDOW + 1)))

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(number of the text, item_id, first character of the window, edits), at most one for
        each text and item."""
        out, go, held, at = [], [], 0, 0
        for i, text in enumerate(texts):
            go.append(f" {normalise(text)} ")
            out.extend((i, item, 0, 0) for item in self.whole.get(go[-1], ()))
            held += len(go[-1])
            if held >= GO_CHARS or i == len(texts) - 1:
                out.extend((at + t, *rest) for t, *rest in self._search_go(go) if self.items)
                at, go, held = i + 1, [], 0
        return out

    def _search_go(self, go: list[str]):
        if not self.items:
            return
        codes = _codes("\n".join(go))  # no item has a line feed, so no q-gram across texts is shared
        hashes = gram_hashes(codes)
        at = np.flatnonzero(self.bitmap[(hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)])
        gram = np.searchsorted(self.grams, hashes[at])
        real = self.grams[np.minimum(gram, len(self.grams) - 1)] == hashes[at]
        at, gram = at[real], gram[real]
        total = int(self.n[gram].sum())
        if total <= MOST_HITS:
            yield from self._matches(go, codes, at, gram, 0, len(self.items))
        elif len(go) > 1:
            half = len(go) // 2
            yield from self._search_go(go[:half])
            for t, *rest in self._search_go(go[half:]):
                yield half + t, *rest
        elif len(go[0]) > SEGMENT + OVERLAP:
            seen: set[int] = set()
            for k in range(0, len(go[0]) - OVERLAP, SEGMENT):
                for _, item, *rest in self._search_go([go[0][k : k + SEGMENT + OVERLAP]]):
                    if item not in seen:
                        seen.add(item)
                        yield 0, item, *rest
        else:
            often = np.bincount(gram, minlength=len(self.grams))
            hits = np.cumsum(np.bincount(self.item, np.repeat(often, self.n), len(self.items)))
            cuts = np.unique(np.searchsorted(hits, np.arange(MOST_HITS, hits[-1], MOST_HITS)) + 1)
            for a, b in zip([0, *cuts], [*cuts, len(self.items)], strict=True):
                yield from self._matches(go, codes, at, gram, int(a), int(b))

    def _matches(self, go: list[str], codes: np.ndarray, at: np.ndarray, gram: np.ndarray, low: int, high: int):
        """Matches of the items from ``low`` up to ``high``."""
        n_items = max(1, len(self.items))
        begin, end = np.searchsorted(self.posting, gram * n_items + low), np.searchsorted(self.posting, gram * n_items + high)
        n = end - begin
        if not n.sum():
            return
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in go])))
        posting = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, place, at = self.item[posting], self.place[posting], np.repeat(at, n)
        diagonal = at - place + WINDOW  # over all texts of the go, not below 0 within a window
        width = self.edits[item] + 1
        text = np.searchsorted(starts, at, "right") - 1
        # items longer than a window have q-grams farther to the left
        shift = max(len(c) for _, c in self.items) + WINDOW
        bands = (diagonal + shift) // width
        span = len(codes) + 2 * shift + 2 * WINDOW + 2
        # a q-gram counts in the band that starts below its diagonal and in the one before
        code = np.concatenate(((item * len(go) + text) * span + bands, (item * len(go) + text) * span + bands - 1))
        hit = np.concatenate((np.arange(len(at)), np.arange(len(at))))
        order = np.argsort(code, kind="stable")
        code, hit = code[order], hit[order]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        count = np.diff(np.append(first, len(code)))
        bound = self.size + 1 - Q * (self.edits + 1)
        done = set()
        for k in np.flatnonzero(count >= np.maximum(1, bound[item[hit[first]]])):
            hits = hit[first[k] : first[k] + count[k]]
            t, it = int(text[hits[0]]), int(item[hits[0]])
            if (t, it) in done:
                continue
            e, need, size = int(self.edits[it]), max(1, int(bound[it])), int(self.size[it])
            places = np.unique(place[hits])
            band = int(code[first[k]] % span) * (e + 1) - shift - WINDOW
            lo, hi = int(starts[t]), int(starts[t + 1]) - 1
            w = np.array(self.windows(it))
            least = 0
            for w in w[np.searchsorted(places, w + size - Q, "right") - np.searchsorted(places, w) >= need].tolist():
                if w < least:
                    continue
                begin_at, end_at = w + band - e, w + size + band + 3 * e + 2
                cost = aligned(self.items[it][1][w : w + size], part(codes, begin_at, end_at, lo, hi), e, 3 * e + 1, e)
                if cost <= e:
                    done.add((t, it))
                    yield t, self.items[it][0], w, cost
                    break
                least = w + cost - e


def _index(items: list[tuple[int, str]]) -> Index:
    """The index of ``items``; a worker keeps the last one it built."""
    return worker_keeps(("benchmark", hash(tuple(items)), len(items)), lambda: Index(items))


def _find_partition(batches, items):
    index = _index(items)
    for batch in slices(batches, "text"):
        ids = batch.column("doc_id").to_pylist()
        found = index.search(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[t] for t, *_ in found], pa.int64()),
                pa.array([x[1] for x in found], pa.int64()),
                pa.array([x[2] for x in found], pa.int64()),
                pa.array([x[3] for x in found], pa.int32()),
            ],
            names=["doc_id", "item_id", "item_at", "edits"],
        )


def _clean_partition(batches, items, column):
    index = _index(items)
    for batch in slices(batches, column):
        leaky = {t for t, *_ in index.search(batch.column(column).to_pylist())}
        yield batch.filter(pa.array([i not in leaky for i in range(batch.num_rows)], pa.bool_())) if leaky else batch


def benchmark_slices(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in slices of about ``SLICE_CHARS`` characters; items without text are left out."""
    typed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = typed.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = math.ceil(total / SLICE_CHARS)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, slices)))
    return [[tuple(r) for r in typed.where(part == k).orderBy("item_id", "text").collect()] for k in range(slices)]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_at, edits: one row for each document and item of which it holds a
    window, ``item_at`` being that window's first character in the item's compared form.

    Null and empty texts hold nothing, and items without a letter or digit are held by none.
    Items of under 20 compared characters are held as whole words, those of under 8 by texts that
    are nothing else. Items with the same text are each reported. Documents that repeat give
    repeated rows. An empty benchmark or table gives no rows. Other columns are not read. The
    benchmark is collected on the driver: it is a fixed set that doesn't grow with the documents.
    """
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, item_at long, edits int"
    out = None
    for items in benchmark_slices(benchmark) or [[]]:
        part = typed.mapInArrow(partial(_find_partition, items=items), schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no window of an item."""
    for items in benchmark_slices(benchmark):
        docs = docs.mapInArrow(partial(_clean_partition, items=items, column=column), docs.schema)
    return docs
