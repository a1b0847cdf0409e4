"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is encoded by an agenda: every adjacent pair of symbols whose concatenation is a piece
waits, ordered by score (highest first, then leftmost); the best pair is merged, its new
neighbours join the agenda, pairs whose symbols have changed meanwhile are passed over.
Characters that end up outside the vocabulary become byte pieces.

No merge can cross a point that no piece of the vocabulary spans. In a vocabulary whose pieces
have the space mark only at their start, the start of each word is such a point, and so is each
side of a line feed that no piece holds. Words are therefore encoded by themselves and remembered
in a bounded cache, and the agendas of all new words of a batch go on at the same time, as rows of
an array: in each round every row merges its best pair. Where a vocabulary lacks the property, the
whole text is one agenda, held in a heap.

In each Arrow batch every word that had to be worked out is also given to the sentencepiece
library, for ids and for decoded text, and so is one whole text; the batch fails if any differs.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import slices, worker_keeps

SPACE = "▁"
#: Words kept in each of the two generations of a worker's cache.
CACHE_WORDS = 250_000
#: Symbols of the agendas that go on at the same time.
ROW_SYMBOLS = 1 << 18
#: Longer words have an agenda of their own.
LONG_WORD = 64
#: New words that are checked against the library in one call.
CHECK_WORDS = 10_000
#: Characters of the text of each batch that is checked as a whole, at most.
CHECK_CHARS = 20_000


class PieceModel:
    """Vocabulary, agenda encoder and decoder; ``library`` is only asked for checks."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        self.unknown = sp.unk_id()
        self.text_of = list(map(str, range(size)))
        normal = [i for i in range(size) if i not in self.special and i not in self.byte_of]
        self.id_of = {self.pieces[i]: i for i in normal}
        self.score_of = {self.pieces[i]: sp.get_score(i) for i in normal}
        order = {s: r for r, s in enumerate(sorted(set(self.score_of.values()), reverse=True))}
        #: Place of each piece's score, best first; equal scores share a place.
        self.rank_of = {p: order[s] for p, s in self.score_of.items()}
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p in self.id_of)
        self.by_line = self.by_word and not any("\n" in p for p in self.id_of)
        pieces_of: dict[int, list[str]] = {}
        for p, r in self.rank_of.items():
            pieces_of.setdefault(r, []).append(p)
        equal = {p for same in pieces_of.values() if len(same) > 1 for p in same if len(p) > 1}
        #: Pieces of equal score that hold no other such piece: words with one of them get a heap.
        self.equal = [p for p in equal if not any(q != p and q in p for q in equal)]
        self.by_rank = sorted(self.rank_of, key=lambda p: (self.rank_of[p], p))
        self.id_by_rank = np.array([self.id_of[p] for p in self.by_rank], np.int64)
        self.rows = Rows(self.by_rank, equal) if self.by_word else None

    def merge(self, text: str) -> list[int]:
        """Ids of ``text``, whose spaces are marks already."""
        symbols = self._heaped(text)
        ids: list[int] = []
        id_of = self.id_of
        for s in symbols:
            i = id_of.get(s)
            if i is not None:
                ids.append(i)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in s.encode())
            else:
                ids.append(self.unknown)
        return ids

    def _heaped(self, text: str) -> list[str]:
        """Symbols of a text whose agenda is a heap."""
        symbols, rank = list(text), self.rank_of.get
        n = len(symbols)
        heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := rank(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            _, left, right, length = heapq.heappop(heap)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != length:
                continue  # one of the two has changed since
            symbols[left], symbols[right] = a + b, ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            for x, y in ((before[left], left), (left, after[left])):
                if x >= 0 and y < n and (r := rank(pair := symbols[x] + symbols[y])) is not None:
                    heapq.heappush(heap, (r, x, y, len(pair)))
        return [s for s in symbols if s]

    def work_out(self, words: list[str]) -> tuple[list[str], list[str]]:
        """Ids of each word, joined by commas, and its surface."""
        ids_of, surface_of = [""] * len(words), [""] * len(words)
        left = []
        short = []
        for i, w in enumerate(words):
            (short if 0 < len(w) <= LONG_WORD and not any(p in w for p in self.equal) else left).append(i)
        if self.rows is None:
            short, left = [], range(len(words))
        short.sort(key=lambda i: len(words[i]))
        at = 0
        while at < len(short):
            end = at + 1
            while end < len(short) and (end - at) * len(words[short[end]]) < ROW_SYMBOLS:
                end += 1
            for places, n, symbols in self.rows.merge([words[i] for i in short[at:end]]):
                known = symbols < len(self.by_rank)
                ids = self.id_by_rank[np.where(known, symbols, 0)].tolist()
                texts, pieces = list(map(self.text_of.__getitem__, ids)), list(map(self.pieces.__getitem__, ids))
                ends = np.cumsum(n)
                odd = np.add.reduceat(~known, ends - n).tolist()
                k = 0
                for place, stop, bad in zip(places.tolist(), ends.tolist(), odd, strict=True):
                    i = short[at + place]
                    if bad:  # a character outside of the vocabulary
                        left.append(i)
                    else:
                        ids_of[i], surface_of[i] = ",".join(texts[k:stop]), "".join(pieces[k:stop]).replace(SPACE, " ")
                    k = stop
            at = end
        for i in left:
            ids = self.merge(words[i])
            ids_of[i], surface_of[i] = ",".join(map(self.text_of.__getitem__, ids)), self.surface(ids)
        return ids_of, surface_of

    def surface(self, ids: list[int]) -> str:
        """Text of ``ids`` with the leading space mark still there as a space."""
        out, raw = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                raw.append(byte)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i not in self.special:
                out.append(self.pieces[i])
            elif i == self.unknown:
                out.append(" ⁇ ")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def encode(self, text: str) -> list[int]:
        return self.merge(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids: list[int]) -> str:
        return self.surface(ids).removeprefix(" ")


class Rows:
    """Agendas of many words at the same time. A piece's symbol is its place by score, so that the
    better of two has the smaller one; any other character's is its code behind those."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, by_rank: list[str], without: set[str]):
        rank_of = {p: r for r, p in enumerate(by_rank)}
        self.n = len(by_rank)
        self.symbol = np.arange(self.n, self.n + 0x110000, dtype=np.int32)
        for p, r in rank_of.items():
            if len(p) == 1:
                self.symbol[ord(p)] = r
        sym = lambda s: rank_of.get(s, self.n + ord(s) if len(s) == 1 else None)
        pairs: dict[int, int] = {}
        for p, r in rank_of.items():
            for k in range(1, 0 if p in without else len(p)):
                a, b = sym(p[:k]), sym(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 21) + b] = r
        keys, ranks = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        self.bits = max(10, (8 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot = self._slot(keys)
        self.keys[slot], self.ranks[slot] = keys, ranks
        lost = np.flatnonzero(self.keys[slot] != keys)  # another pair has the place
        lost = lost[np.argsort(keys[lost])]
        self.lost, self.lost_ranks = np.append(keys[lost], np.iinfo(np.int64).max), np.append(ranks[lost], self.NONE).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that two symbols make, ``NONE`` if they make none."""
        keys = (a.astype(np.int64) << 21) + b
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], self.NONE)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        at = np.searchsorted(self.lost, keys[rest])
        out[rest] = np.where(self.lost[at] == keys[rest], self.lost_ranks[at], self.NONE)
        return out

    def merge(self, words: list[str]):
        """(places of words, number of symbols of each, their symbols) of those that are done, round by round."""
        size = np.array([len(w) for w in words])
        width = int(size.max())
        flat = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        inside = np.arange(width) < size[:, None]
        symbols = np.full((len(words), width), -1, np.int32)
        symbols[inside] = flat
        ranks = np.full((len(words), width), self.NONE, np.int32)  # of a symbol and the next
        both = inside[:, 1:]
        ranks[:, :-1][both] = self._rank(symbols[:, :-1][both], symbols[:, 1:][both])
        place = np.arange(len(words))
        while len(place):
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(place)), best]
            done = rank == self.NONE
            if done.any():
                ready = symbols[done]
                yield place[done], (ready >= 0).sum(axis=1), ready[ready >= 0]
                place, symbols, ranks, best, rank = place[~done], symbols[~done], ranks[~done], best[~done], rank[~done]
                if not len(place):
                    return
            row = np.arange(len(place))
            symbols[row, best] = rank
            keep = np.ones(symbols.shape, bool)
            keep[row, best + 1] = False  # a best pair has a next symbol
            symbols, ranks = symbols[keep].reshape(len(place), -1), ranks[keep].reshape(len(place), -1)
            ranks[row, best] = self.NONE
            for left in (best - 1, best):
                ok = np.flatnonzero((left >= 0) & (left + 1 < symbols.shape[1]))
                ok = ok[symbols[ok, left[ok] + 1] >= 0]
                ranks[ok, left[ok]] = self._rank(symbols[ok, left[ok]], symbols[ok, left[ok] + 1])


#: Stands before a key that is itself what is to be encoded; other keys are words behind a mark.
_AS_IS = "\n"
#: A run of marks with the word behind it, or a run that nothing follows.
_CUT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class _Words:
    """Key -> ids joined by commas; with the surface, where that isn't the word with its mark as a space."""

    def __init__(self, model: PieceModel, size: int):
        self.model, self.size, self.now, self.old = model, size, {}, {}
        self.feed = ",".join(map(str, model.merge("\n")))

    def prepare(self, keys: set[str]) -> None:
        """Have all the keys in ``now``."""
        if len(self.now) > self.size:
            self.old, self.now = self.now, {}
        now, old = self.now, self.old
        keys = [k for k in keys if k not in now]
        if old:
            now.update((k, old[k]) for k in keys if k in old)
            keys = [k for k in keys if k not in now]
        for at in range(0, len(keys), CHECK_WORDS):
            part = keys[at : at + CHECK_WORDS]
            words = [k[1:] if k.startswith(_AS_IS) else SPACE + k for k in part]
            ids, surfaces = self.model.work_out(words)
            self._check(words, ids, surfaces)
            now.update(zip(part, (i if s == w.replace(SPACE, " ") else (i, s) for w, i, s in zip(words, ids, surfaces, strict=True)), strict=True))

    def _check(self, words: list[str], ids: list[str], surfaces: list[str]) -> None:
        """Hold words against the library: those with a mark as the words of one text, the others
        as the lines of one; nothing but marks as a text of its own. The library puts one mark
        before any text."""
        marked, bare, blank = [], [], []
        for k, word in enumerate(words):
            (bare if not word.startswith(SPACE) else marked if word.strip(SPACE) else blank).append(k)
        sp, text_of = self.model.library, self.model.text_of
        head = "".join(f"{i}," for i in sp.encode("\n"))  # ends with the ids of the line feed
        head = head.removesuffix(f"{self.feed},")
        for part, lead in ((marked, ""), (bare, "\n"), *(([k], "") for k in blank if words[k] != SPACE)):
            if not part:
                continue
            known = sp.encode("".join(lead + words[k] for k in part).replace(SPACE, " ")[0 if lead else 1 :])
            ours = head + ",".join(f"{self.feed},{ids[k]}" for k in part) if lead else ",".join([ids[k] for k in part])
            said = "".join(lead + surfaces[k] for k in part)
            if ours != ",".join(map(text_of.__getitem__, known)) or sp.decode(known) != (said if lead else said.removeprefix(" ")):
                raise ValueError(f"encoding differs from the library's among {len(part)} words from {words[part[0]]!r} on")

    def check_text(self, text: str, joined: str, surface: str) -> None:
        ids = self.model.library.encode(text)
        if joined != ",".join(map(str, ids)) or surface != (self.model.library.decode(ids) if ids else ""):
            raise ValueError(f"encoding differs from the library's for a text of {len(text)} characters that starts with {text[:50]!r}")

    def encoded(self, lines: list[list[str]]) -> tuple[str, str]:
        """Ids joined by commas, and decoded text, of lines of keys that are all in ``now``."""
        ids, texts = [], []
        get = self.now.__getitem__
        for k, line in enumerate(lines):
            if k:
                ids.append(self.feed)
                texts.append("\n")
            if not line:
                continue
            found = list(map(get, line))
            try:
                ids.append(",".join(found))
                if line[0].startswith(_AS_IS):
                    texts.append(line[0][1:])
                    line = line[1:]
                    if line and line[0].startswith(_AS_IS):
                        texts.append("".join(line).replace(_AS_IS, ""))
                        line = []
                if line:
                    texts.append(SPACE)
                    texts.append(SPACE.join(line))
            except TypeError:  # some surface is another than its word
                ids.append(",".join(x if isinstance(x, str) else x[0] for x in found))
                texts.extend((w[1:] if w.startswith(_AS_IS) else SPACE + w) if isinstance(x, str) else x[1] for w, x in zip(line, found, strict=True))
        return ",".join(ids), "".join(texts).replace(SPACE, " ").removeprefix(" ")


def _lines(model: PieceModel, text: str) -> list[list[str]]:
    """For each line the keys to look up. Words that single spaces part are keys as they stand,
    but for a first one without a mark; else a line is cut before each run of marks."""
    if not text:
        return []
    if not model.by_line:
        marked = SPACE + text.replace(" ", SPACE)
        return [[_AS_IS + x for x in (_CUT.findall(marked) if model.by_word else [marked])]]
    out = []
    plain = not (text.startswith(" ") or text.endswith(" ") or "  " in text or " \n" in text or SPACE in text)
    if plain:
        for k, line in enumerate(text.split("\n")):
            if not line:
                out.append([_AS_IS + SPACE] if not k else [])
            elif not k:
                out.append(line.split(" "))
            else:
                first, *rest = line.split(" ")
                out.append([_AS_IS + first, *rest] if first else rest)
    else:
        for line in (SPACE + text.replace(" ", SPACE)).split("\n"):
            out.append([_AS_IS + x for x in _CUT.findall(line)])
    return out


def encode_partition(batches, model_file: str):
    words = worker_keeps(("pieces", model_file), lambda: _Words(PieceModel(model_file), CACHE_WORDS))
    for batch in slices(batches, "text"):
        texts = [x or "" for x in batch.column("text").to_pylist()]
        lines = [_lines(words.model, text) for text in texts]
        words.prepare(set().union(*(line for of in lines for line in of)))
        n_out, ids_sha, text_sha, checked = [], [], [], False
        for text, of in zip(texts, lines, strict=True):
            joined, surface = words.encoded(of)
            if text and not checked and len(text) <= CHECK_CHARS:
                words.check_text(text, joined, surface)
                checked = True
            n_out.append(joined.count(",") + 1 if joined else 0)
            ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
            text_sha.append(hashlib.sha256(surface.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_out, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no ids, and both digests are those of the empty string. Rows
    repeat as they do in ``docs``; other columns are not carried, so their names can't clash.
    Texts of any length are encoded whole. ``model_file`` must be readable on every executor
    (part of the installed environment).
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: encode_partition(batches, model_file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
