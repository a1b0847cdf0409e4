"""Language identification by a mixture of character n-gram models.

Each language is a smoothed distribution over hashed letter trigrams. A document is taken as
drawn from a mixture of languages: expectation-maximisation estimates the proportions from the
likelihoods of its trigrams, and the set of languages is the one with the best likelihood less
a penalty for each language (half the logarithm of the number of trigrams, and ``SET_PENALTY``).

Counts cover every training document: a task counts the trigrams of its documents and emits
each count once, and Spark adds them up. The table that comes to the driver has at most
``BUCKETS`` rows for each language, and no more than ``MOST_LANGUAGES`` are learnt, whatever the
size of the corpus and however many values the column has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import slices, worker_keeps

#: Hashed trigrams; their number bounds the model's size.
BUCKETS = 1 << 16
#: Languages that are learnt at most: those with the most texts.
MOST_LANGUAGES = 256
SMOOTHING = 0.2
EM_STEPS = 12
#: Nats that a further language must gain beyond half the logarithm of the document's length.
SET_PENALTY = 6.0
UNDETERMINED = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigram_types(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams whose middle is a letter, and how often each occurs.

    Letters are lower-cased; all else counts as one and the same break, and so do both ends.
    """
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    code = np.where(_letters()[code], code, np.uint32(32))
    mixed = code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA6B) + code[2:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    buckets = (mixed >> np.uint32(16)).astype(np.uint16)[code[1:-1] != 32]
    if not buckets.size:
        return buckets, buckets
    buckets.sort(kind="stable")
    first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    return buckets[first], np.diff(np.concatenate((first, [buckets.size]))).astype(np.float64)


def _count_partition(batches):
    worker_keeps(("language",), lambda: None)
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
            types, n = trigram_types(text.as_py())
            if types.size:
                into = counts.setdefault(lang.as_py(), np.zeros(BUCKETS))
                into[types] += n
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at].astype(np.int64))], names=["lang", "bucket", "n"]
        )


class LanguageModel:
    """``langs`` in alphabetical order and the likelihood of each bucket under each of them."""

    def __init__(self, langs: list[str], likelihood: np.ndarray):
        self.langs, self.likelihood = langs, likelihood

    @classmethod
    def learn(cls, docs: DataFrame) -> LanguageModel:
        """From the columns text and lang of ``docs``; rows where either is null are left out, and
        so are languages beyond the ``MOST_LANGUAGES`` with the most texts (ties by name)."""
        known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
        most = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()
        if len(most) > MOST_LANGUAGES:
            known = known.where(F.col("lang").isin([r["lang"] for r in most[:MOST_LANGUAGES]]))
        rows = (
            known.mapInArrow(_count_partition, "lang string, bucket int, n long")
            .groupBy("lang", "bucket")
            .agg(F.sum("n").alias("n"))
            .toArrow()
        )
        names = rows.column("lang").to_pylist()
        langs = sorted(set(names))
        counts = np.zeros((BUCKETS, len(langs)))
        place = {x: i for i, x in enumerate(langs)}
        counts[rows.column("bucket").to_numpy(), [place[x] for x in names]] = rows.column("n").to_numpy()
        counts += SMOOTHING
        return cls(langs, counts / counts.sum(axis=0)) if langs else cls([], counts)

    def mixture(self, text: str) -> dict[str, float]:
        """Proportions of the selected languages; empty where there is no letter or no model."""
        types, n = trigram_types(text)
        if not types.size or not self.langs:
            return {}
        like = self.likelihood[types]
        like = like / like.max(axis=1, keepdims=True)
        share, _ = _expect(like, n, np.full(len(self.langs), 1 / len(self.langs)), EM_STEPS)
        order = np.argsort(-share, kind="stable")
        penalty = 0.5 * np.log(n.sum()) + SET_PENALTY
        best, best_value, kept = share, -np.inf, order[:1]
        for k in range(1, len(order) + 1):
            of = order[:k]
            if k > 1 and share[of[-1]] < 0.01:
                break
            start = share[of] / share[of].sum()
            part, value = _expect(like[:, of], n, start, EM_STEPS if k > 1 else 0)
            if value - k * penalty > best_value:
                best, best_value, kept = part, value - k * penalty, of
        return {self.langs[i]: float(p) for i, p in zip(kept, best, strict=True)}

    def predict(self, text: str | None) -> tuple[str, float]:
        mix = self.mixture(text) if text else {}
        if not mix:
            return UNDETERMINED, 0.0
        lang = min(mix, key=lambda x: (-mix[x], x))
        return lang, min(1.0, max(0.0, mix[lang]))


def _expect(like: np.ndarray, n: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Proportions after ``steps`` rounds, and the logarithm of the likelihood under them."""
    total = n.sum()
    for _ in range(steps):
        new = share * ((n / (like @ share + 1e-300)) @ like) / total
        moved = np.abs(new - share).max()
        share = new / new.sum()
        if moved < 1e-4:
            break
    return share, float(n @ np.log(like @ share + 1e-300))


def held_out(fold: int = 5):
    """Whether crc32 of doc_id as text leaves no remainder; a null doc_id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == 0, F.lit(False))


def _predict_partition(batches, langs, likelihood):
    worker_keeps(("language",), lambda: None)
    model = LanguageModel(langs, likelihood)
    for batch in slices(batches, "text"):
        said = [model.predict(t.as_py()) for t in batch.column("text")]
        keep = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())],
            names=[*(x for x in batch.schema.names if x != "text"), "lang_pred", "score"],
        )


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    The model learns from rows that are not held out and whose text and lang are not null; a
    prediction sees the text alone. Null texts and texts without a letter give ``und`` and 0,
    and so does every text where there was nothing to learn from. Other columns are not carried.
    """
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = LanguageModel.learn(typed.where(~held_out() & F.col("doc_id").isNotNull()))
    langs, likelihood = model.langs, model.likelihood.astype(np.float32).astype(np.float64) if model.langs else model.likelihood
    return typed.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        lambda batches: _predict_partition(batches, langs, likelihood), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def _keep_partition(batches, langs, likelihood, least):
    worker_keeps(("language",), lambda: None)
    model = LanguageModel(langs, likelihood)
    for batch in slices(batches, "text"):
        said = [model.predict(t.as_py()) for t in batch.column("text")]
        yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in said], pa.bool_()))


def keep_identified(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is determined with a share of
    ``least_score`` or more of the text. Learns as ``identify`` does; where nothing can be learnt
    no row is kept."""
    model = LanguageModel.learn(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    langs, likelihood = model.langs, model.likelihood
    return docs.mapInArrow(lambda batches: _keep_partition(batches, langs, likelihood, least_score), docs.schema)
