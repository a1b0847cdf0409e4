"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on trusted text: documents labelled as of good quality and not toxic. An
n-gram is the number that its five characters' classes make up (a class is a byte: ASCII
characters as they are, all others hashed into the upper half). A task counts its documents'
n-grams and emits each count once; Spark adds the counts up and works out continuation counts,
discounts, backoff weights and interpolated probabilities of all orders by joins and aggregates.

The model grows with the corpus, so it is never held as a whole. All longer n-grams by which a
character is judged agree in the two characters before it: their tables are sharded by that, into
as many shards as make ``SHARD_ENTRIES`` entries each; unigrams and bigrams (65,792 at most) are
part of every shard. Shard by shard, the table is broadcast for one pass over the documents that
gives every document's partial sum of logarithms, the sums are checkpointed and the broadcast is
destroyed, so that the driver holds one shard at a time. Two characters can't have more than
256**3 entries, whatever the size of the corpus. The sums are added up by document. A document stays
when its perplexity is at most its language's threshold: that quantile of the perplexities of
trusted documents that the model has not seen which best parts them from documents labelled as
poor or toxic.
"""

from __future__ import annotations

import math
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import durable, slices, worker_keeps

ORDER = 5
CLASSES = 256
#: Mean number of entries of the probability and backoff tables that are broadcast at once.
SHARD_ENTRIES = 4_000_000
#: The loosest quantile of trusted documents; in steps of ``STEP`` down to ``TIGHTEST`` others are tried.
QUANTILE = 0.99
STEP, TIGHTEST = 0.01, 0.5
#: A language's share of poor or toxic documents kept is taken of so many at least, so that a few don't set its threshold.
LEAST_POOR = 10
#: Accuracy of the quantiles' sketch: their rank is off by at most one in so many.
ACCURACY = 10_000
#: Labels that are broadcast to find the trusted documents; beyond that they are joined by shuffle.
BROADCAST_LABELS = 1_000_000
GO_CHARS = 1 << 18
#: Of so many folds of the trusted documents one sets the thresholds; the others train the model.
FOLDS = 5
NO_LANGUAGE = "und"
_MASKS = [(1 << (8 * k)) - 1 for k in range(ORDER + 1)]


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    mixed = (code * np.uint32(0x9E3779B1)) >> np.uint32(25)
    return np.where(code < 128, code, mixed + np.uint32(128)).astype(np.int64)


def ngrams(text: str) -> np.ndarray:
    """For each character the number of the n-gram that ends with it; the start is padded."""
    c = np.concatenate((np.full(ORDER - 1, 32, np.int64), classes(text)))
    n = len(c) - ORDER + 1
    out = np.zeros(n, np.int64)
    for k in range(ORDER):
        out = (out << 8) | c[k : k + n]
    return out


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, n = np.concatenate(codes), np.concatenate(counts)
    values, place = np.unique(every, return_inverse=True)
    return values, np.bincount(place, n).astype(np.int64)


def _count_partition(batches):
    held, held_n, go, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add():
        nonlocal held, held_n, go, size
        if go:
            values, n = np.unique(np.concatenate(go), return_counts=True)
            held, held_n = _merge([held, values], [held_n, n])
            go, size = [], 0

    worker_keeps(("counts",), lambda: None)
    for batch in slices(batches, "text"):
        for text in batch.column("text"):
            go.append(ngrams(text.as_py()))
            size += len(go[-1])
            if size >= 4 * GO_CHARS:
                add()
    add()
    for at in range(0, len(held), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(held[at : at + (1 << 16)]), pa.array(held_n[at : at + (1 << 16)])], names=["code", "n"])


def count_ngrams(docs: DataFrame) -> DataFrame:
    """code, n: how often each n-gram of the highest order occurs in the texts."""
    return docs.where("text is not null").select("text").mapInArrow(_count_partition, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from the numbers of n-grams that occur once to four times."""
    n = [float(x) for x in table.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
    return [min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 for k in (1, 2, 3)]


def train(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables (code, p) and (code, gamma) of the orders 1 to ``ORDER``.

    In the highest order n is a count; below, it is the number of different characters before.
    """
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):
        levels.append(durable(levels[-1].groupBy(F.col("code").bitwiseAND(F.lit(_MASKS[k]).cast("long")).alias("code")).agg(F.count("*").alias("n"))))
    probabilities: list[DataFrame] = []
    backoffs: list[DataFrame] = []
    for k, table in enumerate(reversed(levels), start=1):
        d = _discounts(table)
        taken = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        table = table.withColumn("context", F.shiftright("code", 8))
        contexts = durable(
            table.groupBy("context").agg(F.sum("n").alias("total"), F.sum(taken).alias("mass")).select("context", F.col("total").cast("double").alias("total"), (F.col("mass") / F.col("total")).alias("gamma"))
        )
        table = table.join(contexts, "context")
        own = F.greatest(F.col("n") - taken, F.lit(0.0)) / F.col("total")
        if k == 1:
            table = table.select("code", (own + F.col("gamma") / CLASSES).alias("p"))
        else:
            lower = probabilities[-1].select(F.col("code").alias("suffix"), F.col("p").alias("lower"))
            suffix = F.col("code").bitwiseAND(F.lit(_MASKS[k - 1]).cast("long"))
            table = table.withColumn("suffix", suffix).join(lower, "suffix").select("code", (own + F.col("gamma") * F.col("lower")).alias("p"))
        probabilities.append(durable(table))
        backoffs.append(contexts.select(F.col("context").alias("code"), "gamma"))
    return probabilities, backoffs


class _Table:
    """Numbers by sorted code; most are found by one look into a table of places."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        order = np.argsort(codes, kind="stable")
        self.codes, self.values = codes[order], values[order]
        self.bits = max(8, int(len(codes) * 4).bit_length())
        self.places = np.zeros(1 << self.bits, np.int32)
        self.places[self._slot(self.codes)] = np.arange(len(codes))

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Values, nan where the code is unknown."""
        if not len(self.codes):
            return np.full(len(codes), np.nan)
        at = self.places[self._slot(codes)]
        out = np.where(self.codes[at] == codes, self.values[at], np.nan)
        rest = np.flatnonzero(np.isnan(out))
        at = np.minimum(np.searchsorted(self.codes, codes[rest]), len(self.codes) - 1)
        out[rest] = np.where(self.codes[at] == codes[rest], self.values[at], np.nan)
        return out


class _Shard:
    def __init__(self, p: list[tuple[np.ndarray, np.ndarray]], gamma: list[tuple[np.ndarray, np.ndarray]], number: int, shards: int):
        self.p, self.gamma = [_Table(*x) for x in p], [_Table(*x) for x in gamma]
        self.of = _shard_of(np.arange(CLASSES * CLASSES), shards) == number

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities of the n-grams' last characters, backing off as needed."""
        out, weight, open_ = np.zeros(len(codes)), np.zeros(len(codes)), np.arange(len(codes))
        for k in range(ORDER, 0, -1):
            part = codes[open_] & _MASKS[k]
            p = self.p[k - 1].find(part)
            seen = ~np.isnan(p)
            out[open_[seen]] = np.log(p[seen]) + weight[open_[seen]]
            open_, part = open_[~seen], part[~seen]
            if not len(open_):
                return out
            gamma = self.gamma[k - 1].find(part >> 8)
            weight[open_] += np.where(np.isnan(gamma), 0.0, np.log(np.maximum(gamma, 1e-12)))
        out[open_] = weight[open_] - np.log(CLASSES)
        return out


def _score_partition(batches, name, shard):
    mine = worker_keeps(("shard", name), lambda: _Shard(*shard.value))
    for batch in slices(batches, "text"):
        texts = batch.column("text")
        sums, n, go, rows, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64), [], [], 0
        for i, text in enumerate(texts):
            text = text.as_py()
            if text:
                codes = ngrams(text)
                codes = codes[mine.of[(codes >> 8) & _MASKS[2]]]
                go.append(codes)
                rows.append(i)
                n[i] = len(codes)
                size += len(codes)
            if go and (size >= GO_CHARS or i == len(texts) - 1):
                logs = mine.logs(np.concatenate(go))
                sums[rows] = np.bincount(np.repeat(np.arange(len(go)), [len(x) for x in go]), logs, len(go))
                go, rows, size = [], [], 0
        if go:
            logs = mine.logs(np.concatenate(go))
            sums[rows] = np.bincount(np.repeat(np.arange(len(go)), [len(x) for x in go]), logs, len(go))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), batch.column("text_hash"), pa.array(sums), pa.array(n)], names=["doc_id", "lang", "text_hash", "logs", "n"]
        )


def _shard_of(pair, shards: int):
    """The shard of two characters (a number, or a column of numbers): a multiplicative hash."""
    if isinstance(pair, Column):
        return F.pmod(F.shiftright(pair * 40_503, 4).bitwiseAND(F.lit(0xFFFF).cast("long")), F.lit(shards))
    return ((pair * 40_503 >> 4) & 0xFFFF) % shards


def _collected(table: DataFrame, value: str, pair: Column | None, number: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    got = (table if pair is None else table.where(_shard_of(pair, shards) == number)).select("code", value).toArrow()
    return got.column("code").to_numpy(), got.column(value).to_numpy()


def log_sums(docs: DataFrame, probabilities: list[DataFrame], backoffs: list[DataFrame]) -> DataFrame:
    """doc_id, lang, text_hash, logs, n for each document and shard of the model."""
    two = F.lit(_MASKS[2]).cast("long")
    before, last = F.shiftright("code", 8).bitwiseAND(two), F.col("code").bitwiseAND(two)
    total = sum(table.count() for table in probabilities[2:] + backoffs[2:])
    shards = max(1, math.ceil(total / SHARD_ENTRIES))
    sc, out = docs.sparkSession.sparkContext, None
    for number in range(shards):
        p = [_collected(probabilities[k], "p", before if k > 1 else None, number, shards) for k in range(ORDER)]
        gamma = [_collected(backoffs[k], "gamma", last if k > 1 else None, number, shards) for k in range(ORDER)]
        sent = sc.broadcast((p, gamma, number, shards))
        part = durable(docs.mapInArrow(partial(_score_partition, name=uuid.uuid4().hex, shard=sent), "doc_id long, lang string, text_hash long, logs double, n long"))
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _thresholds(known: DataFrame, keys: list[str], quantile: float) -> DataFrame:
    """keys, cut: of the quantiles of the good documents' perplexities the one that keeps the most
    of the good less what it keeps of the others (as shares); the loosest where several do."""
    steps = max(0, round((quantile - TIGHTEST) / STEP))
    grid = [quantile - STEP * k for k in range(steps, -1, -1)]
    cuts = known.where("good").groupBy(*keys).agg(F.percentile_approx("perplexity", grid, ACCURACY).alias("cuts"))
    held = known.join(F.broadcast(cuts), keys) if keys else known.crossJoin(F.broadcast(cuts))
    held = held.where("cuts is not null").withColumn("place", F.size(F.filter("cuts", lambda c: c < F.col("perplexity"))))
    by_place = held.groupBy(*keys, "place", "cuts").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("poor"))
    every = Window.partitionBy(*keys)
    upto = every.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gain = F.sum("good").over(upto) / F.sum("good").over(every) - F.sum("poor").over(upto) / F.greatest(F.sum("poor").over(every), F.lit(LEAST_POOR))
    tried = by_place.withColumn("gain", gain).where(F.col("place") < len(grid))
    return tried.groupBy(*keys).agg(F.max_by("cuts", F.struct("gain", "place")).alias("cuts"), F.max(F.struct("gain", "place"))["place"].alias("place")).select(*keys, F.get("cuts", "place").alias("cut"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row for each row of ``docs`` (rows equal in doc_id, lang and text count as one): doc_id,
    lang, perplexity, threshold, keep.

    Trusted are documents with a label of quality 1 and none of toxic 1; those of any other label
    of quality or toxicity are not good. The thresholds are quantiles of at most ``quantile``, chosen on
    the documents of one fold. A null or empty text has no perplexity and is not kept. A null
    language counts as ``und``. A language without trusted documents to test on takes the threshold of all
    languages together; without any trusted text there is no threshold, and every document with text
    is kept. Other columns are not read.
    """
    typed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("string").alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    marks = durable(marks.where("q is not null or t is not null").select("doc_id", F.expr("coalesce(q, 0) = 1 and coalesce(t, 0) <> 1").alias("good")))
    good = marks.where("good").select("doc_id")
    few = good.count() <= BROADCAST_LABELS
    test = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0
    trusted = typed.where(~test).join(F.broadcast(good) if few else good, "doc_id", "left_semi")
    probabilities, backoffs = train(durable(count_ngrams(trusted)))

    scores = (
        log_sums(typed, probabilities, backoffs)
        .groupBy("doc_id", "lang", "text_hash")
        .agg(F.sum("logs").alias("logs"), F.sum("n").alias("n"))
    )
    scores = durable(scores.select("doc_id", "lang", F.when(F.col("n") > 0, F.round(F.exp(-F.col("logs") / F.col("n")), 6)).alias("perplexity")))
    known = durable(scores.where("perplexity is not null").where(test).join(marks, "doc_id"))
    by_lang = _thresholds(known, ["lang"], quantile).withColumnRenamed("cut", "own")
    overall = _thresholds(known, [], quantile).agg(F.max("cut").alias("overall"))
    threshold = F.coalesce("own", "overall")
    return (
        scores.join(F.broadcast(by_lang), "lang", "left")
        .crossJoin(F.broadcast(overall))
        .select("doc_id", "lang", "perplexity", threshold.alias("threshold"), (F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))).alias("keep"))
    )
