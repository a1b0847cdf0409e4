"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents with the same set of shingles are one node. Nodes that agree in a band of their MinHash
values are candidates. The candidates' components are found first: small components share bins
and send each text once, and the nodes of a large one are dealt into blocks of at most ``BLOCK``
nodes and about ``BLOCK_BYTES`` of text, each pair of blocks being one task, so that a text of a
component of n nodes is sent n / ``BLOCK`` times. There, candidate pairs compare their MinHash values
bit by bit of the signature: after each chunk a pair is dropped when the posterior probability
that its similarity reaches the threshold, given the matches so far and a uniform prior, is below
the tolerance. What is left is verified by the exact similarity of the shingle sets.

A task gives one row for each node it saw (its links, and the smallest node it is linked with,
directly or not), never a row for each pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import durable, slices, with_totals, worker_keeps
from lattica.llm.components import components
from lattica.llm.shingles import MinHash, fingerprint, shingle_sets

THRESHOLD = 0.8
#: A pair at the threshold agrees in none of the bands with a probability of 5e-6.
BANDS, ROWS = 40, 6
#: MinHash values compared between two looks at the posterior.
CHUNK = 24
TOLERANCE = 1e-7
#: Nodes and bytes of text of one block of a large component, or of a bin of small ones.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Components of up to so many nodes are compared together with others of their bin.
SMALL = 64
#: Rows of a block that are compared with all of the other at once.
PAIR_ROWS = 128
#: Bytes of bits that are held, and compared in one go, when pairs are verified.
BIT_BYTES = 8 << 20
#: Nodes whose rows are so many that no more nodes can have as many.
HOT_NODES = 4096
#: Stands for a null doc_id.
NO_ID = 2**63 - 1

_HASH = MinHash(BANDS, ROWS)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, total: int = BANDS * ROWS, chunk: int = CHUNK) -> list[tuple[int, int]]:
    """(values compared, fewest matches with which a pair stays).

    With m matches in n values and a uniform prior the similarity's posterior is Beta(m + 1,
    n - m + 1), and its mass above t equals the probability of at most m successes in n + 1
    trials with chance t.
    """
    out = []
    for n in range(chunk, total + 1, chunk):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    return np.stack([_HASH.signature(s) for s in sets]) if sets else np.zeros((0, BANDS * ROWS), np.uint32)


def _sketch_partition(batches):
    worker_keeps(("jaccard",), lambda: None)
    for batch in slices(batches, "text"):
        sets = shingle_sets(batch.column("text").to_pylist())
        full = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        for at in range(0, len(full), 256):
            part = full[at : at + 256]
            for i, row in zip(part, _HASH.keys(_signatures([sets[i] for i in part])), strict=True):
                keys[i] = row
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64()),
                pc.binary_length(batch.column("text")).cast(pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            names=["doc_id", "text_hash", "node", "n_bytes", "keys"],
        )


def prune(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose posterior stays above the tolerance to the end."""
    matches = np.zeros(len(i), np.int32)
    for n, least in least_matches():
        if not len(i):
            break
        matches += (sig[i, n - CHUNK : n] == sig[j, n - CHUNK : n]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        i, j, matches = i[stay], j[stay], matches[stay]
    return i, j


class Exact:
    """Exact similarities of pairs out of ``sets``, by bits of the shingles that two sets or more have."""

    def __init__(self, sets: list[np.ndarray], threshold: float = THRESHOLD):
        self.sizes, self.threshold = np.array([len(s) for s in sets], np.int64), threshold
        values, inverse, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        shared = n > 1  # a shingle of one set alone is common to no pair
        keep = shared[inverse]
        self.row = np.repeat(np.arange(len(sets)), self.sizes)[keep]
        self.column = (np.cumsum(shared) - 1)[inverse[keep]]
        self.width = int(shared.sum())
        self.step = max(64, BIT_BYTES * 8 // max(1, len(sets)) // 64 * 64)
        self.held = self._words(0) if self.width <= self.step else None

    def _words(self, at: int) -> np.ndarray:
        """The sets' bits of ``step`` columns from ``at`` on, in rows of words."""
        width = (min(self.step, self.width - at) + 63) // 64 * 8
        out = np.zeros(len(self.sizes) * width, np.uint8)
        now = (self.column >= at) & (self.column < at + self.step)
        column = self.column[now] - at
        place = self.row[now] * width + (column >> 3)  # rows and their columns are in order
        if len(place):
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            out[place[first]] = np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (column & 7).astype(np.uint8)), first)
        return out.reshape(len(self.sizes), width).view(np.uint64)

    def reached(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether each pair's similarity reaches the threshold."""
        common = np.zeros(len(i), np.int64)
        for at in range(0, self.width if len(i) else 0, self.step):
            words = self.held if self.held is not None else self._words(at)
            step = max(1, BIT_BYTES // 8 // max(1, words.shape[1]))
            for k in range(0, len(i), step):
                common[k : k + step] += np.bitwise_count(words[i[k : k + step]] & words[j[k : k + step]]).sum(axis=1, dtype=np.int64)
        return common >= self.threshold * (self.sizes[i] + self.sizes[j] - common) - 1e-9


def _bucket_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of rows that agree in a band, where few rows do."""
    codes = []
    n = len(keys)
    for band in range(keys.shape[1]):
        order = np.argsort(keys[:, band], kind="stable")
        k = keys[order, band]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        for start, end in zip(first, [*first[1:], n], strict=True):
            if end - start > 1:
                own = np.sort(order[start:end])
                a, b = np.triu_indices(end - start, 1)
                codes.append(own[a] * n + own[b])
    code = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
    return code // n, code % n


def _block_pairs(keys: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Pairs of a row of ``left`` and a greater or foreign one of ``right`` that agree in a band,
    for some rows of ``left`` at a time."""
    same = left is right
    for at in range(0, len(left), PAIR_ROWS):
        part = left[at : at + PAIR_ROWS]
        agree = np.zeros((len(part), len(right)), bool)
        for band in range(keys.shape[1]):
            agree |= keys[part, band][:, None] == keys[right, band][None, :]
        i, j = np.nonzero(np.triu(agree, at + 1) if same else agree)
        yield part[i], right[j]


class _Union:
    """Classes of the numbers below n, each named by its smallest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def _top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self._top(x), self._top(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def labels(self) -> np.ndarray:
        return np.array([self._top(x) for x in range(len(self.up))], np.int64)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        n = len(self.up)
        low = np.arange(n)
        np.minimum.at(low, i, j)
        np.minimum.at(low, j, i)
        moved = np.flatnonzero(low < np.arange(n))
        self._join(moved, low[moved])
        name = self.labels()
        a, b = name[i], name[j]
        code = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
        self._join(code // n, code % n)


_FOUND = pa.schema([("node", pa.int64()), ("to", pa.int64()), ("links", pa.int64()), ("split", pa.bool_())])


def _candidates(keys: np.ndarray, comp: np.ndarray):
    """Pairs of rows that agree in a band, by component; those of small components together."""
    order = np.argsort(comp, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], comp[order][1:] != comp[order][:-1])))
    parts = np.split(order, first[1:])
    small = np.sort(np.concatenate([np.zeros(0, np.int64), *(x for x in parts if len(x) <= SMALL)]).astype(np.int64))
    i, j = _bucket_pairs(keys[small])
    yield small[i], small[j]
    for part in parts:
        if len(part) > SMALL:
            own = np.sort(part)
            yield from _block_pairs(keys, own, own)


def _join_group(table: pa.Table) -> pa.Table:
    """Verified links within a bin, or between the two blocks of a large component."""
    worker_keeps(("jaccard",), lambda: None)
    nodes, mult, block, comp = table.column("node").to_pylist(), table.column("mult").to_numpy(), table.column("block").to_numpy(), table.column("comp").to_numpy()
    sets = []
    for batch in slices(table.select(["text"]).combine_chunks().to_batches(), "text"):
        sets.extend(shingle_sets(batch.column("text").to_pylist()))
    seen: dict[int, int] = {}
    for k, (node, s) in enumerate(zip(nodes, sets, strict=True)):
        if fingerprint(s) == node:  # rows may repeat, and texts may share a doc_id
            seen.setdefault(node, k)
    order = [seen[x] for x in sorted(seen)]
    sets, nodes, mult, block, comp = [sets[k] for k in order], sorted(seen), mult[order], block[order], comp[order]
    if not nodes:
        return _FOUND.empty_table()
    sig = _signatures(sets)
    keys, exact, classes = _HASH.keys(sig), Exact(sets), _Union(len(nodes))
    split = bool(table.column("blocks")[0].as_py() > 1)
    if split:
        pair = table.column("pair")[0].as_py()
        left, right = np.flatnonzero(block == pair // (1 << 31)), np.flatnonzero(block == pair % (1 << 31))
        found = _block_pairs(keys, left, left if pair // (1 << 31) == pair % (1 << 31) else right)
    else:
        found = _candidates(keys, comp)
    links = np.zeros(len(nodes))
    for i, j in found:
        i, j = prune(sig, i, j)
        real = exact.reached(i, j)
        i, j = i[real], j[real]
        links += np.bincount(i, mult[j], len(nodes)) + np.bincount(j, mult[i], len(nodes))
        classes.link(i, j)
    to = classes.labels().tolist()
    return pa.table([pa.array(nodes, pa.int64()), pa.array([nodes[x] for x in to], pa.int64()), pa.array(links.astype(np.int64)), pa.array([split] * len(nodes))], schema=_FOUND)


def _members(nodes: DataFrame, comps: DataFrame, rows: int) -> DataFrame:
    """doc_id, text_hash, node, mult, comp, bin, blocks, block: where the text of each node of a
    component is to go.

    A component of more than ``BLOCK`` nodes or ``BLOCK_BYTES`` of text is dealt into blocks;
    smaller ones share bins of about that size.
    """
    placed = comps.join(nodes.select("node", "mult", "first.*"), "node").withColumnRenamed("root", "comp")
    placed = durable(with_totals(placed, "comp", "node", {"size": F.count("*"), "bytes": F.sum("n_bytes")}), rows)
    wanted = F.least("size", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)))
    placed = placed.withColumn("blocks", wanted.cast("long"))
    total = placed.where("blocks = 1").agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    bins = max(1, math.ceil(total[0] / BLOCK), math.ceil(total[1] / BLOCK_BYTES))
    whole = F.col("blocks") == 1
    return placed.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text_hash", "node", "mult", "comp", "blocks",
        F.when(whole, F.pmod(F.xxhash64("comp"), F.lit(bins))).otherwise(F.col("comp")).alias("bin"),
        F.when(whole, F.lit(0)).otherwise(F.pmod(F.xxhash64("node", F.lit(3)), "blocks")).cast("long").alias("block"),
    )


def _texts(typed: DataFrame, members: DataFrame, repeated: bool) -> DataFrame:
    """The members with their texts: one row for each, but where a hash has several texts."""
    key = ["doc_id", "text_hash"]
    rows = typed.where("doc_id is not null").select(*key, "text").join(members.where("doc_id is not null"), key)
    if repeated:
        rows = rows.dropDuplicates([*key, "node"])
    loose = members.where("doc_id is null")
    if not loose.isEmpty():
        texts = typed.where("doc_id is null and text is not null").select("text_hash", "text").dropDuplicates(["text_hash"])
        rows = rows.unionByName(texts.join(loose, "text_hash").select(*rows.columns))
    return rows


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, text_hash, is_first.

    Two documents are linked when their sets of five-word shingles have a Jaccard similarity of
    0.8 or more; equal texts are. ``n_links`` counts the other documents a document is linked
    with; ``class_id`` is the smallest doc_id of its class, the documents linked with it directly
    or through others; ``is_first`` marks the rows that have that doc_id, and among those of one
    class with different texts the one with the least ``text_hash`` (xxhash64 of the text).
    Texts that are null or hold no word have no links, and class_id is their own doc_id (a null
    doc_id stays null). Rows without a doc_id are compared and counted like all others. Only
    doc_id and text are read, so other columns' names can't clash. An empty table gives no rows.
    """
    return _classes(docs)[0]


def _classes(docs: DataFrame) -> tuple[DataFrame, int]:
    """``jaccard_classes``, and the number of its rows."""
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    sketches = durable(typed.mapInArrow(_sketch_partition, "doc_id long, text_hash long, node long, n_bytes long, keys array<long>"))
    rows = sketches.count()
    nodes = durable(
        sketches.where("node is not null")
        .groupBy("node")
        .agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text_hash", "n_bytes")).alias("first"), F.count("*").alias("mult"), F.first("keys").alias("keys")),
        rows,
    )
    bands = nodes.select("node", F.explode("keys").alias("key"))
    linked = with_totals(bands, "key", "node", {"hub": F.min("node"), "n": F.count("*")}, F.col("n") > 1)
    comps = durable(components(linked.select(F.col("node").alias("a"), F.col("hub").alias("b")), rows), rows)
    repeated = not sketches.where("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    sent = (
        _texts(typed, _members(nodes, comps, rows), repeated)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("text", "node", "mult", "comp", "bin", "blocks", "block", (F.least("block", "other") * (1 << 31) + F.greatest("block", "other")).alias("pair"))
    )
    found = durable(sent.groupBy("bin", "blocks", "pair").applyInArrow(_join_group, "node long, `to` long, links long, split boolean"), rows, waves=4)
    across = components(found.where("split and node <> `to`").select(F.col("node").alias("a"), F.col("to").alias("b")), rows)
    roots = found.where("not split").select("node", F.col("to").alias("root")).unionByName(across)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = (
        nodes.select("node", F.struct("first.doc_id", "first.text_hash").alias("first"), "mult")
        .join(roots, "node", "left")
        .join(links, "node", "left")
        .select("node", "first", "mult", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    )
    whole = with_totals(whole, "root", "node", {"class_first": F.min("first")})
    whole = durable(whole.select("node", "class_first", "n_links", "mult"), rows)
    known = sketches.select("doc_id", "text_hash", "node")
    # a node may have most of the rows: those of at most ``HOT_NODES`` nodes meet their class by broadcast
    least = max(2, math.ceil(rows / HOT_NODES))
    hot, rest = (whole.where(c).drop("mult") for c in (F.col("mult") >= least, F.col("mult") < least))
    classed = (
        known.join(F.broadcast(hot), "node")
        .unionByName(known.where("node is not null").join(F.broadcast(hot.select("node")), "node", "left_anti").join(rest, "node"))
        .unionByName(known.where("node is null"), allowMissingColumns=True)
    )
    same = (F.col("doc_id") == F.col("class_first.doc_id")) & (F.col("text_hash") == F.col("class_first.text_hash"))
    out = classed.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_first.doc_id", "doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "text_hash",
        F.coalesce(same, F.lit(True)).alias("is_first"),
    )
    return out, rows


def first_of_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one for each class stays: the one
    with the smallest doc_id. Rows that repeat exactly in doc_id and text count as one. Rows
    without a doc_id stay."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")  # apart from the helpers' names
    hashed = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    classes, n = _classes(docs)
    rows = durable(classes.where("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.bool_or("is_first").alias("stays"), F.count("*").alias("n")), n)
    gone = rows.where("not stays").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    kept = hashed.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left_anti")
    if not rows.where("stays and n > 1").isEmpty():
        named = kept.where("id is not null").dropDuplicates(["id", "hash"])
        kept = named.unionByName(kept.where("id is null"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
