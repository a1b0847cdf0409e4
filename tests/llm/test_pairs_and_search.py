"""Jaccard join, decontamination, top-k search and sharding against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lattica.llm import decontaminate, jaccard, shards, topk
from lattica.llm.components import components


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: (least[top(i)], links[i]) for i, (d, _) in enumerate(rows)}


def near_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_against_brute_force(spark, monkeypatch):
    texts = near_copies(80, 60, 3, 1) + near_copies(20, 200, 8, 2) + [f"only {i} text of its own kind here" for i in range(20)] + ["same words in both"] * 6 + [None, "", "  "]
    rows = list(enumerate(texts, start=10))
    random.Random(3).shuffle(rows)
    want = brute_classes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == want
    monkeypatch.setattr(jaccard, "SMALL", 4)  # some components are then compared by themselves
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == want
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # the large component is then dealt into blocks
    monkeypatch.setattr(jaccard, "PAIR_ROWS", 5)
    monkeypatch.setattr(jaccard, "BIT_BYTES", 64)  # and its bits are made part by part
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == want


def test_jaccard_edge_cases(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (2, None, None), (3, "z" * 50_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in jaccard.jaccard_classes(docs).collect())
    assert got == [(0, 0, 2), (1, 1, 2), (1, 1, 2), (2, 2, 0), (3, 3, 0)]
    kept = jaccard.first_of_class(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "None"]
    assert jaccard.jaccard_classes(docs.limit(0)).count() == 0


def test_rows_without_id_are_linked(spark):
    near = near_copies(3, 120, 3, 4)
    rows = [(1, near[0]), (None, near[1]), (None, near[2]), (None, near[2]), (None, "a b c d e f g"), (None, "a b c d e f g")] + [(7, f"{near[0]} end")] * 2
    out = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_classes([(i, t) for i, (_, t) in enumerate(rows)])
    assert Counter((r["doc_id"], r["n_links"]) for r in out) == Counter((d, want[i][1]) for i, (d, _) in enumerate(rows))
    assert {r["class_id"] for r in out if r["doc_id"]} == {1}


def test_exact_similarities_by_parts(monkeypatch):
    rng = random.Random(4)
    sets = [np.unique(np.array([rng.randrange(300) for _ in range(rng.randrange(1, 200))], np.uint64)) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    want = [len(set(sets[a]) & set(sets[b])) >= 0.3 * len(set(sets[a]) | set(sets[b])) for a, b in zip(i, j, strict=True)]
    assert jaccard.Exact(sets, 0.3).reached(i, j).tolist() == want
    monkeypatch.setattr(jaccard, "BIT_BYTES", 400)
    assert jaccard.Exact(sets, 0.3).held is None and jaccard.Exact(sets, 0.3).reached(i, j).tolist() == want


def test_posterior_bounds_grow():
    bounds = jaccard.least_matches()
    assert [n for n, _ in bounds] == list(range(24, 241, 24)) and all(a[1] < b[1] for a, b in zip(bounds, bounds[1:], strict=False))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(200, 100 + i) for i in range(30)] + [(5, 5)] + [(1000, 1001 + i) for i in range(500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[200] == 100
    assert {got[1000 + i] for i in range(501)} == {1000}


def levenshtein(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_within_the_budget_are_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 40))).capitalize() + ".") for i in range(12)] + [(50, None), (51, "too short")]
    index = decontaminate.Index([(i, t) for i, t in items if t])
    docs, want = [], {}
    for d in range(60):
        body = " ".join(word() for _ in range(80))
        if d % 2:
            k = rng.randrange(len(index.items))
            codes = index.items[k][1]
            w = rng.choice(index.windows(k))
            part = [chr(c) for c in codes[w : w + decontaminate.WINDOW]]
            for _ in range(int(index.edits[k])):
                place = rng.randrange(len(part))
                part[place] = rng.choice(["", "q", part[place] + "k"])
            body = body[:100] + " " + "".join(part) + " " + body[100:]
            want[d] = index.items[k][0]
        docs.append((d, body, 1))
    docs += [(100, None, 1), (101, "", 1), (102, items[0][1].upper().replace(" ", "\n \t"), 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame, bench).collect()}
    assert {(d, i) for d, i in want.items()} <= got and (102, 0) in got
    normal = {i: decontaminate.normalise(t) for i, t in items if t}
    for d, i in got - set(want.items()) - {(102, 0)}:
        raise AssertionError((d, i, levenshtein(normal[i][:96], decontaminate.normalise(docs[d][1]))))
    clean = decontaminate.without_leaks(frame, bench)
    assert clean.columns == frame.columns and {r["doc_id"] for r in clean.collect()} == {d for d, _, _ in docs} - set(want) - {102}
    assert decontaminate.find_leaks(frame, bench.limit(0)).count() == 0 and decontaminate.find_leaks(frame.limit(0), bench).count() == 0


def test_passages_are_found_at_every_offset():
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    item = decontaminate.normalise(noise(400))
    index = decontaminate.Index([(7, item)])
    size = decontaminate.WINDOW
    texts = [f"{noise(200)} {item[w : w + size]} {noise(200)}" for w in range(len(item) - size + 1)]
    texts += [f"{item[w : w + size]} {noise(50)}" for w in range(0, 300, 7)] + [noise(50) + item[w : w + size] for w in range(0, 300, 7)]
    assert {t for t, *_ in index.search(texts)} == set(range(len(texts)))
    assert not index.search([f"{noise(100)} {item[w : w + 60]} {noise(100)}" for w in range(0, 300, 11)])


def brute_leaks(items, texts):
    """(text, item) for each pair of which some window of the item is in the text within its budget."""
    out = set()
    for k, item in items:
        item = decontaminate.normalise(item)
        if not item:
            continue
        e, size = decontaminate.edits_allowed(len(item)), min(len(item), decontaminate.WINDOW)
        for t, text in enumerate(texts):
            text = decontaminate.normalise(text)
            if not e:
                here = f" {item} " in f" {text} " if len(item) + 2 >= decontaminate.Q else item == text
            else:
                here = any(levenshtein(item[w : w + size], text) <= e for w in range(len(item) - size + 1))
            if here:
                out.add((t, k))
    return out


@pytest.mark.parametrize("hits", [1 << 20, 300])
def test_search_is_brute_force(monkeypatch, hits):
    monkeypatch.setattr(decontaminate, "MOST_HITS", hits)
    monkeypatch.setattr(decontaminate, "SEGMENT", 150)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(n)) for k, n in enumerate([2, 3, 4, 5, 6, 7, 9, 12, 15, 20, 28])] + [(90, "Paris"), (91, "?!"), (92, "abcd " * 12), (93, "")]
    texts = ["paris", "Paris is", "", None, "abcd " * 60, "abc"]
    for n in range(90):
        k, item = items[rng.randrange(11)]
        item = decontaminate.normalise(item)
        size = min(len(item), decontaminate.WINDOW)
        w = rng.randrange(len(item) - size + 1)
        part = list(item[w : w + size])
        for _ in range(rng.randrange(decontaminate.edits_allowed(len(item)) + 3)):
            at = rng.randrange(len(part))
            part[at] = rng.choice(["", "e", part[at] + "e"])
        texts.append(f"{prose(rng.randrange(12))} {''.join(part)} {prose(rng.randrange(12))}" if n % 5 else "".join(part))
    found = decontaminate.Index(items).search(texts)
    got = {(t, k) for t, k, *_ in found}
    want = brute_leaks(items, texts)
    assert got == want and len(found) == len(got) and len(want) > 40


@pytest.mark.parametrize("blocks", [16_384, 16])
def test_top_k_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.7]) for _ in range(4)], 0) for i in range(0, 400, 2)]
    rows += [(1, None, 0), (3, [1.0, None, 0.0, 0.0], 0), (5, [float("inf"), 0.0, 0.0, 0.0], 0), (None, [1.0] * 4, 0), (7, [1.0], 0), rows[0]]
    ints = {i: [int(256 * x // 1) for x in v] for i, v, _ in rows if i is not None and v and len(v) == 4 and None not in v and float("inf") not in v}
    want = set()
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"))
    assert {tuple(r) for r in got.collect()} == want
    large = [(i, [1000.0 * x for x in v], 0) if v else (i, v, 0) for i, v, _ in rows if v and None not in v]  # beyond two bytes
    ints = {i: [int(256 * x // 1) for x in v] for i, v, _ in large if i is not None and len(v) == 4 and float("inf") not in v}
    want = set()
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(spark.createDataFrame(large, "vec_id long, embedding array<double>, rank int")).collect()} == want
    assert topk.top_k(got.sparkSession.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_shards_are_even_and_keep_groups(spark):
    texts = ["hot"] * 300 + [f"pair {i // 2}" for i in range(100)] + [None] * 7 + [f"single {i}" for i in range(496)]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(None, "hot", 9), (0, "hot", 9)]
    out = shards.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 10).collect()
    assert len(out) == len(rows)
    sizes = Counter(r["shard"] for r in out)
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    of = {r["doc_id"]: r["shard"] for r in out}
    assert len({of[i] for i in range(300)}) <= 5  # a shard takes 90 rows
    assert sum(of[300 + 2 * i] != of[301 + 2 * i] for i in range(50)) == 0
    one = next(r for r in out if r["doc_id"] == 300)
    assert (one["size"], one["text_crc32"], one["law"], one["grown_shard"]) == (len("pair 0") + 16, zlib.crc32(b"pair 0"), "rows", None)
    assert shards.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_come_together_in_full_shards(spark):
    texts = [f"pair {i // 2}" for i in range(4000)]
    out = shards.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 10).collect()
    of = {r["doc_id"]: r["shard"] for r in out}
    sizes = Counter(of.values())
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) <= 1
    assert sum(of[2 * i] == of[2 * i + 1] for i in range(2000)) > 1800
