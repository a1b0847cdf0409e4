"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, operator by operator."""

import random
from collections import Counter

import pytest

from lattica.llm import chat, decontaminate, html_text, jaccard, language, perplexity, pii, shards

rng = random.Random(17)
WORDS = ["river", "stone", "under", "house", "green", "walks", "seldom", "morning"]
ITEM = " ".join(rng.choice(WORDS) + str(k) for k in range(30))
LONG = " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(60_000))
CLASHING = "dk string, th string, cuts string, row string, node string, text_hash string, id string, hash string, lane string, score string, keep string, item_id string, start string, base string, perplexity string, link string, size string, n string, level string, message string"
N = CLASHING.count(",") + 1


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * N) for r in rows], f"doc_id long, text string, lang string, {CLASHING}")


ROWS = [(1, "river stone under house green walks", "en"), (1, "river stone under house green walks", "en"), (2, None, "en"), (3, "", None), (None, "morning walks seldom under the stone", None), (None, None, None), (4, LONG, "en"), (5, f"{LONG} {ITEM}", "en"), (6, " 12 34 !? ", "en")]


def test_decontamination(spark):
    docs = table(spark, [*ROWS, ROWS[7]])
    bench = spark.createDataFrame([(7, ITEM, "x"), (7, ITEM, "x"), (8, None, "x"), (None, ITEM, "x")], "item_id long, text string, doc_id string")
    got = decontaminate.find_leaks(docs, bench).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == {(5, 7): 4, (5, None): 2}  # repeated rows on both sides
    clean = decontaminate.without_leaks(docs, bench)
    assert clean.columns == docs.columns and Counter(r["doc_id"] for r in clean.collect()) == Counter(d for d, *_ in ROWS if d != 5)


def test_languages(spark):
    got = language.identify(table(spark, ROWS)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in ROWS)
    assert {(r["doc_id"], r["lang_pred"]) for r in got} == {(1, "en"), (2, "und"), (3, "und"), (None, "en"), (None, "und"), (4, "en"), (5, "en"), (6, "und")}
    kept = language.keep_identified(table(spark, ROWS), 0.3)
    assert Counter(r["doc_id"] for r in kept.collect()) == {1: 2, None: 1, 4: 1, 5: 1} and kept.columns == table(spark, ROWS).columns


def test_most_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([("abc abd", "a")] * 3 + [("xyz xyw", "b")] * 2 + [("mno mnp", "c")], "text string, lang string")
    assert language.LanguageModel.learn(docs).langs == ["a", "b"]


def test_quality(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (4, 1, 0), (None, 0, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = perplexity.judge(table(spark, ROWS), labels).collect()
    assert {r["doc_id"] for r in got} == {d for d, *_ in ROWS}
    assert {r["doc_id"]: r["perplexity"] is None for r in got if r["doc_id"] in (1, 2, 3, 4)} == {1: False, 2: True, 3: True, 4: False}
    assert all(r["keep"] is not None for r in got)


def test_shards(spark):
    rows = [*ROWS, *[(None, "equal", None)] * 50, *[(None, None, None)] * 20]
    got = shards.shard_documents(table(spark, rows), 4).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert next(r["size"] for r in got if r["doc_id"] == 4) == len(LONG) + 16


@pytest.mark.parametrize("seed", range(3))
def test_shards_are_as_good_as_one_by_one(spark, seed):
    """At least four fifths as many pairs of equal texts together as when groups are put whole into
    the first shard with room, largest first, by one process that sees them all."""
    own = random.Random(seed)
    sizes = [own.choice([2, 3, 5, 8, 13]) for _ in range(40)]
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)] + [f"single {i}" for i in range(60)]
    own.shuffle(texts)
    got = shards.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5).collect()
    room, together = [len(texts) // 5 + (s < len(texts) % 5) for s in range(5)], 0
    for n in sorted(sizes, reverse=True):
        at = next((s for s in range(5) if room[s] >= n), None)
        if at is not None:
            room[at] -= n
            together += n * (n - 1) // 2
    of = {r["doc_id"]: r["shard"] for r in got}
    cells = Counter((texts[i], s) for i, s in of.items())
    assert sum(n * (n - 1) // 2 for n in cells.values()) >= 0.8 * together


def test_personal_data(spark):
    rows = [*ROWS, (7, f"{LONG} a@b.co {LONG}", "en"), (7, f"{LONG} a@b.co {LONG}", "en")]
    docs = table(spark, rows)
    got = pii.find_pii(docs).collect()
    assert len(got) == len(rows) and {r["n_email"] for r in got if r["doc_id"] == 7} == {1}
    out = pii.redact(docs)
    assert out.columns == docs.columns and Counter(map(tuple, out.collect())) == Counter((d, t and t.replace("a@b.co", "[EMAIL]"), x, *["x"] * N) for d, t, x in rows)


def test_near_copies(spark):
    docs = table(spark, ROWS)
    got = jaccard.first_of_class(docs)
    assert got.columns == docs.columns and Counter(r["doc_id"] for r in got.collect()) == {1: 1, 2: 1, 3: 1, None: 2, 4: 1, 6: 1}
    assert jaccard.first_of_class(docs.limit(0)).count() == 0


def test_pages_and_chats(spark):
    page = f"<body><article><p>{LONG}</p></article></body>"
    pages = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, "x")], "page_id long, url string, html string, n_chars string")
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in html_text.extract_pages(pages).collect()) == [(0, 0), (1, len(LONG)), (1, len(LONG))]
    assert html_text.extract_pages(pages.limit(0)).count() == 0
    chats = spark.createDataFrame([(1, 0, "user", LONG, "x"), (1, 0, "user", LONG, "x"), (None, None, None, None, "x")], "conv_id long, turn long, role string, text string, message string")
    assert Counter(r["conv_id"] for r in chat.format_chats(chats).collect()) == {1: 2, None: 1}
