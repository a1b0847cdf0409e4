"""The pipeline is its stages one after the other, and each stage does its work."""

import hashlib
import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from lattica.llm.common import stored
from lattica.llm.pieces import PieceModel
from lattica.llm.queries import piece_model

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        rows[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    assert list(rows) == ["language_id", "ngram_jaccard", "decontamination", "pii", "sentencepiece"]
    assert rows["language_id"] >= rows["ngram_jaccard"] >= rows["decontamination"] == rows["pii"] == rows["sentencepiece"] > 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def words(rng, n, lang):
    return " ".join("".join(rng.choice({"aa": ["tion", "the", "ing", "wh"], "bb": ["ücht", "der", "schaft", "öß"]}[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_pipeline_against_a_plain_version(spark, tmp_path):
    """Nulls, empty and long texts, copies, repeated rows and clashing columns: what run() gives is
    what a plain version of the stages gives."""
    rng, extra = random.Random(5), ["dk", "th", "cuts", "row", "node", "text_hash", "island", "kind", "score", "keys", "id", "hash", "gone_id", "__text_hash", "vec"]
    texts = [words(rng, 60, rng.choice(["aa", "bb"])) for _ in range(60)]
    item = words(rng, 40, "aa")
    long, other = words(rng, 40_000, "bb"), words(rng, 60, "aa")
    near = texts[3].split(" ")
    near[30] = "changed"
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100, texts[3]), (101, " ".join(near)), (102, f"{texts[4]} {item} {texts[5]}"), (103, f"{other} write to ab@cd.org or +1 (830) 555-5433 now")]
    rows += [(104, None), (105, ""), (106, "12 34 !"), (107, long), (108, long), (7, texts[7]), (None, words(rng, 50, "aa")), (None, None)]
    gone = {100, 101, 102, 104, 105, 106, 108}
    want = [(d, t) for d, t in rows if d not in gone and t]
    want.remove((7, texts[7]))  # the row that repeats
    clean = {103: f"{other} write to [EMAIL] or [PHONE] now"}
    library = PieceModel(piece_model()).library
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = Counter()
    for d, t in want:
        ids = library.encode(clean.get(d, t))
        expected[d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    lang = lambda t: None if not t else "aa" if "th" in t or "tion" in t else "bb"
    full = [(d, t, lang(t), "s", None if t is None else len(t), *extra) for d, t in rows]
    rng.shuffle(full)
    spark.createDataFrame(full, schema).repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "?")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert Counter(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == expected
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, f"{tmp_path}/a"))
        assert docs.columns == [x.split(" ")[0].strip("`") for x in schema.split(", ")], name
    assert {tuple(r)[5:] for r in docs.collect()} == {tuple(extra)}
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
