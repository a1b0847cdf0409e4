"""Tokenizer, languages, perplexity, pages, personal data and chats on small tables."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import pytest

from lattica.llm import chat, html_text, language, perplexity, pieces, pii

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")


def test_encoding_equals_the_library(spark):
    rng = random.Random(1)
    parts = ["ab", " ", "  ", "\n", "▁", "the", "étion", "🦜", "\x00", "<s>", "0", "'", "tion", "　"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)] + ["", None, " ", "\n", "\n\na", "a\n", "a\n b", "a  b", " a", "a ", "▁a b", "a\nb c\n\nd", "\r\n a", "a" * 3000, "x y " * 2000]
    model = pieces.PieceModel(MODEL)
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for r in pieces.encode_documents(frame, MODEL).collect():
        ids = model.library.encode(texts[r["doc_id"]] or "")
        decoded = model.library.decode(ids) if ids else ""
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_agendas_in_rows_and_in_a_heap_agree():
    model, rng = pieces.PieceModel(MODEL), random.Random(2)
    words = ["".join(rng.choice(["▁", ""]) for _ in range(2)) + "".join(rng.choice("abcdetionrüé🦜") for _ in range(rng.randrange(0, 90))) for _ in range(2000)]
    ids = [model.merge(w) for w in words]
    assert model.rows is not None and model.work_out(words) == ([",".join(map(str, i)) for i in ids], [model.surface(i) for i in ids])
    assert model.encode("a b") == model.library.encode("a b")


def test_languages(spark):
    rng = random.Random(3)
    words = {"xx": ["tion", "the", "and", "ing"], "yy": ["ücht", "der", "schaft", "und"]}
    rows = [(i, " ".join(rng.choice(words[x]) + rng.choice(words[x]) for _ in range(30)), x, 0.5) for i, x in ((i, rng.choice(["xx", "yy"])) for i in range(200))]
    rows += [(900, None, "xx", 0.5), (901, "12 +-", "xx", 0.5), (None, "the tion and", None, 0.5), (902, rows[0][1] + " " + rows[0][1], None, 0.5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = language.identify(frame).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == x for i, _, x, _ in rows[:200]) and by[900]["lang_pred"] == by[901]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.keep_identified(frame, 0.35).count() == len(rows) - 2
    assert all(r["lang_pred"] == "und" for r in language.identify(frame.drop("lang").selectExpr("*", "cast(null as string) lang")).collect())
    assert language.identify(frame.limit(0)).count() == 0


def test_mixture_finds_both_languages(spark):
    a, b = "the tion and ing " * 40, "der schaft und ücht " * 40
    model = language.LanguageModel.learn(spark.createDataFrame([(a, "xx"), (b, "yy")], "text string, lang string"))
    mix = model.mixture(a + b)
    assert set(mix) == {"xx", "yy"} and abs(mix["xx"] - 0.5) < 0.15
    assert set(model.mixture(a)) == {"xx"}


def brute_perplexity(train, texts):
    grams = lambda t, k: [int(x) & perplexity._MASKS[k] for x in perplexity.ngrams(t)]
    top = perplexity.ORDER
    counts = {top: Counter(g for t in train for g in grams(t, top))}
    for k in range(top - 1, 0, -1):
        counts[k] = Counter(g & perplexity._MASKS[k] for g in counts[k + 1])
    total, mass, cut = {}, {}, {}
    for k, c in counts.items():
        n = [0] + [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        cut[k] = [min(float(i), max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.5 for i in (1, 2, 3)]
        total[k], mass[k] = Counter(), Counter()
        for g, v in c.items():
            total[k][g >> 8] += v
            mass[k][g >> 8] += cut[k][min(v, 3) - 1]

    def p(g, k):
        if not k:
            return 1 / 256
        g &= perplexity._MASKS[k]
        h = g >> 8
        if not total[k][h]:
            return p(g, k - 1)
        v = counts[k].get(g, 0)
        return (v - cut[k][min(v, 3) - 1] if v else 0) / total[k][h] + mass[k][h] / total[k][h] * p(g, k - 1)

    return [math.exp(-sum(math.log(p(g, top)) for g in grams(t, top)) / len(t)) if t else None for t in texts]


@pytest.mark.parametrize("entries", [4_000_000, 30])
def test_perplexity_against_brute_force(spark, monkeypatch, entries):
    monkeypatch.setattr(perplexity, "SHARD_ENTRIES", entries)
    train = ["the cat sat on the mat the end", "the dog sat on the log, über"]
    texts = [*train, "zzz qqq éé the", "the the the"]
    frame = lambda rows: spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], "doc_id long, text string, lang string")
    tables = perplexity.train(perplexity.count_ngrams(frame(train)))
    sums = perplexity.log_sums(frame(texts).selectExpr("*", "xxhash64(text) text_hash"), *tables).groupBy("doc_id").sum("logs", "n").collect()
    got = {r["doc_id"]: math.exp(-r["sum(logs)"] / r["sum(n)"]) for r in sums}
    assert [got[i] for i in range(4)] == pytest.approx(brute_perplexity(train, texts), rel=1e-9)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good text", None, 0), (2, None, "en", 0), (None, "", "en", 0)], "doc_id long, text string, lang string, keep int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["doc_id"], r["keep"]) for r in perplexity.judge(docs, none).collect()} == {(1, True), (2, False), (None, False)}
    assert perplexity.judge(docs.limit(0), none).count() == 0


def test_documents_with_toxic_words_are_not_kept(spark):
    rng = random.Random(9)
    words = ["house", "river", "walks", "under", "green", "stone", "morning", "seldom"]
    foul = ["xqzvk", "wkjqx", "zzvqj"]
    text = lambda n: " ".join([rng.choice(words) for _ in range(30 - n)] + [rng.choice(foul) for _ in range(n)])
    # one good document in twenty is odd itself: the 0.99 quantile would let the toxic ones pass
    kinds = [(i, (2 if i % 20 == 0 else 0) if i < 800 else 2) for i in range(1000)]
    docs = spark.createDataFrame([(i, text(n), "en") for i, n in kinds], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i >= 800)) for i, _ in kinds], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in perplexity.judge(docs, labels).collect() if r["keep"]}
    assert sum(i in kept for i in range(800)) > 700 and sum(i in kept for i in range(800, 1000)) < 20


def test_pages(spark):
    page = """<!DOCTYPE html><html><head><title>no</title><script>var t="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=/a>menu</a></ul></nav><div class="cookie-notice">We use cookies, yes, yes, yes</div><div id=sidebar><p>a, b, c, d, e, f, g</p></div>
    <main><article><h1>T &amp; U</h1><p><b>One, two,&nbsp;three<br>four<p>Five <a href="/x?a>b">six</a>, seven &lt;8&gt;<form><p>mail, mail, mail</p></form><aside>side</aside></article>
    <section class="comments"><article class="comment"><p>Nice, nice, nice, nice, a long, long, long, long comment</p></article></section></main><footer>foot</footer></body></html>"""
    assert html_text.main_text(page) == "T & U\nOne, two, three four\nFive six, seven <8>"
    frame = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (3, "u", "<div>" * 20_000 + "deep", "t"), (4, "u", "plain <b>te</b>xt", "t")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["n_chars"], r["text"][:10]) for r in html_text.extract_pages(frame).collect())
    assert [x[0] for x in got] == [1, 2, 3, 3, 4] and (2, 0, "") in got and (3, 4, "deep") in got and (4, 10, "plain text") in got


def test_an_article_is_kept_whole():
    long = ["Prose of some length, with a comma, that goes on and on. " * 4 + str(i) for i in range(20)]
    parts = "".join(f"<p>{x}</p>" for x in long)
    page = f"""<body><div><p>menu</p></div><article><h1>Title</h1>bare<section>{parts}</section><section><p>s1</p><p>s2</p></section><p>short</p>
    <ul><li><a href=/a>a linked source</a></li></ul><table><tr><td>cell</td></tr></table><aside>no</aside></article><div><a href=/b>next page</a></div></body>"""
    want = ["Title", "bare", *(" ".join(x.split()) for x in long), "s1", "s2", "short", "a linked source", "cell"]
    assert html_text.main_text(page).split("\n") == want
    assert html_text.main_text(page.replace("article>", "main>")).split("\n") == want


def test_nothing_of_the_article_is_lost():
    """Random articles among random boilerplate: exactly the article's blocks come out."""
    rng = random.Random(21)
    word = lambda: rng.choice(["tree", "river,", "über", "a", "stone.", "x &amp; y", "1 &lt; 2"])
    plain = lambda t: t.replace("&amp;", "&").replace("&lt;", "<")
    say = lambda n: " ".join(word() for _ in range(n))

    def block():
        t, u = say(rng.randrange(1, 40)), say(3)
        odd = rng.choice(["legal", "tags", "tools", "discussion", "rail", "related-work", "remarks", "header-note", "popular"])
        return rng.choice([
            (f"<p>{t}</p>", [t]), (f"<p>{t}<br>{u}", [f"{t} {u}"]), (f"<h2 id=comments>{u}</h2><p>{t}</p>", [u, t]),
            (f"<ul class=sources><li><a href=/a>{t}</a></li><li><a href=/b>{u}</a></li></ul>", [t, u]), (f"<section class={odd}><p>{t}</p></section>", [t]),
            (f"<div id={odd}>{t}<div>{u}</div></div>", [t, u]), (f"<table><tr><td><a href=/c>{u}</a></td><td>{t}</td></tr></table>", [u, t]),
            (f"<p>{u} <math><mi>E</mi><mo>=</mo><mn>3</mn></math> {t}</p>", [f"{u} E=3 {t}"]), (f"<blockquote><p>{t}</p><footer>{u}</footer></blockquote>", [t, u]),
            (f"<header><h1>{u}</h1><div>by me</div></header>", [u]), (f"<pre>{t}\n{u}</pre>", [f"{t} {u}"]), (f"<figure><img src=x><figcaption>{u}</figcaption></figure>", [u]),
            (f"<dl><dt>{u}<dd>{t}</dl>", [u, t]), (f"<details><summary>{u}</summary>{t}</details>", [u, t]),
        ])

    waste = [
        "<nav><ul><li><a href=/>menu</a></ul></nav>", "<div class='ad'>buy, buy, buy</div>", "<aside>side, side</aside>", "<form><p>mail, mail</p><button>go</button></form>", "<script>var a='<p>no</p>'</script>",
        "<style>p{}</style>", "<div class=cookie-notice><p>we use, well, cookies, many, many</p></div>", "<div class='share buttons'>tell</div>", "<div id=comments><p>first, first, first, a long comment, with, commas</p></div>",
        "<!-- <p>no</p> -->", "<div hidden>no</div>", "<ul class=breadcrumbs><li>no</ul>", "<div class='newsletter-signup'>no, no</div>", "<footer>foot, foot</footer>", "<template><p>no</p></template>",
    ]
    for _ in range(300):
        parts, want = [], []
        for _ in range(rng.randrange(1, 12)):
            html_part, texts = block()
            parts.append(html_part + (rng.choice(waste) if rng.random() < 0.3 else ""))
            want += texts
        around = lambda: "".join(rng.sample(waste, rng.randrange(5)))
        tag = rng.choice(["article", "main"])
        page = f"<html><head><title>t</title></head><body>{around()}<div class='{rng.choice(['page', 'widget', 'rail'])}'><{tag}>{''.join(parts)}</{tag}></div>{around()}</body></html>"
        assert html_text.main_text(page) == "\n".join(plain(" ".join(t.split())) for t in want), page


def test_a_container_keeps_its_lists():
    prose = "Some prose, that goes on, and on, with commas, for quite a while, as articles do. " * 3
    page = f"<body><div class=menu><a href=/>home</a></div><div id=content><p>{prose}</p><ul><li><a href=/x>first source</a></ul><div class=legal>terms</div><p>{prose}</p></div><div class=related><a href=/y>more</a></div></body>"
    assert html_text.main_text(page).split("\n") == [prose.strip(), "first source", "terms", prose.strip()]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if fits:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_against_python(spark):
    rng = random.Random(7)
    parts = ["a", "b.", "@", "@b.c", "1", "22", ".", "-", " ", "+", "(", ")", "255.1", "4111111111111111", "4111 1111 1111 1111", "+1 (830) 555-5433", "1.2.3.4", "é", "🦜", "\x01", "_", "000", "\n", "x@y.z"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30))), "s") for i in range(600)] + [(5000, None, "s"), (5001, "", "s"), (5002, "a" * 5000 + " 1" * 3000 + "@", "s"), (5000, None, "s"), (None, "x@y.z", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find_pii(frame).collect()
    assert len(got) == len(rows)
    texts = {d: t for d, t, _ in rows}
    for r in got:
        want = brute_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert set(want) <= set(r["spans"].split(",")) | {""}
    assert pii.find_pii(frame.limit(0)).count() == 0


def test_neighbouring_data_are_found(spark):
    texts = {
        "a 7536784127813050 4845168114407329 b": "a [CARD] [CARD] b",
        "a +1 (826) 555-4081 190.137.223.204 b": "a [PHONE] [IP] b",
        "a 4111 1111 1111 1111 4111-1111-1111-1111 b": "a [CARD] [CARD] b",
        "+1 (826) 555-4081 4111111111111111, x": "[PHONE] [CARD], x",
        "10.1.2.3 4111111111111111 10.1.2.3": "[IP] [CARD] [IP]",
        "+1 (826) 555-4081 2024 05 17": "[PHONE] 2024 05 17",
        "7536784127813051 4845168114407320 b": "7536784127813051 4845168114407320 b",
    }
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in pii.redact(frame).orderBy("doc_id").collect()] == list(texts.values())
    assert {r["n_card"] for r in pii.find_pii(frame).where("doc_id = 0").collect()} == {0}  # counts are of base spans


def test_trees_add_what_patterns_miss(spark):
    rng = random.Random(12)
    words = ["house", "river", "at", "look", "dot", "under", "write", "me", "call", "or", "stone", "the"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = lambda: next(x for x in iter(lambda: "4" + num(15), None) if luhn(x))
    plain = [lambda: f"{name()}.{num(2)}@{name()}.com", lambda: f"+1 ({num(3)}) 555-{num(4)}", card, lambda: ".".join(str(rng.randrange(256)) for _ in range(4))]
    missed = [lambda: f"{name()}.{num(2)} at {name()} dot com", lambda: f"{name()}.{num(2)} [at] {name()} [dot] com", lambda: f"({num(3)}) 555-{num(4)}", lambda: "[.]".join(str(rng.randrange(256)) for _ in range(4))]
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    usual = [lambda: f"20{num(2)}-0{rng.randrange(1, 10)}-1{num(1)}", lambda: f"{num(3)},{num(3)}", lambda: f"{rng.randrange(1, 13)}/{num(2)}/{num(4)}", lambda: f"{rng.randrange(9)}.{num(2)}", lambda: f"look at {name()}", lambda: "v" + num(1) + "_some_long_name_of_a_file_" + name()]
    rows, want = [], set()
    for d in range(1500):
        text, odd = say(6), d % 12 == 0
        for make in [rng.choice(usual), rng.choice(plain), rng.choice(usual), rng.choice(missed) if odd else rng.choice(usual)]:
            text += " "
            if odd and make in missed:
                want.add((d, len(text)))
            text += f"{make()} {say(3)}"
        if d % 10 == 0:
            text += " token = \""
            want.add((d, len(text)))
            text += f'{secret()}" {say(2)}'
        rows.append((d, text))
    added = set()
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        base = set(brute_spans(rows[r["doc_id"]][1]))
        assert base <= set(r["spans"].split(",")) | {""}
        added |= {(r["doc_id"], int(x.split(":")[1])) for x in r["spans"].split(",") if x and x not in base}
    assert len(added & want) >= 0.8 * len(want) and len(added & want) >= 0.9 * len(added), (len(want), len(added), len(added & want))


def test_copies_are_candidates(spark):
    """Each way in which base spans are written anew is found by its generator as a whole."""
    rows = [(i, f"x {t} y") for i, t in enumerate(["ab.c@d-e.co.uk", "10.2.3.44", "4111 1111 1111 1111", "+1 (830) 555-5433", "+49 30 1234567", "+33 1 23 45 67 89"] * 8)]
    found = pii.matches(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = [(r["dk"] * 100 + i, f"x {r['match']} y", r["of"]) for i, r in enumerate(pii._copies(found.where(found.of.isin(*pii.KINDS) & pii.is_base())).collect())]
    again = pii.matches(spark.createDataFrame(texts, "doc_id long, text string, of string"))
    whole = {(r["dk"], r["of"]) for r in again.collect() if (r["start"], r["end"]) == (2, len(dict((d, t) for d, t, _ in texts)[r["dk"]]) - 2)}
    assert len(texts) >= 48 and {(d, of) for d, _, of in texts} <= whole


def test_redaction_keeps_all_columns(spark):
    names = ["dk", "th", "cuts", "row", "island", "kind", "end", "start"]
    frame = spark.createDataFrame([(1, "to a@b.co", *[f"v{i}" for i in range(8)]), (2, None, *["w"] * 8)], f"doc_id long, text string, {', '.join(f'`{n}` string' for n in names)}")
    out = pii.redact(frame)
    assert out.columns == frame.columns
    assert sorted(map(tuple, out.collect())) == [(1, "to [EMAIL]", *[f"v{i}" for i in range(8)]), (2, None, *["w"] * 8)]


def test_redaction(spark):
    rows = [(1, "🦜 mail a@b.co or +1 (830) 555-5433x 4111111111111111. end", 1), (2, "nothing", 1), (2, "nothing", 1), (None, None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, start int")
    out = pii.redact(frame)
    assert out.columns == frame.columns
    assert sorted(str(r["text"]) for r in out.collect()) == ["None", "nothing", "nothing", "🦜 mail [EMAIL] or [PHONE]x [CARD]. end"]


def test_chats(spark):
    call = lambda i, n, a: {"id": i, "function": {"name": n, "arguments": json.dumps(a)}}
    asked = json.dumps({"content": None, "tool_calls": [call("b", "search", {"query": "${a}", "limit": 3}), call("a", "weather", {"days": "x", "city": "Rome"}), {"id": "z", "name": "nope", "arguments": {"b": 1, "a": [{"d": None, "c": "é"}]}}]})
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", asked)] + [(1, 2 + k, "tool", json.dumps({"tool_call_id": i, "content": i * 2})) for k, i in enumerate("abq")]
    rows += [(1, 5, "assistant", "{bad tool_call"), (2, 0, None, None), (2, 0, None, None), (None, 1, "assistant", asked)]
    circle = json.dumps({"tool_calls": [call("x", "calculate", {"expression": "${y}"}), call("y", "calculate", {"expression": "${x}"})]})
    rows.append((3, 0, "assistant", circle))
    frame = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, n_calls int")
    out = chat.format_chats(frame).orderBy("conv_id", "at_turn", "at_part", "at_level", "at_idx", "turn").collect()
    assert len(out) == len(rows)
    first = [r for r in out if r["conv_id"] == 1]
    assert [r["turn"] for r in first] == [0, 1, 2, 3, 4, 5] and [r["orphan"] for r in first] == [False] * 4 + [True, False]
    message = json.loads(first[1]["message"])
    assert [(c["id"], c["level"], c["linked"], c["valid"]) for c in message["tool_calls"]] == [("a", 0, True, False), ("z", 0, False, False), ("b", 1, True, True)]
    assert (first[1]["n_calls"], first[1]["n_linked"], first[1]["n_invalid"]) == (3, 2, 2)
    for r in out:
        assert r["message"] == json.dumps(json.loads(r["message"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False).replace('"tool_calls":' + json.dumps([], separators=(",", ":")), '"tool_calls":[]') or r["conv_id"] == 1
    assert all(c["level"] == -1 for c in json.loads(out[-1]["message"])["tool_calls"])
    assert chat.format_chats(frame.limit(0)).count() == 0


def brute_levels(calls):
    """Level by (turn, idx) of one conversation's calls (turn, idx, id, needed ids); -1 in or behind a cycle."""
    on = {}
    for turn, idx, name, _ in sorted(calls):
        on.setdefault(name, (turn, idx))
    need = {(t, i): {on[x] for x in ids if x in on} for t, i, _, ids in calls}
    level = {}
    while ready := [k for k in need if k not in level and all(x in level for x in need[k])]:
        level |= {k: max((level[x] + 1 for x in need[k]), default=0) for k in ready}
    return {k: level.get(k, -1) for k in need}


def test_random_chats_against_brute_force(spark):
    rng = random.Random(31)
    rows, levels, linked, orphans, valid = [], {}, {}, {}, {}
    for conv in range(25):
        calls, answers, turn = [], [], 0
        for _ in range(rng.randrange(1, 5)):
            said = []
            for idx in range(rng.randrange(4)):
                name, needs = f"c{rng.randrange(7)}", [f"c{rng.randrange(9)}" for _ in range(rng.choice([0, 0, 1, 2]))]
                args = {"query": " ".join("${%s}" % x for x in needs)} | ({"limit": rng.choice([3, "3"])} if rng.random() < 0.5 else {}) | ({"more": 1} if rng.random() < 0.2 else {})
                fits = set(args) <= {"query", "limit"} and isinstance(args.get("limit", 1), int)
                said.append({"id": name, "type": "function", "function": {"name": rng.choice(["search", "search", "none"]), "arguments": rng.choice([json.dumps(args), args])}})
                calls.append((turn, idx, name, needs))
                valid[conv, turn, idx] = fits and said[-1]["function"]["name"] == "search"
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": said, "content": rng.choice([None, "é", ["a", {"b": 1}]]), "z": 1, "a": [True]})))
            turn += 1
            for _ in range(rng.randrange(4)):
                name = f"c{rng.randrange(8)}"
                answers.append((turn, name))
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": name, "content": "x", "name": "n"})))
                turn += 1
        levels |= {(conv, *k): v for k, v in brute_levels(calls).items()}
        for t, i, name, _ in calls:
            linked[conv, t, i] = any(a > t and n == name for a, n in answers)
        for a, name in answers:
            orphans[conv, a] = not any(t < a and n == name for t, _, n, _ in calls)
    rng.shuffle(rows)
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == len(rows)
    texts = {(c, t): json.loads(x) for c, t, _, x in rows}
    for r in out:
        message, source = json.loads(r["message"]), texts[r["conv_id"], r["turn"]]
        assert r["message"] == json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert {k: v for k, v in message.items() if k not in ("tool_calls", "role")} == {k: v for k, v in source.items() if k != "tool_calls"} and message["role"] == r["role"]
        if r["role"] == "tool":
            assert r["orphan"] == orphans[r["conv_id"], r["turn"]]
            continue
        order = sorted((levels[r["conv_id"], r["turn"], i], i) for i in range(len(source["tool_calls"])))
        assert r["n_calls"] == len(order) and len(message["tool_calls"]) == len(order)
        for (level, i), got in zip(order, message["tool_calls"], strict=True):
            raw = source["tool_calls"][i]
            args = raw["function"]["arguments"]
            key = (r["conv_id"], r["turn"], i)
            want = {"arguments": json.loads(args) if isinstance(args, str) else args, "id": raw["id"], "level": level, "linked": linked[key], "name": raw["function"]["name"], "valid": valid[key]}
            assert got == want


def test_judge_against_brute_force(spark):
    rng = random.Random(41)
    words = {"aa": ["house", "river", "green"], "bb": ["haus", "fluss", "grün"]}
    rows, labels = [], []
    for d in range(260):
        lang, odd = rng.choice(["aa", "bb"]), rng.random() < 0.3
        rows.append((d, " ".join(rng.choice(words[lang]) + (rng.choice(["", "xq", "zz"]) if odd else "") for _ in range(rng.randrange(3, 15))), lang))
        if rng.random() < 0.8:
            labels.append((d, int(not odd or rng.random() < 0.1), int(rng.random() < 0.05)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    test = {r[0] for r in docs.selectExpr("doc_id").where(f"pmod(xxhash64(doc_id), {perplexity.FOLDS}) = 0").collect()}
    good = {d: q == 1 and t != 1 for d, q, t in labels}
    seen = brute_perplexity([t for d, t, _ in rows if good.get(d) and d not in test], [t for _, t, _ in rows])
    value = {d: round(p, 6) for (d, _, _), p in zip(rows, seen, strict=True)}
    cut = {}
    for lang in words:
        fine, poor = ([value[d] for d, _, x in rows if x == lang and d in test and good.get(d) is flag] for flag in (True, False))
        tried = []
        for k in range(50, 100):
            at = sorted(fine)[max(0, math.ceil(k / 100 * len(fine) - 1e-9) - 1)]
            tried.append((sum(v <= at for v in fine) / len(fine) - sum(v <= at for v in poor) / max(len(poor), perplexity.LEAST_POOR), at))
        cut[lang] = max(tried)[1]
    got = perplexity.judge(docs, marks).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["perplexity"] == pytest.approx(value[r["doc_id"]], abs=2e-6) and r["threshold"] == pytest.approx(cut[r["lang"]], abs=2e-6)
        assert r["keep"] == (r["perplexity"] <= r["threshold"])


def test_held_out_languages_of_the_tables(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    said = language.identify(docs).where("held_out and lang_pred <> 'und'").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id").selectExpr("avg(int(lang = lang_pred)) a", "count(*) n").first()
    assert said["n"] > 100 and said["a"] > 0.98
