"""Personal data: regular base spans, and further candidates that boosted trees decide on.

Base spans are what fixed patterns and checks accept. High-recall generators propose further,
overlapping candidates: addresses written with "at" and "dot", runs of digits in any layout, and
long runs of letters and digits, which may be secrets. A candidate is described by its format and
its surroundings, as a vector of small whole numbers; equal vectors are counted together, so that
the table the trees learn from grows with the number of different vectors and not with the corpus.

What the patterns catch teaches what they miss: every base span is written in the other ways that
people write such data ("at" for "@", a phone number without its "+", a card with dots), in its own
surroundings, and these copies are the positive examples; runs behind an assignment to a word such
as "token" are those of the secrets. All candidates that overlap no base span are unlabelled. Trees
are fitted on four fifths of the documents. On the rest each generator's threshold is calibrated:
with c the score that ``RECALL`` of the positives reach, an unlabelled candidate of a score s below
c is taken for a positive with the chance (1 - c) / c * s / (1 - s), and the threshold is the lowest
score from which on the mean of these chances is ``PRECISION``. Candidates above it are added.

Data that stand next to each other make one match that fails its check as a whole. Of such a match
the parts are proposed: every sequence of digit groups as long as a card, and the run behind a "+"
up to the next span. Parts are decided by the check of their format and not by the trees.

Everything is DataFrame functions and the JVM's own trees. Places are found without leaving
them: a pattern's matches are marked in one pass, the text is cut at the marks, and a window adds
up the lengths. All that is shuffled is doc_id, a hash of the text, and the matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import durable

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Possessive quantifiers and the look-behinds leave the matches as they
#: are and keep the search linear; after a match the next may begin at once (\\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "address": r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++\x20?(?:[\[({<]\x20?at\x20?[\])}>]|\x20at\x20|@)\x20?[a-z0-9-]++"
    r"(?:(?:\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?|\x20dot\x20|\.)[a-z0-9-]++)++",
    "digits": r"(?:\G|(?<![0-9A-Za-z]))[+(]?[0-9](?:(?:\[\.\]|[\x20()./-]{0,2}+)[0-9])++",
    "token": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}+",
}
#: Whether a text is worth a pattern's pass.
GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "address": lambda t: F.contains(t, F.lit("@")) | t.rlike(r"(?i)[\[({<]\x20?at\x20?[\])}>]|\x20at\x20[a-z0-9-]+\x20?(?:[\[({<]|dot|\.[a-z])"),
    "digits": lambda t: t.rlike(r"[0-9](?:\[\.\]|[\x20()./-]{0,2})[0-9]"),
    "token": lambda t: t.rlike(r"[0-9]") & t.rlike(r"[A-Za-z0-9_+/-]{20}"),
}
#: Digits that a candidate of the second generator has at least and at most; longer runs are proposed in parts.
DIGITS = (7, 19)
#: A card's digits as a part of a longer match, without those of ``ISSUED``.
CARD_DIGITS = (16, 19)
#: Shorter cards, known by issuer and length.
ISSUED = r"^(?:3[47][0-9]{13}|3[0689][0-9]{12}|4[0-9]{12})$"
#: Groups of a card have so many digits at least, but for the last.
LEAST_GROUP = 3
_GROUPS = 1 + CARD_DIGITS[1] // LEAST_GROUP
#: Starts of a "+" run that are a phone number, best first: of its country's length, before white space, before no digit.
PHONE_STARTS = [
    r"^\+1[\x20().-]*+(?:[0-9][\x20().-]*+){9}[0-9](?![0-9])",
    r"^\+(?:[0-9][\x20().-]*+){7,14}[0-9](?=\x20|$)",
    r"^\+(?:[0-9][\x20().-]*+){7,14}[0-9](?![0-9])",
]
#: Kinds of spans that may be added: the last has no base pattern.
ADDED = (*KINDS, "secret")
#: What stands before a run that is a secret.
ASSIGNED = r"(?i)(?:token|key|secret|passw(?:or)?d|pwd|auth|bearer|credentials?)[\"']?\s?(?:[=:]|=>)\s?[\"']?$"
CONTEXT = 24
CUES = {
    1: r"(?i)mail|write|contact|kontakt|correo|courriel",
    2: r"(?i)\bip\b|host|server|addr|login",
    3: r"(?i)card|visa|karte|carte|tarjeta|payment|credit",
    4: r"(?i)phone|tel|call|fax|mobil|whatsapp|sms|number",
}
FEATURES = (
    "generator", "n_digits", "n_groups", "first_group", "last_group", "plus", "bracket", "dots", "dashes", "spaces", "slashes", "words", "lead", "luhn", "upper", "hex", "cue", "before_class",
    "after_class", "even_groups",
)
TREES, DEPTH, STEP, SEED = 12, 3, 0.3, 7
PRECISION, RECALL = 0.98, 0.95
#: Least score of an added candidate.
LEAST_SCORE = 0.5
#: A generator learns from so many written copies at least.
LEAST_COPIES = 20

_OPEN, _CLOSE, _OTHER = "\u0001", "\u0002", "\u0003"
_DOC = ["dk", "th"]


def _keys() -> list[Column]:
    """dk and th: what tells documents apart, null doc_ids included."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("dk"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th")]


def _marked(text: Column, pattern: str, guard: Column) -> Column:
    clean = F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE)), F.translate(text, _OPEN + _CLOSE, _OTHER * 2)).otherwise(text)
    return F.when(guard, F.split(F.regexp_replace(clean, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN, -1))


def _pieces(name: str, cut: Column) -> Column:
    """Structs for the piece before the first match (i = 0) and for each match with what follows."""

    def one(piece: Column, i: Column) -> Column:
        match = F.when(i > 0, F.substring_index(piece, _CLOSE, 1))
        return F.struct(
            F.lit(name).alias("of"),
            i.alias("i"),
            (F.length(piece) - F.when(i > 0, 1).otherwise(0)).cast("long").alias("n"),
            match.alias("match"),
            F.when(i > 0, F.right(F.element_at(cut, F.greatest(i, F.lit(1))), F.lit(CONTEXT))).alias("before"),
            F.when(i > 0, F.substring(piece, F.length(match) + 2, F.lit(2))).alias("after"),
        )

    return F.when(F.size(cut) > 1, F.transform(cut, one))


def matches(docs: DataFrame) -> DataFrame:
    """dk, th, of, match, start, end, before, after: every match of every pattern."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(*_keys(), text.alias("t"))
    every = PATTERNS | GENERATORS
    cut = base.select(*_DOC, *[_marked(F.col("t"), p, GUARDS[k](F.col("t"))).alias(k) for k, p in every.items()])
    lists = F.array(*[F.coalesce(_pieces(k, F.col(k)), F.array()) for k in every])
    rows = cut.where(reduce(lambda a, b: a | b, [F.coalesce(F.size(k), F.lit(0)) > 1 for k in every])).select(*_DOC, F.explode(F.flatten(lists)).alias("p"))
    rows = rows.select(*_DOC, "p.*").repartition(*_DOC).dropDuplicates([*_DOC, "of", "i"])
    upto = Window.partitionBy(*_DOC, "of").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        .where("i > 0")
        .select(*_DOC, "of", "match", "start", (F.col("start") + F.length("match")).alias("end"), "before", "after")
    )


def _digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _digits(c: str = "match") -> Column:
    return _digits_of(F.col(c))


def is_base() -> Column:
    """Whether a base pattern's match passes its check."""
    digits = F.length(_digits())
    part = lambda x: F.regexp_replace(x, "^0+", "")
    small = F.forall(F.split("match", r"\."), lambda x: (F.length(part(x)) < 3) | ((F.length(part(x)) == 3) & (part(x) <= "255")))
    return (
        F.when(F.col("of") == "email", True)
        .when(F.col("of") == "ip", small)
        .when(F.col("of") == "card", digits.between(16, 19) & F.call_function("luhn_check", _digits()))
        .when(F.col("of") == "phone", digits.between(8, 15))
        .otherwise(False)
    )


def _class(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[A-Za-z]"), 2).when(c.rlike("^[.,;:!?]"), 3).when(c.rlike("^[0-9]"), 4).otherwise(5)


def _features() -> list[Column]:
    m, digits = F.col("match"), _digits()
    count = lambda chars: F.least(F.length(m) - F.length(F.translate(m, chars, "")), F.lit(4))
    cue = reduce(lambda out, k: F.when(F.col("before").rlike(CUES[k]), k).otherwise(out), reversed(CUES), F.lit(0))
    groups = F.split(F.trim(F.regexp_replace(m, "[^0-9]+", " ")), " ")
    token, flag = F.col("of") == "token", lambda c: F.coalesce(c, F.lit(False)).cast("int")
    values = (
        F.when(F.col("of") == "address", 0).when(token, 2).otherwise(1),
        F.when(token, F.floor(F.length(digits) * 10 / F.length(m))).otherwise(F.length(digits)),
        F.least(F.size(groups), F.lit(6)),
        F.least(F.length(groups[0]), F.lit(9)),
        F.least(F.length(F.element_at(groups, -1)), F.lit(9)),
        flag(F.startswith(m, F.lit("+"))),
        count("([{<"),
        count("."),
        count("-"),
        count(" "),
        count("/"),
        F.least(F.size(F.split(m, r"(?i)(?<![a-z])(?:at|dot)(?![a-z])")) - 1, F.lit(4)),
        F.coalesce(F.left(digits, F.lit(1)).try_cast("int"), F.lit(0)),
        flag(F.when(F.length(digits).between(2, 19), F.call_function("luhn_check", digits))),
        flag(m.rlike("[A-Z]")),
        flag(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        F.when(token, 0).otherwise(cue),
        F.when(token, 0).otherwise(_class(F.right("before", F.lit(1)))),
        F.when(token, 0).otherwise(_class(F.left("after", F.lit(1)))),
        flag(F.size(F.array_distinct(F.transform(groups, F.length))) == 1),
    )
    # where digits are no more than a part, their layout is told roughly
    rough = F.col("of").isin("address", "token")
    return [F.when(rough, F.least(v, F.lit(6))).otherwise(v).cast("int").alias(n) for n, v in zip(FEATURES, values, strict=True)]


def _copies(base: DataFrame) -> DataFrame:
    """The base spans ``base`` (dk, th, of, match, start, before, after) as rows of the generators,
    each in one of the other ways to write it, by a hash of its place."""
    m, digits = F.col("match"), _digits()
    said = lambda at, dot: F.concat(F.substring_index(m, "@", 1), F.lit(at), F.replace(F.substring_index(m, "@", -1), F.lit("."), F.lit(dot)))
    local = F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20-]+", "")
    local = F.when(F.length(_digits_of(local)) >= 7, local).otherwise(F.substring(m, 2, 2**31 - 1))
    fours = lambda by: F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{by}")
    ways = {
        "email": [said(" at ", " dot "), said(" [at] ", " [dot] "), said("(at)", "."), said(" at ", "."), said("[at]", "[dot]"), said(" (at) ", " dot ")],
        "ip": [F.replace(m, F.lit("."), F.lit("[.]")), F.replace(m, F.lit("."), F.lit("-"))],
        "card": [fours("."), fours("/"), fours("  ")],
        "phone": [F.substring(m, 2, 2**31 - 1), local, F.translate(local, "()", ""), F.trim(F.regexp_replace(local, "[^0-9]+", " ")), F.regexp_replace(F.trim(F.regexp_replace(local, "[^0-9]+", " ")), " ", "."), F.concat(F.lit("00"), F.substring(m, 2, 2**31 - 1))],
    }
    way = lambda kind: F.element_at(F.array(*ways[kind]), (F.pmod(F.xxhash64(*_DOC, "start"), F.lit(len(ways[kind]))) + 1).cast("int"))
    text = reduce(lambda out, k: F.when(F.col("of") == k, way(k)).otherwise(out), ways, F.lit(None).cast("string"))
    return base.select(*_DOC, F.when(F.col("of") == "email", "address").otherwise("digits").alias("of"), text.alias("match"), "before", "after").where("match is not null")


def _selected(vectors: DataFrame) -> DataFrame | None:
    """Vectors whose score passes their generator's threshold; None where nothing can be learnt."""
    enough = vectors.groupBy("generator").agg(F.sum("fit_yes").alias("a"), F.sum("fit_no").alias("b"), F.sum("test_yes").alias("c")).collect()  # one row for each generator
    able = [r["generator"] for r in enough if r["a"] >= LEAST_COPIES and r["c"]]
    if not able or not sum(r["b"] for r in enough):
        return None
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(vectors)
    fit = assembled.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("fit_yes").cast("double").alias("weight")), F.struct(F.lit(0.0).alias("label"), F.col("fit_no").cast("double").alias("weight")))).alias("x"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, weightCol="weight", cacheNodeIds=False).fit(fit.select("features", "x.label", "x.weight").where("weight > 0"))
    scored = model.transform(assembled).select(*FEATURES, "test_yes", "test_no", F.round(vector_to_array("probability")[1], 9).alias("score"))
    scored = durable(scored, 0)
    down = Window.partitionBy("generator").orderBy(F.desc("score"))
    steps = scored.groupBy("generator", "score").agg(F.sum("test_yes").alias("copies"), F.sum("test_no").alias("n"))
    steps = steps.withColumn("upto", F.sum("copies").over(down)).withColumn("copies", F.sum("copies").over(Window.partitionBy("generator")))
    usual = F.max(F.when(F.col("upto") >= RECALL * F.col("copies"), F.col("score"))).over(Window.partitionBy("generator"))
    steps = steps.withColumn("c", usual)
    odds = F.when(F.col("score") >= F.col("c"), 1.0).otherwise((1 - F.col("c")) / F.col("c") * F.col("score") / (1 - F.col("score")))
    steps = steps.withColumn("all", F.sum("n").over(down)).withColumn("yes", F.sum(F.col("n") * F.least(odds, F.lit(1.0))).over(down))
    least = steps.where((F.col("yes") >= PRECISION * F.col("all")) & (F.col("score") >= LEAST_SCORE)).groupBy("generator").agg(F.min("score").alias("least"))
    return scored.where(F.col("generator").isin(able)).join(least, "generator").where(F.col("score") >= F.col("least")).select(*FEATURES)


def _kind() -> Column:
    digits = F.length(_digits())
    ip = F.col("match").rlike(r"^[0-9]{1,3}(?:(?:\[\.\]|[.-])[0-9]{1,3}){3}$")
    number = F.when(ip, 1).when(digits.between(13, 19) & ~F.startswith(F.col("match"), F.lit("+")), 2).otherwise(3)
    return F.when(F.col("of") == "address", 0).when(F.col("of") == "token", len(KINDS)).otherwise(number)


def _overlapping(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` with ``hit``: whether one of ``spans`` overlaps."""
    both = rows.withColumn("base", F.lit(False)).unionByName(spans.select(*_DOC, "start", "end", F.lit(True).alias("base")), allowMissingColumns=True)
    by_start = Window.partitionBy(*_DOC).orderBy("start")
    ends = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    starts = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    hit = F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False))
    return both.withColumn("hit", hit).where("not base").drop("base")


def _card_parts(found: DataFrame, base: DataFrame) -> DataFrame:
    """dk, th, kind, start, end: sequences of digit groups within a match that is no card as a
    whole which are cards by themselves and overlap no base span. Of those that overlap each
    other the one of fewest groups stays, and of these the first."""
    runs = found.where(F.col("of").isin("card", "digits") & ~is_base() & (F.length(_digits()) >= 13))
    zipped = F.arrays_zip(F.split("match", "[0-9]+", -1).alias("gap"), F.expr("regexp_extract_all(match, '[0-9]+', 0)").alias("group"))
    groups = runs.select(*_DOC, "of", "start", F.posexplode(zipped).alias("i", "x")).select(*_DOC, "of", "start", "i", F.length("x.gap").alias("gap"), F.col("x.group").alias("group")).where("group is not null")
    w = Window.partitionBy(*_DOC, "of", "start").orderBy("i")
    at = F.col("start") + F.sum(F.col("gap") + F.length("group")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("group")
    ahead = F.collect_list(F.struct("at", "group")).over(w.rowsBetween(Window.currentRow, _GROUPS - 1))

    def sequence(k: Column) -> Column:
        last = F.element_at("ahead", k)
        return F.struct(
            F.col("at").alias("start"),
            (last["at"] + F.length(last["group"])).alias("end"),
            F.array_join(F.transform(F.slice("ahead", 1, k), lambda x: x["group"]), "").alias("digits"),
            F.exists(F.slice("ahead", 1, k - 1), lambda x: F.length(x["group"]) < LEAST_GROUP).alias("short"),
            k.alias("n"),
        )

    every = groups.withColumn("at", at).withColumn("ahead", ahead).select(*_DOC, F.explode(F.transform(F.sequence(F.lit(1), F.size("ahead")), sequence)).alias("x")).select(*_DOC, "x.*")
    long = F.length("digits").between(*CARD_DIGITS) | F.col("digits").rlike(ISSUED)
    cards = every.where(long & ~F.col("short")).where(F.call_function("luhn_check", F.col("digits"))).select(*_DOC, "start", "end", "n").dropDuplicates([*_DOC, "start", "end"])
    cards = _overlapping(cards, base).where("not hit").groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("n", "start", "end"))).alias("all"))
    clear = lambda held, x: ~F.exists(held, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"]))
    chosen = F.aggregate("all", F.slice("all", 1, 0), lambda held, x: F.when(clear(held, x), F.concat(held, F.array(x))).otherwise(held))
    return cards.select(*_DOC, F.explode(chosen).alias("x")).select(*_DOC, F.lit(KINDS.index("card")).alias("kind"), "x.start", "x.end")


def _phone_parts(found: DataFrame, spans: DataFrame) -> DataFrame:
    """dk, th, kind, start, end: the phone numbers at the start of "+" runs that have too many
    digits as a whole. A run ends where the next of ``spans`` starts."""
    runs = found.where((F.col("of") == "phone") & (F.length(_digits()) > 15)).select(*_DOC, "match", "start")
    both = runs.unionByName(spans.select(*_DOC, "start"), allowMissingColumns=True)
    after = Window.partitionBy(*_DOC).orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    room = F.min(F.when(F.col("match").isNull(), F.col("start"))).over(after) - F.col("start")
    cut = both.withColumn("room", room).where("match is not null").withColumn("head", F.when(F.col("room").isNull(), F.col("match")).otherwise(F.left("match", F.col("room").cast("int"))))
    whole = F.regexp_extract("head", r"^\+.*[0-9]", 0)
    starts = [F.when(F.length(_digits("head")).between(8, 15), whole), *[F.nullif(F.regexp_extract("head", p, 0), F.lit("")) for p in PHONE_STARTS]]
    cut = cut.withColumn("part", F.coalesce(*starts)).where("part is not null")
    return cut.select(*_DOC, F.lit(KINDS.index("phone")).alias("kind"), "start", (F.col("start") + F.length("part")).alias("end"))


def spans(docs: DataFrame) -> DataFrame:
    """dk, th, kind (place in ``ADDED``), start, end, base: base spans, checked parts of longer
    matches, and selected candidates. Of candidates that overlap the one that starts first stays,
    of these the longest."""
    found = durable(matches(docs), docs.select("doc_id").count(), waves=4)
    rows = found.count()
    base = found.where(F.col("of").isin(*KINDS) & is_base()).select(
        *_DOC, F.array_position(F.array(*map(F.lit, KINDS)), F.col("of")).cast("int").alias("kind"), "start", "end", F.lit(True).alias("base")
    )
    base = base.withColumn("kind", F.col("kind") - 1)
    cards = durable(_card_parts(found, base), rows)
    parts = cards.unionByName(_phone_parts(found, base.select(*_DOC, "start", "end").unionByName(cards.select(*_DOC, "start", "end"))))
    base = durable(base.unionByName(parts.withColumn("base", F.lit(False))), rows)
    enough = F.col("of").isin("address", "token") | F.length(_digits()).between(*DIGITS)
    proposed = found.where(F.col("of").isin(*GENERATORS) & enough).select(*_DOC, "start", "end", _kind().cast("int").alias("kind"), ((F.col("of") == "token") & F.col("before").rlike(ASSIGNED)).alias("copy"), *_features())
    candidates = durable(_overlapping(proposed, base).where("not hit").drop("hit"), rows)
    written = _copies(found.where(F.col("of").isin(*KINDS) & is_base())).select(*_DOC, F.lit(True).alias("copy"), *_features())
    test = F.pmod(F.xxhash64("th", F.lit(5)), F.lit(5)) == 0
    counted = lambda c: F.count_if(c).alias
    vectors = durable(
        candidates.select(*_DOC, "copy", *FEATURES).unionByName(written).groupBy(*FEATURES).agg(
            counted(~test & F.col("copy"))("fit_yes"), counted(~test & ~F.col("copy"))("fit_no"), counted(test & F.col("copy"))("test_yes"), counted(test & ~F.col("copy"))("test_no")
        ),
        rows,
    )
    selected = _selected(vectors)
    if selected is None:
        return base
    added = candidates.join(selected, list(FEATURES))
    before = Window.partitionBy(*_DOC).orderBy("start", F.desc("end"), "kind")
    clear = F.coalesce(F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) <= F.col("start")
    added = added.withColumn("clear", clear).where("clear").select(*_DOC, "kind", "start", "end", F.lit(False).alias("base"))
    return base.unionByName(added)


def _of_kind(k: int):
    return lambda x: x["kind"] == k


def _listed(spans_col: Column) -> Column:
    names = F.array(*map(F.lit, ADDED))
    return F.array_join(F.transform(spans_col, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of base spans, ``spans`` lists all, those of kind ``secret`` last. Places are code points from 0, ends
    exclusive. A null text counts as empty: no spans, and the digest of no bytes. Rows that
    repeat give equal rows; a null doc_id stays null. Other columns are not read.
    """
    item = F.struct("kind", "start", "end")
    per_doc = (
        spans(docs)
        .groupBy(*_DOC)
        .agg(F.array_sort(F.collect_list(F.when(F.col("base"), item))).alias("base"), F.array_sort(F.collect_list(item)).alias("all"))
        .select(
            *_DOC,
            *[F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)],
            _listed(F.col("base")).alias("base_list"),
            _listed(F.col("all")).alias("spans"),
        )
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys())
    return ids.join(per_doc, _DOC, "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base_list", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with every span of ``text`` replaced by its kind in
    brackets; spans that overlap are replaced as one, by the kind that starts first."""
    w = Window.partitionBy(*_DOC).orderBy("start", F.desc("end"), "kind")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        spans(docs)
        .withColumn("new", F.when(F.coalesce(far <= F.col("start"), F.lit(True)), 1).otherwise(0))
        .withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*_DOC, "island")
        .agg(F.min(F.struct("start", (-F.col("end")).alias("e"), "kind")).alias("head"), F.max("end").alias("end"))
    )
    cuts = islands.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct(F.col("head.start").alias("start"), "end", F.col("head.kind").alias("kind")))).alias("cuts"))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in ADDED])
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")  # apart from the helpers' names
    text = F.col("row.text").cast("string")

    def kept(x: Column, i: Column) -> Column:
        since = F.when(i > 0, F.element_at("cuts", F.greatest(i, F.lit(1)))["end"]).otherwise(F.lit(0))
        return F.concat(F.substring(text, (since + 1).cast("int"), (x["start"] - since).cast("int")), F.element_at(marks, x["kind"] + 1))

    last = F.element_at("cuts", -1)["end"]
    clean = F.concat(F.array_join(F.transform("cuts", kept), ""), F.substring(text, (last + 1).cast("int"), F.lit(2**31 - 1)))
    joined = docs.select(row, *_keys()).join(cuts, _DOC, "left")
    return joined.select(*[F.when(F.col("cuts").isNotNull(), clean).otherwise(text).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
