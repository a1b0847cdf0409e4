"""Queries on documents (cluster: source, period: lang), labels and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import text
from lattica.operators.components import cut
from lattica.plans.registry import Tables, query, sql_query

STOP = ["the", "of", "and", "to", "a", "in", "is", "it", "der", "die", "und", "das", "le", "la", "de", "et", "les", "el", "y", "que"]
FILLER = 0.5

TOK = """
tk AS (SELECT doc_id, source, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS token FROM documents WHERE text IS NOT NULL)"""
STOPS = "(" + ", ".join(f"'{x}'" for x in STOP) + ")"
CNT = f"""{TOK},
cn AS (SELECT source, lang, token, count(*) AS n FROM tk WHERE token NOT IN {STOPS} GROUP BY 1, 2, 3),
tot AS (SELECT source, lang, sum(n) AS total FROM cn GROUP BY 1, 2)"""
CT = f"""{CNT},
am AS (SELECT lang, avg(total) AS a FROM tot GROUP BY lang), fq AS (SELECT lang, token, sum(n) AS f FROM cn GROUP BY 1, 2),
ct AS (SELECT cn.source, cn.lang, cn.token, n / total * ln(1 + a / f) AS ctfidf FROM cn JOIN tot ON cn.source = tot.source AND cn.lang = tot.lang JOIN fq ON cn.lang = fq.lang AND cn.token = fq.token JOIN am ON cn.lang = am.lang),
tp AS (SELECT * FROM (SELECT source, lang, token, ctfidf, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY round(ctfidf, 10) DESC, token) AS INT) AS rank FROM ct) x WHERE rank <= 50)"""


def counts(t: Tables) -> DataFrame:
    stop = t.spark.createDataFrame([(x,) for x in STOP], "token string")
    return text.without_tokens(text.token_counts(t.documents.where("text is not null"), "source", "lang"), F.broadcast(stop))


def class_scores(t: Tables) -> DataFrame:
    return text.class_tf_idf(counts(t), "source", "lang")


def top_tokens(t: Tables, k: int = 50) -> DataFrame:
    """At most k rows for each class, written down, as several parts of a query read them."""
    return cut(text.top(class_scores(t).withColumn("__v", F.round("ctfidf", 10)), ["source", "lang"], "__v", k, "token").drop("__v"))


@query(f"WITH {CNT} SELECT lang, token, count(*) AS df FROM cn GROUP BY 1, 2")
def token_document_frequency(t):
    return text.document_frequency(counts(t), "source", "lang").select("lang", "token", "df")


@query(f"WITH {CNT}, nd AS (SELECT lang, count(DISTINCT source) AS docs FROM cn GROUP BY 1), df AS (SELECT lang, token, count(*) AS df FROM cn GROUP BY 1, 2) SELECT cn.source, cn.lang, cn.token, round(n / total * ln(docs / CAST(df AS DOUBLE)), 8) AS tfidf FROM cn JOIN tot ON cn.source = tot.source AND cn.lang = tot.lang JOIN nd ON cn.lang = nd.lang JOIN df ON cn.lang = df.lang AND cn.token = df.token")
def tfidf(t):
    return text.tf_idf(counts(t), "source", "lang").select("source", "lang", "token", F.round("tfidf", 8).alias("tfidf"))


@query(f"WITH {CT} SELECT source, lang, token, round(ctfidf, 8) AS ctfidf FROM ct")
def ctfidf(t):
    return class_scores(t).select("source", "lang", "token", F.round("ctfidf", 8).alias("ctfidf"))


@query(f"WITH {CT} SELECT source, lang, token, rank FROM tp")
def ctfidf_topk(t):
    return top_tokens(t).select("source", "lang", "token", "rank")


@query(f"WITH {CT}, k AS (SELECT source, lang, count(*) AS n FROM tp WHERE rank <= 10 GROUP BY 1, 2) SELECT DISTINCT cn.source, cn.lang FROM cn LEFT JOIN k ON cn.source = k.source AND cn.lang = k.lang WHERE coalesce(k.n, 0) < 10")
def token_coverage(t):
    full = top_tokens(t, 10).groupBy("source", "lang").agg(F.count("*").alias("n")).where("n >= 10")
    return counts(t).select("source", "lang").distinct().join(full, ["source", "lang"], "left_anti")


@query(f"WITH {CT}, a AS (SELECT source, lang, list(token ORDER BY rank)[1:10] AS l FROM tp GROUP BY 1, 2), b AS (SELECT source, lang, list(token ORDER BY n DESC, token)[1:10] AS l FROM cn GROUP BY 1, 2) SELECT a.source, a.lang, a.l = b.l AS same FROM a JOIN b ON a.source = b.source AND a.lang = b.lang")
def topk_list_equality(t):
    listed = lambda rows, key: F.slice(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["token"]), 1, 10)
    a = top_tokens(t, 10).groupBy("source", "lang").agg(listed(None, F.struct("rank", "token")).alias("a"))
    b = counts(t).groupBy("source", "lang").agg(listed(None, F.struct((-F.col("n")).alias("m"), "token")).alias("b"))
    return a.join(b, ["source", "lang"]).select("source", "lang", (F.col("a") == F.col("b")).alias("same"))


@query(f"WITH {CT} SELECT source, lang, token FROM tp WHERE rank <= 3")
def topk_tokens_no_tie_loss(t):
    return top_tokens(t, 3).select("source", "lang", "token")


WORDS = f"""{CT}, fl AS (SELECT token FROM tp GROUP BY token HAVING count(DISTINCT source) > {FILLER} * (SELECT count(DISTINCT source) FROM tp)),
ws AS (SELECT source, lang, token FROM tp WHERE token NOT IN (SELECT token FROM fl)), wn AS (SELECT source, lang, count(*) AS n FROM ws GROUP BY 1, 2)"""


def _words(t: Tables) -> DataFrame:
    top = top_tokens(t)
    share = top.groupBy("token").agg(F.count_distinct("source").alias("k")).crossJoin(F.broadcast(top.agg(F.count_distinct("source").alias("all"))))
    return cut(top.join(share.where(F.col("k") > FILLER * F.col("all")), "token", "left_anti").select("source", "lang", "token"))


@query(f"WITH {WORDS} SELECT token FROM fl")
def filler_tokens(t):
    top = top_tokens(t)
    share = top.groupBy("token").agg(F.count_distinct("source").alias("k")).crossJoin(F.broadcast(top.agg(F.count_distinct("source").alias("all"))))
    return share.where(F.col("k") > FILLER * F.col("all")).select("token")


@query(f"WITH {WORDS} SELECT a.lang, a.source AS source_a, b.source AS source_b, round(count(*) / CAST(x.n + y.n - count(*) AS DOUBLE), 6) AS jaccard FROM ws a JOIN ws b ON a.token = b.token AND a.lang = b.lang AND a.source < b.source JOIN wn x ON x.source = a.source AND x.lang = a.lang JOIN wn y ON y.source = b.source AND y.lang = b.lang GROUP BY 1, 2, 3, x.n, y.n")
def word_jaccard_edges(t):
    w = _words(t)
    n = w.groupBy("source", "lang").agg(F.count("*").alias("n"))
    a, b = w.withColumnRenamed("source", "source_a"), w.withColumnRenamed("source", "source_b")
    inter = a.join(b, ["token", "lang"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.count("*").alias("i"))
    sized = inter.join(n.withColumnsRenamed({"source": "source_a", "n": "na"}), ["lang", "source_a"]).join(n.withColumnsRenamed({"source": "source_b", "n": "nb"}), ["lang", "source_b"])
    return sized.select("lang", "source_a", "source_b", F.round(F.col("i") / (F.col("na") + F.col("nb") - F.col("i")), 6).alias("jaccard"))


@query(f"WITH {WORDS}, r AS (SELECT tp.source, tp.lang, tp.token, tp.rank FROM tp WHERE token NOT IN (SELECT token FROM fl)) SELECT source, lang, array_to_string(list(token ORDER BY rank)[1:8], ', ') AS words FROM r GROUP BY 1, 2")
def cluster_word_list(t):
    top = top_tokens(t).join(_words(t), ["source", "lang", "token"], "left_semi")
    ordered = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), 1, 8)
    return top.groupBy("source", "lang").agg(F.array_join(ordered, ", ").alias("words"))


@query(f"WITH {CT}, r AS (SELECT source, lang, list(token ORDER BY rank) AS l FROM tp GROUP BY 1, 2) SELECT source, lang, array_to_string(l[1:5], ', ') || CASE WHEN len(l) > 5 THEN ', ...' ELSE '' END AS head FROM r")
def word_head_ellipsis(t):
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"])
    return top_tokens(t).groupBy("source", "lang").agg(words.alias("l")).select("source", "lang", F.concat(F.array_join(F.slice("l", 1, 5), ", "), F.when(F.size("l") > 5, ", ...").otherwise("")).alias("head"))


@query(f"WITH {TOK} SELECT token, count(*) AS n FROM tk WHERE token NOT IN {STOPS} GROUP BY token")
def stopword_removal(t):
    stop = t.spark.createDataFrame([(x,) for x in STOP], "token string")
    return text.without_tokens(text.token_counts(t.documents.where("text is not null")), F.broadcast(stop))


@query(f"WITH {WORDS} SELECT source, lang, count(*) AS n FROM ws GROUP BY 1, 2")
def filler_removal(t):
    return _words(t).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query(f"WITH {TOK} SELECT lang, count(DISTINCT token) AS n_tokens FROM tk GROUP BY lang")
def two_stage_distinct(t):
    return text.token_counts(t.documents.where("text is not null"), "lang").groupBy("lang").agg(F.count("*").alias("n_tokens"))


@query(f"WITH {CNT} SELECT upper(source) AS key, CAST(sum(n) AS BIGINT) AS n FROM cn JOIN (SELECT DISTINCT lower(source) AS s FROM documents) d ON d.s = lower(cn.source) GROUP BY 1")
def lower_key_join(t):
    d = t.documents.select(F.lower("source").alias("s")).distinct()
    return counts(t).withColumn("s", F.lower("source")).join(d, "s").groupBy(F.upper("source").alias("key")).agg(F.sum("n").alias("n"))


POSTS = """p AS (SELECT source, text, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, text, doc_id) AS INT) AS rn FROM documents WHERE length(trim(regexp_replace(text, 'https?://\\S+', '', 'g'))) >= 20)"""


def posts(t: Tables, k: int = 20) -> DataFrame:
    kept = t.documents.where(text.valid_text(F.col("text")))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "text", "doc_id"))
    return kept.withColumn("rn", rank).where(F.col("rn") <= k)


def prompts(t: Tables) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda x: x["text"])
    return posts(t).groupBy("source").agg(text.numbered(ordered).alias("content"))


@query(f"WITH {POSTS} SELECT source, rn, n_chars FROM p WHERE rn <= 20")
def top_posts_per_group(t):
    return posts(t).select("source", "rn", "n_chars")


@query("SELECT source, count(*) AS n FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS i FROM documents) x WHERE i <= 20 GROUP BY source")
def group_top_without_tiebreak(t):
    return text.top(t.documents.select("source", "n_chars", "doc_id"), ["source"], "n_chars", 20, "doc_id").groupBy("source").agg(F.count("*").alias("n"))


PROMPT = f"{POSTS}, pr AS (SELECT source, string_agg(CAST(rn AS VARCHAR) || '. ' || replace(text, chr(10), ' '), chr(10) ORDER BY rn) AS content FROM p WHERE rn <= 20 GROUP BY source)"


@query(f"WITH {PROMPT} SELECT source, md5(content) AS digest, length(content) AS n FROM pr")
def prompt_render(t):
    return prompts(t).select("source", F.md5("content").alias("digest"), F.length("content").cast("long").alias("n"))


@query(f"WITH {PROMPT}, ln AS (SELECT source, string_split(content, chr(10)) AS l FROM pr) SELECT source, md5(array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+\\. ') AND length(x) > 500 THEN substr(x, 1, 500) || ' [...]' ELSE x END), chr(10))) AS digest FROM ln")
def prompt_truncate(t):
    return prompts(t).select("source", F.md5(text.shortened(F.col("content"))).alias("digest"))


@query("SELECT doc_id, length(trim(regexp_replace(text, 'https?://\\S+', '', 'g'))) >= 20 AS fine FROM documents")
def text_validity_filter(t):
    return t.documents.select("doc_id", text.valid_text(F.col("text")).alias("fine"))


@query("SELECT doc_id FROM documents WHERE NOT (lower(source) IN ('src3', 'src7') OR lower(source) LIKE '%bot' OR lower(source) LIKE 'bot\\_%' ESCAPE '\\') AND text NOT IN ('[deleted]', '[removed]')")
def bot_filter(t):
    return t.documents.where(~text.is_bot(F.col("source"), ["src3", "src7"]) & ~F.col("text").isin("[deleted]", "[removed]")).select("doc_id")


LABELLED = "l AS (SELECT lang AS stratum, quality = 1 AS gold, n_chars >= 400 AS said FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"


def labelled(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(F.col("lang").alias("stratum"), (F.col("quality") == 1).alias("gold"), (F.col("n_chars") >= 400).alias("said"), "doc_id")


CONF = f"{LABELLED}, c AS (SELECT CAST(count(*) FILTER (WHERE gold AND said) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE NOT gold AND said) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE gold AND NOT said) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE NOT gold AND NOT said) AS DOUBLE) AS tn, CAST(count(*) AS DOUBLE) AS n FROM l)"


def _confusion(rows: DataFrame, *by: str) -> DataFrame:
    g, s = F.col("gold"), F.col("said")
    return rows.groupBy(*by).agg(*[F.count_if(x).cast("double").alias(n) for n, x in (("tp", g & s), ("fp", ~g & s), ("fn", g & ~s), ("tn", ~g & ~s))], F.count("*").cast("double").alias("n"))


@query(f"WITH {CONF} SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn FROM c")
def confusion_matrix(t):
    return _confusion(labelled(t)).select(*[F.col(x).cast("long").alias(x) for x in ("tp", "fp", "fn", "tn")])


@query(f"WITH {CONF}, q AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n) AS pe, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1p, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f1n FROM c) SELECT round(po, 6) AS accuracy, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa, round((f1p + f1n) / 2, 6) AS macro_f1 FROM q")
def kappa_f1(t):
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    po, pe = (tp + tn) / n, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    f1 = lambda x: F.coalesce(F.try_divide(2 * x, 2 * x + fp + fn), F.lit(0.0))
    return _confusion(labelled(t)).select(F.round(po, 6).alias("accuracy"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"), F.round((f1(tp) + f1(tn)) / 2, 6).alias("macro_f1"))


@query(f"WITH {LABELLED} SELECT stratum, count(*) AS n, round(avg(CASE WHEN gold = said THEN 1.0E0 ELSE 0.0E0 END), 6) AS accuracy FROM l GROUP BY stratum")
def accuracy_by_stratum(t):
    return labelled(t).groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("said")).cast("double")), 6).alias("accuracy"))


@query(f"WITH {LABELLED}, s AS (SELECT stratum, avg(CASE WHEN gold = said THEN 1.0E0 ELSE 0.0E0 END) AS a FROM l GROUP BY stratum), w AS (SELECT lang AS stratum, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY lang) SELECT round(sum(a * n) / sum(n), 6) AS accuracy FROM s JOIN w ON s.stratum = w.stratum")
def poststratified_accuracy(t):
    s = labelled(t).groupBy("stratum").agg(F.avg((F.col("gold") == F.col("said")).cast("double")).alias("a"))
    w = t.documents.groupBy(F.col("lang").alias("stratum")).agg(F.count("*").cast("double").alias("n"))
    return s.join(w, "stratum").agg(F.round(F.sum(F.col("a") * F.col("n")) / F.sum("n"), 6).alias("accuracy"))


@query("SELECT labels.doc_id, quality = 1 AS gold, n_chars >= 400 AS said FROM labels JOIN documents ON labels.doc_id = documents.doc_id WHERE (quality = 1) <> (n_chars >= 400)")
def disagreements(t):
    return labelled(t).where("gold <> said").select("doc_id", "gold", "said")


sql_query("prefix_strip", "SELECT doc_id, regexp_replace(source, '^src', '') AS entity FROM documents")
sql_query("trim_lower", "SELECT conv_id, turn, lower(trim(role)) AS role FROM conversations")


@query("SELECT doc_id, md5(replace(replace(replace(text, '|', '\\|'), '_', '\\_'), '*', '\\*')) AS digest FROM documents")
def markdown_escape(t):
    out = F.col("text")
    for c in "|_*":
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return t.documents.select("doc_id", F.md5(out).alias("digest"))


@query("SELECT conv_id, md5(string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def chat_template(t):
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    return t.conversations.groupBy("conv_id").agg(F.md5(joined).alias("digest"))


@query("SELECT conv_id, list(role ORDER BY turn)[1:2] = ['user', 'assistant'] AS opens_plainly FROM conversations GROUP BY conv_id")
def list_slice_equal(t):
    roles = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), 1, 2)
    return t.conversations.groupBy("conv_id").agg((roles == F.array(F.lit("user"), F.lit("assistant"))).alias("opens_plainly"))
