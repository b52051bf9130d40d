"""Queries over text operators."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import text as T
from ..operators import topics as N
from .base import query, table
from .stats import rounded

WS = r"list_filter(string_split_regex({c}, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"
CLEAN = r"array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}\p{Pc}\s]', ' ', 'g'), '\d+', ' ', 'g'), '\s+'), lambda w: length(w) >= 3), ' ')"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang")


@query("text_clean", f"SELECT doc_id, md5({CLEAN}) AS cleaned FROM documents")
def text_clean(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.clean(F.col("text"))).alias("cleaned"))


@query("text_stats", f"""WITH w AS (SELECT doc_id, text, {WS.format(c='text')} AS ws FROM documents) SELECT doc_id, length(text)::INT AS text_char_count, len(ws)::INT AS text_word_count, round(coalesce(length(array_to_string(ws, '')) / nullif(len(ws), 0), 0), 6)::DOUBLE AS text_avg_word_length,
 len(list_filter(ws, lambda w: upper(w) = w AND lower(w) <> w))::INT AS text_uppercase_count, len(list_distinct(list_transform(ws, lambda w: lower(w))))::INT AS text_unique_word_count, round(coalesce(len(list_distinct(list_transform(ws, lambda w: lower(w)))) / nullif(len(ws), 0), 0), 6)::DOUBLE AS text_unique_word_ratio,
 round(coalesce(len(regexp_extract_all(text, '[0-9]')) / nullif(length(text), 0), 0), 6)::DOUBLE AS text_digit_ratio FROM w""")
def text_stats(spark, d):
    return rounded(T.text_stats(docs(spark, d), "text").drop("text", "lang"))


@query("text_readability", f"""WITH w AS (SELECT doc_id, text, {WS.format(c='text')} AS ws FROM documents), s AS (SELECT doc_id, len(ws) AS n, greatest(1, len(regexp_extract_all(text, '[.!?]'))) AS st, list_sum(list_transform(ws, lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+')) - (CASE WHEN lower(w) LIKE '%e' THEN 1 ELSE 0 END)))) AS sy FROM w)
 SELECT doc_id, round(CASE WHEN n > 0 THEN least(100, greatest(0, 206.835::DOUBLE - 1.015::DOUBLE * (n / st) - 84.6::DOUBLE * (sy / n))) ELSE 0 END, 4) AS text_flesch_ease, round(CASE WHEN n > 0 THEN least(18, greatest(0, .39::DOUBLE * (n / st) + 11.8::DOUBLE * (sy / n) - 15.59::DOUBLE)) ELSE 0 END, 4) AS text_fk_grade FROM s""")
def text_readability(spark, d):
    return rounded(T.readability(docs(spark, d), "text").drop("text", "lang"), 4)


LEX = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("text_sentiment", f"WITH w AS (SELECT conv_id, turn, list_transform({WS.format(c='text')}, lambda w: lower(w)) AS ws FROM conversations), s AS (SELECT conv_id, turn, len(list_filter(ws, lambda w: list_contains({LEX(T.POSITIVE)}, w))) AS p, len(list_filter(ws, lambda w: list_contains({LEX(T.NEGATIVE)}, w))) AS n FROM w) SELECT conv_id, turn, round(coalesce((p - n) / nullif(p + n, 0), 0), 6)::DOUBLE AS sentiment FROM s")
def text_sentiment(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(T.sentiment(F.col("text")), 6).alias("sentiment"))


TERMS = f"x AS (SELECT doc_id, lang, unnest(list_filter(string_split({CLEAN}, ' '), lambda w: w <> '')) AS term FROM documents)"


@query("text_bow_topk", f"WITH {TERMS}, c AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL), t AS (SELECT term, count(*) AS df FROM c GROUP BY 1 ORDER BY df DESC, term LIMIT 50) SELECT doc_id, term, tf, df FROM c JOIN t USING (term)")
def text_bow_topk(spark, d):
    return T.bag_of_words(docs(spark, d), "doc_id", "text", 50).select("doc_id", "term", "tf", "df")


@query("text_tfidf_top", f"WITH {TERMS}, c AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL), i AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1), w AS (SELECT doc_id, term, tf * idf AS w FROM c JOIN i USING (term)), s AS (SELECT doc_id, round(max(w / n), 5) AS top FROM (SELECT doc_id, w, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS n FROM w) GROUP BY 1) SELECT * FROM s")
def text_tfidf_top(spark, d):
    return T.tfidf(docs(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.round(F.max("tfidf"), 5).alias("top"))


@query("text_ctfidf", f"""WITH {TERMS}, r AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT lang, term, count(*) AS tf FROM x GROUP BY ALL), i AS (SELECT term, ln((1 + (SELECT count(*) FROM r)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1),
 w AS (SELECT lang, term, tf * idf AS w FROM c JOIN i USING (term)), m AS (SELECT lang, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) SELECT lang, term, round(w / norm * (SELECT avg(n) FROM r) / n, 5) AS score FROM w JOIN m USING (lang) JOIN r USING (lang) WHERE w / norm > 0.02""")
def text_ctfidf(spark, d):
    out = T.class_tfidf(docs(spark, d), "lang", "text")
    rows = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    mean = rows.agg(F.avg("n").alias("m"))
    out = out.join(rows, "lang").join(F.broadcast(mean), F.lit(True)).where(F.col("score") * F.col("n") / F.col("m") > 0.02)
    return out.select("lang", "term", F.round("score", 5).alias("score"))


@query("text_pii_counts", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}'))::INT AS n_{k}" for k, p in T.PII.items()) + " FROM documents")
def text_pii_counts(spark, d):
    return T.pii_counts(docs(spark, d), "text").select("doc_id", *[f"n_{k}" for k in T.PII])


def _replaced(c):
    for k, p in T.PII.items():
        c = f"regexp_replace({c}, '{p}', '[{k.upper()}]', 'g')"
    return c


@query("text_anonymize", f"SELECT doc_id, md5({_replaced('text')}) AS h FROM documents")
def text_anonymize(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.anonymize(F.col("text"))).alias("h"))


@query("text_rake")
def text_rake(spark, d):
    return T.keywords_rake(table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"), "id", "text", 5)


@query("embedding_topk", "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS c FROM embeddings, q) SELECT vec_id, round(c, 5) AS similarity FROM s ORDER BY c DESC, vec_id LIMIT 20")
def embedding_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").select("embedding").head()[0]  # one row
    return T.most_similar(e, "vec_id", "embedding", q, 20).withColumn("similarity", F.round("similarity", 5))


@query("topic_model")
def topic_model(spark, d):
    return T.topic_model(docs(spark, d), "doc_id", "text", 3)[0]


@query("document_embeddings")
def document_embeddings(spark, d):
    return T.document_embeddings(table(spark, d, "documents"), "doc_id", "text", size=16)[0]


@query("nmf_topics")
def nmf_topics(spark, d):
    return N.nmf(docs(spark, d), "doc_id", "text", 4)[0]


@query("nmf_document_topics")
def nmf_document_topics(spark, d):
    return N.nmf(docs(spark, d), "doc_id", "text", 4)[1]


@query("topic_coherence", f"""WITH {TERMS}, c AS (SELECT DISTINCT doc_id, term FROM x), g AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS rk FROM c JOIN documents USING (doc_id) GROUP BY lang, term), t AS (SELECT dense_rank() OVER (ORDER BY lang) - 1 AS topic, term FROM g WHERE rk <= 6),
 n AS (SELECT count(*)::DOUBLE AS n FROM documents), f AS (SELECT term, count(*)::DOUBLE AS df FROM c GROUP BY 1), q AS (SELECT a.topic, a.term AS a, b.term AS b, x.df AS x, y.df AS y FROM t a JOIN t b ON a.topic = b.topic AND a.term < b.term JOIN f x ON x.term = a.term JOIN f y ON y.term = b.term),
 m AS (SELECT q.*, (SELECT count(*) FROM c p JOIN c r ON p.doc_id = r.doc_id WHERE p.term = q.a AND r.term = q.b)::DOUBLE AS k FROM q)
 SELECT topic::INT AS topic, round(avg(CASE WHEN k = 0 THEN -1 ELSE ln(k * n / (x * y)) / -ln(k / n) END), 6) AS npmi, round(avg(k / (x * y)), 8) AS lift FROM m, n GROUP BY topic""")
def topic_coherence(spark, d):
    """Of the six terms that most documents of each language hold."""
    df = docs(spark, d)
    found = T.document_terms(T.worded(df, "doc_id", "text", "lang"), "doc_id", "lang").groupBy("lang", "term").agg(F.count("*").alias("n"))
    best = found.withColumn("rk", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "term"))).where("rk <= 6")
    names = [r["lang"] for r in df.select("lang").distinct().orderBy("lang").collect()]
    number = F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int") - 1
    topics = best.select(number.alias("topic"), "term")
    return N.coherence(df, "doc_id", "text", topics).select("topic", F.round("npmi", 6).alias("npmi"), F.round("lift", 8).alias("lift"))
