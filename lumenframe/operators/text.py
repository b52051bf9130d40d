"""Text analytics in built-in expressions: cleaning, statistics, readability, sentiment, terms, personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import clip, ratio
from ..sources.tables import materialize

#: Sentiment words.
POSITIVE = """good great excellent positive best amazing wonderful fantastic beautiful happy love joy success successful win winning
    perfect brilliant""".split()
NEGATIVE = """bad terrible awful negative worst horrible poor sad hate fail failure lose losing difficult wrong problem trouble
    angry upset""".split()
#: Words that split key phrases.
STOPWORDS = """a an the and or but is are was were in on at to for with by about like from of that this these those it its it's he
    she they them their have has had do does did can could will would should""".split()
#: Patterns of personal data.
PII = {"email": r"[\w.+-]+@[\w-]+(\.[\w-]+)+", "phone": r"\+?\d{1,3}[ -]?\(?\d{2,4}\)?([ -]?\d{2,4}){2,4}", "ip_address": r"\b\d{1,3}(\.\d{1,3}){3}\b", "ssn": r"\b\d{3}-\d{2}-\d{4}\b", "credit_card": r"\b\d{4}([ -]?\d{4}){3}\b"}


#: Characters of text that one task of Word2Vec learns from.
TRAINING_PART = 1 << 25
#: A table of at most so many terms is broadcast.
VOCABULARY = 1_000_000


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def words(c: Column, min_length: int = 3, stopwords: list[str] | None = None) -> Column:
    """The words of a text in lower case: punctuation and digits to spaces, short tokens and stop words dropped."""
    c = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " "), r"\d+", " ")
    kept = F.filter(F.split(c, r"\s+"), lambda w: F.length(w) >= max(1, min_length))
    return F.array_except(kept, F.array(*map(F.lit, stopwords))) if stopwords else kept


def clean(c: Column, min_length: int = 3, stopwords: list[str] | None = None) -> Column:
    """The ``words`` of a text, joined by a space."""
    return F.array_join(words(c, min_length, stopwords), " ")


def text_stats(df: DataFrame, column: str, prefix: str = "text") -> DataFrame:
    """Character and word counts, mean word length, upper-case words, distinct words and their share."""
    c, ws = F.coalesce(F.col(column), F.lit("")), F.col("_ws")
    df = df.withColumn("_ws", tokens(F.col(column)))
    size = F.size(ws)
    lengths = F.aggregate(ws, F.lit(0), lambda a, w: a + F.length(w))
    upper = F.size(F.filter(ws, lambda w: (F.upper(w) == w) & (F.lower(w) != w)))
    unique = F.size(F.array_distinct(F.transform(ws, F.lower)))
    new = {"char_count": F.length(c), "word_count": size, "avg_word_length": F.coalesce(ratio(lengths, size), F.lit(0.0)), "uppercase_count": upper, "unique_word_count": unique, "unique_word_ratio": F.coalesce(ratio(unique, size), F.lit(0.0)), "digit_ratio": F.coalesce(ratio(F.regexp_count(c, F.lit(r"\d")), F.length(c)), F.lit(0.0))}
    return df.withColumns({f"{prefix}_{k}": v for k, v in new.items()}).drop("_ws")


def syllables(w: Column) -> Column:
    """Vowel groups, less one for a final e, at least one."""
    w = F.lower(w)
    return F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")) - F.when(w.endswith("e"), 1).otherwise(0))


def readability(df: DataFrame, column: str, prefix: str = "text") -> DataFrame:
    """Flesch ease (0 to 100) and Flesch-Kincaid grade (0 to 18); an empty text has 0."""
    df = df.withColumn("_ws", tokens(F.col(column)))
    n = F.size("_ws")
    sentences = F.greatest(F.lit(1), F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit("[.!?]")))
    per_word = ratio(F.aggregate("_ws", F.lit(0), lambda a, w: a + syllables(w)), n)
    per_sentence = ratio(n, sentences)
    ease = clip(206.835 - 1.015 * per_sentence - 84.6 * per_word, 0.0, 100.0)
    grade = clip(0.39 * per_sentence + 11.8 * per_word - 15.59, 0.0, 18.0)
    filled = lambda c: F.when(n > 0, c).otherwise(F.lit(0.0))
    return df.withColumns({f"{prefix}_flesch_ease": filled(ease), f"{prefix}_fk_grade": filled(grade)}).drop("_ws")


def sentiment(c: Column) -> Column:
    """(positive - negative) / (positive + negative) over lexicon words, 0 without any."""
    ws = F.transform(tokens(c), F.lower)
    pos, neg = F.size(F.filter(ws, lambda w: w.isin(POSITIVE))), F.size(F.filter(ws, lambda w: w.isin(NEGATIVE)))
    return F.coalesce(ratio(pos - neg, pos + neg), F.lit(0.0))


def worded(df: DataFrame, id_col: str, column: str, *others: str) -> DataFrame:
    """(id, others, _ws): the words of every text, cleaned once and written."""
    return materialize(df.select(id_col, *others, words(F.col(column)).alias("_ws")), "words")


def counted(texts: DataFrame, id_col: str) -> DataFrame:
    """(id, term, tf) of a table (id, _ws), whose rows are shuffled by id, and not their terms."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select(id_col, "_ws").repartition(parts, id_col)
    return dealt.select(id_col, F.explode("_ws").alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def term_counts(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, term, tf) of cleaned texts."""
    return counted(df.select(id_col, words(F.col(column)).alias("_ws")), id_col)


def document_terms(texts: DataFrame, id_col: str, *others: str) -> DataFrame:
    """(id, others, term): the different terms of every id of a table (id, others, _ws), without a shuffle where ids have one row."""
    if texts.groupBy(id_col).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        return texts.select(id_col, *others, F.explode(F.array_distinct("_ws")).alias("term"))
    found = counted(texts, id_col).drop("tf")
    return found.join(texts.select(id_col, *others), id_col).select(id_col, *others, "term") if others else found


def bag_of_words(df: DataFrame, id_col: str, column: str, max_features: int = 1000) -> DataFrame:
    """term_counts for the terms in the most documents (ties by term); the vocabulary is bounded, so it is broadcast.

    The terms are found first, and only theirs are counted.
    """
    texts = worded(df, id_col, column)
    top = document_terms(texts, id_col).groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(max_features)
    found = texts.select(id_col, F.explode("_ws").alias("term")).join(F.broadcast(materialize(top, "vocabulary")), "term")
    return found.groupBy(id_col, "term", "df").agg(F.count("*").alias("tf")).select("term", id_col, "tf", "df")


def tfidf(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, term, tfidf): smooth idf ln((1 + N) / (1 + df)) + 1, rows of unit length."""
    texts = worded(df, id_col, column)
    n = df.agg(F.count("*").alias("n"))
    held = document_terms(texts, id_col).groupBy("term").agg(F.count("*").alias("df"))
    idf = materialize(held.join(F.broadcast(n), F.lit(True)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    raw = counted(texts, id_col).join(F.broadcast(idf) if idf.count() <= VOCABULARY else idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    return raw.select(id_col, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(id_col)))).alias("tfidf"))


def class_tfidf(df: DataFrame, class_col: str, column: str) -> DataFrame:
    """(class, term, score): TF-IDF over classes as documents, times mean class size over class size (in rows)."""
    classes = df.groupBy(class_col).agg(F.count("*").alias("rows"))
    sizes = classes.withColumn("scale", F.avg("rows").over(W.partitionBy()) / F.col("rows"))
    counts = df.select(class_col, F.explode(tokens(clean(F.col(column)))).alias("term")).groupBy(class_col, "term").agg(F.count("*").alias("tf"))
    n = classes.agg(F.count("*").alias("n"))
    idf = counts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n), F.lit(True)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy(class_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).join(sizes, class_col)
    return raw.join(norms, class_col).select(class_col, "term", (F.col("w") / F.col("norm") * F.col("scale")).alias("score"))


def top_terms(scores: DataFrame, key: str, score: str, k: int = 10) -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc(score), "term")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keywords_rake(df: DataFrame, id_col: str, column: str, k: int = 10) -> DataFrame:
    """(id, term, score): runs of words between stop words and punctuation; the score is the mean frequency of their words."""
    text = F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), r"(?U)[^\w\s]+", " | ")
    stop = r"(?U)\b(" + "|".join(STOPWORDS) + r")\b"
    phrases = F.filter(F.transform(F.split(F.regexp_replace(text, stop, "|"), r"\|"), F.trim), lambda p: p != "")
    rows = df.select(id_col, F.explode(F.array_distinct(F.transform(phrases, lambda p: F.regexp_replace(p, r"\s+", " ")))).alias("term"), phrases.alias("_all"))
    words = df.select(id_col, F.explode(F.flatten(F.transform(phrases, lambda p: F.split(p, r"\s+")))).alias("w")).groupBy(id_col, "w").agg(F.count("*").alias("f"))
    split = rows.select(id_col, "term", F.explode(F.split("term", " ")).alias("w")).join(words, [id_col, "w"])
    return top_terms(split.groupBy(id_col, "term").agg(F.avg("f").alias("score")), id_col, "score", k)


def pii_counts(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({f"n_{k}": F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(p)) for k, p in PII.items()})


def anonymize(c: Column) -> Column:
    """Personal data replaced by its kind in brackets."""
    for k, p in PII.items():
        c = F.regexp_replace(c, p, f"[{k.upper()}]")
    return c


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def most_similar(df: DataFrame, id_col: str, vector: str, query: list[float], k: int = 10) -> DataFrame:
    """The k rows closest to one vector by cosine; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(id_col, cosine(F.col(vector), q).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def document_embeddings(df: DataFrame, id_col: str, column: str, size: int = 50, min_count: int = 2, iterations: int = 1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """((id, embedding) of every text, (word, embedding)): Word2Vec, a text being the mean of its words; zeros without a known word.

    Every TRAINING_PART characters are learned in a task of their own, whose vectors are averaged; one task would read all texts.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    x = df.select(id_col, F.coalesce(tokens(clean(F.col(column))), F.array().cast("array<string>")).alias("ws"))
    chars = df.agg(F.sum(F.length(column))).head()[0] or 0
    model = Word2Vec(numPartitions=1 + chars // TRAINING_PART, vectorSize=size, minCount=min_count, maxIter=iterations, seed=seed, inputCol="ws", outputCol="v").fit(x)
    return model.transform(x).select(id_col, vector_to_array("v").alias("embedding")), model.getVectors().select("word", vector_to_array("vector").alias("embedding"))


def topic_model(df: DataFrame, id_col: str, column: str, n_topics: int = 5, max_features: int = 1000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """LDA: (topic, term, weight) of the ten heaviest terms, and (id, topic weights) of all documents."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    x = df.select(id_col, tokens(clean(F.col(column))).alias("ws"))
    cv = CountVectorizer(inputCol="ws", outputCol="features", vocabSize=max_features, minDF=2.0).fit(x)
    x = cv.transform(x)
    model = LDA(k=n_topics, maxIter=5, seed=seed).fit(x)
    vocabulary = F.array(*map(F.lit, cv.vocabulary))
    t = model.describeTopics(10).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("z"))
    terms = t.select("topic", F.get(vocabulary, F.col("z.termIndices")).alias("term"), F.col("z.termWeights").alias("weight"))
    return terms, model.transform(x).select(id_col, vector_to_array("topicDistribution").alias("weights"))
