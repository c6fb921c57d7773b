"""Queries over short texts with a sentiment, a source and a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.functions.dates import part_of_day, wall_clock
from tarn.operators import collocations, features, profile, share, textmodel
from tarn.plans import stem_sql
from tarn.sources import ordinals, readers, schemas

ROW, FIRST, LENGTH = 3, 10, 12
CODES = {"negative": 1, "neutral": 0, "positive": 0}


_tweets = readers.tweets


def _tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = readers.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("tweet_id"), X.tidy(F.col("text")).alias("tidy_text"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = readers.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("tweet_id"), X.tidy_tokens(F.col("text")).alias("tokens"))


def _length(spark: SparkSession, sf_dir: str, *columns: str, labelled: bool = False) -> DataFrame:
    return _tweets(spark, sf_dir, "text", *columns, labelled=labelled).withColumn("length", F.length("text"))


def tweets_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.row_count(_tweets(spark, sf_dir, "tweet_id"))


def tweets_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.head(_tweets(spark, sf_dir), "tweet_id")


def first_n_enumerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.enumerated(_tweets(spark, sf_dir, "tweet_id", "text"), "tweet_id", FIRST).select("ordinal", "text")


def row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.row_at(_tweets(spark, sf_dir), "tweet_id", ROW)


def tweets_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_counts(_tweets(spark, sf_dir))


def tweets_mean_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = profile.means(_tweets(spark, sf_dir, "airline_sentiment", "airline_sentiment_confidence", "retweet_count", labelled=True), "airline_sentiment")
    return made.select("airline_sentiment", *(F.round(c, 6).alias(c) for c in made.columns[1:]))


def tweets_describe_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = profile.summary(_length(spark, sf_dir), "length")
    return made.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


def tweets_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first text of the greatest length."""
    made = _length(spark, sf_dir, "tweet_id").select("tweet_id", "text", "length")
    return made.orderBy(F.desc("length"), "tweet_id").limit(1)


def tweets_of_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first text with a given number of characters."""
    made = _length(spark, sf_dir, "tweet_id").where(F.col("length") == LENGTH).select("tweet_id", "text", "length")
    return profile.head(made, "tweet_id", 1)


def tweets_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = profile.histogram(_length(spark, sf_dir), "length")
    return made.withColumns({c: F.round(c, 6) for c in ("lo", "hi")})


def tweets_hist_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = profile.histogram(_length(spark, sf_dir, "airline_sentiment", labelled=True), "length", "airline_sentiment")
    return made.withColumns({c: F.round(c, 6) for c in ("lo", "hi")})


def tweets_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.frequencies(_tweets(spark, sf_dir, "airline_sentiment", labelled=True), "airline_sentiment")


def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.frequencies(_tweets(spark, sf_dir, "negativereason", labelled=True), "negativereason")


def tweets_part_of_day_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = share.part_of_day_share(_tweets(spark, sf_dir, "tweet_created", "airline_sentiment", labelled=True), "tweet_created", "airline_sentiment")
    return made.orderBy("part_order", "airline_sentiment")


def tweets_airline_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share.share_of_label(_tweets(spark, sf_dir, "airline", "airline_sentiment", labelled=True), "airline", "airline_sentiment")


def text_strip_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tweet_id"), X.without_handles(F.col("text")).alias("tidy_text"))


def text_charclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tweet_id"), X.letters_only(X.without_handles(F.col("text"))).alias("tidy_text"))


def text_short_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(spark, sf_dir)


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("tweet_id", F.array_join("tokens", " ").alias("tokens"))


def text_word_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _tweets(spark, sf_dir, "text", "airline_sentiment", labelled=True).where("airline_sentiment in ('positive', 'negative')").select("airline_sentiment", X.tidy_tokens(F.col("text")).alias("tokens"))
    top = features.word_frequencies(made, "airline_sentiment", "tokens")
    return top.withColumn("weight", F.round("weight", 8))


def text_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words and pairs of words of a cloud, for each of two labels."""
    made = _tweets(spark, sf_dir, "text", "airline_sentiment", labelled=True).where("airline_sentiment in ('positive', 'negative')").select("airline_sentiment", X.tidy_tokens(F.col("text")).alias("tokens"))
    terms = collocations.cloud_words(made, "airline_sentiment", "tokens")
    return terms.withColumns({"weight": F.round("weight", 8), "score": F.round("score", 6)})


def text_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _tokens(spark, sf_dir)
    return features.stems(made, "tweet_id", "tokens").select("tweet_id", "stemmed")


def _bag(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _tidy(spark, sf_dir)
    return docs, features.bag_of_words(docs, "tweet_id", "tidy_text")


def text_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.vocabulary(_bag(spark, sf_dir)[1])


def text_vocab_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bag(spark, sf_dir)[1].agg(F.countDistinct("term").alias("n_terms"))


def text_bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bag(spark, sf_dir)[1]


def text_bow_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bag = _bag(spark, sf_dir)
    return features.transform(profile.row_at(docs, "tweet_id", ROW), "tweet_id", "tidy_text", features.vocabulary(bag))


def text_matrix_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.matrix_shape(*_bag(spark, sf_dir), "tweet_id")


def text_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.tfidf(*_bag(spark, sf_dir), "tweet_id")
    return made.withColumn("tfidf", F.round("tfidf", 6))


def text_sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts as one sparse row over the vocabulary of all documents."""
    docs = _tidy(spark, sf_dir)
    bag = readers.kept(features.bag_of_words(docs, "tweet_id", "tidy_text"))
    vocab = readers.kept(features.vocabulary(bag))
    return textmodel.sparse_rows(docs, bag.join(vocab.hint("shuffle_hash"), "term"), "tweet_id", vocab.count())


def _folds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tidy texts of documents with a sentiment, and of those without one."""
    tidy = _tweets(spark, sf_dir, "tweet_id", "text", "airline_sentiment").select("tweet_id", "airline_sentiment", X.tidy(F.col("text")).alias("tidy_text"))
    return tidy.where("airline_sentiment is not null"), tidy.where("airline_sentiment is null")


def _fitted(spark: SparkSession, docs: DataFrame) -> textmodel.TextModel:
    path = readers.scratch(spark)
    textmodel.fit(docs, "tweet_id", "tidy_text").save(path)
    return textmodel.load(spark, path)


def text_model_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF of documents without a sentiment by the stored model of those that have one."""
    known, new = _folds(spark, sf_dir)
    made = textmodel.weigh(_fitted(spark, known), new, "tweet_id", "tidy_text")
    return made.withColumn("tfidf", F.round("tfidf", 6))


def text_model_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as sparse rows; documents without known terms have empty ones."""
    known, new = _folds(spark, sf_dir)
    model = _fitted(spark, known)
    made = textmodel.sparse_rows(new, textmodel.weigh(model, new, "tweet_id", "tidy_text"), "tweet_id", model.n_terms, "tfidf")
    return made.withColumn("values", F.transform("values", lambda v: F.round(v, 6)))


def _stemmed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stemmed texts and their bag of words: cleaned, tokens without stop words, stems, joined."""
    made = _tokens(spark, sf_dir)
    docs = features.stems(made, "tweet_id", "tokens").select("tweet_id", "stemmed")
    return docs, features.bag_of_words(docs, "tweet_id", "stemmed")


def text_stem_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.vocabulary(_stemmed(spark, sf_dir)[1])


def text_stem_bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stemmed(spark, sf_dir)[1]


def text_stem_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.tfidf(*_stemmed(spark, sf_dir), "tweet_id")
    return made.withColumn("tfidf", F.round("tfidf", 6))


def tweets_csv_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by hour and part of the day, from a CSV file whose times are texts with an offset."""
    rows = readers.tweets(spark, sf_dir, *(f.name for f in schemas.TWEETS))
    written = rows.withColumn("tweet_created", F.concat(F.date_format("tweet_created", "yyyy-MM-dd HH:mm:ss"), F.lit(" -0800")))
    path = readers.scratch(spark)
    written.write.csv(path, header=True, escape='"', quoteAll=True)
    hours = readers.csv(spark, path, schemas.TWEETS).select(F.hour(wall_clock(F.col("tweet_created"))).alias("tweet_hour"), F.length("text").alias("length"))
    made = hours.groupBy("tweet_hour").agg(F.count("*").alias("n"), F.sum("length").alias("characters"))
    return made.withColumn("part_of_day", part_of_day(F.col("tweet_hour"))).orderBy("tweet_hour")


def _csv_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tweets as CSV files, written by id, and read with the number of each row in the files."""
    rows = readers.tweets(spark, sf_dir, *(f.name for f in schemas.TWEETS)).repartitionByRange("tweet_id").sortWithinPartitions("tweet_id")
    path = readers.scratch(spark)
    rows.withColumn("tweet_created", F.date_format("tweet_created", "yyyy-MM-dd HH:mm:ss")).write.csv(path, header=True, escape='"', quoteAll=True)
    return ordinals.in_file_order(readers.csv(spark, path, schemas.TWEETS))


def csv_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rows of the files."""
    return profile.head(_csv_in_order(spark, sf_dir), "row")


def csv_enumerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten texts of the files and their ordinals."""
    made = _csv_in_order(spark, sf_dir).where(F.col("row") < FIRST)
    return made.select(F.col("row").alias("ordinal"), "text").orderBy("ordinal")


def csv_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of a given label, its place in the files."""
    return profile.row_at(_csv_in_order(spark, sf_dir), "row", ROW)


def text_label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _tweets(spark, sf_dir, "tweet_id", "airline_sentiment")
    return features.recoded(made, "airline_sentiment", CODES, "airline_sentiment_model")


_T = f"WITH t AS ({readers.TWEETS_SQL})"
_L = f"{_T}, l AS (SELECT *, length(text) AS length FROM t)"
_WORD = r"[\p{L}\p{M}\p{N}_]"
_STRIP = f"list_reduce(list_prepend(text, regexp_extract_all(text, '@{_WORD}*')), lambda a, h: replace(a, h, ''))"
_CLASS = f"regexp_replace({_STRIP}, '[^a-zA-Z#]', ' ', 'g')"
_SHORT = f"array_to_string(list_filter(string_split({_CLASS}, ' '), lambda w: length(w) > 3), ' ')"
_STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_TOKENS = f"list_filter(string_split(replace({{0}}, '#', ''), ' '), lambda w: length(w) > 0 AND NOT list_contains({_STOPS}, lower(w)))"
_DOCS = f"d AS (SELECT doc_id AS tweet_id, {_SHORT} AS tidy_text FROM documents)"
_BAG = rf"{_DOCS}, w AS (SELECT tweet_id, unnest(regexp_extract_all(lower(tidy_text), '[a-z]{{2,}}')) AS term FROM d), b AS (SELECT tweet_id, term, count(*) AS tf FROM w GROUP BY 1, 2)"
_STEMS = f"""{_DOCS}, k AS (SELECT tweet_id, {_TOKENS.format('tidy_text')} AS tokens FROM d), x AS (SELECT tweet_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS place FROM k),
{stem_sql.stems('SELECT DISTINCT token FROM x')},
j AS (SELECT tweet_id, string_agg(stem, ' ' ORDER BY place) AS stemmed FROM x JOIN stems ON stems.token = x.token GROUP BY 1)"""
_STEM_BAG = rf"{_STEMS}, w AS (SELECT tweet_id, unnest(regexp_extract_all(stemmed, '[a-z]{{2,}}')) AS term FROM j), b AS (SELECT tweet_id, term, count(*) AS tf FROM w GROUP BY 1, 2)"
_VOCAB = "v AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_id FROM (SELECT DISTINCT term FROM b))"
_MODEL = f"""{_T}, a AS (SELECT tweet_id, airline_sentiment IS NOT NULL AS known, {_SHORT} AS tidy_text FROM t),
w AS (SELECT tweet_id, known, unnest(regexp_extract_all(lower(tidy_text), '[a-z]{{2,}}')) AS term FROM a),
b AS (SELECT tweet_id, known, term, count(*) AS tf FROM w GROUP BY ALL),
f AS (SELECT term, count(*) AS df, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_id FROM b WHERE known GROUP BY term),
u AS (SELECT tweet_id, b.term, term_id, tf, tf * (ln(CAST(1 + (SELECT count(*) FROM a WHERE known) AS DOUBLE) / (1 + df)) + 1) AS weight FROM b JOIN f ON f.term = b.term WHERE NOT known),
m AS (SELECT tweet_id, term, term_id, tf, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY tweet_id)), 6) AS tfidf FROM u)"""
_ROWS = "SELECT d.tweet_id, (SELECT count(*) FROM {vocab}) AS size, coalesce(c.indices, []) AS indices, coalesce(c.values, []) AS values FROM {docs} d LEFT JOIN (SELECT tweet_id, list(term_id ORDER BY term_id) AS indices, list({value} ORDER BY term_id) AS values FROM {cells} GROUP BY 1) c ON c.tweet_id = d.tweet_id"
_CSV = f"{_T}, o AS (SELECT tweet_id, text, airline, airline_sentiment, airline_sentiment_confidence, negativereason, retweet_count, strftime(tweet_created, '%Y-%m-%d %H:%M:%S') AS tweet_created, row_number() OVER (ORDER BY tweet_id) - 1 AS row FROM t)"
_TFIDF = """f AS (SELECT term, count(*) AS df FROM b GROUP BY 1),
u AS (SELECT tweet_id, b.term, tf * (ln(CAST(1 + (SELECT count(*) FROM documents) AS DOUBLE) / (1 + df)) + 1) AS weight FROM b JOIN f ON f.term = b.term)
SELECT tweet_id, term, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY tweet_id)), 6) AS tfidf FROM u"""
_PARTS = "CASE WHEN hour(tweet_created) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(tweet_created) BETWEEN 12 AND 18 THEN 'afternoon' WHEN hour(tweet_created) BETWEEN 19 AND 24 THEN 'night' ELSE 'dawn' END"


def _share_sql(key: str, value: str, more: str = "") -> str:
    return f"""{_T}, c AS (SELECT {value} AS {key}, airline_sentiment, count(*) AS n FROM t WHERE airline_sentiment IS NOT NULL AND ({value}) IS NOT NULL GROUP BY 1, 2)
SELECT {key}, airline_sentiment, n, round_even(CAST(100 AS DOUBLE) * n / CAST(sum(n) OVER (PARTITION BY airline_sentiment) AS BIGINT), 0) AS percentage{more} FROM c"""


def _hist_sql(by: str | None) -> str:
    key, part = (f"{by}, ", f"WHERE {by} IS NOT NULL") if by else ("", "")
    on = f"USING ({by})" if by else "ON true"
    return f"""{_L}, r AS (SELECT {key}min(length) AS mn, max(length) AS mx FROM l {part} {f'GROUP BY {by}' if by else ''}),
e AS (SELECT *, CASE WHEN mn = mx THEN mn - 0.5::DOUBLE ELSE mn END AS a, CASE WHEN mn = mx THEN mx + 0.5::DOUBLE ELSE mx END AS z FROM r),
k AS (SELECT {f'l.{by}, ' if by else ''}least(CAST(floor((length - a) * 20 / (z - a)) AS INTEGER) + 1, 20) AS bin, count(*) AS n FROM l JOIN e {on} GROUP BY ALL),
g AS (SELECT {key}a, z, CAST(unnest(range(1, 21)) AS INTEGER) AS bin FROM e)
SELECT {f'g.{by}, ' if by else ''}g.bin, round(a + (g.bin - 1) * (z - a) / 20, 6) AS lo, round(a + g.bin * (z - a) / 20, 6) AS hi, coalesce(n, 0) AS n
FROM g LEFT JOIN k ON g.bin = k.bin {f'AND g.{by} = k.{by}' if by else ''}"""


def _folded_sql(name: str, counts: str) -> str:
    """``name``: counts of words (s, word, n) with cases and plurals folded, as (s, stem, word, n)."""
    return f"""{name}0 AS (SELECT s, word, n, CASE WHEN ends_with(lower(word), 's') AND NOT ends_with(lower(word), 'ss') THEN left(lower(word), length(word) - 1) ELSE lower(word) END AS stem FROM ({counts})),
{name}1 AS (SELECT *, bool_or(lower(word) = stem) OVER (PARTITION BY s, stem) AS has FROM {name}0),
{name}2 AS (SELECT s, stem, CASE WHEN has AND lower(word) <> stem THEN left(word, length(word) - 1) ELSE word END AS form, sum(n) AS n FROM {name}1 GROUP BY ALL),
{name} AS (SELECT s, stem, first(form ORDER BY n DESC, form) AS word, CAST(sum(n) AS BIGINT) AS n FROM {name}2 GROUP BY s, stem)"""


def _collocations_sql() -> str:
    stops = "[" + ", ".join(f"'{w}'" for w in collocations.CLOUD_STOP_WORDS) + "]"
    stem = "CASE WHEN ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN left(x, length(x) - 1) ELSE x END"

    def odds(k: str, n: str, p: str) -> str:
        return f"(({k}) * ln(greatest({p}, 1e-10)) + (({n}) - ({k})) * ln(greatest(1 - ({p}), 1e-10)))"

    overall, after, elsewhere = "b / m", "k / a", "(b - k) / (m - a)"
    score = f"2 * ({odds('k', 'a', after)} + {odds('b - k', 'm - a', elsewhere)} - {odds('k', 'a', overall)} - {odds('b - k', 'm - a', overall)})"
    return f"""{_T}, x AS (SELECT airline_sentiment AS s, {_TOKENS.format(_SHORT)} AS tokens FROM t WHERE airline_sentiment IN ('positive', 'negative')),
e AS (SELECT s, unnest(tokens) AS word, unnest(list_append(tokens[2:], NULL)) AS follower FROM x),
p AS (SELECT s, word, CASE WHEN NOT list_contains({stops}, lower(follower)) THEN follower END AS follower, count(*) AS n FROM e WHERE NOT list_contains({stops}, lower(word)) GROUP BY ALL),
{_folded_sql('w', 'SELECT s, word, sum(n) AS n FROM p GROUP BY ALL')},
{_folded_sql('z', "SELECT s, word || ' ' || follower AS word, sum(n) AS n FROM p WHERE follower IS NOT NULL GROUP BY ALL")},
y AS (SELECT s, word, n, {stem.replace('x', "lower(split_part(word, ' ', 1))")} AS one, {stem.replace('x', "lower(split_part(word, ' ', 2))")} AS two FROM z),
k AS (SELECT y.s, y.word, y.n, one, two, CAST(y.n AS DOUBLE) AS k, CAST(f.n AS DOUBLE) AS a, CAST(g.n AS DOUBLE) AS b, CAST((SELECT sum(n) FROM w WHERE w.s = y.s) AS DOUBLE) AS m FROM y JOIN w f ON f.s = y.s AND f.stem = one JOIN w g ON g.s = y.s AND g.stem = two),
q AS (SELECT * FROM (SELECT s, word, n, one, two, {score} AS score FROM k) WHERE score > {collocations.THRESHOLD}),
r AS (SELECT s, stem, sum(n) AS taken FROM (SELECT s, one AS stem, n FROM q UNION ALL SELECT s, two, n FROM q) GROUP BY ALL),
u AS (SELECT w.s, w.word, CAST(w.n - coalesce(taken, 0) AS BIGINT) AS n, NULL::DOUBLE AS score FROM w LEFT JOIN r ON r.s = w.s AND r.stem = w.stem UNION ALL SELECT s, word, n, score FROM q),
v AS (SELECT *, CAST(row_number() OVER (PARTITION BY s ORDER BY n DESC, word) AS INTEGER) AS place, round(CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY s), 8) AS weight FROM u WHERE n > 0)
SELECT s AS airline_sentiment, word, n, round(score, 6) AS score, place, weight FROM v WHERE place <= 200"""


_COLUMNS = ["tweet_id", "text", "airline", "airline_sentiment", "negativereason", "airline_sentiment_confidence", "retweet_count", "tweet_created"]
QUERIES = {
    f.__name__: f
    for f in (
        tweets_count, tweets_head, first_n_enumerated, row_lookup, tweets_null_counts, tweets_mean_by_label, tweets_describe_length, tweets_longest, tweets_of_length,
        tweets_hist, tweets_hist_by_label, tweets_label_counts, reason_counts, tweets_part_of_day_share, tweets_airline_share, text_strip_handles, text_charclass,
        text_short_words, text_tokens, text_word_freq, text_stems, text_vocab, text_vocab_size, text_bow, text_bow_one, text_matrix_shape, text_tfidf, text_label_model,
        text_stem_vocab, text_stem_bow, text_stem_tfidf, tweets_csv_hours, text_collocations, text_sparse_rows,
        text_model_applied, text_model_sparse, csv_head, csv_enumerated, csv_row,
    )
}
SQL = {
    "tweets_count": f"{_T} SELECT count(*) AS n FROM t",
    "tweets_head": f"{_T} SELECT * FROM t ORDER BY tweet_id LIMIT 5",
    "first_n_enumerated": f"{_T}, o AS (SELECT CAST(row_number() OVER (ORDER BY tweet_id) - 1 AS INTEGER) AS ordinal, text FROM t) SELECT ordinal, text FROM o WHERE ordinal < {FIRST}",
    "row_lookup": f"{_T} SELECT * FROM t WHERE tweet_id = {ROW}",
    "tweets_null_counts": f"{_T} SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in _COLUMNS) + " FROM t",
    "tweets_mean_by_label": f"{_T} SELECT airline_sentiment, round(avg(airline_sentiment_confidence), 6) AS mean_airline_sentiment_confidence, round(avg(retweet_count), 6) AS mean_retweet_count FROM t WHERE airline_sentiment IS NOT NULL GROUP BY 1",
    "tweets_describe_length": f"{_L} SELECT count(length) AS n, round(avg(length), 6) AS mean, round(stddev_samp(length), 6) AS std, CAST(min(length) AS INTEGER) AS min, quantile_cont(length, 0.25) AS q25, quantile_cont(length, 0.5) AS median, quantile_cont(length, 0.75) AS q75, CAST(max(length) AS INTEGER) AS max FROM l",
    "tweets_longest": f"{_L} SELECT tweet_id, text, CAST(length AS INTEGER) AS length FROM l ORDER BY length DESC, tweet_id LIMIT 1",
    "tweets_of_length": f"{_L} SELECT tweet_id, text, CAST(length AS INTEGER) AS length FROM l WHERE length = {LENGTH} ORDER BY tweet_id LIMIT 1",
    "tweets_hist": _hist_sql(None),
    "tweets_hist_by_label": _hist_sql("airline_sentiment"),
    "tweets_label_counts": f"{_T} SELECT airline_sentiment, count(*) AS n FROM t WHERE airline_sentiment IS NOT NULL GROUP BY 1",
    "reason_counts": f"{_T} SELECT negativereason, count(*) AS n FROM t WHERE negativereason IS NOT NULL GROUP BY 1",
    "tweets_part_of_day_share": _share_sql("part_of_day", _PARTS, ", CAST(list_position(['morning', 'afternoon', 'night', 'dawn'], part_of_day) AS INTEGER) AS part_order"),
    "tweets_airline_share": _share_sql("airline", "airline"),
    "text_strip_handles": f"SELECT doc_id AS tweet_id, {_STRIP} AS tidy_text FROM documents",
    "text_charclass": f"SELECT doc_id AS tweet_id, {_CLASS} AS tidy_text FROM documents",
    "text_short_words": f"WITH {_DOCS} SELECT * FROM d",
    "text_tokens": f"WITH {_DOCS} SELECT tweet_id, array_to_string({_TOKENS.format('tidy_text')}, ' ') AS tokens FROM d",
    "text_word_freq": f"""{_T}, x AS (SELECT airline_sentiment, unnest({_TOKENS.format(_SHORT)}) AS word FROM t WHERE airline_sentiment IN ('positive', 'negative')),
c AS (SELECT airline_sentiment, word, count(*) AS n FROM x GROUP BY 1, 2),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY airline_sentiment ORDER BY n DESC, word) AS INTEGER) AS place, round(CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY airline_sentiment), 8) AS weight FROM c)
SELECT * FROM p WHERE place <= 200""",
    "text_collocations": _collocations_sql(),
    "text_sparse_rows": f"WITH {_BAG}, {_VOCAB}, c AS (SELECT tweet_id, term_id, tf FROM b JOIN v ON v.term = b.term) " + _ROWS.format(vocab="v", docs="d", value="tf", cells="c"),
    "text_model_applied": f"{_MODEL} SELECT * FROM m",
    "text_model_sparse": f"{_MODEL}, d AS (SELECT tweet_id FROM a WHERE NOT known) " + _ROWS.format(vocab="f", docs="d", value="tfidf", cells="m"),
    "csv_head": f"{_CSV} SELECT * FROM o ORDER BY row LIMIT 5",
    "csv_enumerated": f"{_CSV} SELECT row AS ordinal, text FROM o WHERE row < {FIRST}",
    "csv_row": f"{_CSV} SELECT * FROM o WHERE row = {ROW}",
    "text_vocab": f"WITH {_BAG}, {_VOCAB} SELECT * FROM v",
    "text_vocab_size": f"WITH {_BAG} SELECT count(DISTINCT term) AS n_terms FROM b",
    "text_bow": f"WITH {_BAG} SELECT * FROM b",
    "text_bow_one": f"WITH {_BAG}, {_VOCAB} SELECT tweet_id, b.term, term_id, tf FROM b JOIN v ON v.term = b.term WHERE tweet_id = {ROW}",
    "text_matrix_shape": f"WITH {_BAG} SELECT (SELECT count(*) FROM documents) AS n_docs, count(DISTINCT term) AS n_terms, count(*) AS n_nonzero FROM b",
    "text_tfidf": f"WITH {_BAG}, {_TFIDF}",
    "text_stems": f"WITH {_STEMS} SELECT d.tweet_id, coalesce(stemmed, '') AS stemmed FROM d LEFT JOIN j ON j.tweet_id = d.tweet_id",
    "text_stem_vocab": f"WITH {_STEM_BAG}, {_VOCAB} SELECT * FROM v",
    "text_stem_bow": f"WITH {_STEM_BAG} SELECT * FROM b",
    "text_stem_tfidf": f"WITH {_STEM_BAG}, {_TFIDF}",
    "tweets_csv_hours": f"{_T}, h AS (SELECT CAST(hour(tweet_created) AS INTEGER) AS tweet_hour, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters FROM t GROUP BY 1) SELECT *, {_PARTS.replace('hour(tweet_created)', 'tweet_hour')} AS part_of_day FROM h",
    "text_label_model": f"{_T} SELECT tweet_id, airline_sentiment, CAST(CASE airline_sentiment WHEN 'negative' THEN 1 WHEN 'neutral' THEN 0 WHEN 'positive' THEN 0 END AS INTEGER) AS airline_sentiment_model FROM t",
}
