"""Registered text-labelling queries (C1-C9) over the driver's text tables.

Documents stand in for review texts (doc_id as review_id, source as product);
since the default Hangul filter empties this Latin-script prose, the cleaner keeps
letters and digits of every script here (``LATIN_TEST_CLASS``)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import labels as L
from ..operators import scorers as SC
from ..sources import fixture
from ..sources.io import balanced
from .params import AS_OF
from .registry import register

WS = T.WS
STOP_TEST = ("the", "and", "of", "le", "la", "de", "der", "die", "und", "el", "y")
WINDOW = 12


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def toks_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> '')"


def clean_sql(x: str, stop) -> str:
    t = f"regexp_replace(coalesce(CAST({x} AS VARCHAR), 'None'), '{T.LAUGH_RUNS}', '', 'g')"
    t = f"regexp_replace({t}, '[^{T.LATIN_TEST_CLASS}{WS}]', '', 'g')"
    return f"array_to_string(list_filter({toks_sql(t)}, lambda w: NOT list_contains({_list(sorted(set(stop)))}, w)), ' ')"


def hits_sql(toks: str, words) -> str:
    return f"len(list_filter({toks}, lambda t: list_contains({_list(words)}, lower(t))))"


def topics_sql(s: str) -> str:
    tk = toks_sql(s)
    labels = list(K.CLASSIFIER_TOPICS)
    logits = "[" + ", ".join(f"CAST({hits_sql(tk, T.TOPIC_LEXICON.get(l, ()))} AS DOUBLE) - 0.5" for l in labels) + "]"
    return topics_from_logits_sql(logits)


def topics_from_logits_sql(logits: str) -> str:
    labels = _list(K.CLASSIFIER_TOPICS)
    idx = f"list_filter(range(1, {len(K.CLASSIFIER_TOPICS) + 1}), lambda i: 1.0 / (1.0 + exp(-CAST(({logits})[i] AS DOUBLE))) > 0.5)"
    kept = f"list_transform({idx}, lambda i: {labels}[i])"
    return f"array_to_string(CASE WHEN len({kept}) > 0 THEN {kept} ELSE ['{K.FALLBACK_TOPIC}'] END, ',')"


def sentiment_sql(s: str) -> str:
    tk = toks_sql(s)
    v = (f"[CAST({hits_sql(tk, T.NEGATIVE_WORDS)} AS DOUBLE), 0.5, "
         f"CAST({hits_sql(tk, T.POSITIVE_WORDS)} AS DOUBLE)]")
    return f"CAST(list_position({v}, list_max({v})) - 1 AS INTEGER)"


DOC_REVIEWS = f"""
 docs AS (SELECT doc_id AS review_id, source AS product_id, text AS review_text,
                 CAST(n_chars % 5 + 1 AS DOUBLE) AS rating, DATE '{AS_OF}' AS review_date FROM documents),
 cl AS (SELECT review_id, product_id, rating, review_date, {toks_sql(clean_sql('review_text', STOP_TEST))} AS w FROM docs),
 sent AS (SELECT review_id, product_id, rating, review_date, i AS pos,
                 array_to_string(w[i * {WINDOW} + 1 : i * {WINDOW} + {WINDOW}], ' ') AS sentence
          FROM cl, LATERAL (SELECT unnest(range(0, CAST(ceil(len(w) / {WINDOW}.0) AS BIGINT))) AS i) r)"""


def _text_table(spark, sf, name):
    return balanced(fixture(spark, sf).table(name))


def _docs(spark, sf):
    d = _text_table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("review_id"), F.col("source").alias("product_id"),
                    F.col("text").alias("review_text"), (F.col("n_chars") % 5 + 1).cast("double").alias("rating"),
                    F.lit(AS_OF).cast("date").alias("review_date"))


@register("clean_text", f"""
SELECT doc_id, {clean_sql('text', STOP_TEST)} AS cleaned FROM documents""")
def q_clean_text(spark, sf):
    d = _text_table(spark, sf, "documents")
    return d.select("doc_id", T.clean_text("text", stopwords=STOP_TEST, keep=T.LATIN_TEST_CLASS).alias("cleaned"))


@register("stopword_removal", f"""
SELECT doc_id, array_to_string(list_filter({toks_sql('text')}, lambda w: NOT list_contains({_list(sorted(STOP_TEST))}, w)), ' ') AS text
FROM documents""")
def q_stopword_removal(spark, sf):
    d = _text_table(spark, sf, "documents")
    return d.select("doc_id", T.remove_stopwords("text", STOP_TEST).alias("text"))


@register("sentence_explode", f"""{DOC_REVIEWS}
SELECT review_id, pos, sentence FROM sent""")
def q_sentence_explode(spark, sf):
    s = L.sentences(_docs(spark, sf), stopwords=STOP_TEST, keep=T.LATIN_TEST_CLASS, window=WINDOW)
    return s.select("review_id", "pos", "sentence")


@register("sentence_split_punct", f"""
 t AS (SELECT conv_id, turn, regexp_split_to_array(coalesce(text, ''), '{T.SENTENCE_END}') AS arr FROM conversations),
 u AS (SELECT conv_id, turn, i - 1 AS pos, regexp_replace(arr[i], '^[{WS}]+|[{WS}]+$', '', 'g') AS sentence
       FROM t, LATERAL (SELECT unnest(range(1, len(arr) + 1)) AS i) r)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, sentence FROM u WHERE sentence <> ''""")
def q_sentence_split_punct(spark, sf):
    c = _text_table(spark, sf, "conversations")
    s = c.select("conv_id", "turn", F.posexplode(T.split_sentences_punct("text")).alias("pos", "sentence"))
    return s.select("conv_id", "turn", "pos", T.strip_ws("sentence").alias("sentence")).where(F.col("sentence") != "")


def _centroid_logits_sql(classes: int) -> str:
    """vec_id, l: dot products of whole embeddings with the mean embedding of each class (label % classes)."""
    return f"""
 parts AS (SELECT label % {classes} AS c, i, CAST(embedding[i] AS DOUBLE) AS v
           FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) r),
 means AS (SELECT c, i, avg(v) AS m FROM parts GROUP BY 1, 2),
 cents AS (SELECT c, list(m ORDER BY i) AS m FROM means GROUP BY c),
 model AS (SELECT list(m ORDER BY c) AS ms FROM cents),
 lg AS (SELECT vec_id, list_transform(ms, lambda m: list_dot_product(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), m)) AS l
        FROM embeddings, model)"""


def _with_centroid_logits(spark, sf, classes: int):
    e = fixture(spark, sf).embeddings
    model = L.class_centroids(e, "embedding", F.col("label") % classes, classes)
    return e.select("vec_id", L.centroid_logits("embedding", model).alias("l"))


@register("topic_threshold", f"""{_centroid_logits_sql(len(K.CLASSIFIER_TOPICS))}
SELECT vec_id, {topics_from_logits_sql('l')} AS category FROM lg""")
def q_topic_threshold(spark, sf):
    e = _with_centroid_logits(spark, sf, len(K.CLASSIFIER_TOPICS))
    return e.select("vec_id", T.topics_from_logits("l").alias("category"))


@register("sentiment_argmax", f"""{_centroid_logits_sql(3)}
SELECT vec_id, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS sentiment FROM lg""")
def q_sentiment_argmax(spark, sf):
    e = _with_centroid_logits(spark, sf, 3)
    return e.select("vec_id", T.argmax(T.softmax("l")).alias("sentiment"))


@register("text_sentiment")
def q_text_sentiment(spark, sf):
    """The default scorer fitted on the rated documents (low quality: class 0, high: 2) and applied to
    every document (no SQL twin: a trained model)."""
    fx = fixture(spark, sf)
    docs = _text_table(spark, sf, "documents").select("doc_id", "text")
    rated = docs.join(fx.table("labels").select("doc_id", (F.col("quality") * 2).alias("label")), "doc_id")
    return SC.text_sentiment(docs, SC.fit_text_scorer(rated)).select("doc_id", "sentiment")


@register("analysis_rows", f"""{DOC_REVIEWS}
SELECT review_id, product_id, substr(sentence, 1, 255) AS sentence, {topics_sql('sentence')} AS category,
       {sentiment_sql('sentence')} AS sentiment, rating, review_date, pos AS seq FROM sent""")
def q_analysis_rows(spark, sf):
    return L.analysis_rows(_docs(spark, sf), stopwords=STOP_TEST, keep=T.LATIN_TEST_CLASS, window=WINDOW)


@register("sentiment_labels", """
SELECT review_id, sentence, sentiment, CASE sentiment WHEN 0 THEN '부정' WHEN 1 THEN '중립' WHEN 2 THEN '긍정'
       ELSE '알 수 없음' END AS sentiment_label FROM review_analysis""")
def q_sentiment_labels(spark, sf):
    ra = fixture(spark, sf).review_analysis
    return L.with_sentiment_label(ra.select("review_id", "sentence", "sentiment"))


@register("incremental_slice", f"""
SELECT * FROM reviews WHERE review_date = DATE '{AS_OF}'""")
def q_incremental_slice(spark, sf):
    return L.incremental_slice(fixture(spark, sf).reviews, AS_OF)


def _upsert_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"e.{c} = b.{c}" for c in keys)
    kept = [c for c in L.ANALYSIS_COLS if c not in keys and c not in ("category", "sentiment")]
    upd = [c for c in ("category", "sentiment") if c not in keys]
    sel = []
    for c in L.ANALYSIS_COLS:
        if c in keys:
            sel.append(f"coalesce(e.{c}, b.{c}) AS {c}")
        elif c in kept:
            sel.append(f"CASE WHEN e.{c}_p THEN e.{c} ELSE b.{c} END AS {c}")
        else:
            sel.append(f"CASE WHEN b.{c}_p THEN b.{c} ELSE e.{c} END AS {c}")
    first = ", ".join(f"f.{c}" for c in kept)
    last = ", ".join(f"l.{c}" for c in upd)
    return f"""
 ex AS (SELECT * FROM labelled_rows WHERE seq = 1),
 bt AS (SELECT * FROM labelled_rows WHERE seq > 1),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY seq ASC) AS rn FROM bt) t WHERE rn = 1),
 l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY seq DESC) AS rn FROM bt) t WHERE rn = 1),
 b AS (SELECT {", ".join(f"f.{c}" for c in keys)}, {first}, {last}, {", ".join(f"true AS {c}_p" for c in upd)}
       FROM f JOIN l ON {" AND ".join(f"f.{c} = l.{c}" for c in keys)}),
 e AS (SELECT {", ".join(L.ANALYSIS_COLS)}, {", ".join(f"true AS {c}_p" for c in kept)} FROM ex)
SELECT {", ".join(sel)} FROM e FULL OUTER JOIN b ON {on}"""


def _upsert(keys):
    def q(spark, sf):
        lr = fixture(spark, sf).labelled_rows
        return L.upsert_analysis(lr.where(F.col("seq") == 1), lr.where(F.col("seq") > 1), keys, "seq")
    return q


register("analysis_upsert_daily", _upsert_sql(["review_id", "sentence"]))(_upsert(["review_id", "sentence"]))
register("analysis_upsert_cumulative", _upsert_sql(["review_id", "category"]))(_upsert(["review_id", "category"]))
