"""Keyword queries over documents."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..functions import flag
from ..operators.components import component_variance
from ..operators.keywords import (
    join_response, keyword_appearance, keyword_iv, matrix_to_pairs, presence_lists, presence_matrix, principal_variance,
    text_to_pairs,
)
from ..session import materialise
from .registry import query, rounded, table

# Words the queries look for: fixed values.
WORDS = ["the", "de", "und", "que", "tion", "les", "src1", "en", "e", "ztreal"]
STUDY_WORDS = (
    "the of de and to in a la der is en that it for was on die with be que le as er des und by this et are at re an "
    "from th les un es el nd ha den st ou von ing tion zu nt ly du"
).split()


# 4,913 words: every run of three of these letters
MANY_LETTERS = "abcdefghilmnoprst"
MANY_WORDS = ["".join(p) for p in product(MANY_LETTERS, repeat=3)]
MANY_SQL = f"""SELECT a || b || c AS keyword, CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS INTEGER) AS position
   FROM (SELECT unnest(string_split('{MANY_LETTERS}', '')) AS a), (SELECT unnest(string_split('{MANY_LETTERS}', '')) AS b),
        (SELECT unnest(string_split('{MANY_LETTERS}', '')) AS c)"""


def matrix_sql(words, key="doc_id", text="text") -> str:
    cols = ", ".join(f"CAST(contains({text}, '{w}') AS INTEGER) AS \"has_{w}\"" for w in words)
    return f"SELECT {key}, {cols} FROM documents"


@query("K1_presence_matrix", matrix_sql(WORDS))
def matrix(spark, sf):
    return presence_matrix(table(spark, sf, "documents"), "doc_id", "text", WORDS, prefix="has_")


@query(
    "K1_presence_pairs",
    f"""SELECT doc_id, w AS keyword FROM documents, (SELECT unnest({WORDS!r}) AS w) WHERE contains(text, w)""",
)
def pairs(spark, sf):
    wide = presence_matrix(table(spark, sf, "documents"), "doc_id", "text", WORDS, prefix="has_")
    return matrix_to_pairs(wide, WORDS, ["doc_id"], prefix="has_")


@query(
    "K2_join_response",
    f"SELECT m.*, quality AS label FROM ({matrix_sql(WORDS)}) m LEFT JOIN labels USING (doc_id)",
)
def joined(spark, sf):
    wide = presence_matrix(table(spark, sf, "documents"), "doc_id", "text", WORDS, prefix="has_")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return join_response(wide, labels, "doc_id")


@query(
    "K3_keyword_appearance",
    f"""WITH d AS (SELECT text, lang, source, text || ' ' || lang || ' ' || source AS whole, quality = 0 AS bad
                   FROM documents JOIN labels USING (doc_id)),
       w AS (SELECT unnest({WORDS!r}) AS keyword, unnest(range({len(WORDS)})) AS position),
       x AS (SELECT keyword, position, contains(whole, keyword) AS has, bad, contains(text, keyword) AS t,
                    contains(lang, keyword) AS l, contains(source, keyword) AS s FROM d, w)
       SELECT CAST(position AS INTEGER) AS position, keyword,
              round(CASE WHEN count(*) FILTER (has) > 0 THEN count(*) FILTER (has AND bad) / count(*) FILTER (has) END, 6) AS present_bad_rate,
              round(CASE WHEN count(*) FILTER (NOT has) > 0 THEN count(*) FILTER (NOT has AND bad) / count(*) FILTER (NOT has) END, 6) AS absent_bad_rate,
              count(*) FILTER (has AND t) AS text, count(*) FILTER (has AND l) AS lang, count(*) FILTER (has AND s) AS source
       FROM x GROUP BY ALL""",
)
def appearance(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "text", "lang", "source", F.concat_ws(" ", "text", "lang", "source").alias("whole"),
        flag("quality", 0).alias("label"),
    )
    marks = [F.contains("whole", F.lit(w)).cast("int").alias(f"has_{w}") for w in WORDS]
    wide = docs.select("text", "lang", "source", "label", *marks)
    return rounded(keyword_appearance(wide, ["text", "lang", "source"], WORDS, prefix="has_"))


# a text holds a run of three letters if it is one of its runs of three characters
MANY_PAIRS_SQL = f"""w AS MATERIALIZED ({MANY_SQL}),
   g AS (SELECT DISTINCT doc_id, text[i:i + 2] AS keyword FROM documents, unnest(range(1, length(text) - 1)) AS u(i)),
   h AS MATERIALIZED (SELECT doc_id, keyword, position FROM g JOIN w USING (keyword))"""


@query("K1_presence_pairs_many", f"WITH {MANY_PAIRS_SQL} SELECT doc_id, keyword FROM h")
def pairs_many(spark, sf):
    return text_to_pairs(table(spark, sf, "documents"), "text", MANY_WORDS, ["doc_id"])


@query(
    "K3_keyword_appearance_many",
    f"""WITH {MANY_PAIRS_SQL}, d AS (SELECT doc_id, source, quality = 0 AS bad FROM documents JOIN labels USING (doc_id)),
       s AS (SELECT count(*) AS rows, count(*) FILTER (bad) AS pos FROM d),
       p AS (SELECT keyword, count(*) AS n, count(*) FILTER (bad) AS b, count(*) FILTER (contains(source, keyword)) AS source FROM h JOIN d USING (doc_id) GROUP BY keyword)
       SELECT position, keyword, round(CASE WHEN n > 0 THEN b / n END, 6) AS present_bad_rate,
         round(CASE WHEN rows > coalesce(n, 0) THEN (pos - coalesce(b, 0)) / (rows - coalesce(n, 0)) END, 6) AS absent_bad_rate,
         coalesce(n, 0) AS text, coalesce(source, 0) AS source FROM w LEFT JOIN p USING (keyword), s""",
)
def appearance_many(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("text", "source", flag("quality", 0).alias("label"))
    return rounded(keyword_appearance(docs, ["text", "source"], MANY_WORDS, text="text"))


@query(
    "K4_keyword_iv_many",
    f"""WITH {MANY_PAIRS_SQL}, d AS (SELECT doc_id, CAST(lang = 'fr' AS INTEGER) AS y FROM documents),
       s AS (SELECT count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM d),
       p AS (SELECT position, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM h JOIN d USING (doc_id) GROUP BY position),
       b AS (SELECT position, keyword, unnest([coalesce(p, 0), pos - coalesce(p, 0)]) AS p, unnest([coalesce(n, 0), neg - coalesce(n, 0)]) AS n, pos, neg
             FROM w LEFT JOIN p USING (position), s),
       r AS (SELECT *, (p + 1) / (pos + 2) AS x, (n + 1) / (neg + 2) AS y FROM b WHERE p + n > 0)
       SELECT position, keyword, round(sum((x - y) * ln(x / y)), 6) AS iv FROM r GROUP BY ALL""",
)
def iv_many(spark, sf):
    docs = table(spark, sf, "documents").select("text", flag("lang", "fr").alias("y"))
    return rounded(keyword_iv(docs, MANY_WORDS, "y", text="text"))


@query("K5_truncated_components")
def truncated_components(spark, sf):
    # read again in every pass
    rows = materialise(presence_lists(table(spark, sf, "documents"), "doc_id", "text", MANY_WORDS).select("present"), "presence")
    return rounded(component_variance(rows, "present", 10, width=len(MANY_WORDS), sparse=True))


IV_SQL = """WITH d AS ({rows}),
   w AS (SELECT unnest({words}) AS keyword, unnest(range({n})) AS position),
   g AS (SELECT keyword, position, contains(text, keyword) AS has, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n
         FROM d, w GROUP BY ALL),
   r AS (SELECT *, (p + 1) / (sum(p) OVER v + 2) AS a, (n + 1) / (sum(n) OVER v + 2) AS b FROM g WINDOW v AS (PARTITION BY keyword))
   SELECT CAST(position AS INTEGER) AS position, keyword, round(sum((a - b) * ln(a / b)), 6) AS iv FROM r GROUP BY ALL"""


@query(
    "K4_keyword_iv_from_text",
    IV_SQL.format(
        rows="SELECT text, CAST(lang = 'fr' AS INTEGER) AS y FROM documents", words=repr(STUDY_WORDS), n=len(STUDY_WORDS)
    ),
)
def iv_from_text(spark, sf):
    docs = table(spark, sf, "documents").select("text", flag("lang", "fr").alias("y"))
    return rounded(keyword_iv(docs, STUDY_WORDS, "y", text="text"))


@query(
    "K4_keyword_iv_from_matrix",
    IV_SQL.format(
        rows="SELECT text, CAST(quality = 0 AS INTEGER) AS y FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
        words=repr(WORDS), n=len(WORDS),
    ),
)
def iv_from_matrix(spark, sf):
    wide = presence_matrix(table(spark, sf, "documents"), "doc_id", "text", WORDS, prefix="has_")
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("y"))
    return rounded(keyword_iv(join_response(wide, labels, "doc_id"), WORDS, "y", prefix="has_"))


@query("K5_principal_variance")
def components(spark, sf):
    return rounded(principal_variance(table(spark, sf, "embeddings"), "embedding", 10))


@query(
    "K5_variance_identities",
    f"""WITH d AS (SELECT row_number() OVER () AS i, text FROM documents),
       x AS (SELECT i, w, CAST(contains(text, w) AS INTEGER) AS v FROM d, (SELECT unnest({STUDY_WORDS!r}) AS w)),
       c AS (SELECT a.w AS p, b.w AS q, covar_samp(a.v, b.v) AS c FROM x a JOIN x b USING (i) GROUP BY ALL)
       SELECT 1.0::DOUBLE AS total, round(sum(c * c) / pow(sum(c) FILTER (p = q), 2), 6) AS squares FROM c""",
)
def variance_identities(spark, sf):
    """Over all components the variance shares add up to one, and their squares to the squared norm of the covariance over its trace."""
    wide = presence_matrix(table(spark, sf, "documents"), "doc_id", "text", STUDY_WORDS, prefix="has_")
    shares = principal_variance(wide, [f"has_{w}" for w in STUDY_WORDS], len(STUDY_WORDS))
    v = F.col("variance_ratio")
    return rounded(shares.agg(F.sum(v).alias("total"), F.sum(v * v).alias("squares")))


@query("K5_keyword_components")
def keyword_components(spark, sf):
    wide = presence_matrix(table(spark, sf, "documents"), "doc_id", "text", STUDY_WORDS, prefix="has_")
    return rounded(principal_variance(wide, [f"has_{w}" for w in STUDY_WORDS], 10))
