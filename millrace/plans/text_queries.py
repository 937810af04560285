"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..runtime import table

STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP) + "]"


def fields_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '{T.WS}+'), lambda x: x <> '')"


def tokens_sql(text: str) -> str:
    bare = rf"list_transform({fields_sql(text)}, lambda w: regexp_replace(w, '^[\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]+$', '', 'g'))"
    return rf"list_transform(list_filter({bare}, lambda w: regexp_matches(w, '\p{{L}}')), lambda w: lower(w))"


def norm_sql(text: str) -> str:
    space = rf"regexp_replace(regexp_replace({text}, '\p{{Zs}}', ' ', 'g'), '[\t\n\f\r ]+', ' ', 'g')"
    trim = rf"regexp_replace({space}, '^{T.WS}+|{T.WS}+$', '', 'g')"
    return rf"regexp_replace({trim}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{{Cf}}]', '', 'g')"


@query("text_normalize", f"select doc_id, {norm_sql('text')} as text, coalesce(len({fields_sql('text')}), 0) as words from documents")
def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", T.normalize_text(F.col("text")).alias("text"), T.word_count(F.col("text")).cast("long").alias("words"))


@query(
    "stopword_density",
    f"""with t as (select doc_id, text, {tokens_sql('text')} as w from documents where text is not null),
        d as (select *, len(list_filter(w, lambda x: list_contains({STOP_SQL}, x))) / nullif(len(w), 0) as share from t)
        select doc_id, len(w) as tokens, round(share, 6) as share,
               round(case when share is null or share < 0.10 then -2.0 else len(w) / (strlen(text) / 80.0 + 1) end, 6) as density from d""",
)
def stopword_density(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("text is not null").withColumn("w", T.letter_tokens(F.col("text")))
    w = F.col("w")
    return docs.withColumn("share", T.stop_density(w)).select(
        "doc_id",
        F.size(w).cast("long").alias("tokens"),
        F.round("share", 6).alias("share"),
        F.round(T.text_density(F.col("text"), F.lit(0.0), w, F.col("share")), 6).alias("density"),
    )
