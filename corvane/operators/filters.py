"""Row filters of the preparation, each a function of a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_of, token_count, truncate

#: What may happen to texts that are too long.
LONG_TEXT = ("drop", "truncate", "keep", "raise")


def by_modality(df: DataFrame, modality: str | None) -> DataFrame:
    return df.filter(F.col("modality") == modality) if modality else df


def min_chars(df: DataFrame, least: int = 0, text: str = "text") -> DataFrame:
    return df.filter(F.length(text_of(text)) >= least) if least else df


def max_tokens(df: DataFrame, most: int | None = None, tokenizer: str = "split", text: str = "text") -> DataFrame:
    """Add ``tokens`` and drop (not truncate) what has more than the most."""
    df = df.withColumn("tokens", token_count(text, tokenizer))
    return df.filter(F.col("tokens") <= most) if most else df


def with_label(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.coalesce(F.col(label), F.lit("")) != "")


def by_actor(df: DataFrame, include: list[str] | None = None, min_docs: int = 0, actor: str = "actor") -> DataFrame:
    """Actors of a list (a join, however long it is), and of those the ones with enough documents."""
    if include:
        wanted = df.sparkSession.createDataFrame([(a,) for a in sorted(set(include))], "_wanted string")
        df = df.join(wanted, F.col(actor) == F.col("_wanted"), "left_semi")
    if min_docs > 0:
        enough = df.groupBy(F.col(actor).alias("_actor")).count().filter(F.col("count") >= min_docs).select("_actor")
        df = df.join(enough, F.col(actor).eqNullSafe(F.col("_actor")), "left_semi")
    return df


def long_texts(df: DataFrame, most: int, policy: str = "drop", text: str = "text") -> DataFrame:
    """Texts of more than the most characters: dropped, truncated, kept, or an error when the row is read."""
    if policy not in LONG_TEXT:
        raise ValueError(f"a policy for long texts is one of {LONG_TEXT}, not {policy!r}")
    long = F.length(text_of(text)) > most
    if policy == "drop":
        return df.filter(~long)
    if policy == "truncate":
        return df.withColumn(text, truncate(text, most))
    if policy == "raise":
        return df.withColumn(text, F.when(long, F.raise_error(F.lit(f"a text has more than {most} characters"))).otherwise(F.col(text)))
    return df


def require_rows(df: DataFrame, what: str = "documents") -> DataFrame:
    """The same rows, or an error if there are none; an action."""
    if df.isEmpty():
        raise ValueError(f"no {what} left")
    return df
