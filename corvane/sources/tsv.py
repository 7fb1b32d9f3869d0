"""Tab-separated splits: all-string columns, minimal quoting with doubled quotes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

_DIALECT = {"sep": "\t", "quote": '"', "escape": '"', "multiLine": "true", "header": "true"}
COLUMNS = ("id", "xml_id", "label", "label_raw", "modality", "corpus_id", "text")
TEXT_NAMES, ID_NAMES = ("text", "doc", "content"), ("id", "xml_id", "doc_id")
EVAL_ORDER = ("test", "job", "dev", "train")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the header as strings; empty fields are empty strings, not null."""
    df = spark.read.options(**_DIALECT, inferSchema="false", enforceSchema="false").csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_split(spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """A prepared split by its fixed schema, without looking at the file first."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).options(**_DIALECT).csv(path)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def labelled(df: DataFrame) -> DataFrame:
    """Rows that have a text and a label."""
    return df.filter((F.col("text") != "") & (F.col("label") != ""))


def stripped(df: DataFrame) -> DataFrame:
    """Text and label without white space around; rows without a text go."""
    return df.withColumns({c: strip(F.col(c)) for c in ("text", "label")}).filter("text <> ''")


def _present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return read_tsv(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _first(spark: SparkSession, folder: str, names: tuple[str, ...]) -> tuple[str, DataFrame] | None:
    for name in names:
        df = _present(spark, f"{folder}/{name}.tsv")
        if df is not None:
            return name, df
    return None


def read_training(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """train, and job or else train; a missing train file is an error."""
    train = labelled(read_tsv(spark, f"{folder}/train.tsv"))
    job = _first(spark, folder, ("job",))
    return {"train": train, "job": labelled(job[1]) if job else train}


def read_evaluation(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """The first of test, job, dev, train that is there, with its name; no labelled row is an error."""
    found = _first(spark, folder, EVAL_ORDER)
    if found is None:
        raise FileNotFoundError(f"no split in {folder}")
    rows = labelled(found[1])
    if rows.isEmpty():
        raise ValueError(f"no labelled document in {found[0]} of {folder}")
    return found[0], rows


def sniff(columns: list[str]) -> tuple[str, str | None]:
    """Names of the text and id columns of a foreign table: known ones, else the last, else none."""
    text = next((c for c in TEXT_NAMES if c in columns), columns[-1])
    return text, next((c for c in ID_NAMES if c in columns), None)


def read_audited(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, dict[str, dict]]:
    """Splits by name as rows (split, id, text), and the columns that were taken in each; missing files are left out, and if all are, that is an error.

    The first file's columns are taken in every file that has them; another
    file is looked at anew. A row without an id gets none that another has.
    """
    out = None
    taken: dict[str, dict] = {}
    names: tuple[str, str | None] | None = None
    for split, path in paths.items():
        df = _present(spark, path)
        if df is None:
            continue
        if names is None or not {c for c in names if c} <= set(df.columns):
            text, ident = sniff(df.columns)
        else:
            text, ident = names
        names = names or (text, ident)
        taken[split] = {"id": ident, "text": text}
        own = strip(F.col(f"`{ident}`")) if ident else F.lit("")
        own = F.when(own == "", F.concat(F.lit(f"__no_id__:{split}:"), F.monotonically_increasing_id().cast("string"))).otherwise(own)
        part = df.select(F.lit(split).alias("split"), own.alias("id"), strip(F.col(f"`{text}`")).alias("text"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"none of {list(paths.values())}")
    return out, taken


def read_positional(spark: SparkSession, path: str) -> DataFrame:
    """The first column as text and the second as label."""
    df = read_tsv(spark, path)
    return df.select(F.col(df.columns[0]).alias("text"), F.col(df.columns[1]).alias("label"))


def write_split(df: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS) -> None:
    """A folder of tab-separated parts; nulls as empty fields."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").options(sep="\t", quote='"', escape='"', header="true", emptyValue="", lineSep="\n").csv(path)


def write_splits(df: DataFrame, folder: str, columns: tuple[str, ...] = COLUMNS, split: str = "split") -> None:
    """train, dev, test and job (the test rows again)."""
    for name, source in (("train", "train"), ("dev", "dev"), ("test", "test"), ("job", "test")):
        write_split(df.filter(F.col(split) == source), f"{folder}/{name}.tsv", columns)
