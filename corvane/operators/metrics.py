"""Classification metrics from rows (label, prediction), whole and by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_label

MISSING = "__missing__"


def _div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_counts(df: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """tp, support and predicted of every class that is a label or a prediction of the keys."""
    pairs = df.groupBy(*keys, F.col(label).alias("_y"), F.col(prediction).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sides = F.array(F.struct(F.col("_y").alias("class"), F.col("_n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0).alias("tp")), F.struct(F.col("_p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("_n").alias("predicted"), F.lit(0).cast("long").alias("tp")))
    each = pairs.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    return each.groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])


def per_class(df: DataFrame, keys: list[str] | None = None, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """precision, recall, f1 and support of every class; a quotient by zero is zero."""
    counts = class_counts(df, keys or [], label, prediction)
    precision, recall = _div(F.col("tp"), F.col("predicted")), _div(F.col("tp"), F.col("support"))
    out = counts.withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1", _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("predicted", "tp")


def summary(df: DataFrame, keys: list[str] | None = None, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """n, accuracy, macro_f1 of each group of the keys; the classes are the group's own."""
    keys = keys or []
    counts = class_counts(df, keys, label, prediction)
    precision, recall = _div(F.col("tp"), F.col("predicted")), _div(F.col("tp"), F.col("support"))
    f1 = _div(2 * precision * recall, precision + recall)
    return counts.groupBy(*keys).agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The classification report in long form: (class, precision, recall, f1, support), with accuracy and two averages."""
    rows = per_class(df, None, label, prediction).select("class", "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    w = F.sum("support")
    total = rows.agg(w.alias("n"), *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[(F.sum(F.col(c) * F.col("support")) / w).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])
    averages = total.select(F.explode(F.array(*[F.struct(F.lit(f"{kind} avg").alias("class"), *[F.col(f"{kind}_{c}").alias(c) for c in ("precision", "recall", "f1")], F.col("n").alias("support")) for kind in ("macro", "weighted")])).alias("s")).select("s.*")
    hit = df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    accuracy = hit.select(F.lit("accuracy").alias("class"), F.col("a").alias("precision"), F.col("a").alias("recall"), F.col("a").alias("f1"), F.col("n").alias("support"))
    return rows.unionByName(averages).unionByName(accuracy)


def grouped(df: DataFrame, fields: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """summary by each value of each field, in long form (field, value, n, accuracy, macro_f1); fields that rows lack are one group."""
    values = F.array(*[F.struct(F.lit(f).alias("field"), (F.coalesce(F.col(f).cast("string"), F.lit(MISSING)) if f in df.columns else F.lit(MISSING)).alias("value")) for f in fields])
    pairs = df.groupBy(label, prediction, *[f for f in fields if f in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    each = pairs.select(label, prediction, "_n", F.explode(values).alias("v")).select(F.col("v.field").alias("field"), F.col("v.value").alias("value"), F.col(label).alias("_y"), F.col(prediction).alias("_p"), "_n")
    sides = F.array(F.struct(F.col("_y").alias("class"), F.col("_n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0).alias("t")), F.struct(F.col("_p").alias("class"), F.lit(0).cast("long").alias("s"), F.col("_n").alias("p"), F.lit(0).cast("long").alias("t")))
    counts = each.select("field", "value", F.explode(sides).alias("x")).select("field", "value", "x.*").groupBy("field", "value", "class").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    precision, recall = _div(F.col("t"), F.col("p")), _div(F.col("t"), F.col("s"))
    return counts.groupBy("field", "value").agg(F.sum("s").alias("n"), (F.sum("t") / F.sum("s")).alias("accuracy"), F.avg(_div(2 * precision * recall, precision + recall)).alias("macro_f1"))


def normalised_weights(groups: DataFrame, weights: DataFrame | None, value: str = "value") -> DataFrame:
    """Add ``weight`` to groups: given (value, weight), missing ones 0, scaled to 1; equal ones if none are given or they sum to nothing."""
    every = Window.partitionBy()
    if weights is None:
        return groups.withColumn("weight", 1.0 / F.count(F.lit(1)).over(every))
    given = weights.select(F.col(value).alias("_value"), F.col("weight").cast("double").alias("_w"))
    rows = groups.join(given, F.col(value) == F.col("_value"), "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    total = F.sum("_w").over(every)
    return rows.withColumn("weight", F.when(total > 0, F.col("_w") / total).otherwise(1.0 / F.count(F.lit(1)).over(every))).drop("_value", "_w")


def balanced_summary(groups: DataFrame, field: str, weights: DataFrame | None = None) -> DataFrame:
    """Weighted accuracy and macro F1 over the groups of one field."""
    rows = normalised_weights(groups.filter(F.col("field") == field), weights)
    return rows.agg(F.sum(F.col("weight") * F.col("accuracy")).alias("balanced_accuracy"), F.sum(F.col("weight") * F.col("macro_f1")).alias("balanced_macro_f1"), F.count(F.lit(1)).alias("groups"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(true, pred, n, row_share), a share of the true class's rows."""
    cells = df.groupBy(F.col(label).alias("true"), F.col(prediction).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("row_share", F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("true")), F.lit(1)))


def top_confusions(df: DataFrame, k: int = 40, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The k largest cells off the diagonal: (count, row_share, true, pred)."""
    cells = confusion(df, label, prediction).filter(F.col("true") != F.col("pred"))
    return cells.orderBy(F.desc("n"), "true", "pred").limit(k).select(F.col("n").alias("count"), "row_share", "true", "pred")


def confusion_bars(df: DataFrame, k: int = 15, **columns: str) -> DataFrame:
    """The first confusions as labelled bars."""
    top = top_confusions(df, k, **columns)
    return top.select(F.concat(short_label("true"), F.lit(" -> "), short_label("pred")).alias("pair"), "count")


def check_stats(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts by label with the numbers of documents and labels beside: the model that only checks."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    return counts.select(label, "n", F.sum("n").over(every).alias("n_docs"), F.count(F.lit(1)).over(every).alias("n_labels"))
