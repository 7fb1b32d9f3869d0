"""TEI corpora: a splittable scan, one parse for each document, extraction as columns.

Documents are cut at their closing tag by the text source, so that a file of
any size is read by many tasks; namespace declarations of each file's root are
given back to its fragments. Mixed content needs a parser that keeps the order
of text and elements, hence one Arrow-batched Python step.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import checkpointed
from ..shipping import ship

XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
NAMESPACE = "http://www.tei-c.org/ns/1.0"
_SCHEMA = (
    "xml_id string, n string, terms map<string, array<string>>, class_codes array<struct<scheme: string, value: string>>, "
    "text string, text_no_segments string, text_all string, text_all_no_segments string, has_text boolean, has_segments boolean, broken boolean, in_namespace boolean"
)
_COLUMNS = ["xml_id", "n", "terms", "class_codes", "text", "text_no_segments", "text_all", "text_all_no_segments", "has_text", "has_segments", "broken", "in_namespace"]

#: A TEI element's beginning, with its prefix, in text without the tag's end.
_ELEMENT = r"<((?:[\w.-]+:)?)TEI(?=[\s>/]|$)"


#: A root element's beginning with its attributes, in text without the tag's end, and a declaration among them.
_ROOT, _DECLARED = r"<(?:[\w.-]+:)?teiCorpus(?=[\s>/]|$)([^>]*)", r"xmlns(?::[\w.-]+)?\s*=\s*(?:\"[^\"]*\"|'[^']*')"
#: Bytes of file names and declarations up to which they are sent to every task.
SENT = 64 << 20


def heads(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file with TEI elements: file, prefix of the first of them, and the root's namespace declarations.

    A scan of its own, of tags only: the root and the first element may stand
    anywhere in a file.
    """
    tags = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    tags = tags.filter(F.col("value").contains("TEI") | F.col("value").contains("teiCorpus"))
    first = F.min(F.when(F.col("value").rlike(_ELEMENT), F.struct("at", F.regexp_extract("value", _ELEMENT, 1).alias("v"))))
    declared = F.array_join(F.regexp_extract_all(F.regexp_extract("value", _ROOT, 1), F.lit(_DECLARED), F.lit(0)), " ")
    root = F.min(F.when(F.col("value").rlike(_ROOT), F.struct("at", declared.alias("v"))))
    files = tags.groupBy("file").agg(first["v"].alias("prefix"), F.coalesce(root["v"], F.lit("")).alias("declared"))
    return checkpointed(files.filter("prefix IS NOT NULL"))


def _elements(spark: SparkSession, paths: str | list[str], prefix: str) -> DataFrame:
    """Rows (file, frag) of all elements of a prefix, in file order; an element of another prefix is an error."""
    raw = spark.read.option("lineSep", f"</{prefix}TEI>").text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    start = F.regexp_instr("value", F.lit(f"<{prefix}TEI[\\s>]"))
    whole = F.concat(F.expr(f"substring(value, regexp_instr(value, '<{prefix}TEI[\\\\s>]'))"), F.lit(f"</{prefix}TEI>"))
    other = F.raise_error(F.concat(F.lit(f"TEI elements of another prefix than '{prefix}' in "), F.col("file")))
    return raw.filter((start > 0) | F.col("value").rlike(_ELEMENT)).select("file", F.when(start > 0, whole).otherwise(other).alias("frag"))


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """Rows (pos, idx, frag, declared), one for each TEI element in file order, with the declarations of its file's root.

    idx numbers all elements without gaps, those that can't be parsed as well.
    Files may have roots of their own and prefixes of their own; those of one
    prefix are read together. Elements of several prefixes in one file are an
    error.
    """
    files = heads(spark, path)
    prefixes = sorted(r[0] for r in files.select("prefix").distinct().collect()) or [""]
    parts = []
    for prefix in prefixes:
        # Names of files, of which the driver has a list as well when it plans the scan.
        paths = [unquote(r[0]) for r in files.filter(F.col("prefix") == prefix).select("file").collect()] if len(prefixes) > 1 else path
        parts.append(_elements(spark, paths, prefix))
    rows = reduce(DataFrame.unionByName, parts)
    rows = with_index(rows.select(F.monotonically_increasing_id().alias("pos"), "file", "frag"))
    some = [r[0] for r in files.select("declared").distinct().limit(2).collect()]
    if len(some) < 2:
        return rows.withColumn("declared", F.lit("".join(some))).drop("file")
    size = files.agg(F.sum(F.length("file") + F.length("declared"))).first()[0]
    of = files.select(F.col("file").alias("_file"), "declared")
    return rows.join(F.broadcast(of) if size <= SENT else of, F.col("file") == F.col("_file")).drop("file", "_file")


def _local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _chunks(node: ET.Element, skip: Callable[[ET.Element], bool]) -> Iterator[str]:
    """Text in document order, without skipped elements but with what follows them."""
    stack: list[tuple[ET.Element, str | None]] = [(node, None)]
    while stack:
        element, text = stack.pop()
        if text is not None:
            yield text
            continue
        if skip(element):
            continue
        below: list[tuple[ET.Element, str | None]] = [(element, element.text)] if element.text else []
        for child in element:
            below.append((child, None))
            if child.tail:
                below.append((child, child.tail))
        stack.extend(reversed(below))


def _never(_: ET.Element) -> bool:
    return False


def _segments(e: ET.Element) -> bool:
    return _local(e.tag) == "ab" and (e.get("type") or "").strip().lower() == "segments"


def _segments_exactly(e: ET.Element) -> bool:
    return _local(e.tag) == "ab" and e.get("type") == "segments"


def _joined(node: ET.Element, skip: Callable[[ET.Element], bool]) -> str:
    return re.sub(r"\s+", " ", " ".join(c.strip() for c in _chunks(node, skip) if c.strip())).strip()


def parse(fragment: str, declared: str = "") -> dict:
    """What is extracted from one TEI element; ``broken`` if it can't be parsed."""
    row = dict.fromkeys(("xml_id", "n", "text", "text_no_segments", "text_all", "text_all_no_segments"), "")
    row |= {"terms": {}, "class_codes": [], "has_text": False, "has_segments": False, "broken": False, "in_namespace": False}
    try:
        tei = ET.fromstring(f"<wrap {declared}>{fragment}</wrap>")[0]
    except (ET.ParseError, IndexError):
        return row | {"broken": True}
    row |= {"xml_id": tei.get(XML_ID) or "", "n": tei.get("n") or "", "in_namespace": tei.tag == f"{{{NAMESPACE}}}TEI"}
    body = None
    for e in tei.iter():
        name, value = _local(e.tag), (e.text or "").strip()
        if name == "term" and value and e.get("type"):
            row["terms"].setdefault(e.get("type"), []).append(value)
        elif name == "classCode" and (value or (e.get("scheme") or "").strip()):
            row["class_codes"].append(((e.get("scheme") or "").strip(), value))
        elif name == "text" and body is None:
            body = e
        row["has_segments"] |= _segments_exactly(e)
    row["has_text"] = body is not None
    whole = tei if body is None else body
    row |= {"text": _joined(whole, _never), "text_no_segments": _joined(whole, _segments)}
    if body is not None:
        row |= {"text_all": " ".join(_chunks(body, _never)).strip(), "text_all_no_segments": " ".join(_chunks(body, _segments_exactly)).strip()}
    return row


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Extracted documents: pos, idx and the columns of ``parse``."""
    return extract(fragments(spark, path))


def extract(rows: DataFrame) -> DataFrame:
    """The same for rows (pos, frag), with idx and declared or without."""
    ship(rows.sparkSession)
    numbers = [c for c in ("pos", "idx") if c in rows.columns]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([parse(*x) for x in zip(frame["frag"], frame["declared"])], columns=_COLUMNS)
            for i, c in enumerate(numbers):
                out.insert(i, c, frame[c].to_numpy())
            yield out

    if "declared" not in rows.columns:
        rows = rows.withColumn("declared", F.lit(""))
    return rows.mapInPandas(run, f"{', '.join(f'{c} long' for c in numbers)}, {_SCHEMA}")


def term(kind: str, party_fallback: bool = True) -> Column:
    """The first value of a term; for crawl and domain the party's class code may stand in."""
    own = F.get(F.coalesce(F.try_element_at("terms", F.lit(kind)), F.array().cast("array<string>")), F.lit(0))
    if kind not in ("crawl", "domain") or not party_fallback:
        return own
    party = F.get(F.filter(F.transform(F.filter("class_codes", lambda c: c["scheme"] == "asr_party"), lambda c: c["value"]), lambda v: v != ""), F.lit(0))
    return F.coalesce(own, F.concat(F.lit("asr_party:"), party))


def first_term(kinds: list[str], party_fallback: bool = True) -> Column:
    return F.coalesce(*[term(k, party_fallback) for k in kinds]) if kinds else F.lit(None).cast("string")


def modality(default: str | None = None) -> Column:
    return F.coalesce(term("modality"), F.lit(default), F.lit("unknown"))


def with_index(docs: DataFrame, pos: str = "pos") -> DataFrame:
    """Add ``idx``, the gapless number of a row in the order of monotonically increasing positions, none of which may be missing."""
    part = F.shiftright(F.col(pos), 33)
    counts = docs.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    # A row for each partition of the scan.
    return docs.join(F.broadcast(offsets), part == F.col("_part")).withColumn("idx", F.col("_before") + F.col(pos).bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before")


def prepared(docs: DataFrame, label_fields: list[str], default_modality: str | None = None, drop_segments: bool = False, segment_modalities: list[str] | None = None, party_fallback: bool = True) -> DataFrame:
    """Scanned documents as id, label_raw, modality, crawl, domain, actor, text (and pos, broken)."""
    docs = docs if "idx" in docs.columns else with_index(docs)
    ident = F.coalesce(F.when(F.col("xml_id") != "", F.col("xml_id")), F.when(F.col("n") != "", F.col("n")), F.concat(F.lit("doc_"), F.col("idx").cast("string")))
    mode = modality(default_modality)
    without = F.lit(drop_segments) & (mode.isin(*segment_modalities) if segment_modalities else F.lit(True))
    return docs.select(
        "pos", ident.alias("id"), ident.alias("xml_id"), first_term(label_fields, party_fallback).alias("label_raw"), mode.alias("modality"),
        term("crawl", party_fallback).alias("crawl"), term("domain", party_fallback).alias("domain"), term("actor").alias("actor"),
        F.when(without, F.col("text_no_segments")).otherwise(F.col("text")).alias("text"), "broken",
    )


def audited(docs: DataFrame) -> DataFrame:
    """Scanned documents in the columns that the audits read."""
    values = lambda kind: F.coalesce(F.try_element_at("terms", F.lit(kind)), F.array().cast("array<string>"))
    return docs.select("pos", "xml_id", values("domain").alias("domains"), values("crawl").alias("crawls"), values("modality").alias("modalities"), "class_codes", F.col("text_all"), F.col("text_all_no_segments").alias("text_no_segments"), "has_text", "has_segments")
