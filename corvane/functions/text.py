"""Scalar text functions, as columns.

White space and word characters are spelled out as Unicode classes, so that
other engines' regular expressions agree. Only Unicode normalisation, for which
Spark has no function, runs in Arrow-batched Python.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..shipping import ship

#: What belongs inside brackets: Unicode white space, and word characters.
WHITE = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"


# Fixed values of the label and text conventions.
LABEL_PREFIXES = ("crawl_", "asr_party_")
LABEL_DATE = "_[0-9]{8}_[0-9]{6}$"
LABEL_SUFFIX = "_full"
LABEL_ALIAS = ("initiative_communiste", "init_com")
LABEL_WIDTH = 18
LINK_RESIDUE = "\t _blank"


def text_of(c: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end; Spark's trim only knows U+0020."""
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WHITE}]+", " "))


def lower_collapse(c: Column | str) -> Column:
    return collapse(F.lower(text_of(c)))


def text_key(c: Column | str) -> Column:
    """Lower case, punctuation as space, white space collapsed: what duplicates share. Both are runs of anything but word characters."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), f"[^{WORD}]+", " "))


def text_hash(c: Column | str) -> Column:
    return F.sha1(text_key(c))


def stats_key(c: Column | str) -> Column:
    """Case and punctuation kept; no-break spaces, a link residue and zero-width spaces cleaned."""
    cleaned = F.replace(F.replace(F.replace(text_of(c), F.lit(" "), F.lit(" ")), F.lit(LINK_RESIDUE), F.lit(" ")), F.lit("​"), F.lit(""))
    return F.md5(collapse(cleaned))


def label_key(c: Column | str) -> Column:
    """A label value in the form of mapping keys: lower case, one underscore for anything else."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(F.lower(strip(c)), rf"[{WHITE}/\\]+", "_")
    c = F.regexp_replace(c, "[^0-9a-zA-Z_]+", "_")
    return F.regexp_replace(F.regexp_replace(c, "_+", "_"), "^_|_$", "")


def token_count(c: Column | str, tokenizer: str = "split") -> Column:
    """Tokens between white space; ``simple`` splits at spaces and newlines only, ``word_punct`` counts words and marks."""
    c = text_of(c)
    if tokenizer == "simple":
        return F.regexp_count(c, F.lit("[^ \n]+"))
    if tokenizer == "word_punct":
        return F.regexp_count(c, F.lit(f"[{WORD}]+|[^{WORD}{WHITE}]"))
    if tokenizer.startswith("spacy:"):
        return _spacy_count(tokenizer.partition(":")[2])(c)
    return F.regexp_count(c, F.lit(f"[^{WHITE}]+"))


def word_punct_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(text_of(c), F.lit(f"[{WORD}]+|[^{WORD}{WHITE}]"), F.lit(0))


def _spacy_count(lang: str):
    """Counts by a blank spaCy tokenizer where spaCy is installed, else by words and marks."""
    try:
        import spacy
    except ImportError:
        return lambda c: token_count(c, "word_punct")

    ship()

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        try:
            nlp = spacy.blank(lang or "xx")
        except Exception:  # noqa: BLE001 - unknown languages use the multi-language tokenizer
            nlp = spacy.blank("xx")
        return texts.map(lambda t: len(nlp(t)))

    return count


def strip_urls_emails(c: Column | str) -> Column:
    """Web addresses and e-mail-like tokens as spaces, white space collapsed."""
    c = F.regexp_replace(text_of(c), rf"https?://[^{WHITE}]+", " ")
    c = F.regexp_replace(c, rf"www\.[^{WHITE}]+", " ")
    # Once for each run between white space: from its first word character to its last, if there is an @ between.
    return collapse(F.regexp_replace(c, rf"(?<![^{WHITE}])([^{WORD}{WHITE}]*+)[{WORD}][^{WHITE}@]*+@[^{WHITE}]*[{WORD}]", "$1 "))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def without_marks(texts: pd.Series) -> pd.Series:
    """Decomposed, non-spacing marks dropped, composed again."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")), na_action="ignore")


_BASIC = {"basic", "light", "std", "standard"}
_STRONG = {"aggressive", "full", "strong", "debias"}


def normalise(c: Column | str, mode: str | None = "none") -> Column:
    """none: as it is; basic: NFKC, lower case; aggressive: no diacritics either; debias: no addresses either; any other: NFKC, case kept."""
    c = text_of(c)
    mode = (mode or "none").strip().lower()
    if mode in {"none", "off", "false", "0"}:
        return c
    ship()
    c = collapse(nfkc(c))
    if mode in _BASIC:
        return F.lower(c)
    if mode in _STRONG:
        c = collapse(without_marks(F.lower(c)))
        return strip_urls_emails(c) if mode == "debias" else c
    return c


def redact_values(c: Column | str, *values: Column | str) -> Column:
    """Remove specific metadata values from the text, whatever their case.

    Specific are values with a dot or colon, those that begin with ``crawl``
    and those of at least eight characters; of one that begins with ``www.``
    the rest goes too. Longer ones go first.
    """
    tokens = F.array()
    for v in values:
        v = strip(text_of(v))
        low = F.lower(v)
        specific = (v != "") & (F.contains(low, F.lit(".")) | F.contains(low, F.lit(":")) | low.startswith("crawl") | (F.length(v) >= 8))
        own = F.when(specific & low.startswith("www."), F.array(v, F.substring(v, 5, 1 << 20))).when(specific, F.array(v)).otherwise(F.array().cast("array<string>"))
        tokens = F.concat(tokens.cast("array<string>"), own)
    longest = F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t != "")), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = F.transform(longest, lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return collapse(F.when(F.size(quoted) > 0, F.aggregate(quoted, text_of(c), lambda s, q: F.regexp_replace(s, F.concat(F.lit("(?iu)"), q), F.lit(" ")))).otherwise(text_of(c)))


def short_label(c: Column | str) -> Column:
    """A label for display: no prefixes, no date suffix, at most 18 characters."""
    c = F.col(c) if isinstance(c, str) else c
    for gone in LABEL_PREFIXES:
        c = F.replace(c, F.lit(gone), F.lit(""))
    c = F.replace(F.regexp_replace(c, LABEL_DATE, ""), F.lit(LABEL_SUFFIX), F.lit(""))
    return F.left(F.replace(c, *[F.lit(x) for x in LABEL_ALIAS]), F.lit(LABEL_WIDTH))


def truncate(c: Column | str, most: int) -> Column:
    return F.substring(text_of(c), 1, most)


def hash_order(seed: int, stage: str, *ids: Column | str) -> Column:
    """The order that stands for a seeded shuffle: md5 of seed, stage and id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stage), *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]))


def label_offset(c: Column | str) -> Column:
    """A number of a label that every run and engine computes alike: the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(F.col(c) if isinstance(c, str) else c), 1, 8), 16, 10).cast("long")
