"""Language identification by interpolated Kneser-Ney character models.

One model per language, order 5, over letters in lower case with every run of
other characters as one space. The last five symbols are packed into one
60-bit code, twelve folded bits each; a model's n-grams and contexts are sorted
arrays of those codes beside their discounted probabilities and back-off
weights. A text gets the language of the lowest cross-entropy a symbol. It is
rejected when its passages, each by the language that suits it best, so that
texts in several known languages pass, lie higher than calibration texts of
those languages ever come near. Models are fitted on a bounded sample; every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, claim, digest_long, narrow, runs

ORDER, BITS = 5, 12
#: Documents a language is fitted on, and those its rejection is calibrated on; expected numbers, as they are chosen by hash.
FIT_ROWS, CALIBRATION_ROWS = 400, 200
#: Texts that a label needs at least to be calibrated; one that can expect fewer is fitted on all its rows.
LEAST_CALIBRATION = 20
#: Share of calibration texts that the calibrated limit alone would reject, and the margin put on top of it.
REJECT_SHARE, REJECT_MARGIN = 0.001, 2.0
#: Symbols of a passage.
PASSAGE = 40
#: Symbols that count towards the score at most: beyond, every score would be 1.
EVIDENCE = 200
#: Texts, and characters of them, scored at once.
TEXTS, CHARS = 400, 500_000
UNKNOWN = "und"

_LETTERS: np.ndarray | None = None


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (BITS * n)) - 1)


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def _forget() -> None:
    global _LETTERS
    _LETTERS = None


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code of every symbol with the four before it, and each text's number of symbols; 0 if it has no letter."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    of = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _letters()[points]
    before = np.zeros(len(points), bool)
    before[1:] = letter[:-1] & (of[1:] == of[:-1])
    kept = letter | before
    symbols = np.where(letter, points % ((1 << BITS) - 1) + 1, 0).astype(np.uint64)[kept]
    of = of[kept]
    n = np.bincount(of, minlength=len(texts))
    place = np.arange(len(of)) - (np.cumsum(n) - n)[of]
    out = symbols.copy()
    for back in range(1, ORDER):
        earlier = np.zeros_like(symbols)
        earlier[back:] = symbols[:-back]
        earlier[place < back] = 0
        out |= earlier << np.uint64(BITS * back)
    return out, n


@dataclass
class LanguageModels:
    """For each order: sorted codes with a row of discounted probabilities, sorted contexts with a row of back-off weights; a column per language."""

    labels: list[str]
    grams: list[np.ndarray]
    probabilities: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: np.ndarray | None = None

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        p = np.full((len(code), len(self.labels)), 2.0**-BITS)
        for n in range(1, ORDER + 1):
            gram = code & _mask(n)
            p *= _rows(self.contexts[n - 1], self.backoffs[n - 1], gram >> np.uint64(BITS), 1.0)
            p += _rows(self.grams[n - 1], self.probabilities[n - 1], gram, 0.0)
        return np.log(p)

    def passages(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Summed cross-entropy of each passage by each language, passages' numbers of symbols, their texts, and the texts' numbers of symbols. A text's last passage takes the rest; a text without symbols has an empty one."""
        code, n = codes(texts)
        parts = np.maximum(n // PASSAGE, 1)
        of = np.repeat(np.arange(len(texts)), parts)
        if not self.labels or not len(code):
            return np.zeros((len(of), len(self.labels))), np.zeros(len(of), np.int64), of, n
        which, distinct = pd.factorize(code)
        log_p = self.log_probabilities(np.asarray(distinct, np.uint64))
        text = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(text)) - (np.cumsum(n) - n)[text]
        at = (np.cumsum(parts) - parts)[text] + np.minimum(place // PASSAGE, parts[text] - 1)
        sums = np.stack([np.bincount(at, log_p[which, k], len(of)) for k in range(len(self.labels))], 1)
        return -sums, np.bincount(at, minlength=len(of)), of, n

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a symbol of each text by each language, and the texts' numbers of symbols."""
        sums, _, of, n = self.passages(texts)
        return _whole(sums, of, n), n

    def predict(self, texts: list[str]) -> pd.DataFrame:
        sums, size, of, n = self.passages(texts)
        entropy = _whole(sums, of, n)
        known = (n > 0) & (len(self.labels) > 0)
        if not self.labels:
            return pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0, "entropy": 0.0, "rejected": True})
        best = entropy.argmin(1)
        lowest = entropy[np.arange(len(texts)), best]
        score = 1 / np.exp(-(entropy - lowest[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(1)
        high = self.passage_distance(sums, size, of, n) > self.limit[best] if self.limit is not None else np.zeros(len(texts), bool)
        names = np.array([*self.labels, UNKNOWN], object)
        return pd.DataFrame({"lang": names[np.where(known, best, -1)], "score": np.where(known, score, 0.0), "entropy": np.where(known, lowest, 0.0), "rejected": ~known | high})

    def distance(self, entropy: np.ndarray, n: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Standard deviations above a language's own texts; shorter texts vary more."""
        return (entropy - self.mean[label]) / np.sqrt(self.spread[label] ** 2 + 4.0 / np.maximum(n, 1))

    def passage_distance(self, sums: np.ndarray, size: np.ndarray, of: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The same for texts whose passages may differ in language; those of languages that can't tell add nothing."""
        own = sums.argmin(1)
        above = np.where(np.isfinite(self.limit[own]), sums[np.arange(len(own)), own] - size * self.mean[own], 0.0)
        above, spread = (np.bincount(of, x, len(n)) / np.maximum(n, 1) for x in (above, size * self.spread[own]))
        return above / np.sqrt(spread**2 + 4.0 / np.maximum(n, 1))

    def calibrate(self, label: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> None:
        k = len(self.labels)
        self.mean, self.spread, self.limit = np.full(k, np.inf), np.full(k, 1.0), np.full(k, np.inf)
        for i in range(k):
            own = entropy[label == i]
            if len(own) >= LEAST_CALIBRATION:
                self.mean[i], self.spread[i] = own.mean(), own.std() + 0.01
                z = self.distance(own, n[label == i], np.full(len(own), i))
                # Few or uniform texts show less than their tail: it is taken to reach as far as a normal one at least.
                self.limit[i] = REJECT_MARGIN * max(np.quantile(z, 1 - REJECT_SHARE), NormalDist().inv_cdf(1 - REJECT_SHARE))
            else:
                self.mean[i] = 0.0  # too few texts to tell: nothing is rejected


def _whole(sums: np.ndarray, of: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Cross-entropy a symbol of texts from the sums of their passages."""
    whole = [np.bincount(of, column, len(n)) for column in sums.T]
    return np.stack(whole, 1) / np.maximum(n, 1)[:, None] if whole else np.zeros((len(n), 0))


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), otherwise)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], otherwise)


def fit_kneser_ney(labels: list[str], counted: list[tuple[np.ndarray, np.ndarray]]) -> LanguageModels:
    """counted: for each label the distinct codes of order 5 and how often each occurs."""
    parts: list[list[tuple]] = [[] for _ in range(ORDER)]
    for code, count in counted:
        for n in range(ORDER, 0, -1):
            if n < ORDER:  # a lower order counts the distinct symbols before its grams
                code, count = np.unique(code & _mask(n), return_counts=True)
            count = count.astype(float)
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context, first, kinds = np.unique(code >> np.uint64(BITS), return_inverse=True, return_counts=True)
            total = np.bincount(first, count)
            parts[n - 1].append((code, (count - discount).clip(0) / total[first], context, discount * kinds / total))
    models = LanguageModels(labels, [], [], [], [])
    for order in parts:
        for keys, values, at, otherwise in ((models.grams, models.probabilities, 0, 0.0), (models.contexts, models.backoffs, 2, 1.0)):
            every = np.unique(np.concatenate([p[at] for p in order] or [np.zeros(0, np.uint64)]))
            table = np.full((len(every), len(labels)), otherwise, np.float32)
            for k, p in enumerate(order):
                table[np.searchsorted(every, p[at]), k] = p[at + 1]
            keys.append(every)
            values.append(table)
    return models


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, code, n), combined by batch."""
    claim("language_id", _forget)
    for batch in batches:
        for label, own in batch.to_pandas().groupby("label")["text"]:
            for part in runs(own.str.len().tolist(), CHARS, TEXTS):
                distinct, n = np.unique(codes(own.iloc[part].tolist())[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(distinct), pa.string()), pa.array(distinct.astype(np.int64)), pa.array(n.astype(np.int64))], names=["label", "code", "n"])


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> LanguageModels:
    """Models of all labels, from about fit_rows texts of each, calibrated on about calibration_rows others.

    Rows without label or text are not learned from. Rows are drawn by a hash of
    id and text. A label of few rows is fitted on all of them and not
    calibrated, so that every label with a letter is learned. What reaches the
    driver, for each label, is the counts of the n-grams of its sample and a
    number for each different text it is calibrated on.
    """
    bounded_batches(rows.sparkSession)
    rows = narrow(rows, id=id_col, text=text_col, label=label_col).select("id", F.col("text").cast("string").alias("text"), F.col("label").cast("string").alias("label"))
    rows = rows.filter("label IS NOT NULL AND text IS NOT NULL")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    labels = sorted(counts)
    grain, limits = 1_000_000, []
    for c in labels:
        n, few = counts[c], counts[c] * calibration_rows < LEAST_CALIBRATION * (fit_rows + calibration_rows)
        upto = min(grain, -(-grain * (fit_rows + calibration_rows) // n))
        limits.append((c, grain if few else min(grain * fit_rows // (fit_rows + calibration_rows), -(-grain * fit_rows // n)), upto))
    limits = rows.sparkSession.createDataFrame(limits, "_label string, fit_upto long, upto long")
    drawn = rows.withColumn("draw", F.pmod(digest_long("id", "text", seed=11), F.lit(grain))).join(F.broadcast(limits), F.col("label") == F.col("_label"))  # a row for each label

    def grams(some: DataFrame) -> dict[str, pd.DataFrame]:
        found = some.select("label", "text").mapInArrow(_count, "label string, code long, n long")
        return dict(list(found.groupBy("label", "code").agg(F.sum("n").alias("n")).toPandas().groupby("label")))

    groups = grams(drawn.filter("draw < fit_upto"))
    missed = [c for c in labels if c not in groups]
    if missed:  # rows that are all alike may all have been drawn for calibration
        groups |= grams(rows.filter(F.col("label").isin(missed)))
    empty = pd.DataFrame({"code": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    per_label = []
    for c in labels:
        own = groups.get(c, empty).sort_values("code")
        per_label.append((own["code"].to_numpy().astype(np.uint64), own["n"].to_numpy()))
    labels, per_label = [c for c, p in zip(labels, per_label) if len(p[0])], [p for p in per_label if len(p[0])]
    models = fit_kneser_ney(labels, per_label)
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def entropies(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {c: i for i, c in enumerate(shared.value.labels)}
        for frame in batches:
            frame = frame[frame["label"].isin(place.keys())]
            for part in runs(frame["text"].str.len().tolist(), CHARS, TEXTS):
                some = frame.iloc[part]
                label = some["label"].map(place).to_numpy()
                # Only the passages in the text's own language: labelled texts hold others too.
                sums, size, of, n = shared.value.passages(some["text"].tolist())
                own = sums.argmin(1) == label[of]
                n = np.bincount(of, size * own, len(n)).astype(np.int64)
                entropy = np.bincount(of, sums[np.arange(len(of)), label[of]] * own, len(n)) / np.maximum(n, 1)
                yield pd.DataFrame({"label": label, "entropy": entropy, "n": n})

    held = drawn.filter("draw >= fit_upto AND draw < upto").select("label", "text")
    seen = held.mapInPandas(entropies, "label long, entropy double, n long").filter("n > 0").distinct().toPandas()
    models.calibrate(seen["label"].to_numpy(), seen["entropy"].to_numpy(), seen["n"].to_numpy())
    return models


def detector(df: DataFrame, models: LanguageModels):
    """A function of a text column: struct lang, score, entropy, rejected. Null and letterless texts are ``und``, score 0, rejected."""
    shared = df.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("lang string, score double, entropy double, rejected boolean")
    def detect(texts: pd.Series) -> pd.DataFrame:
        claim("language_id", _forget)
        texts = texts.fillna("").tolist()
        parts = [shared.value.predict(texts[part]) for part in runs([len(t) for t in texts], CHARS, TEXTS)]
        return pd.concat(parts, ignore_index=True) if parts else shared.value.predict([])

    return detect


def learnable(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text isn't divisible by 5. Null ids are not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **bounds: int) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected, entropy.

    Learns from the rows whose id allows it and predicts every whole text from
    the text alone. Null, empty and letterless texts are ``und``; without any
    labelled row all texts are. Ties go to the label first by code point. The
    score is the label's share of the likelihood that the text's mean over at
    most EVIDENCE symbols gives all labels. Rows that repeat an id or a text are
    predicted each for itself, and texts of any length whole. An empty table
    gives no rows; other columns are ignored.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col, lang=label_col)
    models = fit(rows.filter(learnable()), "doc_id", "text", "lang", **bounds)
    detect = detector(rows, models)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~learnable() & F.col("doc_id").isNotNull(), F.lit(False)).alias("held_out"), detect(F.col("text").cast("string")).alias("d"))
    return rows.select("doc_id", "held_out", F.col("d.lang").alias("lang_pred"), F.col("d.score").alias("score"), F.col("d.rejected").alias("rejected"), F.col("d.entropy").alias("entropy"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **bounds: int) -> DataFrame:
    """The documents whose language is not rejected, with all their columns, whatever their names.

    Null, empty and letterless texts are rejected; repeated rows stay or go
    alike. Texts of any length are judged whole, and two languages that suit a
    passage equally well give it the same cross-entropy, so that ties decide
    nothing. Texts in languages that are too rare to be calibrated stay, and an
    empty table stays empty.
    """
    names = docs.columns
    models = fit(narrow(docs, doc_id=id_col, text=text_col, lang=label_col).filter(learnable()), "doc_id", "text", "lang", **bounds)
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    detect = detector(docs, models)
    flat = flat.withColumn("_d", detect(F.col(f"_{names.index(text_col)}").cast("string"))).filter("not _d.rejected")
    return flat.drop("_d").toDF(*names)
