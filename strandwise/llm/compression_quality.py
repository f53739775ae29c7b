"""Operator 11: a quality classifier from compressed sizes under two zstandard dictionaries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, in_arrow

#: The bounds of the sample that a fit reads: labelled documents of each label, and bytes of them.
FIT_ROWS, FIT_BYTES = 3000, 8 << 20
#: Bytes of a dictionary, of text that is compressed at a time (so that long texts meet the dictionary all the way), and of a training sample.
DICTIONARY_BYTES, CHUNK_BYTES, SAMPLE_BYTES, LEVEL = 32 << 10, 512, 256, 6
#: Parts of the sample that are held out in turn to calibrate; the fewest bytes that can be a dictionary.
CALIBRATION_PARTS, LEAST_DICTIONARY = 3, 8
THRESHOLD = 0.3
#: The part of a score that keeps the order where the calibrated curve is level.
ORDER_PART = 0.02


@dataclass(frozen=True)
class Classifier:
    """Dictionaries of label 0 and 1, and a curve of the difference: points (at, share) with straight lines between them,
    and a slope of a small part of the score that keeps the order where the points are level. Without both dictionaries all scores are the prior."""

    bad: bytes
    good: bytes
    at: tuple[float, ...]
    share: tuple[float, ...]
    slope: float
    prior: float

    def score(self, differences: np.ndarray) -> np.ndarray:
        if not (self.bad and self.good):
            return np.full(len(differences), self.prior)
        order = 1 / (1 + np.exp(-np.clip(self.slope * differences, -500, 500)))
        return (1 - ORDER_PART) * np.interp(differences, self.at, self.share) + ORDER_PART * order


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the decimal id, modulo folds, is 0; a null id counts as the word null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds == 0


class _Sizes:
    """Compressed sizes under one dictionary, without headers that differ."""

    def __init__(self, dictionary: bytes):
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary)
        known.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_dict_id=False, write_content_size=False).compress

    def __call__(self, data: bytes) -> int:
        return sum(len(self.compress(data[at : at + CHUNK_BYTES])) for at in range(0, len(data), CHUNK_BYTES))


def differences(texts: list[str | None], bad: bytes, good: bytes) -> np.ndarray:
    """(size under bad - size under good) / bytes of each whole text: above 0 if it is more like good text. 0 for an empty one.

    By the text's bytes and not by the sizes' sum, so that repetition, which leaves little under any dictionary, doesn't enlarge it.
    """
    sizes = [_Sizes(d) for d in (bad, good)]
    out = []
    for text in texts:
        data = (text or "").encode()
        b, g = (s(data) for s in sizes)
        out.append((b - g) / len(data) if data else 0.0)
    return np.array(out, np.float64)


def _dictionary(texts: list[str]) -> bytes:
    import zstandard

    samples = [d[at : at + SAMPLE_BYTES] for d in (t.encode() for t in texts) for at in range(0, len(d), SAMPLE_BYTES)]
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text is the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


def rising_shares(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Isotonic regression of labels on x: neighbours pool while their shares of label 1 fall; (mean x, share) of each pool.
    A pool counts half a document of either label besides, so that no share is 0 or 1."""
    pools: list[list[float]] = []
    for at, label in sorted(zip(x.tolist(), y.tolist())):
        pools.append([1, at, label])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            n, total, ones = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + total, pools[-1][2] + ones]
    return tuple(total / n for n, total, _ in pools), tuple((ones + 0.5) / (n + 1) for n, _, ones in pools)


def training_sample(docs: DataFrame, labels: DataFrame, *, folds: int = 5, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> list[tuple[int, str]]:
    """(label, text) of at most rows documents and about size bytes of each label, by the order of a hash of their ids.

    Held-out ids aren't in it. Ids are chosen among the labels alone, so documents are scanned
    for at most 2 * rows ids (once for lengths, once for texts) and not shuffled; of rows that share an id the least text is read.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("of"))
    known = known.agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other").where(~held_out(F.col("of"), folds)).drop("other")
    order = F.xxhash64("of", F.lit(11))
    chosen = known.where("label = 0").orderBy(order, "of").limit(rows).union(known.where("label = 1").orderBy(order, "of").limit(rows))
    found = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), F.col("id") == F.col("of"))  # at most 2 * rows ids
    texts = found.where("text <> ''").groupBy("of", "label").agg(F.min("text").alias("text"))
    sizes = sorted(texts.select(order.alias("o"), "of", "label", F.octet_length("text").alias("n")).collect())  # numbers only
    wanted, total = [], {0: 0, 1: 0}
    for _, of, label, n in sizes:
        if total[label] + n <= size:
            total[label] += n
            wanted.append(of)
    if not wanted:
        return []
    ids = docs.sparkSession.createDataFrame([(w,) for w in wanted], "wanted long")
    picked = texts.join(F.broadcast(ids), F.col("of") == F.col("wanted"))
    return [(r.label, r.text) for r in sorted(picked.select(order.alias("o"), "of", "label", "text").collect())]


def fit(sample: list[tuple[int, str]]) -> Classifier:
    """From (label, text) in an order that says nothing of them. The dictionaries are made of all texts; the curve is
    fitted to differences of each part of the texts under dictionaries that are made of the other parts."""
    prior = (sum(label for label, _ in sample) + 1) / (len(sample) + 2)
    by = {label: [t for own, t in sample if own == label] for label in (0, 1)}
    bad, good = (_dictionary(by[label]) for label in (0, 1))
    x, y = [], []
    for part in range(CALIBRATION_PARTS):
        others = [_dictionary([t for n, t in enumerate(by[label]) if n % CALIBRATION_PARTS != part]) for label in (0, 1)]
        for label, own in by.items():
            if min(map(len, others)) >= LEAST_DICTIONARY and (held := own[part::CALIBRATION_PARTS]):
                x.append(differences(held, *others))
                y += [label] * len(held)
    if min(len(bad), len(good)) < LEAST_DICTIONARY or not x:
        return Classifier(b"", b"", (), (), 0.0, prior)
    found = np.concatenate(x)
    at, share = rising_shares(found, np.array(y))
    share = tuple(np.maximum.accumulate(share).tolist())  # small pools' halves may step down
    return Classifier(bad, good, at, share, 1 / (float(np.std(found)) or 1.0), prior)


def quality_scores(docs: DataFrame, classifier: Classifier, *, threshold: float = THRESHOLD, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1, higher: label 1 is likelier), predicted (1 if score >= threshold).

    A text is compressed whole, in chunks, under both dictionaries; the difference of the sizes, by the
    text's bytes, becomes a score on the fitted curve. The text alone is scored: equal texts, equal scores. A null text is
    empty, and an empty one has the difference 0. A null id stays null; repeated rows give repeated
    results; an empty table gives an empty result; other columns of docs, whatever their names, are
    not read. A map without a shuffle; the classifier (two dictionaries of at most DICTIONARY_BYTES) is broadcast.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "text")
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    return rows.transform(in_arrow, partial(_score, shared=shared, threshold=threshold), "doc_id long, held_out boolean, score double, predicted int")


def _score(batches, shared, threshold: float):
    model = shared.value
    for batch in batches:
        texts = batch.column(2).to_pylist()
        found = differences(texts, model.bad, model.good) if model.bad and model.good else np.zeros(len(texts))
        score = model.score(found)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def fitted(docs: DataFrame, labels: DataFrame, **options) -> Classifier:
    """A classifier from labels(doc_id, quality) of docs(doc_id, text). Labels that are null or contradict each other are left out;
    without both labels every score is the prior."""
    return fit(training_sample(docs, labels, **options))
