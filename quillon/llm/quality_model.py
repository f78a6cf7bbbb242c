"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is compressed with a dictionary built from texts labelled good and with one built from texts labelled bad. The
difference of the two sizes for each byte of text, calibrated by a logistic curve on other labelled texts, is the
score: how likely label 1 is. The same difference says more of a longer text, so the curve's slope and intercept change
with the logarithm of the length, up to the length of a part. A dictionary only helps the start of what is compressed, so a text is compressed in equal
parts of at most PART bytes: the difference means the same at every length.

Learning takes a bounded sample of the labelled rows: at most `per_class` rows of each label for the dictionaries, and
at most `per_class` others of each label for the curve, whole texts both. Texts are measured where they lie; only the
dictionary texts come to the driver, whole: rows of a label are taken in the order of a hash until they hold `class_bytes`.
Scoring is over every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, slices, texts_of


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


#: Bytes that are compressed at a time.
PART = 16_384


def parts_of(raw: bytes) -> list[bytes]:
    """The text in equal parts of at most PART bytes; an empty text is one empty part."""
    n = max(1, -(-len(raw) // PART))
    ends = [len(raw) * k // n for k in range(n + 1)]
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    level: int = 12
    #: Of the difference, of it times the length, of the length, and the intercept.
    curve: tuple[float, float, float, float] = (1.0, 0.0, 0.0, 0.0)

    def compressors(self):
        import zstandard

        out = []
        for raw in (self.good, self.bad):
            if not raw:
                out.append(zstandard.ZstdCompressor(level=self.level))
                continue
            held = zstandard.ZstdCompressionDict(raw)
            held.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=held, write_dict_id=False))
        return out

    def measure(self, texts: list[str], compressors) -> np.ndarray:
        """Of each text the bytes that the good dictionary saves over the bad one, for each byte of text, that times the
        length, and the length: the logarithm of the bytes, from 64 to PART."""
        good, bad = compressors
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        x = np.array([sum(len(bad.compress(p)) - len(good.compress(p)) for p in parts_of(r)) / (len(r) + 1) for r in raw], np.float64)
        length = np.log(np.clip(np.array([len(r) for r in raw], np.float64), 64, PART))
        return np.stack([x, x * length, length], 1)

    def score(self, measured: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(measured @ np.array(self.curve[:3]) + self.curve[3], -40, 40)))


def build_dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; of few short texts, too few to train one, none."""
    import zstandard

    texts = [t for t in texts if len(t) >= 8]
    size = min(size, sum(map(len, texts)) // 4)
    if len(texts) < 8 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, texts, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Weights of the columns and intercept by Newton's steps, with a small ridge on the scaled columns."""
    if not len(x) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return 0.0, 0.0, 0.0, math.log(p / (1 - p))
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    ridge, w = np.append(np.full(x.shape[1], 0.1), 1e-9), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return (*(float(v) for v in w[:-1] / scale), float(w[-1] - (w[:-1] * mean / scale).sum()))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 800, class_bytes: int = 16 << 20, dictionary_bytes: int = 524_288, level: int = 12) -> CompressionModel:
    """Learn from the labelled rows outside the held-out fold. The sample is those with the smallest hash of the
    doc_id: dictionaries from folds 1 and 2, the curve from folds 3 and 4. Dictionary rows are whole texts, as many as
    `class_bytes` hold; a row of over a quarter of that takes no part. Of a repeated doc_id the smallest text counts,
    of differing labels the lower. Null labels, doc_ids and texts take no part. Where too few or too short texts of a
    label are there, no dictionary is built and every score is the share of label 1."""
    labelled = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = labelled.withColumn("curve", fold(F.col("doc_id")) >= 3).where(fold(F.col("doc_id")) > 0)
    picked = None
    for quality in (0, 1):
        for curve in (False, True):
            part = labelled.where((F.col("quality") == quality) & (F.col("curve") == curve)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
            picked = part if picked is None else picked.union(part)
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    # of a repeated doc_id one text: at most 4 * per_class rows, whatever the corpus
    sample = materialise(sample.groupBy("doc_id", "quality", "curve").agg(F.min("text").alias("text")).select("doc_id", "quality", "curve", "text"))

    bounded_batches(docs.sparkSession)
    size = F.octet_length("text")
    held = F.sum(size).over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most per_class rows of each
    whole = sample.where(~F.col("curve") & (size <= class_bytes // 4)).withColumn("held", held).where(F.col("held") <= class_bytes)
    rows = sorted((r.doc_id, r.quality, r.text) for r in whole.select("doc_id", "quality", "text").collect())
    rows = [(quality, part) for _, quality, text in rows for part in parts_of(text.encode("utf-8", "surrogatepass"))]
    good, bad = (build_dictionary([p for q, p in rows if q == quality], dictionary_bytes) for quality in (1, 0))
    model = CompressionModel(good, bad, level) if good and bad else CompressionModel(b"", b"", level)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in slices(batches, 64):
            measured = model.measure(texts_of(batch.column(2)), compressors)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(measured.tolist(), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    rest = sample.where("curve").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "text").mapInArrow(measure, "doc_id long, quality int, x array<double>")
    rest = sorted((r.doc_id, r.quality, r.x) for r in rest.collect())
    model.curve = logistic(np.array([r[2] for r in rest], np.float64).reshape(-1, 3), np.array([r[1] for r in rest], np.float64))
    return model


def quality_scores(docs: DataFrame, model: CompressionModel, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Null and empty texts get the score of a difference of 0 at the shortest length; very long
    ones are scored whole, part by part; null and repeated keys stay rows of their own; no rows, no result; other columns
    are left out."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in slices(batches, 512):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(model.measure(texts_of(batch.column(1)), compressors)))], ["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    out = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(judge, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, model: CompressionModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs that score at least the threshold, with docs' own columns, whatever their names. Null, empty and
    very long texts are scored as in quality_scores; repeated rows stay or go together; no rows, no result."""
    at = docs.columns.index(text)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in slices(batches, 512):
            yield batch.filter(pa.array(model.score(model.measure(texts_of(batch.column(at)), compressors)) >= threshold))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
