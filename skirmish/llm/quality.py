"""Quality by compression: zstandard dictionaries of good and bad text, the difference of compressed sizes, a calibrated score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each class that the classifier is fitted on, at most: those with the smallest hash of their id.
FIT_ROWS = 3000
#: Of these rows, those with hash mod 3 = 0 calibrate the score; the others make the dictionaries.
DICTIONARY = 112_640
CHUNK = 1024
LEVEL = 1
THRESHOLD = 0.3


class Model:
    """Two dictionaries and a logistic curve over the normalised difference of compressed sizes."""

    def __init__(self, good: bytes, bad: bytes, curve: tuple[float, float], prior: float):
        self.good, self.bad, self.curve, self.prior = good, bad, curve, prior
        self._open()

    def _open(self):
        self._pair = None
        if self.good and self.bad:
            self._pair = []
            for raw in (self.bad, self.good):
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self._pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def __getstate__(self):
        return self.good, self.bad, self.curve, self.prior

    def __setstate__(self, state):
        self.good, self.bad, self.curve, self.prior = state
        self._open()

    def difference(self, text: bytes) -> float:
        """(bytes with the bad dictionary - with the good one) / their sum: above 0 the text is more like good text. Whole text, in chunks."""
        bad, good = self._pair
        a = b = 0
        for i in range(0, len(text), CHUNK):
            part = text[i : i + CHUNK]
            a += len(bad(part))
            b += len(good(part))
        return (a - b) / (a + b) if a + b else 0.0

    def score(self, text: bytes) -> float:
        if self._pair is None:
            return self.prior
        z = self.curve[0] + self.curve[1] * self.difference(text)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(intercept, slope) by Newton steps; x is scaled inside, and the slope is not below 0."""
    scale = float(x.std()) or 1.0
    design, w = np.column_stack([np.ones(len(x)), x / scale]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + ridge * w
        step = np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(2), grad)
        w -= np.clip(step, -3, 3)
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1] / scale))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Fits on ``rows`` labelled rows of each class at most, on the driver, with their whole texts.

    Labels other than 0 and 1, null ids and null texts don't count. Without rows of both classes the model scores the share
    of good labels (0.5 without any).
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__good")).where("__id is not null and __good in (0, 1)")
    pick = lambda k: known.where(F.col("__good") == k).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    ids = pick(0).unionAll(pick(1)).distinct()
    part = docs.join(F.broadcast(ids), F.col(id_col) == F.col("__id")).where(F.col(text_col).isNotNull())  # bounded by 2 x ``rows``
    got = part.select("__id", "__good", F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(3)).alias("part")).toArrow().sort_by([("__id", "ascending"), ("text", "ascending")])
    good, part_no = (np.array(got.column(c).to_pylist()) for c in ("__good", "part"))
    text = np.array([*got.column("text").to_pylist(), None], object)[:-1]
    if not len(good) or good.min() == good.max():
        return Model(b"", b"", (0.0, 0.0), float(good.mean()) if len(good) else 0.5)
    made = {}
    for k in (0, 1):
        samples = [raw[i : i + CHUNK] for t in text[(good == k) & (part_no != 0)] for raw in [t.encode()] for i in range(0, len(raw), CHUNK)]
        try:
            made[k] = zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
        except zstandard.ZstdError:  # too little text for training: the text itself is the dictionary
            made[k] = b"".join(samples)[-DICTIONARY:] or b" " * 8
    model = Model(made[1], made[0], (0.0, 0.0), float(good.mean()))
    held = part_no == 0 if len(set(good[part_no == 0])) == 2 else np.ones(len(good), bool)
    model.curve = logistic(np.array([model.difference(t.encode()) for t in text[held]]), good[held].astype(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the chance that label 1 holds, one row per row of ``docs``.

    Null and empty texts have difference 0 and the curve's value there. Texts count whole at any length; equal texts score
    alike; other columns are not read; an empty table gives an empty result.
    """
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 110 KB

    def run(batches):
        m = shared.value
        for b in batches:
            seen: dict[bytes, float] = {}
            out = []
            for t in common.texts(b.column(1)):
                if t not in seen:
                    seen[t] = m.score(t)
                out.append(seen[t])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels.where(~held_out())))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
