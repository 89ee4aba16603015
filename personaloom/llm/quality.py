"""Quality by compression: zstandard dictionaries of good and of bad text, and a calibrated size difference."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personaloom.llm.batches import bounded
from personaloom.llm.columns import covered, uncovered
from personaloom.llm.wordhash import text_bytes

#: Bounds of the sample that is learnt from: labelled documents per class, and characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 8000
DICTIONARY_BYTES = 112_640
_CHUNK, _LEVEL = 2048, 3


@dataclass
class Model:
    """Two dictionaries and the logistic calibration: weights of the features and a constant."""

    good: bytes
    bad: bytes
    weights: list[float]


def held_out() -> Column:
    """Documents whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Scorer:
    def __init__(self, model: Model):
        import zstandard as z

        self.weights = np.array(model.weights)
        self.sides = []
        for raw in (model.good, model.bad):
            kept = z.ZstdCompressionDict(raw)
            kept.precompute_compress(level=_LEVEL)
            self.sides.append(z.ZstdCompressor(dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, raw: memoryview) -> tuple[float, float]:
        """The normalised difference of the sizes with both dictionaries, and the mean size per byte.

        A text is compressed in chunks, so that it is measured by the dictionaries and not by itself.
        """
        good, bad = (sum(len(s.compress(raw[i : i + _CHUNK])) for i in range(0, max(1, len(raw)), _CHUNK)) for s in self.sides)
        return (bad - good) / max(1, bad + good), (bad + good) / 2 / (len(raw) + 10)

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.clip(features @ self.weights[:2] + self.weights[2], -60, 60)
        return 1 / (1 + np.exp(-x))


def calibrate(features: np.ndarray, labels: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps on standardised features; weights for the plain features."""
    mean, spread = features.mean(0), features.std(0) + 1e-9
    x = np.c_[(features - mean) / spread, np.ones(len(features))]
    b = np.zeros(3)
    ridge = np.diag([1e-2, 1e-2, 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ b)
        b += np.clip(step, -4, 4)
    return [*(b[:2] / spread), float(b[2] - (b[:2] / spread) @ mean)]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model | None:
    """Learns from at most `rows` labelled documents per class, `chars` characters of each; None if a class is missing.

    The sample is the labels of the smallest hashes of doc_id; held-out documents are no part of it. One half
    of each class makes the dictionaries, the other calibrates the scores. Labels other than 0 and 1, and
    labels without text, teach nothing; of several texts or labels of one document the smallest counts.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (1, 0)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * rows ids
    cut = docs.filter("text is not null").select("doc_id", F.substring("text", 1, chars).alias("text"))
    sample = cut.join(ids, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = sorted((r["quality"], hash_order(r["doc_id"]), r["text"].encode()) for r in sample.collect())
    classes = {q: [t for k, _, t in found if k == q] for q in (1, 0)}
    if min(map(len, classes.values())) < 2:
        return None
    halves = {q: (t[: len(t) // 2], t[len(t) // 2 :]) for q, t in classes.items()}
    model = Model(dictionary(halves[1][0]), dictionary(halves[0][0]), [0.0, 0.0, 0.0])
    scorer = Scorer(model)
    rest = [(scorer.features(memoryview(t)), q) for q in (1, 0) for t in halves[q][1]]
    model.weights = calibrate(np.array([f for f, _ in rest]), np.array([q for _, q in rest], float))
    return model


def hash_order(doc_id) -> int:
    return int.from_bytes(str(doc_id).encode()[::-1].ljust(8, b"\0")[:8], "big") * 0x9E3779B97F4A7C15 % (1 << 64)


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of a sample too small to train on, the sample itself."""
    import zstandard as z

    chunks = [t[i : i + _CHUNK] for t in texts for i in range(0, len(t), _CHUNK)]
    try:
        return z.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, chunks)) // 8)), chunks).as_bytes()
    except z.ZstdError:
        return b"".join(chunks)[-DICTIONARY_BYTES:]


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every row of `docs` with score (0 to 1, higher is better) and predicted (1 if score >= 0.5).

    Only the text is looked at, all of it; null counts as empty, and empty texts get the score of size 0.
    Without a model every score is 0.5. Columns named score and predicted are replaced.
    """
    kept = docs.drop("score", "predicted")
    if model is None:
        return kept.withColumns({"score": F.lit(0.5), "predicted": F.lit(1)})
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in bounded(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            raw = memoryview(np.ascontiguousarray(data))
            edges = offsets.tolist()
            features = np.array([scorer.features(raw[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
            score = scorer.score(features)
            yield pa.record_batch(
                [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"]
            )

    return kept.mapInArrow(run, f"{schema}, score double, predicted int")


def good_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` without the rows that the classifier rejects."""
    return uncovered(scored(covered(docs), model).filter("predicted = 1"), docs)
