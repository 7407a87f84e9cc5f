"""Language identification: hashed subword embeddings, averaged, under a linear softmax.

Subwords are the byte n-grams of a text between two spaces, A-Z lower-cased, hashed into buckets.
The model is an embedding for each bucket and a softmax layer over their average, trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows. A temperature fitted on
rows kept out of training calibrates the probabilities, and the rejection threshold is a low
quantile of what correct predictions on these rows get.

To predict, embeddings and layer are multiplied once into a table of scores for each bucket, which
is broadcast (its size is fixed); a text's scores are the average over all of its subwords.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected. Equal
scores go to the label that sorts first. A model without any labelled row rejects everything as
`und`. Rows are judged one by one; further columns are left out but for the id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewgraph.llm.batches import bounded_batches, slices

NONE = "und"
ORDERS = (2, 3, 4)
BUCKET_BITS = 16
DIMENSIONS = 16
# Bounds of the training sample: labelled rows of a language, and characters read of such a row.
SAMPLE_ROWS = 1000
DRAWS = 1 << 30
SAMPLE_CHARS = 8_192
# One in so many sampled rows calibrates instead of training.
CALIBRATION = 5
EPOCHS, RATE, BATCH = 8, 0.5, 32
# Share of correct calibration rows that may fall below the rejection threshold, which is never
# above the highest threshold: text that is clearly nearest to one language stays.
REJECTED_SHARE, HIGHEST_THRESHOLD = 0.001, 0.4
SLICE_BYTES = 1_000_000

_LETTER = regex.compile(r"\p{L}")


def _lowered(text: str) -> bytes:
    return b" " + text.encode("utf-8", "surrogatepass").lower() + b" "


def subword_buckets(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of each n-gram of all texts, and where each text's begin."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.append(0, np.cumsum(lengths))
    for n in ORDERS:
        if len(data) < n:
            yield np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
            continue
        key = data[:len(data) - n + 1].copy()
        for k in range(1, n):
            key = key * np.uint32(257) + data[k:len(data) - n + 1 + k]
        key = (key + np.uint32(n)) * np.uint32(2654435761)
        bucket = (key >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
        whole = np.ones(len(bucket), bool)
        for k in range(1, n):  # n-grams that run over a text's end
            at = starts[1:-1] - k
            whole[at[(at >= 0) & (at < len(whole))]] = False
        kept = np.maximum(lengths - n + 1, 0)
        yield bucket[whole], np.append(0, np.cumsum(kept))


@dataclass
class Model:
    """Scores of each label by bucket, and the threshold below which a prediction is rejected."""

    labels: list[str]
    scores: np.ndarray
    bias: np.ndarray
    threshold: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities of the labels for each text."""
        raw = [_lowered(x) for x in texts]
        total = np.zeros((len(raw), len(self.labels)))
        n = np.zeros(len(raw))
        for bucket, starts in subword_buckets(raw):
            full = np.flatnonzero(np.diff(starts))
            if len(full):
                sums = np.add.reduceat(self.scores[bucket], starts[full], axis=0, dtype=np.float64)
                total[full] += sums
            n += np.diff(starts)
        return softmax(total / np.maximum(n, 1)[:, None] + self.bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets and their shares."""
    out = []
    for text in texts:
        buckets = np.concatenate([b for b, _ in subword_buckets([_lowered(text)])])
        own, counts = np.unique(buckets, return_counts=True)
        out.append((own.astype(np.uint16), (counts / counts.sum()).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """A calibrated model of labelled texts, the same for the same rows in the same order."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in labels])
    rows = _features(texts)
    kept_out = np.arange(len(rows)) % CALIBRATION == CALIBRATION - 1
    fitted = np.flatnonzero(~kept_out)
    embed = rng.normal(0, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIMENSIONS, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    steps, step = max(1, EPOCHS * -(-len(fitted) // BATCH)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(fitted)
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = np.stack([rows[i][1] @ embed[rows[i][0]] for i in part])
            wrong = softmax(mean @ layer + bias)
            wrong[np.arange(len(part)), y[part]] -= 1
            back = wrong @ layer.T
            layer -= rate * mean.T @ wrong / len(part)
            bias -= rate * wrong.mean(axis=0)
            for g, i in zip(back, part):
                own, share = rows[i]
                embed[own] -= rate * np.sqrt(len(own)) * share[:, None] * g[None, :]
    scores = embed @ layer
    held = np.flatnonzero(kept_out) if kept_out.any() else fitted
    z = np.stack([rows[i][1] @ scores[rows[i][0]] + bias for i in held])
    # The temperature with the least loss on rows kept out of training.
    scales = np.geomspace(0.25, 8, 41)
    losses = [-np.log(softmax(z * s)[np.arange(len(held)), y[held]] + 1e-12).mean()
              for s in scales]
    scale = scales[int(np.argmin(losses))]
    p = softmax(z * scale)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    threshold = float(np.quantile(right, REJECTED_SHARE)) if len(right) else 0.0
    return Model(names, (scores * scale).astype(np.float32), bias * scale,
                 min(threshold, HIGHEST_THRESHOLD))


def train_on(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang",
             sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of a sample: at most sample_rows labelled rows of each language.

    Rows are drawn by a hash of their id, from texts with a letter. Of a text of over SAMPLE_CHARS
    characters so many are taken, from a place drawn by a hash of the text.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    over = F.length(text_col) - SAMPLE_CHARS
    start = F.pmod(F.xxhash64(F.col(text_col)), F.greatest(over, F.lit(0)) + 1).cast("int") + 1
    rows = (rows if usable is None else rows.where(usable)).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
        F.when(over > 0, F.substring(F.col(text_col), start, F.lit(SAMPLE_CHARS)))
        .otherwise(F.col(text_col)).alias("text"),
        F.xxhash64(F.col(id_col).cast("string")).alias("draw"))
    # Twice the rows needed pass the draw, so that no language gathers in one task. The model has
    # a column for each label, so that their counts fit where it does.
    labelled = rows.groupBy("lang").count().collect()
    if not labelled:
        return train([], [])
    limits = F.create_map(*[F.lit(x) for r in labelled for x in (
        r["lang"], int(DRAWS * min(1.0, 2 * sample_rows / r["count"])))])
    rows = rows.where(F.pmod("draw", F.lit(DRAWS)) <= limits[F.col("lang")])
    order = W.partitionBy("lang").orderBy("draw", "id", "text")
    drawn = (rows.withColumn("rank", F.row_number().over(order))
             .where(F.col("rank") <= sample_rows).select("lang", "text", "rank").collect())
    drawn.sort(key=lambda r: (r["rank"], r["lang"]))
    return train([r["text"] for r in drawn], [r["lang"] for r in drawn])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id",
            text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns to keep, lang_pred, score and rejected of each row.

    A prediction is rejected if its calibrated probability is below the model's threshold; `und`
    always is. A column to keep that has the name of a result gives way to it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    passed = [id_col, *(c for c in keep if c not in ("lang_pred", "score", "rejected"))]
    rows = docs.select(F.col(text_col).alias("_text"), *passed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            done = 0
            for part in slices(batch, [len(x or "") for x in texts], SLICE_BYTES):
                own = texts[done:done + part.num_rows]
                done += part.num_rows
                told = np.array([bool(x and model.labels and _LETTER.search(x)) for x in own],
                                bool)
                label = [NONE] * len(own)
                score = np.zeros(len(own))
                at = np.flatnonzero(told)
                if len(at):
                    p = model.probabilities([own[i] for i in at])
                    best = p.argmax(axis=1)
                    score[at] = p[np.arange(len(at)), best]
                    for i, b in zip(at.tolist(), best.tolist()):
                        label[i] = model.labels[b]
                rejected = ~told | (score < model.threshold)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k + 1) for k in range(len(passed))), pa.array(label, pa.string()),
                     pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[*passed, "lang_pred", "score", "rejected"])

    schema = T.StructType([rows.schema[c] for c in passed])
    return rows.mapInArrow(run, schema.add("lang_pred", "string").add("score", "double")
                           .add("rejected", "boolean"))
