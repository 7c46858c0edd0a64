"""Toxicity scores: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased and framed by spaces; their distinct character n-grams (N_GRAMS), hashed to 2**BITS buckets, are
the features. Each feature's value is its log-count ratio between toxic and other training texts; the FEATURES that tell
most apart are kept, and a logistic regression is fitted to them. It learns from a bounded sample of labelled documents
(TRAINED at most, those of the smallest id hashes); statistics of that sample are counted on the executors.

Defined results: a null text counts as empty; an empty text has no features and gets the score of the bias; without
training texts of both kinds every text gets the smoothed share of toxic ones. Of conflicting labels of a document the
toxic one holds; a null id, null label or label besides 0 and 1 is not learned from. Of documents repeated under an id
the least text is learned from; all rows get a score each. Whole texts of any length are read, and an empty table stays
empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recospark.llm.common import checkpoint, chunks, tidy

N_GRAMS, BITS, FEATURES = (4, 6, 8), 20, 1024
#: Labelled documents learned from at most, and the tasks that count them.
TRAINED, TASKS = 16_000, 8
#: Characters whose n-grams are hashed at once.
STRETCH = 1 << 20
#: Fixed odd multipliers of the n-gram hash.
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def buckets(text: str | None) -> np.ndarray:
    """The distinct buckets of all character n-grams of a text; a long one is read in stretches of STRETCH characters."""
    framed = f" {(text or '').lower()} "
    parts = []
    for a in range(0, len(framed), STRETCH):
        # A stretch overlaps the next one by what the longest n-gram needs.
        x = np.frombuffer(framed[a : a + STRETCH + max(N_GRAMS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        out, h = [], x * _MIX[0]
        for n in range(2, max(N_GRAMS) + 1):
            if len(x) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _MIX[1] + x[n - 1 :] * _MIX[2]
            if n in N_GRAMS:
                out.append((((h ^ (h >> np.uint64(31))) * _MIX[0]) >> np.uint64(64 - BITS)).astype(np.int64))
        parts += [np.unique(np.concatenate(out))] if out else []
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.zeros(0, np.int64), *parts]))


@dataclass
class Model:
    """bucket -> feature (-1: none), the weight of each feature (log-count ratio included), and the bias."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def present(self, text: str | None) -> np.ndarray:
        """The model's features that a text has."""
        found = self.feature[buckets(text)]
        return np.unique(found[found >= 0])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weight[self.present(text)].sum() + self.bias, -500, 500))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression, by gradient steps with momentum."""
    w, at, rate = np.zeros(x.shape[1] + 1), 0, 0.05
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for at in range(1, steps + 1):
        error = (1 / (1 + np.exp(-(x @ w[:-1].astype(x.dtype) + w[-1])))) - y
        g = np.append(x.T @ error.astype(x.dtype) + ridge * w[:-1], error.sum()) / len(y)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**at)) / (np.sqrt(second / (1 - 0.999**at)) + 1e-8)
    return w[:-1], float(w[-1])


def drawn(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """The bounded training sample: text and toxic; learn: a condition on the labels' doc_id."""
    known = labels.select("doc_id", "toxic").filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    ids = known.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(TRAINED).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most TRAINED ids of some 20 bytes are broadcast; of rows repeated under an id one text is learned from.
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def fit(sample: DataFrame) -> Model:
    """A model of the sample's texts; its statistics are counted on the executors in two passes."""
    sample = checkpoint(sample.repartition(TASKS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic] += 1
                counts[toxic, buckets(text)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()]), pa.array([seen[0]]), pa.array([seen[1]])], ["counts", "n0", "n1"])

    counts, n0, n1 = np.zeros((2, 1 << BITS)), 0, 0
    for row in sample.mapInArrow(tidy(count), "counts binary, n0 long, n1 long").collect():
        counts += np.frombuffer(row.counts, np.int32).reshape(2, -1)
        n0, n1 = n0 + row.n0, n1 + row.n1
    nothing = np.full(1 << BITS, -1, np.int16)
    if not (n0 and n1):
        share = (n1 + 0.5) / (n0 + n1 + 2)
        return Model(nothing, np.zeros(0), float(np.log(share / (1 - share))))
    share = (counts + 1) / (np.array([[n0], [n1]]) + 2)
    ratio = np.log(share[1] / share[0])
    gain = np.abs((share[1] - share[0]) * ratio)
    chosen = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    feature = nothing.copy()
    feature[chosen] = np.arange(len(chosen))
    model = Model(feature, ratio[chosen], 0.0)
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shared.value.present(x).astype(np.int16).tobytes() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column(1).cast(pa.int32())], ["features", "toxic"])

    rows = sample.mapInArrow(tidy(features), "features binary, toxic int").collect()
    x, y = np.zeros((len(rows), len(chosen)), np.float32), np.array([r.toxic for r in rows], np.float64)
    for i, r in enumerate(rows):
        own = np.frombuffer(r.features, np.int16)
        x[i, own] = ratio[chosen][own]
    order = np.lexsort((*x[:, ::-8].T, y))  # the order in which rows arrive must not matter
    weight, bias = logistic(x[order], y[order])
    return Model(feature, weight * ratio[chosen], bias)


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text", into: str = "score") -> DataFrame:
    """The columns `keep` and each text's score: how likely it is toxic, 0 to 1."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = StructType([df.schema[c] for c in keep]).add(into, "double")
    arrow = to_arrow_schema(schema)
    columns = keep if text in keep else [*keep, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                scores = [shared.value.score(x) for x in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(scores, pa.float64())], schema=arrow)

    return df.select(*columns).mapInArrow(tidy(run), schema)
