"""Toxicity: a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within, scratch_path
from passageway.llm.common import written
from passageway.llm.linear import descend
from passageway.llm.ngrams import gram_counts, gram_slots

SIZES = (3, 4, 5)
BITS = 18
#: Code points above which a text's n-grams are counted in a table of all slots rather than sorted.
LONG = 1 << 16
#: Slots of the count table that travel in one row.
CHUNK = 1 << 12
#: Texts whose features travel at once.
ROWS = 128


def text_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the whole text's n-grams, each once, and how often each occurs."""
    if len(text) > LONG:
        counts = gram_counts(text, SIZES, BITS)
        slots = np.flatnonzero(counts)
        return slots, counts[slots]
    return np.unique(np.concatenate([*gram_slots(text, SIZES, BITS), np.zeros(0, dtype=np.int64)]), return_counts=True)


@dataclass
class Model:
    """``column``: the feature of a slot or -1; per feature its log-count ratio and its weight; a bias."""

    column: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    bias: float

    def entries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The features of the whole text, and their counts times their ratios, scaled to length 1."""
        slots, counts = text_counts(text)
        features = self.column[slots]
        known = features >= 0
        features = features[known]
        x = counts[known] * self.ratio[features]
        return features, x / max(1e-12, float(np.sqrt(x @ x)))

    def score(self, text: str | None) -> float:
        features, x = self.entries(text or "")
        return float(1 / (1 + np.exp(-np.clip(x @ self.weight[features] + self.bias, -500, 500))))


def packed(at: np.ndarray, x: np.ndarray) -> tuple[bytes, bytes]:
    """Rising features as 16-bit steps and their values as 16-bit floats: half the bytes that tasks read in each round.
    A step too long for 16 bits is taken over fillers of value 0."""
    step, most = np.diff(at, prepend=0), (1 << 16) - 1
    fill = np.maximum(0, (step - 1) // most)
    if fill.any():
        last = np.cumsum(fill + 1) - 1
        longer, value = np.full(last[-1] + 1, most), np.zeros(last[-1] + 1)
        longer[last], value[last] = step - fill * most, x
        step, x = longer, value
    return step.astype("<u2").tobytes(), x.astype("<f2").tobytes()


def unpacked(steps: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(steps, dtype="<u2"), dtype=np.int64), np.frombuffer(values, dtype="<f2").astype(np.float64)


def class_counts(labelled: DataFrame) -> np.ndarray:
    """Number of different texts with every slot, over all (text, label) of label 0 and 1: an array of 2 by 2^BITS.

    Copies of a text and repeats within one count once, so that no group of copies outweighs the other texts.
    Each task adds up what it reads; its table travels in chunks that are summed slot by slot, so the driver receives
    one table whatever the number of texts.
    """

    def counted(batches):
        table = np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                table[label][text_counts(text.as_py() or "")[0]] += 1
        for label in (0, 1):
            if table[label].any():
                parts = [x.tobytes() for x in table[label].reshape(-1, CHUNK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(parts)), pa.array(range(len(parts))), pa.array(parts, pa.binary())], names=["label", "chunk", "counts"]
                )

    def summed(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in group.column("counts"))
        return pa.table({"label": group.column("label")[:1], "chunk": group.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    shape = "label bigint, chunk bigint, counts binary"
    rows = labelled.select("text", "label").distinct().mapInArrow(counted, shape).groupBy("label", "chunk").applyInArrow(summed, shape)
    out = np.zeros((2, (1 << BITS) // CHUNK, CHUNK), dtype=np.int64)
    for r in rows.toLocalIterator():
        out[r["label"], r["chunk"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return out.reshape(2, -1)


def log_count_ratios(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    p = (counts + smoothing) / (counts + smoothing).sum(1, keepdims=True)
    return np.log(p[1] / p[0])


def _sample(labelled: DataFrame, most_rows: int) -> DataFrame:
    """(text, label): at most ``most_rows`` different ones, those first in order of a hash of the text, so that neither
    copies nor repeated ids take more than one place."""
    rows = labelled.select("text", "label", F.xxhash64("text").alias("h"))
    chosen = rows.select("h", "label").distinct().orderBy("h", "label").limit(most_rows)
    # Copies of a text are brought down to one in each task before the shuffle.
    return rows.join(F.broadcast(chosen), ["h", "label"]).groupBy("h", "label").agg(F.first("text").alias("text")).select("text", "label")


def _cost_over(rows: DataFrame, features: int, cost: float):
    """The regularised logistic cost of weights and bias over rows (label, columns, values), with its gradient.

    Tasks stream through their rows and return one sum each; the driver holds those and the weights, whatever the
    lengths of the texts. The bias is nearly free (a tiny ridge keeps it finite).
    """
    context = rows.sparkSession.sparkContext

    def value(at: np.ndarray) -> tuple[float, np.ndarray]:
        sent = context.broadcast(at)  # 2 MB at most

        def summed(batches):
            w, bias, loss, slope = sent.value[:-1], sent.value[-1], 0.0, np.zeros(features + 1)
            for batch in batches:
                for label, at, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    at, x = unpacked(at.as_py(), x.as_py())
                    sign = 1.0 if label else -1.0
                    margin = sign * float(x @ w[at] + bias)
                    pull = -sign / (1 + np.exp(min(margin, 500.0)))
                    loss += float(np.logaddexp(0, -margin))
                    slope[at] += pull * x  # a row has each feature once, fillers apart, which are 0
                    slope[-1] += pull
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.astype(np.float32).tobytes()], pa.binary())], names=["loss", "slope"])

        parts = rows.mapInArrow(summed, "loss double, slope binary").collect()
        sent.unpersist()
        parts.sort(key=lambda r: (r["loss"], bytes(r["slope"][:64])))  # one order of summation
        ridge = np.append(np.ones(features), 1e-6) * at
        slope = ridge + cost * sum((np.frombuffer(r["slope"], dtype=np.float32) for r in parts), np.zeros(features + 1))
        return 0.5 * float(ridge @ at) + cost * sum(r["loss"] for r in parts), slope

    return value


def train(labelled: DataFrame, most_rows: int = 8_000, features: int = 1 << BITS, cost: float = 30.0, tasks: int = 16) -> Model:
    """Fit on rows (text, label 0 or 1).

    Log-count ratios come from all labelled texts. The weights are fitted by logistic regression on at most
    ``most_rows`` different ones of them (those first in order of a hash of the text) and on all slots that occur; if
    ``features`` is smaller, on so many whose counts differ most from independence of the label. Texts of any length
    enter whole: their features stay in a written table that ``tasks`` tasks stream through for each value of the cost,
    and the driver holds a number per feature. Without both labels the score is the one label there is, 0 without any.
    """
    counts = class_counts(labelled)
    totals = counts.sum(1).astype(float)
    column = np.full(1 << BITS, -1, dtype=np.int32)
    if not totals.all():
        return Model(column, np.zeros(1), np.zeros(1), 30.0 if totals[1] else -30.0)
    expected = counts.sum(0) * totals[1] / totals.sum()
    surprise = np.abs(counts[1] - expected) / np.sqrt(expected + 1)
    chosen = np.argsort(-surprise, kind="stable")[:features]
    chosen = np.sort(chosen[counts.sum(0)[chosen] > 0])
    column[chosen] = np.arange(len(chosen))
    model = Model(column, log_count_ratios(counts)[chosen], np.zeros(len(chosen)), 0.0)

    def sparse(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):  # features take several times the room of their text
                batch = whole.slice(at, ROWS)
                found = [packed(*model.entries(text.as_py() or "")) for text in batch.column(0)]
                columns, values = (pa.array(x, pa.binary()) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int64()), columns, values], names=["label", "columns", "values"])

    shape = "label bigint, columns binary, values binary"
    rows, path = _sample(labelled, most_rows).mapInArrow(sparse, shape), scratch_path(labelled.sparkSession, "entries")
    # Small row groups: a reader holds one at a time.
    rows.write.option("parquet.block.size", 4 << 20).parquet(path)
    entries = labelled.sparkSession.read.schema(shape).parquet(path)
    found = descend(_cost_over(entries.coalesce(tasks), len(chosen), cost), len(chosen) + 1)
    model.weight, model.bias = found[:-1], float(found[-1])
    return model


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(id, text, label) of documents with a label of 0 or 1; a document with conflicting labels has the larger."""
    marks = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("bigint").alias("label"))
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return texts.join(broadcast_within(written(marks, "labels")), "id")


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the model's score of each whole text (0 to 1, higher: toxic likelier).

    Null texts are scored as empty ones, very long ones whole, n-gram counts in a table of fixed size; the score depends
    on nothing but the text, so repeated rows have equal scores; an empty table gives no rows; a column named like ``out`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # about 5 MB, whatever the data

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(sent.value.score).astype(float)

    return docs.withColumn(out, score(F.coalesce(F.col(text).cast("string"), F.lit(""))))
