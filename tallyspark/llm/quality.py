"""Quality by votes of the nearest labelled texts in a latent semantic space.

A text becomes counts of 4-grams of character classes (a letter is ``a`` or ``A``, a digit
``0``, signs stay themselves) and of a few terms for repetition, hashed to ``FEATURES``
columns, weighted by log counts and inverse document frequency, and projected on the
leading singular vectors of the labelled sample. Cosines with all labelled vectors are
exact, in blocks of documents; the labels of the nearest ``neighbours`` vote, weighted by a
power of similarity.

The labelled sample is bounded by ``Settings.sample`` rows, so the model every task receives
is bounded too: projection and vectors are about ``(FEATURES + sample) * rank * 4`` bytes.

Edge cases: a NULL text counts as empty; a text without features (empty, or no signs in
common with the sample) scores the share of label 1 in the sample; labels of unknown
documents and NULL labels are ignored; without any labelled text every score is 0.5;
repeated rows score alike; an empty table gives no rows; other columns of ``docs`` pass
through where ``classify`` is used, and are ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.sampling import hash_sample

FEATURES = 2048
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 20


@dataclass(frozen=True)
class Settings:
    """``sample``: the most labelled rows used; ``rank``: latent dimensions."""

    sample: int = 5000
    rank: int = 64
    neighbours: int = 25
    power: float = 8.0


def _classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint32)
    groups = {ord("\n"): 4, ord(" "): 3, ord("\t"): 3, ord("\r"): 3}
    for b in range(256):
        c = chr(b)
        if b in groups:
            table[b] = groups[b]
        elif b >= 128 or c.islower():
            table[b] = 1
        elif c.isupper():
            table[b] = 2
        elif c.isdigit():
            table[b] = 5
        else:
            table[b] = 6 + b % 58
    return table


CLASSES = _classes()
#: The last columns hold the terms for repetition.
REPETITION = 24
GRAMS = FEATURES - REPETITION


def counts(texts: list[bytes]) -> np.ndarray:
    """Term counts, one row a text."""
    n = len(texts)
    flat = CLASSES[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    lengths = np.fromiter(map(len, texts), np.int64, n)
    out = np.zeros((n, FEATURES), dtype=np.float32)
    if len(flat) >= 4:
        code = flat[:-3] << 18 | flat[1:-2] << 12 | flat[2:-1] << 6 | flat[3:]
        column = ((code * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(GRAMS)
        owner = np.repeat(np.arange(n), lengths)
        inside = owner[:-3] == owner[3:]
        cells = owner[:-3][inside] * FEATURES + column[inside]
        out += np.bincount(cells, minlength=n * FEATURES).reshape(n, FEATURES)
    for row, text in enumerate(texts):
        for term in _repetition(text):
            # As heavy as a common 4-gram, so that it counts in long texts too.
            out[row, GRAMS + term] = max(1, len(text) // 16)
    return out


def _repetition(text: bytes) -> list[int]:
    words = text.split()
    if len(words) < 12:
        return []
    n = len(words)
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    pairs = len(set(zip(words, words[1:], strict=False))) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    unique = len(set(lines)) / max(1, len(lines))
    return [
        int(np.searchsorted((0.03, 0.1, 0.3, 0.6), again)),
        8 + int(np.searchsorted((0.2, 0.4, 0.6, 0.8, 0.9), pairs)),
        16 + int(np.searchsorted((0.3, 0.6, 0.9), unique)),
    ]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9)


class Model:
    """Fitted on the term counts and labels of the sample."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, settings: Settings) -> None:
        self.settings = settings
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        seen = (terms > 0).sum(axis=0)
        self.idf = np.log((1 + len(terms)) / (1 + seen)).astype(np.float32) + 1
        if len(labels):
            weighted = self._weigh(terms)
            values, vectors = np.linalg.eigh(weighted.T @ weighted)
            order = np.argsort(values)[::-1][: settings.rank]
            self.projection = np.ascontiguousarray(vectors[:, order[values[order] > 1e-6]])
            self.vectors = _unit(weighted @ self.projection)

    def _weigh(self, terms: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(terms) * self.idf)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        latent = _unit(self._weigh(counts(texts)) @ self.projection)
        usable = np.flatnonzero(np.abs(latent).sum(axis=1) > 0)
        cosines = latent[usable] @ self.vectors.T
        k = min(self.settings.neighbours, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-6) ** self.settings.power
        out[usable] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return out


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and (i - start >= BLOCK_DOCS or size + len(text) > BLOCK_BYTES):
            yield start, i
            start, size = i, 0
        size += len(text)
    if len(texts) > start:
        yield start, len(texts)


def _raw(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()) -> Model:
    """Fit on at most ``settings.sample`` labelled rows, chosen by a hash of the id.

    ``labels`` holds the rows allowed for training. Only their ids and labels, a bounded
    number, are sent to the scan of the documents; term counts come back.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.select("doc_id", F.col(label).cast("int").alias("_label"))
    chosen = hash_sample(usable, settings.sample, "doc_id")
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Documents repeating an id can give more rows than the bound: the first ``sample`` by
    # (doc_id, text digest, label) are chosen in Spark, repeated rows by their multiplicity,
    # so the same rows are featurised on every run, whatever order tasks finish in.
    key = ["doc_id", "_digest", "_label"]
    known = known.withColumn("_digest", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    first = known.select(*key).orderBy(*key).limit(settings.sample)
    known = known.dropDuplicates(key).join(F.broadcast(first), key)

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = _raw(batch["text"])
            for a, b in _blocks(raw):
                found = counts(raw[a:b])
                where = [np.flatnonzero(r).astype("<i4") for r in found]
                yield pd.DataFrame(
                    {
                        "label": batch["_label"].to_numpy()[a:b],
                        "doc": batch["doc_id"].astype(str).to_numpy()[a:b],
                        "at": [w.tobytes() for w in where],
                        "n": [r[w].astype("<f4").tobytes() for r, w in zip(found, where, strict=True)],
                    }
                )

    rows = known.mapInPandas(terms, "label int, doc string, at binary, n binary")
    rows = sorted(rows.collect(), key=lambda r: (r.doc, r.label, r.at, r.n))
    matrix = np.zeros((len(rows), FEATURES), dtype=np.float32)
    for i, row in enumerate(rows):
        matrix[i, np.frombuffer(row.at, "<i4")] = np.frombuffer(row.n, "<f4")
    return Model(matrix, np.array([r.label for r in rows], dtype=np.float32), settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _score_all(shared.value, _raw(batch["text"]))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "score": found, "predicted": (found >= 0.5).astype("int32")}
            )

    return docs.select("doc_id", "text").mapInPandas(rows, f"doc_id {kind}, score double, predicted int")


def _score_all(model: Model, raw: list[bytes]) -> np.ndarray:
    parts = [model.scores(raw[a:b]) for a, b in _blocks(raw)]
    return np.concatenate(parts) if parts else np.zeros(0)


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows that score ``least`` or more, all columns as they are, without a shuffle."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            found = _score_all(shared.value, _raw(text.to_pylist()))
            yield batch.filter(pa.array(found >= least))

    return docs.mapInArrow(rows, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1
