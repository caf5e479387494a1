"""Language identification with string kernels.

The kernel of two texts is the share of byte n-grams (of blended lengths) that both
hold, presence only, scaled by their numbers of n-grams. Landmark texts span a Nyström
feature space; one ridge regression per language, against the rest, is solved there.
Scoring a batch of documents is one product of their presence matrix with the
landmarks' and one with the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 15
LENGTHS = (1, 2, 3, 4)
_LETTER = re.compile(r"[^\W\d_]")
_ROWS = 64


def present(text: str) -> np.ndarray:
    """Which hashed n-grams of the lower-case text occur, as booleans."""
    out = np.zeros(1 << BITS, dtype=bool)
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    for at in range(0, max(1, len(b)), 1 << 20):  # very long texts piece by piece
        piece = b[at : at + (1 << 20) + max(LENGTHS) - 1].astype(np.uint32)
        code = np.zeros(len(piece), dtype=np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            if len(piece) < n:
                break
            code = code[: len(piece) - n + 1] * np.uint32(257) + piece[n - 1 :] + np.uint32(1)
            if n in LENGTHS:
                out[(code * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    return out


@dataclass(frozen=True)
class Model:
    """Columns of the n-grams that landmarks hold, landmarks' presence scaled by their size, weights by language."""

    columns: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    languages: list[str]

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(rows.sum(1), 1)).astype(np.float32)
        return rows[:, self.columns].astype(np.float32) @ self.landmarks / own[:, None]

    def score(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language of each row and how sure it is, from 0 to 1."""
        k = self.kernel(rows)
        s = np.concatenate([k, np.ones((len(k), 1), dtype=np.float32)], axis=1) @ self.weights
        p = np.exp(4.0 * (s - s.max(1, keepdims=True)))
        return s.argmax(1), (p.max(1) / p.sum(1)).astype(float)


def fit(rows: np.ndarray, labels: list[str], landmarks: int = 96, ridge: float = 1e-3, seed: int = 11) -> Model:
    """Nyström features from ``landmarks`` rows dealt evenly over the languages, then ridge regressions."""
    rng, languages = np.random.default_rng(seed), sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == c))[:each] for c in range(len(languages))])
    marks = rows[chosen]
    columns = np.flatnonzero(marks.any(0))
    scaled = (marks[:, columns] / np.sqrt(np.maximum(marks.sum(1), 1))[:, None]).T.astype(np.float32)
    model = Model(columns, scaled, np.zeros((0, 0)), languages)
    k = np.concatenate([model.kernel(rows[i : i + 256]) for i in range(0, len(rows), 256)]).astype(float)
    mm = model.kernel(marks).astype(float)
    value, vector = np.linalg.eigh((mm + mm.T) / 2)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    x = np.concatenate([k @ root, np.ones((len(k), 1))], axis=1)
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = (1.0 / np.bincount(y)[y])[:, None]  # each language counts alike
    a = x.T @ (x * weight) + ridge * np.diag([*np.ones(root.shape[1]), 0.0])
    w = np.linalg.solve(a + 1e-12 * np.eye(len(a)), x.T @ (target * weight))
    return Model(columns, scaled, np.concatenate([root @ w[:-1], w[-1:]]).astype(np.float32), languages)


def fold(docs: DataFrame) -> Column:
    """crc32 of the id as text, modulo 4; a null id has none."""
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4


def learn(docs: DataFrame, held_out_fold: int = 2, fit_rows: int = 4000) -> Model | None:
    """Fit on rows outside the held-out fold with a text and a language.

    About ``fit_rows`` rows at most, dealt evenly over the languages by hash of the id
    and text; each comes to the driver as a fixed number of presence bits.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(docs) != held_out_fold))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, fit_rows / len(counts) / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.packbits(present(t)).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(packed, pa.binary())], names=["lang", "bits"])

    sample = usable.where(place < share).select("lang", "text").mapInArrow(bits, "lang string, bits binary").distinct().limit(2 * fit_rows).collect()
    sample.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    if not sample:
        return None
    rows = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in sample), dtype=np.uint8)).reshape(len(sample), -1).astype(bool)
    return fit(rows, [r["lang"] for r in sample])


def predict(docs: DataFrame, held_out_fold: int = 2, fit_rows: int = 4000) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) of every document.

    Whole texts are scored; ``lang_pred`` is ``und`` with score 0 for a text that is null
    or has no letter, and where there is nothing to learn from. A null id is in no fold:
    it is neither held out nor learned from. Repeated rows each give a row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, held_out_fold, fit_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if model.value and t and _LETTER.search(t)]
            for at in range(0, len(known), _ROWS):
                some = known[at : at + _ROWS]
                best, sure = model.value.score(np.stack([present(texts[i]) for i in some]))
                for i, b, s in zip(some, best.tolist(), sure.tolist()):
                    names[i], scores[i] = model.value.languages[b], s
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(fold(docs) == held_out_fold, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, "text").mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")
