"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A document classifier gives each document log-odds of being good and of being toxic.
Sites shift them: the mean of a host is shrunk toward the global one and that of a path
toward its host's, by as much as method-of-moments concentrations say, so that sparse
sites say little. Sites are summed by grouped aggregation over all documents, and a
document's own evidence is taken out of what its site says about it.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, stored

_PUNCT = bytes(b for b in string.punctuation.encode())
_TO_SPACE = bytes.maketrans(_PUNCT, b" " * len(_PUNCT))
_HEADS = ("good", "toxic")


def shape(text: str) -> tuple[list[float], set[bytes]]:
    """Features of a text's form, and its distinct words in lower case without punctuation."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    by = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    punct = by[list(_PUNCT)].sum()
    upper, lower, digit = by[65:91].sum(), by[97:123].sum(), by[48:58].sum()
    again = sum(map(bytes.__eq__, words, words[1:])) if len(words) > 1 else 0
    plain = raw.lower().translate(_TO_SPACE).split()
    kinds = set(plain)
    return [
        punct / size,
        upper / max(1, upper + lower),
        digit / size,
        again / n,
        1.0 - len(kinds) / max(1, len(plain)),
        (by[33] + by[35] + by[36] + by[37] + by[38] + by[42]) / n,
        by[124] / n,
        np.log1p(n) / 10.0,
        by[10] / n,
    ], kinds


@dataclass
class Model:
    """Words' log-odds by head, and a logistic model of the features by head."""

    words: dict[bytes, tuple[float, float]] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None

    def features(self, text: str) -> list[float]:
        form, kinds = shape(text)
        found = [self.words[w] for w in kinds & self.words.keys()]
        for head in range(2):
            values = [f[head] for f in found]
            form += [max(values, default=0.0), min(values, default=0.0), float(np.tanh(sum(values) / 8.0))]
        return form

    def log_odds(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {head: np.clip(self.inputs(x, head) @ w, -20, 20) for head, w in self.weights.items()}

    def inputs(self, x: np.ndarray, head: str) -> np.ndarray:
        """Scaled features and their squares: toxicity is told from words alone, goodness from form as well."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        z = z[:, -3:] if head == "toxic" else z
        return np.concatenate([z, z**2, np.ones((len(z), 1))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the constant."""
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    penalty = ridge * len(x) * np.r_[np.ones(x.shape[1] - 1), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, vocabulary: int = 2_000) -> Model | None:
    """Fit both heads on at most about ``fit_rows`` labelled documents, chosen by hash of their id.

    Words are weighed by grouped counts over these documents; the ``vocabulary`` most
    telling ones of each head are kept.
    """
    given = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("good"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = given.count()
    if not total:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = given.where(place < int(min(1.0, fit_rows / total) * (1 << 20))).limit(2 * fit_rows)
    sample = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("text", "good", "toxic"), "labelled")
    n, good, toxic = sample.agg(F.count("*"), F.sum("good"), F.sum("toxic")).first()
    if not n:
        return None

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [list(shape(t)[1]) for t in batch["text"].to_pylist()]
            times = np.array([len(k) for k in kinds])
            yield pa.RecordBatch.from_arrays([pa.array([w for k in kinds for w in k], pa.binary()), *(pa.array(np.repeat(batch[h].to_numpy(), times), pa.int32()) for h in _HEADS)], names=["word", *_HEADS])

    counts = sample.mapInArrow(words, "word binary, good int, toxic int").groupBy("word").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).where("n >= 5")
    model, picked = Model(), {}
    for head, have in zip(_HEADS, (good, toxic)):
        share = have / n
        deviation = F.abs(F.col(head) - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-6))
        for r in counts.withColumn("z", deviation).where("z >= 5").orderBy(F.desc("z"), "word").limit(vocabulary).collect():
            picked[bytes(r["word"])] = r
    for word, r in picked.items():
        model.words[word] = tuple(float(np.log((r[h] + 0.5) / (r["n"] - r[h] + 0.5)) - np.log((have + 0.5) / (n - have + 0.5))) for h, have in zip(_HEADS, (good, toxic)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch["good"], batch["toxic"]], names=["x", *_HEADS])

    got = sample.mapInArrow(features, "x array<double>, good int, toxic int").toArrow()
    x = np.array(got["x"].to_pylist())
    model.centre, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    model.weights = {h: logistic(model.inputs(x, h), got[h].to_numpy().astype(float)) for h in _HEADS}
    return model


def evidence(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """Rows (doc_id, sig, host, path, good, toxic): log-odds of every document from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([shared.value.features(t or "") for t in batch["text"].to_pylist()]).reshape(batch.num_rows, -1)
            odds = shared.value.log_odds(x) if batch.num_rows else {h: np.zeros(0) for h in _HEADS}
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "sig", "host", "path")), *(pa.array(odds[h]) for h in _HEADS)], names=["doc_id", "sig", "host", "path", *_HEADS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signature(docs).alias("sig"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, sig long, host string, path string, good double, toxic double")


def signature(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def _sites(rows: DataFrame, head: str) -> tuple[DataFrame, float]:
    """Sums of each path and its host with both concentrations, and the global mean."""
    p = 1 / (1 + F.exp(-F.col(head)))
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    mean = min(max((total["s"] or 0.0) / max(1, total["n"] or 0), 1e-4), 1 - 1e-4)
    host_k = _concentration(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s"), F.lit(mean).alias("m")))
    both = paths.join(hosts, "host")
    host_mean = (F.col("host_s") + host_k * mean) / (F.col("host_n") + host_k)
    path_k = _concentration(both.select("n", "s", host_mean.alias("m")))
    return both.select("host", "path", *(F.col(c).alias(f"{head}_{c}") for c in ("n", "s", "host_n", "host_s")), F.lit(host_k).alias(f"{head}_host_k"), F.lit(path_k).alias(f"{head}_path_k")), mean


def _concentration(sites: DataFrame) -> float:
    """Beta concentration whose spread of site means matches the one seen, by moments.

    Each site of n rows around the expected mean m has variance
    m (1 - m) (1 / n + (1 - 1 / n) / (k + 1)); solved for k over sites of two rows or more.
    """
    m, n = F.col("m"), F.col("n")
    base = m * (1 - m)
    seen = sites.where("n >= 2").agg(
        F.sum(n * F.pow(F.col("s") / n - m, 2)).alias("spread"), F.sum(base).alias("own"), F.sum(base * (n - 1)).alias("between")
    ).first()
    if not seen["between"]:
        return 100.0
    rho = max((seen["spread"] - seen["own"]) / seen["between"], 1e-4)
    return float(min(max(1 / rho - 1, 1.0), 1e4))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, fit_rows: int = 20_000) -> DataFrame:
    """Rows (doc_id, sig, p_good, p_toxic, keep) of every document.

    ``host`` and ``path`` are the site's columns, by default source and lang; nulls form
    one site. A document is kept if it is more likely good than not and more likely not
    toxic. Empty and null texts count as empty. Without labels all are kept, with
    probabilities null. Repeated rows each give a row; other columns are ignored.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = learn(docs, labels, fit_rows)
    if model is None:
        null = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), signature(docs).alias("sig"), null.alias("p_good"), null.alias("p_toxic"), F.lit(True).alias("keep"))
    rows = stored(evidence(docs, model, host, path), "evidence")
    out, sites, means = rows, None, {}
    for head in _HEADS:
        table, means[head] = _sites(rows, head)
        sites = table if sites is None else sites.join(table, ["host", "path"])
    sites = stored(sites, "sites")
    out = beside(out, sites, ["host", "path"], "inner", row_bytes=F.octet_length("host") + F.octet_length("path") + 120)
    for head in _HEADS:
        c = lambda name, head=head: F.col(f"{head}_{name}")
        own = 1 / (1 + F.exp(-F.col(head)))
        host_mean = (c("host_s") - own + c("host_k") * means[head]) / (c("host_n") - 1 + c("host_k"))
        site = (c("s") - own + c("path_k") * host_mean) / (c("n") - 1 + c("path_k"))
        site = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), site))
        shift = F.log(site / (1 - site)) - F.lit(float(np.log(means[head] / (1 - means[head]))))
        out = out.withColumn(f"p_{head}", 1 / (1 + F.exp(-(F.col(head) + shift))))
    return out.select("doc_id", "sig", "p_good", "p_toxic", ((F.col("p_good") >= 0.5) & (F.col("p_toxic") < 0.5)).alias("keep"))
