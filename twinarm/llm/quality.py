"""Quality by hierarchical empirical Bayes: a document classifier's evidence with host and path posteriors.

1. A logistic classifier over the shape of a text (its characters, repetitions, lengths), learned from labelled rows, gives each document a probability.
2. Grouped aggregation sums those probabilities by host and by path within host. A Beta prior around the global rate, its strength estimated from
   the spread between hosts, shrinks each host; the same prior strength around the host's posterior shrinks each path. Sparse sites
   stay near the global rate. A document's own probability is left out of the posteriors that it meets.
3. The score's log odds are the document's plus the path posterior's distance from the global rate, by a weight fitted on the labelled rows.

Any two columns serve as host and path; :func:`host_of` and :func:`path_of` cut them out of a URL.

Fitting takes about TRAIN_ROWS labelled rows at most, chosen by a hash, repeated ones once and however many rows a doc_id has; all statistics of sites cover all documents. Defined results: null and
empty texts are judged as empty; null hosts and paths are sites of their own; repeated rows are judged one by one; labels that are null are ignored, the
smaller one counts where a doc_id has several; without labels of both kinds the classifier gives every document 1/2 and sites have no weight; an empty table gives no rows;
further columns are ignored by :func:`score`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_most_about, materialise
from .toxicity import held_out

TRAIN_ROWS = 30_000
#: What a site's distance from the global rate, in log odds, may count at most against a document's own.
MOST_WEIGHT = 2.0
THRESHOLD = 0.5
#: A prior is worth between so many documents.
STRENGTH = (1.0, 1000.0)

_UPPER, _DIGITS = slice(65, 91), slice(48, 58)
_PUNCT = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-"])


def shape(text: str) -> list[float]:
    """Features of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    words = text.split()
    k = max(len(words), 1)
    repeats = sum(map(str.__eq__, words, words[1:]))
    distinct = len(set(words))
    rest = (k - distinct) / k
    shares = [h[_UPPER].sum() / n, h[_DIGITS].sum() / n, h[_PUNCT].sum() / n, h[124] / n, h[10] / n, repeats / k]
    return [*shares, *(float(np.log(s + 1e-3)) for s in shares), float(np.log1p(len(words))), min(n / k, 30.0), rest, rest * float(np.log1p(k)), float(k < 5)]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.1)
    ridge[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return w


def _design(f: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((f - mean) / scale, -8, 8)
    return np.column_stack([np.ones(len(z)), z, z**2])


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased, without a port; null where it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """The first part of a URL's path, the empty string without one."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)", 1)


def marked_rows(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """About that many labelled ids outside the held-out part: doc_id, y."""
    marked = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("y"))
    n = marked.count()
    if n > rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    return marked


def fit(docs: DataFrame, marked: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Mean, scale and weights of the document classifier; None without labels of both kinds."""

    def features(batches):
        for batch in batches:
            f = [shape(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(f, pa.list_(pa.float64()))], names=["y", "f"])

    joined = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("y", "text", F.xxhash64("doc_id", "text").alias("h"))
    joined = at_most_about(joined, "h", TRAIN_ROWS).select("y", "text")
    got = joined.mapInArrow(features, "y int, f array<double>").collect()
    y = np.array([r["y"] for r in got], float)
    if len(set(y)) < 2:
        return None
    f = np.array([r["f"] for r in got])
    mean, scale = f.mean(0), f.std(0) + 1e-6
    return mean, scale, _logistic(_design(f, mean, scale), y)


def evidence(docs: DataFrame, model, host: Column, path: Column) -> DataFrame:
    """Per row of docs: doc_id, host, path, p of the document classifier."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches):
        m = shared.value
        for batch in batches:
            f = np.array([shape(t or "") for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, -1)
            p = np.full(batch.num_rows, 0.5) if m is None or not batch.num_rows else 1 / (1 + np.exp(-np.clip(_design(f, m[0], m[1]) @ m[2], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "path")), pa.array(p)], names=["doc_id", "host", "path", "p"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", host.cast("string").alias("host"), path.cast("string").alias("path"))
    return keyed.mapInArrow(rate, f"doc_id {kind}, host string, path string, p double")


def sites(rated: DataFrame) -> DataFrame:
    """Per (host, path): n, s, its documents and the sum of their probabilities, hn, hs, those of its host, mu, the global rate, and the prior's strength. Rows grow with sites, not documents."""
    paths = rated.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    # Method of moments: the variance between hosts' rates, less what sampling explains, against mu (1 - mu).
    total = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n")).select((F.col("s") / F.greatest("n", F.lit(1))).alias("mu"))
    spread = hosts.join(F.broadcast(total)).select("mu", (F.pow(F.col("hs") / F.col("hn") - F.col("mu"), 2) - F.col("mu") * (1 - F.col("mu")) / F.col("hn")).alias("v"))
    prior = spread.groupBy("mu").agg(F.avg("v").alias("v"))
    strength = F.when(F.col("v") > 0, F.col("mu") * (1 - F.col("mu")) / F.col("v") - 1).otherwise(F.lit(STRENGTH[1]))
    prior = prior.select("mu", F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), strength)).alias("strength"))  # one row
    known = hosts.join(F.broadcast(prior))
    joined = paths.alias("a").join(known.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host")))
    return joined.select(F.col("a.host").alias("host"), "path", "n", "s", "hn", "hs", "mu", "strength")


def _shrunk(prior: Column, total: Column, count: Column) -> Column:
    """The posterior rate of the others of a site, its own row (p) left out."""
    k = F.col("strength")
    return (k * prior + total - F.col("p")) / (k + count - 1)


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(q / (1 - q))


def site_weight(judged: DataFrame, marked: DataFrame) -> float:
    """What the distance counts: a logistic fit of one number on the labelled rows, the document's own log odds given."""
    rows = judged.join(F.broadcast(marked), "doc_id").select("y", "own", "distance", F.xxhash64("doc_id", "own", "distance").alias("h"))
    points = at_most_about(rows, "h", TRAIN_ROWS).select("y", "own", "distance").collect()
    y, own, distance = (np.array(c, float) for c in zip(*points)) if points else (np.zeros(0),) * 3
    w = 0.0
    for _ in range(30 if len(set(y)) > 1 else 0):
        p = 1 / (1 + np.exp(-np.clip(own + w * distance, -30, 30)))
        w -= (distance @ (p - y) + 1e-3 * w) / (distance**2 @ (p * (1 - p)) + 1e-3)
        w = min(max(w, 0.0), MOST_WEIGHT)
    return float(w)


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1: good), host_posterior, path_posterior."""
    marked = marked_rows(labels)
    rated = materialise(evidence(docs, fit(docs, marked), host, path), "rated")
    joined = rated.alias("r").join(sites(rated).alias("s"), F.col("r.host").eqNullSafe(F.col("s.host")) & F.col("r.path").eqNullSafe(F.col("s.path")))
    judged = joined.withColumn("host_posterior", _shrunk(F.col("mu"), F.col("hs"), F.col("hn")))
    judged = judged.withColumn("path_posterior", _shrunk(F.col("host_posterior"), F.col("s"), F.col("n")))
    judged = judged.select("doc_id", "host_posterior", "path_posterior", _logit(F.col("p")).alias("own"), (_logit(F.col("path_posterior")) - _logit(F.col("mu"))).alias("distance"))
    value = 1 / (1 + F.exp(-(F.col("own") + site_weight(judged, marked) * F.col("distance"))))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score"), (value >= threshold).cast("int").alias("predicted"), "host_posterior", "path_posterior")
