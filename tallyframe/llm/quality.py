"""Quality classifier: document evidence and site posteriors by hierarchical empirical Bayes.

A document's own evidence is the log-odds of an additive logistic model on text statistics, each cut at
quantiles of the training sample.  Each document then gives its site evidence: its label where it has one, else
the classifier's probability.  Grouped sums over all documents give, per path (source and language here) and
per host (source), the share of good documents; host shares shrink toward the global share and path shares toward
their host's, with strengths estimated from the spread between sites.  A document's score is its own log-odds moved by
how far its path's posterior lies from the global share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import ship
from .spark_io import bounded_sample, cut, free_name
from .vectext import buffers, mix, scan_words, shingle_hashes, slices_of

TRAIN_ROWS, CUTS = 20_000, 12
_U = np.uint64


def _class(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


_CLASSES = [
    _class(lambda b: 0x41 <= b <= 0x5A),
    _class(lambda b: 0x61 <= b <= 0x7A or b >= 0x80),
    _class(lambda b: 0x30 <= b <= 0x39),
    _class(lambda b: chr(b) in "#*$%&|<>=+^~_{}[]\\/@"),
    _class(lambda b: chr(b) in "!?"),
    _class(lambda b: chr(b) in ".,;:'\"()-"),
    _class(lambda b: b == 0x0A),
]


def _distinct_share(values: np.ndarray, text: np.ndarray, counts: np.ndarray) -> np.ndarray:
    keys = np.unique(mix(values + text.astype(_U) * _U(0x9E3779B97F4A7C15)), return_index=True)[1]
    return np.bincount(text[keys], minlength=len(counts)) / np.maximum(counts, 1)


def text_features(column) -> np.ndarray:
    """(texts, features): log words, bytes a word, shares of byte classes, of equal neighbours, of distinct words and word triples."""
    data, offsets = buffers(column)
    words = scan_words(column)
    n = np.diff(words.bounds)
    size = np.maximum(np.diff(offsets), 1)
    out = [np.log1p(n), (np.add.reduceat(np.r_[words.ends - words.starts, 0], words.bounds[:-1]) * (n > 0)) / np.maximum(n, 1)]
    for kind in _CLASSES:
        total = np.zeros(len(n), dtype=np.int64)
        for a, z in _chunks(len(data)):
            hit = np.flatnonzero(kind[data[a:z]]) + a
            total += np.bincount(np.searchsorted(offsets, hit, side="right") - 1, minlength=len(n))[: len(n)]
        out.append(total / size)
    text = words.text_of()
    same = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (text[1:] == text[:-1])) if len(text) else np.zeros(0, int)
    out.append(np.bincount(text[same], minlength=len(n)) / np.maximum(n, 1))
    out.append(_distinct_share(words.hashes, text, n))
    grams, owner = shingle_hashes(words, 3)
    out.append(_distinct_share(grams, owner, np.bincount(owner, minlength=len(n))))
    return np.stack(out, axis=1)


def _chunks(n: int, size: int = 1 << 20):
    return ((a, min(n, a + size)) for a in range(0, n, size))


@dataclass
class Classifier:
    """Cut points of each feature, a weight for each interval, and an intercept."""

    cuts: list[np.ndarray]
    weights: list[np.ndarray]
    bias: float

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        total = np.full(len(features), self.bias)
        for k, (cuts, weights) in enumerate(zip(self.cuts, self.weights)):
            total += weights[np.searchsorted(cuts, features[:, k], side="right")]
        return total

    @classmethod
    def fit(cls, features: np.ndarray, label: np.ndarray) -> Classifier:
        """Ridge logistic regression by Newton steps; without rows of both classes the log-odds are those of the labels, smoothed."""
        prior = float(np.log((label.sum() + 1) / ((1 - label).sum() + 1))) if len(label) else 0.0
        cuts = [np.unique(np.quantile(features[:, k], np.linspace(0, 1, CUTS + 1)[1:-1])) if len(features) else np.zeros(0) for k in range(features.shape[1])]
        if not len(label) or label.min() == label.max():
            return cls(cuts, [np.zeros(len(c) + 1) for c in cuts], prior)
        blocks = [np.eye(len(c) + 1)[np.searchsorted(c, features[:, k], side="right")] for k, c in enumerate(cuts)]
        x = np.hstack([*blocks, np.ones((len(label), 1))])
        ridge = np.r_[np.full(x.shape[1] - 1, 0.5), 1e-3]
        w = np.zeros(x.shape[1])
        w[-1] = prior
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - label) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        edges = np.cumsum([len(c) + 1 for c in cuts])
        return cls(cuts, np.split(w[:-1], edges[:-1]), float(w[-1]))


def _features(batches):
    for batch in batches:
        for a, z in slices_of(batch.column(0)):
            part = batch.slice(a, z - a)
            values = text_features(part.column(0))
            flat = pa.array(values.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], lists], names=[str(k) for k in range(len(part.columns))])


def _marked(column: str | None) -> Column:
    """A null site is a site of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")) if column else F.lit("")


def _shrunk(sites: DataFrame, parent: Column) -> DataFrame:
    """`sites` (n, good) with `post`: its share of good documents, shrunk toward `parent`; the strength is from the spread that is more than binomial."""
    base = sites.withColumn("prior", parent)
    share, noise = F.col("good") / F.col("n"), F.col("prior") * (1 - F.col("prior"))
    spread = base.where("n >= 2").agg(F.sum(F.col("n") * (share - F.col("prior")) ** 2 - noise).alias("over"), F.sum("n").alias("n"), F.sum(noise * F.col("n")).alias("noise")).first()
    over = max(0.0, spread.over or 0.0) / max(1.0, spread.n or 0.0)
    strength = min(1e4, max(1.0, (spread.noise or 0.0) / max(1.0, spread.n or 0.0) / over - 1)) if over > 0 else 1e4
    return base.withColumn("post", (F.col("good") + strength * F.col("prior")) / (F.col("n") + strength)).drop("prior")


@dataclass
class QualityModel:
    """A classifier, the global share, and the posteriors by path (columns host, path, post) and by host (host, host_post)."""

    classifier: Classifier
    share: float
    paths: DataFrame
    hosts: DataFrame


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _log_odds(classifier: Classifier):
    @F.pandas_udf("double")
    def own(features):
        import pandas as pd

        return pd.Series(classifier.log_odds(np.stack(features.to_list())) if len(features) else np.zeros(0))

    return own


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", path_col: str | None = "lang", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> tuple[QualityModel, DataFrame]:
    """The model, and (id, host, path, log_odds, label) of all rows.

    The classifier takes the `train_rows` labelled rows of least id hash; site sums take all rows.  Null labels count as no
    label; of several labels for an id the least counts.  Rows with a null id have no label but count for their site.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"), _marked(host_col).alias("host"), _marked(path_col).alias("path"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    rows = cut(slim.mapInArrow(_features, "id long, host string, path string, features array<double>").join(known, "id", "left"))
    sample = bounded_sample(rows.where("label is not null").select("id", "features", "label"), "id", train_rows).orderBy(F.xxhash64("id"), "id").limit(train_rows).collect()
    width = len(text_features(pa.array([""]))[0])
    classifier = Classifier.fit(np.array([r.features for r in sample]).reshape(-1, width), np.array([r.label for r in sample], dtype=float))
    scored = rows.withColumn("log_odds", _log_odds(classifier)("features")).drop("features")
    evidence = F.coalesce(F.col("label").cast("double"), 1 / (1 + F.exp(-F.col("log_odds"))))
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(evidence).alias("good")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    share = ((total.good or 0.0) + 1) / ((total.n or 0) + 2)
    hosts = cut(_shrunk(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), F.lit(share)).select("host", F.col("post").alias("host_post")))
    paths = cut(_shrunk(paths.join(hosts, "host"), F.col("host_post")).select("host", "path", "post"))
    return QualityModel(classifier, share, paths, hosts), scored


def _scores(frame: DataFrame, model: QualityModel, host: str, path: str, log_odds: str) -> tuple[DataFrame, str, str]:
    """`frame` with the site's share and the score, and the names of both columns; a site outside the model has its host's share, else the global one."""
    h1, h2, p1, post, host_post, site, score = (free_name(frame, n) for n in ("site_host1", "site_host2", "site_path", "site_post", "site_host_post", "site_share", "site_score"))
    joined = frame.join(model.paths.toDF(h1, p1, post), (F.col(host) == F.col(h1)) & (F.col(path) == F.col(p1)), "left").join(model.hosts.toDF(h2, host_post), F.col(host) == F.col(h2), "left")
    joined = joined.withColumn(site, F.coalesce(post, host_post, F.lit(model.share)))
    joined = joined.withColumn(score, 1 / (1 + F.exp(-(F.col(log_odds) + _logit(F.col(site)) - _logit(F.lit(model.share))))))
    return joined, site, score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", **columns) -> DataFrame:
    """(id, own_score, site_share, score, kept), one row per row of `docs`; kept is score >= threshold.

    A null or empty text is scored by its statistics like any other (all zero).  Repeated rows have equal scores; without
    labels the score is one half moved by nothing, so all is kept; an empty table gives an empty one.
    """
    model, scored = fit_quality(docs, labels, id_col, **columns)
    out, site, score = _scores(scored, model, "host", "path", "log_odds")
    return out.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-F.col("log_odds")))).alias("own_score"), F.col(site).alias("site_share"), F.col(score).alias("score"), (F.col(score) >= threshold).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", path_col: str | None = "lang", **more) -> DataFrame:
    """`docs`, all columns, without the rows whose score is under `threshold`."""
    model, _ = fit_quality(docs, labels, id_col, text_col, host_col, path_col, **more)
    own, host, path = (free_name(docs, n) for n in ("own_log_odds", "own_host", "own_path"))
    position, classifier = docs.columns.index(text_col), model.classifier

    def run(batches):
        for batch in batches:
            for a, z in slices_of(batch.column(position)):
                part = batch.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(classifier.log_odds(text_features(part.column(position))))], names=[str(k) for k in range(len(part.columns) + 1)])

    rows = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(own, DoubleType())])).withColumns({host: _marked(host_col), path: _marked(path_col)})
    out, _, score = _scores(rows, model, host, path, own)
    return out.where(F.col(score) >= threshold).select(*docs.columns)
