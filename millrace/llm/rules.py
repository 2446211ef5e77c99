"""Quality rules: boosted trees over document statistics, scored from flat node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stats import COUNTS, document_counts, features_of

#: Features along which quality may only rise (1) or only fall (-1); the others are free.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "marks": -1, "upper": -1, "distinct": 1}


@dataclass
class FlatTrees:
    """All trees in arrays: a node's feature, threshold, first child (its second is next) and value; leaves point to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: all trees and rows step down one level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            leaf = self.child[at] == at
            at = np.where(leaf, at, self.child[at] + (x[rows, self.feature[at]] > self.threshold[at]))
        return self.base + self.value[at].sum(axis=1)


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, penalty: float = 1.0, least: int = 20) -> FlatTrees:
    """Gradient boosting on log loss with histogram splits.

    A split on a feature with a sign is taken only if its two values are in
    that order; the middle of the two then bounds everything below either
    side, which keeps the whole ensemble monotonic in the feature.
    """
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    rate_ok = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate_ok / (1 - rate_ok)))
    margin = np.full(n, base)
    feature, threshold, child, value, roots = [], [], [], [], []

    def add() -> int:
        feature.append(0)
        threshold.append(0.0)
        child.append(len(child))
        value.append(0.0)
        return len(child) - 1

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        root = add()
        roots.append(root)
        todo = [(root, np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            weight = float(np.clip(gs / (hs + penalty), low, high))
            value[node] = rate * weight
            best = None
            if level < depth and len(rows) >= 2 * least:
                for f in range(width):
                    size = len(edges[f]) + 1
                    if size < 2:
                        continue
                    b = binned[rows, f]
                    left_g, left_h, left_n = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
                    a = np.clip(left_g / (left_h + penalty), low, high)
                    c = np.clip((gs - left_g) / (hs - left_h + penalty), low, high)
                    gain = 2 * (left_g * a + (gs - left_g) * c) - (left_h + penalty) * a**2 - (hs - left_h + penalty) * c**2
                    ok = (left_n >= least) & (len(rows) - left_n >= least) & (signs[f] * (c - a) >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    k = int(np.argmax(gain))
                    if best is None or gain[k] > best[0]:
                        best = (gain[k], f, k, float(a[k]), float(c[k]))
                whole = 2 * gs * weight - (hs + penalty) * weight**2
                if best is not None and best[0] > whole + 1e-6:
                    _, f, k, a, c = best
                    feature[node], threshold[node] = f, float(edges[f][k])
                    child[node] = add()
                    add()
                    goes = binned[rows, f] > k
                    middle = (a + c) / 2
                    bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[f])]
                    todo += [(child[node], rows[~goes], level + 1, *bounds[0]), (child[node] + 1, rows[goes], level + 1, *bounds[1])]
                    continue
            margin[rows] += value[node]
    return FlatTrees(np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold), np.array(child, np.int64), np.array(value), depth, base)


def sample(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the rows, or all if they are no more: those whose hash of doc_id is low enough for that share."""
    total = rows.count()
    if total <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 32)) < int((1 << 32) * most / total))


def labelled_sample(counts: DataFrame, labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features and labels of about ``most`` labelled documents at most, in a fixed order; one row stands for all of a doc_id."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = sample(marks, most).checkpoint()
    rows = counts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("c"))  # bounded by the sample
    rows = rows.select("doc_id", "quality", "c.*").toPandas().sort_values("doc_id", kind="stable")
    names, x = features_of({c: rows[c].to_numpy() for c in COUNTS})
    return x, rows["quality"].to_numpy().astype(float), names


def judge(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, min_words: int = 10, max_repeat_percent: int = 20, threshold: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, base_failed, score and kept for every document.

    base_failed: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` of them in repeated five-word windows.  Other
    documents are kept if the trees give quality 1 odds of ``threshold`` or
    more.  The trees are fitted on a sample of about
    ``most_labelled`` rows of ``labels`` (doc_id, quality); everything else covers all documents.

    A null text has no words and fails the base; rows with null doc_id or
    label take no part in fitting; repeated rows are judged each for itself,
    and count once in fitting; texts of any length are read whole; an empty
    table gives an empty result; without labels of both kinds every document
    that passes the base is kept.
    """
    counts = document_counts(docs).checkpoint()
    x, y, names = labelled_sample(counts, labels, most_labelled)
    signs = np.array([MONOTONE.get(n, 0) for n in names])
    trees = fit_trees(x, y, signs) if len(set(y.tolist())) == 2 else None
    limit = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rows = features_of({c: batch.column(c).to_numpy() for c in COUNTS})
            score = trees.score(rows) if trees is not None else np.full(batch.num_rows, limit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    fields = ", ".join(f"{n} long" for n in ("doc_id", *COUNTS))
    scored = counts.mapInArrow(run, f"{fields}, score double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= limit))
