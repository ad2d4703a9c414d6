"""Regularised quadratic discriminant over statistics of a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from listing_lake.llm.common import BLANKS, count_of, pack, settled, words

DIGITS, MARKS, SYMBOLS = "0123456789", ".,!?;:'\"()-", "#*$%&|<>_=+@^~\\/{}[]"


def _share(part: Column, whole: Column) -> Column:
    """Variance-stabilised share, with a small prior so that short texts say less."""
    return F.asin(F.sqrt(F.least(F.lit(1.0), (part + 0.05) / (whole + 1.0))))


# Name of each statistic and its transformed value, over the counts of `_counts`.
STATISTICS = {
    "length": lambda c: F.log1p(c("n_words")),
    "word_length": lambda c: F.log1p(c("word_chars") / F.greatest(c("n_words"), F.lit(1))),
    "symbols": lambda c: _share(c("n_symbols"), c("word_chars")),
    "upper": lambda c: _share(c("n_upper"), c("n_letters")),
    "digits": lambda c: _share(c("n_digits"), c("word_chars")),
    "marks": lambda c: _share(c("n_marks"), c("word_chars")),
    "echo": lambda c: _share(c("n_echo"), c("n_words")),
    "distinct": lambda c: _share(c("n_distinct"), c("n_words")),
    "lines": lambda c: F.log1p(c("n_lines")) - F.log1p(c("n_words")),
    "repeated_lines": lambda c: _share(c("n_dup_lines"), c("n_lines")),
}


def _counts(packed: DataFrame) -> DataFrame:
    value = F.col("summary")
    lines = F.filter(F.split(value, "\n"), lambda line: F.length(F.trim(line)) > 0)
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(value) - count_of(value, BLANKS),
        "n_symbols": count_of(value, SYMBOLS),
        "n_letters": F.length(F.regexp_replace(value, r"\P{L}+", "")),
        "n_upper": F.length(F.regexp_replace(value, r"\P{Lu}+", "")),
        "n_digits": count_of(value, DIGITS),
        "n_marks": count_of(value, MARKS),
        "n_echo": F.size(F.filter("words", lambda w, i: F.coalesce(w == F.get(F.col("words"), i - 1), F.lit(False)))),
        "n_distinct": F.size(F.array_distinct("words")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
    }
    return (
        packed.withColumn("words", settled(words(value))).withColumn("lines", settled(lines))
        .select(*packed.columns, *[settled(v).alias(name) for name, v in counts.items()])
    )


def text_statistics(content: DataFrame) -> DataFrame:
    """Adds `statistics`, an array of the transformed `STATISTICS` of the whole summary, in order.

    Null and empty summaries count as texts without words; rows are measured one by one; nothing but the text is read.
    """
    packed, others = pack(content, "statistics")
    values = [f(F.col).cast("double") for f in STATISTICS.values()]
    return _counts(packed).select("content_id", "summary", *others, settled(F.array(*values)).alias("statistics"))


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians: means, inverse Cholesky factors, log normalisers with the log prior, for labels 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log-density difference of label 1 and label 0, prior included."""
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            density.append(self.offsets[k] - 0.5 * np.einsum("ij,ij->i", z, z))
        return density[1] - density[0]


def fit(statistics: DataFrame, labels: DataFrame, shrink: float = 0.1, floor: float = 0.05) -> Discriminant:
    """Learns the discriminant from the labelled rows.

    `statistics` has `content_id` and `statistics`, `labels` has `content_id` and `quality` (0 or 1; other values and nulls are left
    out). Sums and products of each class are aggregated on the cluster over all rows given; the driver gets two rows of
    about d^2/2 numbers. A class covariance becomes (1 - shrink) of its own plus `shrink` of the pooled one, plus `floor` times
    the mean pooled variance on the diagonal. A class without rows takes the pooled values, and no labelled rows give even odds.
    """
    d = len(STATISTICS)
    x = [F.col("statistics")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = (
        statistics.select("content_id", "statistics")
        .join(labels.where(F.col("quality").isin(0, 1)).select("content_id", F.col("quality").cast("int").alias("quality")), "content_id")
        .groupBy("quality")
        .agg(F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p"))
        .collect()
    )
    n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for row in sums:
        n[row.quality], s[row.quality] = row.n, row.s
        for (i, j), v in zip(pairs, row.p):
            p[row.quality][i, j] = p[row.quality][j, i] = v
    if n.sum() == 0:
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    mean_all = s.sum(0) / n.sum()
    means = np.stack([s[k] / n[k] if n[k] else mean_all for k in (0, 1)])
    scatter = [p[k] - n[k] * np.outer(means[k], means[k]) if n[k] else np.zeros((d, d)) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n.sum()
    ridge = floor * max(np.trace(pooled) / d, 1e-9) * np.eye(d)
    factors, offsets = [], []
    for k in (0, 1):
        own = scatter[k] / n[k] if n[k] else pooled
        root = np.linalg.cholesky((1 - shrink) * own + shrink * pooled + ridge)
        factors.append(np.linalg.inv(root))
        offsets.append(np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(root)).sum())
    return Discriminant(means, np.stack(factors), np.array(offsets))


def labelled_sample(content: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """The content rows of at most `most` labelled ids, the first by a hash of the id; enough for the few hundred numbers of the model.

    Only these ids are broadcast, so the bound is also that of the broadcast.
    """
    chosen = labels.where(F.col("quality").isin(0, 1)).select("content_id").distinct().orderBy(F.xxhash64("content_id"), "content_id").limit(most)
    return content.join(F.broadcast(chosen), "content_id", "left_semi")


def score_quality(statistics: DataFrame, model: Discriminant) -> DataFrame:
    """Adds `quality_score`, 0 to 1, higher where label 1 is likelier; a score of 0.5 means even odds. The model is some hundred numbers.

    Rows keep their columns and every row gets a score, those with an empty text too.
    """
    @pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=float)
        odds = model.log_odds(np.stack(values.to_numpy()))
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500))))

    # As nondeterministic, the score is not computed again for a filter on it.
    return statistics.withColumn("quality_score", score.asNondeterministic()("statistics"))
