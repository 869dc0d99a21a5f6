"""Quality classifier: regularised quadratic discriminant over transformed statistics of each text.

Fitting needs one pass of sums (counts, first and second moments per class) that Spark aggregates;
the model is two means and two Cholesky factors. A text's score is the sigmoid of the difference of
the two Gaussian log-densities plus the log prior ratio.

Defined cases: a null or empty text has all statistics 0 and is scored like any other. Labels that
are null, neither 0 nor 1, or contradict each other for one id are not learned from; repeated equal
labels count once. With no label of one class, every score is the share of the other (0.5 with no
label at all). Only the id and the text are read from the documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrylens.llm.shared import SMALL_STEP_BYTES, Words, giving_back, repeated_words, steps, text_bytes

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
UPPER = np.isin(np.arange(256), np.arange(65, 91))
DIGIT = np.isin(np.arange(256), np.arange(48, 58))
SHOUT = np.isin(np.arange(256), list(b"!"))
STOP = np.isin(np.arange(256), list(b".?"))
FEATURES = (
    "words", "word_length", "symbol_bytes", "upper_bytes", "digit_bytes", "shout_bytes", "stop_bytes",
    "lone_symbols", "symbol_ends", "echoed_words", "repeated_runs", "vocabulary", "equal_lines",
)


def statistics(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text: logarithms of sizes, square roots of shares."""
    w = Words(buf, starts, ends)
    n, rows = w.per_row, w.rows
    size = np.maximum(w.row_end - w.row_start, 1)
    per_word = np.maximum(n, 1)
    hashes = w.hashes()

    def bytes_share(table: np.ndarray) -> np.ndarray:
        return np.sqrt(w.row_sums(table[w.buf]) / size)

    def words_share(flags: np.ndarray) -> np.ndarray:
        return np.sqrt(np.bincount(w.row[flags], minlength=rows) / per_word)

    ends_odd = SYMBOLS[w.buf[w.end - 1]] if len(w.end) else np.zeros(0, bool)
    echo = np.zeros(len(hashes), dtype=bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (w.row[1:] == w.row[:-1])
    keyed = hashes ^ (w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    new = np.zeros(len(hashes), dtype=bool)
    new[np.unique(keyed, return_index=True)[1]] = True
    lines = np.zeros(rows)
    text = w.buf.tobytes()
    for k, (a, b) in enumerate(zip(w.row_start.tolist(), w.row_end.tolist())):
        parts = [x for x in text[a:b].split(b"\n") if x]
        lines[k] = 1 - len(set(parts)) / len(parts) if parts else 0
    return np.column_stack(
        [
            np.log1p(n),
            np.log1p(w.row_sums(w.inside) / per_word),
            bytes_share(SYMBOLS),
            bytes_share(UPPER),
            bytes_share(DIGIT),
            bytes_share(SHOUT),
            bytes_share(STOP),
            words_share(ends_odd & (w.end - w.start == 1)),
            words_share(ends_odd),
            words_share(echo),
            np.sqrt(repeated_words(w, hashes, 8) / per_word),
            np.bincount(w.row[new], minlength=rows) / np.sqrt(2.0 * per_word),
            np.sqrt(lines),
        ]
    )


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Iterable[str] = ()) -> DataFrame:
    """The id, the carried columns and ``stats``, an array of the FEATURES of each whole text."""
    carry = list(carry)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [id_col, *carry]) + ", stats array<double>"
    width = len(FEATURES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            buf, starts, ends = text_bytes(texts)
            for lo, hi in steps(starts, ends, SMALL_STEP_BYTES):
                x = statistics(buf, starts[lo:hi], ends[lo:hi])
                offsets = pa.array(np.arange(0, width * (hi - lo) + 1, width, dtype=np.int32))
                stats = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))
                kept = [batch.column(k)[lo:hi] for k in range(1 + len(carry))]
                yield pa.RecordBatch.from_arrays([*kept, stats], names=[id_col, *carry, "stats"])

    return docs.select(id_col, *carry, text_col).mapInArrow(giving_back(measure), schema)


@dataclass
class Quadratic:
    """Means, inverse Cholesky factors and log terms of the two classes."""

    means: list[np.ndarray]
    whiten: list[np.ndarray]
    log_terms: list[float]
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        density = []
        for mean, factor, log_term in zip(self.means, self.whiten, self.log_terms):
            z = (x - mean) @ factor.T
            density.append(log_term - 0.5 * np.sum(z * z, axis=1))
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(stats: DataFrame, label: str = "quality", shrink: float = 0.2, ridge: float = 1e-3) -> Quadratic:
    """From rows with ``stats`` and a 0/1 label; class covariances are drawn towards the pooled one."""
    d = len(FEATURES)
    x = [F.col("stats")[k] for k in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(x[i]) for i in range(d)] + [F.sum(x[i] * x[j]) for i, j in pairs]
    rows = stats.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"), F.array(*sums).alias("sums")).collect()
    by = {r["label"]: (r["n"], np.array(r["sums"], dtype=float)) for r in rows}
    total = sum(n for n, _ in by.values())
    if 0 not in by or 1 not in by:
        return Quadratic([], [], [], by[1][0] / total if 1 in by else 0.0 if by else 0.5)
    means, spreads = [], []
    for k in (0, 1):
        n, s = by[k]
        mean = s[:d] / n
        second = np.zeros((d, d))
        for (i, j), v in zip(pairs, s[d:]):
            second[i, j] = second[j, i] = v / n
        means.append(mean)
        spreads.append(second - np.outer(mean, mean))
    pooled = sum(by[k][0] * spreads[k] for k in (0, 1)) / total
    whiten, logs = [], []
    for k in (0, 1):
        blend = min(1.0, shrink + (d + 1) / (by[k][0] + d + 1))
        cov = (1 - blend) * spreads[k] + blend * pooled
        cov += np.eye(d) * (ridge + 1e-3 * np.trace(cov) / d)
        chol = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(chol))
        logs.append(float(np.log(by[k][0] / total) - np.log(np.diag(chol)).sum()))
    return Quadratic(means, whiten, logs, by[1][0] / total)


def clear_labels(labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row for each id whose labels are 0 or 1 and agree."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    both = known.groupBy(id_col).agg(F.min(label).alias("low"), F.max(label).alias(label))
    return both.where(F.col("low") == F.col(label)).select(id_col, label)


def scored(stats: DataFrame, model: Quadratic, score: str = "score") -> DataFrame:
    """``stats`` replaced by the model's score of each row."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    width = len(FEATURES)

    @F.pandas_udf("double")
    def of(x):
        import pandas as pd

        rows = np.concatenate(x.to_list()).reshape(-1, width) if len(x) else np.zeros((0, width))
        return pd.Series(shared.value.scores(rows))

    return stats.withColumn(score, of("stats")).drop("stats")


def learn(stats: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id") -> Quadratic:
    """Fit on all rows of ``stats`` that have a clear label and for which ``usable`` holds."""
    return fit(stats.where(usable).join(clear_labels(labels, id_col), id_col))
