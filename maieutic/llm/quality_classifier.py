"""op13: quality scores from document statistics by random Fourier features.

1. **Statistics.**  One pass over the whole texts turns each into a few bounded numbers (shares, means, logarithms), written to
   the shared folder; nothing later reads a text.
2. **Kernel.**  Standardised statistics go through random cosines, whose products approximate a Gaussian kernel.
3. **Ridge.**  Each partition sums its share of the normal equations; the sums are added up and solved once.
4. **Calibration.**  Scores of the labelled rows that the ridge has not seen are counted per narrow bin; isotonic regression over
   those bins (pooling neighbours that fall) gives the probability of a score, with straight lines between the
   centres of its steps.

Numbers that are summed over rows are rounded to integers first, so the sums, and with them the model,
do not depend on partitions or order.  The driver holds matrices and bins whose sizes are parameters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maieutic.llm.common import text_slices, written

STATISTICS = [
    "log_words", "mean_word", "spread_word", "blank_share", "upper_share", "digit_share", "symbol_share", "stop_share", "other_share",
    "beyond_ascii", "distinct_words", "top_word", "same_as_before", "distinct_pairs", "symbol_words", "capital_words",
    "words_a_line", "repeated_lines", "bare_lines",
]
_ONE = 1 << 20  # statistics are multiples of 1 / _ONE
_Z = 1 << 14  # cosines are multiples of 1 / _Z
_CLIP = 6.0  # standard deviations beyond which a statistic counts as this far off
SLICE_BYTES = 1 << 20

# Characters that end words or sentences, and symbols that prose has little of.
_STOPS = ".,;:!?"
_SYMBOLS = "#*$%&|<>=+/\\@^~_{}[]"
_EDGE_SYMBOL = re.compile(f"[{re.escape(_SYMBOLS)}]")


def statistics_of(text: str) -> list[float]:
    """The numbers of one whole text, in the order of ``STATISTICS``; all 0 for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    # Code points are counted per class from one histogram.
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_count = np.bincount(points[points < 128], minlength=128)
    upper = int(ascii_count[65:91].sum())
    lower = int(ascii_count[97:123].sum())
    digits = int(ascii_count[48:58].sum())
    symbols = int(ascii_count[[ord(c) for c in _SYMBOLS]].sum())
    stops = int(ascii_count[[ord(c) for c in _STOPS]].sum())
    beyond = int((points >= 128).sum())
    blanks = size - int(lengths.sum())
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    bare = sum(not x.rstrip().endswith((".", "!", "?", ":", ";", '"')) for x in lines)
    return [
        np.log1p(n) / 12, min(float(lengths.mean()), 40.0) / 40, min(float(lengths.std()), 40.0) / 40, blanks / size,
        upper / max(1, upper + lower), digits / size, symbols / size, stops / n if stops < n else 1.0,
        (int(ascii_count[33:127].sum()) - upper - lower - digits - symbols - stops) / size, beyond / size,
        len(counts) / n, max(counts.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n, pairs / max(1, n - 1),
        sum(_EDGE_SYMBOL.match(w[-1]) is not None for w in words) / n, sum(w[0].isupper() for w in words) / n,
        np.log1p(n / max(1, len(lines))) / 12, 1 - len(set(lines)) / max(1, len(lines)), bare / max(1, len(lines)),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, s)``: the statistics of every whole text as integers, one row per input row (null text: as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_BYTES):
                s = np.array([statistics_of(t.decode("utf-8", "surrogatepass")) for t in texts])
                flat = pa.array(np.rint(s * _ONE).astype(np.int32).ravel())
                yield pa.record_batch(
                    [part.column(0), pa.FixedSizeListArray.from_arrays(flat, len(STATISTICS)).cast(pa.list_(pa.int32()))], names=["id", "s"]
                )

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, s array<int>")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), np.float64).reshape(-1, len(STATISTICS)) / _ONE


class Features:
    """Random cosines of standardised statistics; what it holds depends on their numbers alone."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, n_features: int, width: float, seed: int):
        self.mean, self.spread = mean, spread
        rng = np.random.default_rng(seed)
        # The Gaussian kernel exp(-|u - v|**2 / (2 width**2)): normal frequencies, uniform phases.
        self.frequencies = rng.standard_normal((len(mean), n_features)) / width
        self.phases = rng.uniform(0, 2 * np.pi, n_features)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """Integers: cosines as multiples of 1 / _Z, and a constant of 1 at the end."""
        u = np.clip((s - self.mean) / self.spread, -_CLIP, _CLIP)
        z = np.rint(np.cos(u @ self.frequencies + self.phases) * _Z)
        return np.hstack([z, np.full((len(z), 1), float(_Z))])


def _exact_sums(rows: DataFrame, names: list[str], partial) -> dict[tuple[int, int], int]:
    """Sum integer matrices over partitions: ``partial(batch)`` gives one per batch; entries are keyed by (i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = partial(batch)
                total = found if total is None else total + found
        if total is not None:
            i, j = np.indices(total.shape, np.int32)
            values = pa.array([Decimal(int(v)) for v in total.ravel()], pa.decimal128(38, 0))
            yield pa.record_batch([pa.array(i.ravel()), pa.array(j.ravel()), values], names=["i", "j", "v"])

    found = rows.select(*names).mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): int(r["v"]) for r in found.collect()}


def _moments(train: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, spread) of the statistics."""

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        s = np.asarray(batch.column(0).flatten()).astype(np.int64).reshape(-1, len(STATISTICS))
        # Squares of 2**20 units: 2**40 a row at most, so int64 holds the sum of any batch.
        return np.stack([s.sum(0), (s * s).sum(0), np.full(s.shape[1], len(s))]).astype(object)

    sums = _exact_sums(train, ["s"], partial)
    n = sums.get((2, 0), 0)
    k = len(STATISTICS)
    mean = np.array([sums[0, j] / n / _ONE for j in range(k)]) if n else np.zeros(k)
    var = np.array([(sums[1, j] * n - sums[0, j] ** 2) / (n * _ONE) ** 2 for j in range(k)]) if n else np.ones(k)
    spread = np.sqrt(var)
    return n, mean, np.where(spread > 1e-6, spread, 1.0)


def fit_ridge(train: DataFrame, features: Features, n_features: int, penalty: float) -> np.ndarray:
    """Weights of the ridge regression of ``y`` on the cosines; ``penalty`` is per row, the constant has none."""
    spark = train.sparkSession
    held = spark.sparkContext.broadcast(features)
    k = n_features + 1

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((k, k + 1), np.int64)
        s, y = _matrix(batch, 0), np.asarray(batch.column(1), np.float64)
        for at in range(0, len(s), 4096):  # products below 2**28, so 4096 rows stay exact in doubles
            z = held.value(s[at : at + 4096])
            total += np.rint(z.T @ np.hstack([z, _Z * y[at : at + 4096, None]])).astype(np.int64)
        return total.astype(object)

    sums = _exact_sums(train, ["s", "y"], partial)
    n = sums[k - 1, k - 1] / _Z**2
    a = np.array([[sums[i, j] for j in range(k)] for i in range(k)], np.float64) / _Z**2 / n
    b = np.array([sums[i, k] for i in range(k)], np.float64) / _Z**2 / n
    return np.linalg.solve(a + penalty * np.diag([1.0] * n_features + [0.0]), b)


def pool_adjacent(x: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of bins (centre, rows, rows of label 1, ascending): (centres, levels) of its steps."""
    blocks: list[list[float]] = []  # rows, ones, rows times centre
    for c, n, k in zip(x, total, ones):
        blocks.append([n, k, n * c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 3,
    held_out_fold: int = 1,
    n_features: int = 256,
    width: float = 4.0,
    penalty: float = 1e-4,
    bins: int = 4096,
    seed: int = 13,
) -> DataFrame:
    """``(<id_col>, held_out, score, predicted)``, one row per input row.

    Labels are learnt only from rows whose crc32(id as text) modulo ``folds`` is not ``held_out_fold``.  Of those, rows with
    crc32('c' and the id) even fit the ridge, the others the calibration.  No cap: every labelled row
    counts, as often as it is labelled; labels without a document, without an id or other than 0 and 1 do not.  Statistics of the text are the
    only inputs of a score.

    ``score`` is the calibrated probability of label 1, ``predicted`` is 1 from 0.5 on.  A null or empty text has the
    statistics 0 and its score like any other.  Null ids are not held out and never learnt from; repeated ids keep their rows.
    Where only one label is there to learn from, every score is that label; without any, 0.5.  Where one half has
    no rows or one label, both halves fit and calibrate.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    statistics = written(document_statistics(docs, id_col, text_col), "statistics")
    y = F.col(label_col).cast("int")
    labelled = labels.where(F.col(id_col).isNotNull() & y.isin(0, 1)).where(fold(F.col(id_col), folds) != held_out_fold)
    marked = labelled.select(F.col(id_col).alias("id"), y.alias("y"), (F.crc32(F.concat(F.lit("c"), F.col(id_col).cast("string")).cast("binary")) % 2 == 0).alias("fits"))
    train = written(statistics.join(marked, "id"), "labelled")
    there = {(r["fits"], r["y"]): r["count"] for r in train.groupBy("fits", "y").count().collect()}
    classes = sorted({y for _, y in there})
    id_out = F.col("id").alias(id_col)
    held_out = F.coalesce(fold(F.col("id"), folds) == held_out_fold, F.lit(False)).alias("held_out")
    if len(classes) < 2:
        constant = float(classes[0]) if classes else 0.5
        return statistics.select(id_out, held_out, F.lit(constant).alias("score"), F.lit(int(constant >= 0.5)).alias("predicted"))
    halves = len(there) == 4
    fitting, calibrating = (train.where("fits"), train.where("NOT fits")) if halves else (train, train)

    _, mean, spread = _moments(fitting)
    features = Features(mean, spread, n_features, width, seed)
    weights = fit_ridge(fitting, features, n_features, penalty)
    # Weights as whole numbers too, as large as keeps 64-bit sums exact: a score does not depend on its neighbours in a batch.
    bits = 61 - _Z.bit_length() - len(weights).bit_length() - int(np.ceil(np.log2(np.abs(weights).max() + 1)))
    held = spark.sparkContext.broadcast((features, np.rint(weights * 2.0**bits).astype(np.int64)))

    def ridge(s: np.ndarray) -> np.ndarray:
        features, weights = held.value
        return (features(s).astype(np.int64) @ weights) / (_Z * 2.0**bits)

    def place(raw: np.ndarray) -> np.ndarray:
        """Bin of a raw score; the outer bins take what lies beyond -0.5 and 1.5."""
        return np.clip(np.floor((raw + 0.5) / 2 * bins), 0, bins - 1).astype(np.int64)

    def counted(batch: pa.RecordBatch) -> np.ndarray:
        at, y = place(ridge(_matrix(batch, 0))), np.asarray(batch.column(1), np.int64)
        return np.stack([np.bincount(at, minlength=bins), np.bincount(at[y == 1], minlength=bins)]).astype(object)

    sums = _exact_sums(calibrating, ["s", "y"], counted)
    total = np.array([sums[0, i] for i in range(bins)], np.float64)
    ones = np.array([sums[1, i] for i in range(bins)], np.float64)
    used = total > 0
    centres, levels = pool_adjacent(((np.arange(bins) + 0.5) / bins * 2 - 0.5)[used], total[used], ones[used])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.interp(ridge(_matrix(batch, 1)), centres, levels)
            yield pa.record_batch(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["id", "score", "predicted"]
            )

    scored = statistics.mapInArrow(run, f"id {statistics.schema['id'].dataType.simpleString()}, score double, predicted int")
    return scored.select(id_out, held_out, "score", "predicted")
