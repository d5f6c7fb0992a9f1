"""Quality rules: fixed limits, and robust multivariate outliers per language and source.

Each document gives a vector of transformed statistics: the logarithm of its mean
word length, the square root of symbols per word, the share of duplicate lines and
the share of repeated words.  For each language and source the minimum covariance
determinant is estimated over all documents: from a start at medians and quartile
ranges, concentration steps refit mean and covariance to the half of the documents
nearest to the last fit; at last they are refitted to all documents within the
:data:`INNER` quantile.  A document is rejected if its squared Mahalanobis
distance exceeds the :data:`CONFIDENCE` quantile of Hotelling's T-squared, which is
that of chi-squared for many documents and wider where few of them gave the scatter.

A mean or share over few words scatters more, by the root of their number.  So a
statistic is taken as its deviation from the group's median, times the root of
``n_words / FULL_WORDS``, at most 1: a long text is held to no closer limit than one
of :data:`FULL_WORDS` words, and a line said twice does not condemn a short one.

A concentration step is one aggregate by group and distance cell, so a group may
hold any share of the rows; what is fitted in Python is one group's cells, at most
a few hundred rows.  Where most texts have no symbol, double line or repeated word at
all, the scatter of that statistic is exactly zero and says nothing: :data:`FLOORS`
stands in for it there, at about what one repeated line does in a short text.

Groups of fewer than :data:`MIN_GROUP` documents are pooled by language, and what
is then still too small in one rest group.  Null language and null source are
values of their own.  A null or empty text has no words and fails the limits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import BYTE_VALUES, PrefixHash, flat_bytes, joined_hashes, text_blocks, word_ranges
from tidemark.llm.tables import stored
from tidemark.sizes import checked_broadcast

#: Fixed limits: fewest words, largest share of repeated words in percent.
MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = b"#*$%&|<>"

STATISTICS = ("x0", "x1", "x2", "x3")
#: Least standard deviation of each weighted statistic: a guard against a scatter of zero.
FLOORS = np.array([0.005, 0.03, 0.08, 0.035])
FULL_WORDS = 400
MIN_GROUP = 50
STEPS = 4
CONFIDENCE = 0.9999
INNER = 0.975
#: Cells of squared distance per doubling; grid of the medians and quartiles.
CELLS = 16
GRID = 0.005

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_LINE_WORD = re.compile(r"[^\x20\x09-\x0D]")


def block_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of :data:`COUNTS`, and the number of lines with a word, for each text."""
    data, offsets = flat_bytes(texts)
    start, end, places = word_ranges(data, offsets)
    words = PrefixHash(data, BYTE_VALUES).ranges(start, end)
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(letters[end] - letters[start])])
    marks = np.zeros(256, bool)
    marks[list(SYMBOLS)] = True
    symbols = np.concatenate([[0], np.cumsum(marks[data])])
    triples = joined_hashes(words, 3)
    repeated, lines, double = [], [], []
    for first, last in zip(places[:-1], places[1:], strict=True):
        own = triples[first : max(first, last - 2)]
        covered = 0
        if len(own) > 1:
            order = np.argsort(own, kind="stable")
            same = own[order[1:]] == own[order[:-1]]
            if same.any():
                twice = np.zeros(last - first, bool)
                found = np.concatenate([order[1:][same], order[:-1][same]])
                for step in range(3):
                    twice[found + step] = True
                covered = int(twice.sum())
        repeated.append(covered)
    for text in texts.to_pylist():
        own_lines = [line for line in (text or "").split("\n") if _LINE_WORD.search(line)]
        lines.append(len(own_lines))
        double.append(len(own_lines) - len(set(own_lines)))
    return {
        "n_words": np.diff(places),
        "word_chars": np.diff(chars[places]),
        "n_symbols": np.diff(symbols[offsets]),
        "n_dup_lines": np.array(double, np.int64),
        "n_repeat_words": np.array(repeated, np.int64),
        "n_lines": np.array(lines, np.int64),
    }


def text_counts(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep``, those of :data:`COUNTS` and ``n_lines``."""
    rows = docs.select(*keep, docs[text].alias("_text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "_text"):
            found = block_counts(block.column("_text"))
            columns = [pa.array(values, pa.int64()) for values in found.values()]
            yield pa.RecordBatch.from_arrays([*(block.column(name) for name in keep), *columns], [*keep, *found])

    kept = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in keep)
    return rows.mapInArrow(count, f"{kept}, {COUNTS}, n_lines long")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def statistics() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / words,
    ]


def _chi2_tail(x: float, dof: int) -> float:
    """P(chi-squared > x)."""
    odd = dof % 2
    term, total = (math.sqrt(2 * x / math.pi), 0.0) if odd else (1.0, 0.0)
    for k in range(dof // 2):
        total += term
        term *= x / (2 * k + 3) if odd else x / (2 * k + 2)
    return math.exp(-x / 2) * total + (math.erfc(math.sqrt(x / 2)) if odd else 0.0)


def chi2_quantile(share: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - _chi2_tail(middle, dof) < share else (low, middle)
    return high


def distance_limit(n: int) -> float:
    """The :data:`CONFIDENCE` quantile of Hotelling's T-squared, if ``n`` documents gave the scatter."""
    size = len(STATISTICS)
    half = max(n - size, 1) / 2
    # For four statistics, the tail of the F distribution is a power times a linear term.
    low, high = 0.0, 1.0
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if x**half * (1 + half * (1 - x)) < 1 - CONFIDENCE else (low, x)
    return (1 / high - 1) * (n * n - 1) / n


def _fit_row(group, mean: np.ndarray, cov: np.ndarray, n: int) -> dict:
    """A fit to ``n`` documents as one row: the mean, the whitening matrix row by row, and the limit."""
    cov = cov + np.diag(np.maximum(FLOORS**2 - np.diag(cov), 0))
    white = np.linalg.inv(np.linalg.cholesky(cov))
    return {"_group": group, "mean": mean.tolist(), "white": white.ravel().tolist(), "limit": distance_limit(int(n))}


_FIT = "_group string, mean array<double>, white array<double>, limit double"


def _weighted(rows: DataFrame, centre: DataFrame) -> DataFrame:
    """Each statistic as its deviation from ``centre``, of less weight in a text of few words."""
    weight = F.sqrt(F.least(F.col("n_words"), F.lit(FULL_WORDS)) / FULL_WORDS)
    centre = centre.select("_group", F.col("mean").alias("_centre"))
    found = {x: (F.col(x) - F.col("_centre")[k]) * weight for k, x in enumerate(STATISTICS)}
    return rows.join(checked_broadcast(centre), "_group", "left").withColumns(found).drop("_centre")


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges by group, from counts on a grid."""
    size = len(STATISTICS)
    cells = F.posexplode(F.array(*(F.floor(F.col(x) / GRID) for x in STATISTICS)))
    counted = rows.select("_group", cells.alias("_which", "_cell")).groupBy("_group", "_which", "_cell").count()

    def fit(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        mean, spread = np.zeros(size), np.zeros(size)
        for which, own in cells.groupby("_which"):
            own = own.sort_values("_cell")
            reached = own["count"].cumsum().to_numpy()
            low, middle, high = (
                own["_cell"].to_numpy()[np.searchsorted(reached, share * reached[-1])] * GRID for share in (0.25, 0.5, 0.75)
            )
            mean[which], spread[which] = middle, (high - low) / 1.349
        return pd.DataFrame([_fit_row(key[0], mean, np.diag(spread**2), reached[-1])])

    return counted.groupBy("_group").applyInPandas(fit, _FIT)


def _distance() -> Column:
    """Squared Mahalanobis distance from a row's statistics and its group's ``mean`` and ``white``."""
    size = len(STATISTICS)
    centred = [F.col(x) - F.col("mean")[k] for k, x in enumerate(STATISTICS)]
    total = F.lit(0.0)
    for i in range(size):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col("white")[i * size + j] * centred[j]
        total = total + part * part
    return total


def _refit(rows: DataFrame, fit: DataFrame, share: float | None) -> DataFrame:
    """Refit each group to its nearest ``share``, or to all within the quantile :data:`INNER`."""
    size = len(STATISTICS)
    pairs = [(i, j) for i in range(size) for j in range(i + 1)]
    near = rows.join(checked_broadcast(fit), "_group").withColumn("_cell", F.floor(CELLS * F.log2(1 + _distance())))
    sums = [F.sum(x).alias(f"s{k}") for k, x in enumerate(STATISTICS)]
    products = [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}{j}") for i, j in pairs]
    cells = near.groupBy("_group", "_cell").agg(F.count("*").alias("n"), *sums, *products)
    edge = math.floor(CELLS * math.log2(1 + chi2_quantile(INNER, size)))

    def refit(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("_cell")
        reached = cells["n"].cumsum().to_numpy()
        nearest = int(np.searchsorted(reached, reached[-1] * (share or 0.5))) + 1
        if share is None:
            nearest = max(nearest, int(np.searchsorted(cells["_cell"], edge, "right")))
        used = cells.iloc[:nearest]
        n = used["n"].sum()
        mean = np.array([used[f"s{k}"].sum() / n for k in range(size)])
        cov = np.zeros((size, size))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = used[f"p{i}{j}"].sum() / n - mean[i] * mean[j]
        # Rounding may leave tiny negative directions.
        values, vectors = np.linalg.eigh(cov)
        cov = (vectors * np.maximum(values, 0)) @ vectors.T
        # What was cut off is made up for in the dimensions that scatter; a constant statistic is none.
        free = max(1, int((np.diag(cov) > 1e-9).sum()))
        kept = share or INNER
        consistent = kept / (1 - _chi2_tail(chi2_quantile(kept, free), free + 2))
        return pd.DataFrame([_fit_row(key[0], mean, consistent * cov, n)])

    return cells.groupBy("_group").applyInPandas(refit, _FIT)


def _concentrate(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """One concentration step: refit to the nearest half of each group."""
    return _refit(rows, fit, 0.5)


def judge(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep``, the counts, ``base_failed``, ``distance`` and ``kept`` for every row."""
    named = docs.select(*keep, docs[text].alias("_text"), docs[lang].alias("_lang"), docs[source].alias("_source"))
    counted = text_counts(named, "_text", (*keep, "_lang", "_source"))
    part = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("_lang", "_source")]
    scored = stored(
        counted.select(
            *keep, *(c.split()[0] for c in COUNTS.split(", ")), base_failed().alias("base_failed"),
            *(x.alias(name) for x, name in zip(statistics(), STATISTICS, strict=True)),
            F.to_json(F.array(part[0])).alias("_by_lang"), F.to_json(F.array(*part)).alias("_by_source"),
        ),
        "quality",
    )
    fitted = scored.where(~F.col("base_failed"))
    # Which level a group is fitted at: its own, its language's rest, the rest of all.
    sizes = fitted.groupBy("_by_lang", "_by_source").agg(F.count("*").alias("_n"))
    small = F.col("_n") < MIN_GROUP
    rests = sizes.where(small).groupBy("_by_lang").agg(F.sum("_n").alias("_rest"))
    levels = stored(
        scored.select("_by_lang", "_by_source").distinct()
        .join(sizes, ["_by_lang", "_by_source"], "left").join(rests, "_by_lang", "left")
        .select(
            "_by_source",
            F.when(F.col("_n") >= MIN_GROUP, F.col("_by_source"))
            .when(F.col("_rest") >= MIN_GROUP, F.col("_by_lang")).otherwise(F.lit("rest")).alias("_group"),
        ),
        "quality-levels",
    )
    levels = checked_broadcast(levels)
    rows = fitted.join(levels, "_by_source").select("_group", "n_words", *STATISTICS)
    centre = stored(_start(rows), "quality-centre")
    rows = _weighted(rows, centre)
    fit = stored(_start(rows), "quality-fit")
    for _ in range(STEPS):
        fit = stored(_concentrate(rows, fit), "quality-fit")
    fit = stored(_refit(rows, fit, None), "quality-fit")
    judged = _weighted(scored.join(levels, "_by_source"), centre).join(checked_broadcast(fit), "_group", "left")
    distance = F.when(~F.col("base_failed"), _distance())
    return judged.select(
        *keep, *(c.split()[0] for c in COUNTS.split(", ")), "base_failed", distance.alias("distance"),
        F.coalesce(~F.col("base_failed") & (distance <= F.col("limit")), F.lit(False)).alias("kept"),
    )
