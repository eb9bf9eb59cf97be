"""Quality classifier from trusted positives and unlabelled text: non-negative unbiased risk."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import stored

#: What is measured of a text; every value is mapped to 0..1.
STATS = ("words", "word_length", "capital_words", "shout_words", "symbol_bytes", "digit_bytes", "space_bytes",
         "symbol_words", "repeats", "distinct", "repeated_pairs", "repeated_lines", "packed", "lone_symbols")
_KNOTS = 9
_PLAIN = np.zeros(256, bool)
_PLAIN[[*b" \t\n\r.,;:'\"?!()-"]] = True
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = _PLAIN[128:] = True


def measure(text: str | None) -> list[float]:
    """The values of ``STATS``, from the whole text; all 0 without words."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATS)
    data = text.encode("utf-8", "surrogatepass")
    n, size = len(words), len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    pairs = n - 1 or 1
    lines = [x for x in text.split("\n") if x.strip()]
    expected = 20.0 * (n / 20.0) ** 0.75 if n > 20 else n  # distinct words of ordinary prose grow slower than its length
    part = lambda x: min(1.0, float(x)) ** 0.5  # noqa: E731  spreads small shares
    return [
        min(1.0, np.log1p(n) / 14), min(1.0, len(text) / n / 20),
        part(sum(w[0].isupper() for w in words) / n), part(sum(len(w) > 1 and w.isupper() for w in words) / n),
        part(counts[~_PLAIN].sum() / size), part(counts[48:58].sum() / size), part(counts[[9, 10, 13, 32]].sum() / size),
        part(sum(not w[-1].isalnum() for w in words) / n),
        part(sum(map(str.__eq__, words, words[1:])) / pairs), min(1.0, len(set(words)) / expected / 1.5),
        part(1 - len(set(zip(words, words[1:]))) / pairs) if n > 1 else 0.0,
        part(1 - len(set(lines)) / len(lines)), min(1.0, len(zlib.compress(data, 1)) / size),
        part(sum(not any(c.isalnum() for c in w) for w in words) / n),
    ]


def basis(stats: np.ndarray) -> np.ndarray:
    """Piecewise linear functions of every value, and a constant."""
    at = np.clip(stats, 0, 1)[:, :, None] * (_KNOTS - 1)
    hats = np.clip(1 - np.abs(at - np.arange(_KNOTS)), 0, None)
    return np.concatenate([hats.reshape(len(stats), -1), np.ones((len(stats), 1))], axis=1)


WIDTH = len(STATS) * _KNOTS + 1


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [np.array(measure(t), "<f4").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "stats": values})

    return docs.select(F.col("doc_id").cast("long").cast("string"), F.xxhash64("text").alias("text_hash"), "text").mapInPandas(
        run, "doc_id string, text_hash long, stats binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def moments(rows: DataFrame) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """For ``u`` (all rows) and ``p`` (rows with ``positive``): count, sum of x, sum of x x'.

    Tasks sum their rows; their sums are added up per entry by a grouped sum, so
    what reaches the driver is a matrix of fixed size, whatever the corpus.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {"u": np.zeros((WIDTH, WIDTH)), "p": np.zeros((WIDTH, WIDTH))}
        for batch in batches:
            x = basis(np.frombuffer(b"".join(batch["stats"]), "<f4").reshape(-1, len(STATS)).astype(float))
            total["u"] += x.T @ x
            own = x[batch["positive"].to_numpy(bool)]
            total["p"] += own.T @ own
        for kind, m in total.items():
            i, j = np.nonzero(m)
            yield pd.DataFrame({"kind": kind, "i": i, "j": j, "v": m[i, j]})

    parts = rows.select("stats", "positive").mapInPandas(run, "kind string, i int, j int, v double")
    out = {"u": np.zeros((WIDTH, WIDTH)), "p": np.zeros((WIDTH, WIDTH))}
    for r in parts.groupBy("kind", "i", "j").agg(F.sum("v").alias("v")).collect():  # at most 2 * WIDTH ** 2
        out[r["kind"]][r["i"], r["j"]] = r["v"]
    return {k: (m[-1, -1], m[-1].copy(), m) for k, m in out.items()}


def _inverse(m: np.ndarray) -> np.ndarray:
    """Of a positive definite matrix, by elimination; small, so without the threads of a BLAS."""
    n = len(m)
    a = np.concatenate([m, np.eye(n)], axis=1)
    for k in range(n):
        a[k] /= a[k, k]
        rest = a[:, k].copy()
        rest[k] = 0
        a -= rest[:, None] * a[k]
    return a[:, n:]


def _times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m * v).sum(axis=1)


def fit(sums: dict[str, tuple[float, np.ndarray, np.ndarray]], prior: float, ridge: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights w of g(x) = w'x that minimise the non-negative risk under squared loss.

    With l(g, y) = (1 - y g)^2 / 4, the risk is prior * E_p[l(g, 1)] +
    max(0, E_u[l(g, -1)] - prior * E_p[l(g, -1)]), plus a ridge. All terms are
    quadratic in w, so counts, sums and products of the rows are enough. Starts at
    the minimum of the unbiased risk; while its second part is below zero, steps
    go against that part, as the non-negative estimator asks.
    """
    (nu, su, mu), (np_, sp, mp) = sums["u"], sums["p"]
    if nu == 0 or np_ == 0:
        return np.zeros(WIDTH)
    au, bu, ap, bp = mu / nu, su / nu, mp / np_, sp / np_
    eye = ridge * np.eye(WIDTH)
    inverse = _inverse(au + eye)
    w = _times(inverse, 2 * prior * bp - bu)
    loss = lambda m, b, y: (1 - 2 * y * (w * b).sum() + (w * _times(m, w)).sum()) / 4
    slope = lambda m, b, y: (_times(m, w) - y * b) / 2
    best, least = w, np.inf
    for _ in range(steps):
        rest = loss(au, bu, -1) - prior * loss(ap, bp, -1)
        risk = prior * loss(ap, bp, 1) + max(0.0, rest) + ridge * (w * w).sum() / 4
        if risk < least:
            best, least = w, risk
        down = slope(au, bu, -1) - prior * slope(ap, bp, -1)
        step = -down if rest < 0 else prior * slope(ap, bp, 1) + down + ridge * w / 2
        w = w - 0.2 * _times(inverse, step)
    return best


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (score >= ``threshold``).

    Only labels of rows outside the held-out fold are read. Rows labelled 1 are
    the trusted positives; all documents are the unlabelled text; labels of 0
    only enter the class prior, the share of 1 among the labelled. The score is
    the estimated probability (g + 1) / 2. Sums run over all rows; no sample.

    A document with labels 1 and 0 counts as 0. Rows that repeat a doc_id share
    its label. Null labels and ids are no labels. Null and empty texts get the
    score of a text without words. Without any positive the score is 0.5.
    """
    return _scored(docs, labels, folds, threshold).drop("text_hash")


def _scored(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """``score_quality`` with text_hash, which tells apart the texts under one doc_id."""
    stats = stored(measured(docs), "quality-stats")
    train = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality")).dropna().filter(
        ~held_out(F.col("_id"), folds)).groupBy("_id").agg(F.min("quality").alias("quality"))
    rows = stats.join(train, F.col("doc_id") == F.col("_id"), "left").select(
        "stats", "quality", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("positive"))
    rows = stored(rows, "quality-rows")
    prior = rows.agg(F.avg((F.col("quality") == 1).cast("double")).alias("p")).first()["p"]
    weights = fit(moments(rows), prior if prior is not None else 0.5)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = basis(np.frombuffer(b"".join(batch["stats"]), "<f4").reshape(-1, len(STATS)).astype(float))
            score = np.clip((_times(x, weights) + 1) / 2, 0, 1)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score,
                                "predicted": (score >= threshold).astype(np.int32), "text_hash": batch["text_hash"]})

    return stats.select(F.col("doc_id").cast("string"), "text_hash", "stats", held_out(F.col("doc_id"), folds).alias("held_out")).mapInPandas(
        run, "doc_id string, held_out boolean, score double, predicted int, text_hash long").withColumn("doc_id", F.col("doc_id").cast("long"))


def keep_good(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` whose own text is predicted 1, with all their columns; rows without id are kept."""
    bad = _scored(docs.select("doc_id", "text"), labels, **options).filter(
        (F.col("predicted") == 0) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_bad_text")).distinct()
    return docs.join(bad, (docs["doc_id"] == bad["_bad"]) & (F.xxhash64(docs["text"]) == bad["_bad_text"]), "left_anti")
