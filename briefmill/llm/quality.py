"""Quality rules (operator 7): gradient-boosted trees over document statistics.

Trees of small depth are fitted to the labelled documents by histograms of gradients.  On chosen features the
score may only fall (more repetition, more symbols never help): a split on such a feature is taken only if
its two sides are in order, and their middle bounds the values below, so the whole model is monotone.  The
trees are flattened into numpy arrays of nodes and scored for a batch of documents at once.

The model is fitted on at most ``most_rows`` labelled documents, those with the least hashes of their ids;
statistics, base rules and scores cover every document.  Without labels of both kinds there is no verdict of
the model and every document that passes the base rules is kept.

Null texts have no words and fail the base rules.  Rows are independent: repeated rows give repeated
results, an empty table gives an empty one."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import byte_texts, map_arrow, written

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "distinct_share", "words_a_line", "stop_share", "punctuation_share",
]
# -1: the score may only fall as the feature grows
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "digit_share": -1}
MOST_ROWS = 20_000
KEEP_FROM = 0.5

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_STOPS = b".!?"
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\v\f\r"


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of one text.  Words are parted by ASCII white space."""
    text = text or b""
    words = text.split()
    n = len(words)
    seen: set[bytes] = set()
    dup_lines = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    repeat = 0
    triples = Counter(zip(words, words[1:], words[2:]))
    if len(triples) < n - 2:
        covered = 0  # words up to here are counted
        for k, triple in enumerate(zip(words, words[1:], words[2:])):
            if triples[triple] > 1:
                repeat += k + 3 - max(k, covered)
                covered = k + 3
    less = lambda chars: len(text) - len(text.translate(None, chars))
    word_chars = len(text.translate(None, _SPACE + _CONTINUATION))
    symbols = less(_SYMBOLS)
    base = [n, word_chars, symbols, dup_lines, repeat]
    if not n:
        return base, [0.0] * len(FEATURES)
    return base, [
        float(np.log1p(n)), word_chars / n, symbols / word_chars, dup_lines / lines, repeat / n, less(_UPPER) / word_chars,
        less(_DIGITS) / word_chars, len(set(words)) / n, n / lines, less(_STOPS) / n, less(_PUNCTUATION) / word_chars,
    ]


@dataclass
class Trees:
    """Flattened trees: inner nodes go left if the feature is at most the threshold, leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.bias + self.value[node].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2,
        bins: int = 48, penalty: float = 1.0) -> Trees | None:
    """Boosting with logistic loss over binned features; None if only one label occurs."""
    if not len(y) or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(len(y), bias)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        best = float(np.clip(-g[rows].sum() / (h[rows].sum() + penalty), low, high))
        nodes.append([0, np.inf, at, at, best * rate])
        split = _best_split(binned[rows], g[rows], h[rows], cuts, monotone, low, high, penalty) if level < depth else None
        if split is None:
            score[rows] += best * rate
            return at
        f, k, a, b = split
        goes_left = binned[rows, f] <= k
        middle = (a + b) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(monotone[f], ((low, high), (low, high)))
        left = grow(rows[goes_left], g, h, level + 1, *bounds[0])
        right = grow(rows[~goes_left], g, h, level + 1, *bounds[1])
        nodes[at] = [f, cuts[f][k], left, right, 0.0]
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    table = np.array(nodes)
    return Trees(table[:, 0].astype(np.int32), table[:, 1], table[:, 2].astype(np.int32), table[:, 3].astype(np.int32),
                 table[:, 4], np.array(roots, np.int32), depth, bias)


def _best_split(binned, g, h, cuts, monotone, low, high, penalty, least_rows: int = 20):
    """(feature, bin, left value, right value) of the split of most gain that keeps the order, or None."""
    best, found = 1e-6, None
    total_g, total_h, total_n = g.sum(), h.sum(), len(g)
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        size = len(cut) + 1
        gl = np.cumsum(np.bincount(binned[:, f], g, size))[:-1]
        hl = np.cumsum(np.bincount(binned[:, f], h, size))[:-1]
        nl = np.cumsum(np.bincount(binned[:, f], minlength=size))[:-1]
        gr, hr = total_g - gl, total_h - hl
        a = np.clip(-gl / (hl + penalty), low, high)
        b = np.clip(-gr / (hr + penalty), low, high)
        gain = -(gl * a + (hl + penalty) * a * a / 2) - (gr * b + (hr + penalty) * b * b / 2) - total_g**2 / (2 * (total_h + penalty))
        wrong = (nl < least_rows) | (total_n - nl < least_rows) | (monotone[f] * (b - a) < 0)
        gain = np.where(wrong, -np.inf, gain)
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = float(gain[k]), (f, k, float(a[k]), float(b[k]))
    return found


def measured(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts and ``features``."""

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [statistics(text) for text in byte_texts(batch.column("text"))]
            base = np.array([r[0] for r in rows], np.int64)
            return pa.record_batch(
                [batch.column("doc_id"), *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
                ["doc_id", *BASE, "features"])

        return step

    columns = ", ".join(f"{name} bigint" for name in BASE)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_arrow(rows, start, f"doc_id bigint, {columns}, features array<double>")


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Trees | None:
    """Trees for the labels' ``quality`` from at most ``most_rows`` labelled documents."""
    chosen = written(
        labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").alias("labelled"), "quality")
        .orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(most_rows), "labelled")
    rows = measured(docs.join(chosen.select("labelled").distinct(), F.col("doc_id") == F.col("labelled"), "left_semi"))
    sample = rows.join(chosen, rows["doc_id"] == chosen["labelled"]).select("doc_id", "quality", "features")
    # repeated document ids could make more rows than labels: the bound holds for these too
    got = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "features").limit(most_rows).toArrow()
    if not got.num_rows:
        return None
    x = np.array(got["features"].to_pylist())
    y = (np.asarray(got["quality"]) > 0).astype(float)
    return fit(x, y, [MONOTONE.get(name, 0) for name in FEATURES])


def scored(docs: DataFrame, model: Trees | None) -> DataFrame:
    """Base counts and ``score``, the model's probability of good quality (null without a model)."""
    rows = measured(docs)
    if model is None:
        return rows.withColumn("score", F.lit(None).cast("double"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(features: pa.Array) -> pa.Array:
        x = np.asarray(features.flatten()).reshape(len(features), len(FEATURES))
        return pa.array(shipped.value.probability(x))

    return rows.withColumn("score", score("features"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        scored(docs, train(docs, labels)).withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= KEEP_FROM, F.lit(True)))
        .select("doc_id", *BASE, "base_failed", "kept")
    )
