"""Quality rules: fixed limits on a document's statistics, then boosted trees fitted on labelled documents.

The trees are flattened into arrays of nodes, so a batch of rows walks all
trees with array reads. Chosen statistics may only lower, or only raise, the
score (``DIRECTIONS``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.columns import free_name

# Limits and characters of the base rule.
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\f"

# Statistics that the trees see: 1 may only raise the score, -1 only lower it, 0 both.
DIRECTIONS = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "duplicate_line_share": -1,
    "repeated_share": -1,
    "upper_share": -1,
    "exclaimed_share": -1,
    "adjacent_share": -1,
    "distinct_share": 0,
    "digit_share": 0,
    "letter_share": 1,
    "line_words": 0,
    "longest_word": 0,
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

# The bound on labelled rows that the trees are fitted on, taken by the hash of their id.
SAMPLE = 20_000
# Fewer labelled rows, or rows of one class only, fit no trees; the base rule then decides alone.
LEAST = 40

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_HIGH = bytes(range(128, 256))


def _without(raw: bytes, chars: bytes) -> int:
    """How many bytes of ``chars`` there are."""
    return len(raw) - len(raw.translate(None, chars))


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    last = dict(zip(words, range(len(words))))
    ids = np.fromiter(map(last.__getitem__, words), dtype=np.uint64, count=len(words))
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # equal windows have equal hashes
    # Equal hashes are looked at word by word.
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    rows = np.stack([ids[at + k] for k in range(window)], axis=1)
    _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    starts = at[counts[inverse.reshape(-1)] > 1]
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _one(text: str | None) -> tuple:
    if not text:
        return (0,) * (len(COUNTS) + len(DIRECTIONS))
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - _without(raw, SPACE)
    symbols = _without(raw, SYMBOLS)
    lines = [x for x in text.split("\n") if x and x.strip(" \t\n\r\x0b\f")]
    repeated = repeated_words(words)
    upper, lower = _without(raw, _UPPER), _without(raw, _LOWER)
    high = len(text) - len(raw.translate(None, _HIGH))  # characters beyond ASCII
    adjacent = sum(map(bytes.__eq__, words[1:], words)) if n > 1 else 0
    chars, some = max(word_chars, 1), max(n, 1)
    return (
        n, word_chars, symbols, len(lines) - len(set(lines)), repeated,
        float(np.log1p(n)), word_chars / some, symbols / chars, (len(lines) - len(set(lines))) / max(len(lines), 1), repeated / some,
        upper / max(upper + lower, 1), raw.count(b"!") / some, adjacent / some, len(set(words)) / some, _without(raw, _DIGITS) / chars,
        (upper + lower + high) / chars, n / max(len(lines), 1), float(max(map(len, words), default=0)),
    )


def _statistics(texts: pd.Series) -> pd.DataFrame:
    rows = [_one(x) for x in texts]
    return pd.DataFrame(rows, columns=[*COUNTS, *DIRECTIONS]).astype({c: "int64" for c in COUNTS} | {c: "float64" for c in DIRECTIONS})


def statistics(text: Column, trees: Trees | None = None) -> Column:
    """A struct of the counts of the base rule and the statistics that the trees see; a null text has none of all.

    With trees also their ``score``, made beside the statistics, so that one worker of a task does both.
    """
    schema = ", ".join([*(f"{c} bigint" for c in COUNTS), *(f"{c} double" for c in DIRECTIONS), *["score double"] * (trees is not None)])

    def made(texts: pd.Series) -> pd.DataFrame:
        found = _statistics(texts)
        if trees is not None:
            found["score"] = trees.score(found[list(DIRECTIONS)].to_numpy(np.float64))
        return found

    return F.pandas_udf(made, f"struct<{schema}>")(text.cast("string"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


@dataclass
class Trees:
    """Full binary trees of equal depth in arrays: row ``t`` is a tree, the children of node ``i`` are 2i+1 and 2i+2."""

    start: float
    feature: np.ndarray  # (trees, inner nodes)
    limit: np.ndarray  # (trees, inner nodes); above goes right
    value: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of good quality of each row."""
        total = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Boosted trees for a 0/1 target with the logistic loss.

    A split against its statistic's direction is not made, and each child's
    values keep to their side of the middle, so the whole score is monotonic.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    inner, leaves = 2**depth - 1, 2**depth
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    total = np.full(len(y), model.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for i in range(inner):
            at = np.flatnonzero(node == i)
            low, high = bounds[i]
            best = _split(binned[at], g[at], h[at], edges, directions, ridge, low, high) if len(at) else None
            left = right = (low, high)
            if best is not None:
                f, cut, values = best
                model.feature[t, i], model.limit[t, i] = f, edges[f][cut]
                middle = sum(values) / 2
                if directions[f] > 0:
                    left, right = (low, middle), (middle, high)
                elif directions[f] < 0:
                    left, right = (middle, high), (low, middle)
                node[at] = 2 * i + 1 + (binned[at, f] > cut)
            else:
                node[at] = 2 * i + 1
            bounds[2 * i + 1], bounds[2 * i + 2] = left, right
        for leaf in range(leaves):
            at = node == inner + leaf
            low, high = bounds[inner + leaf]
            model.value[t, leaf] = rate * np.clip(g[at].sum() / (h[at].sum() + ridge), low, high) if at.any() else 0
        total += model.value[t, node - inner]
    return model


def _split(binned, g, h, edges, directions, ridge, low, high):
    """The best allowed split of a node: statistic, bin and the values of both sides."""
    best, most = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for f, cuts in enumerate(edges):
        if not len(cuts):
            continue
        gl = np.cumsum(np.bincount(binned[:, f], g, len(cuts) + 1))[:-1]
        hl = np.cumsum(np.bincount(binned[:, f], h, len(cuts) + 1))[:-1]
        nl = np.cumsum(np.bincount(binned[:, f], minlength=len(cuts) + 1))[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
        gain = np.where((nl > 0) & (nl < len(g)), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole, -np.inf)
        if directions[f]:
            gain = np.where(directions[f] * (vr - vl) >= 0, gain, -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > most:
            best, most = (f, k, (float(vl[k]), float(vr[k]))), gain[k]
    return best


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees fitted on labelled documents; ``None`` where there are too few labels of either class.

    At most ``sample`` labelled ids, those with the smallest hashes, and one
    text for each: their statistics fit the driver, and so does their join.
    """
    wanted = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(wanted), "doc_id")  # ``sample`` rows at most
        .select("doc_id", "quality", statistics(F.col("text")).alias("s"))
        .groupBy("doc_id", "quality")
        .agg(*(F.min(f"s.{c}").alias(c) for c in DIRECTIONS))
        .toPandas()
        .sort_values("doc_id")
    )
    y = (rows["quality"].to_numpy() > 0).astype(np.float64)
    if len(y) < LEAST or y.min() == y.max():
        return None
    return fit(rows[list(DIRECTIONS)].to_numpy(np.float64), y, list(DIRECTIONS.values()))


def score(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Every row with the counts, ``base_failed``, the trees' ``score`` (null without trees) and ``kept``.

    A null or empty text has no words and fails the base rule. Rows are judged
    one by one, so equal rows are judged alike; other columns pass through, and
    one with the name of a result is replaced.
    """
    s = free_name(docs, "_statistics")
    made = [*COUNTS, "base_failed", "score", "kept"]
    passed = [F.col(f"`{c}`") for c in docs.columns if c not in made]

    good = F.lit(None).cast("double") if trees is None else F.col(f"{s}.score")
    rows = docs.withColumn(s, statistics(F.col("text"), trees))
    failed = base_failed(F.col(f"{s}.n_words"), F.col(f"{s}.n_repeat_words"))
    rows = rows.select(*passed, *(F.col(f"{s}.{c}").alias(c) for c in COUNTS), failed.alias("base_failed"), good.alias("score"))
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= 0.5, F.lit(True)))
