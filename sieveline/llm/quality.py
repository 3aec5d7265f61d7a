"""Quality rules: gradient-boosted trees over document statistics.

The trees are fitted here, on the driver, with numpy: histogram splits on the logistic loss, and
for the features named in ``MONOTONE`` only splits whose leaf values go the right way, with the
bounds handed down to the children, so the score never rises (or falls) with that feature. They are
then flattened into node arrays, which score a whole batch of documents level by level.

Fitting uses at most ``MAX_LABELLED`` labelled rows, those with the smallest hash of their id;
statistics and verdicts cover every document.

Cases: a null or empty text has no words, fails the base rule and is not kept; without a label of
either kind the verdict is that of the base rule; several labels for an id count each; repeated rows
give repeated results; an empty table gives an empty result; a very long text is worked on in slices (see ``_in_slices``);
other columns of the input are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import ship
from sieveline.llm.windows import SLICE, distinct, distinct_words, slices, window_hashes

MAX_LABELLED = 20_000
#: Characters from which on a text is worked on in slices.
LONG = 4 << 20
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "distinct", "marks", "digits", "line_words", "longest_word")
_WORD = re.compile(r"[^\x20\x09-\x0D]")
#: -1: a larger value never raises the score.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "marks": -1}
#: A document goes if its score (log odds of being good) is below this.
THRESHOLD = math.log(0.25 / 0.75)


def repeated_words(words: list, size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, total = 0, 0
    for at, w in enumerate(windows):
        if counts[w] > 1:
            total += at + size - max(covered, at)
            covered = at + size
    return total


def repeated_places(hashes: np.ndarray, size: int = 5) -> int:
    """As ``repeated_words``, from the hashes of all windows in order: places in a window whose hash comes twice or more."""
    ordered = np.sort(hashes)
    twice = distinct(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(twice):
        return 0
    covered = np.zeros(len(hashes) + size - 1, dtype=bool)
    for i in range(0, len(hashes), SLICE):
        part = hashes[i : i + SLICE]
        at = np.minimum(np.searchsorted(twice, part), len(twice) - 1)
        again = twice[at] == part
        for k in range(size):
            covered[i + k : i + k + len(part)] |= again
    return int(covered.sum())


def _in_slices(text: str, step: int | None = None) -> tuple[int, int, int, int, int, int, int]:
    """Words, upper-case words, the longest, distinct ones, repeated ones, lines with a word, and those equal to an earlier one, of a long text.

    Lists hold a slice; of the whole text there are eight bytes for each window and sixteen for each line: windows and
    lines are compared by hashes of 64 and 128 bits.
    """
    import xxhash

    n = upper = longest = 0
    for part in slices(text, step):
        words = part.split()
        n += len(words)
        upper += sum(1 for w in words if w.isupper())
        longest = max(longest, max(map(len, words), default=0))
    n_repeat = 0
    if n > 5:
        n_repeat = repeated_places(np.concatenate(list(window_hashes(text, 5, 0, step, lower=False))))
    seen, held, at = [], [], 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if _WORD.search(text, at, end):
            held.append(xxhash.xxh3_128_digest(text[at:end].encode("utf-8", "surrogatepass")))
            if len(held) >= SLICE:
                seen.append(np.frombuffer(b"".join(held), dtype="V16"))
                held = []
        at = end + 1
    lines = np.frombuffer(b"".join([s.tobytes() for s in seen] + held), dtype=np.uint64).reshape(-1, 2)
    lines = lines[np.lexsort((lines[:, 1], lines[:, 0]))] if len(lines) else lines
    n_dup = int((lines[1:] == lines[:-1]).all(axis=1).sum()) if len(lines) else 0
    return n, upper, longest, distinct_words(text, step), n_repeat, len(lines), n_dup


def statistics(text: str | None, long: int = LONG) -> tuple[int, ...]:
    """The values of ``STATS`` and then those of ``FEATURES``. A text of more than ``long`` characters is worked on in slices, with the same result."""
    text = text or ""
    if len(text) > long:
        n, upper, longest, distinct, n_repeat, n_lines, n_dup = _in_slices(text)
    else:
        words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space alone
        lines = [x for x in text.split("\n") if x.strip(WHITE)]
        n, n_lines, n_dup, n_repeat = len(words), len(lines), len(lines) - len(set(lines)), repeated_words(words)
        upper, distinct, longest = sum(1 for w in words if w.isupper()), len(set(words)), max(map(len, words), default=0)
    word_chars = len(text) - sum(map(text.count, WHITE))
    n_symbols = sum(map(text.count, SYMBOLS))
    chars = max(word_chars, 1)
    marks = text.count("!") + text.count("?")
    digits = sum(map(text.count, "0123456789"))
    features = (
        math.log1p(n), word_chars / max(n, 1), n_symbols / chars, n_dup / max(n_lines, 1), n_repeat / max(n, 1),
        upper / max(n, 1), distinct / max(n, 1), marks / chars, digits / chars, n / max(n_lines, 1), math.log1p(longest),
    )
    return n, word_chars, n_symbols, n_dup, n_repeat, *features


def base_failed(n_words, n_repeat):
    return (n_words < 10) | (100 * n_repeat > 20 * n_words)


class BoostedTrees:
    """Binary classifier; ``fit`` grows trees, ``score`` runs over their flattened nodes."""

    def __init__(self, trees: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.2, smooth: float = 5.0, least: int = 10) -> None:
        self.trees, self.depth, self.bins, self.rate, self.smooth, self.least = trees, depth, bins, rate, smooth, least
        self.start = 0.0
        self.roots: list[int] = []
        self._nodes: list[list[float]] = []  # feature (-1: leaf), threshold, left, right, value

    def fit(self, x: np.ndarray, y: np.ndarray, signs: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            gradient, hessian = y - q, q * (1 - q)
            self.roots.append(self._grow(binned, edges, gradient, hessian, signs, np.arange(len(y)), score, -np.inf, np.inf, 0))
        self.flatten()
        return self

    def _value(self, g: float, h: float, low: float, high: float) -> float:
        return min(max(g / (h + self.smooth), low), high)

    def _grow(self, binned, edges, gradient, hessian, signs, rows, score, low, high, depth) -> int:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        at = len(self._nodes)
        value = self._value(g, h, low, high)
        self._nodes.append([-1, 0.0, at, at, self.rate * value])
        best = None
        if depth < self.depth and len(rows) >= 2 * self.least:
            for j, e in enumerate(edges):
                b, k = binned[rows, j], len(e) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (gradient[rows], hessian[rows], None))
                if not k > 1:
                    continue
                left = np.clip(gl / (hl + self.smooth), low, high)
                right = np.clip((g - gl) / (h - hl + self.smooth), low, high)
                # gain of the values that the bounds allow
                gain = gl * left - 0.5 * (hl + self.smooth) * left**2 + (g - gl) * right - 0.5 * (h - hl + self.smooth) * right**2
                ok = (nl >= self.least) & (len(rows) - nl >= self.least) & (signs[j] * (right - left) >= 0)
                if ok.any():
                    i = int(np.argmax(np.where(ok, gain, -np.inf)))
                    if best is None or gain[i] > best[0]:
                        best = (gain[i], j, i, left[i], right[i])
        if best is None or best[0] <= g * value - 0.5 * (h + self.smooth) * value**2 + 1e-6:
            score[rows] += self.rate * value
            return at
        _, j, i, left, right = best
        middle = (left + right) / 2
        goes_left = binned[rows, j] <= i
        bounds = {-1: ((middle, high), (low, middle)), 0: ((low, high), (low, high)), 1: ((low, middle), (middle, high))}[int(signs[j])]
        children = [self._grow(binned, edges, gradient, hessian, signs, r, score, *b, depth + 1) for r, b in zip((rows[goes_left], rows[~goes_left]), bounds, strict=True)]
        self._nodes[at] = [j, float(edges[j][i]), *children, 0.0]
        return at

    def flatten(self) -> None:
        nodes = np.array(self._nodes, dtype=np.float64).reshape(-1, 5)
        self.feature, self.left, self.right = (nodes[:, c].astype(np.int32) for c in (0, 2, 3))
        self.threshold, self.value = nodes[:, 1].copy(), nodes[:, 4].copy()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds for each row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, dtype=np.int32)
            for _ in range(self.depth):
                feature = self.feature[node]
                right = x[rows, feature] > self.threshold[node]
                node = np.where(feature < 0, node, np.where(right, self.right[node], self.left[node]))
            out += self.value[node]
        return out


def _frame(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    n = len(STATS.split(", "))
    flat = np.fromiter(chain.from_iterable(map(statistics, texts)), np.float64).reshape(len(texts), n + len(FEATURES))
    return flat[:, :n].astype(np.int64), flat[:, n:]


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", at_most: int = MAX_LABELLED) -> BoostedTrees | None:
    """Trees fitted on at most ``at_most`` labelled documents; None if there are none of either kind."""
    ship(docs.sparkSession)
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).dropna()
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "y").limit(at_most)  # a bounded table, so it may be broadcast

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_frame(texts)[1]))

    found = docs.select(F.col(id_col).alias("doc"), F.col(text).cast("string").alias("doc_text")).join(F.broadcast(chosen), F.col("doc") == F.col("id"))
    # Texts become statistics first, so only narrow rows are sorted for the limit.
    rows = found.select("id", "y", features("doc_text").alias("x")).orderBy(F.xxhash64("id"), "id", "y", "x").limit(at_most).collect()
    if len({r.y for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r.id, r.y, r.x))
    y = np.array([r.y > 0 for r in rows], dtype=np.float64)
    return BoostedTrees().fit(np.array([r.x for r in rows]), y, np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def verdict(text: Column, model: BoostedTrees | None, threshold: float = THRESHOLD) -> Column:
    """A struct of the statistics, the score, base_failed and kept."""

    @F.pandas_udf(STATS + ", quality_score double, base_failed boolean, kept boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        stats, x = _frame(texts)
        out = pd.DataFrame(stats, columns=[c.split()[0] for c in STATS.split(", ")])
        out["quality_score"] = model.score(x) if model else 0.0
        out["base_failed"] = base_failed(out.n_words, out.n_repeat_words)
        out["kept"] = ~out.base_failed & (out.quality_score >= (threshold if model else 0.0))
        return out

    return judged(text.cast("string"))


def judge_documents(docs: DataFrame, model: BoostedTrees | None, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, statistics, score and verdict for each row."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), verdict(F.col(text), model, threshold).alias("v")).select("doc_id", "v.*")


def keep_good(docs: DataFrame, model: BoostedTrees | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    ship(docs.sparkSession)
    return docs.filter(verdict(F.col(text), model, threshold)["kept"])
