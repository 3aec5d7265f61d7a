"""Tree ensembles read from saved text files and scored over columns, without the library that trained them.

A file lists trees as blocks of ``key=values`` lines: per inner node the feature, threshold, decision and children, per leaf
the value; a child below zero is leaf -child - 1. A decision's bits say whether the node is categorical (1), where missing values go (2: left) and
what counts as missing (bits 2 and 3: nothing, zero, NaN). All trees' nodes lie in flat arrays; a batch of rows steps down all
trees at once, level by level.

Rules at a node: a NaN counts as zero where NaN isn't what is missing; a missing value goes the default way; else a value at most
the threshold goes left. At a categorical node a whole number, zero or more, that the node's bit set has goes left, everything else right. The sum of the
leaves is the raw score; files of averaged trees divide it; a logistic objective may squash it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Below this a number counts as zero.
ZERO = 1e-35
CATEGORICAL, DEFAULT_LEFT = 1, 2


@dataclass(frozen=True)
class TreeModel:
    """Flat arrays over the nodes of all trees; a child below zero is a leaf: its complement is a place in ``value``."""

    features: tuple[str, ...]
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    decision: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    set_of: np.ndarray
    set_start: np.ndarray
    set_bits: np.ndarray
    averaged: bool = False
    sigmoid: float | None = None

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Raw scores of rows (n, features)."""
        rows = np.asarray(rows, dtype=np.float64)
        n = len(rows)
        total = np.zeros(n)
        for root in self.roots:
            at = np.full(n, root, dtype=np.int64)
            live = np.flatnonzero(at >= 0)
            while len(live):
                node = at[live]
                at[live] = np.where(self._goes_left(node, rows[live, self.feature[node]]), self.left[node], self.right[node])
                live = live[at[live] >= 0]
            total += self.value[~at]
        return total / len(self.roots) if self.averaged and len(self.roots) else total

    def predict(self, rows: np.ndarray) -> np.ndarray:
        out = self.raw(rows)
        return out if self.sigmoid is None else 1.0 / (1.0 + np.exp(-self.sigmoid * out))

    def _goes_left(self, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        decision = self.decision[node]
        kind = decision >> 2 & 3
        nan = np.isnan(x)
        filled = np.where(nan & (kind != 2), 0.0, x)
        missing = (kind == 1) & (np.abs(filled) <= ZERO) | (kind == 2) & nan
        with np.errstate(invalid="ignore"):
            left = np.where(missing, (decision & DEFAULT_LEFT) > 0, filled <= self.threshold[node])
        categorical = (decision & CATEGORICAL) > 0
        if categorical.any():
            which = np.flatnonzero(categorical)
            left[which] = self._in_set(node[which], x[which])
        return left

    def _in_set(self, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        whole = np.where(np.isfinite(x) & (x > -1) & (x < 2**31), x, -1).astype(np.int64)
        first, end = self.set_start[self.set_of[node]], self.set_start[self.set_of[node] + 1]
        word = first + (whole >> 5)
        inside = (x > -1) & (whole >= 0) & (word < end)
        bits = self.set_bits[np.where(inside, word, 0)] if len(self.set_bits) else np.zeros(len(x), dtype=np.int64)
        return inside & ((bits >> (whole & 31) & 1) == 1)


def _blocks(text: str) -> list[dict[str, str]]:
    """The header, then each tree, as keys and values; what follows the trees is left out."""
    blocks: list[dict[str, str]] = [{}]
    for line in text.splitlines():
        line = line.strip()
        if line == "end of trees":
            break
        key, is_, value = line.partition("=")
        if is_ and key == "Tree":
            blocks.append({})
        elif is_:
            blocks[-1][key] = value
        elif line:
            blocks[-1][line] = ""
    return blocks


def parse_model(text: str) -> TreeModel:
    """A model from the text of its file; a file that isn't one raises ``ValueError``."""
    header, *trees = _blocks(text)
    if not trees or "feature_names" not in header:
        raise ValueError("no saved tree ensemble: feature names or trees are missing")
    if int(header.get("num_tree_per_iteration", header.get("num_class", "1"))) != 1:
        raise ValueError("models of several classes have no one score")
    ints = lambda t, k: [int(float(x)) for x in t.get(k, "").split()]
    floats = lambda t, k: [float(x) for x in t.get(k, "").split()]
    parts: dict[str, list] = {k: [] for k in ("roots", "feature", "threshold", "decision", "left", "right", "value", "set_of", "set_bits")}
    starts = [0]
    for t in trees:
        if t.get("is_linear", "0") == "1":
            raise ValueError("trees with linear leaves aren't supported")
        inner, leaf = len(parts["feature"]), len(parts["value"])
        feature, decision, threshold = ints(t, "split_feature"), ints(t, "decision_type"), floats(t, "threshold")
        place = lambda c: c + inner if c >= 0 else ~(leaf + ~c)  # noqa: E731,B023
        parts["roots"].append(inner if feature else ~leaf)
        parts["feature"] += feature
        parts["decision"] += decision
        parts["threshold"] += threshold
        parts["left"] += [place(c) for c in ints(t, "left_child")]
        parts["right"] += [place(c) for c in ints(t, "right_child")]
        parts["value"] += floats(t, "leaf_value")
        ends, words, base = ints(t, "cat_boundaries"), ints(t, "cat_threshold"), len(starts) - 1
        parts["set_of"] += [base + int(x) if d & CATEGORICAL else 0 for x, d in zip(threshold, decision, strict=True)]
        starts += [len(parts["set_bits"]) + e for e in ends[1:]]
        parts["set_bits"] += words
        if not len(feature) == len(decision) == len(threshold) == len(ints(t, "left_child")) == len(ints(t, "right_child")) or len(floats(t, "leaf_value")) != len(feature) + 1:
            raise ValueError("a tree's lists are of different lengths")
    whole = ("roots", "feature", "decision", "left", "right", "set_of", "set_bits")
    arrays = {k: np.array(v, dtype=np.int64 if k in whole else np.float64) for k, v in parts.items()}
    objective = header.get("objective", "").split()
    slope = next((float(x.partition(":")[2]) for x in objective if x.startswith("sigmoid:")), 1.0)
    return TreeModel(
        tuple(header["feature_names"].split()), set_start=np.array(starts, dtype=np.int64), averaged="average_output" in header,
        sigmoid=slope if objective[:1] == ["binary"] else None, **arrays,
    )


def read_model(spark, path: str) -> TreeModel:
    """A model from a file that Spark can read. A model is a file of some MB, which the driver parses and ships with the function."""
    return parse_model(spark.read.format("binaryFile").load(path).select("content").first()[0].decode())


def predictor(model: TreeModel):
    """A function of a pandas frame with the model's features as columns, for ``pool.model_score``."""

    def predict(columns):
        return model.predict(columns[list(model.features)].to_numpy(dtype=np.float64))

    return predict


def as_sql(model: TreeModel) -> str:
    """The raw score as a SQL expression of nested CASEs; for small models without categorical nodes, where another engine checks."""

    def node(at: int) -> str:
        if at < 0:
            return repr(float(model.value[~at]))
        x, d = model.features[model.feature[at]], int(model.decision[at])
        if d & CATEGORICAL:
            raise ValueError("categorical nodes have no such expression")
        kind = d >> 2 & 3
        filled = x if kind == 2 else f"coalesce({x}, 0)"
        missing = {0: "FALSE", 1: f"abs({filled}) <= {ZERO!r}", 2: f"{x} IS NULL"}[kind]
        default = model.left[at] if d & DEFAULT_LEFT else model.right[at]
        return f"CASE WHEN {missing} THEN {node(default)} WHEN {filled} <= {float(model.threshold[at])!r} THEN {node(model.left[at])} ELSE {node(model.right[at])} END"

    total = " + ".join(f"({node(int(r))})::DOUBLE" for r in model.roots)
    return f"({total}) / {len(model.roots)}" if model.averaged else total
