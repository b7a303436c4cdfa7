"""Quality by a sparse rule ensemble.

Shallow boosted trees over statistics of labelled texts give conjunctive rules,
one for each path from a root; a lasso logistic fit picks and weighs them; what
is left is compiled into one Spark column expression over the statistics.

The fit takes a bounded sample of labelled rows (``rows``), in the order of a
hash of their id.  Statistics are of whole texts, from an Arrow function.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.llm.runtime import new_name, prepare

FEATURES = (
    "n_words", "word_length", "upper", "digits", "symbols", "exclaims", "bars", "stops", "spaces", "foreign",
    "distinct_words", "distinct_lines", "line_words", "one_case_words", "plain_ends", "byte_entropy",
)
_kinds = {
    "upper": bytes(range(65, 91)),
    "digits": b"0123456789",
    "symbols": b"#$%&*+/<=>@[\\]^_`{}~",
    "exclaims": b"!",
    "bars": b"|",
    "stops": b".,;:?",
    "spaces": b" \t\n\v\f\r",
    "foreign": bytes(range(128, 256)),
}
_kind_matrix = np.array([[byte in kind for byte in range(256)] for kind in _kinds.values()], dtype=np.float64)


# ---------------------------------------------------------------- statistics


def statistics(text: bytes | None) -> list[float]:
    """The FEATURES of a whole UTF-8 text; all zero without a word."""
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n, w = len(text), len(words)
    p = counts[counts > 0] / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    one_case = sum(map(bytes.isupper, words))
    plain = sum([x[-1] > 127 or 97 <= x[-1] <= 122 for x in words])
    return [
        float(w), (n - w + 1) / w, *(_kind_matrix @ counts / n).tolist(), len(set(words)) / w, len(set(lines)) / len(lines),
        w / len(lines), one_case / w, plain / w, float(-(p * np.log2(p)).sum()),
    ]


def statistics_column(text: Column) -> Column:
    def compute(texts: pa.Array) -> pa.Array:
        table = np.array([statistics(t) for t in texts.to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(FEATURES))], list(FEATURES))

    compute.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(compute, ", ".join(f"{f} double" for f in FEATURES))(text.cast("binary"))


# ---------------------------------------------------------------- fit


@dataclass(frozen=True)
class Rule:
    """All of its conditions: (feature, True for >, threshold)."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return functools.reduce(operator.and_, [(x[:, f] > t) == above for f, above, t in self.conditions])

    def column(self, fields: list[Column]) -> Column:
        return functools.reduce(operator.and_, [fields[f] > t if above else fields[f] <= t for f, above, t in self.conditions])


@dataclass(frozen=True)
class Ensemble:
    base: float
    weights: tuple[float, ...]
    rules: tuple[Rule, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for w, r in zip(self.weights, self.rules, strict=True):
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, fields: list[Column]) -> Column:
        parts = [F.when(r.column(fields), F.lit(w)).otherwise(F.lit(0.0)) for w, r in zip(self.weights, self.rules, strict=True)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-functools.reduce(operator.add, parts, F.lit(self.base))))


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds halfway between quantiles, which no value of the sample equals."""
    out = []
    for column in x.T:
        marks = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        above = np.sort(column)
        following = above[np.minimum(np.searchsorted(above, marks, "right"), len(above) - 1)]
        out.append(np.unique((marks + following) / 2)[: bins - 1])
    return out


def _tree(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, list[Rule]]:
    """Values of one boosted tree over the sample, and the rules of all its nodes but the root."""
    value, rules = np.zeros(len(grad)), []

    def grow(rows: np.ndarray, conditions: tuple, level: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f, marks in enumerate(cuts):
                if not len(marks):
                    continue
                size = len(marks) + 1
                code = binned[rows, f]
                gl = np.cumsum(np.bincount(code, grad[rows], size))[:-1]
                hl = np.cumsum(np.bincount(code, hess[rows], size))[:-1]
                nl = np.cumsum(np.bincount(code, minlength=size))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), (f, at))
        if best[1] is None:
            value[rows] = -g / (h + 1)
            return
        f, at = best[1]
        for above in (False, True):
            path = (*conditions, (f, above, float(cuts[f][at])))
            rules.append(Rule(tuple(sorted(path))))
            grow(rows[(binned[rows, f] > at) == above], path, level + 1)

    grow(np.arange(len(grad)), (), 0)
    return value, rules


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights by accelerated proximal gradient; the constant is free."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack(((x - mean) / spread, np.ones(len(x))))
    step = 4 * len(z) / (np.linalg.norm(z, 2) ** 2)
    w = np.zeros(z.shape[1])
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        new = ahead - step * (z.T @ (1 / (1 + np.exp(-(z @ ahead))) - y)) / len(z)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - w)
        w = new
    return float(w[-1] - (w[:-1] * mean / spread).sum()), w[:-1] / spread


def fit_ensemble(x: np.ndarray, y: np.ndarray, *, trees: int = 20, depth: int = 3, bins: int = 32, rate: float = 0.3, penalty: float = 1e-3) -> Ensemble:
    """Without rows of both labels, a constant."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or len(y) < 20:
        share = min(max(share, 0.01), 0.99)
        return Ensemble(float(np.log(share / (1 - share))), (), ())
    cuts = _cuts(x, bins)
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    margin = np.full(len(y), np.log(share / (1 - share)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        value, found = _tree(binned, cuts, p - y, p * (1 - p), depth, max(5, len(y) // 500))
        margin += rate * value
        rules.update(dict.fromkeys(found))
    matrix, kept, seen = [], [], set()
    for rule in rules:
        column = rule.holds(x)
        key = min(column.tobytes(), (~column).tobytes())
        if key not in seen:
            seen.add(key)
            kept.append(rule)
            matrix.append(column)
    if not kept:
        return Ensemble(float(np.log(share / (1 - share))), (), ())
    base, weights = _lasso(np.column_stack(matrix).astype(np.float64), y.astype(np.float64), penalty)
    live = [i for i, w in enumerate(weights) if abs(w) > 1e-6]
    return Ensemble(base, tuple(float(weights[i]) for i in live), tuple(kept[i] for i in live))


# ---------------------------------------------------------------- Spark


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 20_000, **options) -> Ensemble:
    """From about ``rows`` labelled rows at most; rows with a null label or id are left out."""
    prepare(docs.sparkSession)
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    n = marked.count()
    if not n:
        return fit_ensemble(np.zeros((0, len(FEATURES))), np.zeros(0), **options)
    sample = marked.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 40)) <= min(1 << 40, (rows << 40) // n))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(sample), "id").select("id", "label", statistics_column(F.col("text")).alias("s")).select("id", "label", "s.*")
    table = found.toPandas().sort_values(["id", "label", *FEATURES])
    return fit_ensemble(table[list(FEATURES)].to_numpy(np.float64), table["label"].to_numpy(np.float64), **options)


def score(docs: DataFrame, model: Ensemble, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, cut: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= cut).

    Null counts as empty; an empty text has all statistics zero and gets the
    score of that.  Repeated rows keep a row each.
    """
    prepare(docs.sparkSession)
    stats = new_name("stats")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), statistics_column(F.col(text_col)).alias(stats))
    value = model.column([F.col(f"{stats}.{f}") for f in FEATURES])
    return rows.withColumn("score", value).select("doc_id", "held_out", "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))
