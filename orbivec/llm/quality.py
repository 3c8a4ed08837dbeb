"""Quality classifier as a sparse rule ensemble.

Statistics of each text are column expressions. On a sample of labelled rows, small boosted trees are grown; every path
of theirs is a conjunctive rule; lasso logistic regression gives most rules no weight. What is left is compiled into one
column expression, so scoring is a projection.

The sample holds at most ``SAMPLE`` labelled rows, those of the smallest hash of their id, so it does not depend on the
layout; its rows and their statistics are all that reaches the driver.

Defined cases: null and empty texts have all statistics 0 and are scored. Labels that are null take no part; an id with
several labels counts with each different one, an id with several documents with each. With no labels of the training
part every score is 0.5; with one class only, the scores are that class's share of the sample, smoothed by one row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbivec.llm.registry import query, table
from orbivec.llm.texts import col, lower_ascii, text_of

#: Labelled rows that are used for training, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 40, 3, 32, 0.3, 5
PENALTY, STEPS = 0.002, 400

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, bound) each


def statistics(text: Column) -> dict[str, Column]:
    """Statistics by name, each 0 for an empty text."""
    n = F.length(text)
    lines, words = F.split(text, "\n", -1), F.split(lower_ascii(text), "[ \n]+", -1)

    def share(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(n, F.lit(1))

    def of(character: str) -> Column:
        return (n - F.length(F.replace(text, F.lit(character), F.lit("")))) / F.greatest(n, F.lit(1))

    made = {
        "length": F.log1p(n),
        "capitals": share("[A-Z]+"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:'\"-]+"),
        "digits": share("[0-9]+"),
        "spaces": of(" "),
        "line_ends": of("\n"),
        "commas": of(","),
        "stops": of("."),
        "bars": of("|"),
        "exclamations": of("!"),
        "repeated_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "repeated_signs": share(r"([^\p{L}\p{N}\s])\1+"),
    }
    return {name: F.when(n > 0, c).otherwise(F.lit(0.0)).cast("double") for name, c in made.items()}


def _grow(x: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: dict[Rule, None]) -> np.ndarray | float:
    """One regression tree by histograms of binned statistics; notes the path to every node. Gives each row's leaf value."""
    value = np.zeros(len(gradient))
    value[rows] = gradient[rows].sum() / (weight[rows].sum() + 1)
    if path:
        rules[tuple(sorted(path))] = None
    if depth == 0 or len(rows) < 2 * LEAST:
        return value
    total_g, total_w = gradient[rows].sum(), weight[rows].sum()
    best = (1e-9, None, None)
    for f in range(x.shape[1]):
        b = x[rows, f]
        g, w, c = (np.bincount(b, v, BINS).cumsum()[:-1] for v in (gradient[rows], weight[rows], np.ones(len(rows))))
        gain = g * g / (w + 1) + (total_g - g) ** 2 / (total_w - w + 1) - total_g * total_g / (total_w + 1)
        gain[(c < LEAST) | (len(rows) - c < LEAST)] = -1
        at = int(gain[:len(edges[f])].argmax()) if len(edges[f]) else 0
        if len(edges[f]) and gain[at] > best[0]:
            best = (gain[at], f, at)
    if best[1] is None:
        return value
    _, f, at = best
    above = x[rows, f] > at
    bound = float(edges[f][at])
    for side in (False, True):
        part = rows[above == side]
        value[part] = _grow(x, edges, gradient, weight, part, depth - 1, (*path, (f, side, bound)), rules)[part]
    return value


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees for log-loss."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1], method="nearest")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score, rules = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        score += RATE * _grow(binned, edges, y - p, p * (1 - p), np.arange(len(y)), DEPTH, (), rules)
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > bound) == above for f, above, bound in rule])


def lasso(m: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights of L1-penalised logistic regression, by accelerated proximal gradient."""
    mean, spread = m.mean(0), np.maximum(m.std(0), 1e-3)
    z = (m - mean) / spread
    step = 4 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    b, w = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.zeros(z.shape[1])
    vb, vw, t = b, w, 1.0
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(vb + z @ vw))) - y
        nb, nw = vb - step * r.mean(), vw - step * (z.T @ r) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * PENALTY, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return b - float((w * mean / spread).sum()), w / spread


class RuleEnsemble:
    """A trained model: intercept, and weighted rules over named statistics."""

    def __init__(self, names: list[str], intercept: float, rules: list[tuple[float, Rule]]):
        self.names, self.intercept, self.rules = names, intercept, rules

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for weight, rule in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))

    def column(self, of=F.col) -> Column:
        """The score as an expression over the statistics that ``of`` gives by name."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            fits = None
            for f, above, bound in rule:
                one = of(self.names[f]) > bound if above else of(self.names[f]) <= bound
                fits = one if fits is None else fits & one
            total = total + F.when(fits, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(names: list[str], x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    if not len(y):
        return RuleEnsemble(names, 0.0, [])
    if y.min() == y.max():
        return RuleEnsemble(names, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [])
    rules = extract_rules(x, y)
    intercept, weights = lasso(np.stack([holds(r, x) for r in rules], axis=1).astype(float), y)
    return RuleEnsemble(names, intercept, [(float(w), r) for w, r in zip(weights, rules, strict=True) if w])


def training_part(doc_id: Column) -> Column:
    """Ids whose labels may be learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> RuleEnsemble:
    usable = labels.where(training_part(col(doc_id)) & col(label).isNotNull()).select(col(doc_id).alias("id"), (col(label) > 0).cast("double").alias("y")).distinct()
    # Few more labels than wanted when every id has both; the limit is on labels, so the broadcast is bounded by it.
    chosen = usable.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    stats = statistics(F.col("text"))
    rows = docs.select(col(doc_id).alias("id"), text_of(text).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.select("id", "y", *[c.alias(n) for n, c in stats.items()]).orderBy(F.xxhash64("id"), "id", "y", *stats).limit(sample).toPandas()
    return fit(list(stats), rows[list(stats)].to_numpy(float), rows["y"].to_numpy(float))


def scored(docs: DataFrame, model: RuleEnsemble, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: ``doc`` (its columns, or those of ``keep``) and ``score``, 0 to 1."""
    row = F.struct(*[col(c) for c in (docs.columns if keep is None else keep)])
    rows = docs.select(row.alias("doc"), text_of(text).alias("text"))
    return rows.select("doc", *[c.alias(n) for n, c in statistics(F.col("text")).items()]).select("doc", model.column().alias("score"))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, all columns as they were."""
    model = train(docs, labels, doc_id=doc_id, text=text)
    # An array of one: as plain columns, the optimizer would put each statistic into the filter once per rule.
    made = F.array(F.struct(*[c.alias(n) for n, c in statistics(text_of(text)).items()]))
    return docs.where(F.transform(made, lambda s: model.column(s.getField))[0] >= 0.5)


@query("op8_quality")
def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    made = scored(docs, model, keep=["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc.doc_id").cast("string")) % 3 == 1, F.lit(False))
    return made.select("doc.doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
