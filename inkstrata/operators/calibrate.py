"""Fitting of the decoder: multinomial calibration, grid search, human prior."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from itertools import product


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as N
from .decode import decode
from .metrics import token_scores

ABSENT = -20.0


@dataclass
class Calibrator:
    """Affine maps of six features to three potentials, class offsets and the chain's two penalties; saved as JSON."""

    intercepts: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    weights: list[list[float]] = field(default_factory=lambda: [[1.0, 0, 0, 0, 0, 0], [0, 1.0, 0, 0, 0, 0], [0, 0, 1.0, 0, 0, 0]])
    deltas: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    smooth: float = 4.0
    gamma: float = 0.5

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=1)

    @classmethod
    def load(cls, path: str) -> Calibrator:
        with open(path, encoding="utf-8") as f:
            return cls(**json.load(f))

    def potentials(self, tokens: DataFrame) -> DataFrame:
        """Adds u0, u1, u2 to tokens with features f0 to f5."""
        columns = N.unary([F.col(f"f{k}") for k in range(6)], self.intercepts, self.weights, self.deltas)
        return tokens.withColumns({f"u{c}": columns[c] for c in range(3)})


def fit_multinomial(tokens: DataFrame, label: str = "label", strength: float = 1.0) -> Calibrator:
    """Multinomial logistic regression of the features; a class without tokens gets a very low intercept."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[f"f{k}" for k in range(6)], outputCol="features").transform(tokens.where(F.col(label).isNotNull())).select("features", F.col(label).cast("int").alias("y"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # three classes
    present = sorted(counts)
    out = Calibrator(intercepts=[ABSENT] * 3, weights=[[0.0] * 6 for _ in range(3)])
    if len(present) < 2:
        for c in present:
            out.intercepts[c] = 0.0
        return out
    index = F.create_map(*[F.lit(x) for i, c in enumerate(present) for x in (c, float(i))])
    model = LogisticRegression(family="multinomial", regParam=1.0 / (strength * sum(counts.values())), standardization=False, maxIter=200, tol=1e-9).fit(rows.select("features", index[F.col("y")].alias("label")))
    for i, c in enumerate(present):
        out.intercepts[c] = float(model.interceptVector[i])
        out.weights[c] = [float(model.coefficientMatrix[i, k]) for k in range(6)]
    return out


def grid_search(tokens: DataFrame, doc: str, label: str, calibrator: Calibrator, smooths: tuple[float, ...] = (0.0, 1.0, 2.0, 4.0, 6.0, 8.0, 12.0), gammas: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0)) -> Calibrator:
    """The pair of penalties of the best token macro F1, the first on ties."""
    base, best = calibrator.potentials(tokens), None
    for s, g in product(smooths, gammas):
        found = decode(base, doc, s, g, least=1).select(doc, "pos", F.col("label").alias("predicted"))
        score = round(token_scores(tokens.select(doc, "pos", label).join(found, [doc, "pos"]), label, "predicted").first()["macro_f1"] or 0.0, 9)
        if best is None or score > best[0]:
            best = (score, s, g)
    return Calibrator(calibrator.intercepts, calibrator.weights, calibrator.deltas, best[1], best[2])


def human_prior(tokens: DataFrame, doc: str, human: str, calibrator: Calibrator, target: float = 0.005, values: int = 33, top: float = 8.0) -> Calibrator:
    """The offset of the human class: of those at or below the target of human documents taken for others, the one that keeps most other documents; else the one with fewest such errors.

    ``human`` is a boolean column of the document. Verdicts come from token labels, a document being
    human where at least 0.9 of its tokens are.
    """
    best = None
    for k in range(values):
        delta = top * k / (values - 1)
        trial = Calibrator(calibrator.intercepts, calibrator.weights, [calibrator.deltas[0] + delta, *calibrator.deltas[1:]], calibrator.smooth, calibrator.gamma)
        labels = decode(trial.potentials(tokens), doc, trial.smooth, trial.gamma)
        verdicts = labels.groupBy(doc).agg((F.avg((F.col("merged") == 0).cast("double")) >= 0.9).alias("says_human")).join(tokens.select(doc, human).distinct(), doc)
        r = verdicts.agg((F.count_if(F.col(human) & ~F.col("says_human")) / F.greatest(F.count_if(human), F.lit(1))).alias("fpr"), (F.count_if(~F.col(human) & F.col("says_human")) / F.greatest(F.count_if(~F.col(human)), F.lit(1))).alias("fnr")).first()
        rank = (0, r.fnr, r.fpr, delta) if r.fpr <= target else (1, r.fpr, r.fnr, delta)
        if best is None or rank < best[0]:
            best = (rank, trial)
    return best[1]
