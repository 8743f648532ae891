"""Per-row feature attributions of a score and their narratives."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions import derive
from ledgerlens.session import scratch

TOP = 5
#: Comparisons up to which the values of a group of leaves are tabulated by outcome.
TABLE_CUTS = 10
ATTRIBUTION = "struct<feature:string,contribution:double,feature_value:double>"


def linear_attributions(
    scaled: DataFrame, model: PipelineModel, features: Sequence[str],
    means: dict[str, float] | None = None,
) -> DataFrame:
    """Exact log-odds attributions ``w * (x - mean)`` of a linear model; on the
    scaled view every training mean is zero. Adds ``attributions``."""
    weights = model.stages[-1].coefficients.toArray().tolist()
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            (F.lit(w) * (F.col(name) - F.lit((means or {}).get(name, 0.0)))).alias("contribution"),
            F.col(name).cast("double").alias("feature_value"),
        )
        for name, w in zip(features, weights)
    ]
    return scaled.withColumn("attributions", F.array(*entries))


def tree_nodes(spark: SparkSession, model: PipelineModel) -> tuple[pd.DataFrame, list[float]]:
    """The ensemble's nodes as one table, bounded by trees * 2^(depth + 1).

    Read from the model's own saved node table, whose impurity statistics give the
    training weight that reached each node.
    """
    trees = model.stages[-1]
    path = scratch(spark, "trees")
    trees.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    flat = nodes.select(
        F.col("treeID").alias("tree"), "id", "prediction", "impurityStats",
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", 0).alias("cut"),
    )
    return flat.orderBy("tree", "id").toPandas(), list(trees.treeWeights)


def _leaf_paths(nodes: pd.DataFrame, weights: Sequence[float], kind: str) -> list[tuple]:
    """Per leaf: its value and, per feature on its path, the value interval that
    stays on the path and the share of training weight that does."""
    paths = []
    for tree, table in nodes.groupby("tree"):
        rows = {r.id: r for r in table.itertuples(index=False)}

        def cover(row) -> float:
            stats = list(row.impurityStats)
            # Variance statistics start with the weight; class statistics sum to it.
            return float(stats[0] if kind == "regression" else sum(stats))

        def value(row) -> float:
            if kind == "regression":
                return float(row.prediction)
            stats = list(row.impurityStats)
            return float(stats[1] / sum(stats))

        stack = [(rows[0], {})]
        while stack:
            node, path = stack.pop()
            if node.left < 0:
                paths.append((weights[tree] * value(node),
                              [(f, lo, hi, z) for f, (lo, hi, z) in path.items()]))
                continue
            for child, below in ((rows[node.left], True), (rows[node.right], False)):
                lo, hi, z = path.get(node.feature, (-np.inf, np.inf, 1.0))
                share = cover(child) / cover(node)
                bounds = (lo, min(hi, node.cut)) if below else (max(lo, node.cut), hi)
                stack.append((child, {**path, node.feature: (*bounds, z * share)}))
    return paths


def _game(on: np.ndarray, shares: Sequence[float]) -> np.ndarray:
    """Shapley values, per unit of leaf value, of rows of 0/1 presences in one leaf.

    In a leaf's game a present feature contributes 1 or 0 (row on the path or
    not), an absent one its training share. With d features, the coalitions of
    each size are the coefficients of prod(share + present * t); dividing one
    factor out is avoided by multiplying the others.
    """
    d = len(shares)
    order = np.cumprod([1.0, *[k / (d - k) for k in range(1, d)]]) / d
    out = np.empty_like(on)
    for j in range(d):
        poly = [np.ones(len(on))]
        for k in range(d):
            if k == j:
                continue
            grown = [c * shares[k] for c in poly] + [np.zeros(len(on))]
            for size, c in enumerate(poly):
                grown[size + 1] = grown[size + 1] + c * on[:, k]
            poly = grown
        out[:, j] = (on[:, j] - shares[j]) * sum(w * c for w, c in zip(order, poly))
    return out


def _cuts(path: list[tuple]) -> set[tuple]:
    """The comparisons ``value > cut``, by feature, that decide a leaf's conditions."""
    return {(f, cut) for f, lo, hi, _ in path for cut in (lo, hi) if np.isfinite(cut)}


def _presences(path: list[tuple], above: dict[tuple, np.ndarray]) -> np.ndarray:
    """Which of a leaf's conditions are met, from the comparisons' outcomes."""
    met = []
    for f, lo, hi, _ in path:
        on = np.ones(len(next(iter(above.values()))), bool)
        if np.isfinite(lo):
            on = on & above[f, lo]
        if np.isfinite(hi):
            on = on & ~above[f, hi]
        met.append(on)
    return np.stack(met, axis=1).astype(float)


def _tables(paths: list[tuple]) -> list[tuple]:
    """Leaves in groups of neighbours that few comparisons decide: (cuts, features, table).
    The table has the sum of the leaves' values of each feature for every outcome of the
    cuts. A leaf with too many cuts has (cuts, its path, nothing)."""
    groups: list[tuple[set, list]] = []
    for leaf in paths:
        cuts = _cuts(leaf[1])
        if groups and len(groups[-1][0] | cuts) <= TABLE_CUTS:
            groups[-1][0].update(cuts)
            groups[-1][1].append(leaf)
        elif cuts:
            groups.append((set(cuts), [leaf]))
    tables = []
    for cuts, leaves in groups:
        order = sorted(cuts)
        if len(order) > TABLE_CUTS:
            tables.append((order, leaves[0], None))
            continue
        outcomes = np.arange(1 << len(order))
        above = {c: (outcomes >> k & 1).astype(bool) for k, c in enumerate(order)}
        found = sorted({p[0] for _, path in leaves for p in path})
        table = np.zeros((len(found), len(outcomes)))
        for leaf_value, path in leaves:
            if path:
                values = leaf_value * _game(_presences(path, above), [p[3] for p in path])
                for j, p in enumerate(path):
                    table[found.index(p[0])] += values[:, j]
        tables.append((order, found, table))
    return tables


def _base(paths: list[tuple]) -> float:
    """The ensemble's mean value over its training weight."""
    base = 0.0
    for leaf_value, path in paths:
        base += leaf_value * float(np.prod([p[3] for p in path])) if path else leaf_value
    return base


def _shapley(matrix: np.ndarray, paths: list[tuple]) -> tuple[np.ndarray, float]:
    return _looked_up(matrix, _tables(paths)), _base(paths)


def _looked_up(matrix: np.ndarray, tables: list[tuple]) -> np.ndarray:
    """Path-dependent Shapley values of all rows. A row's values in a group of leaves depend
    only on the outcomes of its comparisons, so they are looked up."""
    phi = np.zeros((matrix.shape[1], len(matrix)))
    columns = np.ascontiguousarray(matrix.T)
    for cuts, features, table in tables:
        if table is None:
            leaf_value, path = features
            on = _presences(path, {(f, cut): columns[f] > cut for f, cut in cuts})
            values = leaf_value * _game(on, [p[3] for p in path])
            for j, p in enumerate(path):
                phi[p[0]] += values[:, j]
            continue
        outcome = np.zeros(len(matrix), np.uint16)
        for k, (f, cut) in enumerate(cuts):
            outcome |= np.left_shift((columns[f] > cut).view(np.uint8), k, dtype=np.uint16)
        places = outcome.astype(np.intp)
        for feature, values in zip(features, table):
            phi[feature] += values.take(places, mode="clip")
    return np.ascontiguousarray(phi.T)


def tree_attributions(
    unscaled: DataFrame, model: PipelineModel, features: Sequence[str], *,
    keep: Sequence[str] = (S.LOAN_ID,),
) -> DataFrame:
    """Path-dependent tree Shapley values of each row's log-odds (boosted trees) or
    mean class-1 probability (forest, a share from 0 to 1): ``keep`` columns, ``base_value`` and
    ``attributions`` in feature order. Tables bounded by the model's leaves are all that is
    shipped to tasks; rows stream through in Arrow batches."""
    spark = unscaled.sparkSession
    kind = "regression" if type(model.stages[-1]).__name__.startswith("GBT") else "gini"
    nodes, weights = tree_nodes(spark, model)
    if kind == "regression":  # the library's margin is half the log-odds
        weights = [2.0 * w for w in weights]
    else:  # a forest averages its trees
        weights = [1.0 / len(weights)] * len(weights)
    paths = _leaf_paths(nodes, weights, kind)
    # Tables of hundreds of trees take seconds: they are made once, not in every task.
    shipped, base = spark.sparkContext.broadcast(_tables(paths)), _base(paths)
    names, kept = list(features), list(keep)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrix = batch[names].to_numpy(dtype=float)
            phi = _looked_up(matrix, shipped.value)
            out = batch[kept].copy()
            out["base_value"] = base
            out["contributions"] = list(phi)
            out["feature_values"] = list(matrix)
            yield out

    kinds = ", ".join(f"`{c}` {unscaled.schema[c].dataType.simpleString()}" for c in kept)
    explained = unscaled.select(*kept, *[F.col(c).cast("double").alias(c) for c in names]) \
        .mapInPandas(
            explain,
            f"{kinds}, base_value double, contributions array<double>, "
            "feature_values array<double>",
        )
    labels = F.array(*[F.lit(n) for n in names])
    zipped = F.arrays_zip(
        labels.alias("feature"), F.col("contributions").alias("contribution"),
        F.col("feature_values").alias("feature_value"),
    )
    return explained.select(*kept, "base_value", zipped.cast(f"array<{ATTRIBUTION}>")
                            .alias("attributions"))


def top_attributions(attributions: Column | str = "attributions", top: int = TOP) -> Column:
    """The ``top`` entries by absolute contribution; ties go to the later feature."""
    column = F.col(attributions) if isinstance(attributions, str) else attributions
    placed = F.transform(column, lambda e, i: F.struct(
        F.abs(e["contribution"]).alias("size"), i.alias("position"), e.alias("entry")))
    ordered = F.sort_array(placed, asc=False)
    return F.slice(F.transform(ordered, lambda e: e["entry"]), 1, max(1, top))


def narrate(df: DataFrame, attributions: str = "attributions") -> DataFrame:
    """Add ``top_features`` (with display name and direction) and ``narrative``."""
    named = F.transform(top_attributions(attributions), lambda e: F.struct(
        e["feature"].alias("feature"),
        derive.display_name(e["feature"]).alias("display_name"),
        e["contribution"].alias("contribution"),
        F.when(e["contribution"] >= 0, "risk_increasing").otherwise("risk_reducing")
        .alias("direction"),
        e["feature_value"].alias("feature_value"),
    ))
    return df.withColumn("top_features", named).withColumn(
        "narrative", narrative(F.col("top_features"))
    )


def narrative(top_features: Column) -> Column:
    def listed(direction: str) -> Column:
        return F.transform(
            F.filter(top_features, lambda e: e["direction"] == direction),
            lambda e: e["display_name"],
        )

    raising, lowering = listed("risk_increasing"), listed("risk_reducing")
    return (
        F.when(F.size(raising) > 0, F.concat(
            F.lit("Elevated risk is driven primarily by "),
            F.array_join(raising, ", "), F.lit(".")))
        .when(F.size(lowering) > 0, F.concat(
            F.lit("The score is reduced primarily by "),
            F.array_join(lowering, ", "), F.lit(".")))
        .otherwise(F.lit("No individual feature materially changed this model score."))
    )


def mask_explanation(
    df: DataFrame, arm: Column | str, available: str = "explanation_available",
    text: str = "narrative", top_features: str = "top_features",
) -> DataFrame:
    """Withhold explanations from the score-only arm."""
    arm_column = F.col(arm) if isinstance(arm, str) else arm
    withheld = F.coalesce(arm_column == S.ARM_SCORE_ONLY, F.lit(False))
    masked = df.withColumn(available, F.when(withheld, F.lit(False)).otherwise(F.col(available)))
    masked = masked.withColumn(
        text, F.when(withheld, F.lit(S.WITHHELD_NARRATIVE)).otherwise(F.col(text))
    )
    if top_features in df.columns:
        kind = df.schema[top_features].dataType
        masked = masked.withColumn(
            top_features,
            F.when(withheld, F.array().cast(kind)).otherwise(F.col(top_features)),
        )
    return masked
