"""One-to-one matching of predictions with targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def greedy(preds: DataFrame, targets: DataFrame, pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """preds(page_id, pred), targets(page_id, target), pairs(page_id, pred, target, iou): counts
    (page_id, tp, fp, fn). In order of the predictions, each takes the best target still free
    (first on a tie) if their IoU is `least` or more; otherwise it takes none.

    The order makes this a fold: a page's pairs of enough IoU, in order of prediction, are folded
    into the list of taken targets. A pair below `least` can't change the outcome: a prediction's
    best free target is above it if any is."""
    good = pairs.where(F.col("iou") >= least)
    options = good.groupBy("page_id", "pred").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("k"), "target"))).alias("options"))
    lists = options.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pred", "options"))).alias("preds"))

    def step(taken, p):
        free = F.filter(p["options"], lambda o: ~F.array_contains(taken, o["target"]))
        return F.when(F.size(free) > 0, F.concat(taken, F.array(F.get(free, F.lit(0))["target"]))).otherwise(taken)

    types = {f.name: f.dataType.simpleString() for f in pairs.schema}
    matched = lists.select("page_id", F.size(F.aggregate("preds", F.array().cast(f"array<{types['target']}>"), step)).cast("bigint").alias("tp"))
    n = preds.groupBy("page_id").agg(F.count("*").alias("p")).join(targets.groupBy("page_id").agg(F.count("*").alias("t")), "page_id", "full").join(matched, "page_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return n.select("page_id", zero("tp").alias("tp"), (zero("p") - zero("tp")).alias("fp"), (zero("t") - zero("tp")).alias("fn"))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one pairs of least total cost: shortest augmenting paths with potentials."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            free = np.flatnonzero(~used)
            slack = c[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            nearer = slack < least[free]
            least[free[nearer]], back[free[nearer]] = slack[nearer], j0
            j1 = free[np.argmin(least[free])]
            d = least[j1]
            u[owner[used]] += d
            v[used] -= d
            least[free] -= d
            j0 = j1
        while j0:
            owner[j0] = owner[back[j0]]
            j0 = back[j0]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def optimal(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """pairs(page_id, pred, target, iou): the one-to-one pairs of greatest total IoU, without
    those at or below `least`. A page's overlapping pairs meet in one task."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        p, q = sorted(set(page["pred"])), sorted(set(page["target"]))
        grid = np.zeros((len(p), len(q)))
        grid[np.searchsorted(p, page["pred"]), np.searchsorted(q, page["target"])] = page["iou"]
        rows = [(page["page_id"].iloc[0], p[i], q[j], grid[i, j]) for i, j in assignment(1 - grid) if grid[i, j] > least]
        return pd.DataFrame(rows, columns=["page_id", "pred", "target", "iou"])

    typed = pairs.select(F.col("page_id").cast("bigint"), F.col("pred").cast("bigint"), F.col("target").cast("bigint"), F.col("iou").cast("double"))
    return typed.groupBy("page_id").applyInPandas(run, "page_id bigint, pred bigint, target bigint, iou double")


def best_target(pairs: DataFrame, score: str = "iou") -> DataFrame:
    """Each prediction with the target of greatest score, the first on a tie."""
    best = F.max_by(F.struct("target", score), F.struct(F.col(score), -F.col("target"))).alias("b")
    return pairs.where(F.col(score) > 0).groupBy("page_id", "pred").agg(best).select("page_id", "pred", "b.target", f"b.{score}")


def class_overlaps(cells: DataFrame) -> DataFrame:
    """cells(page_id, pred, target), 0 for none: IoU of every pair of classes that share a cell."""
    n = cells.groupBy("page_id", "pred", "target").agg(F.count("*").alias("n"))
    p, t = F.sum("n").over(Window.partitionBy("page_id", "pred")), F.sum("n").over(Window.partitionBy("page_id", "target"))
    sized = n.withColumns({"p": p, "t": t}).where("pred > 0 and target > 0")
    return sized.select("page_id", "pred", "target", (F.col("n") / (F.col("p") + F.col("t") - F.col("n"))).alias("iou"))


def top_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k best pairs of each page."""
    order = Window.partitionBy("page_id").orderBy(F.desc("iou"), "pred", "target")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
