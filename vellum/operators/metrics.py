"""Quality and runtime figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.numeric import hmean, ratio
from vellum.operators.components import nearest_of


def micro(counts: DataFrame, *keys: str) -> DataFrame:
    """counts(tp, fp, fn): sums first, then precision, recall and their harmonic mean."""
    summed = counts.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return summed.withColumns({"precision": p, "recall": r}).withColumn("hmean", hmean(F.col("precision"), F.col("recall")))


def confusion(pairs: DataFrame, pred: str, target: str) -> DataFrame:
    return pairs.groupBy(F.col(pred).alias("pred"), F.col(target).alias("target")).agg(F.count("*").alias("n"))


def per_class(table: DataFrame) -> DataFrame:
    """table(pred, target, n): counts, precision, recall, F1 and IoU of every class on either
    side; IoU is 1 where nothing is predicted or wanted."""
    sides = table.select(F.explode(F.array(F.struct(F.col("pred").alias("class"), F.lit(0).alias("side")), F.struct(F.col("target").alias("class"), F.lit(1).alias("side")))).alias("s"), "pred", "target", "n")
    hit = F.when((F.col("pred") == F.col("target")) & (F.col("s.side") == 0), F.col("n")).otherwise(0)
    got = F.when(F.col("s.side") == 0, F.col("n")).otherwise(0)
    want = F.when(F.col("s.side") == 1, F.col("n")).otherwise(0)
    counts = sides.groupBy(F.col("s.class").alias("class")).agg(F.sum(hit).alias("tp"), (F.sum(got) - F.sum(hit)).alias("fp"), (F.sum(want) - F.sum(hit)).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    union = F.col("tp") + F.col("fp") + F.col("fn")
    return counts.withColumns({"precision": p, "recall": r, "iou": F.when(union == 0, 1.0).otherwise(F.col("tp") / union)}).withColumn("f1", hmean(F.col("precision"), F.col("recall")))


def cross_entropy(table: DataFrame) -> DataFrame:
    """table(pred, target, n): mean penalty, -ln 0.999 for a hit, else by the number of classes."""
    top = F.max(F.greatest("pred", "target"))
    sums = table.agg(top.alias("k"), F.sum(F.when(F.col("pred") == F.col("target"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("n"))
    miss = -F.log(F.greatest(F.lit(1e-9), F.lit(0.001) / F.greatest(F.lit(1), F.col("k"))))
    return sums.select(((F.col("hit") * -F.log(F.lit(0.999)) + (F.col("n") - F.col("hit")) * miss) / F.col("n")).alias("cross_entropy"))


def mask_overlap(cells: DataFrame, a: Column, b: Column, *keys: str, empty: float = 1.0) -> DataFrame:
    """IoU and Dice of two masks over cells; `empty` where neither has any."""
    n = lambda c: F.count_if(c)
    sums = cells.groupBy(*keys).agg(n(a & b).alias("inter"), n(a | b).alias("union"), n(a).alias("a"), n(b).alias("b"))
    iou = F.when(F.col("union") == 0, empty).otherwise(F.col("inter") / F.col("union"))
    dice = F.when(F.col("a") + F.col("b") == 0, empty).otherwise(2 * F.col("inter") / (F.col("a") + F.col("b")))
    return sums.select(*keys, "inter", "union", iou.alias("iou"), dice.alias("dice"))


def best_shift(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """a, b(page_id, y, x): the shift of a within +-most that overlaps b most, first in the order
    of dy, dx. A row of a page is one array; rows meet where their distance is within `most`, and
    their columns likewise, so cells far apart never meet."""
    rows = lambda d, y, xs: d.groupBy("page_id", F.col("y").alias(y)).agg(F.collect_list("x").alias(xs))
    shifted = rows(a, "ay", "axs").withColumn("dy", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("by", F.col("ay") + F.col("dy"))
    met = shifted.join(rows(b, "by", "bxs"), ["page_id", "by"])
    offsets = F.explode(F.flatten(F.transform("axs", lambda x: F.transform(F.filter("bxs", lambda z: F.abs(z - x) <= most), lambda z: z - x))))
    votes = met.select("page_id", "dy", offsets.alias("dx")).groupBy("page_id", "dy", "dx").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("dy", "dx", "n"), F.struct(F.col("n"), -F.col("dy"), -F.col("dx"))).alias("s")
    return votes.groupBy("page_id").agg(best).select("page_id", "s.dy", "s.dx", "s.n")


def best_shift_scores(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """The greatest IoU and the greatest Dice of a shifted within +-most and b. Cells that leave the
    picture are still counted: the pictures are taken as padded."""
    best = best_shift(a, b, most).select("page_id", "n")
    size = lambda d, c: d.groupBy("page_id").agg(F.count("*").alias(c))
    both = best.join(size(a, "p"), "page_id").join(size(b, "q"), "page_id")
    return both.select("page_id", (F.col("n") / (F.col("p") + F.col("q") - F.col("n"))).alias("iou"), (2 * F.col("n") / (F.col("p") + F.col("q"))).alias("dice"))


def centerline_error(a: DataFrame, b: DataFrame, least: int = 5) -> DataFrame:
    """a, b(page_id, x, y): mean ink row per column; mean absolute error and population deviation
    over shared columns, for pages with `least` of them."""
    centre = lambda d, n: d.groupBy("page_id", "x").agg(F.avg("y").alias(n))
    both = centre(a, "a").join(centre(b, "b"), ["page_id", "x"])
    out = both.groupBy("page_id").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.stddev_pop(F.col("a") - F.col("b")).alias("std"), F.count("*").alias("columns"))
    return out.where(F.col("columns") >= least)


def runtime_summary(rows: DataFrame, sec: str, *keys: str) -> DataFrame:
    """Count, total, mean, median, least and greatest; zeros where there is none. The median is
    exact: Spark sums counts per value before the shuffle."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.count(sec).alias("n"), zero(F.sum(sec)).alias("total"), zero(F.avg(sec)).alias("mean"), zero(F.median(sec)).alias("median"),
        zero(F.min(sec)).alias("least"), zero(F.max(sec)).alias("greatest"),
    )


def spread(rows: DataFrame, value: str, *keys: str, important: float = 0.15) -> DataFrame:
    """Mean, population variance and deviation, their ratio (null for a mean of zero), greatest,
    count, and whether the greatest is above `important`."""
    out = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"), F.stddev_pop(value).alias("std"), F.max(value).alias("greatest"), F.count(value).alias("n"))
    cv = F.when(F.abs("mean") > 1e-12, F.col("std") / F.col("mean"))
    return out.withColumns({"cv": cv, "label": F.when(F.col("greatest") <= important, "not important").otherwise("important")})


def macro(long: DataFrame, *keys: str) -> DataFrame:
    """long(metric, value): plain means; rows without a value (failed pages) don't count."""
    return long.where("value is not null").groupBy(*keys, "metric").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def improvements(before: DataFrame, after: DataFrame, errors: list[str], *keys: str) -> DataFrame:
    """after - before by metric, with the sign turned for errors."""
    both = before.withColumnRenamed("value", "b").join(after.withColumnRenamed("value", "a"), [*keys, "metric"])
    return both.select(*keys, "metric", F.when(F.col("metric").isin(errors), F.col("b") - F.col("a")).otherwise(F.col("a") - F.col("b")).alias("gain"))




def chamfer(a: DataFrame, b: DataFrame, reach: float, side: float) -> DataFrame:
    """a, b(page_id, y, x): mean distance of each point to the nearest of the other side, both ways
    averaged, however far; `side` (the page's longer one) where one side has no point. Pages
    without any point don't appear. `reach` is where most neighbours are expected."""
    point = F.col("y").cast("bigint") * (1 << 32) + F.col("x")
    mine = lambda p: p.select("page_id", point.alias("id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    # the other side's numbers are negative, as a place doesn't shut out itself
    theirs = lambda q: q.select("page_id", (-1 - point).alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    mean = lambda p, q, name: nearest_of(mine(p), theirs(q), reach).groupBy("page_id").agg(F.avg("distance").alias(name))
    pages = a.select("page_id").unionAll(b.select("page_id")).distinct()
    both = pages.join(mean(a, b, "there"), "page_id", "left").join(mean(b, a, "back"), "page_id", "left")
    return both.select("page_id", F.coalesce((F.col("there") + F.col("back")) / 2, F.lit(float(side))).alias("chamfer"))


def chamfer_score(distance: Column, diagonal: float) -> Column:
    return 1 / (1 + distance / diagonal)


def f_beta(p: Column, r: Column, beta: float = 1.0) -> Column:
    return F.when(p + r > 0, (1 + beta * beta) * p * r / (beta * beta * p + r)).otherwise(0.0)
