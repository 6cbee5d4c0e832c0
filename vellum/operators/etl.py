"""Building datasets: joins with defaults, resumed runs, deduplication, validation, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_default(rows: DataFrame, labels: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """Every row, with its label or the default."""
    return rows.join(labels.select(key, value), key, "left").withColumn(value, F.coalesce(value, default))


def unmatched(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return rows.join(other.select(key).distinct(), key, "left_anti")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run has still to do."""
    return unmatched(rows, done, key)


def first_of_each(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first row of each key, and how many there were."""
    first = F.min(F.struct(ordinal, F.struct(*[c for c in rows.columns if c not in (key, ordinal)]).alias("rest")))
    return rows.groupBy(key).agg(first.alias("f"), F.count("*").alias("n")).select(key, f"f.{ordinal}", "f.rest.*", "n")


def best_of_each(runs: list[DataFrame], key: str, score: str) -> DataFrame:
    """Several runs as one, the row of greatest score for each key."""
    merged = runs[0]
    for r in runs[1:]:
        merged = merged.unionByName(r)
    rest = F.struct(*[c for c in merged.columns if c != key])
    return merged.groupBy(key).agg(F.max_by(rest, F.struct(F.col(score), rest)).alias("r")).select(key, "r.*")


def reasons(checks: dict[str, Column]) -> Column:
    """The names of all checks that fail, in order."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda r: r.isNotNull())


def reason_counts(rows: DataFrame, column: str = "reasons") -> DataFrame:
    return rows.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def split(rows: DataFrame, key: str, shares: dict[str, int]) -> DataFrame:
    """A repeatable split by a hash of the key: shares in percent, in order."""
    slot = F.pmod(F.crc32(F.col(key).cast("string")), F.lit(100))
    part, top = None, 0
    for name, share in shares.items():
        top += share
        part = F.when(slot < top, name) if part is None else part.when(slot < top, name)
    return rows.withColumn("part", part)


def leading(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by an explicit order, as a head report."""
    return rows.orderBy(*order).limit(n)


def numbered_copies(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Names made unique: the second and later rows of a name get _dup1, _dup2 ... before the
    suffix."""
    w = Window.partitionBy(name).orderBy(*order)
    k = F.row_number().over(w) - 1
    return rows.withColumn("target", F.when(k == 0, F.col(name)).otherwise(F.regexp_replace(F.col(name), F.lit(r"^(.*?)(\.[^./]*)?$"), F.concat(F.lit("$1_dup"), k.cast("string"), F.lit("$2")))))


def per_source_skips(rows: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """By source: rows, rows with a partner, rows without."""
    both = rows.join(matched.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("__hit").alias("copied"), (F.count("*") - F.count("__hit")).alias("skipped"))


def matched(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows that have a partner."""
    return rows.join(other.select(key).distinct(), key, "left_semi")


def stem(path: Column) -> Column:
    """The file name of a path without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def index_by_stem(files: DataFrame, path: str = "path") -> DataFrame:
    """(stem, path, n): the first path of each stem, and how many there are."""
    return files.groupBy(stem(F.col(path)).alias("stem")).agg(F.min(path).alias("path"), F.count("*").alias("n"))


def leading_split(rows: DataFrame, key: str, n_train: int) -> DataFrame:
    """The first rows in order of the key for training, the others for validation; where none would
    be left of three or more, the last two validate. Keys that sort together go by their rank, found
    from counts of the keys before, so no task sorts all rows."""
    total = rows.count()
    valid = total - min(n_train, total)
    if not valid and total >= 3:
        valid = min(2, total - 1)
    last = rows.select(key).orderBy(F.desc(key)).limit(valid) if valid <= total // 2 else None
    if last is not None:
        marked = rows.join(last.withColumn("__v", F.lit(True)), key, "left")
        return marked.withColumn("part", F.when(F.col("__v"), "valid").otherwise("train")).drop("__v")
    first = rows.select(key).orderBy(key).limit(total - valid)
    marked = rows.join(first.withColumn("__t", F.lit(True)), key, "left")
    return marked.withColumn("part", F.when(F.col("__t"), "train").otherwise("valid")).drop("__t")


def run_counts(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """One row of a run's state: files there are, done, still pending."""
    both = files.select(key).distinct().join(done.select(key).distinct().withColumn("__d", F.lit(1)), key, "left")
    return both.agg(F.count("*").alias("available"), F.count("__d").alias("optimised"), (F.count("*") - F.count("__d")).alias("pending"))


def stacked(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources under one another, with their name."""
    out = None
    for name, rows in sources.items():
        part = rows.withColumn("origin", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def score_report(rows: DataFrame, part: str, scores: list[str]) -> DataFrame:
    """(part, n, mean of each score): rows without a score don't count in its mean."""
    return rows.groupBy(part).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in scores])


def fan_out(rows: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """Each row once per category."""
    return rows.withColumn("category", F.explode(F.array(*map(F.lit, categories))))


def flat_settings(nested: DataFrame, key: str) -> DataFrame:
    """A struct of settings per row, one level deep, to (key, name, value) with dotted names."""
    parts = []
    for f in nested.schema:
        if f.name == key:
            continue
        inner = getattr(f.dataType, "fields", None)
        parts += [F.struct(F.lit(f"{f.name}.{g.name}").alias("name"), F.col(f.name)[g.name].cast("double").alias("value")) for g in inner] if inner else [F.struct(F.lit(f.name).alias("name"), F.col(f.name).cast("double").alias("value"))]
    return nested.select(key, F.inline(F.array(*parts)))


def nested_settings(flat: DataFrame, key: str) -> DataFrame:
    """(key, settings): the names and values of flat_settings as one map."""
    return flat.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("settings"))
