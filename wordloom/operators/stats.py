"""Statistics, metrics and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import RANGE_ROWS, numbered


def sequential_sigma(rows: DataFrame, columns: list[str], sigmas: float = 3.0) -> DataFrame:
    """Keeps rows within so many sample deviations of the mean, one column after another on what is left."""
    for c in columns:
        m = rows.agg(F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s"))
        rows = rows.crossJoin(F.broadcast(m)).where(F.abs(F.col(c) - F.col("_m")) <= sigmas * F.col("_s")).drop("_m", "_s")
    return rows


def bins(rows: DataFrame, x: str, low: float, high: float, number: int) -> DataFrame:
    """Mean, median and mean above a half in equal bins; the last holds its upper end."""
    b = F.least(F.floor((F.col(x) - low) / ((high - low) / number)), F.lit(number - 1)).cast("int")
    return rows.where((F.col(x) >= low) & (F.col(x) <= high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.avg(F.when(F.col(x) > 0.5, F.col(x))).alias("mean_above"))


def average_rank(order: Column, by: list[str]) -> Column:
    """Ranks from 1, ties sharing their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, order)) - 1) / 2.0


def wilcoxon(differences: DataFrame, by: list[str]) -> DataFrame:
    """Signed ranks of ``d``: statistic, count and z by the normal approximation with ties; zeros are dropped."""
    ranked = differences.where("d <> 0").withColumn("r", average_rank(F.abs(F.col("d")), by)).withColumn("t", F.count("*").over(Window.partitionBy(*by, F.abs(F.col("d")))))
    s = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("minus"), F.sum(F.col("t") * F.col("t") - 1.0).alias("ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    w = F.least("plus", "minus")
    return s.select(*by, "n", w.alias("w"), F.try_divide(w - n * (n + 1) / 4, F.sqrt(var)).alias("z"))


def holm(rows: DataFrame, p: str, key: str) -> DataFrame:
    """Step-down adjusted p-values."""
    ranked = numbered(rows, p, key, name="_r").crossJoin(F.broadcast(rows.agg(F.count("*").alias("_m"))))
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p))
    # a running maximum over blocks of ranks, and over the blocks' own maxima
    blocks = ranked.withColumn("_step", step).withColumn("_block", F.floor(F.col("_r") / RANGE_ROWS))
    top = blocks.groupBy("_block").agg(F.max("_step").alias("_top"))
    before = top.select("_block", F.max("_top").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row per block
    inside = F.max("_step").over(Window.partitionBy("_block").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("_inside", inside).join(F.broadcast(before), "_block").withColumn("adjusted", F.greatest("_inside", "_before")).drop("_r", "_m", "_step", "_block", "_before", "_inside")


def t_statistics(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Paired and pooled independent t of two columns."""
    d = F.col(a) - F.col(b)
    n = F.count("*")
    pooled = (F.var_samp(a) + F.var_samp(b)) / 2
    return rows.agg(n.alias("n"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(n)).alias("paired"), F.try_divide(F.avg(a) - F.avg(b), F.sqrt(pooled * 2 / n)).alias("independent"))


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman, and the coefficient of determination of ``y`` as a prediction of ``x``."""
    w = rows.withColumn("_one", F.lit(1)).withColumn("_rx", average_rank(F.col(x), ["_one"])).withColumn("_ry", average_rank(F.col(y), ["_one"]))
    m = w.crossJoin(F.broadcast(rows.agg(F.avg(x).alias("_m"))))
    return m.agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"), (1 - F.try_divide(F.sum(F.pow(F.col(x) - F.col(y), 2)), F.sum(F.pow(F.col(x) - F.col("_m"), 2)))).alias("r2"))


def class_report(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """By class: precision, recall, F1, support; undefined ratios are 0."""
    classes = rows.select(F.col(truth).alias("label")).unionByName(rows.select(F.col(guess).alias("label"))).distinct()
    both = rows.groupBy(truth, guess).agg(F.count("*").alias("n"))
    cells = classes.join(both, (F.col(truth) == F.col("label")) | (F.col(guess) == F.col("label")), "left")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    t, g = F.col(truth) == F.col("label"), F.col(guess) == F.col("label")
    c = cells.groupBy("label").agg(n(t & g).alias("tp"), n(t).alias("support"), n(g).alias("claimed"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("claimed")), ratio(F.col("tp"), F.col("support"))
    return c.select("label", "support", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def k_folds(rows: DataFrame, k: int, order: str) -> DataFrame:
    """Contiguous folds in order; the first ``n mod k`` have one row more."""
    total = rows.count()
    rows = numbered(rows, order, name="_i", first=0)
    n, i = F.lit(total), F.col("_i")
    base, extra = F.floor(n / k), n % k
    fold = F.when(i < extra * (base + 1), F.floor(i / (base + 1))).otherwise(extra + F.floor((i - extra * (base + 1)) / F.greatest(base, F.lit(1))))
    return rows.withColumn("fold", fold.cast("int")).drop("_i")


def ordered_slice(rows: DataFrame, start: int, stop: int, *order) -> DataFrame:
    """The rows from place ``start`` (from 0) up to ``stop`` in a total order."""
    return numbered(rows, *order, name="_i", first=0).where((F.col("_i") >= start) & (F.col("_i") < stop)).drop("_i")


def regression_metrics(rows: DataFrame, truth: str, guess: str, small: float = 1e-7) -> DataFrame:
    """Coefficient of determination and Pearson correlation as a training metric reports them.

    The sum of squares about the mean is kept off zero by ``small``; a correlation of constants is 0.
    """
    mean = rows.agg(F.avg(truth).alias("_m"))
    d = rows.crossJoin(F.broadcast(mean))
    rest, about = F.sum(F.pow(F.col(truth) - F.col(guess), 2)), F.sum(F.pow(F.col(truth) - F.col("_m"), 2))
    return d.agg((1 - rest / (about + small)).alias("r2"), F.coalesce(F.nanvl(F.corr(truth, guess), F.lit(0.0)), F.lit(0.0)).alias("pearson"))


def stratified_folds(rows: DataFrame, k: int, label: str, order: str) -> DataFrame:
    return rows.withColumn("fold", F.pmod(F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1, F.lit(k)).cast("int"))


def holdout(rows: DataFrame, share: float, key: Column, seed: int) -> DataFrame:
    """A column ``test``: an even share of rows, chosen by a hash of the key and the seed."""
    return rows.withColumn("test", F.pmod(F.crc32(F.concat_ws(":", F.lit(str(seed)), key).cast("binary")), F.lit(1_000_000)) < int(share * 1_000_000))


def centroid_rank(vectors: DataFrame) -> DataFrame:
    """``id, distance, rank`` by Euclidean distance to the mean of ``id, v``, ties to smaller ids."""
    long = vectors.select("id", F.posexplode("v").alias("i", "x"))
    mean = long.groupBy("i").agg(F.avg("x").alias("m"))
    d = long.join(F.broadcast(mean), "i").groupBy("id").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("m"), 2))).alias("distance"))
    return numbered(d, F.round("distance", 9), "id", name="rank").withColumn("rank", F.col("rank").cast("int"))
