"""Agreement, classification and distribution metrics. Zero denominators give null, or what is stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.runtime import cut


def kappa(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns, with n and agreement; labels '' and N/A on either side leave a pair out.
    Chance agreement of 1 gives kappa 1 if all agree, else 0."""
    kept = pairs.where(f"{a} not in ('', 'N/A') and {b} not in ('', 'N/A')")
    return kappa_of_counts(kept.groupBy(*by, a, b).agg(F.count("*").alias("c")), by, a, b)


def kappa_of_counts(cells: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """kappa of pairs counted by their two labels: c is the number. The counts are written, as three sums read them."""
    cells = cut(cells)
    whole = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("same"))
    left, right = (cells.groupBy(*by, F.col(x).alias("label")).agg(F.sum("c").alias(f"n_{k}")) for x, k in ((a, "a"), (b, "b")))
    chance = left.join(right, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("cross"))
    out = whole.join(chance, by, "left").fillna(0, ["cross"])
    po, pe = F.col("same") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    k = F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return out.select(*by, "n", po.alias("agreement"), k.alias("kappa"))


def confusion(df: DataFrame, by: list[str], truth: Column, predicted: Column) -> DataFrame:
    """TP, TN, FP, FN of boolean columns with precision, recall and F1 (null where undefined)."""
    t, p = truth, predicted
    out = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.select("*", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def rounded_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row of counts and rates of 0/1 labels, predictions outside 0/1 read as 0; rates are 0 where undefined and
    rounded to three places, F1 from the rounded rates."""
    p = F.when(F.col(predicted) == 1, 1).otherwise(0)
    out = df.agg(*[F.count_if((F.col(truth) == t) & (p == v)).alias(n) for n, t, v in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))])
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0)), 3)
    out = out.select("*", rate("tp", "fn").alias("sensitivity"), rate("tn", "fp").alias("specificity"), rate("tp", "fp").alias("precision"))
    return out.withColumn("f1", F.round(F.coalesce(F.try_divide(2 * F.col("precision") * F.col("sensitivity"), F.col("precision") + F.col("sensitivity")), F.lit(0.0)), 3))


def weighted_metrics(df: DataFrame, truth: str, predicted: str, invalid: int = 404) -> DataFrame:
    """Precision, recall, F1 and specificity by class, weighted by the true classes' sizes; invalid predictions are left
    out, undefined rates are 0."""
    kept = df.where(F.col(predicted) != invalid).select(F.col(truth).cast("int").alias("t"), F.col(predicted).cast("int").alias("p"))
    cells = kept.groupBy("t", "p").agg(F.count("*").alias("c"))
    true, said = cells.groupBy(F.col("t").alias("k")).agg(F.sum("c").alias("n_true")), cells.groupBy(F.col("p").alias("k")).agg(F.sum("c").alias("n_said"))
    hit = cells.where("t = p").select(F.col("t").alias("k"), F.col("c").alias("hit"))
    by = true.join(said, "k", "left").join(hit, "k", "left").fillna(0, ["n_said", "hit"]).join(cells.agg(F.sum("c").alias("n")))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    precision, recall = zero(F.try_divide("hit", "n_said")), zero(F.try_divide("hit", "n_true"))
    f1 = zero(F.try_divide(2 * F.col("hit"), F.col("n_said") + F.col("n_true")))
    specificity = zero(F.try_divide(F.col("n") - F.col("n_true") - F.col("n_said") + F.col("hit"), F.col("n") - F.col("n_true")))
    mean = lambda x: F.sum(x * F.col("n_true")) / F.sum("n_true")
    return by.agg(mean(precision).alias("precision"), mean(recall).alias("recall"), mean(f1).alias("f1"), mean(specificity).alias("specificity"), F.sum("n_true").alias("n"))


def errors_by_position(df: DataFrame, order: str, truth: str, predicted: str, period: int = 39) -> DataFrame:
    """False positives and negatives by place within chunks of `period` rows. Places are numbered in two steps, within
    ranges of the order and then across them, so that no single task sorts all rows."""
    placed = numbered(df, order)
    wrong = placed.where(F.col(truth) != F.col(predicted))
    kind = F.when(F.col(predicted) == 1, "FP").otherwise("FN")
    return wrong.groupBy((F.pmod(F.col("_n") - 1, F.lit(period)) + 1).cast("int").alias("question"), kind.alias("kind")).agg(F.count("*").alias("n"))


def cumulative(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """Adds running sums, of all rows or within `by`, in an order that must be unique and begin with the columns of `by`. No
    task sorts all rows of a group: rows go to range partitions and are written with their partition, so that the sums
    of whole partitions, which are added to those within, can't differ from them."""
    parts = {f"_s{k}": c for k, c in enumerate(sums.values())}
    ranged = cut(df.select("*", *[c.alias(n) for n, c in parts.items()]).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    whole = ranged.groupBy("_part", *by).agg(*[F.sum(n).alias(f"_t{n}") for n in parts])
    down = Window.partitionBy(*by).orderBy("_part") if by else Window.orderBy("_part")  # one row a partition
    before = whole.select("_part", *by, *[(F.sum(f"_t{n}").over(down) - F.col(f"_t{n}")).alias(f"_b{n}") for n in parts])
    if by:  # most groups lie in one partition and have nothing before them
        before = before.where(" or ".join(f"_b{n} != 0" for n in parts))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(n).over(inside).alias(f"_i{n}") for n in parts])
    same = F.expr(" and ".join(["l._part = b._part", *[f"l.{c} <=> b.{c}" for c in by]]))
    out = local.alias("l").join(F.broadcast(before.alias("b")), same, "left")
    added = [(F.col(f"l._i{n}") + F.coalesce(F.col(f"b._b{n}"), F.lit(0))).alias(name) for name, n in zip(sums, parts)]
    return out.select(*[F.col(f"l.`{c}`") for c in df.columns if c not in sums], *added)


def numbered(df: DataFrame, order: str, name: str = "_n") -> DataFrame:
    """Adds row numbers from 1 in the order of a unique column, with no global sort."""
    return cumulative(df, [F.col(order)], {name: F.lit(1)})


def _scored(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """(threshold, pos, neg, cp, cn): rows at each distinct score and from the highest down to it."""
    at = df.groupBy(score.alias("threshold")).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    return cumulative(at, [F.desc("threshold")], {"cp": F.col("pos"), "cn": F.col("neg")})


def roc(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """(threshold, tpr, fpr) for each distinct score, from the highest; cumulative over scores, not rows."""
    at = cut(_scored(df, truth, score))
    whole = at.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return at.join(F.broadcast(whole)).select("threshold", F.try_divide("cp", "all_pos").alias("tpr"), F.try_divide("cn", "all_neg").alias("fpr"))


def auc(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """Area under the ROC curve by trapezoids from (0, 0): each step right, times the mean of the heights at its ends."""
    at = _scored(df, truth, score)
    area = F.sum(F.col("neg").cast("double") * (2 * F.col("cp") - F.col("pos")) / 2)
    return at.agg(F.try_divide(area, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], weight: str | None = None) -> DataFrame:
    """(by, q): linear quantiles of the values of each group, nulls left out; weight names a column of how often a row counts.
    Ranks are looked up in running counts of the distinct values, so no task holds a group's values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    placed = cut(cumulative(counts, [*map(F.col, by), F.col("_v")], {"_to": F.col("_c")}, by))
    sizes = placed.groupBy(*by).agg(F.max("_to").alias("_n"))
    same = F.expr(" and ".join(f"p.{c} <=> s.{c}" for c in by))
    at = placed.alias("p").join(sizes.alias("s"), same).select(*[F.col(f"p.{c}").alias(c) for c in by], "_v", "_c", "_to", "_n")
    picks = []
    for k, q in enumerate(shares):
        low = F.floor((F.col("_n") - 1) * q)
        held = lambda rank: (F.col("_to") > rank) & (F.col("_to") - F.col("_c") <= rank)
        picks += [F.max(F.when(held(low), F.col("_v"))).alias(f"_l{k}"), F.max(F.when(held(F.ceil((F.col("_n") - 1) * q)), F.col("_v"))).alias(f"_h{k}")]
    found = at.groupBy(*by, "_n").agg(*picks)
    mixed = [F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * ((F.col("_n") - 1) * q - F.floor((F.col("_n") - 1) * q)) for k, q in enumerate(shares)]
    return found.select(*by, F.array(*mixed).alias("q"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles (linear) and maximum of each column, rounded to three places."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    r = lambda c: F.round(c, 3)
    plain = long.groupBy("variable").agg(F.count("v").alias("n"), r(F.avg("v")).alias("mean"), r(F.stddev_samp("v")).alias("std"), r(F.min("v")).alias("low"), r(F.max("v")).alias("high"))
    q = quantiles(long, ["variable"], "v", [0.25, 0.5, 0.75])
    return plain.join(q, "variable", "left").select("variable", "n", "mean", "std", "low", r(F.col("q")[0]).alias("q1"), r(F.col("q")[1]).alias("median"), r(F.col("q")[2]).alias("q3"), "high")


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin from 0, n) of equal bins over [low, high]; the last bin includes its right edge; values outside don't count."""
    v = value.cast("double")
    k = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
    return df.where((v >= low) & (v <= high)).groupBy(k.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def edged_histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """(bin from 0, low, high, n) of bins between given edges, right edges excluded but for the last; empty bins too."""
    v = value.cast("double")
    k = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= v)) - 1
    counts = df.where((v >= edges[0]) & (v <= edges[-1])).groupBy(F.least(k, F.lit(len(edges) - 2)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin long, low double, high double")
    return bins.join(counts, "bin", "left").fillna(0, ["n"])


def boxplot(df: DataFrame, by: list[Column], value: str) -> DataFrame:
    """Quartiles, and the furthest values within one and a half quartile ranges."""
    names = [f"k{i}" for i in range(len(by))]
    base = cut(df.select(*[c.alias(n) for c, n in zip(by, names)], F.col(value).alias("v")).where("v is not null").groupBy(*names, "v").agg(F.count("*").alias("c")))
    q = quantiles(base, names, "v", [0.25, 0.5, 0.75], "c")
    q = q.select(*names, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    same = F.expr(" and ".join(f"b.{c} <=> q.{c}" for c in names))
    inside = base.alias("b").join(q.alias("q"), same).where("v >= q1 - 1.5 * (q3 - q1) and v <= q3 + 1.5 * (q3 - q1)")
    return inside.groupBy(*[F.col(f"b.{c}").alias(c) for c in names], "q1", "median", "q3").agg(F.min("v").alias("whisker_low"), F.max("v").alias("whisker_high"))


def shares(df: DataFrame, key: Column, name: str) -> DataFrame:
    counts = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
