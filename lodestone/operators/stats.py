"""Agreement and calibration: kappa, precision and recall, ECE, Brier score, reliability bins.

Comparisons run over the trials that both annotators have judged; a category's absent labels are counted from the marginals, so
that the grid of categories and trials is never built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import calibration_bin, kappa, safe_ratio

BINS = 10
CALIBRATED_KAPPA = 0.4


class EmptyInputError(ValueError):
    """There is nothing to measure, or it is out of range."""


def validate_pairs(pairs: DataFrame, confidence: str = "confidence", observed: str = "observed") -> None:
    c, o = F.col(confidence), F.col(observed)
    bad = F.count_if(c.isNull() | (c < 0) | (c > 1) | o.isNull() | ~o.isin(0, 1))
    n, wrong = pairs.agg(F.count(F.lit(1)), bad).first()
    if not n:
        raise EmptyInputError("no pairs of confidence and outcome")
    if wrong:
        raise EmptyInputError(f"{wrong} pairs out of range")


def agreement(rows: DataFrame) -> DataFrame:
    """Pairwise agreement of annotators by category: 2 x 2 counts over shared trials and kappa (NULL where undefined).

    rows: annotator, trial_id, category_name. One shuffle brings a trial's labels into one row (annotators times 40 categories at
    most); equal rows are counted, by partial sums, before pairs are made inside them, so that annotators do not multiply the trials.
    A row without a category counts the trials of a pair.
    """
    rows = rows.filter((F.col("annotator") != "") & (F.col("trial_id") != ""))
    t = rows.groupBy("trial_id").agg(F.array_sort(F.collect_set(F.struct("annotator", "category_name"))).alias("s"))
    t = t.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    who = F.array_sort(F.array_distinct(F.transform("s", lambda x: x["annotator"])))
    pairs = F.flatten(F.transform(who, lambda a: F.transform(F.filter(who, lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    t = t.select("s", "n", F.explode(pairs).alias("p"))
    of = lambda side: F.transform(F.filter("s", lambda x: x["annotator"] == F.col(f"p.{side}")), lambda x: x["category_name"])
    t = t.select(F.col("p.a").alias("annotator_a"), F.col("p.b").alias("annotator_b"), of("a").alias("ca"), of("b").alias("cb"), "n")
    t = t.select("annotator_a", "annotator_b", "ca", "cb", "n", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_union("ca", "cb"))).alias("category_name"))
    x, y = (F.coalesce(F.array_contains(c, F.col("category_name")).cast("long"), F.lit(0)) for c in ("ca", "cb"))
    per = t.groupBy("annotator_a", "annotator_b", "category_name").agg(F.sum(x * y * F.col("n")).alias("n11"), F.sum(x * (1 - y) * F.col("n")).alias("n10"), F.sum((1 - x) * y * F.col("n")).alias("n01"), F.sum("n").alias("k"))
    # what is left is a row for each pair of annotators and category
    trials = F.max(F.when(F.col("category_name").isNull(), F.col("k"))).over(W.partitionBy("annotator_a", "annotator_b"))
    per = per.withColumn("n00", trials - F.col("n11") - F.col("n10") - F.col("n01")).filter("category_name is not null").drop("k")
    return per.withColumn("kappa", kappa(*(F.col(c) for c in ("n11", "n10", "n01", "n00"))))


def mean_kappa(per: DataFrame, digits: int = 4) -> DataFrame:
    """The mean of the defined, rounded kappas of each pair of annotators."""
    return per.groupBy("annotator_a", "annotator_b").agg(F.avg(F.bround("kappa", digits)).alias("mean_kappa"), F.count("kappa").alias("categories"))


def cross_model(per: DataFrame, threshold: float = CALIBRATED_KAPPA) -> DataFrame:
    """agreement() with an undefined kappa as 0, the share of equal judgements, and whether the category counts as calibrated."""
    cells = [F.col(c) for c in ("n11", "n10", "n01", "n00")]
    k = kappa(*cells, undefined_as=0.0)
    n = cells[0] + cells[1] + cells[2] + cells[3]
    return per.select("annotator_a", "annotator_b", "category_name", k.alias("kappa"), safe_ratio(cells[0] + cells[3], n).alias("agreement"), (cells[0] + cells[1]).alias("count_a"), (cells[0] + cells[2]).alias("count_b"), (k >= threshold).alias("calibrated"))


def _side_by_side(predicted: DataFrame, golden: DataFrame) -> DataFrame:
    """One row for each trial that both have: p, the predicted (category, confidence) pairs, and g, the golden categories. One shuffle."""
    conf = F.col("confidence").cast("double") if "confidence" in predicted.columns else F.lit(1.0)
    none = F.lit(None).cast("double")
    tagged = predicted.select("trial_id", "category_name", conf.alias("c"), F.lit(True).alias("own")).unionByName(golden.select("trial_id", "category_name", none.alias("c"), F.lit(False).alias("own")))
    p = F.collect_list(F.when(F.col("own"), F.struct(F.col("category_name").alias("k"), F.col("c"))))
    t = tagged.filter("category_name is not null").groupBy("trial_id").agg(F.array_distinct(p).alias("p"), F.collect_set(F.when(~F.col("own"), F.col("category_name"))).alias("g"))
    return t.filter((F.size("p") > 0) & (F.size("g") > 0))


def _cells(both: DataFrame) -> DataFrame:
    """A row for each trial and category that either side has: confidence (NULL if not predicted) and observed."""
    every = F.array_union(F.transform("p", lambda x: x["k"]), F.col("g"))
    c = both.select("p", "g", F.explode(every).alias("category_name"))
    found = F.get(F.filter("p", lambda x: x["k"] == F.col("category_name")), F.lit(0))
    return c.select("category_name", found.isNotNull().cast("long").alias("predicted"), found["c"].alias("confidence"), F.array_contains("g", F.col("category_name")).cast("int").alias("observed"))


def confusion(predicted: DataFrame, golden: DataFrame) -> DataFrame:
    """Per category over shared trials: true and false positives, false negatives, precision, recall, F1, support."""
    x, y = F.col("predicted"), F.col("observed").cast("long")
    out = _cells(_side_by_side(predicted, golden)).groupBy("category_name").agg(F.sum(x * y).alias("tp"), F.sum(x * (1 - y)).alias("fp"), F.sum((1 - x) * y).alias("fn"))
    return with_scores(out)


def with_scores(df: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return df.withColumns({"precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn), "f1": safe_ratio(2 * tp, 2 * tp + fp + fn), "support": tp + fn})


def calibration_pairs(predicted: DataFrame, golden: DataFrame) -> DataFrame:
    """(category_name, confidence, observed, weight) over all shared trials, equal pairs as one row; trials without the category are confidence 0.

    predicted and golden are read for the cells and again for the number of trials: give tables, not plans.
    """
    both = _side_by_side(predicted, golden)
    n = both.agg(F.count(F.lit(1)).alias("trials"))
    rows = _cells(both).groupBy("category_name", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "observed").agg(F.count(F.lit(1)).alias("weight"))
    rest = rows.groupBy("category_name").agg(F.sum("weight").alias("k")).crossJoin(F.broadcast(n))  # n is a single row
    rest = rest.select("category_name", F.lit(0.0).alias("confidence"), F.lit(0).alias("observed"), (F.col("trials") - F.col("k")).alias("weight"))
    return rows.unionByName(rest.filter("weight > 0"))


def reliability(pairs: DataFrame, by: tuple[str, ...] = (), bins: int = BINS, weight: Column | None = None) -> DataFrame:
    """Bins of equal width with their weight, mean confidence and observed rate; empty bins are left to fill_bins()."""
    w = weight if weight is not None else F.lit(1)
    return pairs.groupBy(*by, calibration_bin(F.col("confidence"), bins).alias("bin")).agg(F.sum(w).cast("long").alias("n"), F.sum(w * F.col("confidence")).alias("confidence_sum"), F.sum(w * F.col("observed")).cast("long").alias("observed_sum"))


def fill_bins(binned: DataFrame, bins: int = BINS) -> DataFrame:
    """All bins of an ungrouped diagram, with zeros where nothing fell."""
    every = binned.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(binned, "bin", "left")
    return out.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("confidence_sum") / F.col("n"), F.lit(0.0)).alias("mean_confidence"), F.coalesce(F.col("observed_sum") / F.col("n"), F.lit(0.0)).alias("observed_rate"))


def ece(binned: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Expected calibration error: the bins' gaps, weighted by their share."""
    return binned.groupBy(*by).agg((F.sum(F.abs(F.col("confidence_sum") - F.col("observed_sum"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def brier(pairs: DataFrame, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    w = weight if weight is not None else F.lit(1)
    return pairs.groupBy(*by).agg((F.sum(w * F.pow(F.col("confidence") - F.col("observed"), F.lit(2.0))) / F.sum(w)).alias("brier"), F.sum(w).cast("long").alias("n"))


def direction(mean_confidence: Column, observed_rate: Column, points: float = 0.01) -> Column:
    """>> overconfident, << underconfident, = within a point, - without data."""
    gap = mean_confidence - observed_rate
    return F.when(gap.isNull(), "-").when(gap > points, ">>").when(gap < -points, "<<").otherwise("=")


def without_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Trials that both sides have and neither reports as an error; inputs: trial_id, status."""
    x = a.select("trial_id", F.col("status").alias("sa")).join(b.select("trial_id", F.col("status").alias("sb")), "trial_id")
    return x.filter((F.coalesce("sa", F.lit("ok")) != "error") & (F.coalesce("sb", F.lit("ok")) != "error")).select("trial_id")


def status_counts(docs: DataFrame) -> DataFrame:
    s = F.col("annotation_result_status")
    return docs.agg(F.count_if(s == "ok").alias("ok"), F.count_if(s == "no_categories").alias("no_categories"), F.count_if(s == "error").alias("error"), F.count(F.lit(1)).alias("total"))


def pooled_kappa(a: DataFrame, b: DataFrame, categories: int) -> DataFrame:
    """Kappa over the whole grid of shared trials and a fixed number of categories."""
    c = confusion(a, b).agg(F.sum("tp").alias("n11"), F.sum("fp").alias("n10"), F.sum("fn").alias("n01"))
    n = a.select("trial_id").intersect(b.select("trial_id")).agg((F.count(F.lit(1)) * categories).alias("cells"))
    x = c.crossJoin(n).withColumn("n00", F.col("cells") - F.col("n11") - F.col("n10") - F.col("n01"))
    cells = [F.col(k) for k in ("n11", "n10", "n01", "n00")]
    return x.select(*cells, kappa(*cells).alias("kappa"))
