"""Report aggregates over trials and their categories.

Inputs are `trials` (a row for each trial, with outcome and dimensions) and `labels` (trial_id, category_name and the trial's
dimensions, a row for each assigned category). Every result has a total order; nothing but the small results leaves the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import taxonomy
from ..functions.columns import core_task_name, phi, safe_ratio
from .rules import WITHOUT_TRAJECTORY

LOW_CONFIDENCE = 3
#: What a report tells of an example, where it is known.
EXAMPLE = ("task_id", "config_name", "reward", "evidence")


def trials_frame(df: DataFrame) -> DataFrame:
    """Agents and benchmarks without a name become `unknown`."""
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    return df.withColumn("agent_name", named("agent_name")).withColumn("benchmark", named("benchmark")).withColumn("model", F.nullif(F.col("model"), F.lit("")))


def _measures() -> list:
    """Rates and rewards have four places, mean lengths two, as reports show them."""
    n, passed = F.count(F.lit(1)), F.count_if(F.coalesce("passed", F.lit(False)))
    return [
        n.alias("n"), passed.alias("passed"), F.round(safe_ratio(passed, n), 4).alias("pass_rate"), F.round(F.avg("reward"), 4).alias("mean_reward"),
        F.round(F.avg("trajectory_length"), 2).alias("mean_trajectory_length"), F.round(F.avg("total_turns"), 2).alias("mean_turns"),
    ]


def slices(trials: DataFrame, *by: str) -> DataFrame:
    """Outcomes of each slice."""
    return trials.groupBy(*by).agg(*_measures())


def top_failures(labels: DataFrame, *by: str, k: int = 3) -> DataFrame:
    """The k most frequent categories among the failed trials of each slice."""
    c = labels.filter(~F.coalesce("passed", F.lit(False))).groupBy(*by, "category_name").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "category_name"))).filter(F.col("place") <= k)


def agent_models(trials: DataFrame) -> DataFrame:
    """Outcomes by agent and model; the label names the model only where an agent has more than one."""
    per = slices(trials, "agent_name", "model")
    several = F.count(F.lit(1)).over(W.partitionBy("agent_name")) > 1
    return per.withColumn("label", F.when(several, F.concat("agent_name", F.lit(" / "), F.coalesce("model", F.lit("(no model)")))).otherwise(F.col("agent_name")))


def agent_benchmarks(trials: DataFrame) -> DataFrame:
    """The cross-tab of agents and benchmarks, with thin cells marked."""
    return slices(trials, "agent_name", "benchmark").withColumn("low_confidence", F.col("n") < LOW_CONFIDENCE)


def divergences(matrix: DataFrame, k: int = 10) -> DataFrame:
    """Benchmarks on which agents differ most: the best and the worst agent of each, by pass rate and then name."""
    per = matrix.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("agents"), F.min(F.struct(-F.col("pass_rate"), F.col("agent_name"))).alias("high"),
        F.max(F.struct(-F.col("pass_rate"), F.col("agent_name"))).alias("low"),
    )
    out = per.filter("agents > 1").select("benchmark", F.col("high.agent_name").alias("high_agent"), (-F.col("high.col1")).alias("high_rate"), F.col("low.agent_name").alias("low_agent"), (-F.col("low.col1")).alias("low_rate"))
    return out.withColumn("max_delta", F.round(F.col("high_rate") - F.col("low_rate"), 4)).orderBy(F.desc("max_delta"), "benchmark").limit(k)


def corpus_stats(trials: DataFrame) -> DataFrame:
    names = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    passed = F.count_if(F.coalesce("passed", F.lit(False)))
    return trials.agg(
        F.count(F.lit(1)).alias("total"), passed.alias("passed"), (F.count(F.lit(1)) - passed).alias("failed"), F.round(safe_ratio(passed, F.count(F.lit(1))), 4).alias("pass_rate"),
        F.round(F.coalesce(F.avg("reward"), F.lit(0.0)), 4).alias("avg_reward"), names("config_name").alias("configs"), names("benchmark").alias("benchmarks"),
        F.count_if(F.coalesce("has_trajectory", F.lit(False))).alias("with_trajectory"),
    )


def category_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("category_name").agg(F.count(F.lit(1)).alias("n"))


def category_rates(labels: DataFrame, trials: DataFrame) -> DataFrame:
    """Counts over their denominator: trials with a trajectory for the categories that need one, else all."""
    totals = trials.agg(F.count(F.lit(1)).alias("all_trials"), F.count_if(F.coalesce("has_trajectory", F.lit(False))).alias("with_trajectory"))
    needs = ~F.col("category_name").isin(*sorted(WITHOUT_TRAJECTORY))
    out = category_counts(labels).crossJoin(totals)  # totals is a single row
    out = out.withColumn("denominator", F.when(needs, F.col("with_trajectory")).otherwise(F.col("all_trials")))
    return out.select("category_name", "n", needs.alias("requires_trajectory"), "denominator", F.round(safe_ratio(F.col("n"), F.col("denominator")), 4).alias("rate"))


def category_by(labels: DataFrame, by: str) -> DataFrame:
    """Counts of categories in each slice, with the slice's total; slices without a name are `unknown`."""
    c = labels.groupBy(F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit("unknown")).alias(by), "category_name").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("slice_total", F.sum("n").over(W.partitionBy(by)))


def paired_deltas(labels: DataFrame, least_shared: int = 20, k: int = 5) -> DataFrame:
    """For each pair of configurations that share enough tasks: the categories that come and go most from one to the other.

    A task is shared if both configurations have a labelled trial of it. Every (task, configuration) is counted once by its distinct categories. A category present in both cancels out, so counting per
    side over the shared tasks and subtracting gives the net number of tasks that gain or lose it.
    """
    named = labels.filter((F.col("config_name") != "") & (F.col("trial_path") != ""))
    cats = named.select(core_task_name(F.col("trial_path")).alias("task"), F.col("config_name").alias("cfg"), "category_name").distinct()
    cells = cats.select("task", "cfg").distinct()
    pairs = cells.alias("a").join(cells.alias("b"), (F.col("a.task") == F.col("b.task")) & (F.col("a.cfg") < F.col("b.cfg"))).select(F.col("a.task").alias("task"), F.col("a.cfg").alias("cfg_a"), F.col("b.cfg").alias("cfg_b"))
    enough = pairs.groupBy("cfg_a", "cfg_b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least_shared)
    sides = pairs.select("task", "cfg_a", "cfg_b", F.explode(F.array(F.struct(F.col("cfg_a").alias("cfg"), F.lit(-1).alias("sign")), F.struct(F.col("cfg_b").alias("cfg"), F.lit(1).alias("sign")))).alias("s")).select("task", "cfg_a", "cfg_b", "s.*")
    net = sides.join(cats, ["task", "cfg"]).groupBy("cfg_a", "cfg_b", "category_name").agg(F.sum("sign").alias("delta"))
    net = net.join(enough, ["cfg_a", "cfg_b"]).filter("delta <> 0")
    w = W.partitionBy("cfg_a", "cfg_b", F.col("delta") > 0).orderBy(F.abs("delta").desc(), "category_name")
    return net.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("cfg_a", "cfg_b", "shared", "category_name", "delta", "place")


def top_categories(labels: DataFrame, polarity: str, n: int = 3, examples: int = 2, legacy_polarity: bool = False) -> DataFrame:
    """The n most frequent categories of a polarity, each with its first examples by trial.

    With legacy_polarity every polarity counts as unknown, as in reports that looked it up in flat taxonomies only.
    """
    known = F.lit("unknown") if legacy_polarity else F.col("polarity")
    of = F.broadcast(taxonomy.table(labels.sparkSession).filter(known == polarity).select(F.col("name").alias("category_name")))
    own = labels.join(of, "category_name")
    top = own.groupBy("category_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category_name").limit(n)
    some = own.join(F.broadcast(top), "category_name").withColumn("place", F.row_number().over(W.partitionBy("category_name").orderBy("trial_id")))
    return some.filter(F.col("place") <= examples).select("category_name", "n", "place", "trial_id", *[c for c in EXAMPLE if c in labels.columns])


def dimension_rollup(labels: DataFrame) -> DataFrame:
    """Trials with a category in a dimension, and their failure rate."""
    of = F.broadcast(taxonomy.table(labels.sparkSession).select(F.col("name").alias("category_name"), "dimension"))
    per = labels.join(of, "category_name").select("trial_id", "dimension", "passed").distinct()
    failed = F.count_if(~F.coalesce("passed", F.lit(False)))
    return per.groupBy("dimension").agg(F.count(F.lit(1)).alias("trials"), failed.alias("failed"), F.round(safe_ratio(failed, F.count(F.lit(1))), 4).alias("failure_rate"))


def kinds(sets: DataFrame) -> DataFrame:
    """(c, n): the sets of categories that trials have and how many trials have each. Trials are many, their different sets few: counted by partial sums, first of all."""
    return sets.groupBy(F.array_sort("c").alias("c")).agg(F.count(F.lit(1)).alias("n"))


def category_sets(labels: DataFrame) -> DataFrame:
    """One row (c) for each labelled trial: its categories."""
    return labels.groupBy("trial_id").agg(F.collect_set("category_name").alias("c"))


def cooccurrence_of(counted: DataFrame) -> DataFrame:
    """Pairs of categories of one trial, from kinds(): pairs are made once for each different set, of at most 40 categories."""
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: a < b), lambda b: F.struct(a.alias("cat_a"), b.alias("cat_b")))))
    return counted.select("n", F.explode(pairs).alias("p")).groupBy("p.cat_a", "p.cat_b").agg(F.sum("n").alias("co_occurrences"))


def cooccurrence(labels: DataFrame) -> DataFrame:
    """Pairs of categories of one trial, from rows of labels."""
    return cooccurrence_of(kinds(category_sets(labels)))


def phi_matrix(labels: DataFrame, trials: DataFrame) -> DataFrame:
    """phi_of() of rows of labels."""
    return phi_of(kinds(category_sets(labels)), trials)


def phi_of(counted: DataFrame, trials: DataFrame) -> DataFrame:
    """How many trials have a category on the diagonal, phi coefficients of six places off it, for all pairs of the categories that occur.

    Trials without a category count among those that have neither of two.
    """
    spark = counted.sparkSession
    n = trials.agg(F.count(F.lit(1)).alias("trials"))
    single = counted.select("n", F.explode("c").alias("category_name")).groupBy("category_name").agg(F.sum("n").alias("k"))
    # at most 40 categories: the taxonomy bounds both sides of this grid
    known = F.broadcast(single.join(F.broadcast(taxonomy.table(spark).select(F.col("name").alias("category_name"))), "category_name"))
    grid = known.select(F.col("category_name").alias("a"), F.col("k").alias("ka")).crossJoin(known.select(F.col("category_name").alias("b"), F.col("k").alias("kb"))).crossJoin(F.broadcast(n))
    both = cooccurrence_of(counted)
    both = both.select(F.col("cat_a").alias("a"), F.col("cat_b").alias("b"), F.col("co_occurrences").alias("k")).unionByName(both.select(F.col("cat_b").alias("a"), F.col("cat_a").alias("b"), F.col("co_occurrences").alias("k")))
    value = F.when(F.col("a") == F.col("b"), F.col("ka").cast("double")).otherwise(F.round(phi(F.col("trials"), F.col("ka"), F.col("kb"), F.coalesce("k", F.lit(0))), 6))
    return grid.join(both, ["a", "b"], "left").select("a", "b", value.alias("value"))
