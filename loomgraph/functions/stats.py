"""Statistics of rankings and nulls: false discovery rates, AUROC and AUPRC, precision at k, empirical p-values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.running import running_sums
from loomgraph.session import stage


def benjamini_hochberg(df: DataFrame, p: str, groups: list[str], q: str = "q") -> DataFrame:
    """q-values within ``groups``; a null p has none and does not count. Ties share a rank, so their order does not matter.

    Distinct p-values are range-partitioned by group and value, so a large group spreads over several partitions: ranks add the
    rows of the group's partitions before, minima those of its partitions after.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(p).isNotNull()).groupBy(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)), F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    rows = stage(counts.repartitionByRange(parts, *keys, "_p").withColumn("_part", F.spark_partition_id()), "ranges")
    part = [*keys, "_part"]

    def joined(rows: DataFrame, per: DataFrame, columns: list[str]) -> DataFrame:
        """``per`` has a row for each group and partition."""
        right = per.select(*(F.col(k).alias(f"_j{k}") for k in part), *columns)
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_j{k}")) for k in part])
        return rows.join(right, same).drop(*(f"_j{k}" for k in part))

    whole, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*part).agg(F.sum("_c").alias("_s"))
    per = per.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).withColumn("_n", F.sum("_s").over(whole))
    rank = F.sum("_c").over(Window.partitionBy(*part).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    rows = joined(rows, per, ["_before", "_n"]).withColumn("_v", F.col("_p") * F.col("_n") / rank)
    rows = stage(rows.select(*part, "_p", "_v"), "ratios")
    after = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*part).agg(F.min("_v").alias("_s")).withColumn("_after", F.min("_s").over(after))
    low = F.min("_v").over(Window.partitionBy(*part).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0))
    rows = joined(rows, per, ["_after"]).withColumn(q, F.least(F.lit(1.0), low, F.col("_after")))
    same = reduce(Column.__and__, [F.col(p) == F.col("_p"), *(F.col(g).eqNullSafe(F.col(k)) for g, k in zip(groups, keys, strict=True))])
    return df.join(rows.select(*keys, "_p", q), same, "left").drop("_p", *keys)


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in its group, from 1, for groups whose rows fit a task."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def ranked_by_range(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The same for groups of any size: rows are range-partitioned by group and order, so a large group spreads over
    several partitions; its rows get their place in the partition plus the number of its rows before it. Only groups that
    span partitions have such a number, at most two a partition, so those are broadcast."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(df.repartitionByRange(parts, *groups, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    per = rows.groupBy(*groups, "_part").agg(F.count("*").alias("_c"))
    wide = per.groupBy(*groups).agg(F.collect_list(F.struct("_part", "_c")).alias("_parts")).filter(F.size("_parts") > 1)
    before = F.transform("_parts", lambda p: F.struct(p["_part"].alias("_part"), F.aggregate("_parts", F.lit(0).cast("long"), lambda a, q: a + F.when(q["_part"] < p["_part"], q["_c"]).otherwise(0)).alias("_before")))
    wide = wide.select(*(F.col(g).alias(f"_g_{g}") for g in groups), F.explode(before).alias("_b")).select(*(f"_g_{g}" for g in groups), F.col("_b._part").alias("_p"), F.col("_b._before").alias("_before"))
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    rows = rows.join(F.broadcast(wide), same, "left")
    place = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order)) + F.coalesce("_before", F.lit(0))
    return rows.withColumn(name, place.cast("int")).select(*df.columns, name)


def ranking_metrics(df: DataFrame, groups: list[str], relevant: Column, ks: tuple[int, ...] = (10, 20, 50), counts: DataFrame | None = None) -> DataFrame:
    """Per group of a ranked list (column ``rank``): n, n_relevant, precision, recall, enrichment and NDCG at each k,
    average precision and mean rank of the relevant.

    Precision divides by k even if the list is shorter. Without relevant items NDCG, AP and recall are 0, enrichment and
    mean rank null. Only relevant rows are put in order; the others are counted, or left out if ``counts`` (groups, n) says how
    many rows each list has.
    """
    counts = df.groupBy(*groups).agg(F.count("*").alias("n")) if counts is None else counts
    rows = df.filter(relevant).select(*groups, "rank")
    rows = rows.withColumn("_hits", F.row_number().over(Window.partitionBy(*groups).orderBy("rank")))
    aggs = [F.count("*").alias("n_relevant"), F.avg(F.col("_hits") / F.col("rank")).alias("ap"), F.avg("rank").alias("mean_rank")]
    for k in ks:
        top = F.col("rank") <= k
        aggs += [F.sum(F.when(top, 1).otherwise(0)).alias(f"_h{k}"), F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"_d{k}")]
    out = counts.join(rows.groupBy(*groups).agg(*aggs), groups, "left")
    out = out.fillna(0, ["n_relevant", *(f"_h{k}" for k in ks)]).fillna(0.0, ["ap", *(f"_d{k}" for k in ks)])
    columns = [*groups, "n", "n_relevant", "ap", "mean_rank"]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
        out = out.withColumn(f"p_at_{k}", F.col(f"_h{k}") / k)
        out = out.withColumn(f"recall_at_{k}", F.when(F.col("n_relevant") > 0, F.col(f"_h{k}") / F.col("n_relevant")).otherwise(0.0))
        out = out.withColumn(f"enrich_at_{k}", F.when(F.col("n_relevant") > 0, F.col(f"p_at_{k}") / (F.col("n_relevant") / F.col("n"))))
        out = out.withColumn(f"ndcg_at_{k}", F.when(F.col("n_relevant") > 0, F.col(f"_d{k}") / ideal).otherwise(0.0))
        columns += [f"{m}_at_{k}" for m in ("p", "recall", "enrich", "ndcg")]
    return out.select(*columns)


def roc_and_precision(scored: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row (n, positives, auroc, auprc) over a whole table: ties share a threshold. Null where one class is empty.
    Counts per distinct score are summed in order across range partitions, so no task sorts everything."""
    counts = scored.groupBy(F.col(score).alias("_s")).agg(F.sum(positive.cast("long")).alias("_pos"), F.count("*").alias("_all"))
    run = running_sums(counts, [F.desc("_s")], {"_tp": F.col("_pos"), "_seen": F.col("_all")})
    run = run.withColumn("_fp_before", F.col("_seen") - F.col("_all") - (F.col("_tp") - F.col("_pos")))
    negatives_here = F.col("_all") - F.col("_pos")
    totals = run.agg(
        F.sum("_all").alias("n"),
        F.sum("_pos").alias("positives"),
        F.sum(F.col("_pos") * (F.col("_fp_before") + negatives_here / 2)).alias("_above"),
        F.sum(F.col("_pos") * F.col("_tp") / F.col("_seen")).alias("_ap"),
    )
    negatives = F.col("n") - F.col("positives")
    both = (F.col("positives") > 0) & (negatives > 0)
    return totals.select("n", "positives", F.when(both, 1 - F.col("_above") / (F.col("positives") * negatives)).alias("auroc"), F.when(both, F.col("_ap") / F.col("positives")).alias("auprc"))


def pointwise_precision(scored: DataFrame, score: str, positive: Column, key: str = "node_id") -> DataFrame:
    """One row (n, positives, auprc): mean of hits by rank over the positives, of equal scores positives first."""
    order = [F.desc(score), F.desc("_y"), F.asc(key)]
    run = running_sums(scored.withColumn("_y", positive.cast("int")), order, {"_k": F.lit(1), "_hits": F.col("_y")})
    return run.agg(F.count("*").alias("n"), F.sum("_y").cast("long").alias("positives"), F.avg(F.when(F.col("_y") == 1, F.col("_hits") / F.col("_k"))).alias("auprc"))


def signal(scored: DataFrame, score: str, positive: Column, ks: tuple[int, ...] = (50, 100)) -> DataFrame:
    """One row: entropy of the scores, share of score on positives (localization), share of positives among the top k."""
    x = F.col(score)
    whole = scored.agg((-F.sum(F.when(x > 0, x * F.log(x)).otherwise(0.0))).alias("entropy"), F.sum(F.when(positive, x).otherwise(0.0)).alias("localization"))
    for k in ks:
        best = scored.orderBy(F.desc(score), "node_id").limit(k)  # a top-k report
        whole = whole.join(F.broadcast(best.agg((F.sum(positive.cast("int")) / k).alias(f"top{k}"))))
    return whole


def empirical(nulls: DataFrame, observed: DataFrame, key: str, limit: float = 10.0) -> DataFrame:
    """Per key: null_mean, null_sd (population), null_z, empirical_p = (1 + #null >= observed) / (1 + N), calibrated.

    Keys whose observed value exceeds ``limit`` times the null mean are not calibrated: p and z are null. A deviation of 0
    gives z = 0.
    """
    rows = nulls.join(observed, key)
    out = rows.groupBy(key, "observed").agg(F.count("*").alias("n"), F.avg("null").alias("null_mean"), F.stddev_pop("null").alias("null_sd"), F.sum(F.when(F.col("null") >= F.col("observed"), 1).otherwise(0)).alias("_ge"))
    calibrated = (F.col("null_mean") > 0) & (F.col("observed") / F.col("null_mean") <= limit)
    z = F.when(F.col("null_sd") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_sd")).otherwise(0.0)
    return out.select(key, "observed", "n", "null_mean", "null_sd", F.when(calibrated, z).alias("null_z"), F.when(calibrated, (1 + F.col("_ge")) / (1 + F.col("n"))).alias("empirical_p"), calibrated.alias("calibrated"))


def distribution(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """n, mean, sample deviation, minimum, quartiles and maximum of a value by group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), q.alias("_q"), F.max(value).alias("max"))
    return out.select(*groups, "n", "mean", "sd", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("p75"), "max")
