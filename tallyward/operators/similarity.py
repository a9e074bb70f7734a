"""What index sets reveal: Jaccard scores of clients against labels, inferred labels, and how often they are right."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def jaccard(target: DataFrame, teacher: DataFrame, per_round: bool = False) -> DataFrame:
    """(client_id[, round], label, common, either, score): a score for every client and label, 0 without overlap.

    A label is seen through the rounds that the client took part in, and rounds are merged into one set on each side
    (or each round stands for itself). What a label's indices are in a set of rounds is found once for each distinct set,
    however many clients share it; sizes and overlaps are counted by joins on the index, never set by set.
    """
    extra = ["round"] if per_round else []
    mine = target.select("client_id", *extra, "idx").distinct()
    sizes = mine.groupBy("client_id", *extra).agg(F.count("*").alias("n"))
    if per_round:
        group, seen = sizes.select("client_id", "round", F.col("round").alias("rounds")), teacher.select(F.col("round").alias("rounds"), "label", "idx").distinct()
    else:
        group = target.groupBy("client_id").agg(F.array_join(F.array_sort(F.collect_set("round")), ",").alias("rounds"))
        each = group.select("rounds").distinct().select("rounds", F.explode(F.split("rounds", ",").cast("array<long>")).alias("round"))
        seen = each.join(teacher, "round").select("rounds", "label", "idx").distinct()
    labels = seen.groupBy("rounds", "label").agg(F.count("*").alias("m"))
    common = mine.join(group, ["client_id", *extra]).join(seen, ["rounds", "idx"]).groupBy("client_id", *extra, "label").agg(F.count("*").alias("common"))
    out = sizes.join(group, ["client_id", *extra]).join(labels, "rounds").join(common, ["client_id", *extra, "label"], "left").fillna(0, ["common"])
    either = F.col("n") + F.col("m") - F.col("common")
    return out.select("client_id", *extra, "label", "common", either.alias("either"), F.try_divide(F.col("common").cast("double"), either.cast("double")).alias("score"))


def pair_jaccard(a, b):
    """Of two arrays as sets; null where both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def top_labels(scores: DataFrame, n: int = 1, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """The n labels of the highest scores, ties to the smaller label."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "label")
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(*keys, "label", "place")


def upper_cluster(scores: DataFrame, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """The labels of the upper of two clusters of a client's scores, by the best split of the sorted scores.

    The least sum of squares decides, ties to the lower split; equal scores can't be split and all are taken.
    """
    up = Window.partitionBy(*keys).orderBy("score", "label")
    whole = Window.partitionBy(*keys)
    s = scores.withColumn("q", F.floor(F.col("score") * 1e6 + 0.5).cast("long"))  # whole numbers: sums are exact
    s = s.withColumn("i", F.row_number().over(up)).withColumn("n", F.count("*").over(whole))
    s = s.withColumn("a", F.sum("q").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("t", F.sum("q").over(whole))
    # a split after row i: minus what it takes off the sum of squares, so the least is best
    gain = F.col("a") * F.col("a") / F.col("i").cast("double") + (F.col("t") - F.col("a")) * (F.col("t") - F.col("a")) / (F.col("n") - F.col("i")).cast("double")
    s = s.withColumn("gain", F.when((F.col("i") < F.col("n")) & (F.lead("q").over(up) > F.col("q")), gain))
    best = s.where("gain is not null").groupBy(*keys).agg(F.max_by("i", F.struct("gain", (-F.col("i")).alias("o"))).alias("cut"))
    return s.join(best, list(keys), "left").where(F.col("i") > F.coalesce("cut", F.lit(0))).select(*keys, "label")


def attack_metrics(inferred: DataFrame, top: DataFrame, truth: DataFrame, fixed: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, complete, hit, evaluated, missing, and their shares).

    inferred and top: (keys, client_id, label). With a fixed number of labels, a client whose true labels are fewer is
    missing and counts for no complete match; shares without anything to divide by are null.
    """
    sets = inferred.groupBy(*keys, "client_id").agg(F.array_sort(F.collect_set("label")).alias("guess"))
    real = truth.groupBy("client_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    first = top.groupBy(*keys, "client_id").agg(F.collect_set("label").alias("first"))
    rows = sets.join(first, [*keys, "client_id"], "left").join(real, "client_id")
    missing = F.lit(fixed) & (F.size("guess") > F.size("labels"))
    rows = rows.select(*keys, missing.alias("m"), (~missing & (F.col("guess") == F.col("labels"))).alias("c"), F.coalesce(F.arrays_overlap("first", "labels"), F.lit(False)).alias("h"))
    out = rows.groupBy(*keys).agg(F.count_if("c").alias("complete"), F.count_if("h").alias("hit"), F.count("*").alias("evaluated"), F.count_if("m").alias("missing"))
    out = out.withColumn("complete_share", F.try_divide(F.col("complete").cast("double"), (F.col("evaluated") - F.col("missing")).cast("double")))
    return out.withColumn("hit_share", F.try_divide(F.col("hit").cast("double"), F.col("evaluated").cast("double")))


def cumulative(observations: DataFrame, rounds: int) -> DataFrame:
    """Adds upto: each observation counts for its own round and all later ones."""
    return observations.withColumn("upto", F.explode(F.sequence(F.col("round").cast("int"), F.lit(rounds - 1))))


def infer(target: DataFrame, teacher: DataFrame, method: str = "jaccard", labels: int | None = None, d: int = 0, classes: int = 0, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, top label) of each client that has observations.

    method: jaccard, nn for a network trained on each round, or nn_single for one over all rounds; labels: how many, or
    None for the upper of two clusters.
    """
    if method == "jaccard":
        scores = jaccard(target, teacher)
    elif method in ("nn", "nn_single"):
        from .learn import attack_scores

        scores = attack_scores(target, teacher, d, classes, rounds=rounds, mode="rounds" if method == "nn" else "single")
    else:
        raise ValueError(f"unknown method {method!r}")
    chosen = top_labels(scores, labels).select("client_id", "label") if labels else upper_cluster(scores)
    return chosen, top_labels(scores, 1).select("client_id", "label")
