"""Client-side shaping of updates: flat layouts, differences, top-k, clipping, multi-hot sets, rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import micro

CLIENT = ("fl_id", "round", "client_id")


def top_k(updates: DataFrame, k: int, keys: tuple[str, ...] = CLIENT) -> DataFrame:
    """The k largest coordinates of each client by magnitude, ties to the smaller index, with their rank.

    Each task keeps k rows of a client before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.abs("value").desc(), "idx")
    return updates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def expanded_k(k: int, r: float) -> int:
    """The size of a top-k set that index privacy widens by a share r."""
    return k + int(k * r)


def difference(local: DataFrame, base: DataFrame) -> DataFrame:
    """local minus base, by index; an index that base lacks counts as 0."""
    b = base.select(F.col("idx").alias("_i"), F.col("value").alias("_v"))
    return local.join(b, F.col("idx") == F.col("_i"), "left").withColumn("value", F.col("value") - F.coalesce("_v", F.lit(0.0))).drop("_i", "_v")


def norms(updates: DataFrame, keys: tuple[str, ...] = CLIENT) -> DataFrame:
    """The squared l2 norm of each client's update, as a fixed-point sum."""
    return updates.groupBy(*keys).agg((F.sum(micro(F.col("value") * F.col("value"))) / F.lit(1e6)).alias("square"))


def clip_factor(square: Column, bound: float, slack: float = 0.0) -> Column:
    """min(1, bound / (norm + slack)); a zero norm leaves the update alone."""
    return F.least(F.coalesce(F.try_divide(F.lit(bound), F.sqrt(square) + slack), F.lit(1.0)), F.lit(1.0))


def clipped(updates: DataFrame, bound: float, keys: tuple[str, ...] = CLIENT, slack: float = 0.0) -> DataFrame:
    """Updates scaled to an l2 norm of at most bound."""
    n = norms(updates, keys)
    return updates.join(n, list(keys)).withColumn("value", F.col("value") * clip_factor(F.col("square"), bound, slack)).drop("square")


def learnable(layout: DataFrame) -> DataFrame:
    return layout.where(~F.col("is_buffer"))


def buffers(layout: DataFrame) -> DataFrame:
    return layout.where("is_buffer")


def ranges(layout: DataFrame) -> DataFrame:
    """(layer_pos, name, start, end) from the sizes of the learnable layers, in layer order."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    sized = learnable(layout).select("layer_pos", "name", size.alias("size"))
    end = F.sum("size").over(Window.orderBy("layer_pos").rowsBetween(Window.unboundedPreceding, 0))  # a row for each layer
    return sized.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))


def flattened(layers: DataFrame, layout: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Layer values (keys, name, values) as one vector (keys, idx, value) for each key."""
    spots = F.broadcast(learnable(layout).select("name", "start"))
    return layers.join(spots, "name").select(*keys, "start", F.posexplode("values").alias("p", "value")).select(*keys, (F.col("start") + F.col("p")).alias("idx"), "value")


def by_layer(vector: DataFrame, layout: DataFrame) -> DataFrame:
    """The layer and the place in it of each coordinate: a range join against the few layers."""
    spots = F.broadcast(learnable(layout).select("name", F.col("start").alias("_s"), F.col("end").alias("_e")))
    return vector.join(spots, (F.col("idx") >= F.col("_s")) & (F.col("idx") < F.col("_e"))).withColumn("place", F.col("idx") - F.col("_s")).drop("_s", "_e")


def recovered(vector: DataFrame, layout: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, name, values): the vector cut back into its layers."""
    cells = by_layer(vector, layout).groupBy(*keys, "name").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("c"))
    return cells.select(*keys, "name", F.transform("c", lambda x: x["value"]).alias("values"))


def multi_hot(indices: Column, d: int) -> Column:
    """An index set as d zeros and ones; repeats collapse, indices outside 0..d-1 are left out.

    Runs of zeros between the sorted indices are put together, so the work is d plus the size of the set.
    """
    inside = F.transform(F.array_sort(F.array_distinct(F.filter(indices, lambda x: (x >= 0) & (x < d)))), lambda x: x.cast("int"))
    pairs = F.arrays_zip(F.concat(F.array(F.lit(-1)), inside).alias("a"), F.concat(inside, F.array(F.lit(d))).alias("b"))
    runs = F.transform(pairs, lambda p: F.concat(F.array_repeat(F.lit(0), p["b"] - p["a"] - 1), F.array(F.lit(1))))
    return F.slice(F.flatten(runs), 1, d)  # without the mark of the end


def concatenated(observations: DataFrame, d: int) -> DataFrame:
    """Rounds side by side: index + round * d; a round without indices is d zeros, that is, no row."""
    return observations.withColumn("idx", F.col("idx") + F.col("round").cast("long") * d)


def participated(observations: DataFrame) -> DataFrame:
    """(client_id, rounds): the rounds in which a client sent anything."""
    return observations.groupBy("client_id").agg(F.array_sort(F.collect_set("round")).alias("rounds"))


def latest(observations: DataFrame, added: DataFrame) -> DataFrame:
    """Observations with those of added in place of theirs, by client and round."""
    kept = observations.join(added.select("client_id", "round").distinct(), ["client_id", "round"], "left_anti")
    return kept.unionByName(added)


def one_batch_apart(teacher: DataFrame) -> DataFrame:
    """For each label, the batches that every round has: only those can be put side by side."""
    last = teacher.groupBy("label", "round").agg(F.max("batch_no").alias("m")).groupBy("label").agg(F.min("m").alias("m"))
    return teacher.join(last, "label").where(F.col("batch_no") <= F.col("m")).drop("m")
