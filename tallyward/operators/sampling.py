"""Partitions of examples among clients, samples of clients, and splits, all seeded and reproducible."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import order_key


def ranked(df: DataFrame, seed, id_column: str, digits: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds rn, the place (from 1) of each row in the random order of a seed, within keys.

    In two levels, so that no task sorts all rows of a key: places of buckets by the first digits of the random order,
    then of rows within a bucket.
    """
    keyed = df.withColumn("_k", order_key(seed, id_column)).withColumn("_b", F.substring("_k", 1, digits))
    sizes = keyed.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*keys).orderBy("_b") if keys else Window.orderBy("_b")  # 16^digits rows at most
    before = F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    offsets = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_b1"), before.alias("_o"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_k", id_column))
    on = F.col("_b") == F.col("_b1")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    placed = keyed.withColumn("_r", inside).join(offsets if keys else F.broadcast(offsets), on)
    return placed.withColumn("rn", F.col("_r") + F.col("_o")).drop("_k", "_b", "_r", "_o", "_b1", *[f"_{k}" for k in keys])


def iid(examples: DataFrame, clients: int, seed, total: int | None = None) -> DataFrame:
    """(client_id, example_id): total/clients examples each, disjoint; the remainder is left out."""
    m = (examples.count() if total is None else total) // clients
    rows = ranked(examples.select("example_id"), seed, "example_id").where(F.col("rn") <= m * clients)
    return rows.select(((F.col("rn") - 1) / F.lit(max(m, 1))).cast("long").alias("client_id"), "example_id")


def one_per_user(examples: DataFrame, seed) -> DataFrame:
    """A random permutation: user rn - 1 gets one example."""
    return ranked(examples.select("example_id"), seed, "example_id").select((F.col("rn") - 1).alias("client_id"), "example_id")


def sampled_clients(clients: DataFrame, size: int, seed, keys: tuple[str, ...] = ()) -> DataFrame:
    """size clients (for each of keys) without replacement: the first in the random order."""
    if not keys:
        return ranked(clients, seed, "client_id").where(F.col("rn") <= size).drop("rn")
    w = Window.partitionBy(*keys).orderBy(order_key(seed, *keys, "client_id"), "client_id")
    return clients.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r")


def next_roster(clients: DataFrame, uploads: DataFrame, seed) -> DataFrame:
    """(round, client_id) of the round after the last one uploaded: as many clients as sent that one."""
    last = uploads.agg(F.max("round")).first()[0]
    if last is None:
        return clients.limit(0).select(F.lit(0).cast("long").alias("round"), "client_id")
    size = uploads.where(F.col("round") == last).agg(F.count_distinct("client_id")).first()[0]
    return sampled_clients(clients, size, seed).select(F.lit(last + 1).cast("long").alias("round"), "client_id")


def prepared(examples: DataFrame, size: int, ratio: float, folder: str, seed) -> None:
    """Writes a train part of about size examples and a test part of int(ratio * size), stratified and disjoint, with the
    test part's random order; does nothing if the folder has them."""
    n = examples.groupBy(F.col("label").alias("_l")).agg(F.count("*").alias("_n"))
    total = examples.count()
    if total < (1 + ratio) * size:
        raise ValueError("too few examples")
    part = lambda k: F.floor(F.col("_n") * F.lit(float(k)) / total + 0.5)
    rows = ranked(examples, seed, "example_id", keys=("label",)).join(n, F.col("label").eqNullSafe(F.col("_l")))
    rows = rows.withColumn("part", F.when(F.col("rn") <= part(size), "train").when(F.col("rn") <= part(size) + part(int(ratio * size)), "test")).where("part is not null").drop("rn", "_l", "_n")
    test = ranked(rows.where("part = 'test'"), f"{seed}t", "example_id").withColumnRenamed("rn", "place")
    rows.where("part = 'train'").withColumn("place", F.lit(0).cast("long")).unionByName(test).write.mode("ignore").partitionBy("part").parquet(folder)


def loaded(spark, folder: str, size: int, ratio: float) -> DataFrame:
    """(part, example_id, label): what is there, of the test part the first int(ratio * size) in its order."""
    rows = spark.read.parquet(folder)
    return rows.where((F.col("part") == "train") | (F.col("place") <= int(ratio * size))).select("part", "example_id", "label")


def fraction_of_clients(clients: DataFrame, fraction: float, seed, total: int) -> DataFrame:
    """At least one client, else the truncated fraction."""
    return sampled_clients(clients, max(int(fraction * total), 1), seed)


def positional_split(owned: DataFrame, share: float = 0.9) -> DataFrame:
    """Adds part: the first int(share * n) examples of each client train, the rest test."""
    w = Window.partitionBy("client_id")
    n = F.count("*").over(w)
    return owned.withColumn("part", F.when(F.row_number().over(w.orderBy("example_id")) <= F.floor(n * F.lit(share)), "train").otherwise("test"))


def stratified(examples: DataFrame, n: int, labels: int, seed, capped: bool = True) -> DataFrame:
    """n // labels examples of each label at random; fewer of a smaller label unless capped is off, which is an error."""
    each = n // labels
    if each < 1:
        raise ValueError("fewer examples asked for than there are labels")
    if not capped and examples.groupBy("label").count().where(F.col("count") < each).head(1):
        raise ValueError("a label has too few examples")
    w = Window.partitionBy("label").orderBy(order_key(seed, "example_id"), "example_id")
    return examples.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= each).drop("_r")


def stratified_split(examples: DataFrame, test_share: float, seed) -> DataFrame:
    """Adds part: of each label, the first floor(share * n + 0.5) at random test, the rest train."""
    n = examples.groupBy(F.col("label").alias("_l")).agg(F.count("*").alias("_n"))  # a row for each label
    rows = ranked(examples, seed, "example_id", keys=("label",)).join(n, F.col("label").eqNullSafe(F.col("_l")))
    return rows.withColumn("part", F.when(F.col("rn") <= F.floor(F.col("_n") * F.lit(test_share) + 0.5), "test").otherwise("train")).drop("rn", "_l", "_n")


def minibatches(owned: DataFrame, size: int, seed, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Adds batch_no, in random order within each of keys; a short last batch stays."""
    rows = ranked(owned, seed, "example_id", keys=keys)
    return rows.withColumn("batch_no", ((F.col("rn") - 1) / size).cast("long")).drop("rn")


def shards(examples: DataFrame, size: int, seed) -> DataFrame:
    """Adds shard: consecutive runs of ``size`` examples in the order of their labels.

    Places come from label counts plus places within a label, which come in two levels; no task sorts a whole label.
    """
    n = examples.groupBy("label").count()
    before = F.sum("count").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")  # a row for each label
    offsets = n.select("label", before.alias("_o"))
    rows = ranked(examples, seed, "example_id", keys=("label",)).join(offsets, "label")
    return rows.withColumn("shard", ((F.col("rn") + F.col("_o") - 1) / size).cast("long")).drop("rn", "_o")


def running(df: DataFrame, order: str, value: str, name: str, run: int = 4096) -> DataFrame:
    """Adds the running sum of a value in the order of distinct whole numbers: over runs of them, then within each."""
    df = df.withColumn("_run", F.floor(F.col(order) / run))
    sums = df.groupBy("_run").agg(F.sum(value).alias("_s"))  # a row for each run
    offsets = sums.select(F.col("_run").alias("_q"), (F.sum("_s").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_o"))
    inside = F.sum(value).over(Window.partitionBy("_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_i", inside).join(offsets, F.col("_run") == F.col("_q")).withColumn(name, F.col("_i") + F.col("_o")).drop("_run", "_q", "_i", "_o")


def unequal(examples: DataFrame, clients: int, shard_size: int, seed, most: int = 30, total: int | None = None) -> DataFrame:
    """(client_id, example_id): label-sorted shards dealt in random order, 1..most weights scaled to the number of shards.

    A client's shards end at the rounded cumulative weight, so all are dealt and the order of clients decides nothing
    else; the client with the least weight takes nothing extra, since nothing is left over.
    """
    spark = examples.sparkSession
    rows = shards(examples.select("example_id", "label"), shard_size, seed)
    count = ((examples.count() if total is None else total) + shard_size - 1) // shard_size
    weight = spark.range(clients).select(F.col("id").alias("client_id"), (F.conv(F.substring(order_key(f"{seed}w", "id"), 1, 8), 16, 10).cast("long") % most + 1).alias("w"))
    weight = running(weight, "client_id", "w", "run")
    end = lambda c: F.floor(c * F.lit(count) / F.col("all") + 0.5)
    bounds = weight.join(F.broadcast(weight.agg(F.sum("w").alias("all")))).select("client_id", end(F.col("run") - F.col("w")).alias("lo"), end(F.col("run")).alias("hi"))
    places = bounds.where("hi > lo").select("client_id", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))).alias("rn"))
    dealt = ranked(spark.range(count), f"{seed}s", "id").withColumnRenamed("id", "shard")
    owner = dealt.join(places, "rn").select("shard", "client_id")
    return rows.join(owner, "shard").select("client_id", "example_id")


def deal_segments(pools: list[tuple[int, int]], clients: int, labels_each: int, seed: int, vary: bool = False) -> list[tuple[int, int, int, int]]:
    """(client, label, first, size): consecutive pieces of each label's shuffled pool, dealt client by client.

    A client draws labels_each (or 1..labels_each) labels of those still available and gets a shard of each. A pool
    with less than a shard but more than half gives what it has and is done; otherwise the first other label, in
    ascending order, with a full shard, or with over half of one, steps in; otherwise the short piece goes out.
    A piece is never given twice.
    """
    import random

    rng = random.Random(seed)
    size, used = dict(pools), dict.fromkeys(dict(pools), 0)
    draws = [rng.randint(1, labels_each) if vary else labels_each for _ in range(clients)]
    shard = max(1, sum(size.values()) // max(1, sum(draws)))
    available = sorted(size)
    out = []

    def give(client: int, label: int) -> int:
        n = min(shard, size[label] - used[label])
        if n:
            out.append((client, label, used[label], n))
            used[label] += n
        return n

    for client in range(clients):
        drawn = rng.sample(available, draws[client]) if len(available) > draws[client] else list(available)
        for label in drawn:
            left = size[label] - used[label]
            if left >= shard:
                give(client, label)
            elif 2 * left > shard:
                give(client, label)
                available = [x for x in available if x != label]
            else:
                rest = {x: size[x] - used[x] for x in available}
                other = next((x for x in sorted(rest) if rest[x] >= shard or 2 * rest[x] > shard), None)
                if other is None:
                    give(client, label)
                    available = [x for x in available if x != label]
                elif give(client, other) < shard:
                    available = [x for x in available if x != other]
    return out


def noniid(examples: DataFrame, clients: int, labels_each: int, seed: int, vary: bool = False) -> DataFrame:
    """(client_id, example_id) with few labels for each client: segments are dealt on label counts, rows joined to them."""
    spark = examples.sparkSession
    pools = [(r["label"], r["count"]) for r in examples.groupBy("label").count().orderBy("label").collect()]  # a row for each label
    segments = spark.createDataFrame(deal_segments(pools, clients, labels_each, seed, vary), "client_id long, label long, first long, size long")
    rows = ranked(examples.select("example_id", F.col("label").cast("long").alias("label")), seed, "example_id", keys=("label",)).withColumn("place", F.col("rn") - 1)
    hit = (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("size"))
    return rows.join(segments, "label").where(hit).select("client_id", "example_id")


def label_sets(owned: DataFrame) -> DataFrame:
    """(client_id, labels)."""
    return owned.groupBy("client_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def federated(examples: DataFrame, distribution: str, clients: int, seed, labels_each: int = 2, vary: bool = False, shard_size: int = 50) -> tuple[DataFrame, DataFrame]:
    """Examples (example_id, label) dealt among clients by the named distribution: (client_id, example_id, label), and each
    client's label set. iid, noniid (few labels for each client), unequal (shards of label-sorted examples) or one_per_user."""
    if distribution == "iid":
        owner = iid(examples, clients, seed)
    elif distribution == "noniid":
        owner = noniid(examples, clients, labels_each, seed, vary)
    elif distribution == "unequal":
        owner = unequal(examples, clients, shard_size, seed)
    elif distribution == "one_per_user":
        owner = one_per_user(examples, seed)
    else:
        raise ValueError(f"unknown distribution {distribution!r}")
    owned = owner.join(examples, "example_id").select("client_id", *examples.columns)
    return owned, label_sets(owned)
