"""Mixing sources to target weights along a time-varying curriculum, with DataFrame operations only.

Every source has a weight schedule over training progress 0..1, linear between knots. Its integral is the source's
weight; the weights share out the words of the mix, up to ``most`` times a source's size, the excess going to the
others by weight. Within a source, documents follow each other in the order of a hash of their id; the source's
cumulative demand, inverted, gives each of them its training position, and the mix is range-sorted by position.

Running totals are taken in two levels (hash buckets of a source, then rows of a bucket), so no task sees a whole
source. Only small rows move; texts stay where they are, except where a caller joins them.

Defined cases: a null text has size 0; a null source is a source of its own, the last; documents of size 0 are never
taken and have no position; rows that repeat an id count each by itself, in the order of their sizes; without any word
all targets are 0; equal positions go by doc_id; huge texts are counted whole and never cut by the mix itself; other
columns go along whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

#: (progress, weight) knots by place of the source in code-point order, repeating; the integrals are 3, 1 and 2.
SCHEDULES = (((0.0, 4.5), (0.5, 3.0), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)))


def integrals(knots) -> list[float]:
    """The integral up to each knot."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def inverse(knots, y: str) -> str:
    """SQL for the progress at which the integral of a schedule is y."""
    area = integrals(knots)
    sql = ""
    for k, ((t0, w0), (t1, w1)) in enumerate(zip(knots, knots[1:])):
        rise = f"({y} - {area[k]!r}D)"
        slope = (w1 - w0) / (t1 - t0)
        x = f"{t0!r}D + 2.0D * {rise} / ({w0!r}D + sqrt(greatest(0.0D, {w0 * w0!r}D + {2 * slope!r}D * {rise})))"
        sql += f"WHEN {y} < {area[k + 1]!r}D THEN {x} " if k + 2 < len(knots) else f"ELSE {x} "
    return f"CASE {sql}END" if len(knots) > 2 else sql.removeprefix("ELSE ")


def sized(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(*keep, F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))


def targets(rows: DataFrame, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, its place k among the schedules, and target: one row for each source."""
    weights = [integrals(s)[-1] for s in schedules]
    src = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("k", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(schedules))
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("k") + 1)).withColumn("cap", most * F.col("source_size"))
    full = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    # The water level if this source and those that fill up later share what those that fill up before leave.
    before = F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumn("level", (share * F.sum("source_size").over(every) - before) / after).withColumn("order", F.row_number().over(full))
    holds = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("order", "level"))
    src = src.withColumn("level", F.min(holds).over(every)["level"])
    return src.select("source", "source_size", "k", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def placed(rows: DataFrame, id_column: str = "doc_id", schedules=SCHEDULES, share: float = 1.5, most: float = 2.0, digits: int = 3) -> DataFrame:
    """Adds source_size, k, target and start: how many words of its source come before a document."""
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))).withColumn("b", F.substring("h", 1, digits))
    sums = rows.groupBy("source", "b").agg(F.sum("size").alias("n"))
    offsets = sums.select("source", "b", (F.sum("n").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    src = base.written(targets(rows, schedules, share, most), "targets")
    src = base.small(src.withColumnRenamed("source", "s0"), src.count(), 50_000)
    offsets = offsets.join(src, _same("source", "s0")).drop("s0").withColumnsRenamed({"source": "s1", "b": "b1"})
    inside = F.sum("size").over(Window.partitionBy("source", "b").orderBy("h", id_column, "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("inside", inside)
    out = rows.join(offsets, _same("source", "s1") & (F.col("b") == F.col("b1")))
    return out.withColumn("start", F.col("inside") + F.col("base")).drop("h", "b", "s1", "b1", "inside", "base")


def copies(rows: DataFrame, schedules=SCHEDULES, most: float = 2.0, whole: bool = False) -> DataFrame:
    """Adds copies: for each pass over the source that takes some of the document, (pass, words, position).

    whole: a document is taken whole or not at all, as the nearer of both; otherwise the last one of a source is cut.
    """
    goal = "floor(target)"
    passes = []
    for p in range(int(-(-most // 1))):
        lo = f"(start + {p} * source_size)"
        words = f"(CASE WHEN 2 * {lo} + size < 2 * {goal} THEN size ELSE 0L END)" if whole else f"greatest(0L, least(size, {goal} - {lo}))"
        y = "(" + f"least(1.0D, {lo} / nullif(target, 0.0D))" + " * {})"
        cases = " ".join(f"WHEN {k} THEN {inverse(s, y.format(repr(integrals(s)[-1]) + 'D'))}" for k, s in enumerate(schedules))
        passes.append(f"named_struct('pass', {p}, 'words', cast({words} AS BIGINT), 'position', floor(1e6D * (CASE k {cases} END) + 0.5D) / 1e6D)")
    return rows.withColumn("copies", F.expr(f"filter(array({', '.join(passes)}), c -> c.words > 0)"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the documents that it takes, whole, once for each pass, range-sorted by training position.

    Rows that share a doc_id are taken together, with the most passes of any of them.
    """
    rows = base.written(sized(docs, ("doc_id", "source")), "sizes")
    plan = copies(placed(rows), whole=True).select(F.col("doc_id").alias("takes"), F.inline("copies"))
    plan = plan.groupBy("takes", "pass").agg(F.min("position").alias("position"))
    plan = plan.groupBy("takes").agg(F.collect_list(F.struct("pass", "position")).alias("copies"))
    out = docs.select("doc_id", F.struct(*docs.columns).alias("row")).join(plan, F.col("doc_id").eqNullSafe(F.col("takes")))
    return out.select("doc_id", "row", F.inline("copies")).orderBy("position", "doc_id", "pass").select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and position of each document, in the order of their positions."""
    docs = base.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    rows = base.written(sized(docs, ("doc_id", "source")), "sizes")
    out = copies(placed(rows))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    out = out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.get("copies", F.lit(0))["position"].alias("position"))
    return out.orderBy("position", "doc_id")


def duck(expression: str) -> str:
    """The same arithmetic in the dialect of the check database."""
    import re

    return re.sub(r"(\d+(?:\.\d+)?(?:e-?\d+)?)D\b", r"\1::DOUBLE", expression)


def _op2_sql() -> str:
    at = lambda p: f"(start + {p} * source_size)"
    words = lambda p: f"greatest(0, least(size, floor(target)::BIGINT - {at(p)}))"
    y = "(least(1.0D, {} / target) * {})"
    spot = lambda p: "floor(1e6D * (CASE k " + " ".join(f"WHEN {k} THEN {inverse(s, y.format(at(p), repr(integrals(s)[-1]) + 'D'))}" for k, s in enumerate(SCHEDULES)) + " END) + 0.5D) / 1e6D"
    return f"""
WITH d AS (
  SELECT doc_id::BIGINT AS doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS o FROM w),
g AS (SELECT arg_min(level, o) AS level FROM l WHERE level <= cap / weight),
t AS (SELECT source, source_size, k, least(cap, coalesce((SELECT level FROM g) * weight, cap)) AS target FROM l),
p AS (
  SELECT d.*, t.source_size, t.k, t.target,
    (sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, {words(0)} AS w0, {words(1)} AS w1 FROM p)
SELECT doc_id, size, source_size, target, (w0 + w1)::BIGINT AS taken,
  CASE WHEN w0 > 0 THEN {duck(spot(0))} WHEN w1 > 0 THEN {duck(spot(1))} END AS position
FROM q"""


OP2_SQL = _op2_sql()
