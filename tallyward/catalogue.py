"""Every query by name over the parquet tables, and the SQL that gives the same rows where SQL can.

Sums are taken in whole millionths and transcendental results rounded to six decimals, so that values agree exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import accounting, codec
from .functions.exact import Duck, laplace, order_key, rounded
from .model import advanced, checked, requests_checked, sample_size, started
from .operators import aggregate, learn, privacy, sampling, shaping, similarity
from .plans.rounds import timed
from .sources import fixtures as fx
from .streaming import rounds as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
D, K = fx.D, fx.K
S = fx.Duck


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def clients_of(df: DataFrame) -> int:
    return df.select("client_id").distinct().count()


def _mean_sql(source: str, name: str, d: str, n: str) -> str:
    return f"""WITH {source} SELECT s.i AS idx, coalesce(sum({Duck.micro('value')}), 0)::BIGINT * (1.0::DOUBLE / {n}) / 1e6::DOUBLE AS value
FROM (SELECT unnest(range({d})) AS i) s LEFT JOIN {name} u ON u.idx = s.i GROUP BY s.i"""


# Aggregation

DENSE = S.TOP
SPARSE_D = "(SELECT count(*) FROM part)"
SPARSE_N = "(SELECT count(DISTINCT client_id) FROM f2)"
DENSE_N = "(SELECT count(*) FROM embeddings)"


@query(_mean_sql(DENSE, "top", str(D), DENSE_N))
def secure_round_flagship(spark, sf):
    u = fx.dense_updates(spark, sf)
    return aggregate.mean(shaping.top_k(u, K), fx.table(spark, sf, "embeddings").count(), D, exact=True)


def _sparse(spark, sf, hint, **kw):
    u = fx.sparse_updates(spark, sf)
    return aggregate.mean(u, clients_of(u), fx.table(spark, sf, "part").count(), hint, exact=True, **kw)


def _top(spark, sf, hint, **kw):
    u = shaping.top_k(fx.dense_updates(spark, sf), K)
    return aggregate.mean(u, fx.table(spark, sf, "embeddings").count(), D, hint, exact=True, **kw)


_SPARSE_SQL = _mean_sql(S.F2, "f2", SPARSE_D, SPARSE_N)


@query(_SPARSE_SQL)
def agg_sparse_mean(spark, sf):
    return _sparse(spark, sf, "non_oblivious")


@query(_SPARSE_SQL)
def agg_batched_two_level(spark, sf):
    return _sparse(spark, sf, "optimized", batch=10)


@query(_SPARSE_SQL)
def agg_sorted_fold(spark, sf):
    return _sparse(spark, sf, "advanced")


@query(_mean_sql(DENSE, "top", str(D), DENSE_N))
def agg_cacheline_match(spark, sf):
    return _top(spark, sf, "baseline")


@query(_mean_sql(DENSE, "top", str(D), DENSE_N))
def agg_bubble_equivalent(spark, sf):
    return _top(spark, sf, "bubble")


@query(_mean_sql(DENSE, "top", str(D), DENSE_N))
def agg_oram_equivalent(spark, sf):
    return _top(spark, sf, "path_oram")


@query(_SPARSE_SQL)
def agg_with_dummies(spark, sf):
    d = fx.table(spark, sf, "part").count()
    counts = privacy.dummy_counts(spark.range(d).select(F.col("id").alias("idx")), d, 10, 100.0, 0.01, "dummy")
    extra = privacy.dummies(counts, privacy.laplace_threshold(d, 10, 100.0, 0.01)[1]).unionByName(spark.range(3).select((F.col("id") + d).alias("idx"), F.lit(0.0).alias("value")))
    return _sparse(spark, sf, "nips19", dummies=extra)


@query(f"WITH {S.F1} SELECT idx, sum({Duck.micro('value')})::BIGINT * (1.0::DOUBLE / count(*)) / 1e6::DOUBLE AS value FROM f1 GROUP BY idx")
def agg_dense_mean(spark, sf):
    return aggregate.dense_mean(fx.dense_updates(spark, sf), exact=True)


@query(f"WITH {S.F2}, t AS (SELECT sum({Duck.micro('value')})::BIGINT / 1e6::DOUBLE / {SPARSE_N}::DOUBLE AS s FROM f2 WHERE idx >= 0 AND idx < {SPARSE_D}) SELECT s AS sent, s AS held FROM t")
def agg_checksum(spark, sf):
    u = fx.sparse_updates(spark, sf)
    return aggregate.checksum(u, clients_of(u), fx.table(spark, sf, "part").count())


_NOISE = Duck.normal("dp", "idx")


@query(f"WITH m AS ({_mean_sql(DENSE, 'top', str(D), DENSE_N)}) SELECT idx, {Duck.rounded(f'value + {1.12 * 1.0 / 100!r}::DOUBLE * {_NOISE}')} AS value FROM m")
def agg_gaussian_dp(spark, sf):
    return privacy.gaussian(_top(spark, sf, "non_oblivious"), 1.12, 1.0, 100, "dp").select("idx", rounded("value").alias("value"))


@query(f"WITH {S.F3} SELECT round, idx, count(*) AS count FROM f3 GROUP BY ALL HAVING count(*) >= 5")
def index_counts(spark, sf):
    return aggregate.index_counts(fx.rounds(spark, sf), ("round",), 5).withColumn("round", F.col("round").cast("long"))


@query(f"""WITH {S.F3}, v AS (SELECT client_id, CASE WHEN value > 50 THEN idx % 10 ELSE round % 10 END AS winner FROM f3)
SELECT client_id, winner AS label, count(*) AS votes FROM v GROUP BY ALL""")
def one_vs_one_votes(spark, sf):
    r = fx.rounds(spark, sf)
    return aggregate.one_vs_one_votes(r.select("client_id", F.when(F.col("value") > 50, F.col("idx") % 10).otherwise(F.col("round").cast("long") % 10).alias("winner")))


_TRIALS = "(l_suppkey % 3)"


@query(f"""SELECT l_returnflag AS algorithm, 100::BIGINT AS num_of_parameters, 10::BIGINT AS num_of_sparse_parameters, 5::BIGINT AS num_of_clients,
{', '.join(f"avg(CASE WHEN {_TRIALS} > 0 THEN {e} END) AS {c}" for c, e in (('load_s', 'l_quantity'), ('decryption_s', 'l_linenumber::DOUBLE'), ('aggregation_s', 'l_quantity * 2'), ('total_s', 'l_quantity * 4')))},
count(*) FILTER ({_TRIALS} > 0) AS trials FROM lineitem GROUP BY 1""")
def bench_summary(spark, sf):
    line = fx.table(spark, sf, "lineitem")
    rows = line.select(F.col("l_returnflag").alias("algorithm"), F.lit(100).cast("long").alias("num_of_parameters"), F.lit(10).cast("long").alias("num_of_sparse_parameters"), F.lit(5).cast("long").alias("num_of_clients"), F.col("l_quantity").alias("load_s"), F.col("l_linenumber").cast("double").alias("decryption_s"), (F.col("l_quantity") * 2).alias("aggregation_s"), (F.col("l_quantity") * 4).alias("total_s"), (F.col("l_suppkey") % 3).alias("trial"))
    return aggregate.bench_summary(rows)


@query(f"""WITH {S.F3}, e AS (SELECT round, client_id, idx % 3 AS epoch, avg(value) AS v FROM (SELECT *, {Duck.micro('value')} AS value FROM f3) t(round, client_id, idx, raw, value) GROUP BY ALL),
c AS (SELECT round, client_id, avg(v) AS v FROM e GROUP BY ALL) SELECT round, {Duck.rounded('avg(v) / 1e6::DOUBLE')} AS value FROM c GROUP BY round""")
def mean_of_means(spark, sf):
    r = fx.rounds(spark, sf).select(F.col("round").cast("long").alias("round"), "client_id", (F.col("idx") % 3).alias("epoch"), F.floor(F.col("value") * 1e6 + 0.5).alias("value"))
    return aggregate.mean_of_means(r).select("round", rounded(F.col("value") / 1e6).alias("value"))


@query(f"WITH {S.F1}, m AS ({_mean_sql(DENSE, 'top', str(D), DENSE_N)}), b AS (SELECT idx, value FROM f1 WHERE client_id = 0) SELECT b.idx, b.value + m.value AS value FROM b JOIN m USING (idx)")
def apply_mean_update(spark, sf):
    base = fx.dense_updates(spark, sf).where("client_id = 0")
    return aggregate.applied(base, _top(spark, sf, "non_oblivious"))


@query(_mean_sql("f6 AS (SELECT c AS client_id, (j * 619 + ('0x' || substr(md5('13|' || c::VARCHAR), 1, 8))::BIGINT % 1000) % 1000 AS idx FROM (SELECT unnest(range(40)) AS c), (SELECT unnest(range(100)) AS j)), f7 AS (SELECT client_id, idx, (idx * 0.001::DOUBLE)::FLOAT::DOUBLE AS value FROM f6)", "f7", "1000", "40"))
def agg_generated_uploads(spark, sf):
    return aggregate.mean(fx.generated_uploads(spark, 40, 1000, 100), 40, 1000, exact=True)


# Shaping


@query(f"WITH {S.TOP} SELECT client_id, idx, value, rank FROM top")
def topk_per_client(spark, sf):
    return shaping.top_k(fx.dense_updates(spark, sf), K).select("client_id", "idx", "value", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {S.F1} SELECT client_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY abs(value) DESC, idx) AS r FROM f1) WHERE r <= {shaping.expanded_k(K, 0.5)}")
def topk_teacher_expanded(spark, sf):
    return shaping.top_k(fx.dense_updates(spark, sf), shaping.expanded_k(K, 0.5)).select("client_id", "idx")


_SQUARE = f"(sum({Duck.micro('value * value')}) OVER (PARTITION BY client_id)::BIGINT / 1e6::DOUBLE)"


@query(f"WITH {S.F1}, n AS (SELECT *, {_SQUARE} AS q FROM f1) SELECT client_id, idx, {Duck.rounded('value * CASE WHEN q = 0 THEN 1 ELSE least(1.0::DOUBLE, 0.5::DOUBLE / sqrt(q)) END')} AS value FROM n")
def l2_clip(spark, sf):
    return shaping.clipped(fx.dense_updates(spark, sf), 0.5).select("client_id", "idx", rounded("value").alias("value"))


@query(f"WITH {S.F1}, n AS (SELECT *, {_SQUARE} AS q FROM f1) SELECT client_id, idx, {Duck.rounded('value * least(1.0::DOUBLE, 0.5::DOUBLE / (sqrt(q) + 1e-6::DOUBLE))')} AS value FROM n")
def gradient_norm_clip(spark, sf):
    return shaping.clipped(fx.dense_updates(spark, sf), 0.5, slack=1e-6).select("client_id", "idx", rounded("value").alias("value"))


@query(f"WITH {S.F1}, base AS MATERIALIZED (SELECT i AS idx, embedding[i + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range({D})) AS i) WHERE vec_id = 0) SELECT a.client_id, a.idx, a.value - b.value AS value FROM f1 a JOIN base b USING (idx)")
def diff_from_global(spark, sf):
    u = fx.dense_updates(spark, sf)
    return shaping.difference(u, u.where("client_id = 0")).select("client_id", "idx", "value")


@query(f"WITH {S.F1}, {S.LAYOUT} SELECT client_id, name, list(value ORDER BY idx) AS values FROM f1 JOIN layout ON NOT is_buffer AND idx >= start AND idx < stop GROUP BY ALL")
def recover_layers(spark, sf):
    return shaping.recovered(fx.dense_updates(spark, sf), fx.layout(spark), ("client_id",))


@query(f"WITH {S.F1} SELECT client_id, idx, value FROM f1")
def flatten_layers(spark, sf):
    lay = fx.layout(spark)
    return shaping.flattened(shaping.recovered(fx.dense_updates(spark, sf), lay, ("client_id",)), lay, ("client_id",))


@query(f'WITH {S.LAYOUT} SELECT layer_pos, name, start, stop AS "end" FROM layout WHERE NOT is_buffer')
def index_ranges(spark, sf):
    return shaping.ranges(fx.layout(spark)).select("layer_pos", "name", "start", "end")


@query(f"WITH {S.LAYOUT} SELECT count(*) FILTER (NOT is_buffer) AS layers, count(*) FILTER (is_buffer) AS buffers, sum(CASE WHEN is_buffer THEN 0 ELSE stop - start END)::BIGINT AS parameters FROM layout")
def drop_buffers(spark, sf):
    lay = fx.layout(spark)
    return shaping.learnable(lay).agg(F.count("*").alias("layers"), F.sum(F.col("end") - F.col("start")).alias("parameters")).join(F.broadcast(shaping.buffers(lay).agg(F.count("*").alias("buffers")))).select("layers", "buffers", "parameters")


@query(f"WITH {S.TOP} SELECT client_id, i AS idx, (CASE WHEN t.idx IS NULL THEN 0 ELSE 1 END)::BIGINT AS hot FROM (SELECT vec_id AS client_id FROM embeddings) CROSS JOIN (SELECT unnest(range({D})) AS i) LEFT JOIN (SELECT client_id, idx FROM top) t USING (client_id) WHERE false UNION ALL SELECT e.vec_id, s.i, (EXISTS (SELECT 1 FROM top t WHERE t.client_id = e.vec_id AND t.idx = s.i))::BIGINT FROM embeddings e, (SELECT unnest(range({D})) AS i) s")
def multi_hot(spark, sf):
    sets = shaping.top_k(fx.dense_updates(spark, sf), K).groupBy("client_id").agg(F.collect_list("idx").alias("s"))  # K of a client
    return sets.select("client_id", F.posexplode(shaping.multi_hot(F.col("s"), D)).alias("idx", "hot")).select("client_id", F.col("idx").cast("long").alias("idx"), F.col("hot").cast("long").alias("hot"))


@query(f"WITH {S.F3} SELECT client_id, list_sort(list(DISTINCT idx + round * {D})) AS idx FROM f3 GROUP BY 1")
def concat_rounds_padded(spark, sf):
    return shaping.concatenated(fx.rounds(spark, sf), D).groupBy("client_id").agg(F.array_sort(F.collect_set("idx")).alias("idx"))


@query(f"WITH {S.F3} SELECT client_id, list_sort(list(DISTINCT round)) AS rounds FROM f3 GROUP BY 1")
def participation_rounds(spark, sf):
    return shaping.participated(fx.rounds(spark, sf)).select("client_id", F.col("rounds").cast("array<long>").alias("rounds"))


# Sampling and partitions


@query(f"WITH {S.F2} SELECT client_id FROM (SELECT client_id, row_number() OVER (ORDER BY {Duck.order_key('s', 'client_id')}, client_id) AS r FROM (SELECT DISTINCT client_id FROM f2)) WHERE r <= 30")
def sample_clients(spark, sf):
    return sampling.sampled_clients(fx.sparse_updates(spark, sf).select("client_id").distinct(), sample_size(100, 0.3), "s")


@query(f"""WITH {S.F3}, l AS (SELECT max(round) AS last FROM f3), n AS (SELECT count(DISTINCT client_id) AS n FROM f3, l WHERE round = last)
SELECT last + 1 AS round, client_id FROM (SELECT client_id, row_number() OVER (ORDER BY {Duck.order_key('s', 'client_id')}, client_id) AS r FROM (SELECT DISTINCT client_id FROM f3)), l, n WHERE r <= n""")
def round_roster_next(spark, sf):
    """The roster of the round after the last: as many clients as sent the last one."""
    r = fx.rounds(spark, sf).select(F.col("round").cast("long").alias("round"), "client_id")
    return sampling.next_roster(r.select("client_id").distinct(), r, "s")


# One request for each way that a request can be wrong, and what it is told.
_WRONG = ("ok", "unknown_job", "late_round", "early_round", "algorithm_mismatch", "size_mismatch", "batch_too_large", "roster_mismatch", "payload_mismatch")


@query(f"""WITH c AS (SELECT c_nationkey::BIGINT AS fl_id, list_sort(list(c_custkey)) AS client_ids FROM customer GROUP BY 1)
SELECT fl_id, (ARRAY{list(_WRONG)})[fl_id % {len(_WRONG)} + 1] AS status, CASE WHEN fl_id % {len(_WRONG)} = 1 THEN NULL WHEN fl_id % {len(_WRONG)} = 0 THEN 4 ELSE 3 END::INT AS next_round FROM c""")
def request_checks(spark, sf):
    """Jobs started twice (the second start counts), a request of each kind to them, and the round that each job is in then."""
    c = fx.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("fl_id")).agg(F.array_sort(F.collect_list("c_custkey")).alias("client_ids"))
    kind = F.col("fl_id") % len(_WRONG)
    starts = c.where(kind != 1).select("fl_id", "client_ids", F.lit(10).cast("long").alias("num_of_parameters"), F.lit(2).cast("long").alias("num_of_sparse_parameters"), F.lit(4).alias("aggregation_alg"), F.lit(2).alias("order"))
    old = starts.select("fl_id", F.array(F.lit(1).cast("long")).alias("client_ids"), F.lit(5).cast("long").alias("num_of_parameters"), F.lit(1).cast("long").alias("num_of_sparse_parameters"), F.lit(1).alias("aggregation_alg"), F.lit(1).alias("order"))
    jobs = started(None, old.unionByName(starts), "order").withColumn("round", F.lit(3))
    ids = F.when(kind == 7, F.slice("client_ids", 1, F.size("client_ids") - 1)).otherwise(F.col("client_ids"))
    asked = c.select(
        "fl_id", F.when(kind == 2, 2).when(kind == 3, 4).otherwise(3).alias("round"), ids.alias("client_ids"), F.when(kind == 5, 11).otherwise(10).cast("long").alias("num_of_parameters"), F.lit(2).cast("long").alias("num_of_sparse_parameters"),
        F.when(kind == 4, 1).otherwise(4).alias("aggregation_alg"), F.when(kind == 6, F.size(ids) + 1).otherwise(1).cast("long").alias("optimal_num_of_clients"), (F.size(ids) * 16 - F.when(kind == 8, 1).otherwise(0)).alias("bytes"),
    )
    seen = requests_checked(asked, jobs)
    after = advanced(jobs, seen).select(F.col("fl_id").alias("j"), F.col("round").alias("next_round"))
    return seen.join(after, F.col("fl_id") == F.col("j"), "left").select("fl_id", "status", "next_round")


def _rank(seed: str) -> str:
    return f"row_number() OVER (ORDER BY {Duck.order_key(seed, 'example_id')}, example_id)"


@query(f"WITH {S.F4}, n AS (SELECT count(*) // 7 AS m FROM f4) SELECT (r - 1) // m AS client_id, example_id FROM (SELECT example_id, {_rank('iid')} AS r FROM f4), n WHERE r <= m * 7")
def partition_iid(spark, sf):
    return sampling.iid(fx.examples(spark, sf), 7, "iid")


@query(f"WITH {S.F4} SELECT {_rank('one')} - 1 AS client_id, example_id FROM f4")
def one_per_user(spark, sf):
    return sampling.one_per_user(fx.examples(spark, sf), "one")


@query(f"WITH {S.F4} SELECT client_id, example_id, CASE WHEN row_number() OVER (PARTITION BY client_id ORDER BY example_id) <= floor(count(*) OVER (PARTITION BY client_id) * 0.9::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM f4")
def split_train_test(spark, sf):
    return sampling.positional_split(fx.examples(spark, sf)).select("client_id", "example_id", "part")


def _in_label(seed: str) -> str:
    return f"row_number() OVER (PARTITION BY label ORDER BY {Duck.order_key(seed, 'example_id')}, example_id)"


@query(f"WITH {S.F4} SELECT label, example_id FROM (SELECT *, {_in_label('str')} AS r FROM f4) WHERE r <= 15")
def stratified_attacker_sample(spark, sf):
    return sampling.stratified(fx.examples(spark, sf), 150, 10, "str").select("label", "example_id")


@query(f"WITH {S.F4} SELECT label, example_id, CASE WHEN {_in_label('spl')} <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE + 0.5::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM f4")
def stratified_split(spark, sf):
    return sampling.stratified_split(fx.examples(spark, sf), 0.2, "spl").select("label", "example_id", "part")


@query(f"""WITH {S.F4}, n AS (SELECT *, {_in_label('pur')} AS r, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM f4),
b AS (SELECT *, floor(n * 200.0::DOUBLE / total + 0.5) AS a, floor(n * 200.0::DOUBLE / total + 0.5) + floor(n * 100.0::DOUBLE / total + 0.5) AS z FROM n),
t AS (SELECT *, row_number() OVER (ORDER BY {Duck.order_key('purt', 'example_id')}, example_id) AS place FROM b WHERE r > a AND r <= z)
SELECT 'train' AS part, example_id, label FROM b WHERE r <= a UNION ALL SELECT 'test', example_id, label FROM t WHERE place <= 60""")
def prepared_split(spark, sf):
    """Written once, read back with less of the test part, in its order."""
    folder = stream.shared_folder(spark)
    for size in (200, 10):  # the second finds it there
        sampling.prepared(fx.examples(spark, sf).select("example_id", "label"), size, 0.5, folder, "pur")
    return sampling.loaded(spark, folder, 200, 0.3)


@query(f"WITH {S.F4} SELECT label, example_id, (row_number() OVER (PARTITION BY label ORDER BY {Duck.order_key('mb', 'example_id')}, example_id) - 1) // 16 AS batch_no FROM f4")
def minibatches(spark, sf):
    return sampling.minibatches(fx.examples(spark, sf), 16, "mb", ("label",)).select("label", "example_id", "batch_no")


@query(f"WITH {S.F4} SELECT client_id, list_sort(list(DISTINCT label)) AS labels FROM f4 GROUP BY 1")
def client_label_sets(spark, sf):
    return sampling.label_sets(fx.examples(spark, sf))


@query(f"""WITH {S.F4}, r AS (SELECT *, (row_number() OVER (ORDER BY label, {Duck.order_key('une', 'example_id')}, example_id) - 1) // 5 AS shard FROM f4),
n AS (SELECT (count(*) + 4) // 5 AS c FROM f4), w AS (SELECT id, ('0x' || substr({Duck.order_key('unew', 'id')}, 1, 8))::BIGINT % 30 + 1 AS w FROM (SELECT unnest(range(9)) AS id)),
b AS (SELECT id, floor(sum(w) OVER (ORDER BY id)::BIGINT * c::DOUBLE / sum(w) OVER ()::BIGINT + 0.5::DOUBLE) AS hi, floor((sum(w) OVER (ORDER BY id)::BIGINT - w) * c::DOUBLE / sum(w) OVER ()::BIGINT + 0.5::DOUBLE) AS lo FROM w, n),
s AS (SELECT id AS shard, row_number() OVER (ORDER BY {Duck.order_key('unes', 'id')}, id) AS rn FROM (SELECT unnest(range((SELECT c FROM n))) AS id))
SELECT b.id AS client_id, example_id FROM r JOIN s USING (shard) JOIN b ON rn > lo AND rn <= hi""")
def partition_unequal(spark, sf):
    return sampling.unequal(fx.examples(spark, sf), 9, 5, "une")


@query()
def partition_noniid(spark, sf):
    return sampling.noniid(fx.examples(spark, sf), 12, 3, 5)


# Protections and noise


def _extra(keys: str, sets: str, seed: str, r: float) -> str:
    steps = privacy.permutation_steps(D)
    part = lambda at: f"('0x' || substr({Duck.order_key(seed, keys)}, {at}, 8))::BIGINT"
    return f"""c AS (SELECT {keys}, floor(count(*) * {r!r}::DOUBLE) AS extra, list_extract({steps}, {part(1)} % {len(steps)} + 1) AS step, {part(9)} % {D} AS shift FROM {sets} GROUP BY {keys}),
free AS (SELECT {keys}, extra, j, (j * step + shift) % {D} AS idx FROM c, (SELECT unnest(range({D})) AS j) WHERE ({keys}, (j * step + shift) % {D}) NOT IN (SELECT ({keys}, idx) FROM {sets})),
added AS (SELECT {keys}, idx FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY j) AS q FROM free) WHERE q <= extra)"""


@query(f"WITH {S.TOP}, {_extra('client_id', 'top', 'ip', 0.5)} SELECT client_id, idx, true AS real FROM top UNION ALL SELECT client_id, idx, false FROM added")
def index_privacy(spark, sf):
    return privacy.index_privacy(shaping.top_k(fx.dense_updates(spark, sf), K), D, 0.5, "ip")


@query(f"WITH {S.TOP}, s AS (SELECT client_id % 20 AS round, client_id, idx FROM top) SELECT round, client_id, idx FROM s WHERE (round, idx) IN (SELECT (round, idx) FROM s GROUP BY round, idx HAVING count(*) >= 5)")
def k_anonymize(spark, sf):
    t = shaping.top_k(fx.dense_updates(spark, sf), K).select((F.col("client_id") % 20).alias("round"), "client_id", "idx")
    return privacy.k_anonymous(t, 5).select("round", "client_id", "idx")


@query(f"WITH {S.TOP} SELECT client_id, rank, idx // 8 AS idx FROM top")
def cacheline_ids(spark, sf):
    return privacy.cache_lines(shaping.top_k(fx.dense_updates(spark, sf), K)).select("client_id", F.col("rank").cast("long").alias("rank"), "idx")


_LAP, _LIM = privacy.laplace_threshold(1000, 10, 5.0, 0.01)
_LAP_SQL = Duck.laplace("lap", _LAP, "idx")


@query(f"SELECT idx, {Duck.rounded(_LAP_SQL)} AS noise FROM (SELECT unnest(range(1000)) AS idx)")
def laplace_noise(spark, sf):
    return spark.range(1000).select(F.col("id").alias("idx"), rounded(laplace("lap", _LAP, "id")).alias("noise"))


@query(f"SELECT idx, greatest(CASE WHEN abs(x) > {_LIM!r}::DOUBLE THEN ceil({_LIM!r}::DOUBLE)::BIGINT ELSE trunc({_LIM!r}::DOUBLE + ceil(x))::BIGINT END, 0)::BIGINT AS dummies FROM (SELECT idx, {_LAP_SQL} AS x FROM (SELECT unnest(range(1000)) AS idx))")
def dummy_counts(spark, sf):
    return privacy.dummy_counts(spark.range(1000).select(F.col("id").alias("idx")), 1000, 10, 5.0, 0.01, "lap").select("idx", "dummies")


@query(f"""WITH {S.F1}, z AS (SELECT *, {Duck.normal('ldp', 'client_id', 'idx')} AS z FROM f1),
s AS (SELECT client_id, sum({Duck.micro('value * value')})::BIGINT / 1e6::DOUBLE AS gg, sum({Duck.micro('z * z')})::BIGINT / 1e6::DOUBLE AS zz, sum({Duck.micro('z * value')})::BIGINT / 1e6::DOUBLE AS zg FROM z GROUP BY 1),
t AS (SELECT client_id, sign(zg) * CASE WHEN {Duck.uniform('ldpf', 'client_id')} < 0.5::DOUBLE + least(sqrt(gg), 1.0::DOUBLE) / 2.0::DOUBLE THEN 1 ELSE -1 END * CASE WHEN {Duck.uniform('ldpl', 'client_id')} > exp(1.9::DOUBLE) / (exp(1.9::DOUBLE) + 1) THEN -1 ELSE 1 END / sqrt(zz) AS turn FROM s)
SELECT client_id, idx, {Duck.rounded('z * turn')} AS value FROM z JOIN t USING (client_id)""")
def ldp_perturb(spark, sf):
    return privacy.ldp_perturbed(fx.dense_updates(spark, sf).select("client_id", "idx", "value"), 1.9, 1.0, "ldp").select("client_id", "idx", rounded("value").alias("value"))


@query(f"WITH {S.F1}, v AS (SELECT client_id, idx, value * 10 AS value FROM f1), n AS (SELECT client_id, sqrt(sum({Duck.micro('value * value')})::BIGINT / 1e6::DOUBLE) AS n FROM v GROUP BY 1) SELECT client_id, idx, {Duck.rounded('value / greatest(1.0::DOUBLE, n) * 2.5::DOUBLE')} AS value FROM v JOIN n USING (client_id)")
def l2_projection(spark, sf):
    v = fx.dense_updates(spark, sf).select("client_id", "idx", (F.col("value") * 10).alias("value"))
    return privacy.l2_projection(v, 2.5, ("client_id",)).select("client_id", "idx", rounded("value").alias("value"))


# What index sets reveal

_SCORES = (
    S.F5
    + """, rounds AS (SELECT DISTINCT client_id, round FROM target),
mine AS (SELECT DISTINCT client_id, idx FROM target), seen AS (SELECT DISTINCT client_id, label, idx FROM rounds JOIN teacher USING (round)),
n AS (SELECT client_id, count(*) AS n FROM mine GROUP BY 1), m AS (SELECT client_id, label, count(*) AS m FROM seen GROUP BY ALL),
c AS (SELECT client_id, label, count(*) AS c FROM seen JOIN mine USING (client_id, idx) GROUP BY ALL),
scores AS (SELECT client_id, label, coalesce(c, 0)::BIGINT AS common, (n + m - coalesce(c, 0))::BIGINT AS either, coalesce(c, 0)::DOUBLE / (n + m - coalesce(c, 0))::DOUBLE AS score FROM m JOIN n USING (client_id) LEFT JOIN c USING (client_id, label)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY score DESC, label) AS place FROM scores)"""
)


def _scored(spark, sf, per_round=False):
    target, teacher, truth = fx.attack_tables(spark, sf)
    return similarity.jaccard(target, teacher, per_round), truth


@query(f"WITH {_SCORES} SELECT * FROM scores")
def jaccard_scores(spark, sf):
    return _scored(spark, sf)[0]


@query(f"WITH {_SCORES} SELECT client_id, label, place FROM ranked WHERE place <= 3")
def infer_top_n(spark, sf):
    return similarity.top_labels(_scored(spark, sf)[0], 3).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_SCORES} SELECT client_id, label FROM ranked WHERE place = 1")
def infer_top1(spark, sf):
    return similarity.top_labels(_scored(spark, sf)[0], 1).select("client_id", "label")


_MEANS = """, q AS (SELECT client_id, label, floor(score * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT AS q, row_number() OVER w AS i, count(*) OVER (PARTITION BY client_id) AS n,
  sum(floor(score * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS a, sum(floor(score * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT) OVER (PARTITION BY client_id)::BIGINT AS t,
  lead(floor(score * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT) OVER w AS nx FROM scores WINDOW w AS (PARTITION BY client_id ORDER BY score, label)),
g AS (SELECT *, CASE WHEN i < n AND nx > q THEN a * a / i::DOUBLE + (t - a) * (t - a) / (n - i)::DOUBLE END AS gain FROM q),
cut AS (SELECT client_id, i AS cut FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY gain DESC, i) AS r FROM g WHERE gain IS NOT NULL) WHERE r = 1)"""


@query(f"WITH {_SCORES}{_MEANS} SELECT g.client_id, label FROM g LEFT JOIN cut USING (client_id) WHERE i > coalesce(cut, 0)")
def infer_two_means(spark, sf):
    return similarity.upper_cluster(_scored(spark, sf)[0])


def _metrics_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""gs AS (SELECT {k}client_id, list_sort(list(DISTINCT label)) AS guess, min(CASE WHEN place = 1 THEN label END) AS first FROM ranked WHERE place <= 2 GROUP BY {k}client_id),
rl AS (SELECT client_id, list_sort(list(DISTINCT label)) AS labels FROM truth GROUP BY 1),
j AS (SELECT *, len(guess) > len(labels) AS m FROM gs JOIN rl USING (client_id)),
r AS (SELECT {k}count(*) FILTER (NOT m AND guess = labels) AS complete, count(*) FILTER (list_contains(labels, first)) AS hit, count(*) AS evaluated, count(*) FILTER (m) AS missing FROM j {f'GROUP BY {keys}' if keys else ''})
SELECT *, complete::DOUBLE / nullif(evaluated - missing, 0)::DOUBLE AS complete_share, hit::DOUBLE / nullif(evaluated, 0)::DOUBLE AS hit_share FROM r"""


@query(f"WITH {_SCORES}, {_metrics_sql()}")
def attack_metrics(spark, sf):
    scores, truth = _scored(spark, sf)
    return similarity.attack_metrics(similarity.top_labels(scores, 2), similarity.top_labels(scores, 1), truth)


_ROUND_SCORES = (
    S.F5
    + """, n AS (SELECT client_id, round, count(*) AS n FROM target GROUP BY ALL), seen AS (SELECT client_id, round, label, idx FROM n JOIN teacher USING (round)),
m AS (SELECT client_id, round, label, count(*) AS m FROM seen GROUP BY ALL), c AS (SELECT client_id, round, label, count(*) AS c FROM seen JOIN target USING (client_id, round, idx) GROUP BY ALL),
scores AS (SELECT client_id, round, label, coalesce(c, 0)::DOUBLE / (n + m - coalesce(c, 0))::DOUBLE AS score FROM m JOIN n USING (client_id, round) LEFT JOIN c USING (client_id, round, label)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY client_id, round ORDER BY score DESC, label) AS place FROM scores)"""
)


@query(f"WITH {_ROUND_SCORES}, {_metrics_sql('round')}")
def attack_metrics_per_round(spark, sf):
    scores, truth = _scored(spark, sf, True)
    keys = ("client_id", "round")
    return similarity.attack_metrics(similarity.top_labels(scores, 2, keys), similarity.top_labels(scores, 1, keys), truth, keys=("round",))


@query(f"WITH {S.F5}, u AS (SELECT client_id, u.upto, idx FROM target t JOIN (SELECT unnest(range(3)) AS upto) u ON u.upto >= t.round) SELECT client_id, upto, count(DISTINCT idx) AS indices FROM u GROUP BY ALL")
def cumulative_rounds(spark, sf):
    target, _, _ = fx.attack_tables(spark, sf)
    return similarity.cumulative(target, 3).groupBy("client_id", F.col("upto").cast("long").alias("upto")).agg(F.countDistinct("idx").alias("indices"))


# Accounting

_SETTINGS = ((0.1, 1.12, 3, 0.1), (0.1, 1.12, 10, 0.1), (0.1, 1.12, 300, 1e-5), (0.3, 1.12, 5, 1e-4), (1.0, 50.0, 500, 1e-5), (0.1, 4.0, 300, 1e-5))


@query(f"""WITH o AS (SELECT unnest(range(2, 65)) AS a), t AS (
  SELECT a, i, coalesce((SELECT sum(ln((a - j)::DOUBLE) - ln((j + 1)::DOUBLE)) FROM (SELECT unnest(range(64)) AS j) WHERE j < i), 0)
    + i * ln(0.1::DOUBLE) + (a - i) * ln(0.9::DOUBLE) + (i * i - i) / (2::DOUBLE * 1.12::DOUBLE * 1.12::DOUBLE) AS x FROM o, (SELECT unnest(range(65)) AS i) WHERE i <= a),
m AS (SELECT a, max(x) AS m FROM t GROUP BY a)
SELECT a AS "order", {Duck.rounded('(any_value(m) + ln(sum(exp(x - m)))) / (a - 1)')} AS rdp FROM t JOIN m USING (a) GROUP BY a""")
def rdp_integer_orders(spark, sf):
    """The moment of integer orders with column expressions: a log-sum-exp over exploded terms."""
    t = spark.range(2, 65).select(F.col("id").alias("order"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id"))).alias("i"))
    steps = F.sequence(F.lit(0).cast("long"), F.col("i") - 1)
    choose = F.when(F.col("i") == 0, 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, j: a + F.log((F.col("order") - j).cast("double")) - F.log((j + 1).cast("double"))))
    x = choose + F.col("i") * F.log(F.lit(0.1)) + (F.col("order") - F.col("i")) * F.log(F.lit(0.9)) + (F.col("i") * F.col("i") - F.col("i")) / F.lit(2 * 1.12 * 1.12)
    t = t.withColumn("x", x)
    top = t.groupBy("order").agg(F.max("x").alias("m"))
    s = t.join(F.broadcast(top), "order").groupBy("order", "m").agg(F.sum(F.exp(F.col("x") - F.col("m"))).alias("s"))
    return s.select("order", rounded((F.col("m") + F.log("s")) / (F.col("order") - 1)).alias("rdp"))


def _table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


#: The Renyi moment of one step by direct integration over the Gaussian (the trapezoid rule at an eighth of its width, which converges
#: faster than any power), at every order and setting: an oracle that shares no series with the accountant.
_RDP = (
    "p AS (SELECT * FROM (VALUES " + ", ".join(f"({q!r}::DOUBLE, {s!r}::DOUBLE, {t}, {d!r}::DOUBLE)" for q, s, t, d in _SETTINGS) + ") p(q, sigma, steps, delta)), "
    f"o AS (SELECT unnest({accounting.ORDERS}::DOUBLE[]) AS a), "
    """g AS (SELECT *, -10 * sigma + i * sigma / 8 AS x FROM p, o, (SELECT unnest(range(4000)) AS i) WHERE q < 1 AND i <= 8 * a / sigma + 160),
t AS (SELECT *, -x * x / (2 * sigma * sigma) - ln(sigma * sqrt(2 * pi())) + a * ln(1 - q + q * exp((2 * x - 1) / (2 * sigma * sigma))) AS t FROM g),
m AS (SELECT q, sigma, steps, delta, a, max(t) AS m FROM t GROUP BY ALL),
r AS (SELECT t.q, t.sigma, t.steps, t.delta, t.a, t.steps * (any_value(m) + ln(sum(exp(t - m)) * t.sigma / 8)) / (t.a - 1) AS rdp FROM t JOIN m USING (q, sigma, steps, delta, a) GROUP BY t.q, t.sigma, t.steps, t.delta, t.a
  UNION ALL SELECT q, sigma, steps, delta, a, steps * a / (2 * sigma * sigma) FROM p, o WHERE q = 1)"""
)


@query(f'WITH {_RDP} SELECT q, sigma, steps::INT AS steps, a AS "order", {Duck.rounded("rdp")} AS rdp FROM r')
def rdp_full_grid(spark, sf):
    rows = [(q, s, t, a, r) for q, s, t, _ in _SETTINGS for a, r in zip(accounting.ORDERS, accounting.rdp(q, s, t))]
    return _table(spark, rows, "q double, sigma double, steps int, order double, rdp double").withColumn("rdp", rounded("rdp"))


@query(f"""WITH {_RDP}, e AS (SELECT *, CASE WHEN delta * delta + exp(-rdp) - 1 >= 0 THEN 0 ELSE rdp + ln(1 - 1 / a) - ln(delta * a) / (a - 1) END AS e FROM r)
SELECT q, sigma, steps::INT AS steps, delta, {Duck.rounded("greatest(0, min(e))")} AS epsilon, arg_min(a, e) AS "order" FROM e GROUP BY q, sigma, steps, delta""")
def privacy_spent_eps(spark, sf):
    rows = [(q, s, t, d, *accounting.epsilon(accounting.ORDERS, accounting.rdp(q, s, t), d)) for q, s, t, d in _SETTINGS]
    return _table(spark, rows, "q double, sigma double, steps int, delta double, epsilon double, order double").withColumn("epsilon", rounded("epsilon"))


@query(f"""WITH {_RDP}, e AS (SELECT q, sigma, steps, a, epsilon, least(0.5 * ln(1 - exp(-rdp)), (a - 1) * (rdp - epsilon + ln(1 - 1 / a)) - ln(a)) AS l FROM r, (SELECT unnest([0.5, 2.0]::DOUBLE[]) AS epsilon))
SELECT q, sigma, steps::INT AS steps, epsilon, {Duck.rounded("least(0, min(l))")} AS log_delta, arg_min(a, l) AS "order" FROM e GROUP BY q, sigma, steps, epsilon""")
def privacy_spent_delta(spark, sf):
    """The least delta, as its logarithm."""
    rows = [(q, s, t, e, *accounting.delta(accounting.ORDERS, accounting.rdp(q, s, t), e)) for q, s, t, _ in _SETTINGS for e in (0.5, 2.0)]
    return _table(spark, rows, "q double, sigma double, steps int, epsilon double, delta double, order double").select("q", "sigma", "steps", "epsilon", rounded(F.log("delta")).alias("log_delta"), "order")


@query("SELECT a::DOUBLE AS \"order\", a::DOUBLE * (SELECT sum(floor(log2(s)) + 1) FROM (VALUES (1), (7), (64), (100)) t(s)) / (2 * 4.0::DOUBLE * 4.0::DOUBLE) AS rdp FROM (SELECT unnest(range(2, 33)) AS a)")
def rdp_tree_restart(spark, sf):
    orders = [float(a) for a in range(2, 33)]
    return _table(spark, list(zip(orders, accounting.rdp_tree_restart(4.0, [1, 7, 64, 100], orders))), "order double, rdp double")


@query("SELECT a::DOUBLE AS \"order\", " + Duck.rounded("a * 10 / (2 * 4.0::DOUBLE) + a * 5 / (2 * 9.0::DOUBLE)") + " AS rdp FROM (SELECT unnest(range(2, 33)) AS a)")
def rdp_heterogeneous(spark, sf):
    rows = [(float(a), r) for q, s, t in ((1.0, 2.0, 10), (1.0, 3.0, 5)) for a, r in zip(range(2, 33), accounting.rdp(q, s, t, range(2, 33)))]
    return _table(spark, rows, "order double, r double").groupBy("order").agg(rounded(F.sum("r")).alias("rdp"))


_WITHOUT = [1.5, 2.0, 2.5, 3.0, 4.0, 8.0, 16.0, 32.0, 33.5, 300.0]
#: The bound for samples of fixed size; its even differences are integrals of (ratio - 1)^k over the Gaussian.
_WITHOUT_SQL = f"""WITH z AS (SELECT k, -11.2 + i * 0.14 AS z FROM (SELECT unnest(range(2, 36, 2)) AS k), (SELECT unnest(range(500)) AS i) WHERE i * 0.14 <= k + 22.4),
t AS (SELECT k, -z * z / 2.5088 - ln(1.12 * sqrt(2 * pi())) + k * ln(abs(exp((2 * z - 1) / 2.5088::DOUBLE) - 1)) AS t FROM z),
m AS (SELECT k, max(t) AS m FROM t GROUP BY k), d AS (SELECT k, any_value(m) + ln(sum(exp(t - m)) * 0.14) AS d FROM t JOIN m USING (k) GROUP BY k),
n AS (SELECT DISTINCT unnest([floor(a), ceil(a)])::BIGINT AS n FROM (SELECT unnest({_WITHOUT}::DOUBLE[]) AS a)),
j AS (SELECT n, j, lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.1::DOUBLE) AS c, ln(2) + j * (j - 1) / 2.5088::DOUBLE AS plain FROM n, (SELECT unnest(range(2, 301)) AS j) WHERE j <= n),
b AS (SELECT n, 0.0::DOUBLE AS x FROM n UNION ALL
  SELECT n, c + CASE WHEN j = 2 THEN least(ln(4) + ln(exp(2 / 2.5088::DOUBLE) - 1), 2 / 2.5088::DOUBLE + ln(2)) WHEN n > 256 THEN plain ELSE least(plain, ln(4) + (lo.d + hi.d) / 2) END
  FROM j LEFT JOIN d lo ON lo.k = 2 * (j // 2) LEFT JOIN d hi ON hi.k = 2 * ((j + 1) // 2)),
s AS (SELECT n, max(x) + ln(sum(exp(x - mx))) AS x FROM (SELECT *, max(x) OVER (PARTITION BY n) AS mx FROM b) GROUP BY n),
o AS (SELECT unnest({_WITHOUT}::DOUBLE[]) AS a)
SELECT a AS "order", {Duck.rounded("10 * ((1 - (a - floor(a))) * coalesce(lo.x, 0) + (a - floor(a)) * hi.x) / (a - 1)")} AS rdp FROM o LEFT JOIN s lo ON lo.n = floor(a) JOIN s hi ON hi.n = ceil(a)"""


@query(_WITHOUT_SQL)
def rdp_without_replacement(spark, sf):
    return _table(spark, list(zip(_WITHOUT, accounting.rdp_without_replacement(0.1, 1.12, 10, _WITHOUT))), "order double, rdp double").withColumn("rdp", rounded("rdp"))


_PARAMS = "(SELECT 0.02::DOUBLE * (i + 1) AS e, 10.0::DOUBLE * (i + 1) AS k FROM (SELECT unnest(range(20)) AS i))"


@query(f"SELECT {Duck.rounded('e')} AS epsilon, k AS steps, {Duck.rounded(f'k * e * e / 2 + sqrt(k) * e * sqrt(2 * ln(sqrt(k * {3.141592653589793!r}::DOUBLE / 2) * e / (1e-5::DOUBLE - k * 1e-8::DOUBLE)))')} AS total FROM {_PARAMS}")
def advanced_composition(spark, sf):
    rows = [(0.02 * (i + 1), 10.0 * (i + 1)) for i in range(20)]
    rows = [(e, k, accounting.advanced_composition(e, 1e-8, k, 1e-5)) for e, k in rows]
    return _table(spark, rows, "epsilon double, steps double, total double").select(rounded("epsilon").alias("epsilon"), "steps", rounded("total").alias("total"))


@query(f"WITH p AS (SELECT e * 5 AS e FROM {_PARAMS}), x AS (SELECT e, 8 * sqrt(exp(e) * ln(4 / 5e-6::DOUBLE) / 60000) + 8 * exp(e) / 60000 AS x FROM p) SELECT {Duck.rounded('e')} AS epsilon, {Duck.rounded('ln(1 + (1 - exp(-e)) / (1 + exp(-e) / (1 + x)) * x)')} AS shuffled FROM x")
def closed_form_shuffle(spark, sf):
    e = F.col("e")
    x = 8 * F.sqrt(F.exp(e) * F.log(F.lit(4 / 5e-6)) / 60000) + 8 * F.exp(e) / 60000
    p = spark.range(20).select((F.lit(0.02) * (F.col("id") + 1) * 5).alias("e")).withColumn("x", x)
    return p.select(rounded("e").alias("epsilon"), rounded(F.log(1 + (1 - F.exp(-e)) / (1 + F.exp(-e) / (1 + F.col("x"))) * F.col("x"))).alias("shuffled"))


@query(f"SELECT {Duck.rounded('e')} AS delta, {Duck.rounded('1.0::DOUBLE / 1.12::DOUBLE * sqrt(2 * ln(1.25::DOUBLE / e))')} AS epsilon FROM {_PARAMS}")
def gaussian_eps(spark, sf):
    d = F.lit(0.02) * (F.col("id") + 1)
    return spark.range(20).select(rounded(d).alias("delta"), rounded(F.lit(1.0) / F.lit(1.12) * F.sqrt(2 * F.log(F.lit(1.25) / d))).alias("epsilon"))


#: Delta of the shuffled reports by the sum over every number of clones and every count.
_SHUFFLE_SQL = f"""WITH p AS (SELECT * FROM (VALUES (400, 0.5::DOUBLE, 0.02::DOUBLE), (400, 0.5, 0.1), (1000, 1.0, 0.05), (1000, 1.0, 0.2)) p(n, eps0, eps)),
c AS (SELECT *, exp(-eps0) AS k, 1 / (1 + exp(-eps0)) AS a, c FROM p, (SELECT unnest(range(1000)) AS c) WHERE c < n),
w AS (SELECT *, exp(lgamma(n) - lgamma(c + 1) - lgamma(n - c) + c * ln(k) + (n - 1 - c) * ln(1 - k)) AS w FROM c),
i AS (SELECT *, CASE WHEN i <= c THEN exp(lgamma(c + 1) - lgamma(i + 1) - lgamma(c - i + 1) - c * ln(2)) ELSE 0 END AS one, CASE WHEN i >= 1 THEN exp(lgamma(c + 1) - lgamma(i) - lgamma(c - i + 2) - c * ln(2)) ELSE 0 END AS other
  FROM w, (SELECT unnest(range(1001)) AS i) WHERE i <= c + 1 AND w > 1e-18)
SELECT n, eps0 AS local, eps, {Duck.rounded("1e3 * sum(w * greatest(0, a * other + (1 - a) * one - exp(eps) * ((1 - a) * other + a * one)))")} AS delta_1000 FROM i GROUP BY ALL"""


@query(_SHUFFLE_SQL)
def numerical_shuffle(spark, sf):
    """Thousand times the delta of shuffled reports, at a few sizes and epsilons."""
    rows = [(n, e0, e, 1e3 * accounting.shuffle_delta(n, e0, e, upper=False)) for n, e0, es in ((400, 0.5, (0.02, 0.1)), (1000, 1.0, (0.05, 0.2))) for e in es]
    return _table(spark, rows, "n int, local double, eps double, delta_1000 double").withColumn("delta_1000", rounded("delta_1000"))


# By the same sum over all clones and counts, and halving, in exact integers and 50 digits, apart from this library.
@query("SELECT * FROM (VALUES (2000, 0.5::DOUBLE, 0.048611::DOUBLE, true), (10000, 1.0, 0.053005, true)) t(n, local, epsilon, holds)")
def shuffled_epsilon(spark, sf):
    """The least epsilon at a delta of 1e-6, and whether the delta at it holds and a little below it doesn't."""
    rows = []
    for n, e in ((2000, 0.5), (10_000, 1.0)):
        eps = accounting.numerical_shuffle(n, e, 1e-6)
        rows.append((n, e, eps, accounting.shuffle_delta(n, e, eps) <= 1e-6 < accounting.shuffle_delta(n, e, eps - 1e-6, upper=False)))
    return _table(spark, rows, "n int, local double, epsilon double, holds boolean").withColumn("epsilon", rounded("epsilon"))


# Codec

_CELLS = S.TOP + ", cells AS (SELECT client_id, idx, value::FLOAT::DOUBLE AS value FROM top)"


def _payloads(spark, sf):
    return codec.encoded(shaping.top_k(fx.dense_updates(spark, sf), K), ("client_id",), "rank")


@query(f"WITH {S.TOP} SELECT client_id, count(*) * 8 AS bytes FROM top GROUP BY 1")
def encode_cells(spark, sf):
    return _payloads(spark, sf).select("client_id", F.length("payload").cast("long").alias("bytes"))


@query(f"WITH {_CELLS} SELECT client_id, idx, value FROM cells")
def decode_cells(spark, sf):
    return codec.decoded(_payloads(spark, sf), ("client_id",))


# The counter-mode example of NIST SP 800-38A (AES-128), and counters that pass 2^64 and 2^128.
_CTR_KEY = "2B7E151628AED2A6ABF7158809CF4F3C"
_CTR_COUNTER = 0xF0F1F2F3F4F5F6F7F8F9FAFBFCFDFEFF
_CTR_PLAIN = "6BC1BEE22E409F96E93D7E117393172AAE2D8A571E03AC9C9EB76FAC45AF8E5130C81C46A35CE411E5FBC1191A0A52EFF69F2445DF4F9B17AD2B417BE66C3710"
_CTR_CIPHER = "874D6191B620E3261BEF6864990DB6CE9806F66B7970FDFF8617187BB9FFFDFF5AE4DF3EDBD5D35E5B4F09020DB03EAB1E031DDA2FBE03D1792170A0F3009CEE"


@query(f"SELECT '{_CTR_CIPHER}' AS cipher, true AS carries, true AS wraps")
def ctr_known_answers(spark, sf):
    """The example's cipher text, and whether a carry into the high half and a wrap of all 128 bits go on as from there."""
    key = F.unhex(F.lit(_CTR_KEY))
    stream = lambda counter, blocks=4: codec.keystream(key, F.lit(blocks).cast("long"), counter)
    second = lambda counter: F.hex(F.substring(stream(counter, 2), 17, 16))
    first = lambda counter: F.hex(F.substring(stream(counter, 1), 1, 16))
    plain = F.unhex(F.lit(_CTR_PLAIN))
    one = spark.range(1).select(plain.alias("plain"), stream(_CTR_COUNTER).alias("stream"), (second((1 << 64) - 1) == first(1 << 64)).alias("carries"), (second((1 << 128) - 1) == first(0)).alias("wraps"))
    return one.select(F.hex(codec.xored("plain", "stream")).alias("cipher"), "carries", "wraps")


@query()
def encrypt_ctr(spark, sf):
    return _payloads(spark, sf).select("client_id", F.hex(codec.crypted("payload", F.col("client_id"))).alias("payload"))


@query(f"WITH {S.F1} SELECT client_id, idx, CASE WHEN idx % 3 = 0 THEN 0 ELSE value END AS value, {D * 8}::BIGINT AS bytes FROM f1")
def dense_round_trip(spark, sf):
    """Dense vectors to bytes and back; what a client didn't send is 0."""
    sent = codec.encoded_dense(fx.dense_updates(spark, sf).where("idx % 3 <> 0"), D, ("client_id",))
    return codec.decoded(sent, ("client_id",)).join(sent.select("client_id", F.length("payload").cast("long").alias("bytes")), "client_id")


@query(f"WITH {_CELLS} SELECT client_id, idx, value FROM cells")
def decrypt_ctr(spark, sf):
    sent = _payloads(spark, sf).select("client_id", codec.crypted("payload", F.col("client_id")).alias("payload"))
    return codec.decoded(sent.select("client_id", codec.crypted("payload", F.col("client_id")).alias("payload")), ("client_id",))


# Rounds and streams


@query(f"""WITH {S.F2}, r AS (SELECT client_id FROM (SELECT client_id, row_number() OVER (ORDER BY {Duck.order_key('v', 'client_id')}, client_id) AS q FROM (SELECT DISTINCT client_id FROM f2)) WHERE q <= 50)
SELECT CASE WHEN client_id % 7 = 0 THEN 'late_round' WHEN client_id NOT IN (SELECT client_id FROM r) THEN 'unknown_client' WHEN idx >= 500 THEN 'index_out_of_range' ELSE 'ok' END AS status, count(*) AS cells FROM f2 GROUP BY 1""")
def validate_uploads(spark, sf):
    u = fx.sparse_updates(spark, sf).withColumn("round", F.when(F.col("client_id") % 7 == 0, 0).otherwise(1))
    roster = sampling.sampled_clients(u.select("client_id").distinct(), 50, "v")
    return checked(u, roster, 1, 500).groupBy("status").agg(F.count("*").alias("cells"))


@query(f"WITH {S.F3} SELECT round, CASE WHEN round < 15 THEN 'late_round' WHEN round > 15 THEN 'early_round' ELSE 'ok' END AS status, count(*) AS cells FROM f3 GROUP BY ALL")
def late_rounds_rejected(spark, sf):
    u = fx.rounds(spark, sf)
    return checked(u, u.select("client_id").distinct(), 15, D).groupBy(F.col("round").cast("long").alias("round"), "status").agg(F.count("*").alias("cells"))


@query(f"WITH {S.F3} SELECT round, idx, sum({Duck.micro('value')})::BIGINT / 1e6::DOUBLE / count(*) AS value, count(*) AS cells FROM f3 GROUP BY round, idx")
def stream_round_mean(spark, sf):
    out = stream.run_to_end(stream.round_sums(stream.event_stream(spark, sf)), keys=("start", "idx"))
    day = F.datediff(F.to_date("start"), F.lit("2024-01-01").cast("date")).cast("long")
    return out.select(day.alias("round"), "idx", (F.col("s") / F.lit(1e6) / F.col("cells")).alias("value"), "cells")


@query("""WITH u AS (SELECT user_id % 4 AS fl_id, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS round, user_id AS client_id, ts FROM events),
c AS (SELECT fl_id, round, client_id, row_number() OVER (PARTITION BY fl_id, round ORDER BY min(ts), client_id) AS place FROM u GROUP BY fl_id, round, client_id),
n AS (SELECT j.fl_id, r.round, (SELECT count(*) FROM c WHERE c.fl_id = j.fl_id AND c.round = r.round) AS n FROM (SELECT DISTINCT fl_id FROM u) j, (SELECT unnest(range(1 + (SELECT max(round) + 1 FROM u))) AS round) r),
o AS (SELECT fl_id, min(round) AS last FROM n WHERE n < 3 GROUP BY fl_id)
SELECT fl_id, CASE WHEN round > last THEN 'early_round' WHEN place <= 3 THEN 'ok' ELSE 'unknown_client' END AS status, count(*) AS cells FROM u JOIN c USING (fl_id, round, client_id) JOIN o USING (fl_id) GROUP BY ALL""")
def stream_round_gate(spark, sf):
    s = stream.event_stream(spark, sf)
    u = s.select("ts", (F.col("client_id") % 4).alias("fl_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("round"), "client_id", "idx", "value")
    return stream.run_to_end(stream.gated(u, 3), "append").groupBy("fl_id", "status").agg(F.count("*").alias("cells"))


@query(f"""WITH {S.F3}, n AS (SELECT round, count(DISTINCT client_id) AS n FROM f3 GROUP BY 1), s AS (SELECT round, n, i AS idx FROM n, (SELECT unnest(range({D})) AS i))
SELECT s.round, s.idx, coalesce(sum({Duck.micro('u.value')}), 0)::BIGINT * (1.0::DOUBLE / s.n) / 1e6::DOUBLE AS value FROM s LEFT JOIN f3 u ON u.round = s.round AND u.idx = s.idx GROUP BY s.round, s.idx, s.n""")
def round_mean_from_events(spark, sf):
    return aggregate.round_means(fx.rounds(spark, sf), D, exact=True)


# Learning


@query()
def local_update_mlp(spark, sf):
    return learn.local_updates(fx.examples(spark, sf), None, 64, 8, 10)


_WAVE = [0.2 * math.sin(0.7 * i) for i in range(64 * 8 + 8 + 8 * 10 + 10)]
#: One hidden layer of 8 over 64 features and 10 classes, a join for each layer; w(i) is the i-th parameter.
_NETWORK = """w AS (SELECT i, 0.2::DOUBLE * sin(0.7::DOUBLE * i) AS w FROM (SELECT unnest(range(610)) AS i)),
x AS (SELECT vec_id AS id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64)) AS i)),
hid AS (SELECT id, j, greatest(sum(x * w.w) + any_value(b.w), 0) AS h FROM x, (SELECT unnest(range(8)) AS j) j JOIN w b ON b.i = 512 + j JOIN w ON w.i = x.i * 8 + j GROUP BY id, j),
z AS (SELECT id, c, sum(h * w.w) + any_value(b.w) AS z FROM hid, (SELECT unnest(range(10)) AS c) c JOIN w b ON b.i = 600 + c JOIN w ON w.i = 520 + j * 10 + c GROUP BY id, c),
s AS (SELECT id, max(z) AS m, ln(sum(exp(z - m0))) + max(m0) AS l FROM (SELECT *, max(z) OVER (PARTITION BY id) AS m0 FROM z) GROUP BY id),
lp AS (SELECT z.id, c, z - l AS lp, label::BIGINT AS label, z.id % 50 AS client_id FROM z JOIN s USING (id) JOIN embeddings e ON e.vec_id = z.id)"""


@query(f"""WITH {_NETWORK}, n AS (SELECT vec_id % 50 AS client_id, count(*) AS n FROM embeddings GROUP BY 1),
g AS (SELECT id, client_id, c, (exp(lp) - CASE WHEN c = label THEN 1 ELSE 0 END) / n AS g FROM lp JOIN n USING (client_id)),
back AS (SELECT g.id, g.client_id, j, sum(g * w.w) * CASE WHEN any_value(h) > 0 THEN 1 ELSE 0 END AS back FROM g JOIN hid USING (id) JOIN w ON w.i = 520 + j * 10 + c GROUP BY g.id, g.client_id, j),
parts AS (SELECT client_id, 600 + c AS idx, sum(g) AS value FROM g GROUP BY ALL UNION ALL SELECT client_id, 520 + j * 10 + c, sum(h * g) FROM g JOIN hid USING (id) GROUP BY ALL
  UNION ALL SELECT client_id, 512 + j, sum(back) FROM back GROUP BY ALL UNION ALL SELECT client_id, x.i * 8 + j, sum(x * back) FROM back JOIN x USING (id) GROUP BY ALL)
SELECT client_id, idx, {Duck.rounded('value')} AS value FROM parts""")
def local_full_gradient(spark, sf):
    return learn.full_gradients(fx.examples(spark, sf), _WAVE, 64, 8, 10).withColumn("value", rounded("value"))


@query(f"""WITH {_NETWORK}, t AS (SELECT id, label, arg_max(c, lp) AS predicted, -max(lp) FILTER (c = label) AS loss FROM lp GROUP BY id, label)
SELECT {Duck.rounded('avg((predicted = label)::INT::DOUBLE)')} AS accuracy, {Duck.rounded('sum(loss)')} AS loss FROM t""")
def nn_inference(spark, sf):
    out = learn.quality(learn.predictions(fx.examples(spark, sf), _WAVE, 64, 8, 10))
    return out.select(rounded("accuracy").alias("accuracy"), rounded("loss").alias("loss"))


@query()
def nn_attack_labels(spark, sf):
    target, teacher, _ = fx.attack_tables(spark, sf)
    return similarity.top_labels(learn.attack_scores(target, teacher, D, 10), 2)


@query()
def nn_attack_single_model(spark, sf):
    """One network over all rounds side by side."""
    target, teacher, _ = fx.attack_tables(spark, sf)
    return similarity.top_labels(learn.attack_scores(target, teacher, D, 10, rounds=3, mode="single"), 2)


@query()
def nn_attack_by_prefix(spark, sf):
    """A network for the rounds up to each."""
    target, teacher, _ = fx.attack_tables(spark, sf)
    return similarity.top_labels(learn.attack_scores(target, teacher, D, 10, rounds=3, mode="prefixes"), 1, ("client_id", "upto"))


@query(f"""WITH {S.F5}, b AS (SELECT label, round, count(DISTINCT idx % 3) AS n FROM teacher GROUP BY ALL)
SELECT t.label, t.round, t.idx % 3 AS batch_no, count(*) AS cells FROM teacher t JOIN (SELECT label, round, max(idx % 3) AS m FROM teacher GROUP BY ALL) x USING (label)
WHERE true GROUP BY t.label, t.round, t.idx % 3 HAVING t.idx % 3 <= min(x.m)""")
def batches_side_by_side(spark, sf):
    """Of each label the batches that every round has."""
    _, teacher, _ = fx.attack_tables(spark, sf)
    rounds_ = teacher.select("label", "round").distinct().groupBy("label").agg(F.count("*").alias("times"))
    out = shaping.one_batch_apart(teacher.withColumn("batch_no", F.col("idx") % 3))
    return out.join(rounds_, "label").groupBy("label", "round", "batch_no").agg((F.count("*") * F.max("times")).alias("cells"))


@query(f"SELECT * FROM (VALUES ('non_oblivious', {D}::BIGINT, 1::BIGINT), ('optimized', {D}, 1), ('baseline', {D}, 1)) t(algorithm, num_of_parameters, trials)")
def aggregation_times(spark, sf):
    u = shaping.top_k(fx.dense_updates(spark, sf), K)
    return aggregate.bench_summary(timed(u, 100, D, K, trials=2)).select("algorithm", "num_of_parameters", "trials")


@query(f"WITH {S.F1} SELECT client_id, idx, {Duck.order_key(7, 'client_id', 'idx')} AS key FROM f1")
def seeded_order(spark, sf):
    return fx.dense_updates(spark, sf).select("client_id", "idx", order_key(7, "client_id", "idx").alias("key"))


_CLIPPED = f"{S.F1}, q AS (SELECT *, {_SQUARE} AS q FROM f1), cl AS (SELECT idx, value * CASE WHEN q = 0 THEN 1 ELSE least(1.0::DOUBLE, 0.5::DOUBLE / sqrt(q)) END AS value FROM q)"


@query(f"WITH m AS ({_mean_sql(_CLIPPED, 'cl', str(D), DENSE_N)}) SELECT idx, {Duck.rounded(f'value + {1.12 * 0.5!r}::DOUBLE / {DENSE_N}::DOUBLE * {_NOISE}')} AS value FROM m")
def client_level_dp_mean(spark, sf):
    """Clip each client, average, add noise for all of them."""
    n = fx.table(spark, sf, "embeddings").count()
    return privacy.client_level_mean(fx.dense_updates(spark, sf), n, D, 1.12, 0.5, "dp", exact=True).select("idx", rounded("value").alias("value"))


@query(f"WITH {S.F1}, w AS (SELECT a.idx, a.value + b.value * (-0.1::DOUBLE * 3.0::DOUBLE) AS value FROM f1 a JOIN f1 b USING (idx) WHERE a.client_id = 0 AND b.client_id = 1), n AS (SELECT sqrt(sum({Duck.micro('value * value')})::BIGINT / 1e6::DOUBLE) AS n FROM w) SELECT idx, {Duck.rounded('value / greatest(1.0::DOUBLE, n) * 2.0::DOUBLE')} AS value FROM w, n")
def server_step(spark, sf):
    u = fx.dense_updates(spark, sf)
    out = privacy.server_step(u.where("client_id = 0"), u.where("client_id = 1"), 0.1, 3.0, 2.0)
    return out.select("idx", rounded("value").alias("value"))


@query(f"WITH {S.F3}, o AS (SELECT client_id, round, idx FROM f3), a AS (SELECT client_id, round, idx + 1 AS idx FROM o WHERE round % 2 = 0 AND client_id % 3 = 0) SELECT * FROM a UNION ALL SELECT * FROM o WHERE (client_id, round) NOT IN (SELECT (client_id, round) FROM a)")
def latest_observations(spark, sf):
    o = fx.rounds(spark, sf).select("client_id", F.col("round").cast("long").alias("round"), "idx")
    return shaping.latest(o, o.where("round % 2 = 0 AND client_id % 3 = 0").withColumn("idx", F.col("idx") + 1))


@query(f"WITH {S.TOP}, n AS (SELECT count(*) AS n, pow(2, ceil(log2(count(*)::DOUBLE)))::BIGINT AS p FROM top) SELECT idx, value FROM top UNION ALL SELECT 4294967295, 0.0 FROM n, (SELECT unnest(range(1000000)) AS i) WHERE i < p - n")
def pad_to_power_of_two(spark, sf):
    return aggregate.padded(shaping.top_k(fx.dense_updates(spark, sf), K))


@query(f"WITH {S.F1} SELECT idx, client_id FROM f1 JOIN (SELECT unnest(range(8)) AS client_id) USING (client_id) WHERE idx % 2 = 0")
def semi_join_clients(spark, sf):
    """The uploads of the listed clients, at the listed indices."""
    u = fx.dense_updates(spark, sf)
    clients = spark.range(8).select(F.col("id").alias("client_id"))
    wanted = spark.range(0, D, 2).select(F.col("id").alias("idx"))
    return u.join(F.broadcast(clients), "client_id", "left_semi").join(F.broadcast(wanted), "idx", "left_semi").select("idx", "client_id")


@query(f"WITH {_SCORES}{_MEANS}, ch AS (SELECT g.client_id, label FROM g LEFT JOIN cut USING (client_id) WHERE i > coalesce(cut, 0)) SELECT c.client_id, count(*) AS labels, any_value(t.label) AS top FROM ch c JOIN (SELECT client_id, label FROM ranked WHERE place = 1) t USING (client_id) GROUP BY 1")
def class_label_inference(spark, sf):
    target, teacher, _ = fx.attack_tables(spark, sf)
    chosen, top = similarity.infer(target, teacher)
    return chosen.groupBy("client_id").agg(F.count("*").alias("labels")).join(top.withColumnRenamed("label", "top"), "client_id")


@query("SELECT i AS steps, (0.02::DOUBLE * i > 0.5::DOUBLE OR 1e-6::DOUBLE * i > 4e-5::DOUBLE) AS over FROM (SELECT unnest(range(60)) AS i)")
def budget_alarm(spark, sf):
    return _table(spark, [(i, accounting.over_budget(0.02 * i, 1e-6 * i, 0.5, 4e-5)) for i in range(60)], "steps long, over boolean")
