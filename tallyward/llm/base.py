"""What the operators of this package share: the shared folder, written tables, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these six.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

_own_dir: str | None = None
_written: list[str] = []
_tables: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine."""
    global _own_dir
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tallyward-")
    return f"file://{_own_dir}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: a cut of the lineage that outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyward-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, key: str, n: int) -> DataFrame:
    """Like written(), laid out in n buckets of a key, so that a later join on it leaves these rows where they are."""
    spark = df.sparkSession
    name = f"tallyward_{tag}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "uncompressed").bucketBy(n, key)
    writer.option("path", path := f"{shared_dir(spark)}/{name}").saveAsTable(name)
    _written.append(path)
    _tables.append(name)
    return spark.table(name)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables that this process wrote. Results read from them must be written before."""
    jvm = spark.sparkContext._jvm
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Marked for broadcast if its counted rows stay under the limit, else left to a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def crc_mod(id_column: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % m


def modest_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches between the JVM and Python of about this many bytes at most, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most:
        spark.conf.set(key, str(most))


def runs(texts, most: int):
    """(first, end) of runs of an Arrow column of texts with at most this many bytes each; a longer text stands alone."""
    import pyarrow.compute as pc

    lo = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


_UTF8 = "_text_as_utf8"


def map_texts(docs: DataFrame, make, fields: str, keep: tuple[str, ...] = ("doc_id",), slice_bytes: int = 2 << 20) -> DataFrame:
    """One output row for each row: the kept columns, then what ``make()(list of UTF-8 bytes or None)`` returns by name.

    Whole texts go through in slices of at most slice_bytes, a longer one alone; ``make`` runs once for each task.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    source = docs.select(*[F.col(k) for k in keep], F.col("text").cast("binary").alias(_UTF8))
    kept = StructType([f for f in source.schema.fields if f.name != _UTF8])
    schema = StructType(kept.fields + _parse_datatype_string(fields).fields)
    arrow = to_arrow_schema(schema, timestampUTC=True) if _takes_utc(to_arrow_schema) else to_arrow_schema(schema)
    n_kept = len(kept.fields)

    def run(batches):
        f = make()
        for batch in batches:
            for lo, hi in runs(batch.column(_UTF8), slice_bytes):
                part = batch.slice(lo, hi - lo)
                got = f(part.column(_UTF8).to_pylist())
                columns = [part.column(i) for i in range(n_kept)]
                columns += [got[x.name] if isinstance(got[x.name], pa.Array) else pa.array(got[x.name], x.type) for x in list(arrow)[n_kept:]]
                yield pa.RecordBatch.from_arrays([c.cast(x.type) for c, x in zip(columns, arrow)], schema=arrow)
        pa.default_memory_pool().release_unused()

    modest_batches(docs.sparkSession)
    return source.mapInArrow(run, schema)


def _takes_utc(f) -> bool:
    import inspect

    return "timestampUTC" in inspect.signature(f).parameters
