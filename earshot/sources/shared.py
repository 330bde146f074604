"""Shared storage used to cut lineage, and the guarded re-use of saved results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Bytes of rows in one Arrow batch; a batch is in memory in the JVM and again in the Python worker, for every core.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a folder of its own; on a cluster a
    machine-local folder would lose data with its executor, so its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="earshot-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def bound_batches(spark: SparkSession) -> None:
    """Close Arrow batches by bytes, not at 10,000 rows alone, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_BYTES)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/earshot-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    The result has no lineage behind it, survives the loss of any executor, is evaluated once, and
    stays column-prunable.  The folder may be deleted when the application has ended.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``cut`` plus aggregates of the written rows, taken while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    return out, seen.get


def fingerprint(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row ``(n_rows, digest)``; order-free, so it is a plain partial + final aggregate.

    The digest adds two 60-bit parts of each row's MD5 over id and text, as decimals of 38 digits: room for
    more than 10**19 rows.
    """
    return df.agg(F.count("*").alias("n_rows"), row_digest(F.col(id_col), F.col(text_col)).alias("digest"))


def row_digest(row_id: Column, text: Column) -> Column:
    keyed = F.md5(F.concat(row_id.cast("string"), F.lit("\x00"), F.coalesce(text, F.lit(""))))
    parts = [F.conv(F.substring(keyed, at, 15), 16, 10).cast("decimal(28,0)") for at in (1, 16)]
    return F.concat_ws("-", *[F.coalesce(F.sum(p), F.lit(0)).cast("decimal(38,0)").cast("string") for p in parts])


def materialize(df: DataFrame, path: str, signature: str, *, n_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Read ``path`` back if its recorded signature (and row count) match, else compute and write it.

    Returns the table and whether it was re-used.  The signature lives in a one-row table beside the
    data and is written last, so an interrupted write is never taken for a finished one.
    """
    spark = df.sparkSession
    side = f"{path}/signature"
    found = _read_signature(spark, side)
    if found is not None and found["signature"] == signature and n_rows in (None, found["n_rows"]):
        return spark.read.schema(df.schema).parquet(found["data"]), True
    data = f"{path}/data-{uuid.uuid4().hex[:12]}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(data)
    out = spark.read.schema(df.schema).parquet(data)
    row = [(signature, seen.get["n"], data)]
    spark.createDataFrame(row, "signature string, n_rows bigint, data string").coalesce(1).write.mode(
        "overwrite"
    ).parquet(side)
    return out, False


def _read_signature(spark: SparkSession, side: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{side}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(side).first()


def bucket_of(row_id: Column, buckets: int) -> Column:
    """The bucket of an id, the same on every run and system: the first 32 bits of its MD5, modulo ``buckets``."""
    start = F.conv(F.substring(F.md5(F.coalesce(row_id.cast("string"), F.lit(""))), 1, 8), 16, 10)
    return F.pmod(start.cast("bigint"), F.lit(buckets)).cast("int")


def materialize_buckets(
    source: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    path: str,
    *,
    id_col: str,
    input_cols: Sequence[str] | None = None,
    buckets: int = 256,
    version: str = "",
) -> tuple[DataFrame, list[int]]:
    """``compute(source)``, recomputed only for the buckets of ids whose rows changed since the last call.

    ``compute`` must work row by row and keep ``id_col``, so a bucket's result depends on its own rows alone; all rows
    with one id share a bucket.  Every bucket has a digest of its ``input_cols`` (all by default); one pass over the
    source makes them, and only rows of changed buckets are computed.  Another ``version`` or number of buckets
    recomputes all.  Returns the whole result and the recomputed buckets, in order.

    Results lie in one folder per call and bucket.  The list of valid ones (a row per bucket) is a new table each time
    and counts once it is complete, so an interrupted call leaves the former state; folders it no longer names may be
    deleted.  Buckets without rows leave the list.  One call at a time may write.
    """
    spark = source.sparkSession
    columns = list(input_cols or source.columns)
    bucket = bucket_of(F.col(id_col), buckets)
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    digest = row_digest(F.col(id_col), row)
    now = {
        r["bucket"]: f"{version}|{buckets}|{r['n']}|{r['digest']}"
        for r in source.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), digest.alias("digest")).collect()
    }
    step, known = _last_list(spark, path)
    changed = sorted(b for b, d in now.items() if b not in known or known[b]["digest"] != d)
    schema = compute(source).schema
    lists = {b: (d, known[b]["run"]) for b, d in now.items() if b not in set(changed)}
    run = uuid.uuid4().hex[:12]
    if changed:
        wanted = source if len(changed) == len(now) else source.filter(bucket.isin(changed))
        made = compute(wanted).withColumn("_run", F.lit(run)).withColumn("_bucket", bucket)
        made.repartition("_bucket").write.mode("append").partitionBy("_run", "_bucket").parquet(f"{path}/data")
        lists |= {b: (now[b], run) for b in changed}
    if changed or set(known) != set(now) or not step:
        rows = [(b, d, at) for b, (d, at) in sorted(lists.items())]
        table = spark.createDataFrame(rows, "bucket int, digest string, run string").coalesce(1)
        table.write.parquet(f"{path}/lists/{step + 1:09d}")
    if not lists:
        return spark.createDataFrame([], schema), changed
    runs: dict[str, list[int]] = {}
    for b, (_, at) in lists.items():
        runs.setdefault(at, []).append(b)
    valid = F.lit(False)
    for at, held in runs.items():
        valid = valid | ((F.col("_run") == at) & F.col("_bucket").isin(held))
    full = StructType([*schema, StructField("_run", StringType()), StructField("_bucket", IntegerType())])
    return spark.read.schema(full).parquet(f"{path}/data").filter(valid).select(*schema.names), changed


def _last_list(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and rows of the newest complete list, 0 if there is none; incomplete ones keep their number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/lists")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return 0, {}
    steps = sorted((int(s.getPath().getName()) for s in files.listStatus(folder)), reverse=True)
    for step in steps:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/lists/{step:09d}/_SUCCESS")
        if files.exists(done):
            rows = spark.read.parquet(f"{path}/lists/{step:09d}").collect()
            return steps[0], {r["bucket"]: r for r in rows}
    return steps[0], {}
