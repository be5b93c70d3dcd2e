"""Session settings, shared scratch tables and broadcast bounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is hinted as broadcast only when it is known to hold at most this many
# (narrow) rows; beyond it the same join runs as a shuffle join.
BROADCAST_ROWS = 1_000_000
SALTS = 32


def build_session(app: str = "lexmere", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; `conf` overrides any default."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a folder set with `SparkContext.setCheckpointDir` counts. A
    local-mode session without either gets a temporary folder of its own, as its
    driver and tasks share one machine; any other session raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(
                "set spark.checkpoint.dir, before the session starts, to a folder "
                "that the driver and every executor can reach"
            )
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexmere-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write `df` once as parquet in the shared folder and read it back.

    Used where one expensive result feeds several plans: the consumers then scan
    only the columns they need, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when the written table `df` holds at most `rows` rows.

    A plain count reads file footers only; a limit would send its rows to one task.
    """
    return df.count() <= rows


def small(df: DataFrame, fits: bool) -> DataFrame:
    """Broadcast hint for a side whose size has been checked (`fits`)."""
    return F.broadcast(df) if fits else df


def join_probe(rows: DataFrame, probe: DataFrame, key: str, fits: bool, by: str) -> DataFrame:
    """Join many `rows` to a probe table on a key that may be very frequent in `rows`.

    A probe of checked size is broadcast. Otherwise rows of one key are dealt over
    several tasks by a hash of column `by`, and each probe row is repeated for them.
    """
    if fits:
        return rows.join(F.broadcast(probe), key)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    repeated = probe.withColumn("_salt", F.explode(salts))
    return dealt.join(repeated.hint("merge"), [key, "_salt"]).drop("_salt")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core when the input has fewer splits than cores.

    Only small inputs are moved (a large one already has more splits); hashing on
    the row key lets later per-key steps reuse the partitioning.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
