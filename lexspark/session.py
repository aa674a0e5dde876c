"""Session helpers: runtime settings and reliable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the operators are written for. A value the cluster has
# set explicitly is left alone.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # let AQE split a hot join key even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a broadcast of texts would tie the text stages to the few splits of the other side
    "spark.sql.autoBroadcastJoinThreshold": "4m",
    # regex stages are heavy per byte: keep small shuffles spread over the cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}

_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the cluster left unset."""
    explicit = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for key, value in RUNTIME_SETTINGS.items():
        if key not in explicit:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """This session's folder below ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one; a cluster without it
    is an error, because a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="lexspark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_out(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``; the shuffles behind it go at once, not when the driver comes to collect its garbage."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEAN_SHUFFLES, None)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        # a plan of its own: what is read here is read nowhere else
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before) if before is not None else spark.conf.unset(_CLEAN_SHUFFLES)


def forget(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing will read any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def blank_to_null(col: Column | str) -> Column:
    """Missing text is stored as '' or NULL; treat both as NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != F.lit(""), c)


def first_text(*cols: Column | str) -> Column:
    """First non-empty text among ``cols``."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def struct_rows(names: str, *rows: tuple) -> Column:
    """ARRAY of structs with the given field names, for ``inline``."""
    fields = names.split()
    return F.array(*[
        F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(fields, row, strict=True)])
        for row in rows
    ])
