"""Session factory and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def session(app: str = "corpusloom", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the queries are written for; on a cluster, use the one that is there."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a session in one process (``local``) gets a temporary folder; any other is refused, as a folder
    of this machine would be missing on the executors.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif context.master == "local" or context.master.startswith("local["):
            found = tempfile.mkdtemp(prefix="corpusloom-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written once to the shared folder and read again: its lineage is cut by files that every executor can read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def counted(df: DataFrame, what: Column) -> tuple[DataFrame, int]:
    """``df`` as ``written``, with a count that is taken on the way."""
    seen = Observation()
    out = written(df.observe(seen, what.alias("n")))
    return out, seen.get["n"]


def shuffled(df: DataFrame) -> DataFrame:
    """A table of keys for a join by shuffles: its files are small for its rows, and the driver would hold them all to broadcast them."""
    return df.hint("merge")


def forget(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        if df is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
