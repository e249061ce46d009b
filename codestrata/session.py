"""Session settings and lineage cuts."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job here relies on. Skewed joins are split even when the
# split costs one more exchange: a single repository, file or commit may be huge.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Bytes of compressed exchange a task takes. By default few partitions, one per core, take all there is; rows of
    # history unfold to forty times that in sorts and sums.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Window state of a long stream outgrows the heap; keep it on disk beside the executor.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime settings on a session that already exists."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", app: str = "codestrata", memory: str = "12g") -> SparkSession:
    """Session on this machine, for tests and the benchmark."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach, from ``spark.checkpoint.dir``.

    Without the setting a local master gets a folder of its own; a cluster gets an error,
    because a folder on one machine does not survive the loss of that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors reach")
    folder = tempfile.mkdtemp(prefix="codestrata-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative jobs stay short and survive lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_folders: dict[str, SparkSession] = {}


def written(df: DataFrame) -> DataFrame:
    """Write a step to the shared folder and read it back, for loops with joins.

    A checkpoint cuts the jobs but hands on the size that was estimated for its plan; estimates of joins multiply, so in a
    loop they gain digits by a factor a round until planning takes longer than the work. A table has the size of
    its files. The tables of one application go when its driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/steps-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders[folder] = spark
        atexit.register(_drop, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(folder: str) -> None:
    context = _folders[folder].sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
