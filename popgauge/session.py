"""Session helpers: sensible defaults, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "popgauge", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with AQE, skew handling and UTC timestamps switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Planned sizes are guesses from compressed files; sizes measured at run time may broadcast more.
        "spark.sql.autoBroadcastJoinThreshold": "512KB",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
        # Where every shuffled partition of the build side is small, hash instead of sorting both sides.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Many sums in one pass make long generated methods, which the JVM leaves uncompiled by default.
        "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master, where
    they are one process, may do without; a cluster that names none is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="popgauge-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """See that checkpoints go to the shared folder."""
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


def cut_lineage(df: DataFrame, *, release: bool = False) -> DataFrame:
    """Reliable checkpoint: the result survives executor loss, and the plan starts afresh. ``release`` deletes the files
    that ``df`` shuffled on the way."""
    ensure_checkpoint_dir(df.sparkSession)
    result = df.checkpoint(eager=True)
    if release:
        release_shuffles(df)
    return result


def release_shuffles(df: DataFrame) -> None:
    """Delete the files that a run of ``df`` shuffled, as Spark's cleaner would do whenever the driver next collects its
    garbage. Who runs ``df`` again shuffles again."""
    cleaner = df.sparkSession.sparkContext._jsc.sc().cleaner()
    if cleaner.isEmpty():
        return
    todo, seen = [df._jdf.queryExecution().toRdd()], set()
    while todo:
        rdd = todo.pop()
        if rdd.id() in seen:
            continue
        seen.add(rdd.id())
        dependencies = rdd.dependencies()
        for i in range(dependencies.length()):
            dependency = dependencies.apply(i)
            if dependency.getClass().getSimpleName() == "ShuffleDependency":
                cleaner.get().doCleanupShuffle(dependency.shuffleId(), True)
            todo.append(dependency.rdd())
