"""Where jobs keep intermediate tables: the folder all executors share.

``spark.checkpoint.dir`` names it. Only a session with a local master may leave
it unset (tests): then it is a temporary folder. Elsewhere a folder of the
driver's machine would be another one on each executor, so it's refused.

Tables are written rather than cached, so that a lost executor costs no
recomputation of what came before. What an operator needs only until it has
its result is written in a Scratch folder, which it removes; results that are
read later stay in the application's folder until release().

Rows here are texts, so the session's Arrow batches are lowered to ARROW_ROWS
rows: they are held outside the heap by executors and again by Python.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 1000
FILE_BYTES = 16 << 20  # of input for each file that is written, about; more for inputs with larger splits
TASK_ROWS = 200_000  # narrow rows that a task writes at least, where their number is known
SMALL_KEYS = 1_000_000  # rows of one long each that are broadcast at most
SMALL_BYTES = 32 << 20  # of other tables


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _modest_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ARROW_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/larkspur-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Removes all that this application has written to the shared folder. DataFrames that operators returned can't be read afterwards."""
    remove(spark, _own_dir(spark))


class Scratch:
    """A folder for the tables of one run, removed at its end (a context manager)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, new_path(spark, "run")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return _write(df, f"{self.path}/{name}-{uuid.uuid4().hex}")

    def write_few(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """For narrow tables that come from a shuffle: several of its partitions to a file. rows: of the table at most, if known."""
        return self.write(gathered(df, rows), name)


def gathered(df: DataFrame, rows: int | None = None) -> DataFrame:
    """With several partitions of a shuffle to a task, one after another: else narrow tables make as many small files as there are partitions."""
    spark = df.sparkSession
    most = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 32)
    return df.coalesce(most if rows is None else min(most, rows // TASK_ROWS + 1))


def sized(df: DataFrame, source: DataFrame) -> DataFrame:
    """df, row by row made of source, in no more tasks than source's bytes ask for (and three for each core)."""
    _modest_batches(df.sparkSession)
    size = estimated_bytes(source)
    return df if size is None else df.coalesce(max(3 * df.sparkSession.sparkContext.defaultParallelism, size // FILE_BYTES))


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate, which is the files' size for tables read from files; no job runs. None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else None


def _write(df: DataFrame, path: str) -> DataFrame:
    _modest_batches(df.sparkSession)
    # nothing waits for a success marker
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back."""
    return _write(df, new_path(df.sparkSession, name))


def few(df: DataFrame, each: int = 64, arrays: list[str] = (), element: int = 16) -> DataFrame:
    """A written table, with a broadcast hint if it has at most SMALL_BYTES: each for a row, and element for each of its arrays' elements."""
    held = F.count(F.lit(1)) * each
    for c in arrays:
        held = held + F.coalesce(F.sum(F.size(c)), F.lit(0)) * element
    return F.broadcast(df) if df.select(held.alias("n")).first()["n"] <= SMALL_BYTES else df


def with_keys(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """A semi or anti join with a written table of longs: broadcast up to SMALL_KEYS rows, shuffled beyond."""
    return df.join(F.broadcast(keys) if keys.count() <= SMALL_KEYS else keys, on, how)


def by_row(docs: DataFrame, facts: DataFrame, how: str, key: str = "doc_id", rk: str = "rk") -> DataFrame:
    """docs with what facts (doc_id, rk and others) say of each row: of equal id and row hash. Ids may be null."""
    facts = facts.withColumnsRenamed({"doc_id": "__fact_id", "rk": "__fact_rk"})
    return docs.join(facts, (docs[rk] == facts["__fact_rk"]) & docs[key].eqNullSafe(facts["__fact_id"]), how).drop("__fact_id", "__fact_rk")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
