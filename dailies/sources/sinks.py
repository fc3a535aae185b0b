"""Writing results: cue text per clip and per-project table replacement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyarrow.fs import FileSelector, FileType
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dailies.functions.text import srt_time
from dailies.session import materialize
from dailies.sources.audio import locate


def srt_documents(cues: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One numbered cue text per clip (a clip's cues are bounded by its transcript)."""
    block = F.concat(
        F.col(order).cast("string"), F.lit("\n"), srt_time(F.col("s_us")), F.lit(" --> "), srt_time(F.col("e_us")),
        F.lit("\n"), F.col("text"), F.lit("\n"),
    )
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return cues.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda x: x["b"]), "\n").alias("srt"))


#: Folders of a table of projects; their names tell the number.
BUCKETS = 64


def replace_projects(df: DataFrame, path: str, *, project: str = "project_id", buckets: int = BUCKETS) -> None:
    """Overwrite only the projects present in ``df``; the rows of the others stay as they are.

    Projects share ``buckets`` folders (the same number for every write to a table), so files and renames do not grow with
    the number of projects. Buckets with a project of ``df`` are written anew, their other projects read from the table,
    beside the table under ``_staged``, which is then renamed to ``_next``: from there on the write counts. Its buckets are
    moved into the table one by one, by the next write if this one breaks off, so no row is lost at any point. One writer at
    a time; readers between a bucket's removal and its move miss that bucket. ``df`` is read three times.
    """
    bucket = f"bucket_of_{buckets}"
    where, root = locate(path)
    folders = [f.base_name for f in where.get_file_info(FileSelector(root, allow_not_found=True)) if f.type == FileType.Directory]
    if other := [f for f in folders if not f.startswith((f"{bucket}=", "_", "."))]:
        raise ValueError(f"{path} is not a table of {buckets} buckets: {other[0]}")
    _move_in(path)
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(project), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in dealt.select(bucket).distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    stored = _table_at(df.sparkSession, path, df.schema)
    if stored is not None:
        if bucket in stored.columns:  # not so before the first finished write
            fresh = df.select(F.col(project).alias("__fresh")).distinct()
            rest = stored.where(F.col(bucket).isin(touched)).join(fresh, F.col(project).eqNullSafe(F.col("__fresh")), "left_anti")
            dealt = dealt.unionByName(rest)
    dealt.hint("rebalance", bucket).write.mode("overwrite").partitionBy(bucket).parquet(f"{path}/_staged")
    where.move(f"{root}/_staged", f"{root}/_next")
    _move_in(path)


def _move_in(path: str) -> None:
    """Put the buckets of a finished write in the table's place of them; run again, it goes on where it was left."""
    where, root = locate(path)
    written = FileSelector(f"{root}/_next", allow_not_found=True)
    ready = [f for f in where.get_file_info(written) if f.type == FileType.Directory and f.base_name.startswith("bucket_of_")]
    for folder in ready:
        old = f"{root}/{folder.base_name}"
        if where.get_file_info(old).type != FileType.NotFound:
            where.delete_dir(old)
        where.move(folder.path, old)
    if where.get_file_info(f"{root}/_next").type != FileType.NotFound:
        where.delete_dir(f"{root}/_next")


def versioned_projects(
    path: str, *, project: str = "project_id", version: str = "version", buckets: int = BUCKETS
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that keeps the latest version of every project in a table of buckets of projects.

    A batch holds whole projects, possibly in several versions; the greatest one stays, and replaces a stored one that
    is not newer. So a batch that is played again after a failure, or late, leaves the table's rows as they are, and
    the rows of projects not in the batch stay. A version must have the same rows whenever it comes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _move_in(path)
        newest = batch.groupBy(project).agg(F.max(version).alias("__new"))
        stored = _table_at(spark, path, batch.schema)
        if stored is not None:
            old = stored.join(newest.select(project), project, "left_semi").groupBy(project).agg(F.max(version).alias("__old"))
            newest = newest.join(old, project, "left").where(F.col("__old").isNull() | (F.col("__new") > F.col("__old"))).drop("__old")
        kept = batch.join(newest, project).where(F.col(version) == F.col("__new")).select(*batch.columns)
        replace_projects(materialize(kept), path, project=project, buckets=buckets)

    return write


def _table_at(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
