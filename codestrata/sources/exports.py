"""Readers of exported histories and source trees.

History dump, one file per repository, named after it::

    git -c core.quotePath=false log --numstat --no-renames --format='%x1e%H%x1f%P%x1f%ct%x1f%an%x1f%ae%x1f%B%x1d'

The record separator lets one large dump split over many tasks.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.rules import author_label

RECORD, FIELD, BODY = "\x1e", "\x1f", "\x1d"


def plain_path(uri: Column) -> Column:
    """A file address without its percent codes; a plus sign is a plus sign."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def repo_from_file(uri: Column, folder: str) -> Column:
    """Path below the folder that is read, without its last ending: files of one name in two folders stay apart.

    ``folder`` is the pattern of ``_folder_pattern``. A single file that is read by its own path keeps its name.
    """
    path = plain_path(uri)
    below = F.element_at(F.split(path, folder, 2), -1)
    return F.regexp_replace(F.when(below == path, F.substring_index(path, "/", -1)).otherwise(below), "\\.[^./]*$", "")


def _records(spark: SparkSession, path: str) -> DataFrame:
    raw = (spark.read.option("lineSep", RECORD).option("recursiveFileLookup", True).text(path)
           .select(repo_from_file(F.col("_metadata.file_path"), _folder_pattern(spark, path)).alias("repo_id"), "value")
           .filter(F.col("value").contains(FIELD)))
    head = F.split(F.substring_index("value", BODY, 1), FIELD, 6)
    return raw.select(
        "repo_id", head.alias("head"),
        F.substring_index("value", BODY, -1).alias("numstat"))


def load_commits(spark: SparkSession, path: str) -> DataFrame:
    part = F.col("head")
    return _records(spark, path).select(
        "repo_id",
        part[0].alias("commit_hash"),
        F.nullif(F.substring_index(part[1], " ", 1), F.lit("")).alias("parent_hash"),
        F.timestamp_seconds(part[2].cast("long")).alias("committed_at"),
        part[3].alias("author_name"),
        part[4].alias("author_email"),
        author_label(part[3], part[4]).alias("author"),
        part[5].alias("message"))


def load_file_changes(spark: SparkSession, path: str) -> DataFrame:
    """One row per commit and file; a binary file counts 0 lines."""
    cells = F.split(F.col("line"), "\t", 3)
    count = lambda c: F.when(c == "-", F.lit(0)).otherwise(c.cast("long")).cast("long")
    return (_records(spark, path)
            .select("repo_id", F.col("head")[0].alias("commit_hash"),
                    F.explode(F.split("numstat", "\n")).alias("line"))
            .filter(F.col("line").rlike("^(\\d+|-)\t(\\d+|-)\t."))
            .select("repo_id", "commit_hash", cells[2].alias("file_path"),
                    count(cells[0]).alias("insertions"), count(cells[1]).alias("deletions"))
            .withColumn("lines", F.col("insertions") + F.col("deletions"))
            .withColumn("complexity_before", F.lit(None).cast("double"))
            .withColumn("complexity_after", F.lit(None).cast("double")))


def load_head_files(spark: SparkSession, path: str) -> DataFrame:
    """``git ls-tree -r --name-only HEAD`` listings, one file per repository."""
    return (spark.read.option("recursiveFileLookup", True).text(path)
            .filter(F.col("value") != "")
            .select(repo_from_file(F.col("_metadata.file_path"), _folder_pattern(spark, path)).alias("repo_id"),
                    F.col("value").alias("file_path")))


def load_source_files(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """Whole source files below ``root``; the first folder names the repository."""
    relative = F.element_at(F.split(plain_path(F.col("_metadata.file_path")), _folder_pattern(spark, root), 2), -1)
    return (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
            .text(root, wholetext=True)
            .select(F.substring_index(relative, "/", 1).alias("repo_id"),
                    F.regexp_replace(relative, "^[^/]*/", "").alias("file_path"),
                    F.col("value").alias("content")))


def _folder_pattern(spark: SparkSession, root: str) -> str:
    """Pattern of the absolute folder, whether ``root`` is relative or an address."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return "\\Q" + folder.makeQualified(system.getUri(), system.getWorkingDirectory()).toUri().getPath() + "/\\E"


def blob_at(commits: DataFrame, blobs: DataFrame, path: str | None = None) -> DataFrame:
    """Content of one path, or of every path, at each given commit.

    A commit without a readable version gives no row.
    """
    versions = blobs.filter(F.col("content").isNotNull())
    if path is not None:
        versions = versions.filter(F.col("file_path") == path)
    return commits.select("repo_id", "commit_hash", "committed_at").join(
        versions, ["repo_id", "commit_hash"])
