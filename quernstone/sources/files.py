"""Files as tables: source folders, JSON lines, vector matrices, review records."""

import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EXTENSIONS = ("pdf", "epub", "mobi")


def source_id(project: Column, path: Column) -> Column:
    return F.concat(F.lit("src_"), F.substring(F.sha2(F.concat(project, F.char(F.lit(0)), path), 256), 1, 24))


def document_id(path: Column, digest: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat(path, F.char(F.lit(0)), digest), 256), 1, 24))


def scan_sources(spark: SparkSession, root: str, project: str, digests: bool = True) -> DataFrame:
    """``(source_id, source_relative_path, extension, size_bytes, modified_at, sha256)`` of the kept files under a folder.

    The listing is Spark's own binary-file scan; without digests no file content is read.  A folder that
    is not there has no files.
    """
    if directory_statistics(spark, root)[0] == 0:
        return spark.createDataFrame([], "source_id string, source_relative_path string, extension string, size_bytes long, modified_at timestamp, sha256 string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace("path", r"^.*?" + _quoted(root.rstrip("/").removeprefix("file:")) + "/", "")
    rows = files.withColumn("source_relative_path", base).withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    kept = rows.where(F.col("extension").isin(*EXTENSIONS))
    digest = F.sha2("content", 256) if digests else F.lit(None).cast("string")
    return kept.select(source_id(F.lit(project), F.col("source_relative_path")).alias("source_id"), "source_relative_path", "extension", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), digest.alias("sha256"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def ignored_extensions(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    e = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.groupBy(e.alias("extension")).count().where(~F.col("extension").isin(*EXTENSIONS))


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Objects, one a line, of a fixed schema; anything else is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Writes beside the target and renames, so that the target is whole or not there; a target that exists is an error."""
    fs, at = _file_system(rows.sparkSession, path)
    if fs.exists(at(path)):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    rows.write.json(staging)
    if not fs.rename(at(staging), at(path)):
        fs.delete(at(staging), True)
        raise OSError(f"{path} could not be published")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def directory_statistics(spark: SparkSession, path: str) -> tuple[int, int]:
    """How many files a folder holds and how many bytes; zeros for one that is not there."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at(path)):
        return 0, 0
    summary = fs.getContentSummary(at(path))
    return summary.getFileCount(), summary.getLength()


def read_vector_matrices(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """``(path, ordinal, vector)`` of ``.npy`` matrices of finite float32 rows; another type, shape or value is an error."""
    import numpy as np

    schema = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("vector", pa.list_(pa.float32()))])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if x.dtype != np.float32 or x.ndim != 2 or x.shape[1] != dimension or not np.isfinite(x).all():
                    raise ValueError(f"{name}: a finite float32 matrix of {dimension} columns is needed, not {x.dtype} {x.shape}")
                for i in range(0, len(x), 4096):
                    part = x[i : i + 4096]
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, dimension, dtype=np.int32)), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), vectors], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(load, "path string, ordinal long, vector array<float>")


RECORDS = {
    "metadata_overrides": "source_relative_path string, title string, authors array<string>, year int, doi string, language array<string>, categories array<string>, keywords array<string>, project array<string>, present array<string>",
    "source_exclusions": "source_relative_path string, reason string, excluded_at timestamp",
    "chunk_exclusions": "chunk_id string, reason string, excluded_at timestamp, generation_id string",
}


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A small review table; an exclusion without a reason is an error."""
    rows = read_json_lines(spark, path, RECORDS[kind])
    if kind != "metadata_overrides" and rows.where("reason IS NULL OR trim(reason) = ''").limit(1).count():
        raise ValueError(f"{kind}: a record has no reason")
    return rows


def upserted(records: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """Records with the changed keys replaced; unchanged ones stay."""
    return records.join(change.select(key), key, "left_anti").unionByName(change, allowMissingColumns=True)
