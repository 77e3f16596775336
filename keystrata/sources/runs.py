"""Sorted runs on storage: writing and reading them, their metadata, and which store a path belongs to."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from keystrata.operators.compaction import LsmOptions, sst_metadata

COLUMNS = ("user_key", "sequence", "op", "value")
#: Row groups aren't looked up in dictionaries: Parquet reads those 8 KiB at a time, and a larger one in LZ4_RAW then fails
#: ("all input must be consumed") unless the decompressor happens to hold a larger buffer.
READ = {"parquet.filter.dictionary.enabled": "false"}
#: Keys without a dictionary, since beside one no Bloom filter is written; the smallest filter that holds a row group's keys.
BLOOM = {
    "parquet.bloom.filter.enabled#user_key": "true", "parquet.enable.dictionary#user_key": "false",
    "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.candidates.number#user_key": "10",
}


def write_run(versions: DataFrame, path: str, level: int = 0, options: LsmOptions | None = None, partitions: int | None = None, bloom: bool = True) -> None:
    """Write versions as key-ordered files: range-partitioned by key, newest version first within a key.

    No key lies in two files (ranges are cut between keys). Row groups get minima and maxima of keys, and a Bloom filter
    on the key, so point and range reads skip what they don't need. The commit is Spark's: a run is there as a whole
    or not at all. The codec is the level's.
    """
    codec = (options or LsmOptions()).codec(level)
    rows = versions.select(*COLUMNS)
    spread = rows.repartitionByRange(partitions, "user_key") if partitions else rows.repartitionByRange("user_key")
    out = spread.sortWithinPartitions("user_key", F.desc("sequence")).write.mode("errorifexists").option("compression", codec)
    if bloom:
        out = out.options(**BLOOM)
    out.parquet(path)


def write_bucketed(versions: DataFrame, name: str, buckets: int) -> None:
    """Save versions as a table bucketed by key and sorted by key and sequence: newest-per-key reads and joins on the key
    then need no exchange."""
    rows = versions.select(*COLUMNS).repartition(buckets, "user_key")
    rows.write.mode("errorifexists").bucketBy(buckets, "user_key").sortBy("user_key", "sequence").saveAsTable(name)


def read_runs(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.options(**READ).parquet(*paths).select(*COLUMNS)


def run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(file, first_key, last_key, n, data_size)`` of a run's files."""
    rows = spark.read.options(**READ).parquet(path).select(*COLUMNS, F.col("_metadata.file_name").alias("file"))
    meta = sst_metadata(rows.withColumn("sst_id", F.col("file")).withColumn("level", F.lit(0)))
    return meta.select(F.col("sst_id").alias("file"), "first_key", "last_key", "n", "data_size")


def codec_of(spark: SparkSession, path: str) -> str | None:
    """The compression of a run, by the footer of its first file that has rows; None for an empty run."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    for st in root.getFileSystem(conf).listStatus(root):
        if not st.getPath().getName().endswith(".parquet"):
            continue
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(st.getPath(), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        try:
            blocks = reader.getFooter().getBlocks()
            if blocks.size():
                return blocks.get(0).getColumns().get(0).getCodec().toString()
        finally:
            reader.close()
    return None


def store_options(s3: str | None = None, minio: str | None = None) -> dict[str, str]:
    """Hadoop settings of the store to use: S3 before MinIO before memory (no settings, a temporary view).

    ``minio`` is ``minio://key:secret@host:port/bucket``; the settings point the S3 connector at that endpoint.
    """
    if s3:
        return {"root": s3.replace("s3://", "s3a://", 1)}
    if not minio:
        return {}
    u = urlparse(minio)
    bucket = u.path.strip("/")
    if u.scheme != "minio" or not u.hostname or not bucket:
        raise ValueError("a MinIO address looks like minio://key:secret@host:port/bucket")
    endpoint = f"http://{u.hostname}" + (f":{u.port}" if u.port else "")
    return {
        "root": f"s3a://{bucket}", "fs.s3a.endpoint": endpoint, "fs.s3a.access.key": u.username or "", "fs.s3a.secret.key": u.password or "",
        "fs.s3a.path.style.access": "true",
    }


class ObjectStore:
    """Whole objects by name below a root on any Hadoop file system: put, get, get_range, remove."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self._conf), path

    def put(self, name: str, data: bytes) -> None:
        fs, path = self._at(name)
        out = fs.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def get(self, name: str) -> bytes | None:
        """The object, or None where there is none."""
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        return self.get_range(name, 0, fs.getFileStatus(path).getLen())

    def get_range(self, name: str, begin: int, end: int) -> bytes | None:
        """Bytes ``[begin, end)``; raises for a range outside the object."""
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        size = fs.getFileStatus(path).getLen()
        if not 0 <= begin <= end <= size:
            raise ValueError(f"range {begin}..{end} of an object of {size} bytes")
        src = fs.open(path)
        try:
            src.seek(begin)
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(src, end - begin)) if end > begin else b""
        finally:
            src.close()

    def size(self, name: str) -> int | None:
        """Bytes of the object, None where there is none."""
        fs, path = self._at(name)
        return fs.getFileStatus(path).getLen() if fs.exists(path) else None

    def remove(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, False)
