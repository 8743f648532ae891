"""SHA-256 of files of any size.

Small files are hashed whole where they are read. A large one is read in segments, one task
each, that hand the state of the digest on: SHA-256 takes bytes in order, so the segments of
one file follow each other, but no task holds a file or reads more than its segment.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a file is hashed whole.
WHOLE = 32 << 20
SEGMENT = 128 << 20
#: Large files that are hashed at a time.
AT_ONCE = 8
# Names by which Spark's text source would unpack a file.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")
BOM = b"\xef\xbb\xbf"
# Bytes of OpenSSL's SHA256_CTX: eight words of state, two of length, sixteen of data, two more.
STATE = 112


def file_uri() -> Column:
    """The file that a row was read from, as a qualified URI."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///")


def literal(path: str) -> str:
    """A path that readers take without globs."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def digests(raw: DataFrame, *, whole: int = WHOLE, segment: int = SEGMENT) -> DataFrame:
    """(uri, path, bytes, sha256) of the files of a ``binaryFile`` frame.

    Packed files and, where the system's OpenSSL is out of reach, all files are hashed whole,
    which suits files below 2 GB."""
    spark, length = raw.sparkSession, F.col("length")

    def hashed(files: DataFrame) -> DataFrame:
        return files.select(file_uri().alias("uri"), "path", length.alias("bytes"),
                            F.sha2("content", 256).alias("sha256"))

    if _openssl() is None:
        return hashed(raw)
    found = hashed(raw.filter(length <= whole))
    large = raw.filter(length > whole).select(
        file_uri().alias("uri"), "path", length.alias("bytes")).collect()
    packed = [literal(r["path"]) for r in large if r["path"].endswith(PACKED)]
    if packed:
        found = found.unionByName(hashed(spark.read.format("binaryFile").load(packed)))
    plain = [r for r in large if not r["path"].endswith(PACKED)]
    if plain:
        own = spark.newSession()
        own.conf.set("spark.sql.files.maxPartitionBytes", str(segment))
        own.conf.set("spark.sql.files.openCostInBytes", "0")
        own.conf.set("spark.sql.files.minPartitionNum", "1")
        with ThreadPoolExecutor(AT_ONCE) as pool:
            sums = list(pool.map(lambda r: _in_segments(own, r["path"], r["bytes"]), plain))
        found = found.unionByName(spark.createDataFrame(
            [(*r, s) for r, s in zip(plain, sums)],
            "uri string, path string, bytes long, sha256 string"))
    return found


def _in_segments(spark: SparkSession, path: str, size: int) -> str:
    """The digest of one file, whose lines the text source reads in splits as they are, any
    bytes, but without line feeds and a byte order mark; the file's size tells what is missing."""
    lines = spark.read.option("lineSep", "\n").text(literal(path)).select(
        F.col("value").cast("binary").alias("value"))
    segments = lines.rdd.getNumPartitions()
    for lead in (b"", BOM):
        state, taken = start(lead), -1  # a line feed precedes every line but the first
        for k in range(segments):
            step = lines.mapInArrow(_take(state, taken < 0), "state binary, taken long").rdd
            row, = spark.sparkContext.runJob(step, list, [k])
            state, taken = bytes(row["state"]), taken + row["taken"]
        rest = size - len(lead) - taken
        if rest in (0, 1):
            return finish(update(state, b"\n" * rest))
    raise RuntimeError(f"{path} changed while it was read")


def _take(state: bytes, first: bool):
    """Takes a segment's lines into the state; one row: the state, and the bytes of the lines
    with a line feed each."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken, begun = state, 0, not first
        for batch in batches:
            if batch.num_rows:
                text = b"\n".join(batch.column(0).to_pylist())
                now = update(now, b"\n" + text if begun else text)
                taken, begun = taken + len(text) + 1, True
        yield pa.RecordBatch.from_pydict({
            "state": pa.array([now], pa.binary()), "taken": pa.array([taken], pa.int64())})

    return take


@cache
def _openssl():
    """The library behind Python's own ``hashlib``, whose state of a digest is plain bytes."""
    try:
        import _hashlib
    except ImportError:
        return None
    for name in (getattr(_hashlib, "__file__", None), ctypes.util.find_library("crypto")):
        if name:
            library = ctypes.CDLL(name)
            if all(hasattr(library, f"SHA256_{f}") for f in ("Init", "Update", "Final")):
                library.SHA256_Update.argtypes = (
                    ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t)
                return library
    return None


def start(lead: bytes = b"") -> bytes:
    state = ctypes.create_string_buffer(STATE)
    _openssl().SHA256_Init(state)
    return update(state.raw, lead)


def update(state: bytes, data: bytes) -> bytes:
    now = ctypes.create_string_buffer(state, STATE)
    _openssl().SHA256_Update(now, data, len(data))
    return now.raw


def finish(state: bytes) -> str:
    out = ctypes.create_string_buffer(32)
    _openssl().SHA256_Final(out, ctypes.create_string_buffer(state, STATE))
    return out.raw.hex()
