"""Shared parts: reading tables, the shared work folder, stored intermediates, passing rows through Arrow, characters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_CHARS = 1 << 18  # characters that one numpy step handles; a single longer text is handled whole

#: White space of the word contracts: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a one-machine session without that setting gets a local one.

    The frames that an operator returns read from it, so it stays until their user has written the result.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corvane-llm-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts lineage, survives lost executors, gives joins a plain scan."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, other letters as they are. Pure ASCII takes the fast path of ``lower``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def sha256_text(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def map_rows(
    df: DataFrame,
    fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]],
    inputs: dict[str, Column | str],
    outputs: str,
    keep: Column | None = None,
) -> DataFrame:
    """Columns of ``fn`` beside each row; ``fn`` gets and gives one dict of lists a batch, row for row.

    ``inputs`` are the only columns that Python unpacks; ``keep`` (default: the whole row as a struct, so that no
    column name can clash) passes through untouched as ``row``. An input given by its name is taken from the whole row
    that passes anyway, so that its text crosses to Python once.
    """
    names = list(inputs)
    held = {n: df.columns.index(c) for n, c in inputs.items() if keep is None and isinstance(c, str) and c in df.columns}
    sent = {n: F.col(c) if isinstance(c, str) else c for n, c in inputs.items() if n not in held}
    shaped = df.select((F.struct("*") if keep is None else keep).alias("row"), *[c.alias(n) for n, c in sent.items()])
    place = {n: i + 1 for i, n in enumerate(sent)}
    out = df.sparkSession.createDataFrame([], outputs).schema
    schema = shaped.select("row").schema
    for field in out:
        schema = schema.add(field.name, field.dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in parts_of(batches):
            row = batch.column(0)
            whole = row.flatten() if held else []
            values = fn({n: (whole[held[n]] if n in held else batch.column(place[n])).to_pylist() for n in names})
            arrays = [pa.array(values[f.name], type=f.type) for f in target]
            yield pa.RecordBatch.from_arrays([row, *arrays], names=["row", *target.names])
            del row, whole, values, arrays
        pa.default_memory_pool().release_unused()  # the worker lives on

    return shaped.mapInArrow(run, schema)


def parts_of(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that a worker holds the Python objects of one part at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def runs_of(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of a list of texts of about ``limit`` characters each; a longer text is a slice of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in one array, and the offsets of the texts in it."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def ngram_buckets(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hash bucket of the n-gram that starts at each position; the last ``order - 1`` positions have none."""
    n = max(0, len(points) - order + 1)
    h = np.full(n, np.uint32(order * 2654435761 & 0xFFFFFFFF), np.uint32)
    for k in range(order):
        h ^= points[k : k + n]
        h *= np.uint32(0x01000193 + 2 * 7919 * k)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - bits)


def span_sums(values: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Sums of the values of the n-grams that lie wholly within each text."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, dtype=np.float64, out=total[1:])
    lo = np.minimum(offsets[:-1], len(values))
    hi = np.maximum(np.minimum(offsets[1:] - order + 1, len(values)), lo)
    return total[hi] - total[lo]


def within(offsets: np.ndarray, order: int, n: int) -> np.ndarray:
    """Which of ``n`` n-gram positions lie wholly within one text."""
    ok = np.ones(n, bool)
    for k in range(1, order):
        cut = offsets[1:-1] - k
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """crc32 of the id as text, modulo; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))
