"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python kernel holds at once; batches are cut to about this size.
KERNEL_BYTES = 2 << 20
#: Bits of a filter that is broadcast before an exact join: as many as the keys ask for, within these bounds (8 KB and 8 MB).
FILTER_BITS = (1 << 16, 1 << 26)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables, read through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset is one chosen: a temporary folder in local mode
    (tests), else a folder beside the warehouse, which executors share.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        local = context.master.startswith("local[") or context.master == "local"
        shared = tempfile.mkdtemp(prefix="checkpoints-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back.

    It keeps the size that was estimated for the plan, so it does not suit
    loops of joins, where that estimate grows with each round; see ``stored``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as compressed Parquet to the shared folder and read it back.

    It cuts lineage like ``cut_lineage``, takes less disk for wide tables,
    knows the true size of what it holds, and later reads take only the columns
    they need.  The folder belongs to the run; ``discard`` removes a table that
    nothing reads any more, and the rest can go when the run is over.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` from the shared folder; what is not one is left alone."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let the JVM drop the plans of tables that are written, so that their shuffle files go before the next come.

    Python lets go of its own references first; the JVM frees the files at the second of two collections with a pause between.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(1.5)
    spark._jvm.System.gc()


def bit_filter(keys: DataFrame, key: str) -> DataFrame:
    """One row ``bits``: a bitmap of the hashes of a long column, about 16 bits a key within ``FILTER_BITS``.

    A row whose bit is off has no equal among the keys; one whose bit is on may
    have, so an exact join has to follow.  Beyond the upper bound the filter
    lets more through and the join does more of the work.
    """
    least, most = FILTER_BITS
    bits = min(most, max(least, 1 << (16 * max(1, keys.count()) - 1).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b"))
    dense = [0] * (bits // 64)
    for r in words.toLocalIterator():  # at most bits / 64 rows
        dense[r["w"]] = r["b"]
    return F.broadcast(keys.sparkSession.createDataFrame([(dense, bits)], "bits array<long>, n_bits long"))


def may_match(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows whose key may be among those of a ``bit_filter``."""
    place = F.pmod(F.xxhash64(rows[key]), bits["n_bits"])
    return rows.join(bits, F.getbit(F.get(bits["bits"], F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1, "left_semi")


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def slices(sizes: list[int], limit: int = KERNEL_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows of about ``limit`` bytes, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(col: str = "text"):
    """UTF-8 length of a text column, 0 for null."""
    return F.coalesce(F.octet_length(F.col(col)).cast("long"), F.lit(0).cast("long"))
