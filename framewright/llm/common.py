"""What the operators of this subpackage share: scratch tables, white space, word splitting."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where none is set: on one machine a temporary folder, on a cluster a folder of the warehouse, which all share."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.split("[")[0] == "local"
        folder = "file://" + tempfile.mkdtemp(prefix="framewright-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/framewright-scratch"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared scratch folder and reads it again: the lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = weakref.ref(out), path
    return out


_PATHS: dict = {}


def discard(*tables: DataFrame) -> None:
    """Deletes what materialize() wrote for these, which nothing reads any more."""
    for df in tables:
        ref, path = _PATHS.pop(id(df), (None, ""))
        if ref is not None and ref() is df:
            jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def without_white(text: Column) -> Column:
    """text with all white space deleted; byte-wise replacements are several times cheaper than a regular expression."""
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), WHITE, text)


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z and nothing else."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that whatever names they have meet no name of ours; unpack with select("name.*")."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32(id as text) mod `mod`; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod, F.lit(-1))


def split_words(texts):
    """The white-space separated words of a pyarrow string array (nulls: none): the words one after another, and each text's offsets among them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)  # splits at exactly the characters of WHITE
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    full = pc.binary_length(words).to_numpy() > 0  # white space at an end leaves an empty word
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        words, offsets = words.filter(pa.array(full)), before[offsets]
    return words, offsets


def small_batches(batches, text_col: str, most: int = 4 << 20):
    """Splits Arrow batches so that each holds about `most` bytes of text_col at most (a longer text stands alone), which bounds what a worker holds."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        upto, start = np.cumsum(sizes), 0
        while start < len(sizes):
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, "right")))
            rows = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in rows.columns], names=rows.schema.names)
            start = end


#: Bytes of an Arrow batch that goes to Python, at most; the default of 64 MB is there several times over in JVM and worker.
BATCH_BYTES = 8 << 20


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with small batches, and memory that workers give back after each task, as they live through many."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")

    def lean(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(lean, schema)


def give_back() -> None:
    """Returns freed memory to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def keep_memory() -> None:
    """Lets this process reuse the memory of arrays of up to 32 MB instead of returning it to the system after each and having it cleared anew. These are the limits that the C library itself would come to at most."""
    import ctypes

    try:
        mallopt = ctypes.CDLL("libc.so.6").mallopt
    except (OSError, AttributeError):  # another C library
        return
    mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
    mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def texts_of(batch, text_col: str) -> list[str]:
    return [x or "" for x in batch.column(text_col).to_pylist()]
