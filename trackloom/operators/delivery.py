"""At-least-once delivery: keep one copy of each message without shuffling the payload.

Three narrow steps and one wide read:

1. the key, the delivery order and the position (file, row) of every row are aggregated per key with map-side
   combining, so a key that holds a third of all rows costs one partial row per task;
2. the winners' positions are turned into one bitmap per 32,768 rows of a file and written to the shared folder:
   what is missing in a bitmap is the file's deletion vector;
3. the wide rows are read once, where they lie, and each is kept if its bit is set. Only file and row number go
   through Arrow; the payload stays in the JVM and is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.text import key_text
from trackloom.session import shared_path

#: Bits of one bitmap_construct_agg result.
BITS = 32768


def _columns(df: DataFrame, key: list[str], order: list[str]) -> list[Column]:
    missing = F.lit(False)
    for c in key:
        missing = missing | F.col(c).isNull()
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return [
        *(key_text(df[c]).alias(f"k{i}") for i, c in enumerate(key)),
        F.when(missing, at).alias("alone"),
        F.struct(*(x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"o{i}"))), at.alias("at")).alias("pos"),
    ]


def winners(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per message: k0.., copies (its number of rows) and at (file, row) of the row that is kept.

    df must come straight from files, since positions are those of the file source. Key parts are compared trimmed and
    in lower case. The first row by order is kept (nulls last), ties by position. A row with a null in the
    key can't be identified: it counts as a message of its own. An empty table gives no rows.
    """
    n = len(key)
    return (
        df.select(*_columns(df, key, order))
        .groupBy(*(f"k{i}" for i in range(n)), "alone")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("pos").alias("pos"))
        .select(*(f"k{i}" for i in range(n)), "copies", F.col("pos.at").alias("at"))
    )


def redelivered(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The key columns of every message with more than one row."""
    return winners(df, key, order).where("copies > 1").select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(key)))


def write_bitmaps(chosen: DataFrame, shards: int) -> str:
    """Bitmaps of the kept rows, in the shared folder, partitioned by a hash of the file."""
    path = shared_path(chosen.sparkSession, "kept_rows")
    (
        chosen.select(F.col("at.file").alias("file"), F.expr("bitmap_bucket_number(at.row + 1)").alias("bucket"), F.expr("bitmap_bit_position(at.row + 1)").alias("bit"))
        .groupBy("file", "bucket")
        .agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
        .withColumn("shard", F.expr(f"pmod(hash(file), {shards})"))
        .repartition("shard")
        .write.partitionBy("shard")
        .parquet(path)
    )
    return path


def _reader(path: str):
    """A vectorised test of (file, row, shard) against the bitmaps; one file's bitmaps are held at a time."""
    import numpy as np

    held: dict[str, dict[int, np.ndarray]] = {}

    def bitmaps(file: str, shard: int) -> dict[int, np.ndarray]:
        if file not in held:
            import pyarrow.dataset as ds
            import pyarrow.fs as pafs

            fs, root = pafs.FileSystem.from_uri(path)
            folder = f"{root}/shard={shard}"
            held.clear()
            if fs.get_file_info(folder).type == pafs.FileType.NotFound:
                held[file] = {}
            else:
                found = ds.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["bucket", "bits"], filter=ds.field("file") == file)
                held[file] = {b: np.frombuffer(bits, np.uint8) for b, bits in zip(found["bucket"].to_pylist(), found["bits"].to_pylist())}
        return held[file]

    def kept(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for files, rows, shards in batches:
            out = np.zeros(len(files), bool)
            names, row = files.to_numpy(), rows.to_numpy()
            for file in pd.unique(files):
                of = np.flatnonzero(names == file)
                maps = bitmaps(file, int(shards.iloc[of[0]]))
                bucket, bit = row[of] // BITS + 1, row[of] % BITS
                for b in np.unique(bucket):
                    if b in maps:
                        x = of[bucket == b]
                        at = row[x] % BITS
                        out[x] = (maps[b][at >> 3] >> (at & 7)) & 1
            yield pd.Series(out)

    return kept


#: Files whose bitmaps one folder holds on average.
FILES_A_SHARD = 16


def keep_one(df: DataFrame, key: list[str], order: list[str], shards: int | None = None) -> DataFrame:
    """df without the later copies of each message; all columns as they are, no wide row is shuffled.

    The rules of winners() hold. shards: how many folders the bitmaps are spread over, by default by the number of files.
    """
    shards = shards or max(16, len(df.inputFiles()) // FILES_A_SHARD)
    path = write_bitmaps(winners(df, key, order), shards)
    kept = F.pandas_udf(_reader(path), "boolean")
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    names = df.columns
    tagged = df.select(*(df[f"`{c}`"] for c in names), file.alias("__trackloom_file"), row.alias("__trackloom_row"))
    return tagged.where(kept("__trackloom_file", "__trackloom_row", F.expr(f"pmod(hash(__trackloom_file), {shards})"))).select(*(F.col(f"`{c}`") for c in names))
