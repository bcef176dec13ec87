"""Readers and writers of the pipeline's JSON artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom import schemas


def read_documents(spark: SparkSession, folder: str, schema: str = schemas.TRACKS, source: str | None = None) -> DataFrame:
    """One JSON document a file; files that start with _ are skipped, as are documents that don't parse. source filters file names."""
    df = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(folder)
    df = df.withColumn("_file", F.col("_metadata.file_name")).where(~F.col("_file").startswith("_") & F.col("_bad").isNull())
    return (df.where(F.col("_file").contains(source)) if source else df).drop("_bad", "_file")


def read_predictions(spark: SparkSession, path: str, last: bool = True) -> DataFrame:
    """JSON lines; blank and broken lines, and lines without qa_id, are skipped. extracted_answer may be text or a list.

    last: of the lines of one qa_id and model in a file, the last one only. A line's place is its order in the file,
    so a file is read by one task if it can't be split; several files are ordered by name.
    """
    raw = spark.read.text(path, wholetext=False).withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.col("_metadata.file_block_start")).withColumn("_line", F.monotonically_increasing_id())
    one = F.from_json("value", schemas.PREDS.replace("extracted_answer array<string>", "extracted_answer string"), {"mode": "PERMISSIVE"})
    df = raw.select("_file", "_at", "_line", one.alias("r")).where("r.qa_id is not null and r.qa_id <> ''").select("_file", "_at", "_line", "r.*")
    listed = F.from_json("extracted_answer", "array<string>")
    df = df.withColumn("extracted_answer", F.when(F.col("extracted_answer").startswith("["), listed).when(F.col("extracted_answer").isNotNull(), F.array("extracted_answer")))
    if last:
        w = Window.partitionBy("qa_id", "model").orderBy(F.desc("_file"), F.desc("_at"), F.desc("_line"))
        df = df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return df.drop("_file", "_at", "_line")


def write_documents(df: DataFrame, folder: str, key: str = "video_id") -> None:
    """JSON partitioned by key, replacing what is there."""
    df.write.mode("overwrite").partitionBy(key).json(folder)


def write_summary(df: DataFrame, path: str) -> None:
    """A small table as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_predictions(df: DataFrame, path: str) -> None:
    """Append prediction lines."""
    df.write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both, those of new winning; one row a key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def registry_from_files(spark: SparkSession, root: str) -> DataFrame:
    """video_id, source, path, format of the video files below root/<source>/; one row a path. Contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{mp4,webm,mov,avi,mkv}").load(root).select("path")
    source, stem = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return f.dropDuplicates(["path"]).select(F.concat_ws("_", source, stem).alias("video_id"), source.alias("source"), "path", F.lit("video_file").alias("format"))


def parse_json_reply(text):
    """The JSON object within a reply: fences dropped, else the widest braces; null if none parses."""
    bare = F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    whole, inner = F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))
    return F.to_json(F.coalesce(whole, inner))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry from one JSON file, a list of entries or a map of them by video_id."""
    text = spark.read.text(path, wholetext=True)
    entry = f"struct<{', '.join(c.replace(' ', ': ', 1) for c in schemas.REGISTRY.split(', '))}>"
    listed = text.select(F.inline(F.coalesce(F.from_json("value", f"array<{entry}>"), F.array().cast(f"array<{entry}>")))).where("video_id is not null")
    mapped = text.where(F.trim("value").startswith("{")).select(F.explode(F.from_json("value", f"map<string, {entry}>")).alias("k", "e"))
    return listed.unionByName(mapped.select(F.coalesce("e.video_id", "k").alias("video_id"), "e.source", "e.path", "e.format"))


def resolve_paths(videos: DataFrame, files: DataFrame, registry: DataFrame, root: str) -> DataFrame:
    """video_id, found: the registry's path if it is there (as it is, then below root), else root/<source>/<name>.<ext>, a folder of that name, or root/<video_id>.<ext>.

    files: path of everything that exists. Null where nothing is found; a video that the registry has twice takes the smallest path.
    """
    reg = registry.groupBy("video_id").agg(F.min("path").alias("registered"))
    source, name = F.substring_index("video_id", "_", 1), F.expr("substr(video_id, instr(video_id, '_') + 1)")
    ends = ["mp4", "webm", "mov"]
    tried = F.array(F.col("registered"), F.concat(F.lit(f"{root}/"), "registered"), *(F.concat(F.lit(f"{root}/"), source, F.lit("/"), name, F.lit(f".{e}")) for e in ends), F.concat(F.lit(f"{root}/"), source, F.lit("/"), name), *(F.concat(F.lit(f"{root}/"), "video_id", F.lit(f".{e}")) for e in ends))
    candidates = videos.select("video_id").distinct().join(reg, "video_id", "left").select("video_id", F.posexplode(tried).alias("rank", "path")).where("path is not null")
    hits = candidates.join(files.select("path").distinct(), "path", "left_semi").groupBy("video_id").agg(F.min_by("path", "rank").alias("found"))
    return videos.select("video_id").distinct().join(hits, "video_id", "left")


def read_layer_results(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """qa_id, passed, result (JSON) of a layer from its shards (path may be a pattern): documents with a list of items; of several results of an item that of the last file by name counts.

    Items without the layer's result are skipped, as are files that don't parse; a result that is no object counts as passed.
    """
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    items = F.coalesce(F.from_json(F.get_json_object("value", "$.items"), "array<string>"), F.from_json(F.get_json_object("value", "$"), "array<string>"))
    one = text.select("file", F.posexplode(items).alias("at", "item")).select("file", "at", F.get_json_object("item", "$.qa_id").alias("qa_id"), F.get_json_object("item", f"$.{layer}_result").alias("result"))
    last = one.where("qa_id is not null and result is not null").groupBy("qa_id").agg(F.max_by("result", F.struct("file", "at")).alias("result"))
    return last.select("qa_id", F.coalesce(F.get_json_object("result", "$.passed").cast("boolean"), F.lit(True)).alias("passed"), "result")


def read_items(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Items from folder/_all.json if it is there and holds any, else from the documents of single videos (qa_items of each)."""
    text = spark.read.text(folder, wholetext=True).withColumn("name", F.col("_metadata.file_name"))
    items = F.from_json(F.coalesce(F.get_json_object("value", "$.qa_items"), "value"), f"array<struct<{schema}>>")
    every = text.where("name = '_all.json'").select(F.inline(items))
    return every if every.limit(1).count() else text.where("name not like '\\_%'").select(F.inline(items))


def in_item_order(items: DataFrame, results: DataFrame, key: str = "qa_id", order: str = "ordinal") -> DataFrame:
    """Results of all shards joined to the items in their order; missing marks items without one. Both have one row a key."""
    marked = results.withColumn("__there", F.lit(True))
    return items.join(marked, key, "left").withColumn("missing", F.col("__there").isNull()).drop("__there").repartitionByRange(order).sortWithinPartitions(order)


def write_ids(df: DataFrame, path: str, column: str = "video_id") -> None:
    """One identifier a line, in order."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").repartitionByRange("value").sortWithinPartitions("value").write.mode("overwrite").text(path)


def without_counts(df: DataFrame) -> DataFrame:
    """Summary columns without those that end in _counts."""
    return df.drop(*(c for c in df.columns if c.endswith("_counts")))


def link_script(videos: DataFrame) -> DataFrame:
    """One shell line a video: folders of pictures are linked, files copied. videos: video_id, path, format."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\\\''")), F.lit("'"))
    ext = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    line = F.when(F.col("format") == "video_file", F.concat(F.lit("cp -n "), quoted(F.col("path")), F.lit(" "), quoted(F.concat("video_id", ext)))).otherwise(F.concat(F.lit("ln -sfn "), quoted(F.col("path")), F.lit(" "), quoted(F.col("video_id"))))
    return videos.where("path is not null").select("video_id", line.alias("line"))
