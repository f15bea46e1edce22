"""File sources and sinks: listings, requests, metadata tables, frame names, catalogs, traces and result exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyforge.functions.text import source_key
from tallyforge.operators.prefix import prefix_sums

# fixed values: suffixes of videos, folders that are left out, kinds of artefacts
VIDEO_SUFFIXES = ("mp4", "mkv", "mov", "avi", "webm")
LEFT_OUT = ("corrupt", "exclude")
KINDS = ("0TrackName", "2RaceScore", "3TotalScore")
METADATA = "video string, race string, kind string, requested_frame string, actual_frame string, fps string, timecode string, layout string, width string, height string, path string"
CATALOG = "id int, name string, cup_index int"


def list_files(spark: SparkSession, folder: str, recursive: bool = False, suffixes: tuple[str, ...] = VIDEO_SUFFIXES) -> DataFrame:
    """path, length and modificationTime of the files with one of the suffixes; contents are never read.

    A recursive listing leaves out every path with a folder named like LEFT_OUT.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).drop("content")
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)
    parts = F.split(F.lower(F.regexp_replace("path", r"/[^/]*$", "")), "/")
    return files.where(wanted & ~F.exists(parts, lambda p: p.isin(*LEFT_OUT))) if recursive else files.where(wanted)


def with_source(files: DataFrame, root: str) -> DataFrame:
    """Adds the stable key of the source, from the path below `root`."""
    below = F.expr(f"substring(path, instr(path, '{root.rstrip('/')}/') + {len(root.rstrip('/')) + 1})")
    return files.withColumn("race_class", source_key(below))


def select_files(files: DataFrame, requests: DataFrame, by: list[str], key: str) -> DataFrame:
    """Per request, the files that match it by the first of the columns `by` that matches any; each file once, at its first request."""
    hits = None
    for p, column in enumerate(by):
        h = files.select(key, F.col(column).alias("ask")).join(requests, "ask").select(key, "request", F.lit(p).alias("p"))
        hits = h if hits is None else hits.unionByName(h)
    best = hits.withColumn("b", F.min("p").over(Window.partitionBy("request"))).where("p = b")
    return best.groupBy(key).agg(F.min("request").alias("request"))


def unmatched_requests(files: DataFrame, requests: DataFrame, by: list[str]) -> DataFrame:
    """Requests that no file answers."""
    names = files.select(F.explode(F.array(*by)).alias("ask")).distinct()
    return requests.join(names, "ask", "left_anti")


def workflow_plan(sources: DataFrame) -> DataFrame:
    """Length in seconds, their sum, and the order of work from 1: sources that can run in parallel first, then in order of input.

    input_order has to be unique. Numbers are running counts over ranges of it, so no task sees all sources.
    """
    one = sources.withColumn("length_s", F.col("n_frames") / F.greatest(F.col("fps"), F.lit(1))).withColumn("__one", F.col("parallel").cast("long"))
    first = prefix_sums(one, "input_order", "__one").withColumnsRenamed({"upto": "__ahead", "total": "__parallel"}).withColumn("__one", F.lit(1).cast("long"))
    all_ = prefix_sums(first, "input_order", "__one")
    number = F.when(F.col("parallel"), F.col("__ahead")).otherwise(F.col("__parallel") + F.col("upto") - F.col("__ahead"))
    return all_.withColumn("number", number).drop("__one", "__ahead", "__parallel", "upto", "total")


def longest(sources: DataFrame, n: int) -> DataFrame:
    """The n longest sources (one at least), names falling among equals."""
    return sources.orderBy(F.desc("length_s"), F.desc(F.lower("label"))).limit(max(1, n))


def probe_frames(start: Column, end: Column, samples: int = 60, edge: int = 10, share: float = 0.02) -> Column:
    """Frames to probe: `edge` in the first and last share of the range, the rest evenly between; distinct and sorted."""
    size = end - start
    head, tail = start + size * share, end - size * share
    spread = lambda a, b, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(a + (b - a) * i / max(1, n - 1)))
    return F.array_sort(F.array_distinct(F.concat(spread(start, head, edge), spread(head, tail, samples - 2 * edge), spread(tail, end, edge))))


def frame_number(stem: Column) -> Column:
    """The frame number in an exported name, null if there is none."""
    return F.regexp_extract(stem, r"_F(\d+)", 1).try_cast("long")


def preferred_variants(files: DataFrame, stem: str, order: tuple[str, ...] = ("png", "jpg", "jpeg")) -> DataFrame:
    """Of the files with one stem the one whose suffix comes first, then the lower path."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))), F.lit(0)), F.lit(99))
    return files.groupBy(stem).agg(F.min_by("path", F.struct(rank, F.lower("path"))).alias("path"))


def bundles(files: DataFrame) -> DataFrame:
    """video, race and the artefacts of each, from paths like <video>/Race_001/<kind>...; races without a score bundle go."""
    p = F.regexp_extract("path", r"([^/]+)/Race_(\d+)/([^/]+)", 1)
    rows = files.select(p.alias("video"), F.regexp_extract("path", r"/Race_(\d+)/", 1).try_cast("int").alias("race"), F.regexp_extract("path", r"/Race_\d+/([A-Za-z0-9]+)", 1).alias("kind"), "path").where(F.col("race").isNotNull() & F.col("kind").isin(*KINDS))
    grouped = rows.groupBy("video", "race").agg(F.array_sort(F.collect_list(F.struct("kind", "path"))).alias("items"))
    return grouped.where(F.exists("items", lambda x: x["kind"] == "2RaceScore"))


def read_metadata(spark: SparkSession, path: str, layout: str = "lan2_split_2p") -> DataFrame:
    """The exported frames' table: `;`-separated with a header, rows without a usable key dropped, the last row of a key kept."""
    raw = spark.read.schema(METADATA).option("sep", ";").option("header", True).csv(path).withColumn("__at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    use = raw.withColumn("race", F.trim("race").try_cast("int")).where((F.trim("video") != "") & F.col("race").isNotNull() & (F.trim("kind") != ""))
    rest = [c for c in use.columns if c not in ("video", "race", "kind", "__at")]
    last = use.groupBy("video", "race", "kind").agg(F.max_by(F.struct(*rest), F.col("__at")).alias("r"))
    return last.select("video", "race", "kind", *(F.col(f"r.{c}").alias(c) for c in rest)).withColumn("layout", F.when(F.trim(F.coalesce("layout", F.lit(""))) == "", layout).otherwise(F.col("layout")))


def read_catalog(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One array of a catalog document (cups, tracks or characters) as rows."""
    doc = spark.read.schema(f"{part} array<struct<id:int,name:string,cup_index:int>>").option("multiLine", True).json(path)
    return doc.select(F.inline(part))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, below spark.checkpoint.dir; deleted when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/tallyforge/{name}-{uuid.uuid4().hex[:12]}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def write_metadata(df: DataFrame, path: str) -> None:
    """Exported frames as read_metadata reads them."""
    df.select(*(F.col(c.split()[0]).cast("string") for c in METADATA.split(", "))).write.mode("append").option("sep", ";").option("header", True).csv(path)


def write_results(df: DataFrame, folder: str, name: str) -> None:
    """A result table as CSV with a header, as one directory of part files (their number follows the data)."""
    df.write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}")


def write_trace(df: DataFrame, folder: str) -> None:
    """Events as JSON lines; runs append."""
    df.write.mode("append").json(folder)


def overwrite_sources(df: DataFrame, folder: str) -> None:
    """Replace the partitions of the sources in `df` only, leave those of all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("race_class").parquet(folder)


def artefact_counts(rows: DataFrame) -> DataFrame:
    """Artefacts by kind per source."""
    return rows.groupBy("video").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in KINDS])
