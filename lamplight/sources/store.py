"""Datasets and artifacts by path: any Hadoop file system, local or object store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lamplight.functions.text import slug

# What a run's artifacts and datasets are called below the root.
ARTIFACTS = {"raw_html": ("html", "html"), "candidate_text": ("text", "txt"), "tei": ("tei", "xml"), "transcript_json": ("transcripts", "json")}
DATASETS = ["people", "locations", "claims", "events", "sources"]
CONTENTS_LINK, CONTENTS_END = "/hadc/transcript/", ".htm"
RUN_FORMAT = "yyyyMMdd'T'HHmmss'Z'"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def resolve(root: str, name: str) -> str:
    """The path of a name below the root; ValueError if it leads out of it."""
    parts: list[str] = []
    for x in name.split("/"):
        if x == "..":
            if not parts:
                raise ValueError(f"{name!r} leads out of {root!r}")
            parts.pop()
        elif x not in ("", "."):
            parts.append(x)
    if name.startswith("/") or "://" in name:
        raise ValueError(f"{name!r} leads out of {root!r}")
    return "/".join([root.rstrip("/"), *parts])


def clear(spark: SparkSession, path: str) -> int:
    """Deletes a folder; returns how many files it held."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return 0
    n = fs.getContentSummary(p).getFileCount()
    fs.delete(p, True)
    return n


def read_items(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON dataset: a list or {"items": [...]}; a missing one is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    boxed = spark.read.schema(StructType().add("items", ArrayType(schema))).json(path, multiLine=True).where("items is not null")
    return boxed.select(F.inline("items")) if not boxed.isEmpty() else spark.read.schema(schema).json(path, multiLine=True)


def jsonl_rows(raw: Column) -> Column:
    """Of a model's answer, the lines that are JSON objects with a key `text`, as variants."""
    lines = F.transform(F.split(raw, r"\r?\n"), F.trim)
    good = F.filter(lines, lambda x: x.rlike(r"^\{.*\}$") & F.try_parse_json(x).isNotNull())
    return F.filter(good, lambda x: F.array_contains(F.json_object_keys(x), "text"))


def save_run(df: DataFrame, root: str, name: str, run_id: str) -> None:
    """Writes one run's rows of a dataset; a repeated run replaces its own."""
    df.write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}")


def load_run(spark: SparkSession, root: str, name: str, run_id: str | None = None) -> DataFrame:
    """The rows of a run, or of the latest."""
    out = spark.read.parquet(f"{root}/{name}")
    run_id = run_id or out.agg(F.max("run_id")).first()[0]
    return out.where(F.col("run_id") == run_id)


def run_id(spark: SparkSession, at: str | None = None) -> str:
    """A run's name: its time in UTC, to the second. at is an ISO time to name instead of now."""
    now = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    return spark.range(1).select(F.date_format(F.to_utc_timestamp(now, F.current_timezone()), RUN_FORMAT)).first()[0]


def artifact_paths(root: str, run: Column, source: Column) -> Column:
    """The paths of a source's artifacts in a run."""
    return F.struct(*(F.concat_ws("/", F.lit(root), run, F.lit(folder), F.concat(source, F.lit(f".{end}"))).alias(name) for name, (folder, end) in ARTIFACTS.items()))


def cache_paths(root: str, key: Column, page: Column) -> Column:
    return F.struct(*(F.concat_ws("/", F.lit(root), key, page, F.lit(f"{x}.json")).alias(x) for x in ("bundle", "metadata")))


def brief_path(root: str, run: Column, model: Column, page: Column) -> Column:
    return F.concat_ws("/", F.lit(root), run, slug(model), page, F.lit("briefing.json"))


def corpus_urls(contents: str, links: DataFrame) -> DataFrame:
    """(url, ordinal) to fetch: the table of contents, then the transcripts that it links to (url, index), each once."""
    first = links.where(F.col("url").contains(CONTENTS_LINK) & F.col("url").endswith(CONTENTS_END) & (F.col("url") != contents)).groupBy("url").agg((F.min("index") + 1).cast("long").alias("ordinal"))
    return first.union(links.sparkSession.createDataFrame([(contents, 0)], "url string, ordinal long"))


def pull(fetched: DataFrame, root: str, run: str) -> DataFrame:
    """Saves a run's pages with the paths of their artifacts; returns them as saved. The latest run is the last one saved."""
    save_run(fetched.withColumn("paths", artifact_paths(root, F.lit(run), F.col("source_id"))), root, "pages", run)
    return load_run(fetched.sparkSession, root, "pages", run)


def dataset(spark: SparkSession, root: str, name: str, schemas: dict[str, StructType]) -> DataFrame:
    """A named dataset as published; KeyError for a name there isn't, empty where nothing was published."""
    if name not in schemas:
        raise KeyError(name)
    return read_items(spark, f"{root}/{name}/latest.json", schemas[name])


def map_payload(spark: SparkSession, root: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """All datasets of the map."""
    return {name: dataset(spark, root, name, schemas) for name in DATASETS}


def clear_generated(spark: SparkSession, root: str) -> int:
    """Deletes what runs made (raw and enriched), not the cache; returns how many files that was."""
    return sum(clear(spark, resolve(root, x)) for x in ("raw", "enriched"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each file, whole; line ends as they are."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def last_bundle(pages: DataFrame, bundles: DataFrame, order: str) -> DataFrame:
    """Pages with the last bundle of their source, null if there is none."""
    rest = [c for c in bundles.columns if c != "source_id"]
    last = bundles.where("source_id <> ''").groupBy("source_id").agg(F.max_by(F.struct(*rest), order).alias("bundle"))
    return pages.join(last, "source_id", "left")
