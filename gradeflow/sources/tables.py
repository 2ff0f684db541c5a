"""Taxonomies, chunks, collections, classes, results and messages as tables.

Tables are Parquet under a folder, partitioned by specification and kind. A rebuild writes whole partitions, so running it
again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsing import parse_elements
from ..operators.ordinals import with_ordinal

FORM = "header map<string,string>, data map<string,string>"


def read_taxonomy(spark: SparkSession, path: str, spec_uid: str) -> tuple[DataFrame, DataFrame]:
    """The taxonomy in a file of JSON lines, and its bad lines (row_no, raw_json), which a rewrite keeps.

    Columns are told by their header: levels end with 分类, then 对应特征, 等级, 条件, 真实数据; levels count in numeric key order.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_o"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias("raw_json"))
    numbered = with_ordinal(lines.where(F.trim("raw_json") != ""), ["_f", "_o"], ["_i"], "row_no")
    parsed = numbered.withColumn("row_no", (F.col("row_no") + 1).cast("long")).withColumn("p", F.from_json("raw_json", FORM))
    good = parsed.where("p.header IS NOT NULL AND p.data IS NOT NULL").withColumn("h", F.array_sort(F.transform(F.map_entries("p.header"), lambda e: F.struct(e["key"].cast("int").alias("k"), e["key"].alias("key"), e["value"].alias("name")))))
    value = lambda e: F.coalesce(F.try_element_at("p.data", e["key"]), F.lit(""))
    role = lambda name: F.coalesce(F.get(F.transform(F.filter("h", lambda e: e["name"] == name), value), F.lit(0)), F.lit(""))
    path_of = F.transform(F.filter("h", lambda e: e["name"].endswith("分类")), value)
    tax = good.select(F.lit(spec_uid).alias("spec_uid"), "row_no", path_of.alias("path"), F.size(F.filter(path_of, lambda x: x != "")).alias("depth"), role("对应特征").alias("feature"), role("等级").alias("grade"), role("条件").alias("condition"), parse_elements(role("真实数据")).alias("elements"), "raw_json")
    return tax, parsed.where("p.header IS NULL OR p.data IS NULL").select("row_no", "raw_json")


def standard_lines(tax: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """(value, row_no): the taxonomy as JSON lines in header and data form, kept bad lines at their places."""
    numerals = F.array(*[F.lit(f"{n}级分类") for n in "一二三四五六七八九十"])
    names = F.concat(F.slice(numerals, F.lit(1), F.size("path")), F.array(*map(F.lit, ("对应特征", "等级", "条件", "真实数据"))))
    values = F.concat("path", F.array("feature", "grade", "condition", F.to_json("elements")))
    keyed = lambda xs: F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: i.cast("string")), xs)
    lines = tax.select("row_no", F.to_json(F.struct(keyed(names).alias("header"), keyed(values).alias("data"))).alias("value"))
    return lines if bad is None else lines.unionByName(bad.select("row_no", F.col("raw_json").alias("value")))


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrites the partitions that df has rows for; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks (spec_uid, category_path, doc_name, chunk_no, chunk) by specification, category and document."""
    write_partitions(chunks.withColumn("category", F.array_join("category_path", "|")).withColumn("doc", F.col("doc_name")), path, "spec_uid", "category", "doc")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(spec_uid, category_path, doc_name, chunk_no, line) of chunks with text, stripped."""
    stripped = F.trim("chunk")
    return spark.read.parquet(path).where(stripped != "").select("spec_uid", "category_path", "doc_name", "chunk_no", stripped.alias("line"))


def read_chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, category_path, doc_name, line_no, line) of the lines with text of Markdown files below a folder; line_no counts
    a file's lines from 1. A file of chunks is read as a whole."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    last = folder.rstrip("/").split("/")[-1]
    parts = F.split(F.regexp_replace("path", f"^.*?/\\Q{last}\\E/", ""), "/")
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("_i", "_line")).where(F.trim("_line") != "")
    return lines.select("path", F.slice(parts, F.lit(1), F.size(parts) - 1).alias("category_path"), F.element_at(parts, -1).alias("doc_name"), (F.col("_i") + 1).alias("line_no"), F.trim("_line").alias("line"))


def collection_name(spec_uid: Column, kind: str) -> Column:
    """The name of a collection: dashes as underscores, a leading underscore unless a letter or one begins it."""
    name = F.concat(F.replace(spec_uid, F.lit("-"), F.lit("_")), F.lit(f"_{kind}"))
    return F.when(name.rlike("^[A-Za-z_]"), name).otherwise(F.concat(F.lit("_"), name))


def rebuild_collections(records: DataFrame, path: str, spec_uids: list[str], attempts: int = 10) -> int:
    """Replaces all kinds of the given specifications: kinds without records become empty, so none is stale. Returns the version.

    Only these specifications are written, to a folder of their own. A version is a list of folders, one for each specification,
    so the others are linked, not copied. It counts when its number's file is made, which only one can do: of two rebuilds at once
    the later one takes the other's list and tries the next number. What fails before leaves the old version as it is.
    """
    spark, build = records.sparkSession, uuid.uuid4().hex
    folder = f"{path}/data/build={build}"
    records.where(F.col("spec_uid").isin(spec_uids)).write.mode("errorifexists").partitionBy("spec_uid", "kind").parquet(folder)
    made = [r.spec_uid for r in spark.read.parquet(folder).select("spec_uid").distinct().collect()] if _listed(spark, folder) else []
    for _ in range(attempts):
        version = latest_version(spark, path)
        held = {s: b for s, b in manifest(spark, path, version).items() if s not in spec_uids} | dict.fromkeys(made, build)
        number = 1 + int((_listed(spark, f"{path}/versions") or ["0"])[-1])
        if _created(spark, f"{path}/versions/{number:08d}", json.dumps(held)):
            return number
    raise RuntimeError(f"{path} changed {attempts} times meanwhile")


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    """Hadoop's file system of a path, and the path there."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _listed(spark: SparkSession, path: str) -> list[str]:
    files, at = _files(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at) if not x.getPath().getName().startswith(("_", "."))) if files.exists(at) else []


def _created(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call made the file; one that is there stays as it is."""
    files, at = _files(spark, path)
    try:
        out = files.create(at, False)
    except Exception as e:
        if files.exists(at):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The last version whose list is whole; a number whose file nothing more is written to is passed over."""
    for name in reversed(_listed(spark, f"{path}/versions")):
        if _manifest(spark, f"{path}/versions/{name}") is not None:
            return int(name)
    return None


def _manifest(spark: SparkSession, file: str) -> dict[str, str] | None:
    text = spark.read.text(file, wholetext=True).first()
    try:
        return json.loads(text[0]) if text else None
    except ValueError:
        return None


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[str, str]:
    """The build of each specification in a version, the latest one by default."""
    version = latest_version(spark, path) if version is None else version
    return {} if version is None else _manifest(spark, f"{path}/versions/{version:08d}") or {}


def current_collections(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The records of a version; None before there is one, or if it has no records."""
    builds = manifest(spark, path, version)
    if not builds:
        return None
    kept = spark.read.option("basePath", f"{path}/data").option("mergeSchema", True).parquet(*(f"{path}/data/build={b}" for b in sorted(set(builds.values()))))
    pairs = F.create_map(*[F.lit(x) for kv in sorted(builds.items()) for x in kv])
    return kept.where(F.col("build") == F.try_element_at(pairs, F.col("spec_uid"))).drop("build")


def scan_collection(records: DataFrame, predicate: Column | None = None, columns: list[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Records by id, filtered and projected before they are paged."""
    out = records if predicate is None else records.where(predicate)
    out = out.select(*({*(columns or out.columns), "id"})).orderBy("id")
    out = out.offset(offset) if offset else out
    out = out if limit is None else out.limit(limit)
    return out.select(*(columns or out.columns))


def keyword_scan(records: DataFrame, keyword: str, column: str = "text") -> DataFrame:
    return records.where(F.contains(F.col(column), F.lit(keyword)))


def copy_collection(spark: SparkSession, source: str, target: str) -> None:
    spark.read.parquet(source).write.mode("errorifexists").parquet(target)


def collection_statistics(records: DataFrame) -> DataFrame:
    return records.groupBy("spec_uid", "kind").agg(F.count("*").alias("row_count"))


def look_up_classes(docs: DataFrame, memory: DataFrame, stored: DataFrame) -> DataFrame:
    """docs with doc_class from memory, else from the stored table; both are (doc_id, doc_class)."""
    m, s = memory.select("doc_id", F.col("doc_class").alias("_m")), stored.select("doc_id", F.col("doc_class").alias("_s"))
    return docs.join(m, "doc_id", "left").join(s, "doc_id", "left").withColumn("doc_class", F.coalesce("_m", "_s")).drop("_m", "_s")


def clear_classes(stored: DataFrame, doc_ids: DataFrame | None = None) -> DataFrame:
    return stored.limit(0) if doc_ids is None else stored.join(doc_ids.select("doc_id"), "doc_id", "left_anti")


def write_classes(classes: DataFrame, path: str) -> None:
    """Adds class rows (doc_id, doc_class) to the store; a later row of a document counts."""
    classes.select("doc_id", "doc_class", F.current_timestamp().alias("written_at")).write.mode("append").parquet(path)


def list_classes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doc_class) of all documents in the store."""
    return spark.read.parquet(path).groupBy("doc_id").agg(F.max_by("doc_class", F.struct("written_at", "doc_class")).alias("doc_class"))


def write_results(results: DataFrame, path: str) -> None:
    """Recognition results as JSON by database and table; results of other tables stay."""
    named = results.withColumn("db", F.coalesce("dbName", F.lit("none"))).withColumn("tbl", F.coalesce("tableName", F.lit("none")))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("db", "tbl").json(path)


def write_dump(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_final(spark: SparkSession, path: str, spec_uid: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("spec_uid") == spec_uid)


#: Content types of messages.
STATUS, GRADES, TREE, MAPPINGS = 0, 1, 2, 3


def envelope(value: Column, content_type: int, task: Column, at: Column) -> Column:
    """The JSON text of a message."""
    return F.to_json(F.struct(F.lit(content_type).alias("PushContentType"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("PushDate"), task.alias("TaskUId"), value.alias("Value")))


def batched(rows: DataFrame, order: str, size: int = 10, by: str | None = None) -> DataFrame:
    """(batch_no, n, payload): rows as JSON arrays of ``size`` in order; ``by`` batches within each value of a column.

    Rows are numbered within hash-free ranges of the order column: counts per range first, so no window holds all rows.
    """
    keys = [by] if by else []
    ranged = rows.withColumn("_r", F.floor(F.col(order).cast("double") / 4096))
    sizes = ranged.groupBy(*keys, "_r").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*keys, "_r").orderBy(order))
    numbered = ranged.join(before, [*keys, "_r"]).withColumn("_no", F.col("_before") + rank - 1)
    payload = F.struct(*[c for c in rows.columns if c not in (order, by)])
    items = F.array_sort(F.collect_list(F.struct("_no", payload.alias("v"))))
    return numbered.groupBy(*keys, F.floor(F.col("_no") / size).alias("batch_no")).agg(F.count("*").alias("n"), F.to_json(F.transform(items, lambda x: x["v"])).alias("payload"))


def send(messages: DataFrame, path: str | None = None, kafka: dict[str, str] | None = None) -> None:
    """Messages (value) to Kafka, if options are given, else to text files."""
    if kafka:
        messages.selectExpr("cast(value AS string) AS value").write.format("kafka").options(**kafka).save()
    else:
        messages.select("value").write.mode("append").text(path)
