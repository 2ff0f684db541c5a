"""Category trees: an edge table, nested JSON, scene types, original names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grades import lowest_grade, scene_type
from .taxonomy import path_key, prefixes, used_path


def tree_edges(tax: DataFrame) -> DataFrame:
    """(node, parent, depth, name, grade, annotate, n_children): a node for each prefix of a path.

    node and parent are path keys; grade and annotate are those of the first row that ends at the node, empty if none does.
    """
    used = tax.withColumn("path", used_path(F.col("path")))
    nodes = used.select(F.explode(prefixes(F.col("path"))).alias("p"), "path", "row_no", "grade", "feature")
    own = F.size("p") == F.size("path")
    first = lambda c: F.min_by(F.when(own, F.col(c)), F.when(own, F.col("row_no")))
    named = nodes.groupBy(path_key(F.col("p")).alias("node")).agg(F.first("p").alias("p"), first("grade").alias("grade"), first("feature").alias("annotate"))
    out = named.select("node", F.when(F.size("p") > 1, path_key(F.slice("p", F.lit(1), F.size("p") - 1))).alias("parent"), F.size("p").alias("depth"), F.get("p", F.size("p") - 1).alias("name"), F.coalesce(lowest_grade(F.col("grade")), F.lit("")).alias("grade"), F.coalesce("annotate", F.lit("")).alias("annotate"))
    children = out.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_of")).agg(F.count("*").alias("_n"))
    return out.join(children, F.col("node") == F.col("_of"), "left").withColumn("n_children", F.coalesce("_n", F.lit(0))).drop("_of", "_n")


def tree_json(edges: DataFrame) -> DataFrame:
    """(name, json) of each root: DataClassification, DataGrading, Annotate, SubDataClassifications, children by name.

    Built from the leaves up, one grouping per level, however deep the tree is; no edges give no rows.
    """
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    done = None
    deepest_level = edges.agg(F.max("depth")).first()[0] or 1
    for depth in range(deepest_level, 0, -1):
        own = edges.where(F.col("depth") == depth)
        if done is not None:
            below = done.groupBy(F.col("parent").alias("_of")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "json"))), lambda x: x["json"]), ",").alias("_sub"))
            own = own.join(below, F.col("node") == F.col("_of"), "left")
        else:
            own = own.withColumn("_sub", F.lit(None).cast("string"))
        done = own.select("parent", "name", F.concat(F.lit('{"DataClassification":'), text("name"), F.lit(',"DataGrading":'), text("grade"), F.lit(',"Annotate":'), text("annotate"), F.lit(',"SubDataClassifications":['), F.coalesce("_sub", F.lit("")), F.lit("]}")).alias("json"))
    return done.select("name", "json")


def element_scenes(mappings: DataFrame, tax: DataFrame) -> DataFrame:
    """(element, category, scenes): the sorted scene types of the grades of the element's category; none without a grade."""
    from .taxonomy import deepest

    graded = tax.where("grade <> ''").select(deepest(F.col("path")).alias("category"), scene_type(F.col("grade")).alias("scene")).distinct()
    by = graded.groupBy("category").agg(F.array_sort(F.collect_set("scene")).alias("scenes"))
    return mappings.join(by, "category", "left").withColumn("scenes", F.coalesce("scenes", F.array().cast("array<int>")))


def with_scene(rows: DataFrame, grade: str = "grade") -> DataFrame:
    return rows.withColumn("scene", scene_type(F.col(grade)))


def original_names(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """rows with coded names of a column put back; mapping is (coded, original), and other names stay."""
    own = mapping.groupBy(F.col("coded").alias("_coded")).agg(F.min("original").alias("_original"))
    return rows.join(own, F.col(column) == F.col("_coded"), "left").withColumn(column, F.coalesce("_original", column)).drop("_coded", "_original")


def post_process(edges: DataFrame, grades: DataFrame, mappings: DataFrame, tax: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scene types on the three outputs: tree nodes, grades, elements."""
    return with_scene(edges), with_scene(grades), element_scenes(mappings, tax)


