"""Changing a taxonomy: ordered batches of category and element changes, replayed for each category.

A change batch is (item_no, action, path, feature, grade) for categories, or (item_no, action, name, elements) for elements.
Parquet has no merge, so a change makes a new version of the table; write it beside the old one and switch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .taxonomy import path_key


def replay_changes(tax: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, existed, present, feature, grade, log) of every category that a batch names; log has each item's outcome.

    Create needs an absent category, update and delete a present one; empty new values keep the old ones. Items on one path apply
    in the order of item_no; items on different paths don't touch each other. Whether a category is there before an item is told
    by the last create or delete on its path, whether that succeeded or not, so a path is a window, and its end an aggregate.
    """
    held = tax.groupBy(path_key(F.col("path")).alias("_held")).agg(F.min_by(F.struct("feature", "grade"), "row_no").alias("now"))
    ops = changes.select(path_key(F.col("path")).alias("key"), "path", "item_no", "action", "feature", "grade").join(held, F.col("key") == F.col("_held"), "left").withColumn("existed", F.col("now").isNotNull())
    order = ["item_no", "action", "feature", "grade"]
    create, update, delete = (F.col("action") == a for a in ("create", "update", "delete"))
    before = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    told = ops.withColumn("_there", F.when(create, F.lit(True)).when(delete, F.lit(False)))
    was = F.coalesce(F.last("_there", ignorenulls=True).over(before), F.col("existed"))
    done = told.withColumn("_was", was).withColumn("_ok", F.when(create, ~F.col("_was")).when(update | delete, F.col("_was")).otherwise(F.lit(False))).withColumn("_at", F.struct(*order))
    new = lambda name: F.when(F.col("_ok") & create, F.coalesce(name, F.lit(""))).when(F.col("_ok") & update, F.nullif(F.col(name), F.lit("")))
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col("_at")))
    item = F.struct(F.col("item_no").cast("bigint").alias("item_no"), "action", F.col("_ok").alias("ok"))
    folded = done.groupBy("key").agg(
        F.first("path").alias("path"), F.first("existed").alias("existed"), F.first("now").alias("now"), last(F.col("_there")).alias("_there"),
        last(new("feature")).alias("_feature"), last(new("grade")).alias("_grade"), F.array_sort(F.collect_list(item)).alias("log"),
    )
    value = lambda name: F.coalesce(f"_{name}", f"now.{name}").alias(name)
    return folded.select("path", "existed", F.coalesce("_there", "existed").alias("present"), value("feature"), value("grade"), "log")


def outcomes(replayed: DataFrame) -> DataFrame:
    """(item_no, action, ok) of every item."""
    return replayed.select(F.explode("log").alias("x")).select("x.item_no", "x.action", "x.ok")


def apply_changes(tax: DataFrame, changes: DataFrame) -> DataFrame:
    """The taxonomy after a batch; new categories follow the last row, in an order that their paths fix, without elements."""
    after = replay_changes(tax, changes).withColumn("_key", path_key(F.col("path"))).select("_key", "path", "existed", "present", F.col("feature").alias("_feature"), F.col("grade").alias("_grade"))
    known = after.where("existed").drop("path")
    kept = tax.join(known, path_key(F.col("path")) == F.col("_key"), "left").where("_key IS NULL OR present")
    kept = kept.withColumn("feature", F.when(F.col("_key").isNotNull(), F.col("_feature")).otherwise(F.col("feature"))).withColumn("grade", F.when(F.col("_key").isNotNull(), F.col("_grade")).otherwise(F.col("grade"))).select(tax.columns)
    last = tax.agg(F.coalesce(F.max("row_no"), F.lit(-1)).alias("last"))
    from .kb import ranked

    new = ranked(after.where("NOT existed AND present"), F.md5(F.col("_key").cast("binary")), "_key").withColumnRenamed("_rank", "rank").crossJoin(F.broadcast(last))
    values = {"row_no": F.col("last") + F.col("rank"), "path": F.col("path"), "feature": F.col("_feature"), "grade": F.col("_grade"), "condition": F.lit(""), "elements": F.array().cast("array<string>")}
    made = new.select(*[values.get(f.name, F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in tax.schema])
    return kept.unionByName(made)


def replace_all(tax: DataFrame, changes: DataFrame) -> DataFrame:
    """The taxonomy as a batch of creates alone makes it."""
    return apply_changes(tax.limit(0), changes)


def element_change(elements: Column, ops: Column) -> Column:
    """Elements after ordered changes: add appends what is new, update replaces, delete takes the first of each name."""

    def less(own: Column, gone: Column) -> Column:
        def take(left: Column, x: Column) -> Column:
            at = F.array_position(left, x)
            return F.when(at > 0, F.concat(F.slice(left, F.lit(1), (at - 1).cast("int")), F.slice(left, (at + 1).cast("int"), F.greatest(F.size(left), F.lit(1))))).otherwise(left)

        return F.aggregate(gone, own, take)

    def step(own: Column, o: Column) -> Column:
        return (
            F.when(o["action"] == "add", F.concat(own, F.array_except(o["elements"], own)))
            .when(o["action"] == "update", o["elements"])
            .when(o["action"] == "delete", less(own, o["elements"]))
            .otherwise(own)
        )

    return F.aggregate(F.array_sort(ops), elements, lambda own, o: step(own, o))


def apply_element_changes(tax: DataFrame, changes: DataFrame) -> DataFrame:
    """The taxonomy after element changes (item_no, action, name, elements); they hold for rows with a level of that name.

    What precedes a name's last replacement has no effect on any row, and adding again what the same name was given since it was
    last cut changes nothing, so such items go before rows meet them: what a row takes is bounded by the different elements of its
    names and the cuts since they were last replaced, not by the items.
    """
    last = changes.where("action = 'update'").groupBy("name").agg(F.max("item_no").alias("_last"))
    # of one number, replacements come last
    changes = changes.join(last, "name", "left").where("_last IS NULL OR item_no > _last OR (item_no = _last AND action = 'update')").drop("_last")
    w = Window.partitionBy("name").orderBy("item_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = changes.withColumn("_span", F.sum((F.col("action") != "add").cast("int")).over(w))
    adds = each.where("action = 'add'").select("name", "_span", "item_no", F.posexplode("elements").alias("_i", "e")).groupBy("name", "_span", "e").agg(F.min(F.struct("item_no", "_i")).alias("at"))
    first = adds.groupBy("name", F.col("at.item_no").alias("item_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at._i", "e"))), lambda x: x["e"]).alias("elements"))
    less = changes.where("action <> 'add'").select("name", "item_no", "action", "elements").unionByName(first.withColumn("action", F.lit("add")))
    folded = less.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("item_no", "action", "elements"))).alias("_each"))
    named = tax.select("row_no", F.explode(F.array_distinct("path")).alias("name"))
    ops = named.join(folded, "name").groupBy("row_no").agg(F.flatten(F.collect_list("_each")).alias("_ops"))
    out = tax.join(ops, "row_no", "left")
    return out.withColumn("elements", F.when(F.col("_ops").isNotNull(), element_change(F.col("elements"), F.col("_ops"))).otherwise(F.col("elements"))).select(tax.columns)


def rename_element(tax: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """The taxonomy with an element renamed in every row, and one row (replaced) with the number of places."""
    changed = tax.withColumn("elements", F.transform("elements", lambda x: F.when(x == old, F.lit(new)).otherwise(x)))
    return changed, tax.agg(F.coalesce(F.sum(F.size(F.filter("elements", lambda x: x == old))), F.lit(0)).alias("replaced"))


def origin_rows(tax: DataFrame) -> DataFrame:
    """(spec_uid, path, doc_name, chunk): each row as a chunk of its category."""
    return tax.select("spec_uid", "path", F.lit("origin_data").alias("doc_name"), F.to_json(F.struct(*[c for c in tax.columns if c != "spec_uid"])).alias("chunk"))


def delete_documents(chunks: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks without the documents (spec_uid, path, doc_name) of ``wanted``, and those of wanted that are not there."""
    key = lambda df: df.withColumn("_key", F.concat_ws("\x1e", "spec_uid", path_key(F.col("path")), "doc_name"))
    a, b = key(chunks), key(wanted)
    return a.join(b.select("_key").distinct(), "_key", "left_anti").drop("_key"), b.join(a.select("_key").distinct(), "_key", "left_anti").drop("_key")


def emptied_categories(chunks: DataFrame, left: DataFrame) -> DataFrame:
    """(spec_uid, path) of categories that had chunks and have none left."""
    key = lambda df: df.withColumn("_key", F.concat_ws("\x1e", "spec_uid", path_key(F.col("path"))))
    return key(chunks).select("_key", "spec_uid", "path").distinct().join(key(left).select("_key").distinct(), "_key", "left_anti").drop("_key")


def remaining_classes(classes: DataFrame, chunks: DataFrame, left: DataFrame) -> DataFrame:
    """Class rows (doc_id, ...) without those of documents all of whose chunks are gone."""
    gone = chunks.select(F.col("doc_name").alias("doc_id")).distinct().join(left.select(F.col("doc_name").alias("doc_id")).distinct(), "doc_id", "left_anti")
    return classes.join(gone, "doc_id", "left_anti")
