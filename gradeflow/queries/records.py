"""Queries of the taxonomy, of workbook interpretation and of knowledge-base records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import changes, kb, taxonomy, tree
from ..plans import interpret, knowledge_base
from ..sources import tables
from .base import register, table
from .core import CLEAN, PLACES, TAX, part_taxonomy, place_taxonomy
from .documents import scratch
from .recognition import _embedded

_CLEAN = lambda x: CLEAN.replace("(t", f"({x}").replace(" t END", f" {x} END")


@register("t03_second_level", f"SELECT {_CLEAN('p_brand')} AS name, min(p_partkey) AS row_no FROM part GROUP BY 1")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.second_level_names(part_taxonomy(spark, sf_dir))


# Directories named after categories, some with a letter more, some after none.
DIRS = """dirs AS (SELECT DISTINCT user_id % 40 AS d, CASE user_id % 4 WHEN 0 THEN p_type WHEN 1 THEN concat(p_brand, 'x') WHEN 2 THEN p_name ELSE 'qqqq' END AS directory FROM events JOIN part ON p_partkey = user_id % 40)"""
MATCH = f"""names AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT {_CLEAN("p_name")} FROM part),
    subs AS (SELECT DISTINCT directory AS text, substr(directory, i, l) AS s FROM asked, unnest(range(1, length(directory) + 1)) AS a(i), unnest(range(1, length(directory) + 1)) AS b(l) WHERE i + l - 1 <= length(directory)),
    lcs AS (SELECT text, n.name, max(length(s)) AS l FROM subs JOIN names n ON contains(n.name, s) GROUP BY ALL),
    scored AS (SELECT a.directory AS text, n.name, CASE WHEN a.directory = n.name THEN 1.0 WHEN {_CLEAN("a.directory")} = {_CLEAN("n.name")} THEN 0.95 ELSE round(coalesce(l, 0) / greatest(length(a.directory), length(n.name)), 6) END AS score
               FROM asked a CROSS JOIN names n LEFT JOIN lcs ON lcs.text = a.directory AND lcs.name = n.name),
    cells AS (SELECT p_partkey AS row_no, 0 AS o, p_type AS name FROM part UNION ALL SELECT p_partkey, 1, {_CLEAN("p_type")} FROM part UNION ALL SELECT p_partkey, 2, p_brand FROM part UNION ALL SELECT p_partkey, 3, {_CLEAN("p_brand")} FROM part
              UNION ALL SELECT p_partkey, 4, p_name FROM part UNION ALL SELECT p_partkey, 5, {_CLEAN("p_name")} FROM part),
    rows AS (SELECT text, row_no, arg_min(score, o) AS score FROM scored JOIN cells USING (name) WHERE score >= 0.5 GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, row_no) AS rk FROM rows)"""


def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, part = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    name = F.expr("CASE user_id % 4 WHEN 0 THEN p_type WHEN 1 THEN concat(p_brand, 'x') WHEN 2 THEN p_name ELSE 'qqqq' END")
    return events.join(part, F.col("p_partkey") == F.col("user_id") % 40).select((F.col("user_id") % 40).alias("d"), name.alias("directory")).distinct()


@register("t06_matching_rows", f"WITH {DIRS}, asked AS (SELECT DISTINCT directory FROM dirs), {MATCH} SELECT text, row_no, score, rk FROM ranked")
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.matching_rows(directories(spark, sf_dir), part_taxonomy(spark, sf_dir), query="directory").select("text", "row_no", "score", "rk")


@register(
    "t07_matched_paths",
    f"""WITH {DIRS}, paths AS (SELECT DISTINCT [a.directory, b.directory] AS p FROM dirs a JOIN dirs b ON b.d = (a.d + 1) % 40), asked AS (SELECT DISTINCT directory FROM dirs), {MATCH},
        one AS (SELECT text, row_no, score FROM ranked WHERE rk = 1)
        SELECT array_to_string(p, '|') AS path, b.row_no, b.score FROM paths JOIN one a ON a.text = p[1] JOIN one b ON b.text = p[2]""",
)
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = directories(spark, sf_dir)
    paths = dirs.select("d", F.col("directory").alias("a")).join(dirs.select(((F.col("d") + 39) % 40).alias("d"), F.col("directory").alias("b")), "d").select(F.array("a", "b").alias("category_path"))
    found = taxonomy.match_paths(paths, part_taxonomy(spark, sf_dir))
    return found.select(F.replace("key", F.lit(taxonomy.SEPARATOR), F.lit("|")).alias("path"), "row_no", "score")


@register(
    "t14_replaced_taxonomy",
    """WITH c AS (SELECT p_type, p_brand, arg_min(p_name, p_partkey) AS feature FROM part GROUP BY ALL) SELECT concat(p_type, '|', p_brand) AS path, feature, 'L1' AS grade FROM c""",
)
def t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    creates = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_no"), F.lit("create").alias("action"), F.array("p_type", "p_brand").alias("path"), F.col("p_name").alias("feature"), F.lit("L1").alias("grade"))
    return changes.replace_all(part_taxonomy(spark, sf_dir), creates).select(F.array_join("path", "|").alias("path"), "feature", "grade")


@register("t16_renamed_element", f"WITH {TAX} SELECT row_no, replace(concat('|', array_to_string(elements, '|'), '|'), '|bolt|', '|screw|') AS elements, (SELECT sum(len(list_filter(elements, lambda x: x = 'bolt')))::BIGINT FROM tax) AS replaced FROM tax")
def t16(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, count = changes.rename_element(part_taxonomy(spark, sf_dir), "bolt", "screw")
    return after.crossJoin(F.broadcast(count)).select("row_no", F.concat(F.lit("|"), F.array_join("elements", "|"), F.lit("|")).alias("elements"), "replaced")


@register("t19_parsed_elements", "SELECT p_partkey, concat(split_part(p_name, ' ', 1), '|', split_part(p_name, ' ', 2)) AS elements FROM part")
def t19(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    text = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.array(a, b))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("['"), a, F.lit("', '"), b, F.lit("']"))).otherwise(F.concat(a, F.lit("， "), b, F.lit("、")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(parsing.parse_elements(text), "|").alias("elements"))


@register("t20_origin_chunks", f"WITH {TAX} SELECT concat(p_type, '|', p_brand, '|', p_name) AS path, row_no FROM tax")
def t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.origin_rows(part_taxonomy(spark, sf_dir))
    return rows.select(F.array_join("path", "|").alias("path"), F.get_json_object("chunk", "$.row_no").cast("long").alias("row_no"))


@register(
    "t31_tree_json",
    f"""WITH {PLACES}, g AS (SELECT path, concat('第', row_no % 4 + 1, '级') AS grade FROM places),
        leaf AS (SELECT path[1] AS r, path[2] AS n, path[3] AS name, concat('{{"DataClassification":"', path[3], '","DataGrading":"', grade, '","Annotate":"","SubDataClassifications":[]}}') AS j FROM g WHERE len(path) = 3),
        inner_n AS (SELECT path[1] AS r, path[2] AS name, concat('{{"DataClassification":"', path[2], '","DataGrading":"', grade, '","Annotate":"","SubDataClassifications":[', coalesce((SELECT string_agg(j, ',' ORDER BY name) FROM leaf WHERE leaf.r = path[1] AND leaf.n = path[2]), ''), ']}}') AS j FROM g WHERE len(path) = 2)
        SELECT path[1] AS name, md5(concat('{{"DataClassification":"', path[1], '","DataGrading":"', grade, '","Annotate":"","SubDataClassifications":[', coalesce((SELECT string_agg(j, ',' ORDER BY name) FROM inner_n WHERE inner_n.r = path[1]), ''), ']}}')) AS json_md5 FROM g WHERE len(path) = 1""",
)
def t31_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.tree_json(tree.tree_edges(place_taxonomy(spark, sf_dir))).select("name", F.md5(F.col("json").cast("binary")).alias("json_md5"))


@register("t33_scenes", f"WITH {TAX} SELECT row_no, CASE WHEN contains(grade, '核心数据') THEN 3 WHEN contains(grade, '重要数据') THEN 2 ELSE 1 END AS scene FROM tax")
def t33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.with_scene(part_taxonomy(spark, sf_dir)).select("row_no", "scene")


@register("t34_original_names", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE concat('X', p_size, ' ', p_brand) END AS name FROM part")
def t34(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    coded = F.concat(F.lit("X"), F.col("p_size").cast("string"), F.lit(" "), "p_brand")
    mapping = part.where("p_size % 2 = 0").select(coded.alias("coded"), F.col("p_brand").alias("original"))
    return tree.original_names(part.select("p_partkey", coded.alias("name")), mapping, "name")


@register(
    "t35_deleted_documents",
    """WITH c AS (SELECT doc_id, lang, source FROM documents), gone AS (SELECT doc_id FROM c WHERE doc_id % 3 = 0 OR source = 'src1'), left_c AS (SELECT * FROM c WHERE doc_id NOT IN (SELECT doc_id FROM gone))
       SELECT 'left' AS what, concat('doc', doc_id) AS name FROM left_c UNION ALL SELECT 'missing', 'docnone' UNION ALL SELECT 'empty', concat(lang, '|', source) FROM (SELECT DISTINCT lang, source FROM c EXCEPT SELECT DISTINCT lang, source FROM left_c)
       UNION ALL SELECT 'class', concat('doc', doc_id) FROM left_c""",
)
def t35(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.lit("s").alias("spec_uid"), F.array("lang", "source").alias("path"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"))
    wanted = chunks.where("doc_id % 3 = 0 OR path[1] = 'src1'").select("spec_uid", "path", "doc_name")
    absent = wanted.limit(1).select("spec_uid", F.array(F.lit("en"), F.lit("none")).alias("path"), F.lit("docnone").alias("doc_name"))
    left, missing = changes.delete_documents(chunks, wanted.union(absent))
    classes = changes.remaining_classes(chunks.select(F.col("doc_name").alias("doc_id"), F.lit("1").alias("doc_class")), chunks, left)
    named = lambda what, df, c: df.select(F.lit(what).alias("what"), c.alias("name"))
    return (
        named("left", left, F.col("doc_name"))
        .union(named("missing", missing, F.col("doc_name")))
        .union(named("empty", changes.emptied_categories(chunks, left), F.array_join("path", "|")))
        .union(named("class", classes, F.col("doc_id")))
    )


# ---- workbook ----


@register(
    "i01_sheet_errors",
    """WITH h AS (SELECT DISTINCT p_size % 7 AS col FROM part) SELECT 'Sheet1' AS sheet, col::INT AS col, concat('expected ', CASE WHEN col = (SELECT max(col) FROM h) THEN '对应特征' ELSE concat(['一','二','三','四','五','六','七'][col + 1], '级分类') END, ', found x', col) AS error FROM h WHERE col > 0
       UNION ALL SELECT 'Sheet2', 1, 'expected 子类及范围, found nothing'""",
)
def i01(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = table(spark, sf_dir, "part").select((F.col("p_size") % 7).alias("col")).distinct()
    sheet1 = cols.select(F.lit("Sheet1").alias("sheet"), F.col("col").cast("int").alias("col"), F.when(F.col("col") == 0, "一级分类").otherwise(F.concat(F.lit("x"), F.col("col").cast("string"))).alias("text"))
    sheet2 = cols.where("col = 0").select(F.lit("Sheet2").alias("sheet"), F.lit(0).alias("col"), F.lit("类别").alias("text"))
    return interpret.validate(sheet1.union(sheet2))


NUMBERED = """f AS (SELECT p_type, min(p_partkey) AS k FROM part GROUP BY p_type), g AS (SELECT p_type, p_brand, min(p_partkey) AS k FROM part GROUP BY ALL),
    a AS (SELECT p_type, chr((64 + row_number() OVER (ORDER BY k))::INT) AS c1 FROM f), b AS (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY k) AS n FROM g),
    numbered AS (SELECT p_partkey AS row_no, p_type, p_brand, c1, concat(c1, n) AS c2 FROM part JOIN a USING (p_type) JOIN b USING (p_type, p_brand))"""


def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpret.number_levels(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.array("p_type", "p_brand").alias("cells")), 2)


@register(
    "i03_replacements",
    f"""WITH {NUMBERED}, n AS (SELECT p_type AS original, concat(c1, ' ', p_type) AS coded, 0 AS level, row_no FROM numbered UNION ALL SELECT p_brand, concat(c2, ' ', p_brand), 1, row_no FROM numbered)
        SELECT original, coded FROM (SELECT *, row_number() OVER (PARTITION BY original ORDER BY length(coded) DESC, level, row_no) AS k FROM n) WHERE k = 1""",
)
def i03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpret.replacements(numbered_rows(spark, sf_dir))


@register(
    "i04_replaced_names",
    """SELECT p_size % 5 AS k, concat(p_type, '、(', p_brand, ')、', p_name) AS before, concat('C ', p_type, '、(', 'D ', p_brand, ')、', p_name) AS text FROM part""",
)
def i04(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    text = F.concat("p_type", F.lit("、("), "p_brand", F.lit(")、"), "p_name")
    # the longest name within a part counts; brands begin alike, so each part holds several
    names = part.select(F.explode(F.array(F.struct(F.col("p_type").alias("o"), F.concat(F.lit("C "), "p_type").alias("c")), F.struct(F.col("p_brand").alias("o"), F.concat(F.lit("D "), "p_brand").alias("c")))).alias("x")).select(F.col("x.o").alias("original"), F.col("x.c").alias("coded")).distinct()
    return interpret.replace_names(part.select((F.col("p_size") % 5).alias("k"), text.alias("before"), text.alias("text")), names)


@register("i05_name_mapping", f"WITH {NUMBERED} SELECT DISTINCT concat(c1, ' ', p_type) AS coded, p_type AS original FROM numbered UNION SELECT DISTINCT concat(c2, ' ', p_brand), p_brand FROM numbered")
def i05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpret.name_mapping(numbered_rows(spark, sf_dir))


@register("i06_header_pairs", "SELECT n_nationkey AS \"row\", 'name,region' AS header, concat(n_name, ',', n_regionkey) AS record FROM nation")
def i06(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    rows = nation.select(F.col("n_nationkey").cast("int").alias("row"), F.posexplode(F.array("n_name", F.col("n_regionkey").cast("string"))).alias("col", "text"))
    head = nation.limit(1).select(F.lit(-1).alias("row"), F.posexplode(F.array(F.lit("name"), F.lit("region"))).alias("col", "text"))
    pairs = interpret.header_pairs(rows.union(head).withColumn("sheet", F.lit("s")), "s")
    joined = lambda c: F.array_join(F.map_values(c), ",").alias(c)
    return pairs.select(F.col("row").cast("long").alias("row"), joined("header"), joined("record"))


@register("i09_grade_lines", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, concat_ws(' ', p_type, p_brand) AS text, p_partkey AS row_no FROM part")
def i09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpret.grade_lines(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.array("p_type", "p_brand").alias("values"))).select(F.col("id").cast("long").alias("id"), "text", "row_no")


@register("i11_rewritten_grades", "SELECT p_partkey, concat(p_name, ' 等级是：L', p_size, ' xL1y, 等级是：L2') AS text FROM part")
def i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" L"), F.col("p_size").cast("string"), F.lit(" xL1y, L2"))
    return table(spark, sf_dir, "part").select("p_partkey", interpret.rewrite_grades(text).alias("text"))


@register("i12_candidate_rows", "WITH r AS (SELECT p_partkey AS row_no, p_brand AS last_code FROM part) SELECT row_no, last_code, e.event_type AS text FROM r LEFT JOIN (SELECT DISTINCT user_id, event_type FROM events) e ON e.user_id = row_no")
def i12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.col("p_brand").alias("last_code"))
    found = table(spark, sf_dir, "events").select(F.col("user_id").alias("row_no"), F.col("event_type").alias("text")).distinct()
    return interpret.candidate_rows(rows, found)


@register("i14_appended_columns", "SELECT p_partkey, concat('0=name,1=kind,2=grade,3=note') AS header, concat('0=', p_name, ',1=', p_type, ',2=', p_brand, ',3=') AS data FROM part")
def i14(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(F.lit("0"), F.lit("1"))
    header, data = F.map_from_arrays(keys, F.array(F.lit("name"), F.lit("kind"))), F.map_from_arrays(keys, F.array("p_name", "p_type"))
    more = interpret.append_columns(header, data, ("grade", "note"), (F.col("p_brand"), F.lit(None).cast("string")))
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, sf_dir, "part").select("p_partkey", flat(more[0]).alias("header"), flat(more[1]).alias("data"))


@register("i16_reply_arrays", "SELECT event_id, CASE WHEN user_id % 5 = 4 THEN '' ELSE concat(event_type, '|u', user_id) END AS items FROM events")
def i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    array = F.to_json(F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    reply = F.element_at(F.array(array, F.concat(F.lit("So:\n```json\n"), array, F.lit("\n```\ndone")), F.concat(F.lit("Here:\n"), array, F.lit("\n")), F.concat(F.lit("It is "), array, F.lit(".")), F.lit("nothing")), (F.col("user_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(parsing.array_from_reply(reply), "|").alias("items"))


@register("i17_recovered", "SELECT event_id, CASE WHEN user_id % 3 = 2 THEN NULL ELSE event_type END AS value, user_id % 3 = 2 AS rejected FROM events")
def i17(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("CASE user_id % 3 WHEN 0 THEN event_type WHEN 1 THEN concat('ERROR timeout 原始内容: ', event_type) ELSE 'ERROR nothing' END")
    good, bad = interpret.recover_errors(table(spark, sf_dir, "events").select("event_id", value.alias("value")))
    return good.select("event_id", "value", F.lit(False).alias("rejected")).union(bad.select("event_id", F.lit(None).cast("string"), F.lit(True)))


@register(
    "i18_finer_categories",
    """SELECT p_partkey AS row_no, concat(p_type, '|A', p_size, '-1 ', p_brand) AS path, concat(p_brand, ';second') AS feature FROM part WHERE p_size % 2 = 0
       UNION ALL SELECT p_partkey, concat(p_type, '|B', p_size, ' second'), concat(p_brand, ';second') FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, p_type, concat('plain ', p_name) FROM part WHERE p_size % 2 = 1""",
)
def i18(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    feature = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("A"), size, F.lit("-1 "), "p_brand", F.lit(";;B"), size, F.lit("：second;"))).otherwise(F.concat(F.lit("plain "), "p_name"))
    out = interpret.finer_categories(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.array("p_type").alias("path"), feature.alias("feature")))
    return out.select("row_no", F.array_join("path", "|").alias("path"), "feature")


@register(
    "i19_interpretation",
    f"""WITH {NUMBERED} SELECT n.row_no, concat(c1, ' ', n.p_type, '|', c2, ' ', n.p_brand) AS path, CASE WHEN n.row_no % 2 = 0 THEN concat('L', n.row_no % 4) ELSE '' END AS grade, concat(p_name, '|', n.p_type, 'x|y') AS elements FROM numbered n JOIN part ON p_partkey = n.row_no""",
)
def i19(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    sheet1 = part.select(F.col("p_partkey").alias("row_no"), F.array("p_type", "p_brand").alias("cells"), F.concat(F.lit("资料包括："), "p_name").alias("feature"))
    queries = interpret.code_queries(numbered_rows(spark, sf_dir).select("row_no", F.posexplode(interpret.coded_path()).alias("col", "text")))
    candidates = queries.where("row_no % 2 = 0").select("row_no", F.lit(0).alias("pos"), F.concat("last_code", F.lit(" y")).alias("text"), F.concat(F.lit("L"), (F.col("row_no") % 4).cast("string")).alias("grade"))
    sheet2 = part.groupBy(F.col("p_type").alias("category")).agg(F.min("p_partkey").alias("row_no")).select("row_no", "category", F.concat("category", F.lit("x、y等")).alias("scope"))
    done = interpret.interpret(spark, {"sheet1": sheet1, "sheet2": sheet2, "candidates": candidates}, scratch(spark, "workbook"))["final"]
    return done.select("row_no", F.array_join("path", "|").alias("path"), "grade", F.array_join("elements", "|").alias("elements"))


# ---- knowledge base ----


@register("v03_line_records", f"WITH {TAX} SELECT row_no, count(*) AS n, min(k) AS first_kind FROM (SELECT row_no, unnest(['line', 'value', 'value', 'value', 'value', 'value', 'value', 'joined']) AS k FROM tax) GROUP BY row_no")
def v03_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.expand_records(part_taxonomy(spark, sf_dir)).groupBy("row_no").agg(F.count("*").alias("n"), F.min("kind").alias("first_kind"))


TOKENS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 1)"


@register("v04_general_records", f"SELECT p_partkey, 'general_knowledge' AS kind, array_to_string({TOKENS.format('p_name')}, ' ') AS items FROM part")
def v04(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("spec_uid"), F.col("p_name").alias("line"))
    return kb.general_records(lines).select(F.col("spec_uid").cast("long").alias("p_partkey"), "kind", F.array_join("items", " ").alias("items"))


@register("v05_items", f"WITH {TAX} SELECT row_no, array_to_string({TOKENS.format('''concat_ws(' ', p_name, p_type)''')}, ' ') AS items FROM tax")
def v05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.array_join(kb.items_of(F.col("p_name"), F.col("p_type")), " ").alias("items"))


CLASSES = "CASE doc_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '7' END"


@register("v06_routed", f"SELECT CASE coalesce({CLASSES}, '2') WHEN '1' THEN 'narrative_classification' WHEN '2' THEN 'classification' ELSE 'left out: 7' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def v06(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classes = docs.select("doc_id", F.expr(CLASSES).alias("doc_class")).where("doc_class IS NOT NULL")
    named, rest = kb.routed(docs.select("doc_id", "text"), classes)
    return named.groupBy("kind").agg(F.count("*").alias("n")).union(rest.select(F.concat(F.lit("left out: "), "doc_class").alias("kind"), "n"))


@register("v08_consistency", f"WITH {TAX} SELECT count(*) AS n, count(*) FILTER (NOT contains(t, p_name) AND NOT contains(p_name, t)) AS inconsistent FROM (SELECT p_name, CASE WHEN row_no % 3 = 0 THEN p_brand ELSE concat(p_name, '!') END AS t FROM tax)")
def v08(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = part_taxonomy(spark, sf_dir)
    records = tax.select("row_no", F.when(F.col("row_no") % 3 == 0, F.get("path", F.lit(1))).otherwise(F.concat(F.get("path", F.lit(2)), F.lit("!"))).alias("text"))
    return kb.consistency(records, tax).select("n", "inconsistent")


@register("v09_build_statistics", "SELECT CASE WHEN n_chars > 2000 THEN 'classification' ELSE 'general_knowledge' END AS kind, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM documents")
def v09(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") > 2000, "classification").otherwise("general_knowledge").alias("kind"))
    return kb.build_statistics(docs).select(F.coalesce("kind", F.lit("all")).alias("kind"), "n")


@register(
    "v11_rebuild",
    """WITH r AS (SELECT 'general_knowledge' AS kind, p_name AS v FROM part WHERE p_partkey % 2 = 0 UNION SELECT 'classification', concat(p_type, ' line ', p_size) FROM part WHERE p_partkey % 2 = 1)
       SELECT kind, count(*) AS n FROM r GROUP BY kind UNION ALL SELECT 'all', count(*) FROM r""",
)
def v11(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, chunk_path, path = table(spark, sf_dir, "part"), scratch(spark, "chunks"), scratch(spark, "collections")
    general = F.col("p_partkey") % 2 == 0
    chunks = part.select(
        F.lit("s").alias("spec_uid"), F.when(general, F.array(F.lit("general_knowledge"))).otherwise(F.array("p_type")).alias("category_path"), F.lit("doc").alias("doc_name"),
        F.col("p_partkey").alias("chunk_no"), F.when(general, F.col("p_name")).otherwise(F.concat("p_type", F.lit(" line "), F.col("p_size").cast("string"))).alias("chunk"),
    )
    tables.write_chunks(chunks, chunk_path)
    classes = part.limit(1).select(F.lit("doc").alias("doc_id"), F.lit("2").alias("doc_class"))
    # a stale kind of an earlier build goes
    stale = part.limit(1).select(F.lit("s").alias("spec_uid"), F.lit("narrative_classification").alias("kind"), F.lit("old").alias("text"), F.lit("old").alias("vectorizing_text"), F.array(F.lit("old")).alias("items"))
    tables.rebuild_collections(stale, path, ["s"])
    counts = knowledge_base.rebuild(spark, chunk_path, path, part_taxonomy(spark, sf_dir), classes, ["s"])
    return counts.select(F.coalesce("kind", F.lit("all")).alias("kind"), "n")


@register("s06_taxonomy_lines", f"WITH {TAX} SELECT row_no, concat(p_type, '|', p_brand, '|', p_name) AS path, feature, grade, array_to_string(elements, '|') AS elements FROM tax")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "taxonomy")
    tables.standard_lines(part_taxonomy(spark, sf_dir)).orderBy("row_no").select("value").coalesce(1).write.text(folder)
    tax, _ = tables.read_taxonomy(spark, folder, "part")
    # part keys count from 0, lines from 1
    return tax.select((F.col("row_no") - 1).alias("row_no"), F.array_join("path", "|").alias("path"), "feature", "grade", F.array_join("elements", "|").alias("elements"))


@register(
    "i19_grade_search",
    f"""WITH {NUMBERED}, q AS (SELECT row_no, concat(c2, ' ', left(p_brand, 9)) AS query_text FROM numbered), lines AS (SELECT min(row_no) AS id, query_text AS text FROM q GROUP BY query_text),
        {_embedded("lines", "lv", "id", "text")}, dots AS (SELECT a.id AS asked, b.id, sum(a.w * b.w) AS ip FROM lv a JOIN lv b USING (dim) GROUP BY ALL),
        every_pair AS (SELECT a.id AS asked, b.id, coalesce(ip, 0) AS ip FROM lines a CROSS JOIN lines b LEFT JOIN dots d ON d.asked = a.id AND d.id = b.id),
        best AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY ip DESC, id) - 1 AS pos FROM every_pair)
        SELECT q.row_no, pos, t.text FROM q JOIN lines l ON l.text = q.query_text JOIN best b ON b.asked = l.id AND pos < 4 JOIN lines t ON t.id = b.id""",
)
def i19_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = interpret.code_queries(numbered_rows(spark, sf_dir).select("row_no", F.posexplode(interpret.coded_path()).alias("col", "text")).where("col = 1"))
    lines = queries.groupBy(F.col("query_text").alias("text")).agg(F.min("row_no").alias("id"), F.lit("L1").alias("grade"))
    return interpret.search_grades(queries, lines).select("row_no", "pos", "text")
