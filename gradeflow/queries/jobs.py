"""Queries of ordered element changes, of stores and jobs, and of streams that run to the end of what is there."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import text as T
from ..operators import changes, grids, headings, lines, recognition, scoring, taxonomy, tree
from ..plans import interpret, knowledge_base
from ..sources import documents, tables
from ..streaming import debounce, ingest
from .base import register, table
from .core import PLACES, TAX, part_taxonomy, place_taxonomy
from .documents import scratch
from .recognition import _LCS, bench_taxonomy, conversation_tables

# ---- element changes ----


@register(
    "t17_element_batches",
    f"""WITH RECURSIVE {TAX}, n AS (SELECT count(*) AS n FROM part),
        ops AS (SELECT p_name AS name, row_number() OVER (PARTITION BY p_name ORDER BY event_id) AS k, CASE event_type WHEN 'purchase' THEN 'add' WHEN 'signup' THEN 'update' ELSE 'delete' END AS action,
                       CASE event_type WHEN 'purchase' THEN [concat('u', user_id % 5), concat('e', event_id % 3), concat('u', user_id % 5)] WHEN 'signup' THEN [split_part(p_name, ' ', 1), concat('e', event_id % 4), concat('e', event_id % 4)]
                                       ELSE [concat('e', event_id % 4), split_part(p_name, ' ', 1)] END AS es
                FROM events JOIN n ON true JOIN (SELECT DISTINCT p_name, p_partkey FROM part) ON p_partkey = user_id % n.n WHERE event_type IN ('purchase', 'signup', 'error')),
        walk AS (SELECT row_no, p_name AS name, elements AS own, 0::BIGINT AS k FROM tax
                 UNION ALL SELECT row_no, name, CASE action WHEN 'add' THEN list_concat(own, list_filter(es[1:2], lambda x: NOT list_contains(own, x))) WHEN 'update' THEN es
                                                            WHEN 'delete' THEN CASE WHEN list_contains(one, es[2]) THEN list_concat(one[1:list_position(one, es[2]) - 1], one[list_position(one, es[2]) + 1:]) ELSE one END END, k
                 FROM (SELECT w.row_no, w.name, w.own, o.k, o.action, o.es, CASE WHEN list_contains(w.own, o.es[1]) THEN list_concat(w.own[1:list_position(w.own, o.es[1]) - 1], w.own[list_position(w.own, o.es[1]) + 1:]) ELSE w.own END AS one
                       FROM walk w JOIN ops o ON o.name = w.name AND o.k = w.k + 1))
        SELECT row_no, array_to_string(arg_max(own, k), ' ') AS elements FROM walk GROUP BY row_no""",
)
def t17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements added, replaced and deleted in order, with elements that a list has twice."""
    events, part = table(spark, sf_dir, "events"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    count = F.broadcast(part.agg(F.count("*").alias("n")))
    wanted = events.where(F.col("event_type").isin("purchase", "signup", "error")).crossJoin(count).join(part, F.col("p_partkey") == F.col("user_id") % F.col("n"))
    e, u, first = (lambda m: F.concat(F.lit("e"), (F.col("event_id") % m).cast("string"))), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")), F.split("p_name", " ")[0]
    kind = F.col("event_type")
    elements = F.when(kind == "purchase", F.array(u, e(3), u)).when(kind == "signup", F.array(first, e(4), e(4))).otherwise(F.array(e(4), first))
    action = F.when(kind == "purchase", "add").when(kind == "signup", "update").otherwise("delete")
    ops = wanted.select(F.col("event_id").alias("item_no"), action.alias("action"), F.col("p_name").alias("name"), elements.alias("elements"))
    return changes.apply_element_changes(part_taxonomy(spark, sf_dir), ops).select("row_no", F.array_join("elements", " ").alias("elements"))


_SCENE = "CASE WHEN contains({0}, '核心数据') THEN 3 WHEN contains({0}, '重要数据') THEN 2 ELSE 1 END"


@register(
    "t34_outputs",
    f"""WITH {TAX}, {PLACES}, nodes AS (SELECT path[1:i] AS p, CASE WHEN i = len(path) THEN row_no END AS own FROM places, unnest(range(1, len(path) + 1)) AS t(i)),
        edges AS (SELECT array_to_string(p, '|') AS node, concat('第', min(own) % 4 + 1, '级') AS grade FROM nodes GROUP BY p), grades AS (SELECT DISTINCT grade FROM tax),
        s AS (SELECT DISTINCT p_name AS category, {_SCENE.format("grade")} AS s FROM tax WHERE grade <> ''), l AS (SELECT category, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS scenes FROM s GROUP BY category),
        m AS (SELECT DISTINCT unnest(elements) AS element, p_name AS category FROM tax)
        SELECT 'tree' AS output, node AS name, CAST({_SCENE.format("grade")} AS VARCHAR) AS scene FROM edges UNION ALL SELECT 'grade', grade, CAST({_SCENE.format("grade")} AS VARCHAR) FROM grades
        UNION ALL SELECT 'element', concat(element, '|', category), coalesce(scenes, '') FROM m LEFT JOIN l USING (category)""",
)
def t34(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three outputs of a taxonomy with their scene types."""
    tax = part_taxonomy(spark, sf_dir)
    mapped = taxonomy.element_mappings(tax).select("element", "category").distinct()
    edges, grades, elements = tree.post_process(tree.tree_edges(place_taxonomy(spark, sf_dir)), tax.select("grade").distinct(), mapped, tax)
    of = lambda df, kind, name, scene: df.select(F.lit(kind).alias("output"), name.alias("name"), scene.cast("string").alias("scene"))
    told = of(edges, "tree", F.replace("node", F.lit(taxonomy.SEPARATOR), F.lit("|")), F.col("scene")).union(of(grades, "grade", F.col("grade"), F.col("scene")))
    return told.union(of(elements, "element", F.concat_ws("|", "element", "category"), F.array_join(F.transform("scenes", lambda x: x.cast("string")), ",")))


# ---- fields, headers, lines ----


@register(
    "r21_field_categories",
    f"""WITH fields AS (SELECT conv_id AS request_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, replace(text, chr(10), ' ')) - 2 AS field_no, concat('c', (turn * 7 + conv_id) % 45) AS text FROM conversations),
        cats AS (SELECT item_id AS row_no, concat('c', item_id) AS name FROM benchmark), asked AS (SELECT DISTINCT text AS name FROM fields WHERE field_no >= 0), names AS (SELECT DISTINCT name FROM cats), {_LCS},
        hit AS (SELECT request_id, field_no, row_no, CASE WHEN f.text = c.name THEN 1.0 ELSE round(coalesce(l, 0) / greatest(length(f.text), length(c.name)), 6) END AS score
                FROM fields f JOIN cats c ON c.row_no % 3 = f.request_id % 3 LEFT JOIN lcs ON lcs.text = f.text AND lcs.name = c.name WHERE field_no >= 0)
        SELECT request_id, field_no, row_no, score FROM (SELECT *, row_number() OVER (PARTITION BY request_id, field_no ORDER BY score DESC, row_no) AS k FROM hit WHERE score >= 0.3) WHERE k = 1""",
)
def r21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of conversations straight to the categories of the request's candidates."""
    turns = F.transform("fields", lambda f: F.struct(f["fieldName"].alias("fieldName"), F.concat(F.lit("c"), (F.substr(f["fieldName"], F.lit(2)).cast("long") * 7 + F.col("request_id")) % 45).alias("fieldComment")))
    requests = conversation_tables(spark, sf_dir).withColumn("fields", turns)
    tax = bench_taxonomy(spark, sf_dir)
    candidates = requests.select("request_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("m")).where(F.col("m") == F.col("request_id") % 3).join(tax.select("row_no", (F.col("row_no") % 3).cast("int").alias("m")), "m").select("request_id", "row_no")
    found = recognition.classify_fields(requests, tax, candidates)
    return found.select("request_id", F.col("field_no").cast("long").alias("field_no"), "row_no", "score")


@register(
    "d12_header_row",
    """WITH g AS (SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS "row", a, b FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS a, min(l_linestatus) AS b FROM lineitem GROUP BY ALL)),
       cells AS (SELECT table_id, "row", 0 AS col, a AS text FROM g UNION ALL SELECT table_id, "row", 1, b FROM g UNION ALL SELECT table_id, "row", 2, 'q' FROM g UNION ALL SELECT DISTINCT table_id, 0, c, ['X', 'Y', 'Z'][c + 1] FROM g, unnest([0, 1, 2]) AS t(c)),
       pairs AS (SELECT a.table_id, a."row" AS i, b."row" AS j, avg((a.text = b.text)::INT) AS s FROM cells a JOIN cells b ON a.table_id = b.table_id AND a.col = b.col AND a."row" < b."row" GROUP BY ALL),
       data AS (SELECT table_id, avg(s) AS d FROM pairs WHERE i > 0 GROUP BY table_id), head AS (SELECT table_id, i, avg(s) AS h FROM pairs WHERE i < 3 GROUP BY ALL),
       scored AS (SELECT table_id, i, round(coalesce(d, 0) - h + 0.5, 9) AS score FROM head LEFT JOIN data USING (table_id))
       SELECT table_id, arg_max(i, (score, -i))::INT AS header_row FROM scored GROUP BY table_id HAVING max(score) > 0.3""",
)
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of orders below a header of other letters; two letters are wholly alike or not at all."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("a"), F.min("l_linestatus").alias("b"))
    rows = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "a", "b"))).alias("x"))
    whole = F.concat(F.array(F.array(*map(F.lit, "XYZ"))), F.transform("x", lambda r: F.array(r["a"], r["b"], F.lit("q"))))
    cells = rows.select(F.col("l_orderkey").alias("table_id"), F.posexplode(whole).alias("row", "r")).select("table_id", "row", F.posexplode("r").alias("col", "text"))
    return grids.detect_header(cells)


@register(
    "d03_similar_removed",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
       toc AS (SELECT doc_id, line FROM l WHERE pos % 5 = 1 AND length(line) > 0), asked AS (SELECT doc_id, line, count(*) AS n FROM toc GROUP BY ALL),
       placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k FROM l)
       SELECT p.doc_id, p.pos::INT AS pos, md5(p.line) AS line_md5 FROM placed p LEFT JOIN asked a ON a.doc_id = p.doc_id AND a.line = p.line WHERE coalesce(k > n, true) AND p.doc_id IN (SELECT doc_id FROM l)""",
)
def d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth line of a document is an entry of its table of contents, and takes away the first line like it."""
    every = lines.to_lines(table(spark, sf_dir, "documents").where("text IS NOT NULL"))
    left = headings.remove_similar(every, every.where("pos % 5 = 1 AND line <> ''"))
    return left.select("doc_id", "pos", F.md5(F.col("line").cast("binary")).alias("line_md5"))


_BARE = "text"
for _pattern in T.ANNOTATIONS:
    _BARE = f"regexp_replace({_BARE}, '{_pattern}', '', 'g')"


@register("d20_annotations_in_texts", f"SELECT doc_id, md5(trim(regexp_replace({_BARE}, '\\s+', ' ', 'g'))) AS clean_md5 FROM documents")
def d20_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the marks that they have."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.remove_annotations(F.col("text")).cast("binary")).alias("clean_md5"))


# ---- interpretation ----


@register(
    "i08_nested_scopes",
    "SELECT p_partkey AS row_no, unnest([p_name, concat(p_brand, '（', p_type, '、(x、', p_size, ')、z）'), '甲（乙、丙）']) AS item, unnest([0, 1, 2]) AS item_no, p_type AS category FROM part",
)
def i08_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes with brackets within brackets, and one that nothing closes."""
    scope = F.concat("p_name", F.lit("等、"), "p_brand", F.lit("（"), "p_type", F.lit("、(x、"), F.col("p_size").cast("string"), F.lit(")、z）、甲（乙、丙等"))
    return interpret.expand_scope(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.col("p_type").alias("category"), scope.alias("scope"))).select("row_no", "item", "item_no", "category")


@register(
    "i15_lead_ins",
    """SELECT p_partkey AS row_no, array_to_string(CASE WHEN p_size % 4 = 3 THEN [p_name, '客户姓名', '客户电话'] ELSE list_concat([p_name], list_concat(CASE WHEN p_brand = p_name THEN [] ELSE [p_brand] END, CASE WHEN p_size % 4 = 1 THEN ['a（b、c）'] ELSE ['客户姓名', '客户电话'] END)) END, '|') AS elements FROM part""",
)
def i15_lead_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature texts with and without a lead-in, and short parts that take the beginning of the one before."""
    kind, f = F.col("p_size") % 4, lambda *parts: F.concat(*[F.col(x) if x.startswith("p_") else F.lit(x) for x in parts])
    feature = F.when(kind == 0, f("资料包括但不限于：", "p_name", "、", "p_brand", "和客户姓名，电话等")).when(kind == 1, f("包含", "p_name", "；", "p_brand", "与a（b、c）及其他。")).when(kind == 2, f("范围:", "p_name", ",", "p_brand", "、客户姓名、电话、数据")).otherwise(f("p_name", "、客户姓名、电话、", "p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.array_join(interpret.feature_elements(feature, complete_prefix=True), "|").alias("elements"))


# ---- stores and jobs ----


@register(
    "s08_chunk_files",
    """SELECT concat('a=c', p_size % 5, '/b=d', p_size % 3) AS category_path, line_no, line FROM (SELECT p_size, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(p_name, ' ', p_brand) END AS line,
              row_number() OVER (PARTITION BY p_size % 5, p_size % 3 ORDER BY p_partkey) AS line_no FROM part) WHERE line <> ''""",
)
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files in nested folders, with blank lines."""
    part, folder = table(spark, sf_dir, "part"), scratch(spark, "markdown")
    line = F.when(F.col("p_partkey") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "), "p_brand"))
    name = lambda letter, n: F.concat(F.lit(letter), (F.col("p_size") % n).cast("string"))
    files = part.select(name("c", 5).alias("a"), name("d", 3).alias("b"), "p_partkey", line.alias("line")).repartition("a", "b").sortWithinPartitions("a", "b", "p_partkey").drop("p_partkey")
    plain = {"extension": "md", "quote": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "sep": "\x01"}
    files.write.partitionBy("a", "b").options(**plain).csv(folder)
    return tables.read_chunk_files(spark, folder).select(F.array_join("category_path", "/").alias("category_path"), F.col("line_no").cast("long").alias("line_no"), "line")


@F.pandas_udf(BinaryType())
def _as_gbk(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.encode("gbk"))


@register(
    "s03_three_encodings",
    """SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN concat(source, '客户资料', lang, '（', doc_id, '）') ELSE concat(source, ' été ', lang, ' ', doc_id, ' é') END) AS text_md5 FROM documents""",
)
def s03_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents in UTF-8, GBK and Latin-1, told apart by what is valid."""
    number = F.col("doc_id").cast("string")
    gbk = _as_gbk(F.concat("source", F.lit("客户资料"), "lang", F.lit("（"), number, F.lit("）")))
    latin = F.encode(F.concat("source", F.lit(" été "), "lang", F.lit(" "), number, F.lit(" é")), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 3 == 0, F.col("text").cast("binary")).when(F.col("doc_id") % 3 == 1, gbk).otherwise(latin)
    rows = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return rows.select("doc_id", F.md5(documents.decoded(F.col("content")).cast("binary")).alias("text_md5"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of seven documents: general knowledge, and lines of categories."""
    general = F.col("p_partkey") % 2 == 0
    return table(spark, sf_dir, "part").select(
        F.lit("s").alias("spec_uid"), F.when(general, F.array(F.lit("general_knowledge"))).otherwise(F.array("p_type")).alias("category_path"), F.concat(F.lit("doc"), (F.col("p_partkey") % 7).cast("string")).alias("doc_name"),
        F.col("p_partkey").alias("chunk_no"), F.when(general, F.col("p_name")).otherwise(F.concat("p_type", F.lit(" line "), F.col("p_size").cast("string"))).alias("chunk"),
    )


_RECORDS = """SELECT DISTINCT 'general_knowledge' AS kind, p_name AS vectorizing_text FROM part WHERE p_partkey % 2 = 0 {0} UNION ALL SELECT DISTINCT 'classification', concat(p_type, ' line ', p_size) FROM part WHERE p_partkey % 2 = 1 {0}"""


@register("v11_record_contents", f"SELECT 's' AS spec_uid, * FROM ({_RECORDS.format('')}) UNION ALL SELECT 'other', 'classification', 'kept'")
def v11_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rebuilds of one specification beside another one, and one that fails before its version counts."""
    chunk_path, path, tax = scratch(spark, "chunks"), scratch(spark, "collections"), part_taxonomy(spark, sf_dir)
    tables.write_chunks(_chunks(spark, sf_dir), chunk_path)
    classes = spark.createDataFrame([(f"doc{i}", "2") for i in range(7)], "doc_id string, doc_class string")
    old = [(s, k, t, t, [t]) for s, k, t in (("other", "classification", "kept"), ("s", "narrative_classification", "stale"))]
    tables.rebuild_collections(spark.createDataFrame(old, "spec_uid string, kind string, text string, vectorizing_text string, items array<string>"), path, ["other", "s"])
    for _ in range(2):
        knowledge_base.rebuild(spark, chunk_path, path, tax, classes, ["s"])
    lost = tables.current_collections(spark, path).withColumn("items", F.raise_error(F.lit("lost")).cast("array<string>"))
    try:
        tables.rebuild_collections(lost, path, ["s"])
    except Exception as e:
        if "lost" not in str(e):
            raise
    return tables.current_collections(spark, path).select("spec_uid", "kind", "vectorizing_text")


@register(
    "t36_changed_classification",
    f"SELECT 'record' AS what, * FROM ({_RECORDS.format('AND p_partkey % 7 <> 3')}) UNION ALL SELECT 'missing', 'nowhere', 'none'",
)
def t36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document goes from all its categories; what is left is rebuilt, and a document that is not there is told."""
    chunk_path, left_path, path, tax = scratch(spark, "chunks"), scratch(spark, "chunks"), scratch(spark, "collections"), part_taxonomy(spark, sf_dir)
    chunks = _chunks(spark, sf_dir)
    tables.write_chunks(chunks, chunk_path)
    classes = spark.createDataFrame([(f"doc{i}", "2") for i in range(7)], "doc_id string, doc_class string")
    knowledge_base.rebuild(spark, chunk_path, path, tax, classes, ["s"])
    gone = chunks.where("doc_name = 'doc3'").select("spec_uid", F.col("category_path").alias("path"), "doc_name").distinct()
    gone = gone.union(spark.createDataFrame([("s", ["nowhere"], "none")], gone.schema))
    missing = knowledge_base.change_classification(spark, chunk_path, left_path, path, tax, classes, gone, ["s"])
    records = tables.current_collections(spark, path).select(F.lit("record").alias("what"), "kind", "vectorizing_text")
    return records.union(missing.select(F.lit("missing"), F.array_join("path", "|"), "doc_name"))


def _told(prompts: list[str]) -> list[str]:
    return [f"{len(p)}:{p[:9]}" for p in prompts]


@register("x01_scored", "SELECT doc_id, CASE WHEN text IS NOT NULL THEN concat(length(text), ':', left(text, 9)) END AS reply, CAST(NULL AS VARCHAR) AS error FROM documents")
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as prompts; a reply that is kept is not asked for again."""
    docs, store = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "replies")
    scoring.score_resumably(docs.where("doc_id % 2 = 0"), _told, store, "text", batch=100_000)
    return scoring.score_resumably(docs, _told, store, "text", batch=100_000).select("doc_id", "reply", "error")


# ---- streams ----

_QUIET = 21_600


@register(
    "st3_due_builds",
    f"""SELECT user_id, event_id AS n, strftime(ts + INTERVAL {_QUIET} SECOND, '%Y-%m-%d %H:%M:%S') AS due_at FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt > ts + INTERVAL {_QUIET} SECOND""",
)
def st3_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests that are built when a user has been quiet for six hours."""
    requests = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("n"))
    return debounce.due_builds(requests, _QUIET, "user_id").select("user_id", "n", F.date_format("due_at", "yyyy-MM-dd HH:mm:ss").alias("due_at"))


def _arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; the name may be a file's or a folder's."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


@register(
    "st5_ingested",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL), kept AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
       flag AS (SELECT *, regexp_matches(regexp_replace(line, '\\s+', '', 'g'), '[.．…]{2,}[0-9]+$') AS f FROM kept), near AS (SELECT *, coalesce(lag(f) OVER w, false) OR coalesce(lead(f) OVER w, false) AS n FROM flag WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
       out AS (SELECT doc_id, md5(line) AS line_md5 FROM near WHERE NOT (f AND n)), told AS (SELECT doc_id, count(*) AS n FROM out GROUP BY doc_id)
       SELECT 'line' AS what, doc_id, line_md5 AS value FROM out UNION ALL SELECT 'status', doc_id, CAST(coalesce(n, 0) AS VARCHAR) FROM documents LEFT JOIN told USING (doc_id)""",
)
def st5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest stream over all documents to its end, twice; the second run finds nothing new."""
    where = [scratch(spark, x) for x in ("chunks", "status", "checkpoint")]
    for _ in range(2):
        texts = _arriving(spark, sf_dir, "documents").select("doc_id", "text")
        ingest.ingest(texts, *where, prepare=lambda docs: lines.remove_toc(lines.to_lines(docs.where("text IS NOT NULL")))).awaitTermination()
    made, status = spark.read.parquet(where[0]), spark.read.parquet(where[1])
    return made.select(F.lit("line").alias("what"), "doc_id", F.md5(F.col("line").cast("binary")).alias("value")).union(status.select(F.lit("status"), "doc_id", F.col("n_chunks").cast("string")))


@register("st7_published", "SELECT concat('{\"id\":', event_id, ',\"kind\":\"', event_type, '\"}') AS value FROM events")
def st7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publishing stream over all events to its end, twice; each message is there once."""
    path, checkpoint = scratch(spark, "messages"), scratch(spark, "checkpoint")
    for _ in range(2):
        messages = _arriving(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("value"))
        ingest.publish(messages, checkpoint, path).awaitTermination()
    return spark.read.text(path)
