"""Queries of document preparation: headings, grids, HTML tables, chunks, files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, grids, headings, lines
from ..session import scratch_dir
from ..sources import documents, tables
from .base import register, table
from .core import CELLS, order_cells


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# A document for each order: a numbered heading for each line, by quantity and line number.
HEADED = """own AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, max(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL),
    heads AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, CASE q % 4 WHEN 0 THEN concat('1.', q % 3 + 1) WHEN 1 THEN concat(q % 2 + 1, '.', q % 3 + 1, '.', q % 5 + 1) WHEN 2 THEN '' ELSE CAST(q % 9 + 1 AS VARCHAR) END AS number, q FROM own)"""


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.expr("CASE q % 4 WHEN 0 THEN concat('1.', q % 3 + 1) WHEN 1 THEN concat(q % 2 + 1, '.', q % 3 + 1, '.', q % 5 + 1) WHEN 2 THEN '' ELSE cast(q % 9 + 1 AS string) END")
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")).agg(F.max("l_quantity").cast("long").alias("q"))
    line = F.concat(F.lit("# "), F.when(number == "", F.lit("")).otherwise(F.concat(number, F.lit(" "))), F.lit("t"), F.col("q").cast("string"))
    return lines.renumbered(own.select("doc_id", F.col("pos").cast("int").alias("pos"), line.alias("line")))


@register(
    "d04_heading_levels",
    f"""WITH RECURSIVE {HEADED}, n AS (SELECT *, string_split(number, '.') AS p, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM heads WHERE number <> ''),
        w AS (SELECT doc_id, 0::BIGINT AS i, NULL::INT AS pos, NULL::VARCHAR AS out_number, NULL::BIGINT AS q, 0 AS size, NULL::BIGINT AS major, NULL::VARCHAR AS before, NULL::VARCHAR AS last, 0 AS kids FROM (SELECT DISTINCT doc_id FROM n)
              UNION ALL SELECT w.doc_id, n.i, n.pos, CASE WHEN child THEN concat(w.before, '.', w.kids + 1) ELSE n.number END, n.q, n.i::INT,
                     CASE WHEN child THEN w.major WHEN len(n.p) = 1 THEN n.number::BIGINT ELSE w.major END, CASE WHEN child THEN w.before WHEN len(n.p) = 1 THEN NULL ELSE w.last END, CASE WHEN child THEN w.last ELSE n.number END, CASE WHEN child THEN w.kids + 1 ELSE 0 END
              FROM (SELECT w.*, n2.i AS ni, len(n2.p) = 1 AND w.major IS NOT NULL AND w.before IS NOT NULL AND contains(w.last, '.') AND split_part(w.last, '.', 1) <> CAST(w.major AS VARCHAR) AND n2.number::VARCHAR NOT LIKE '%.%' AND TRY_CAST(n2.number AS BIGINT) < w.major AS child
                    FROM w JOIN n n2 ON n2.doc_id = w.doc_id AND n2.i = w.i + 1) w JOIN n ON n.doc_id = w.doc_id AND n.i = w.ni)
        SELECT h.doc_id, h.pos, CASE WHEN w.out_number IS NULL THEN concat('# t', h.q) ELSE concat(repeat('#', least(6, len(string_split(w.out_number, '.')))::INT), ' ', w.out_number, ' t', h.q) END AS line
        FROM heads h LEFT JOIN w ON w.doc_id = h.doc_id AND w.pos = h.pos""",
)
def d04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.first_pass(headed(spark, sf_dir)).select("doc_id", "pos", "line")


@register(
    "d05_heading_parents",
    f"""WITH {HEADED}, n AS (SELECT *, CASE WHEN number = '' THEN [] ELSE string_split(number, '.') END AS p FROM heads),
        m AS (SELECT *, array_to_string(p[1:len(p) - 1], '.') AS stem, p[len(p)]::BIGINT AS k FROM n WHERE len(p) >= 2),
        spans AS (SELECT a.doc_id, a.pos AS p_pos, a.number AS p_number, min(b.pos) AS s_pos FROM m a JOIN m b ON b.doc_id = a.doc_id AND b.stem = a.stem AND len(b.p) = len(a.p) AND b.k = a.k + 1 AND b.pos > a.pos GROUP BY ALL),
        inside AS (SELECT n.*, p_pos, p_number, row_number() OVER (PARTITION BY n.doc_id, p_pos ORDER BY n.pos) AS j FROM n JOIN spans s ON s.doc_id = n.doc_id AND n.pos > p_pos AND n.pos < s_pos),
        last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY p_pos DESC) AS r FROM inside WHERE len(p) <= 1) WHERE r = 1)
        SELECT n.doc_id, n.pos, CASE WHEN l.doc_id IS NULL THEN concat('# ', CASE WHEN n.number = '' THEN '' ELSE concat(n.number, ' ') END, 't', n.q) ELSE concat('## ', l.p_number, '.', l.j, ' t', n.q) END AS line FROM n LEFT JOIN last l ON l.doc_id = n.doc_id AND l.pos = n.pos""",
)
def d05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.second_pass(headed(spark, sf_dir)).select("doc_id", "pos", "line")


@register(
    "d06_assembled",
    """SELECT doc_id, md5(concat('# ', source, chr(10), chr(10), coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''), chr(10)), ''))) AS text_md5
       FROM documents WHERE NOT regexp_matches(text, '(^|\\n)#{1,6}\\s|[.．…]{2,}\\s*[0-9]+\\s*(\\n|$)')""",
)
def d06(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"(^|\n)#{1,6}\s|[.．…]{2,}\s*[0-9]+\s*(\n|$)"))
    out = headings.assembled(lines.to_lines(docs), docs.select("doc_id", F.col("source").alias("name")))
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register(
    "d07_preferred_versions",
    """WITH f AS (SELECT DISTINCT concat('k/', 20240101000000 + user_id % 3) AS path, concat('b', event_id % 50, CASE user_id % 4 WHEN 0 THEN '_final.md' WHEN 1 THEN '_with_html.md' WHEN 2 THEN '.md' ELSE '.txt' END) AS name FROM events),
       l AS (SELECT * FROM f WHERE path = (SELECT max(path) FROM f) AND name LIKE '%.md')
       SELECT base, path, name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY CASE WHEN name LIKE '%\\_final.md' ESCAPE '\\' THEN 1 WHEN name LIKE '%\\_with\\_html.md' ESCAPE '\\' THEN 2 ELSE 3 END) AS k FROM (SELECT *, regexp_replace(name, '(_final|_with_html)?\\.md$', '') AS base FROM l)) WHERE k = 1""",
)
def d07(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("concat('b', event_id % 50, CASE user_id % 4 WHEN 0 THEN '_final.md' WHEN 1 THEN '_with_html.md' WHEN 2 THEN '.md' ELSE '.txt' END)")
    return lines.preferred_versions(table(spark, sf_dir, "events").select(F.expr("concat('k/', 20240101000000 + user_id % 3)").alias("path"), name.alias("name")).distinct())


# An HTML table for each order: a head cell over two columns, then a row for each line.
ORDER_HTML = """rows AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_returnflag) AS a, min(l_linestatus) AS b FROM lineitem GROUP BY ALL),
    html AS (SELECT doc_id, concat('text ', doc_id, chr(10), '<table><tr><th colspan="2">h', doc_id, '</th><td>x</td></tr>', string_agg(concat('<tr><td>', a, '</td><td>', b, '</td><td>', n, '</td></tr>'), '' ORDER BY n), '</table>', chr(10), '<div><div>in</div></div>', chr(10), 'end') AS html FROM rows GROUP BY doc_id)"""


def by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dealt by order, in a fixed number of parts: few bytes are much work where each order is a document to parse."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").repartition(parts, "l_orderkey")


def order_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_order(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("a"), F.min("l_linestatus").alias("b"))
    row = F.concat(F.lit("<tr><td>"), "a", F.lit("</td><td>"), "b", F.lit("</td><td>"), F.col("l_linenumber").cast("string"), F.lit("</td></tr>"))
    body = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))), lambda x: x["r"]), "").alias("r"))
    key = F.col("doc_id").cast("string")
    return body.select("doc_id", F.concat(F.lit("text "), key, F.lit('\n<table><tr><th colspan="2">h'), key, F.lit("</th><td>x</td></tr>"), "r", F.lit("</table>\n<div><div>in</div></div>\nend")).alias("html"))


@register(
    "d08_html_blocks",
    f"""WITH {ORDER_HTML} SELECT doc_id, 0 AS block_no, strpos(html, '<table>') - 1 AS start, md5(substr(html, strpos(html, '<table>'), strpos(html, chr(10) || 'end') - strpos(html, '<table>'))) AS block_md5 FROM html""",
)
def d08(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grids.html_blocks(order_html(spark, sf_dir), text="html")
    return found.select("doc_id", "block_no", "start", F.md5(F.col("block").cast("binary")).alias("block_md5"))


@register(
    "d09_html_cells",
    """WITH g AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_returnflag) AS a, min(l_linestatus) AS b FROM lineitem GROUP BY ALL), rows AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM g)
       SELECT doc_id, 0 AS table_no, r AS "row", c AS col, CASE c WHEN 0 THEN a WHEN 1 THEN b ELSE CAST(n AS VARCHAR) END AS text FROM rows, unnest(range(0, 3)) AS t(c)
       UNION ALL SELECT DISTINCT doc_id, 0, 0, c, CASE c WHEN 2 THEN 'x' ELSE concat('h', doc_id) END FROM rows, unnest(range(0, 3)) AS t(c)""",
)
def d09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.html_cells(order_html(spark, sf_dir))


@register(
    "d16_tables_to_json",
    f"""WITH {ORDER_HTML}, j AS (SELECT doc_id, string_agg(concat('{{"h', doc_id, '": "', b, '", "x": "', n, '"}}'), chr(10) ORDER BY n) AS j FROM rows GROUP BY doc_id)
        SELECT doc_id, md5(concat('text ', doc_id, chr(10), j, chr(10), 'end')) AS text_md5 FROM j""",
)
def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.tables_to_json(order_html(spark, sf_dir), text="html").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register(
    "d11_hidden_cells",
    f"""WITH {CELLS}, hidden AS (SELECT DISTINCT table_id, "row" AS h FROM cells WHERE "row" % 3 = 0), kept AS (SELECT * FROM cells WHERE "row" % 3 <> 0 AND col <> 1)
        SELECT k.table_id, k."row" - count(h.h) AS "row", k.col - CASE WHEN k.col > 1 THEN 1 ELSE 0 END AS col, k.text FROM kept k LEFT JOIN hidden h ON h.table_id = k.table_id AND h.h < k."row" GROUP BY k.table_id, k."row", k.col, k.text""",
)
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_cells(spark, sf_dir)
    rows = cells.where("row % 3 = 0").select("table_id", F.col("row").cast("int").alias("row")).distinct()
    cols = cells.select("table_id", F.lit(1).alias("col")).distinct()
    ranges = cells.groupBy("table_id").agg(F.lit(0).alias("r0"), F.lit(0).alias("c0"), F.lit(0).alias("r1"), F.lit(0).alias("c1"), F.lit("x").alias("text"))
    return grids.drop_hidden(cells, ranges, rows, cols)[0]


@register(
    "d15_json_lines",
    f"""WITH {CELLS}, r AS (SELECT table_id, "row", concat('{{"column1":"', max(text) FILTER (col = 0), '","column2":"', max(text) FILTER (col = 1), '","column3":"', max(text) FILTER (col = 2), '"}}') AS j FROM cells GROUP BY ALL)
        SELECT table_id, md5(string_agg(j, chr(10) ORDER BY "row")) AS text_md5 FROM r GROUP BY table_id""",
)
def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_cells(spark, sf_dir)
    none = cells.select("table_id", F.lit(0).alias("header_row")).limit(0)
    return grids.json_lines(grids.to_records(cells, none)).select("table_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("d17_fenced", "SELECT doc_id, md5(concat('# ', source, chr(10), chr(10), '```', chr(10), text, chr(10), '```', chr(10))) AS text_md5 FROM documents")
def d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(grids.fenced(F.col("source"), F.col("text")).cast("binary")).alias("text_md5"))


@register("d19_truncated", "SELECT doc_id, md5(substr(text, 1, 3000)) AS long_md5, md5(substr(text, 1, 900)) AS short_md5 FROM documents")
def d19(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda n: F.md5(T.truncate(F.col("text"), n).cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", cut(3000).alias("long_md5"), cut(900).alias("short_md5"))


@register("s04_titled", "SELECT doc_id, md5(concat('# ', source, chr(10), chr(10), text)) AS text_md5 FROM documents")
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(lines.titled(F.col("source"), F.col("text")).cast("binary")).alias("text_md5"))


# ---- chunks with headings and fences ----

# Two headings around a text, a fence behind the second one and one within its section.
FENCED_SQL = """t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(^|\\n)[ \\t]*(#|```)', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)"""


def fenced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A main title, the text, a second-level section with a fence, a second one that nests below it by the count rule."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("text", r"(^|\n)[ \t]*(#|```)", " "), r"(?U)\s+", " "))
    text = F.concat(F.lit("# Main\n"), bare, F.lit("\n## "), "source", F.lit("\n```\ncode "), "source", F.lit("\n```\nbefore\n```\nhidden\n```\nafter\n## "), "lang", F.lit("\nlast "), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@register(
    "c01_headed_chunks",
    f"""WITH {FENCED_SQL}, d AS (SELECT t.*, source, lang FROM t JOIN documents USING (doc_id))
        SELECT doc_id, 1 AS section, i AS chunk_no, md5(concat('Main:', substr(t, i * 500 + 1, 500))) AS chunk_md5 FROM d, unnest(range(0, (length(t) + 499) // 500)) AS c(i) WHERE t <> ''
        UNION ALL SELECT doc_id, 2, 0, md5(concat('Main:', source, ':before after')) FROM d UNION ALL SELECT doc_id, 3, 0, md5(concat('Main:', source, ':', lang, ':last ', doc_id)) FROM d""",
)
def c01_headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.narrative_chunks(lines.to_lines(fenced_documents(spark, sf_dir)))
    return out.select("doc_id", F.col("section").cast("long").alias("section"), "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@register(
    "c03_routed_chunks",
    """WITH t AS (SELECT doc_id, concat('# ', source, chr(10), '{"id":', doc_id, '}') AS x, doc_id % 3 AS k FROM documents)
       SELECT doc_id, CASE WHEN k = 0 THEN 'general_knowledge' WHEN k = 1 THEN 'narrative' ELSE 'data' END AS kind, concat(source, CASE WHEN k = 2 THEN ',' ELSE ':' END, '{"id":', doc_id, '}') AS chunk FROM t JOIN documents USING (doc_id)""",
)
def c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("# "), "source", F.lit('\n{"id":'), F.col("doc_id").cast("string"), F.lit("}"))
    classes = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 2, "2").otherwise("1").alias("doc_class"), (F.col("doc_id") % 3 != 0).alias("has_category"))
    return chunking.routed_chunks(lines.to_lines(docs.select("doc_id", text.alias("text"))), classes).select("doc_id", "kind", "chunk")


# ---- files and stores, written to the shared folder and read back ----


@register("s01_file_scan", "SELECT concat(lang, '.txt') AS name, lang AS stem, md5(concat('# ', lang, chr(10), chr(10), string_agg(concat('doc ', doc_id), chr(10) ORDER BY doc_id), chr(10))) AS text_md5 FROM documents GROUP BY lang")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "files")
    ids = table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: F.concat(F.lit("doc "), x.cast("string"))), "\n").alias("value"))
    ids.repartition("lang").write.partitionBy("lang").text(folder)
    good, _ = documents.scan(spark, folder, "*.txt")
    stem = F.regexp_extract("doc_id", "lang=([^/]*)", 1)
    named = good.withColumn("stem", stem).withColumn("name", F.concat(stem, F.lit(".txt")))
    return documents.markdown(named).select("name", "stem", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("s02_scan_outcome", "SELECT 'ok' AS status, count(DISTINCT lang) AS n FROM documents")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "files")
    table(spark, sf_dir, "documents").select(F.concat("lang", F.lit(" "), "source").alias("value"), "lang").repartition("lang").write.partitionBy("lang").text(folder)
    return documents.outcome(*documents.scan(spark, folder, "*.txt"))


@register("s03_decoded", "SELECT doc_id, md5(text) AS utf8_md5, true AS latin_same FROM documents")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    latin = F.regexp_replace("text", "[^\\x00-\\xff]", "?")
    # bytes that happen to be valid UTF-8 or GBK are read as that; with this end they are neither, whatever precedes it
    whole = F.concat(latin, F.lit("é é "))
    read = documents.decoded(F.encode(whole, "ISO-8859-1"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(documents.decoded(F.col("text").cast("binary")).cast("binary")).alias("utf8_md5"), read.eqNullSafe(whole).alias("latin_same"))


@register("s05_csv_records", """SELECT md5(concat('{"id":"', p_partkey, '","name":"', p_name, '","kind":"', p_type, '"}')) AS record_md5 FROM part""")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "csv")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind")).write.option("header", True).csv(folder)
    return documents.csv_records(spark, folder).select(F.md5(F.col("record").cast("binary")).alias("record_md5"))


@register("s18_size_report", "SELECT 'documents' AS kind, round(sum(strlen(text) + 1) / 1024, 2) AS kb FROM documents UNION ALL SELECT 'pages', round(sum(strlen(html) + 1) / 1024, 2) FROM pages")
def s18(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = {name: scratch(spark, name) for name in ("documents", "pages")}
    table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit(""))).write.text(folders["documents"])
    table(spark, sf_dir, "pages").select(F.coalesce("html", F.lit(""))).write.text(folders["pages"])
    report = documents.size_report(spark, folders)
    return report


@register("s07_chunk_store", "SELECT lang AS spec_uid, source AS category, concat('doc', doc_id) AS doc_name, md5(trim(text)) AS line_md5 FROM documents WHERE trim(text) <> ''")
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "chunks")
    docs = table(spark, sf_dir, "documents")
    # a first version of some documents is overwritten, the others stay
    rows = docs.select(F.col("lang").alias("spec_uid"), F.array("source").alias("category_path"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"), F.lit(0).alias("chunk_no"), F.col("text").alias("chunk"))
    small = rows.withColumn("doc_name", F.lit("all")).groupBy("spec_uid", "category_path", "doc_name").agg(F.min("chunk_no").alias("chunk_no"), F.lit("old").alias("chunk"))
    whole = rows.withColumn("own", F.col("doc_name")).withColumn("doc_name", F.lit("all"))
    tables.write_chunks(small.withColumn("own", F.lit("old")), folder)
    tables.write_chunks(whole, folder)
    back = spark.read.parquet(folder).where(F.trim("chunk") != "")
    return back.select("spec_uid", F.col("category_path")[0].alias("category"), F.col("own").alias("doc_name"), F.md5(F.trim("chunk").cast("binary")).alias("line_md5"))


@register("s14_class_store", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '9' WHEN doc_id % 2 = 0 THEN '2' WHEN doc_id % 5 = 0 THEN NULL ELSE '1' END AS doc_class FROM documents")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "classes")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    tables.write_classes(docs.withColumn("doc_class", F.lit("1")), folder)
    tables.write_classes(docs.where("doc_id % 2 = 0").withColumn("doc_class", F.lit("2")), folder)
    held = tables.clear_classes(tables.list_classes(spark, folder), docs.where("doc_id % 5 = 0 AND doc_id % 2 = 1"))
    return tables.look_up_classes(docs, docs.where("doc_id % 3 = 0").withColumn("doc_class", F.lit("9")), held)


@register("s15_result_store", "SELECT concat('d', p_size % 3) AS db, p_brand AS tbl, count(*) AS n, sum(p_partkey)::BIGINT AS total FROM part GROUP BY ALL")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "results")
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("d"), (F.col("p_size") % 3).cast("string")).alias("dbName"), F.col("p_brand").alias("tableName"), F.col("p_partkey").alias("id"))
    for k in (0, 1, 2):
        tables.write_results(part.where(F.col("dbName") == f"d{k}"), folder)
    tables.write_results(part.where("dbName = 'd1'"), folder)
    return spark.read.json(folder).groupBy("db", "tbl").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@register("s10_collection_page", "SELECT doc_id AS id, source FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20 OFFSET 5")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_collection(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), F.col("lang") == "en", ["id", "source"], limit=20, offset=5)


@register("s12_collection_copy", "SELECT vec_id, label, len(embedding) AS dims FROM embeddings")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch(spark, "copy")
    tables.copy_collection(spark, f"{sf_dir}/embeddings.parquet", target)
    return spark.read.parquet(target).select("vec_id", "label", F.size("embedding").cast("long").alias("dims"))


@register("s16_dump", "SELECT item_id, md5(text) AS text_md5 FROM benchmark")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "dump")
    tables.write_dump(table(spark, sf_dir, "benchmark"), folder)
    return spark.read.json(folder).select("item_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("s19_final", "SELECT lang AS spec_uid, doc_id FROM documents WHERE lang = 'de'")
def s19(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "final")
    table(spark, sf_dir, "documents").select(F.col("lang").alias("spec_uid"), "doc_id").write.partitionBy("spec_uid").parquet(folder)
    return tables.read_final(spark, folder, "de").select("spec_uid", "doc_id")
