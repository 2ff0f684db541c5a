"""The registered queries of the reference operators, each beside its SQL.

Tables have no taxonomy, so ``part`` serves as one, and ``region``, ``nation`` and ``supplier`` as one with inner rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grades as G
from ..functions import text as T
from ..operators import changes, chunking, grids, kb, lexical, lines, matching, postings, scoring, taxonomy, tree, vectors
from ..plans import interpret
from ..sources import tables
from ..session import stored
from ..streaming import triggers
from .base import register, table

# A taxonomy over part: three levels, a feature, a grade that may be joined, the words of the name as elements.
GRADE = """CASE WHEN p_size % 4 = 0 THEN concat('第', p_size % 5 + 1, '级')
                WHEN p_size % 4 = 1 THEN concat('第', p_size % 5 + 1, '级/第', p_size % 3 + 1, '级')
                WHEN p_size % 7 = 0 THEN '核心数据/第2级'
                WHEN p_size % 11 = 0 THEN '重要数据'
                ELSE concat('L', p_size % 4, '/L', p_size % 3) END"""
TAX = f"""tax AS (SELECT p_partkey AS row_no, [p_type, p_brand, p_name] AS path, concat(p_type, '、', p_brand) AS feature, {GRADE} AS grade,
               '' AS condition, string_split(p_name, ' ') AS elements, p_type, p_brand, p_name FROM part)"""


def part_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.lit("part").alias("spec_uid"), F.col("p_partkey").alias("row_no"), F.array("p_type", "p_brand", "p_name").alias("path"), F.concat("p_type", F.lit("、"), "p_brand").alias("feature"),
        F.expr(GRADE).alias("grade"), F.lit("").alias("condition"), F.split("p_name", " ").alias("elements"),
    )


PLACES = """places AS (
    SELECT r_regionkey AS row_no, [r_name] AS path FROM region
    UNION ALL SELECT 100 + n_nationkey, [r_name, n_name] FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 1000 + s_suppkey, [r_name, n_name, s_name] FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def place_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    inner = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    leaf = supplier.join(F.broadcast(inner), F.col("s_nationkey") == F.col("n_nationkey"))
    own = lambda df, no, *path: df.select(no.cast("long").alias("row_no"), F.array(*path).alias("path"))
    rows = own(region, F.col("r_regionkey"), "r_name").union(own(inner, F.col("n_nationkey") + 100, "r_name", "n_name")).union(own(leaf, F.col("s_suppkey") + 1000, "r_name", "n_name", "s_name"))
    return rows.select("row_no", "path", F.concat(F.lit("第"), (F.col("row_no") % 4 + 1).cast("string"), F.lit("级")).alias("grade"), F.lit("").alias("feature"))


# ---- retrieval ----

WORDS = "list_filter(regexp_extract_all(lower(text), '[一-鿿]+|[a-z0-9]+'), lambda w: length(w) > 1)"
BM25 = f"""
    words AS (SELECT doc_id, {WORDS} AS w FROM documents),
    posted AS (SELECT doc_id, len(w) AS dl, token, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS token FROM words) GROUP BY ALL),
    stats AS (SELECT count(*) AS n, avg(len(w)) AS a FROM words),
    df AS (SELECT token, count(*) AS df FROM posted GROUP BY token),
    raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, stats),
    idf AS (SELECT token, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
    asked AS (SELECT item_id, token, count(*) AS q FROM (SELECT item_id, unnest({WORDS}) AS token FROM benchmark) GROUP BY ALL),
    scored AS (SELECT item_id, doc_id, round(sum(q * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score
               FROM posted JOIN idf USING (token) JOIN asked USING (token), stats GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rk FROM scored WHERE score > 0) WHERE rk <= 15)"""


def bm25(spark: SparkSession, sf_dir: str, k: int = 15) -> DataFrame:
    index = postings.index_of(spark, f"{sf_dir}/documents.parquet")
    return postings.topk(index, table(spark, sf_dir, "benchmark"), k, "item_id").withColumnRenamed("query_id", "item_id")


@register("r03_bm25_topk", f"WITH {BM25} SELECT item_id, doc_id, score, rk FROM best")
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(spark, sf_dir)


@register(
    "r04_bm25_minmax",
    f"""WITH {BM25}, span AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM best WINDOW w AS (PARTITION BY item_id))
        SELECT item_id, doc_id, CASE WHEN hi = lo THEN 1.0 ELSE round((score - lo) / (hi - lo), 6) END AS norm_score FROM span""",
)
def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.min_max(bm25(spark, sf_dir), "item_id").select("item_id", "doc_id", "norm_score")


_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"


@register(
    "r05_ip_topk_filtered",
    f"""SELECT q_id, vec_id, ip, rk FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY ip DESC, vec_id) AS rk FROM (
            SELECT q.vec_id AS q_id, v.vec_id, round({_DOT.format("q.embedding", "v.embedding")}, 6) AS ip
            FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.label <> 1)) WHERE rk <= 5""",
)
def r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = table(spark, sf_dir, "embeddings")
    asked = vec.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vector"))
    return vectors.ip_topk(vec, asked, 5, F.col("label") != 1)


@register(
    "r06_cosine_pairs",
    f"""SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({_DOT.format("a.embedding", "b.embedding")} / (sqrt({_DOT.format("a.embedding", "a.embedding")}) * sqrt({_DOT.format("b.embedding", "b.embedding")})), 6) AS cos
        FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.label = b.label AND a.vec_id <> b.vec_id""",
)
def r06(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = table(spark, sf_dir, "embeddings")
    return vectors.similar(vec, vec.where("vec_id % 50 = 0"), -1.0, within="label")


# ---- names and matches ----

_PAIRS = "".join(f" WHEN left(t, 1) = '{a}' AND strpos(t, '{b}') BETWEEN 1 AND length(t) - 1 THEN substr(t, strpos(t, '{b}') + 1)" for a, b in T.BRACKETS.items())
CLEAN = f"""CASE WHEN strpos(t, ' ') > 0 THEN substr(t, strpos(t, ' ') + 1) {_PAIRS}
                 WHEN strpos(t, '、') BETWEEN 1 AND length(t) - 1 THEN substr(t, strpos(t, '、') + 1)
                 WHEN regexp_matches(t, '^[^一-鿿]+[一-鿿]') THEN regexp_extract(t, '^[^一-鿿]+([一-鿿].*)$', 1) ELSE t END"""


@register(
    "t01_clean_name",
    f"""SELECT t AS raw_name, {CLEAN} AS clean_name, n FROM (SELECT t, count(*) AS n FROM (
            SELECT o_orderpriority AS t FROM orders UNION ALL SELECT concat('A', p_size, '-1 ', p_type) FROM part UNION ALL SELECT concat('(', p_size, ')', p_brand) FROM part
            UNION ALL SELECT concat('第', p_size, '、', p_brand) FROM part UNION ALL SELECT concat('B', p_size, '客户', p_type) FROM part UNION ALL SELECT concat('[', p_brand, ']') FROM part) GROUP BY t)""",
)
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    lit = F.lit
    coded = part.select(
        F.explode(F.array(F.concat(lit("A"), "p_size", lit("-1 "), "p_type"), F.concat(lit("("), "p_size", lit(")"), "p_brand"), F.concat(lit("第"), "p_size", lit("、"), "p_brand"), F.concat(lit("B"), "p_size", lit("客户"), "p_type"), F.concat(lit("["), "p_brand", lit("]")))).alias("raw_name")
    )
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("raw_name")).union(coded)
    return names.groupBy("raw_name").agg(F.count("*").alias("n")).select("raw_name", T.clean_name(F.col("raw_name")).alias("clean_name"), "n")


@register(
    "t02_category_names",
    f"""WITH cells AS (SELECT p_partkey, 0 AS level, p_type AS t FROM part UNION ALL SELECT p_partkey, 1, concat('B ', p_brand) FROM part UNION ALL SELECT p_partkey, 2, p_name FROM part),
        named AS (SELECT p_partkey, level, 0 AS form, t AS name FROM cells UNION ALL SELECT p_partkey, level, 1, {CLEAN} FROM cells)
        SELECT name, min(p_partkey) AS first_row FROM named WHERE name <> '' GROUP BY name""",
)
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.array("p_type", F.concat(F.lit("B "), "p_brand"), "p_name").alias("path"))
    return taxonomy.category_names(tax).select("name", F.col("ord.row_no").alias("first_row"))


_NAMES = "SELECT DISTINCT concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) AS name FROM part UNION SELECT DISTINCT concat(p_name, 's') FROM part UNION SELECT DISTINCT p_type FROM part"
_LCS = """subs AS (SELECT DISTINCT name AS text, substr(name, i, l) AS s FROM asked, unnest(range(1, length(name) + 1)) AS a(i), unnest(range(1, length(name) + 1)) AS b(l) WHERE i + l - 1 <= length(name)),
        lcs AS (SELECT text, n.name, max(length(s)) AS l FROM subs JOIN names n ON contains(n.name, s) GROUP BY ALL)"""


@register(
    "t05_best_match",
    f"""WITH asked AS (SELECT DISTINCT p_name AS name FROM part), names AS ({_NAMES}), {_LCS},
        cleaned AS (SELECT a.name AS text, n.name, {CLEAN.replace("(t", "(a.name").replace(" t END", " a.name END").replace("left(a.name", "left(a.name")} AS ca, {CLEAN.replace("(t", "(n.name").replace(" t END", " n.name END")} AS cn FROM asked a, names n),
        scored AS (SELECT c.text, c.name, CASE WHEN c.text = c.name THEN 1.0 WHEN ca = cn THEN 0.95 ELSE round(coalesce(l, 0) / greatest(length(c.text), length(c.name)), 6) END AS score FROM cleaned c LEFT JOIN lcs ON lcs.text = c.text AND lcs.name = c.name)
        SELECT text, name, score FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, name) AS rk FROM scored WHERE score >= 0.5) WHERE rk = 1""",
)
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    names = part.select(F.explode(F.array(F.concat(words[1], F.lit(" "), words[0]), F.concat("p_name", F.lit("s")), F.col("p_type"))).alias("name")).distinct().withColumn("ord", F.col("name"))
    return taxonomy.best_match(part.select(F.col("p_name").alias("text")), names, least=0.5)


@register(
    "t08_category_lookup",
    """WITH asked AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part UNION SELECT DISTINCT right(p_type, 4) FROM part),
       cells AS (SELECT p_partkey AS row_no, unnest([p_type, p_brand, p_name]) AS cell FROM part),
       hit AS (SELECT name, row_no, name = cell AS exact FROM asked JOIN cells ON ends_with(cell, name))
       SELECT name, row_no, exact FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY exact DESC, row_no) AS rk FROM hit) WHERE rk = 1""",
)
def t08(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    asked = part.select(F.explode(F.array("p_brand", F.split("p_name", " ")[1], F.expr("right(p_type, 4)"))).alias("name"))
    return taxonomy.lookup_rows(asked, part_taxonomy(spark, sf_dir))


@register("t09_category_text", f"WITH {TAX} SELECT row_no, md5(concat_ws(', ', p_type, p_brand, p_name, feature, grade, array_to_string(elements, '、'))) AS text_md5 FROM tax")
def t09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.category_text(part_taxonomy(spark, sf_dir)).select("row_no", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# ---- changes ----

CHANGES = f"""{TAX}, n AS (SELECT count(*) AS n FROM part),
    ops AS (SELECT event_id AS item_no, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'update' WHEN 'error' THEN 'delete' END AS action,
                   CASE WHEN user_id % 3 = 0 THEN concat(p_type, '|', p_brand, '|', p_name, '|new', user_id) ELSE concat(p_type, '|', p_brand, '|', p_name) END AS key,
                   concat('f', event_id) AS feature, CASE WHEN event_id % 2 = 0 THEN concat('L', event_id % 5) ELSE '' END AS grade
            FROM events JOIN n ON true JOIN part ON p_partkey = user_id % n.n WHERE event_type IN ('signup', 'view', 'error')),
    held AS (SELECT concat(p_type, '|', p_brand, '|', p_name) AS key, arg_min(feature, row_no) AS feature, arg_min(grade, row_no) AS grade FROM tax GROUP BY 1),
    flow AS (SELECT ops.*, held.key IS NOT NULL AS existed, held.feature AS f0, held.grade AS g0,
                    coalesce(last_value(CASE action WHEN 'create' THEN true WHEN 'delete' THEN false END IGNORE NULLS) OVER (PARTITION BY ops.key ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), held.key IS NOT NULL) AS was
             FROM ops LEFT JOIN held ON held.key = ops.key),
    done AS (SELECT *, CASE WHEN action = 'create' THEN NOT was ELSE was END AS ok FROM flow)"""


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category changes from events: sign-ups create, views update, errors delete; a third are below a category."""
    events, part = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    action = F.create_map(*map(F.lit, ("signup", "create", "view", "update", "error", "delete")))
    count = F.broadcast(part.agg(F.count("*").alias("n")))
    wanted = events.where(F.col("event_type").isin("signup", "view", "error")).crossJoin(count).join(part, F.col("p_partkey") == F.col("user_id") % F.col("n"))
    path = F.array("p_type", "p_brand", "p_name")
    return wanted.select(
        F.col("event_id").alias("item_no"), action[F.col("event_type")].alias("action"), F.when(F.col("user_id") % 3 == 0, F.array_append(path, F.concat(F.lit("new"), "user_id"))).otherwise(path).alias("path"),
        F.concat(F.lit("f"), "event_id").alias("feature"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("L"), (F.col("event_id") % 5).cast("string"))).otherwise("").alias("grade"),
    )


@register(
    "t10_change_batch",
    f"""WITH {CHANGES} SELECT key AS path, coalesce(arg_max(feature, item_no) FILTER (ok AND action <> 'delete'), any_value(f0)) AS feature,
            coalesce(arg_max(grade, item_no) FILTER (ok AND (action = 'create' OR action = 'update' AND grade <> '')), any_value(g0)) AS grade
        FROM done GROUP BY key HAVING coalesce(arg_max(action = 'create', item_no) FILTER (action <> 'update'), bool_or(existed))""",
)
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = changes.replay_changes(part_taxonomy(spark, sf_dir), event_changes(spark, sf_dir))
    return after.where("present").select(F.array_join("path", "|").alias("path"), "feature", "grade")


@register("t13_change_outcome", f"WITH {CHANGES} SELECT action, ok, count(*) AS n FROM done GROUP BY ALL")
def t13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.outcomes(changes.replay_changes(part_taxonomy(spark, sf_dir), event_changes(spark, sf_dir))).groupBy("action", "ok").agg(F.count("*").alias("n"))


@register(
    "t15_element_ops",
    f"""WITH {TAX}, adds AS (SELECT event_id, concat('Brand#', user_id % 25 + 1) AS name, concat('e', user_id % 7) AS e FROM events WHERE event_type = 'purchase'),
        first AS (SELECT name, e, min(event_id) AS since FROM adds GROUP BY ALL), lists AS (SELECT name, list(e ORDER BY since) AS es FROM first GROUP BY name)
        SELECT row_no, replace(array_to_string(list_concat(elements, coalesce(es, [])), ' '), 'widget', 'gadget') AS elements FROM tax LEFT JOIN lists ON name = p_brand""",
)
def t15(spark: SparkSession, sf_dir: str) -> DataFrame:
    adds = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("item_no"), F.lit("add").alias("action"), F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("name"), F.array(F.concat(F.lit("e"), (F.col("user_id") % 7).cast("string"))).alias("elements"))
    after, _ = changes.rename_element(changes.apply_element_changes(part_taxonomy(spark, sf_dir), adds), "widget", "gadget")
    return after.select("row_no", F.array_join("elements", " ").alias("elements"))


# ---- prefixes, leaves, grades, trees ----


@register(
    "t21_prefix_prune",
    f"""WITH {PLACES}, valid AS (SELECT path FROM places WHERE row_no >= 1000 AND row_no % 2 = 0), ok AS (SELECT DISTINCT array_to_string(path[1:i], '|') AS p FROM valid, unnest(range(1, len(path) + 1)) AS t(i))
        SELECT array_to_string(path, '|') AS path, p IS NOT NULL AS kept FROM places LEFT JOIN ok ON p = array_to_string(path, '|')""",
)
def t21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = place_taxonomy(spark, sf_dir)
    pruned = taxonomy.prefix_prune(rows, rows.where("row_no >= 1000 AND row_no % 2 = 0"))
    return pruned.select(F.array_join("path", "|").alias("path"), "kept")


@register(
    "t22_non_leaf_prune",
    f"""WITH {PLACES}, inner_paths AS (SELECT DISTINCT array_to_string(path[1:i], '->') AS p FROM places, unnest(range(1, len(path))) AS t(i))
        SELECT array_to_string(path, '->') AS path, p IS NULL AS is_leaf FROM places LEFT JOIN inner_paths ON p = array_to_string(path, '->')""",
)
def t22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.with_leaf(place_taxonomy(spark, sf_dir)).select(taxonomy.path_text(F.col("path")).alias("path"), "is_leaf")


_NUMBERS = "list_max(list_transform(regexp_extract_all({0}, '\\d+'), lambda n: n::BIGINT))"


@register(
    "t26_lowest_grade",
    f"""WITH {TAX}, g AS (SELECT DISTINCT grade FROM tax), p AS (SELECT grade, unnest(string_split(grade, '/')) AS x, generate_subscripts(string_split(grade, '/'), 1) AS i FROM g),
        best AS (SELECT grade, x, row_number() OVER (PARTITION BY grade ORDER BY CASE x WHEN '核心数据' THEN 1 WHEN '重要数据' THEN 2 ELSE 3 END, coalesce({_NUMBERS.format("x")}, 0) DESC, i) AS rk FROM p)
        SELECT grade AS grade_text, CASE WHEN contains(grade, '/') THEN x ELSE grade END AS lowest FROM best WHERE rk = 1""",
)
def t26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_taxonomy(spark, sf_dir).select(F.col("grade").alias("grade_text")).distinct().withColumn("lowest", G.lowest_grade(F.col("grade_text")))


@register(
    "t25_grade_choice",
    f"""WITH {TAX}, g AS (SELECT DISTINCT grade, list_transform(regexp_extract_all(grade, '第(\\d+)级', 1), lambda n: n::INT) AS n FROM tax)
        SELECT grade AS grade_text, CASE WHEN contains(grade, '/') AND len(n) > 0 THEN concat('第', list_max(n), '级') ELSE grade END AS highest,
               CASE WHEN contains(grade, '/') AND len(n) > 0 THEN concat('第', list_min(n), '级') ELSE grade END AS smallest FROM g""",
)
def t25(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("grade_text")
    return part_taxonomy(spark, sf_dir).select(F.col("grade").alias("grade_text")).distinct().select(g, G.choose_grade(g).alias("highest"), G.choose_grade(g, highest=False).alias("smallest"))


@register(
    "t28_grade_priority",
    f"""WITH {TAX}, p AS (SELECT DISTINCT unnest(string_split(grade, '/')) AS x FROM tax),
        g AS (SELECT DISTINCT CASE WHEN contains(x, '核心数据') THEN '核心数据' WHEN contains(x, '重要数据') THEN '重要数据' ELSE x END AS grade FROM p)
        SELECT grade, row_number() OVER (ORDER BY CASE grade WHEN '核心数据' THEN 1 WHEN '重要数据' THEN 2 ELSE 3 END, coalesce({_NUMBERS.format("grade")}, 0) DESC, grade) AS priority FROM g""",
)
def t28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.grade_priorities(taxonomy.distinct_grades(part_taxonomy(spark, sf_dir)))


@register(
    "t30_duplicate_elements",
    f"""WITH {TAX}, m AS (SELECT unnest(elements) AS element, p_name AS category, row_no FROM tax), c AS (SELECT element, category, min(row_no) AS row_no FROM m GROUP BY ALL)
        SELECT element, count(*) AS n_categories, arg_min(category, row_no) AS chosen FROM c GROUP BY element HAVING count(*) > 1""",
)
def t30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.duplicate_elements(part_taxonomy(spark, sf_dir))


@register(
    "t31_tree_edges",
    f"""WITH {PLACES}, nodes AS (SELECT path[1:i] AS p, CASE WHEN i = len(path) THEN row_no END AS own FROM places, unnest(range(1, len(path) + 1)) AS t(i)),
        g AS (SELECT p, min(own) AS own FROM nodes GROUP BY p), c AS (SELECT p[1:len(p) - 1] AS up, count(*) AS n FROM g WHERE len(p) > 1 GROUP BY 1)
        SELECT array_to_string(g.p, '|') AS node, CASE WHEN len(g.p) > 1 THEN array_to_string(g.p[1:len(g.p) - 1], '|') END AS parent, len(g.p) AS depth, concat('第', own % 4 + 1, '级') AS grade, coalesce(n, 0) AS n_children
        FROM g LEFT JOIN c ON c.up = g.p""",
)
def t31(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda c: F.replace(F.col(c), F.lit(taxonomy.SEPARATOR), F.lit("|")).alias(c)
    return tree.tree_edges(place_taxonomy(spark, sf_dir)).select(shown("node"), shown("parent"), "depth", "grade", "n_children")


@register(
    "t32_scene_type",
    f"""WITH {TAX}, s AS (SELECT DISTINCT p_name AS category, CASE WHEN contains(grade, '核心数据') THEN 3 WHEN contains(grade, '重要数据') THEN 2 ELSE 1 END AS s FROM tax),
        l AS (SELECT category, array_to_string(list(s ORDER BY s), ',') AS scenes FROM s GROUP BY category), m AS (SELECT DISTINCT unnest(elements) AS element, p_name AS category FROM tax)
        SELECT element, category, scenes FROM m JOIN l USING (category)""",
)
def t32(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = part_taxonomy(spark, sf_dir)
    mapped = taxonomy.element_mappings(tax).select("element", "category").distinct()
    return tree.element_scenes(mapped, tax).select("element", "category", F.array_join(F.transform("scenes", lambda x: x.cast("string")), ",").alias("scenes"))


# ---- documents ----

LINES = "SELECT doc_id, unnest(string_split({0}, chr(10))) AS line, generate_subscripts(string_split({0}, chr(10)), 1) AS i FROM documents"


@register(
    "d02_toc_removal",
    f"""WITH raw AS ({LINES.format("concat(lang, ' ....', doc_id % 9, chr(10), source, '.. 2', chr(10), text, chr(10), 'lone...7')")}),
        kept AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM raw WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
        flag AS (SELECT *, regexp_matches(regexp_replace(line, '\\s+', '', 'g'), '[.．…]{{2,}}[0-9]+$') AS f FROM kept),
        near AS (SELECT *, coalesce(lag(f) OVER w, false) OR coalesce(lead(f) OVER w, false) AS n FROM flag WINDOW w AS (PARTITION BY doc_id ORDER BY i))
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, md5(line) AS line_md5 FROM near WHERE NOT (f AND n)""",
)
def d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.concat("lang", F.lit(" ...."), (F.col("doc_id") % 9).cast("string"), F.lit("\n"), "source", F.lit(".. 2\n"), "text", F.lit("\nlone...7"))
    return lines.remove_toc(lines.to_lines(docs.select("doc_id", text.alias("text")))).select("doc_id", "pos", F.md5(F.col("line").cast("binary")).alias("line_md5"))


CELLS = """cells AS (SELECT l_orderkey AS table_id, l_linenumber::INT AS "row", c AS col, CASE c WHEN 0 THEN l_returnflag WHEN 1 THEN l_linestatus ELSE concat('q', l_partkey) END AS text
                     FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL), unnest(range(0, 3)) AS t(c))"""


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each order: a row for each line number, three columns."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("a"), F.min("l_linestatus").alias("b"), F.concat(F.lit("q"), F.min("l_partkey").cast("string")).alias("c"))
    return items.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.posexplode(F.array("a", "b", "c")).alias("col", "text"))


@register(
    "d10_merged_fill",
    f"""WITH {CELLS}, ranges AS (SELECT o_orderkey AS table_id, 1 AS r0, 1 + o_custkey % 3 AS r1, o_custkey % 3 AS c0, greatest(o_custkey % 3, 1) AS c1, o_orderstatus AS text FROM orders WHERE o_custkey % 2 = 0),
        inside AS (SELECT table_id, r AS "row", c AS col, text FROM ranges, unnest(range(r0, r1 + 1)) AS a(r), unnest(range(c0, c1 + 1)) AS b(c))
        SELECT coalesce(cells.table_id, inside.table_id) AS table_id, coalesce(cells."row", inside."row") AS "row", coalesce(cells.col, inside.col) AS col, coalesce(inside.text, cells.text) AS text
        FROM cells FULL JOIN inside ON cells.table_id = inside.table_id AND cells."row" = inside."row" AND cells.col = inside.col""",
)
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = (F.col("o_custkey") % 3).cast("int")
    ranges = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("table_id"), F.lit(1).alias("r0"), (1 + third).alias("r1"), third.alias("c0"), F.greatest(third, F.lit(1)).alias("c1"), F.col("o_orderstatus").alias("text"))
    return grids.fill_merged(order_cells(spark, sf_dir), ranges)


@register(
    "d13_grid_records",
    f"""WITH {CELLS}, h AS (SELECT table_id, min("row") AS h FROM cells GROUP BY ALL),
        named AS (SELECT c.table_id, c."row", c.col, c.text, n.text AS name FROM cells c JOIN h USING (table_id) JOIN cells n ON n.table_id = c.table_id AND n."row" = h AND n.col = c.col WHERE c."row" > h),
        last AS (SELECT *, row_number() OVER (PARTITION BY table_id, "row", name ORDER BY col DESC) AS rk FROM named)
        SELECT table_id, "row", md5(concat('{{', string_agg(concat('"', name, '":"', text, '"'), ',' ORDER BY col), '}}')) AS json_md5 FROM last WHERE rk = 1 GROUP BY ALL""",
)
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_cells(spark, sf_dir)
    headers = cells.groupBy("table_id").agg(F.min("row").alias("header_row"))
    return grids.to_records(cells, headers).select("table_id", "row", F.md5(F.to_json(grids.without_spaces(F.col("record"))).cast("binary")).alias("json_md5"))


OUTLINED = "concat('# ', source, chr(10), chr(10), text, chr(10), '## ', lang, chr(10), '### ', doc_id, chr(10), 'last')"


@register(
    "d18_outline",
    f"""WITH l AS ({LINES.format(OUTLINED)}), s AS (SELECT *, starts_with(trim(line), '#') AS h FROM l),
        f AS (SELECT *, first_value(CASE WHEN NOT h AND trim(line) <> '' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM s),
        items AS (SELECT doc_id, i * 2 AS o, line AS item FROM f WHERE h UNION ALL SELECT doc_id, i * 2 + 1, nxt FROM f WHERE h AND nxt IS NOT NULL),
        run AS (SELECT *, coalesce(sum(length(item)) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM items),
        cut AS (SELECT doc_id, o, substr(item, 1, (900 - b)::BIGINT) AS item FROM run WHERE b < 900)
        SELECT doc_id, md5(string_agg(item, chr(10) ORDER BY o)) AS outline_md5, (sum(length(item)) + count(*) - 1)::BIGINT AS n_chars FROM cut GROUP BY doc_id""",
)
def d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# "), "source", F.lit("\n\n"), "text", F.lit("\n## "), "lang", F.lit("\n### "), F.col("doc_id").cast("string"), F.lit("\nlast"))
    out = lines.outline(lines.to_lines(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))))
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("outline_md5"), F.length("text").cast("long").alias("n_chars"))


@register(
    "d20_annotations",
    """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat(source, ' (', lang, ') ', replace(text, chr(10), ' '), ' [', doc_id, '] <x> — tail: y'), '\\(.*?\\)', '', 'g'), '\\[.*?\\]', '', 'g'), '<.*?>', '', 'g'), '—.*$', '', 'g'), '\\s+', ' ', 'g'))) AS clean_md5
       FROM (SELECT doc_id, source, lang, regexp_replace(regexp_replace(text, '[\\[\\]{}<>:—()【】《》（）：]', '', 'g'), '\\s+', ' ', 'g') AS text FROM documents)""",
)
def d20(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("text", r"[\[\]{}<>:—()【】《》（）：]", ""), r"\s+", " ")
    text = F.concat("source", F.lit(" ("), "lang", F.lit(") "), bare, F.lit(" ["), F.col("doc_id").cast("string"), F.lit("] <x> — tail: y"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.remove_annotations(text).cast("binary")).alias("clean_md5"))


@register(
    "c01_narrative_chunks",
    """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]) AS title FROM documents WHERE NOT regexp_matches(text, '(^|\\n)(#{1,6}\\s|\\s*```)'))
       SELECT doc_id, i AS chunk_no, md5(concat(title, ':', substr(t, i * 500 + 1, 500))) AS chunk_md5 FROM t, unnest(range(0, (length(t) + 499) // 500)) AS c(i) WHERE t <> ''""",
)
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"(^|\n)(#{1,6}\s|\s*```)"))
    return chunking.narrative_chunks(lines.to_lines(docs)).select("doc_id", "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@register(
    "c02_data_chunks",
    """SELECT doc_id, concat(source, ',', lang, ',', '{"id":', doc_id, ',"n":', n_chars, '}') AS chunk FROM documents UNION ALL SELECT doc_id, concat(source, ',', lang, ',', unnest([source, lang])) FROM documents""",
)
def c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("n_chars").alias("n"))), F.lit("\n"), F.to_json(F.array("source", "lang")))
    return chunking.data_chunks(lines.to_lines(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))).select("doc_id", "chunk")


# ---- embeddings ----


@register(
    "v01_hash_embed",
    """WITH t AS (SELECT DISTINCT text FROM documents WHERE text <> ''), l AS (SELECT md5(text) AS text_md5, string_split(text, '') AS c FROM t), g AS (SELECT text_md5, concat(c[i], c[i + 1], c[i + 2]) AS gram, count(*) AS c FROM l, unnest(range(1, greatest(1, len(c) - 2) + 1)) AS u(i) GROUP BY ALL),
       h AS (SELECT gram, md5(gram) AS h FROM (SELECT DISTINCT gram FROM g)),
       s AS (SELECT gram, CAST(('0x' || substr(h, 1, 7))::BIGINT % 64 AS INT) AS dim, CASE WHEN substr(h, 8, 1) < '8' THEN 1 ELSE -1 END AS sign FROM h)
       SELECT text_md5, dim, sum(c * sign)::BIGINT AS weight FROM g JOIN s USING (gram) GROUP BY ALL HAVING sum(c * sign) <> 0""",
)
def v01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.hash_embed(table(spark, sf_dir, "documents"))


# ---- matching and recognition ----


@register(
    "r09_hybrid_match",
    f"""WITH {BM25}, q AS (SELECT vec_id, embedding FROM embeddings), span AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM best WINDOW w AS (PARTITION BY item_id)),
        n AS (SELECT item_id, doc_id, CASE WHEN hi = lo THEN 1.0 ELSE round((score - lo) / (hi - lo), 6) END AS b FROM span),
        e AS (SELECT n.item_id, n.doc_id, b, round({_DOT.format("x.embedding", "y.embedding")} / (sqrt({_DOT.format("x.embedding", "x.embedding")}) * sqrt({_DOT.format("y.embedding", "y.embedding")})), 6) AS e
              FROM n LEFT JOIN q x ON x.vec_id = n.item_id LEFT JOIN q y ON y.vec_id = n.doc_id),
        s AS (SELECT item_id, doc_id, round(e + 2 * b, 6) AS sim FROM e WHERE e IS NOT NULL)
        SELECT item_id, doc_id, sim, rk FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, doc_id) AS rk FROM s) WHERE rk <= 5""",
)
def r09(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = table(spark, sf_dir, "embeddings")
    bm = lexical.min_max(bm25(spark, sf_dir), "item_id").select("item_id", "doc_id", F.col("norm_score").alias("bm25"))
    x, y = vec.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("xv")), vec.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("yv"))
    emb = bm.select("item_id", "doc_id").join(x, "item_id").join(y, "doc_id").select("item_id", "doc_id", F.round(vectors.cosine(F.col("xv"), F.col("yv")), 6).alias("embedding"))
    scored = matching.hybrid(emb, bm, ["item_id", "doc_id"], 1.0, 2.0)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("sim"), "doc_id"))
    return scored.withColumn("rk", rank).where("rk <= 5").select("item_id", "doc_id", "sim", "rk")


# ---- workbook interpretation ----


@register(
    "i02_numbering",
    """WITH f AS (SELECT p_type, min(p_partkey) AS k FROM part GROUP BY p_type), g AS (SELECT p_type, p_brand, min(p_partkey) AS k FROM part GROUP BY ALL),
       a AS (SELECT p_type, row_number() OVER (ORDER BY k) AS n FROM f), b AS (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY k) AS n FROM g)
       SELECT p_type, p_brand, chr((64 + a.n)::INT) AS code1, concat(chr((64 + a.n)::INT), b.n) AS code2, concat(chr((64 + a.n)::INT), b.n, '-1') AS first_code3 FROM a JOIN b USING (p_type)""",
)
def i02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.array("p_type", "p_brand", "p_name").alias("cells"))
    codes = lambda i: F.get("codes", F.lit(i))
    numbered = interpret.number_levels(rows, 3).select(F.get("cells", F.lit(0)).alias("p_type"), F.get("cells", F.lit(1)).alias("p_brand"), codes(0).alias("code1"), codes(1).alias("code2"), codes(2).alias("c3"))
    return numbered.groupBy("p_type", "p_brand", "code1", "code2").agg(F.min("c3").alias("first_code3"))


@register(
    "i08_scope_expansion",
    """SELECT p_partkey AS row_no, unnest([p_name, p_brand, concat(p_type, '类')]) AS item, p_type AS category FROM part""",
)
def i08(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.concat_ws("、", "p_name", F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.concat("p_type", F.lit("类等")))
    return interpret.expand_scope(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.col("p_type").alias("category"), scope.alias("scope"))).drop("item_no")


CODED = """cells AS (SELECT p_partkey AS row_no, 0 AS col, concat(chr((65 + p_size % 5)::INT), ' ', p_type) AS text FROM part
    UNION ALL SELECT p_partkey, 1, concat(chr((65 + p_size % 5)::INT), p_size % 3 + 1, ' ', p_brand, ' long name') FROM part
    UNION ALL SELECT p_partkey, 2, concat(chr((65 + p_size % 5)::INT), p_size % 3 + 1, '-', p_size % 7, p_name) FROM part),
    q AS (SELECT row_no, string_agg(trim(concat(code, ' ', left(trim(rest), 9))), '；' ORDER BY col) AS query_text, arg_max(code, col) AS last_code
          FROM (SELECT row_no, col, regexp_extract(text, '^(?:[A-Z]\\s+)?([A-Z]\\d+(?:-\\d+)*)', 1) AS code, regexp_replace(text, '^(?:[A-Z]\\s+)?([A-Z]\\d+(?:-\\d+)*)', '') AS rest FROM cells) WHERE code <> '' GROUP BY row_no)"""


def coded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter, n, k = F.char(F.lit(65) + F.col("p_size") % 5), (F.col("p_size") % 3 + 1).cast("string"), (F.col("p_size") % 7).cast("string")
    cells = F.array(F.concat(letter, F.lit(" "), "p_type"), F.concat(letter, n, F.lit(" "), "p_brand", F.lit(" long name")), F.concat(letter, n, F.lit("-"), k, "p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.posexplode(cells).alias("col", "text"))


@register("i10_code_extract", f"WITH {CODED} SELECT row_no, query_text, last_code FROM q")
def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpret.code_queries(coded_cells(spark, sf_dir))


@register(
    "i13_grade_resolve",
    f"""WITH {CODED}, cand AS (SELECT q.row_no, i AS pos, CASE i WHEN 0 THEN concat(chr((65 + q.row_no % 6)::INT), (q.row_no + i) % 3 + 1, '-', q.row_no % 4, ' x (c', i, ')') WHEN 1 THEN concat(chr((65 + q.row_no % 4)::INT), ' W', i) ELSE concat('Z ', left(last_code, 1), i) END AS text, concat('L', i + q.row_no % 3) AS grade FROM q, unnest(range(0, 3)) AS t(i)),
        t AS (SELECT cand.*, CASE WHEN regexp_extract(text, '^(?:[A-Z]\\s+)?([A-Z]\\d*(?:-\\d+)*)', 1) = last_code OR starts_with(text, concat(last_code, ' ')) THEN 1 WHEN left(text, 1) = left(last_code, 1) THEN 2
              WHEN upper(substr(regexp_replace(text, '[^A-Za-z]', '', 'g'), 2, 1)) = left(last_code, 1) THEN 3 END AS tier FROM cand JOIN q USING (row_no)),
        b AS (SELECT *, min(tier) OVER (PARTITION BY row_no) AS best FROM t)
        SELECT row_no, coalesce(string_agg(grade, '/' ORDER BY pos) FILTER (tier = best), '') AS grade, coalesce(string_agg(nullif(regexp_extract(text, '\\(([^)]*)\\)', 1), ''), '/' ORDER BY pos) FILTER (tier = best), '') AS condition, min(best) AS tier FROM b GROUP BY row_no""",
)
def i13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interpret.code_queries(coded_cells(spark, sf_dir))
    r = F.col("row_no")
    text = lambda x: lambda i: F.char((F.lit(65) + r % x).cast("int"))
    first = F.concat(text(6)(0), (r % 3 + 1).cast("string"), F.lit("-"), (r % 4).cast("string"), F.lit(" x (c0)"))
    candidates = rows.select("row_no", F.posexplode(F.array(first, F.concat(text(4)(1), F.lit(" W1")), F.concat(F.lit("Z "), F.substring("last_code", 1, 1), F.lit("2")))).alias("pos", "text")).withColumn("grade", F.concat(F.lit("L"), (F.col("pos") + r % 3).cast("string")))
    return interpret.resolve_grades(rows.select("row_no", "last_code"), candidates).select("row_no", "grade", "condition", "tier")


@register(
    "i15_feature_elements",
    """SELECT p_partkey AS row_no, array_to_string(list_distinct_ordered, '|') AS elements FROM (SELECT p_partkey, CASE WHEN p_name = p_brand THEN [p_name, p_type] ELSE [p_name, p_brand, p_type] END AS list_distinct_ordered FROM part)""",
)
def i15(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature = F.concat(F.lit("客户资料包括："), "p_name", F.lit("、"), "p_brand", F.lit("，"), "p_type", F.lit("等"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.array_join(interpret.feature_elements(feature), "|").alias("elements"))


# ---- knowledge base ----


@register(
    "v03_record_expansion",
    f"""WITH {TAX}, v AS (SELECT row_no, list_concat([p_type, p_brand, p_name, feature], elements) AS v FROM tax)
        SELECT row_no, 'value' AS kind, md5(unnest(v)) AS text_md5 FROM v UNION ALL SELECT row_no, 'joined', md5(array_to_string(v, '、')) FROM v""",
)
def v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kb.expand_records(part_taxonomy(spark, sf_dir)).where("kind <> 'line'")
    return out.select("row_no", "kind", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register(
    "v07_numbered_records",
    f"""WITH {TAX}, v AS (SELECT DISTINCT unnest(list_concat([p_type, p_brand, p_name, feature], elements)) AS t FROM tax)
        SELECT md5(concat_ws(chr(30), t, t, t)) AS content_md5, 200000000 + row_number() OVER (ORDER BY md5(concat_ws(chr(30), t, t, t))) AS id FROM v""",
)
def v07(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = kb.expand_records(part_taxonomy(spark, sf_dir)).where("kind = 'value'")
    records = texts.select(F.lit("part").alias("spec_uid"), F.lit("general_knowledge").alias("kind"), "text", F.col("text").alias("vectorizing_text"), F.array("text").alias("items"))
    return kb.numbered(records).select("content_md5", "id")


@register(
    "v10_standard_elements",
    f"WITH {TAX}, e AS (SELECT row_no, p_type, p_brand, unnest(elements) AS e, generate_subscripts(elements, 1) AS i FROM tax) SELECT row_number() OVER (ORDER BY row_no, i) AS id, concat_ws('|', p_type, p_brand, e) AS items, row_no AS source_line FROM e",
)
def v10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.standard_elements(part_taxonomy(spark, sf_dir)).select("id", "items", "source_line")


@register(
    "x02_document_class",
    """WITH r AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
       s AS (SELECT doc_id, len(l) AS n, len(list_filter(l, lambda x: regexp_matches(trim(x), '^[\\[{].*[\\]}],?$') OR len(regexp_split_to_array(x, '[|\\t;]')) >= 3)) AS k, length(text) / greatest(1, len(regexp_split_to_array(text, '[.!?。！？]'))) AS m FROM r)
       SELECT doc_id, CASE WHEN k / greatest(1, n) >= 0.5 OR (m < 12 AND n >= 5) THEN '2' ELSE '1' END AS doc_class FROM s""",
)
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scoring.document_class(F.col("text")).alias("doc_class"))


# ---- sinks and streams ----


@register(
    "s13_collection_statistics",
    "SELECT lang AS spec_uid, CASE WHEN n_chars > 2000 THEN 'classification' ELSE 'general_knowledge' END AS kind, count(*) AS row_count FROM documents GROUP BY ALL",
)
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("spec_uid"), F.when(F.col("n_chars") > 2000, "classification").otherwise("general_knowledge").alias("kind"))
    return tables.collection_statistics(docs)


@register("s11_keyword_scan", "SELECT doc_id FROM documents WHERE contains(text, 'token')")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keyword_scan(table(spark, sf_dir, "documents"), "token").select("doc_id")


@register(
    "s17_message_batches",
    f"""WITH {TAX}, m AS (SELECT row_no, unnest(elements) AS element, p_name AS category, generate_subscripts(elements, 1) AS i FROM tax), k AS (SELECT *, row_no * 100 + i AS o FROM m),
        b AS (SELECT *, (row_number() OVER (ORDER BY o) - 1) // 10 AS batch_no FROM k)
        SELECT batch_no, count(*) AS n, md5(concat('[', string_agg(concat('{{"DataElement":"', element, '","DataClassification":"', category, '"}}'), ',' ORDER BY o), ']')) AS payload_md5 FROM b GROUP BY batch_no""",
)
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = part_taxonomy(spark, sf_dir)
    mapped = tax.select(F.posexplode("elements").alias("i", "DataElement"), taxonomy.deepest(F.col("path")).alias("DataClassification"), "row_no").select("DataElement", "DataClassification", (F.col("row_no") * 100 + F.col("i") + 1).alias("o"))
    return tables.batched(mapped, "o").select("batch_no", "n", F.md5(F.col("payload").cast("binary")).alias("payload_md5"))


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase')")
    return events.select(F.col("user_id").cast("string").alias("spec_uid"), F.when(F.col("event_type") == "signup", "classification").otherwise("data_element").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("n"))


# Between two firings the kinds seen are few, so the state is carried by a recursive walk over each user's calls.
@register(
    "st1_trigger",
    """WITH RECURSIVE c AS (SELECT user_id, event_type = 'signup' AS cls, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('signup', 'purchase')),
       w AS (SELECT user_id, 0::BIGINT AS i, false AS c, false AS d, NULL::TIMESTAMP AS last, NULL::TIMESTAMP AS late, NULL::TIMESTAMP AS fired FROM (SELECT DISTINCT user_id FROM c)
             UNION ALL SELECT user_id, i, cc AND NOT (cc AND dd), dd AND NOT (cc AND dd), ts, late, CASE WHEN cc AND dd THEN ts END FROM (
                 SELECT c.user_id, c.i, c.ts, (w.c AND NOT x) OR c.cls AS cc, (w.d AND NOT x) OR NOT c.cls AS dd, CASE WHEN x THEN w.last + INTERVAL 120 SECOND END AS late
                 FROM (SELECT w.*, coalesce(w.c AND NOT w.d AND n.ts > w.last + INTERVAL 120 SECOND, false) AS x FROM w JOIN c n ON n.user_id = w.user_id AND n.i = w.i + 1) w JOIN c ON c.user_id = w.user_id AND c.i = w.i + 1)),
       e AS (SELECT max(ts) AS e FROM c), l AS (SELECT user_id, arg_max(last, i) AS last, arg_max(c AND NOT d, i) AS open FROM w GROUP BY user_id)
       SELECT user_id::VARCHAR AS spec_uid, strftime(late, '%Y-%m-%d %H:%M:%S') AS fired_at, 'timeout' AS reason FROM w WHERE late IS NOT NULL
       UNION ALL SELECT user_id::VARCHAR, strftime(fired, '%Y-%m-%d %H:%M:%S'), 'both' FROM w WHERE fired IS NOT NULL
       UNION ALL SELECT user_id::VARCHAR, strftime(last + INTERVAL 120 SECOND, '%Y-%m-%d %H:%M:%S'), 'timeout' FROM l, e WHERE open AND e > last + INTERVAL 120 SECOND""",
)
def st1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.trigger_batch(event_calls(spark, sf_dir)).select("spec_uid", F.date_format("fired_at", "yyyy-MM-dd HH:mm:ss").alias("fired_at"), "reason")


STATE = "CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 9 END"


@register("st2_task_status", f"SELECT user_id, arg_max({STATE}, (ts, event_id)) AS last_state FROM events WHERE event_type <> 'click' GROUP BY user_id")
def st2(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.expr(STATE).alias("state"), "ts", F.col("event_id").alias("n"))
    latest, _ = triggers.task_status(messages)
    return latest.select(F.col("task_id").alias("user_id"), F.col("state").alias("last_state"))


@register("st3_latest_requests", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def st3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.latest_requests(table(spark, sf_dir, "events").withColumn("n", F.col("event_id")), "user_id").select("user_id", "event_id")


@register(
    "st4_health_rounds",
    """WITH c AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS r, user_id, bool_and(event_type <> 'error') AS ok FROM events GROUP BY ALL), h AS (SELECT r, bool_or(ok) AS healthy FROM c GROUP BY r)
       SELECT strftime(r, '%Y-%m-%d %H:%M:%S') AS round_start, healthy, healthy AND NOT coalesce(lag(healthy) OVER (ORDER BY r), false) AS recovered FROM h""",
)
def st4(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = table(spark, sf_dir, "events").select(F.col("user_id").alias("check_id"), F.col("event_type").alias("service"), (F.col("event_type") != "error").alias("ok"), "ts")
    return triggers.health_rounds(checks, 60).select(F.date_format("round_start", "yyyy-MM-dd HH:mm:ss").alias("round_start"), "healthy", "recovered")


@register(
    "st6_orphan_tasks",
    "WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t, max(ts) AS ts FROM events GROUP BY user_id) SELECT user_id, t AS last_line FROM l WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTE AND NOT contains(t, 'purchase')",
)
def st6(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("line"), "ts", F.col("event_id").alias("n"))
    return triggers.orphan_tasks(log, dt.datetime(2024, 1, 15), "purchase").select(F.col("task_id").alias("user_id"), "last_line")
