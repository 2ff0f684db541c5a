"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, read, written
from . import license_scan
from .collocations import mine
from .conversation_trie import rebuilt_trie
from .exact_dedup import exact_dedup
from .html_extraction import extract
from .near_dup import near_duplicates
from .packing import pack
from .quality_cnn import KEEP_FROM, score, train
from .quality_rules import apply_rules, learn, statistics
from .sentencepiece_fst import encode
from .secret_scan import scan, span_string
from .suffix_tree_lm import score_documents
from .url_filter import filter_urls, host_of, path_of


def op1_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels"), held_out=2))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    places = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"), license_scan.names(F.col("found")).alias("licenses"), places.alias("places"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), threshold=0.8, n=5)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = span_string(F.filter("spans", lambda s: s["kind"] != "lexed"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"), count("lexed"))


def _day(value: Column, modulus: int) -> Column:
    """A number below modulus that follows from a string."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 7), 16, 10).cast("long") % modulus


def url_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, paths and URLs of pages; dates follow from the keys.

    Domains of unwanted trades are listed, most of them taken off after some weeks and some listed again; one section in five
    of a host and one URL in ten are listed from some day on.
    """
    named = pages.where("url IS NOT NULL").select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    day = lambda key, modulus, more=0: F.date_add(F.lit("2024-01-01").cast("date"), (_day(key, modulus) + more).cast("int"))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    bad = named.select(domain.alias("key")).where(F.col("key").rlike("casino|pills|bets|ads")).distinct()
    section = named.select(F.concat("host", F.lit("/"), F.regexp_extract("path", "^/([^/]*)", 1)).alias("key")).distinct().where(_day(F.col("key"), 5) == 0)
    single = named.select(F.col("url").alias("key")).distinct().where(_day(F.col("key"), 10) == 0)
    entry = lambda df, kind, at, action, reason: df.select(F.lit(kind).alias("kind"), "key", at.alias("at"), F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    key = F.col("key")
    return (
        entry(bad, "domain", day(key, 30), "add", "trade")
        .union(entry(bad.where(_day(key, 3) > 0), "domain", day(key, 30, 20), "remove", "appeal"))
        .union(entry(bad.where(_day(key, 3) > 1), "domain", day(key, 30, 40), "add", "relisted"))
        .union(entry(section, "prefix", day(key, 60), "add", "section"))
        .union(entry(single, "url", day(key, 90), "add", "report"))
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int")))
    out = filter_urls(captures, url_entries(pages))
    return out.select("page_id", "url", F.col("fetched_at").cast("string").alias("fetched_at"), "blocked", "kind", "key", F.col("listed_from").cast("string").alias("listed_from"), "reason")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(statistics(read(spark, sf_dir, "documents")))
    rules = learn(stats, read(spark, sf_dir, "labels"))
    return apply_rules(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), with_ids=False)


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 7) == 2
    scored = score_documents(read(spark, sf_dir, "documents"), is_training=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), size=2048)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "documents"), least=10, longest=3, top=2000, absorb=50)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(read(spark, sf_dir, "conversations"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


# The columns of three operators that SQL can express, by the same operators.


def secret_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(statistics(read(spark, sf_dir, "documents")), []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def suffix_tree_lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_suffix_tree_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_cnn": op1_quality_cnn,
    "op2_license_scan": op2_license_scan,
    "op3_near_dup": op3_near_dup,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op6_quality_rules": op6_quality_rules,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_suffix_tree_lm": op8_suffix_tree_lm,
    "op9_packing": op9_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_collocations": op11_collocations,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_html_extraction": op13_html_extraction,
    "secret_scan_base": secret_scan_base,
    "quality_rules_base": quality_rules_base,
    "suffix_tree_lm_base": suffix_tree_lm_base,
}

_EITHER = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_ASSIGN = rf"""({"|".join(map(_EITHER, ("password", "passwd", "secret", "token")))}|{_EITHER("api")}_?{_EITHER("key")})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=\-]+)"""
_CRC_OF = lambda column: f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""  # noqa: E731
_CRC = _CRC_OF("doc_id")

_HOST = r"regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
_DAY = lambda m, more=0: f"DATE '2024-01-01' + CAST(('0x' || substr(md5(key), 1, 7))::BIGINT % {m} + {more} AS INTEGER)"

ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": f"""
        WITH named AS (SELECT *, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, url, {_HOST} AS host, {_PATH} AS p FROM pages) WHERE host <> ''),
        bad AS (SELECT DISTINCT regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) AS key FROM named WHERE regexp_matches(regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1), 'casino|pills|bets|ads')),
        section AS (SELECT DISTINCT host || '/' || regexp_extract(path, '^/([^/]*)', 1) AS key FROM named),
        hashed AS (SELECT key, ('0x' || substr(md5(key), 1, 7))::BIGINT AS h FROM (SELECT key FROM bad UNION SELECT key FROM section UNION SELECT url FROM named)),
        entries AS (
            SELECT 'domain' AS kind, key, {_DAY(30)} AS since, true AS listed, 'trade' AS reason FROM bad
            UNION ALL SELECT 'domain', key, {_DAY(30, 20)}, false, NULL FROM bad JOIN hashed USING (key) WHERE h % 3 > 0
            UNION ALL SELECT 'domain', key, {_DAY(30, 40)}, true, 'relisted' FROM bad JOIN hashed USING (key) WHERE h % 3 > 1
            UNION ALL SELECT 'prefix', key, {_DAY(60)}, true, 'section' FROM section JOIN hashed USING (key) WHERE h % 5 = 0
            UNION ALL SELECT 'url', key, {_DAY(90)}, true, 'report' FROM (SELECT DISTINCT url AS key FROM named) JOIN hashed USING (key) WHERE h % 10 = 0),
        spans AS (SELECT *, lead(since) OVER (PARTITION BY kind, key ORDER BY since) AS until FROM entries),
        labels AS (SELECT *, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM named),
        keys AS (
            SELECT page_id, url, 1 AS rank, 'domain' AS kind, array_to_string(l[i:], '.') AS key FROM labels, unnest(range(1, len(l) + 1)) AS t(i)
            UNION ALL SELECT page_id, url, 2, 'prefix', host || '/' || array_to_string(s[1:i], '/') FROM labels, unnest(range(0, len(s) + 1)) AS t(i)
            UNION ALL SELECT page_id, url, 3, 'url', url FROM named),
        hits AS (
            SELECT k.page_id, kind, key, since, reason, row_number() OVER (PARTITION BY k.page_id ORDER BY rank DESC, length(key) DESC) AS r
            FROM keys k JOIN spans USING (kind, key)
            WHERE listed AND since <= DATE '2024-01-01' + CAST(k.page_id % 90 AS INTEGER) AND (until IS NULL OR until > DATE '2024-01-01' + CAST(k.page_id % 90 AS INTEGER)))
        SELECT p.page_id, p.url, CAST(DATE '2024-01-01' + CAST(p.page_id % 90 AS INTEGER) AS VARCHAR) AS fetched_at, h.page_id IS NOT NULL AS blocked,
               h.kind, h.key, CAST(CAST(h.since AS DATE) AS VARCHAR) AS listed_from, h.reason
        FROM pages p LEFT JOIN hits h ON h.page_id = p.page_id AND h.r = 1""",
    "secret_scan_base": f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS (SELECT doc_id, t, 0 AS kind, regexp_extract_all(t, '{_ASSIGN}') AS ms FROM d UNION ALL SELECT doc_id, t, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d UNION ALL SELECT doc_id, t, 2, regexp_extract_all(t, '[0-9a-f]+') FROM d),
        walk AS (SELECT doc_id, kind, ms, 0 AS i, t AS rest, 0::BIGINT AS gone, NULL::BIGINT AS a, NULL::VARCHAR AS s FROM m WHERE len(ms) > 0
                 UNION ALL SELECT doc_id, kind, ms, i + 1, substr(rest, strpos(rest, ms[i + 1]) + length(ms[i + 1])), gone + strpos(rest, ms[i + 1]) - 1 + length(ms[i + 1]), gone + strpos(rest, ms[i + 1]) - 1, ms[i + 1] FROM walk WHERE i < len(ms)),
        spans AS (SELECT doc_id, kind, a, a + length(s) AS b FROM walk WHERE i > 0 AND CASE kind WHEN 0 THEN length(regexp_extract(s, '{_ASSIGN}', 2)) >= 6 WHEN 1 THEN length(s) >= 20 ELSE length(s) >= 24 END),
        told AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(concat(['assign', 'access', 'hex'][kind + 1], ':', a, ':', b), ',' ORDER BY a, kind) AS s FROM spans GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256 FROM documents LEFT JOIN told USING (doc_id)""",
    "quality_rules_base": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS r(i)),
        twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 8)) AS r(k) GROUP BY doc_id),
        s AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN covered c USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s""",
    "suffix_tree_lm_base": rf"""
        WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') AS w FROM documents),
        k AS (SELECT doc_id, held_out, unnest(w) AS token FROM d), c AS (SELECT token, count(*) AS c FROM k WHERE NOT held_out GROUP BY token), n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
        SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score FROM k LEFT JOIN c USING (token), n GROUP BY doc_id""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS p FROM d)),
        f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM w, unnest(range(1, 4)) AS s(k), unnest(range(1, len(w) - k + 2)) AS r(i) GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, phrase, k AS size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
        longer AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS most FROM c, unnest([1, 2]) AS t(i) WHERE size = 3 GROUP BY ALL),
        kept AS (SELECT c.*, unnest(range(1, size)) AS cut FROM c LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * most < 50 * a, true)),
        cuts AS (SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM kept c
                 JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')),
        best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM cuts)
        SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) WHERE i = 1) WHERE rank <= 2000""",
    "op12_conversation_trie": f"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, conv_id - conv_id % 5 AS head, {_CRC_OF("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.head WHERE pos <= h UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
        l AS (SELECT conv_id, list(length(role) || ':' || role || text ORDER BY pos) AS s, list(strlen(text) ORDER BY pos) AS b FROM r GROUP BY conv_id),
        m AS (SELECT conv_id, unnest(range(0, len(s) + 1)) AS depth, s, b FROM (SELECT conv_id, coalesce(s, []) AS s, b FROM c LEFT JOIN l USING (conv_id))),
        nodes AS (SELECT depth, s[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n, coalesce(any_value(b[depth]), 0) AS b, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = depth) AS ended FROM m GROUP BY ALL),
        kids AS (SELECT depth - 1 AS depth, p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        told AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, p)),
        below AS (SELECT d AS depth, p[1:d] AS p, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n - 1) * b)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM told) GROUP BY ALL)
        SELECT x.conv_id, x.depth, up.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, n_leaves, saved_tokens, sha256(coalesce(x.ended, '')) AS ends_sha256
        FROM told x JOIN below USING (depth, p) LEFT JOIN nodes up ON up.depth = x.depth - 1 AND up.p = x.p[1:x.depth - 1]""",
}
