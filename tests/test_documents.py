import random
import time

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import chunking, grids, headings, lines, scoring
from gradeflow.sources import documents


def line_table(spark, *texts):
    return lines.to_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))


def back(df):
    return {r.doc_id: r.text for r in lines.from_lines(df).collect()}


def test_toc(spark):
    got = back(lines.remove_toc(line_table(spark, "目录\n第一章 概述......1\n\n第二章 范围.....2\n正文 3.14", "a\nlone....5\nb", "x … … 3\ny．．4")))
    assert got == {0: "目录\n正文 3.14", 1: "a\nlone....5\nb"}


def test_second_pass(spark):
    got = back(headings.second_pass(line_table(spark, "## 1.1 X\n# note\n## 1.2 Y", "## 1.1 A\n# 7 b\ntext\n### 1.1.1 c\n# d\n## 1.2 E\n# f")))
    assert got == {0: "## 1.1 X\n### 1.1.1 note\n## 1.2 Y", 1: "## 1.1 A\n### 1.1.1 b\ntext\n### 1.1.1 c\n### 1.1.3 d\n## 1.2 E\n# f"}


def test_first_pass(spark):
    got = back(headings.first_pass(line_table(spark, "### 1 A\n# 1.1 B\n# plain\n## 2 C\n# 2.3.1 D\nbody", "# 12 A\n# 12.1 B\n# 3.1.1 x\n# 2 y\n# 3 z\n# 13 C")))
    assert got[0] == "# 1 A\n## 1.1 B\n# plain\n# 2 C\n### 2.3.1 D\nbody"
    # 3.1.1 breaks into 12.1; whole numbers below 12 become its children until 13 comes
    assert got[1] == "# 12 A\n## 12.1 B\n### 3.1.1 x\n### 12.1.1 y\n### 12.1.2 z\n# 13 C"


def test_assembled(spark):
    table = line_table(spark, "目录\n一....1\n二....2\n# 1 A\n\n# 1.1 B")
    names = spark.createDataFrame([(0, "name"), (1, "none")], "doc_id int, name string")
    assert {r.doc_id: r.text for r in headings.assembled(table, names).collect()} == {0: "# name\n\n目录\n# 1 A\n## 1.1 B", 1: "# none\n\n"}


def test_remove_similar(spark):
    own, toc = line_table(spark, "chapter one\nchapter one!\nother"), line_table(spark, "chapter one\nabsent")
    assert back(headings.remove_similar(own, toc)) == {0: "chapter one!\nother"}


def test_outline(spark):
    got = {r.doc_id: r.text for r in lines.outline(line_table(spark, "# A\n\nfoo\n## B\n### C\nbar", "no heading", "# " + "x" * 898 + "\ny", "#\nz")).collect()}
    assert got == {0: "# A\nfoo\n## B\nbar\n### C\nbar", 2: "# " + "x" * 898, 3: "#\nz"}
    short = spark.createDataFrame([(0, "# A\nb"), (1, "plain text")], "doc_id int, text string")
    assert {r.doc_id: r.text for r in lines.outline_or_head(short, head=5).collect()} == {0: "# A\nb", 1: "plain"}


def test_preferred_versions(spark):
    files = [("k/20240101000000", "a.md"), ("k/20240202000000", "a.md"), ("k/20240202000000", "a_final.md"), ("k/20240202000000", "b_with_html.md"), ("k/20240202000000", "b.md"), ("k/20240202000000", "c.txt")]
    got = {(r.base, r.name) for r in lines.preferred_versions(spark.createDataFrame(files, "path string, name string")).collect()}
    assert got == {("a", "a_final.md"), ("b", "b_with_html.md")}


def chunks(spark, text, **options):
    return [r.chunk for r in chunking.narrative_chunks(line_table(spark, text), **options).orderBy("section", "chunk_no").collect()]


def test_narrative_chunks(spark):
    assert chunks(spark, "# T\n## A\nfoo\n## B\nbar") == ["T:A:foo", "T:A:B:bar"]
    assert chunks(spark, "# T\n## A\nfoo\n## B\nbar", stack_rule="level") == ["T:A:foo", "T:B:bar"]
    assert [len(c) for c in chunks(spark, "# T\n" + "x" * 1201)] == [502, 502, 203]
    assert chunks(spark, "lead  line\nmore\n# H\n```\ncode\n```\ntail") == ["lead  line:lead line more", "lead  line:H:tail"]
    assert chunks(spark, "# T\n```\n{}\n```\n") == [] and chunks(spark, "") == []


@pytest.mark.parametrize("seed", range(3))
def test_chunks_give_the_text_again(spark, seed):
    rng = random.Random(seed)
    body = "".join(rng.choice("ab \n") for _ in range(3000))
    got = chunks(spark, body, size=97)
    prefix = got[0][: got[0].index(":") + 1]
    assert "".join(c[len(prefix) :] for c in got) == " ".join(body.split())


def test_data_chunks_and_routes(spark):
    table = line_table(spark, '# 通信业类\n## 公共资源类数据\n{"a":1}\n{"b":2}\n# X\n["p","q"]\nprose')
    assert [r.chunk for r in chunking.data_chunks(table).orderBy("pos", "chunk").collect()] == ['通信业类,公共资源类数据,{"a":1}', '通信业类,公共资源类数据,{"b":2}', "X,p", "X,q"]
    both = line_table(spark, "# T\nfoo", '# T\n{"a":1}', "# T\nbar")
    classes = spark.createDataFrame([(0, "1", True), (1, "2", True), (2, "2", False)], "doc_id int, doc_class string, has_category boolean")
    assert {(r.doc_id, r.kind, r.chunk) for r in chunking.routed_chunks(both, classes).collect()} == {(0, "narrative", "T:foo"), (1, "data", 'T,{"a":1}'), (2, "general_knowledge", "T:bar")}


CELL, RANGE = "table_id int, row int, col int, text string", "table_id int, r0 int, c0 int, r1 int, c1 int, text string"


def test_merged_and_hidden(spark):
    cells = spark.createDataFrame([(1, r, c, f"{r}{c}") for r in range(3) for c in range(3)], CELL)
    ranges = spark.createDataFrame([(1, 0, 0, 1, 0, "x"), (1, 2, 1, 2, 1, "h")], RANGE)
    got = {(r.row, r.col): r.text for r in grids.fill_merged(cells, ranges).collect()}
    assert got[1, 0] == "x" and got[2, 2] == "22" and len(got) == 9
    rows, cols = spark.createDataFrame([(1, 2)], "table_id int, row int"), spark.createDataFrame([(1, 0)], "table_id int, col int")
    kept, moved = grids.drop_hidden(cells, ranges, rows, cols)
    assert {(r.row, r.col, r.text) for r in kept.collect()} == {(0, 0, "01"), (0, 1, "02"), (1, 0, "11"), (1, 1, "12")}
    assert moved.collect() == []


def test_header_and_records(spark):
    data = [["name", "age", "city"], ["1001", "31", "55"], ["1002", "32", "56"], ["1003", "33", "57"], ["", "", ""]]
    cells = spark.createDataFrame([(1, r, c, x) for r, row in enumerate(data) for c, x in enumerate(row)] + [(2, r, c, "same") for r in range(3) for c in range(2)], CELL)
    headers = grids.detect_header(cells)
    assert [tuple(r) for r in headers.collect()] == [(1, 0)]
    records = {(r.table_id, r.row): r.record for r in grids.to_records(cells, headers).collect()}
    assert records[1, 1] == {"name": "1001", "age": "31", "city": "55"} and (1, 4) not in records
    assert records[2, 0] == {"column1": "same", "column2": "same"} and len(records) == 6
    text = grids.json_lines(grids.to_records(cells.where("table_id = 1"), headers)).first().text
    assert text.split("\n")[0] == '{"name":"1001","age":"31","city":"55"}'


def test_names_of_records_are_made_once_for_a_table(spark):
    # with names made for each row, and again for each of its columns, this takes minutes
    wide = 300
    cells = spark.range(40).select(F.lit(1).alias("table_id"), F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("col"))
    cells = cells.withColumn("text", F.when(F.col("row") == 0, F.concat(F.lit(" n"), (F.col("col") % 250).cast("string"))).otherwise(F.concat("row", F.lit("-"), "col")))
    headers = spark.createDataFrame([(1, 0)], "table_id int, header_row int")
    began = time.monotonic()
    got = {r.row: r.record for r in grids.to_records(cells, headers).collect()}
    assert got == {r: {f"n{c % 250}": f"{r}-{c}" for c in range(wide)} for r in range(1, 40)}
    assert time.monotonic() - began < 30


HTML = "<table><tr><th rowspan=2>a b</th><th colspan='2'>c</th></tr><tr><td>d</td><td></td></tr></table>"


def test_html(spark):
    assert grids.html_grids(HTML) == [[(0, 0, "a b"), (0, 1, "c"), (0, 2, "c"), (1, 0, "a b"), (1, 1, "d"), (1, 2, "")]]
    docs = spark.createDataFrame([(0, f"x\n{HTML}\n\n<div>k</div>\ny"), (1, "<div>only</div>"), (2, None)], "doc_id int, text string")
    assert {(r.doc_id, r.block_no, r.start) for r in grids.html_blocks(docs).collect()} == {(0, 0, 2), (1, 0, 0)}
    out = {r.doc_id: r.text for r in grids.tables_to_json(docs).collect()}
    assert out[0] == 'x\n{"ab": "ab", "c": ""}\ny' and out[1] == "<div>only</div>" and out[2] == ""
    assert grids.html_cells(docs, html="text").count() == 6


def test_plain_html_is_read_as_the_parser_does():
    rng = random.Random(5)
    parts = ["<table>", "</table>", "<TR>", "</tr>", "<td>", "</td >", '<th rowspan="2">', "<td colspan='3' class=\"a b='c'\">", "<div>", "</div>", "<html>", "</html>", "<b>", "</b>", " x ", "\n", "<table\nborder='1'>", '<td colspan="0">', "<tdx>", ">", '"']
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 18)))
        assert grids._PLAIN.fullmatch(text)
        assert list(grids._plain_blocks(text)) == grids._Blocks(text).found and grids._plain_tables(text) == grids._any_tables(text)
    others = ["<td>&amp;", "<!-- c -->", "<script>x</script>", "<td a=b>", "<br/>", "<td a>", "a < b", "</ td>", '<td a="x>y">', "<?x?>", "<![CDATA[x]]>", "<td"]
    assert not any(grids._PLAIN.fullmatch(x) for x in others)


def test_orders_as_html_keep_their_parts(spark):
    from gradeflow.queries import documents

    docs = documents.order_html(spark, "/root/testdata/sf0.001")
    assert docs._jdf.queryExecution().toString().count("Exchange hashpartitioning") == docs._jdf.queryExecution().toString().count("REPARTITION_BY_NUM") > 0


def test_latin_texts_that_could_be_gbk(spark, tmp_path):
    from gradeflow.queries.documents import s03

    texts = [(0, "ñ"), (1, None), (2, ""), (3, "año"), (4, "客户é"), (5, "été"), (6, "Ã©")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.latin_same for r in s03(spark, str(tmp_path)).collect()} == dict.fromkeys(range(7), True)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "b.md").write_bytes(b"# B\n\xe9t\xe9")
    (tmp_path / "c.xyz").write_bytes(b"?")
    (tmp_path / "d.csv").write_text('k,v\n1,"x, y"\n2,\n')
    good, bad = documents.scan(spark, str(tmp_path))
    assert {r.stem: r.text for r in documents.markdown(good).collect() if r.suffix != "csv"} == {"a": "# a\n\nhéllo", "b": "# B\nété"}
    assert [r.error for r in bad.collect()] == ["unsupported suffix: xyz"]
    assert {r.status: r.n for r in documents.outcome(good, bad).collect()} == {"ok": 3, "failed": 1}
    assert [r.record for r in documents.csv_records(spark, str(tmp_path / "d.csv")).collect()] == ['{"k":"1","v":"x, y"}', '{"k":"2","v":""}']
    assert {r.kind for r in documents.size_report(spark, {"raw": str(tmp_path)}).collect()} == {"raw"}


def test_scorer(spark):
    def scorer(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    got = {r.prompt: (r.reply, r.error) for r in scoring.score_prompts(spark.createDataFrame([("a",), ("bad",), ("c",)], "prompt string"), scorer).collect()}
    assert got == {"a": ("A", None), "bad": (None, "ValueError: no"), "c": ("C", None)}
    kinds = spark.createDataFrame([("It is a long and winding sentence about nothing.",), ('{"a":1}\n{"b":2}\nx',)], "t string").select(scoring.document_class(F.col("t")).alias("c"))
    assert [r.c for r in kinds.collect()] == ["1", "2"]


def test_narrative_chunks_shuffle_once(spark):
    lines = spark.createDataFrame([(i, k, line) for i in range(3) for k, line in enumerate(["# T", "foo", "## A", "### B", "x", "## C", "y", "# U", "z"])], "doc_id long, pos int, line string")
    for rule, last in (("count", ["T:foo", "T:A:B:x", "T:A:C:y", "T:U:z"]), ("level", ["T:foo", "T:A:B:x", "T:C:y", "T:U:z"])):
        out = chunking.narrative_chunks(lines, stack_rule=rule)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan
        assert [r.chunk for r in out.where("doc_id = 1").orderBy("section").collect()] == last


def test_windows_of_characters(spark):
    texts = ["", None, "a", "\n\r " * 4, "é😀x" * 5, "abcdefg" * 3]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(chunking.windows(F.col("t"), 7).alias("w")).collect()
    assert [r.w for r in got] == [[t] if not t else [t[i : i + 7] for i in range(0, len(t), 7)] for t in texts]
