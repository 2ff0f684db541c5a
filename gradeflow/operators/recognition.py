"""Recognition of tables and files: candidates from BM25 and vectors, choice, resolution to a category, fields to elements.

Many requests are one DataFrame. A candidate carries its taxonomy row, so resolving it is a join. The default chooser fuses
the ranks of the sources; a callable scorer may take its place through prompts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.automata import SuffixAutomaton
from ..functions.grades import choose_grade
from ..functions.parsing import parse_choice
from ..functions.text import clean_name, remove_annotations
from .cells import meet
from .scoring import Scorer, score_prompts
from .taxonomy import deepest

#: Candidates of each source before and after they are de-duplicated.
DEPTH, KEPT = 15, 5
FUSION = 60


def gate(requests: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with at least one known spec among spec_uids, and the rest with a reason."""
    asked = requests.select("request_id", F.explode_outer("spec_uids").alias("spec_uid"))
    known = asked.join(specs.select("spec_uid").distinct(), "spec_uid", "left_semi").select("request_id").distinct()
    good = requests.join(known, "request_id", "left_semi")
    bad = requests.join(known, "request_id", "left_anti").withColumn("reason", F.when(F.coalesce(F.size("spec_uids"), F.lit(0)) <= 0, "no specification given").otherwise("no such specification"))
    return good, bad


def table_collections(requests: DataFrame, collections: DataFrame) -> DataFrame:
    """(request_id, spec_uid, kind): classification and general knowledge of the given specs, or of all without any; never
    narratives."""
    usable = collections.where("kind IN ('classification', 'general_knowledge')").select("spec_uid", "kind").distinct()
    given = requests.where(F.size("spec_uids") > 0).select("request_id", F.explode("spec_uids").alias("spec_uid")).distinct().join(usable, "spec_uid")
    free = requests.where(F.coalesce(F.size("spec_uids"), F.lit(0)) <= 0).select("request_id").crossJoin(F.broadcast(usable))
    return given.select("request_id", "spec_uid", "kind").union(free.select("request_id", "spec_uid", "kind"))


def file_collections(requests: DataFrame, collections: DataFrame) -> DataFrame:
    """(request_id, spec_uid, kind): narratives and general knowledge of the given specs; a spec with neither has its
    classification."""
    own = requests.select("request_id", F.explode("spec_uids").alias("spec_uid")).distinct().join(collections.select("spec_uid", "kind").distinct(), "spec_uid")
    preferred = F.col("kind").isin("narrative_classification", "general_knowledge")
    has = F.max(preferred).over(Window.partitionBy("request_id", "spec_uid"))
    return own.withColumn("_has", has).where(preferred | (~F.col("_has") & (F.col("kind") == "classification"))).select("request_id", "spec_uid", "kind")


def merge_candidates(candidates: DataFrame, keep: int = KEPT, key: str = "text") -> DataFrame:
    """(request_id, source, ...) with rk: candidates once per request, source and key, best score first, equal ones by id."""
    order = Window.partitionBy("request_id", "source", key).orderBy(F.desc("score"), "id")
    once = candidates.withColumn("_d", F.row_number().over(order)).where("_d = 1").drop("_d")
    rank = F.row_number().over(Window.partitionBy("request_id", "source").orderBy(F.desc("score"), "id"))
    return once.withColumn("rk", rank).where(F.col("rk") <= keep)


def number_candidates(candidates: DataFrame, sources: tuple[str, ...] = ("bm25", "vector")) -> DataFrame:
    """Adds number: candidates of a request counted over its sources in order."""
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    return candidates.withColumn("number", F.row_number().over(Window.partitionBy("request_id").orderBy(place, "rk")))


def fuse(candidates: DataFrame) -> DataFrame:
    """(request_id, row_no, score): the candidate row with the largest sum of 1 / (60 + rank) over its sources."""
    by_source = candidates.groupBy("request_id", "row_no", "source").agg(F.min("rk").alias("rk"))
    summed = by_source.groupBy("request_id", "row_no").agg(F.round(F.sum(1.0 / (FUSION + F.col("rk"))), 6).alias("score"))
    return summed.withColumn("_rk", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "row_no"))).where("_rk = 1").drop("_rk")


def table_sentence(requests: DataFrame, long: bool = True) -> Column:
    """What a request asks for as text: comment or name and fields, and in the long form also its labelled parts."""
    clean = lambda c: remove_annotations(F.coalesce(c, F.lit("")))
    fields = F.transform("fields", lambda f: F.coalesce(F.nullif(clean(f["fieldComment"]), F.lit("")), f["fieldName"]))
    name = F.coalesce(F.nullif(clean(F.col("tableComment")), F.lit("")), F.col("tableName"))
    short = F.concat_ws(",", name, F.filter(fields, lambda x: x != ""))
    if not long:
        return short
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}:"), F.col(c)))
    labels = (("database", "dbName"), ("schema", "schemaName"), ("system", "systemName"), ("type", "systemType"))
    return F.concat_ws(",", *[part(label, c) for label, c in labels if c in requests.columns], short)


def file_sentence(name: Column, system: Column, shown: Column) -> Column:
    """What a file asks for as text: its system and name, labelled, and what its outline or head shows."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}:"), c))
    return F.concat_ws("\n", part("system", system), part("file", name), F.nullif(F.coalesce(shown, F.lit("")), F.lit("")))


def prompts(candidates: DataFrame, requests: DataFrame, sentence: Column, instruction: str) -> DataFrame:
    """(request_id, prompt): an instruction, what is asked, and the numbered candidates in order."""
    listed = candidates.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: F.concat_ws(". ", x["number"], x["text"])), "\n").alias("_c"))
    asked = requests.select("request_id", sentence.alias("_q"))
    return asked.join(listed, "request_id", "left").select("request_id", F.concat(F.lit(instruction), F.lit("\n\nSubject:\n"), "_q", F.lit("\n\nCandidates:\n"), F.coalesce("_c", F.lit("")), F.lit('\n\nAnswer "number,reason"; -1 if none fits.')).alias("prompt"))


def choose(candidates: DataFrame, prompted: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
    """(request_id, row_no, reason): by the scorer's reply to each prompt, else by rank fusion. No row if nothing fits."""
    if scorer is None:
        return fuse(candidates).select("request_id", "row_no", F.concat(F.lit("rank fusion "), F.col("score").cast("string")).alias("reason"))
    replied = score_prompts(prompted, scorer).select("request_id", parse_choice(F.col("reply")).alias("c"))
    numbered = candidates.select("request_id", F.col("number").alias("_n"), "row_no")
    return replied.join(numbered, "request_id").where("c.index = _n").select("request_id", "row_no", F.col("c.rest").alias("reason"))


def resolve(chosen: DataFrame, tax: DataFrame, highest: bool = True) -> DataFrame:
    """(request_id, row_no, category, grade, elements, reason) of chosen rows."""
    own = tax.select("row_no", deepest(F.col("path")).alias("category"), choose_grade(F.col("grade"), highest).alias("grade"), "elements")
    return chosen.join(own, "row_no").select("request_id", "row_no", "category", "grade", "elements", "reason")


def map_fields(requests: DataFrame, resolved: DataFrame, least: float = 0.3) -> DataFrame:
    """(request_id, field_no, element, score): of each field the element of the request's category that its comment, or else
    its name, resembles most, if that reaches ``least``; the first of equals.

    A category's elements make one suffix automaton, past which the distinct texts of its fields go.
    """
    fields = requests.select("request_id", F.posexplode("fields").alias("field_no", "f")).select("request_id", "field_no", F.coalesce(F.nullif(F.col("f.fieldComment"), F.lit("")), F.col("f.fieldName")).alias("text"))
    asked = fields.where("text IS NOT NULL").join(resolved.select("request_id", "row_no"), "request_id")
    texts = asked.select("row_no", "text").distinct().withColumn("clean", clean_name(F.col("text")))
    rows = resolved.groupBy("row_no").agg(F.first("elements").alias("elements"))
    elements = rows.select("row_no", F.posexplode("elements").alias("element_no", "name")).where("name <> ''").withColumn("clean", clean_name(F.col("name")))
    best = meet(elements, texts, "row_no", F.col("text"), _element_names, _most_alike(least), "text string, element string, score double")
    return asked.join(best, ["row_no", "text"]).select("request_id", "field_no", "element", "score")


def _element_names(rows: list[tuple]) -> tuple[list[tuple[str, str]], dict[str, int], dict[str, int], SuffixAutomaton]:
    """The distinct elements in order, the first by name and by clean name, and their automaton."""
    once = {name: clean for _, name, clean in sorted(rows, reverse=True)}
    names = [(name, once[name]) for name in dict.fromkeys(name for _, name, _ in sorted(rows))]
    by_name = {name: k for k, (name, _) in enumerate(names)}
    by_clean = {clean: k for k, (_, clean) in reversed(list(enumerate(names)))}
    return names, by_name, by_clean, SuffixAutomaton([name for name, _ in names])


def _rounded(x: float) -> float:
    """Six places, halves up, as Spark rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def _most_alike(least: float) -> Callable[..., Iterator[tuple[str, str, float]]]:
    def answer(ready: tuple, row: tuple) -> Iterator[tuple[str, str, float]]:
        (names, by_name, by_clean, automaton), (text, clean) = ready, row
        if text in by_name:
            best = 1.0, -by_name[text]
        elif clean in by_clean:
            best = 0.95, -by_clean[clean]
        else:
            # a score is no larger than the share of the text that is common; scores are rounded
            best = 0.0, -len(names)
            for k, size in automaton.common(text, (1 << len(names)) - 1, least):
                if size / len(text) < best[0] - 1e-6:
                    break
                best = max(best, (_rounded(size / max(len(text), len(names[k][0]))), -k))
        if best[0] >= least and -best[1] < len(names):
            yield text, names[-best[1]][0], best[0]

    return answer


def scored_names_of(pairs: DataFrame) -> DataFrame:
    """pairs (text, name) with their name similarity as score."""
    from ..functions.similarity import name_similarity

    distinct = pairs.select("text", "name").distinct().withColumn("score", F.round(name_similarity(F.col("text"), F.col("name")), 6))
    return pairs.join(distinct, ["text", "name"])


def recognized(requests: DataFrame, resolved: DataFrame, mapped: DataFrame) -> DataFrame:
    """Requests with category, grade, reason and fields, each field with its element; a request without a category has no fields."""
    fields = mapped.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("field_no", "element", "score"))).alias("fieldElements"))
    return requests.join(resolved.drop("elements"), "request_id", "left").join(fields, "request_id", "left")


def classify_fields(requests: DataFrame, tax: DataFrame, candidates: DataFrame, least: float = 0.3) -> DataFrame:
    """(request_id, field_no, row_no, score): fields straight to the request's candidate rows by the names of their categories."""
    fields = requests.select("request_id", F.posexplode("fields").alias("field_no", "f")).select("request_id", "field_no", F.coalesce(F.nullif(F.col("f.fieldComment"), F.lit("")), F.col("f.fieldName")).alias("text"))
    rows = candidates.select("request_id", "row_no").distinct().join(tax.select("row_no", deepest(F.col("path")).alias("name")), "row_no")
    scored = scored_names_of(fields.join(rows, "request_id")).where(F.col("score") >= least)
    return scored.withColumn("_rk", F.row_number().over(Window.partitionBy("request_id", "field_no").orderBy(F.desc("score"), "row_no"))).where("_rk = 1").select("request_id", "field_no", "row_no", "score")
