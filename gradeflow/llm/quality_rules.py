"""Quality rules, native: text statistics as Spark expressions, and a decision list learned from labelled statistics.

The list comes from sequential covering: a rule for low quality grows one threshold at a time by information gain (FOIL) on
the growing part, is pruned back on the other part, and joins the list if it is precise enough there; covered rows leave and
the next rule is grown. There is no limit on rules or on the thresholds of one: growing ends where no threshold gains, the list
where the next rule isn't good enough.

Labelled rows are counted by cell of a fixed grid of quantile borders, a Spark table. Each growing step is one aggregate over
the cells that still match: of every feature the counts below each border, 7 x 13 x 2 sums, are all that reach the driver. The
list becomes an ordered ``when`` chain, and no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, text_of, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: What rules may test; all are shares or means, so that a rule means the same for short and long texts.
FEATURES = ("word_length", "symbol_share", "repeat_share", "dup_line_share", "distinct_share", "upper_share", "stop_share")
#: Borders for each feature.
BORDERS = 12
#: The share of low quality among the rows that a rule covers, on both parts; and its lower bound at 95 % on the pruning part,
#: which a rule reaches with 5 rows or more, whatever the size of the table.
LEAST_PRECISION, LEAST_BOUND = 0.9, 0.6


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, also where body uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words within windows of WINDOW words that occur twice or more in the text, the first occurrence too.

    Windows are compared by a 64-bit hash of their words. Only texts in which some window repeats are sorted.
    """

    def of_windows(hashes: Column) -> Column:
        def counted(ordered: Column) -> Column:
            same = lambda x, i, step: F.coalesce(F.get(ordered, i + step)["h"] == x["h"], F.lit(False))
            twice = F.filter(ordered, lambda x, i: same(x, i, -1) | same(x, i, 1))
            return _let(
                F.sort_array(F.transform(twice, lambda x: x["i"])),
                lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b),
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), counted))

    # hashes of 1, 2, 4 and 8 words: each from two of half its length; the last seven start no whole window
    hashes = lambda step, body: lambda h: _let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))), body)
    whole = lambda h: _let(F.slice(h, F.lit(1), F.size(h) - (WINDOW - 1)), of_windows)
    windows = _let(F.transform(words, lambda w: F.xxhash64(w)), hashes(1, hashes(2, hashes(4, whole))))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(windows).cast("long")


def statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the features, of every row.

    Words are maximal runs of characters other than ASCII white space; a null or empty text has none, and its shares are 0.
    """
    words = F.filter(F.split("_t", f"[{SPACES}]+"), lambda w: w != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("_t"))
    counted = base.select(
        "doc_id",
        _let(
            words,
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct"), F.size(F.filter(w, lambda x: F.length(x) <= 3)).alias("n_short")),
        ).alias("w"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.select(
        "doc_id",
        F.col("w.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.n_dup_lines").alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        share("word_chars", "w.n_words").alias("word_length"),
        share("n_symbols", "w.n_words").alias("symbol_share"),
        share("w.n_repeat_words", "w.n_words").alias("repeat_share"),
        share("l.n_dup_lines", "l.n_lines").alias("dup_line_share"),
        # a text's share of different words falls with its length, so against the root of its words
        F.when(F.col("w.n_words") > 0, F.col("w.n_distinct") / F.pow(F.col("w.n_words"), 0.75)).otherwise(F.lit(0.0)).alias("distinct_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("w.n_short", "w.n_words").alias("stop_share"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    border: float

    def column(self) -> Column:
        return F.col(self.feature) > self.border if self.above else F.col(self.feature) <= self.border

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.border:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    keep: bool = False

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out &= c.column()
        return out

    def __str__(self) -> str:
        return f"{' and '.join(map(str, self.conditions))}: {'keep' if self.keep else 'drop'}"


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """An ordered conditional: the first rule that fires decides, and what none covers is kept."""
    out = None
    for rule in rules:
        out = (F if out is None else out).when(rule.column(), F.lit(rule.keep))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


_Test = tuple[int, bool, int]  # feature, above, border


def _matches(tests: list[_Test]) -> Column:
    out = F.lit(True)
    for f, above, k in tests:
        out &= (F.col(FEATURES[f]) > k) if above else (F.col(FEATURES[f]) <= k)
    return out


def _best_test(cells: DataFrame, n_borders: list[int]) -> _Test | None:
    """The threshold of most information gain over cells (a bin for each feature, low, high); of equal ones the first."""
    bins = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(name).alias("k")) for f, name in enumerate(FEATURES)])).alias("b")
    sums = cells.select(bins, "low", "high").groupBy("b.f", "b.k").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    counts = {(r["f"], r["k"]): (r["low"], r["high"]) for r in sums.collect()}
    p0, n0 = (sum(x[i] for (f, _), x in counts.items() if f == 0) for i in (0, 1))
    if not p0 or not n0:
        return None
    best, found = 1e-9, None
    for f, borders in enumerate(n_borders):
        p = n = 0
        for k in range(borders):
            low, high = counts.get((f, k), (0, 0))
            p, n = p + low, n + high
            for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                if a and (gain := a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0)))) > best:
                    best, found = gain, (f, above, k)
    return found


def _beginnings(cells: DataFrame, tests: list[_Test]) -> list[tuple[int, int, int, int]]:
    """For each beginning of a rule: low and high rows that it covers, of the growing part and of the pruning part."""
    sums = []
    for i in range(1, len(tests) + 1):
        for j, part in enumerate((F.col("grow"), ~F.col("grow"))):
            for k, n in enumerate(("low", "high")):
                sums.append(F.coalesce(F.sum(F.when(part & _matches(tests[:i]), F.col(n))), F.lit(0)).alias(f"s{i}_{j}_{k}"))
    r = cells.agg(*sums).first()
    return [tuple(r[f"s{i}_{j}_{k}"] for j in (0, 1) for k in (0, 1)) for i in range(1, len(tests) + 1)]


def least_share(low: int, high: int, z: float = 1.645) -> float:
    """The lower end of Wilson's interval for the share of low among low + high."""
    n = low + high
    if not n:
        return 0.0
    p = low / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def cover(cells: DataFrame, borders: list[list[float]], precision: float = LEAST_PRECISION, bound: float = LEAST_BOUND) -> list[Rule]:
    """Sequential covering of the low-quality rows by rules of at least the given precision.

    cells: the bin of each feature (borders below the value), grow, low and high.
    """
    rules: list[Rule] = []
    while True:
        tests: list[_Test] = []
        while found := _best_test(cells.where(F.col("grow") & _matches(tests)), [len(b) for b in borders]):
            tests.append(found)
        if not tests:
            return rules
        counts = _beginnings(cells, tests)
        worth = [((p - n) / (p + n) if p + n else -1.0, -i) for i, (_, _, p, n) in enumerate(counts)]
        size = 1 - max(worth)[1]
        tests, (low, high, p, n) = tests[:size], counts[size - 1]
        if low + p < precision * (low + high + p + n) or p < precision * (p + n) or least_share(p, n) < bound:
            return rules
        rules.append(Rule(tuple(Condition(FEATURES[f], above, borders[f][k]) for f, above, k in tests)))
        cells = cells.where(~_matches(tests))


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list from rows of ``stats`` whose quality label is 0 or 1 and which the base rules leave.

    Every labelled row counts; an id with both labels has the low one. Borders are quantiles of each feature over those rows
    (of the high and of the low ones); a third of the rows, by a hash of the id, prunes. Without labels of both kinds the
    list is empty.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)").groupBy("_id").agg(F.min("quality").alias("quality"))
    rows = written(stats.where(~base_failed()).join(known, F.col("doc_id") == F.col("_id")).select("quality", (fold(F.col("_id"), 3) != 0).alias("grow"), *FEATURES))
    shares = [i / (BORDERS // 2 + 1) for i in range(1, BORDERS // 2 + 1)]
    found = rows.agg(*[F.percentile_approx(F.when(F.col("quality") == q, F.col(f)), shares, 1000).alias(f"{f}_{q}") for f in FEATURES for q in (0, 1)]).first()
    if any(found[f"{f}_{q}"] is None for f in FEATURES for q in (0, 1)):
        return []
    borders = [sorted({*found[f"{f}_0"], *found[f"{f}_1"]}) for f in FEATURES]
    bins = [sum(((F.col(f) > b).cast("int") for b in own), F.lit(0)).alias(f) for f, own in zip(FEATURES, borders)]
    cells = rows.select("quality", "grow", *bins).groupBy("grow", *FEATURES).agg(F.sum(1 - F.col("quality")).alias("low"), F.sum("quality").alias("high"))
    return cover(written(cells), borders)


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """stats with base_failed and kept."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
