"""Steps that a model may score: a typed hook for callables, and native defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import stored

Scorer = Callable[[list[str]], list[str]]


def score_prompts(df: DataFrame, scorer: Scorer, prompt: str = "prompt") -> DataFrame:
    """df with reply and error. The callable gets the prompts of an Arrow batch and gives as many replies; if a batch fails,
    its prompts are tried one by one and each failure is that row's error. Concurrency is the number of partitions."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("reply", StringType()), StructField("error", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            prompts = pdf[prompt].tolist()
            try:
                replies: list[str | None] = list(scorer(prompts))
                errors: list[str | None] = [None] * len(prompts)
                if len(replies) != len(prompts):
                    raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
            except Exception:
                replies, errors = [], []
                for p in prompts:
                    try:
                        (reply,) = scorer([p])
                        replies.append(reply)
                        errors.append(None)
                    except Exception as e:
                        replies.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(reply=replies, error=errors)

    return df.mapInPandas(run, schema)


def score_resumably(df: DataFrame, scorer: Scorer, store: str, prompt: str = "prompt", batch: int = 2000, tries: int = 3) -> DataFrame:
    """df with reply and error, where what was answered once is not asked again.

    Replies are kept in ``store`` by the prompt's digest. Distinct prompts without one are asked in batches of about so many, each
    kept as it is done, so a job that is stopped and started again goes on behind its last batch. Prompts that fail are asked
    anew, ``tries`` times in all, and then have the last error. A null prompt has neither.
    """
    spark = df.sparkSession
    key = F.sha2(F.col(prompt).cast("binary"), 256)
    left = df.where(F.col(prompt).isNotNull()).select(key.alias("digest"), F.col(prompt).alias("prompt")).dropDuplicates(["digest"])

    def kept() -> DataFrame:
        try:
            return spark.read.schema("digest string, reply string").parquet(store)
        except AnalysisException:
            return spark.createDataFrame([], "digest string, reply string")

    errors = None
    for _ in range(tries):
        # texts are written once, for what is asked; a further try takes what is left of that
        left = stored(left.join(kept().select("digest"), "digest", "left_anti"))
        n = left.count()
        if not n:
            break
        batches = -(-n // batch)
        part = F.pmod(F.xxhash64("digest"), F.lit(batches))
        failed = []
        for i in range(batches):
            answered = stored(score_prompts(left.where(part == i), scorer).select("digest", "reply", "error"))
            answered.where("error IS NULL").select("digest", "reply").dropDuplicates(["digest"]).write.mode("append").parquet(store)
            failed.append(answered)
        errors = failed[0]
        for more in failed[1:]:
            errors = errors.union(more)
        errors = errors.where("error IS NOT NULL").select("digest", "error")
    replies = kept().groupBy("digest").agg(F.min("reply").alias("reply"))
    told = df.withColumn("_digest", key).join(replies.withColumnRenamed("digest", "_digest"), "_digest", "left")
    if errors is None:
        return told.withColumn("error", F.lit(None).cast("string")).drop("_digest")
    last = errors.select(F.col("digest").alias("_digest"), F.col("error").alias("_error"))
    return told.join(last, "_digest", "left").withColumn("error", F.when(F.col("reply").isNull(), F.col("_error"))).drop("_digest", "_error")


def document_class(text: Column) -> Column:
    """"2" for data-shaped text: half of its lines are records (JSON, or three fields or more between delimiters), or its
    sentences are short and it has many lines; else "1", narrative."""
    rows = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    record = lambda x: strip(x).rlike(r"^[\[{].*[\]}],?$") | (F.size(F.split(x, r"[|\t;]")) >= 3)
    share = F.size(F.filter(rows, record)) / F.greatest(F.lit(1), F.size(rows))
    sentence = F.length(text) / F.greatest(F.lit(1), F.size(F.split(text, r"[.!?。！？]")))
    return F.when((share >= 0.5) | ((sentence < 12) & (F.size(rows) >= 5)), F.lit("2")).otherwise(F.lit("1"))
