"""Prompts, plans and answers as text and JSON files; tables as Parquet and CSV."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import json_span, length_in_path, plan_name, type_in_name
from tidemark.sources.array_files import read_npz, write_npz
from tidemark.sources.named_files import read_named, write_named

__all__ = ["read_npz", "write_npz"]

#: The time in an answer file's name.
STAMP, STAMP_FORMAT = r"\d{8}-\d{6}-\d{6}", "yyyyMMdd-HHmmss-SSSSSS"


def file_name(text: Column) -> Column:
    """A name as part of a path: only the separator and the sign that escapes it are written otherwise."""
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def name_in_file(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%"))


def whole_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, stem, text), one row per file below ``folder``; the path is relative to it."""
    found = read_named(spark, folder, pattern).select(F.col("name").alias("path"), F.col("content").alias("text"))
    return found.withColumn("stem", name_in_file(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)))


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt files with their type and T by name; those without a type or a text are left out."""
    t = length_in_path(F.concat_ws("/", F.lit(folder), "path"))
    found = whole_files(spark, folder, "*.txt").withColumns({"anomaly_type": type_in_name(F.col("stem")), "T": t})
    return found.filter("trim(text) != '' AND anomaly_type IS NOT NULL")


def by_number(prompts: DataFrame) -> DataFrame:
    """Numbered files by number, then the others by name."""
    number = F.col("stem").try_cast("int")
    return prompts.orderBy(number.isNull(), number, "stem")


def stamp_of(stem: Column) -> Column:
    """The time in the name of a plan or answer file; null without one."""
    text = F.nullif(F.regexp_extract(stem, rf"_({STAMP})$", 1), F.lit(""))
    return F.try_to_timestamp(text, F.lit(STAMP_FORMAT)).cast("timestamp_ntz")


def read_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Plan files: (ROUTE_ID, anomaly_type, T, K, scores, scored_at, path). Files that are no plan are left out; A3 plans need no K."""
    found = whole_files(spark, folder, "*.json")
    route, kind = plan_name(F.regexp_replace("stem", "^.*?(?=route_)", ""))
    v = F.try_parse_json(json_span(F.col("text")))
    get = lambda path, type_: F.try_variant_get(v, path, type_)
    plans = found.select(
        route.alias("ROUTE_ID"),
        F.coalesce(get("$.anomaly_type", "string"), kind).alias("anomaly_type"),
        get("$.T", "int").alias("T"),
        get("$.K", "int").alias("K"),
        get("$.scores", "array<double>").alias("scores"),
        stamp_of(F.col("stem")).alias("scored_at"),
        "path",
    )
    return plans.filter("ROUTE_ID IS NOT NULL AND scores IS NOT NULL AND (anomaly_type = 'A3' OR K IS NOT NULL)")


def first_with_plans(spark: SparkSession, folders: list[str]) -> DataFrame | None:
    """The plans of the first folder that has any."""
    from tidemark.sources.ais import existing

    for folder in existing(spark, folders):
        plans = read_plans(spark, folder)
        if not plans.isEmpty():
            return plans
    return None


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Written as Parquet and read back."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path) if by else df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_prompt_files(prompts: DataFrame, folder: str) -> None:
    """A text file for each prompt, ``route_sliced_{T}/user_query/route_{ROUTE_ID}_{type}.txt``; without T right in the folder."""
    base = F.concat(F.lit("route_"), file_name(F.col("ROUTE_ID")), F.lit("_"), "anomaly_type", F.lit(".txt"))
    name = F.concat(F.lit("route_sliced_"), F.col("T").cast("string"), F.lit("/user_query/"), base) if "T" in prompts.columns else base
    write_named(prompts.select(F.coalesce(name, base).alias("name"), F.col("prompt").alias("content")), folder)


def answer_file(answer: str | None) -> str:
    """An answer's JSON object, indented; the whole answer and what is wrong with it where there is no object."""
    text = answer or ""
    first, last = text.find("{"), text.rfind("}")
    try:
        held = json.loads(text[first : last + 1]) if -1 < first < last else None
        fault = "no JSON object"
    except ValueError as e:
        held, fault = None, str(e)
    if held is None:
        held = {"parse_error": fault, "raw_output": text}
    return json.dumps(held, indent=2, ensure_ascii=False) + "\n"


def write_answer_files(answers: DataFrame, folder: str, prefix: str = "answer") -> None:
    """A file for each of (source_name or ROUTE_ID and anomaly_type, scored_at, answer): ``{prefix}_{source}_{time}.json``. Files that are there stay."""
    source = F.col("source_name") if "source_name" in answers.columns else F.concat(F.lit("route_"), "ROUTE_ID", F.lit("_"), "anomaly_type")
    name = F.concat(F.lit(f"{prefix}_"), file_name(source), F.lit("_"), F.date_format("scored_at", STAMP_FORMAT), F.lit(".json"))

    @F.pandas_udf("string")
    def content(texts: pd.Series) -> pd.Series:
        return texts.map(answer_file)

    write_named(answers.select(name.alias("name"), content("answer").alias("content")), folder, replace=False)


def source_of(stem: Column, prefix: str) -> Column:
    """What an answer file was the answer to; null for names of another make."""
    import re

    return F.nullif(F.regexp_extract(stem, rf"^{re.escape(prefix)}_(.+)_{STAMP}$", 1), F.lit(""))


def read_answers(spark: SparkSession, folder: str, prefix: str = "answer") -> DataFrame:
    """(path, source_name, scored_at, answer) of the answer files with a prefix; of a file that holds a refused answer that answer itself."""
    found = whole_files(spark, folder, f"{prefix}_*.json")
    raw = F.try_variant_get(F.try_parse_json("text"), "$.raw_output", "string")
    return found.select("path", source_of(F.col("stem"), prefix).alias("source_name"), stamp_of(F.col("stem")).alias("scored_at"), F.coalesce(raw, "text").alias("answer"))
