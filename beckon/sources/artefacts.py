"""Transcripts, image analyses and raw model responses kept as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


ANALYSIS = ("struct<urgency:string,category:string,has_deadline:boolean,"
            "extracted_text:string,reason:string>")
# the flag is read as text: responses hold true, "true", 1 and the like
RESPONSE = ("urgency string, category string, has_deadline string, extracted_text string, "
            "reason string, _corrupt_record string")
# fixed value: reason of a response that holds no object
RAW_REASON = "Raw response from vision model"


def json_objects(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """One JSON object per row: one per line, or a whole file, which one task reads.

    A path that does not exist gives no rows.
    """
    try:
        return spark.read.text(path, wholetext=whole_file)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], "value string")
        raise


def transcripts(objects: DataFrame) -> DataFrame:
    """``message_id, transcript`` from objects ``{message id: text or null}``."""
    return objects.select(F.explode(F.from_json("value", "map<string,string>"))).toDF(
        "message_id", "transcript")


def analyses(objects: DataFrame) -> DataFrame:
    """``message_id, analysis`` from objects ``{message id: analysis}``."""
    return objects.select(F.explode(F.from_json("value", f"map<string,{ANALYSIS}>"))).toDF(
        "message_id", "analysis")


def _object_text(response: Column) -> Column:
    return F.regexp_extract(response, r"(?s)\{.*\}", 0)


def parse_responses(df: DataFrame, response_col: str) -> DataFrame:
    """Read model responses: bare JSON, JSON in code fences, or plain text.

    Adds ``urgency, category, has_deadline, extracted_text, reason`` and
    ``parsed``.  Plain text is kept as ``extracted_text``.
    """
    raw = F.coalesce(response_col, F.lit(""))
    parsed = F.from_json(_object_text(raw), RESPONSE,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    field = lambda name: F.col(f"_json.{name}")
    ok = F.col("parsed")
    truthy = ~F.lower(F.coalesce(field("has_deadline"), F.lit("false"))).isin("false", "0", "")
    staged = df.withColumn("_json", parsed).withColumn("parsed", F.coalesce(
        F.col("_json").isNotNull() & field("_corrupt_record").isNull()
        & (_object_text(raw) != ""), F.lit(False)))
    return staged.withColumns({
        "urgency": F.when(ok, F.lower(F.coalesce(field("urgency"), F.lit("low"))))
        .otherwise(F.lit("unknown")),
        "category": F.when(ok, F.lower(F.coalesce(field("category"), F.lit("unknown"))))
        .otherwise(F.lit("unknown")),
        "has_deadline": F.when(ok, truthy).otherwise(F.lit(False)),
        "extracted_text": F.when(ok, F.coalesce(field("extracted_text"), F.lit(""))).otherwise(raw),
        "reason": F.when(ok, F.coalesce(field("reason"), F.lit(""))).otherwise(F.lit(RAW_REASON)),
    }).drop("_json")


def media_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Media files as ``path, modificationTime, length, content``."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern).load(path))


def write_json(df: DataFrame, path: str) -> None:
    """JSON objects, one per row in ``value``, as lines."""
    df.select("value").write.mode("overwrite").text(path)
