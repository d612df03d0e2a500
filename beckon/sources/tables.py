"""Declared schemas, readers and writers of the message tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

MESSAGE = ("message_id string, user_id string, conversation_type string, group_id string, "
           "business_id string, sender_user_id string, created_at timestamp, "
           "message_text string, media_type string, media_id string, forwarded_count int")

# --- fixed values: file and column layout of the input tables --------------
SCHEMAS = {
    "messages": MESSAGE,
    "sample_messages": MESSAGE + (
        ", action string, message_type string, reason string, confidence double, "
        "evidence_message_ids string"),
    "message_history": (
        "message_id string, user_id string, sender_user_id string, group_id string, "
        "business_id string, conversation_type string, created_at timestamp, "
        "message_text string"),
    "users": ("user_id string, do_not_disturb_window string, messages_opened_30d int, "
              "messages_replied_30d int, notifications_dismissed_30d int, "
              "messages_reported_30d int"),
    "groups": ("group_id string, group_name string, group_type string, member_count int, "
               "admin_count int, created_at date, messages_30d int"),
    "business_accounts": (
        "business_id string, display_name string, brand_name string, category string, "
        "verified int, official_domain string, domain_used_by_sender string, "
        "account_age_days int, messages_sent_30d int, user_reports_30d int, "
        "domain_used_by_sender_age_days int"),
    "message_events": (
        "user_id string, message_id string, message_opened int, message_replied int, "
        "reaction_time_minutes int, notification_dismissed int, muted_after_message int, "
        "message_reported int"),
    "images": "image_id string, file_path string",
    "voice_notes": "voice_note_id string, file_path string",
    "group_members": (
        "group_id string, user_id string, role string, joined_at date, "
        "messages_sent_30d int, messages_read_30d int, replies_sent_30d int, "
        "notifications_dismissed_30d int, group_muted_by_user int"),
    "user_business_history": (
        "user_id string, business_id string, why_user_knows_account string, "
        "last_activity_at timestamp, allows_promotions int, "
        "promotions_opted_out_at timestamp, activity_count_180d int, "
        "messages_opened_30d int, messages_dismissed_30d int, messages_replied_30d int, "
        "last_reply_at timestamp"),
    "daily_notification_summary": (
        "user_id string, date date, notifications_sent int, notifications_dismissed int"),
    "output": ("message_id string, action string, message_type string, reason string, "
               "confidence double, evidence_message_ids string"),
}
OUTPUT_COLUMNS = ["message_id", "action", "message_type", "reason", "confidence",
                  "evidence_message_ids"]
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}

# Spark's writer cuts blanks at both ends of a text unless told not to.
CSV_WRITE_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "timestampFormat": "yyyy-MM-dd HH:mm",
                     "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def spark_schema(name: str) -> StructType:
    """The declared schema of a table."""
    return StructType.fromDDL(SCHEMAS[name])


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "csv",
               missing_ok: bool = False) -> DataFrame:
    """A named table with its declared schema, never inferred.

    CSV texts span lines inside quotes.  Such a file cannot be split, so large
    tables should be kept as parquet, which is read with the same schema.
    ``missing_ok`` gives an empty table where the file does not exist.
    """
    schema = SCHEMAS[name]
    reader = spark.read.schema(schema)
    try:
        if fmt == "csv":
            return reader.options(timestampFormat="yyyy-MM-dd HH:mm", **CSV_OPTIONS).csv(
                f"{folder}/{name}.csv")
        return reader.format(fmt).load(f"{folder}/{name}.{fmt}")
    except AnalysisException as error:
        if missing_ok and "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def stream_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet",
                 **options: str) -> DataFrame:
    """The same table as a stream of files dropped into a folder."""
    reader = spark.readStream.schema(SCHEMAS[name]).options(**options)
    if fmt == "csv":
        reader = reader.options(timestampFormat="yyyy-MM-dd HH:mm", **CSV_OPTIONS)
    return reader.format(fmt).load(folder)


def write_history(history: DataFrame, path: str) -> None:
    """History as parquet by day, so that scans read the days they need."""
    history.withColumn("day", F.to_date("created_at")).write.mode(
        "overwrite").partitionBy("day").parquet(path)


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """A table as CSV that ``read_table`` reads back; empty texts come back as nulls."""
    df.write.options(**CSV_WRITE_OPTIONS).csv(f"{folder}/{name}.csv")


def write_predictions(decided: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Decisions in the fixed column order; CSV gets a header and doubled quotes."""
    writer = decided.select(*OUTPUT_COLUMNS).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.options(**CSV_WRITE_OPTIONS)
    writer.format(fmt).save(path)
