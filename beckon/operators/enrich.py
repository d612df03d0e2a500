"""Voice transcripts and image analyses joined to messages; media indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon.functions.match import filled, stripped

MEDIA = {"image": "image_id", "voice": "voice_note_id"}


def with_transcripts(messages: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Use the transcript as text of voice messages that have none.

    Adds ``transcript_used``.  ``transcripts``: ``message_id, transcript``.
    """
    use = (f"media_type <=> 'voice' AND {stripped(filled('message_text'))} = '' "
           f"AND {filled('transcript')} != ''")
    return messages.join(transcripts, "message_id", "left").withColumn(
        "transcript_used", F.expr(use)).withColumn(
        "message_text", F.when(F.col("transcript_used"), F.col("transcript"))
        .otherwise(F.col("message_text"))).drop("transcript")


def with_image_analyses(messages: DataFrame, analyses: DataFrame) -> DataFrame:
    """Add the four image columns, NULL where no analysis exists.

    Adds ``image_enriched``.  ``analyses``: ``message_id, analysis`` (a struct).
    """
    seen = (F.col("media_type") == "image") & F.col("analysis").isNotNull()

    def field(name: str, default):
        return F.when(seen, F.coalesce(F.col(f"analysis.{name}"), F.lit(default)))

    return messages.join(analyses, "message_id", "left").withColumns({
        "image_urgency": field("urgency", "low"),
        "image_category": field("category", "unknown"),
        "image_extracted_text": field("extracted_text", ""),
        "image_has_deadline": field("has_deadline", False),
        "image_enriched": F.coalesce(seen, F.lit(False)),
    }).drop("analysis")


def enrich(messages: DataFrame, transcripts: DataFrame, analyses: DataFrame) -> DataFrame:
    """Both enrichments."""
    return with_image_analyses(with_transcripts(messages, transcripts), analyses)


def enrichment_counters(enriched: DataFrame, transcripts: DataFrame,
                        analyses: DataFrame) -> DataFrame:
    """Rows ``counter, n``: artefacts loaded and messages changed."""
    loaded = transcripts.agg(F.count_if(F.coalesce("transcript", F.lit("")) != "")).toDF("n")
    analysed = analyses.agg(F.count("analysis")).toDF("n")
    changed = enriched.agg(F.count_if("transcript_used").alias("transcripts_used"),
                           F.count_if("image_enriched").alias("images_enriched"))
    return (loaded.select(F.lit("transcripts_loaded").alias("counter"), "n")
            .unionAll(analysed.select(F.lit("analyses_loaded").alias("counter"), "n"))
            .unionAll(changed.unpivot([], ["transcripts_used", "images_enriched"],
                                      "counter", "n")))


def with_media_path(messages: DataFrame, images: DataFrame, voice_notes: DataFrame,
                    root: str = "dataset") -> DataFrame:
    """Add ``media_path``, NULL for messages without a known media file."""
    index = (images.select(F.lit("image").alias("media_type"), F.col("image_id").alias("media_id"),
                           "file_path")
             .unionAll(voice_notes.select(
                 F.lit("voice"), F.col("voice_note_id"), F.col("file_path"))))
    return messages.join(index, ["media_type", "media_id"], "left").withColumn(
        "media_path", F.when(F.col("file_path").isNotNull(),
                             F.concat_ws("/", F.lit(root), F.col("file_path")))).drop("file_path")


def media_owner(messages: DataFrame, media_type: str) -> DataFrame:
    """The last message per media id of one media type: ``media_id, message_id``."""
    named = messages.where((F.col("media_type") == media_type)
                           & F.expr(f"trim({filled('media_id')}) != ''"))
    return named.groupBy(F.trim("media_id").alias("media_id")).agg(
        F.max_by("message_id", F.struct("created_at", "message_id")).alias("message_id"))


def extract_media(df: DataFrame, function, media_type: str) -> DataFrame:
    """Run a user-supplied extractor over media rows, batch by batch.

    ``function`` takes an iterator of pandas frames and yields frames in the
    fixed layout of the media type.
    """
    return df.where(F.col("media_type") == media_type).mapInPandas(
        function, MEDIA_SCHEMAS[media_type])


# --- fixed values: output layout of media extractors ----------------------
MEDIA_SCHEMAS = {
    "image": ("message_id string, image_type string, image_urgency string, "
              "image_content string, image_suspicious boolean, image_has_text boolean, "
              "image_text_content string"),
    "voice": ("message_id string, voice_duration double, voice_language string, "
              "voice_text string, voice_confidence double"),
}
