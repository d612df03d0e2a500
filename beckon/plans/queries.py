"""The registered queries: each reads the driver's tables or what is derived from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beckon import lexicons as L
from beckon.functions.match import any_of, filled
from beckon.functions.text import with_text_features
from beckon.operators import boosting
from beckon.operators import enrich as en
from beckon.operators import evidence as ev
from beckon.operators import history as hist
from beckon.operators import model as ml
from beckon.operators import point_in_time as pit
from beckon.operators import reasons, reports, router_model as rm, rules, types, verify
from beckon.operators.consistency import enforce_consistency, identity_key
from beckon.plans import routing, traffic
from beckon.session import scratch_path, staged, where_computed
from beckon.sources import artefacts
from beckon.sources.tables import read_table, spark_schema, write_predictions, write_table
from beckon.streaming import live, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
OUT = ["message_id", "action", "message_type", "reason", "confidence", "evidence_message_ids"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c)
                       for c, kind in df.dtypes])


# --- text features ---------------------------------------------------------

@query
def text_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure of each document: mentions, lengths, links, phones, mails."""
    docs = traffic.spread(traffic.read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return with_text_features(docs, "text", L.TEXT_FEATURES[:9]).drop("text")


@query
def document_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 28 features of each document."""
    docs = traffic.spread(traffic.read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return _rounded(with_text_features(docs, "text").drop("text"))


@query
def conversation_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 28 features of each conversation turn."""
    turns = traffic.spread(traffic.read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text"), "conv_id", "turn")
    return _rounded(with_text_features(turns, "text").drop("text"))


@query
def message_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 28 features of each message."""
    messages = traffic.tables(spark, sf_dir).messages.select("message_id", "message_text")
    return _rounded(with_text_features(messages).drop("message_text"))


@query
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgency, scam and forward words per recipient and conversation type."""
    names = ["urgency_keyword_count", "scam_keyword_count", "forward_indicator_count"]
    messages = traffic.tables(spark, sf_dir).messages.select(
        "user_id", "conversation_type", "message_text")
    return with_text_features(messages, features=names).groupBy(
        "user_id", "conversation_type").agg(*[F.sum(n).alias(n) for n in names])


@query
def spam_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents per language, source and spam score."""
    docs = traffic.spread(traffic.read(spark, sf_dir, "documents").select(
        "lang", "source", "text", "doc_id"), "doc_id")
    scored = with_text_features(docs, "text", ["spam_pattern_score", "caps_word_ratio"])
    return _rounded(scored.groupBy(
        "lang", "source", F.round("spam_pattern_score", 6).alias("score")).agg(
            F.count(F.lit(1)).alias("documents"), F.max("caps_word_ratio").alias("max_caps")))


# --- guard and rules -------------------------------------------------------

@query
def guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe or unsafe, and the path each message takes."""
    messages = traffic.tables(spark, sf_dir).messages.select("message_id", "message_text")
    return rules.with_guard(messages).select(
        "message_id", "is_safe",
        F.when(F.col("is_safe"), F.lit("safe")).otherwise(F.lit("unsafe")).alias("path"))


@query
def business_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of each business account and the messages it sent."""
    t = traffic.tables(spark, sf_dir)
    sent = t.messages.where("business_id IS NOT NULL").groupBy("business_id").agg(
        F.count(F.lit(1)).alias("messages"))
    return rules.business_risk(t.accounts).join(sent, "business_id", "left").select(
        "business_id", "high_risk_business", F.coalesce("messages", F.lit(0)).alias("messages"))


@query
def rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that decides each message, in the output layout."""
    t = traffic.tables(spark, sf_dir)
    return rules.rule_matches(t.messages, t.accounts)


@query
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of messages decided by rules."""
    t = traffic.tables(spark, sf_dir)
    return _rounded(rules.rule_coverage(t.messages, t.accounts))


@query
def rule_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests behind the rules, one column each."""
    t = traffic.tables(spark, sf_dir)
    messages = t.messages.selectExpr(
        "message_id", "conversation_type", f"{filled('message_text')} AS raw",
        f"lower({filled('message_text')}) AS low")
    tests = {
        "has_time": rules.has_time_reference("low"),
        "is_scam": rules.is_scam("low", "conversation_type", "scam_words"),
        "is_spam": rules.is_spam("raw", "raw"),
        "is_chain": any_of("low", L.RULE_CHAIN),
        "is_transactional": any_of("low", L.RULE_TRANSACTIONAL),
        "is_calm": any_of("low", L.RULE_CALM),
    }
    return messages.withColumn("scam_words", F.expr(
        f"bigint({rules.scam_word_hits('low')})")).selectExpr(
            "message_id", "scam_words", *[f"{test} AS {name}" for name, test in tests.items()])


# --- history ---------------------------------------------------------------

@query
def sender_reaction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reactions of each recipient to each sender."""
    t = traffic.tables(spark, sf_dir)
    return hist.sender_stats(t.reactions, t.history)


@query
def user_reaction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, rates and daily load of each user."""
    t = traffic.tables(spark, sf_dir)
    return _rounded(hist.user_stats(t.reactions, t.daily))


def _features(spark: SparkSession, sf_dir: str, *blocks: str) -> DataFrame:
    t = traffic.tables(spark, sf_dir)
    return _rounded(hist.history_features(t.incoming, t.history_tables, list(blocks)))


@query
def sender_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sender features of each incoming message."""
    return _features(spark, sf_dir, "sender")


@query
def user_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement features of each incoming message."""
    return _features(spark, sf_dir, "user")


@query
def category_dismiss_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dismiss rate of the recipient for the conversation type."""
    return _features(spark, sf_dir, "category")


@query
def business_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation of the recipient to the business."""
    return _features(spark, sf_dir, "business")


@query
def group_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role and engagement of the recipient in the group."""
    return _features(spark, sf_dir, "group")


@query
def similar_dismissals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dismissed texts that share three or more words with the message."""
    return _features(spark, sf_dir, "dismissals")


# --- evidence --------------------------------------------------------------

@query
def tfidf_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 most frequent terms of the history with their counts."""
    return ev.vocabulary(traffic.tables(spark, sf_dir).history)


@query
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit TF-IDF weights of all messages, as rows."""
    t = traffic.tables(spark, sf_dir)
    return _rounded(ev.term_weights(t.messages, ev.TfIdf.fit(t.history), spark))


@query
def evidence_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the history searched for each incoming message."""
    t = traffic.tables(spark, sf_dir)
    sizes = staged(ev.scope_sizes(t.history), "scope-sizes")
    return ev.scoped_messages(t.incoming, sizes).select(
        "message_id", "kind", "id", "scope_rows")


@query
def evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best past messages per incoming message."""
    t = traffic.tables(spark, sf_dir)
    top = ev.top_evidence(t.incoming, t.history, ev.TfIdf.fit(t.history))
    return top.select("message_id", F.col("rank").cast("long").alias("rank"), "evidence_id",
                      "score")


@query
def evidence_scope_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the older history that each message searches, its rows and its newest time."""
    t = traffic.tables(spark, sf_dir)
    return ev.scopes_as_of(t.messages, t.history).select("message_id", "kind", "id", "scope_rows", "newest")


@query
def evidence_topk_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three most similar older messages of every message."""
    t = traffic.tables(spark, sf_dir)
    return _rounded(ev.top_evidence(t.messages, t.history, ev.TfIdf.fit(t.history), point_in_time=True))


@query
def evidence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence ids joined by ';', or none."""
    t = traffic.tables(spark, sf_dir)
    top = ev.top_evidence(t.incoming, t.history, ev.TfIdf.fit(t.history))
    return ev.evidence_lists(t.incoming, top)


def _topic(t: traffic.Traffic) -> DataFrame:
    fitted = ev.TfIdf.fit(t.history)
    lists = ev.evidence_lists(t.incoming, ev.top_evidence(t.incoming, t.history, fitted))
    return ev.topic_similarity(t.incoming, lists, t.history, fitted)


@query
def topic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of each message with its evidence."""
    return _rounded(_topic(traffic.tables(spark, sf_dir)), 5)


# --- enrichment and artefacts ----------------------------------------------

def _artefacts(t: traffic.Traffic) -> tuple[DataFrame, DataFrame]:
    return (artefacts.transcripts(traffic.transcript_json(t.messages)),
            artefacts.analyses(traffic.analysis_json(t.messages)))


def _enriched(t: traffic.Traffic) -> DataFrame:
    return en.enrich(t.messages, *_artefacts(t))


@query
def enriched_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with transcripts as text and image analyses as columns."""
    return _enriched(traffic.tables(spark, sf_dir)).select(
        "message_id", "media_type", "message_text", "transcript_used", "image_urgency",
        "image_category", "image_extracted_text", "image_has_deadline")


@query
def enrichment_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artefacts loaded and messages changed."""
    t = traffic.tables(spark, sf_dir)
    return en.enrichment_counters(_enriched(t), *_artefacts(t))


@query
def media_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File of each media message."""
    t = traffic.tables(spark, sf_dir)
    media = t.messages.where("media_type IS NOT NULL").select(
        "message_id", "media_type", "media_id")
    return en.with_media_path(media, t.images, t.voice_notes).select(
        "message_id", "media_type", "media_id", "media_path")


@query
def media_message_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last message of each voice note and image."""
    messages = traffic.tables(spark, sf_dir).messages
    voice = en.media_owner(messages, "voice").withColumn("media_type", F.lit("voice"))
    return voice.unionByName(
        en.media_owner(messages, "image").withColumn("media_type", F.lit("image")))


@query
def parsed_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses built from whole documents, read back as fields."""
    i = F.col("doc_id")
    answer = F.to_json(F.struct(
        F.element_at(F.array(F.lit("HIGH"), F.lit("Medium"), F.lit("low")),
                     (i % 3 + 1).cast("int")).alias("urgency"),
        F.when(i % 4 != 0, F.upper("lang")).alias("category"),
        (i % 2 == 0).alias("has_deadline"),
        F.col("text").alias("extracted_text"), F.col("source").alias("reason")))
    response = F.when(i % 5 == 4, F.concat(F.lit("No object here: "), F.translate(
        "text", "{}", "()"))).when(i % 3 == 0, F.concat(
            F.lit("```json\n"), answer, F.lit("\n```"))).when(
                i % 3 == 1, F.concat(F.lit("Here it is: "), answer)).otherwise(answer)
    docs = traffic.read(spark, sf_dir, "documents").select(
        "doc_id", response.alias("response"))
    return artefacts.parse_responses(docs, "response").drop("response")


@query
def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table."""
    return reports.row_counts({n: traffic.read(spark, sf_dir, n) for n in TABLES})


@query
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns written and read back as CSV predictions."""
    turns = traffic.read(spark, sf_dir, "conversations")
    path = scratch_path(spark, "csv")
    write_predictions(turns.select(
        F.concat_ws("_", F.lit("message"), "conv_id", "turn").alias("message_id"),
        F.lit("digest").alias("action"), F.lit("personal").alias("message_type"),
        F.col("text").alias("reason"), (F.col("turn") / 8).alias("confidence"),
        F.col("role").alias("evidence_message_ids")), f"{path}/output.csv", "csv")
    return read_table(spark, path, "output")


@query
def rule_output_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules decide, written and read back as CSV predictions."""
    t = traffic.tables(spark, sf_dir)
    path = scratch_path(spark, "rule-output")
    write_predictions(rules.rule_matches(t.messages, t.accounts), f"{path}/output.csv", "csv")
    return read_table(spark, path, "output")


def _typed(df: DataFrame, name: str, key: str) -> DataFrame:
    """The declared columns of a table; what the data lacks is made from the key.

    Texts have quotes, commas and line ends, some are empty, and some values are null;
    times are whole minutes, as the files have them.
    """
    number = f"crc32({key})"
    made = {
        "string": f"CASE WHEN {number} % 11 = 0 THEN '' ELSE concat('said \"', {key}, '\",\n', {number} % 100) END",
        "int": f"cast({number} % 1000 AS int)", "double": f"{number} % 1000 / 8.0D",
        "date": f"date_add(DATE '2024-01-01', cast({number} % 365 AS int))",
        "timestamp": f"TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {number} % 9999)",
    }

    def column(field) -> Column:
        kind = field.dataType.simpleString()
        if field.name not in df.columns:
            return F.expr(f"if({number} % 7 = 3, NULL, {made[kind]})").alias(field.name)
        value = F.col(field.name).cast(field.dataType)
        if kind == "timestamp":
            value = F.date_trunc("minute", value)
        return value.alias(field.name)

    return df.select(*[column(f) for f in spark_schema(name)])


def _digest(df: DataFrame) -> Column:
    """The sum of a hash of all columns of the rows.

    In a CSV file an empty text is a missing value, so it counts as null here.
    """
    columns = [F.nullif(F.col(c), F.lit("")).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes]
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.sum(F.xxhash64(row).cast("decimal(38,0)"))


@query
def tables_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every input table written as CSV and read with its declared schema.

    Rows, keys, characters of the texts, and whether all columns of all rows came back
    as they were written (empty texts as nulls).  Message texts get a quoted second line.
    """
    t = traffic.tables(spark, sf_dir)
    path = scratch_path(spark, "tables")
    labelled = t.messages.join(traffic.truth(t.messages), "message_id").withColumnRenamed(
        "true_action", "action")
    made = {
        "messages": (t.incoming, "message_id"), "sample_messages": (labelled, "message_id"),
        "message_history": (t.history, "message_id"), "message_events": (t.reactions, "message_id"),
        "daily_notification_summary": (t.daily, "user_id"),
        "business_accounts": (t.accounts, "business_id"), "group_members": (t.members, "group_id"),
        "user_business_history": (t.relations, "business_id"), "images": (t.images, "image_id"),
        "voice_notes": (t.voice_notes, "voice_note_id"),
        "users": (traffic.read(spark, sf_dir, "customer").select(F.concat(
            F.lit("u_"), F.col("c_custkey").cast("string")).alias("user_id")), "user_id"),
        "groups": (t.members.select("group_id").distinct(), "group_id"),
    }
    counts = []
    for name, (df, key) in made.items():
        if "message_text" in df.columns:
            df = df.withColumn("message_text", F.concat("message_text", F.lit('\n"quoted", '), key))
        table = _typed(df, name, key)
        write_table(table, path, name)
        text = F.sum(F.length("message_text")) if "message_text" in table.columns else F.lit(None)
        back = read_table(spark, path, name)
        read = back.agg(
            F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"),
            text.cast("long").alias("text_chars"), _digest(back).alias("_read"))
        counts.append(read.join(table.agg(_digest(table).alias("_written"))).select(
            "table", "rows", "keys", "text_chars", F.expr("_read <=> _written").alias("unchanged")))
    return reduce(DataFrame.unionAll, counts)


@query
def artefact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts written as JSON lines and read back; a path without files gives no rows."""
    t = traffic.tables(spark, sf_dir)
    path = scratch_path(spark, "artefacts")
    artefacts.write_json(traffic.transcript_json(t.messages), f"{path}/voice")
    absent = artefacts.json_objects(spark, f"{path}/absent")
    return artefacts.transcripts(artefacts.json_objects(spark, f"{path}/voice").unionByName(absent))


# --- types, reasons, checks ------------------------------------------------

@query
def message_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of each enriched message under each possible action."""
    enriched = with_text_features(_enriched(traffic.tables(spark, sf_dir)), features=[
        "at_mention_with_question", "has_specific_time"])
    return types.with_message_types(enriched, {
        f"type_if_{a}": f"'{a}'" for a in L.ACTIONS}).select(
            "message_id", *[f"type_if_{a}" for a in L.ACTIONS])


def _decided(t: traffic.Traffic) -> DataFrame:
    return routing.decide(t.incoming, t.accounts, t.history_tables, traffic.scored(t.incoming))


@query
def reason_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action, type, confidence and reason before the checks."""
    return _rounded(_decided(traffic.tables(spark, sf_dir)).select(
        "message_id", "action", "message_type", "confidence", "reason"))


@query
def calibrated_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed probability, rounded to four digits, and the review flag."""
    scored = traffic.scored(traffic.tables(spark, sf_dir).messages)
    smoothed = scored.withColumn("confidence", reasons.smoothed_confidence(
        F.col("model_probability")))
    return verify.with_review_flag(smoothed).select(
        "message_id", reasons.rounded_confidence(F.col("confidence")).alias("confidence"),
        "needs_review")


_routed: dict[tuple[str, str, str], DataFrame] = {}


def _arrived(t: traffic.Traffic) -> DataFrame:
    """Incoming messages with transcripts as text and image analyses as columns."""
    media = t.incoming.where("media_type IS NOT NULL")
    return en.enrich(t.incoming, artefacts.transcripts(traffic.transcript_json(media)),
                     artefacts.analyses(traffic.analysis_json(media)))


def _checked(t: traffic.Traffic, signal: str = "reason") -> DataFrame:
    """Decisions of incoming messages after evidence, guard, verifier and validation.

    The whole router on enriched messages, stored once per application and folder.
    """
    key = (t.spark_application, t.root, signal)
    if key not in _routed:
        arrived = _arrived(t)
        _routed[key] = staged(routing.route(
            arrived, t.accounts, t.history_tables, ev.TfIdf.fit(t.history),
            traffic.scored(t.incoming), signal, consistent=False).select(
                *OUT, "needs_review", "corrections", "trace", "is_safe", "created_at",
                identity_key().alias("_key")), "checked")
    return _routed[key]


def _final(t: traffic.Traffic) -> DataFrame:
    """The checked decisions with equal messages made equal, stored likewise."""
    key = (t.spark_application, t.root, "final")
    if key not in _routed:
        _routed[key] = staged(enforce_consistency(_checked(t)).select(*OUT), "final")
    return _routed[key]


@query
def verified_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected type and action with the trace line."""
    return _checked(traffic.tables(spark, sf_dir)).select(
        "message_id", "action", "message_type",
        F.array_join("corrections", ",").alias("corrections"), "trace")


@query
def verified_by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the verifier looking at reason templates only."""
    return _checked(traffic.tables(spark, sf_dir), "template").select(
        "message_id", "action", "message_type")


@query
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages processed and corrected."""
    return verify.trace_summary(_checked(traffic.tables(spark, sf_dir)))


@query
def corrected_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages corrected, with their corrections."""
    return verify.corrected_messages(_checked(traffic.tables(spark, sf_dir))).withColumn(
        "corrections", F.array_join("corrections", ","))


@query
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose confidence calls for a review."""
    return where_computed(_checked(traffic.tables(spark, sf_dir)), "needs_review").select(*OUT)


@query
def validated_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event kinds and values as raw decisions, repaired where they break the contract."""
    raw = traffic.tables(spark, sf_dir).messages.select(
        "message_id",
        F.when(F.col("event_type") == "view", F.lit("digest")).when(
            F.col("event_type") == "click", F.lit("notify")).otherwise(
                F.col("event_type")).alias("action"),
        F.when(F.col("k") % 9 == 0, F.lit("chat")).otherwise(F.lit("personal"))
        .alias("message_type"),
        F.when(F.col("k") % 11 != 0, F.col("event_type")).alias("reason"),
        (F.col("value") / 100).alias("confidence"), F.lit("none").alias("evidence_message_ids"))
    return _rounded(verify.with_validation(raw).select(*OUT, "is_valid"))


# --- end to end ------------------------------------------------------------

@query
def route_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The router on all incoming messages: guard, rules, model scores, evidence, checks."""
    t = traffic.tables(spark, sf_dir)
    arrived = _arrived(t)
    return routing.route(arrived, t.accounts, t.history_tables, ev.TfIdf.fit(t.history),
                         traffic.scored(t.incoming)).select(*OUT)


@query
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal messages get the decision of the most confident of them."""
    messages = traffic.tables(spark, sf_dir).messages
    # every third message is delivered again, an hour later and with another decision
    again = F.expr("explode(if(event_id % 3 = 0, array(0, 1), array(0)))").alias("again")
    twice = messages.select("*", again)
    named = F.concat("message_id", F.col("again").cast("string"))
    delivered = twice.select(
        named.alias("message_id"), F.expr("created_at + make_interval(0, 0, 0, 0, again)")
        .alias("created_at"), "user_id", "sender_user_id", "conversation_type", "media_type",
        "forwarded_count", "message_text",
        F.expr("if(again = 0, event_type, conversation_type)").alias("action"),
        F.col("conversation_type").alias("message_type"),
        ((F.col("event_id") + F.col("again") * 3) % 5).cast("double").alias("confidence"),
        named.alias("reason"), F.lit("none").alias("evidence_message_ids"))
    return enforce_consistency(delivered).select(*OUT)


# --- reports ---------------------------------------------------------------

@query
def action_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and share of each action."""
    return _rounded(reports.distribution(_final(traffic.tables(spark, sf_dir)), "action"))


@query
def message_type_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent types."""
    return _rounded(reports.top_types(_final(traffic.tables(spark, sf_dir))))


@query
def confidence_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence range of each action."""
    return _rounded(reports.confidence_by_action(_final(traffic.tables(spark, sf_dir))))


def _with_truth(t: traffic.Traffic) -> DataFrame:
    return reports.with_truth(_final(t), traffic.truth(t.incoming))


@query
def type_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of types equal to what the conversation calls for, and the acceptance gate."""
    t = traffic.tables(spark, sf_dir)
    return _rounded(reports.type_accuracy(_final(t).join(traffic.true_type(t.incoming), "message_id")))


@query
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and share of each true action."""
    t = traffic.tables(spark, sf_dir)
    return _rounded(reports.distribution(traffic.truth(t.messages), "true_action"))


@query
def action_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of decisions equal to the recipient's reaction."""
    return _rounded(reports.accuracy(_with_truth(traffic.tables(spark, sf_dir))))


@query
def rule_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for messages decided by a rule."""
    t = traffic.tables(spark, sf_dir)
    matched = rules.rule_matches(t.messages, t.accounts)
    return _rounded(reports.accuracy(reports.with_truth(
        matched, traffic.truth(t.messages), "left")))


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True against chosen actions."""
    return reports.confusion_matrix(_with_truth(traffic.tables(spark, sf_dir)))


@query
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each action."""
    return _rounded(reports.class_report(_with_truth(traffic.tables(spark, sf_dir))))


@query
def misclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that differ from the recipient's reaction."""
    return reports.misclassified(_with_truth(traffic.tables(spark, sf_dir))).select(
        "message_id", "action", "true_action")


@query
def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the output contract; all messages against the incoming decisions."""
    t = traffic.tables(spark, sf_dir)
    return reports.contract_checks(t.messages, _final(t))


# --- model -----------------------------------------------------------------

@query
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 49 features of each incoming message."""
    t = traffic.tables(spark, sf_dir)
    return _rounded(ml.feature_matrix(t.incoming, t.history_tables, _topic(t)), 5)


@query
def features_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 21 history features of every message from what was known when it was sent."""
    t = traffic.tables(spark, sf_dir)
    return _rounded(pit.history_features_as_of(t.messages, t.history_tables, ev.TfIdf.fit(t.history)), 5)


@query
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class index of each label, and the class sizes."""
    t = traffic.tables(spark, sf_dir)
    indexed = ml.with_label_index(traffic.truth(t.messages).withColumnRenamed(
        "true_action", "action"))
    return indexed.groupBy("action", "label_index").agg(F.count(F.lit(1)).alias("n"))


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact 80/20 split of all messages per true action."""
    t = traffic.tables(spark, sf_dir)
    return ml.stratified_split(traffic.truth(t.messages), "true_action", "message_id")


_models: dict[tuple[str, str], tuple] = {}


def _fitted(spark: SparkSession, sf_dir: str) -> tuple:
    """Booster, its labelled past messages, and scores of incoming ones: once per application and folder."""
    t = traffic.tables(spark, sf_dir)
    key = (t.spark_application, t.root)
    if key not in _models:
        words = ev.TfIdf.fit(t.history)
        actions = traffic.truth(t.history).withColumnRenamed("true_action", "action")
        past, new = _model_features(t, words)
        rows = rm.labelled_rows(t.history, actions, t.history_tables, words, past)
        booster = rm.fit_router_model(rows)
        scores = staged(rm.score_messages(booster, t.incoming, t.history_tables, words, new), "model-scores")
        _models[key] = booster, rows, scores
    return _models[key]


def _model_features(t: traffic.Traffic, words: ev.TfIdf) -> tuple[DataFrame, DataFrame]:
    """Features as of their time of past and of incoming messages, stored; the history is read once for both.

    Ids carry their period meanwhile, so messages of one id in both periods stay apart.
    """
    both = t.messages.withColumn("message_id", F.concat(F.substring("period", 1, 1), "message_id"))
    featured = staged(rm.features_as_of(both, t.history_tables, words), "model-features")
    named = featured.withColumns({"_of": F.substring("message_id", 1, 1), "message_id": F.expr("substring(message_id, 2)")})
    return tuple(named.where(F.col("_of") == kind).drop("_of") for kind in ("h", "i"))


@query
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities of incoming messages, by trees fitted to past messages and reactions."""
    return _fitted(spark, sf_dir)[2]


@query
def model_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the boosted trees on the test part."""
    booster, rows, _ = _fitted(spark, sf_dir)
    scored = booster.score(rows.where("is_test"), ["message_id", "action"])
    return reports.class_report(scored, "model_action", "action")


@query
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty features of largest mean gain."""
    return _fitted(spark, sf_dir)[0].importances(spark)


@query
def training_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss on the training and the test part after each round."""
    return _fitted(spark, sf_dir)[0].history(spark)


@query
def model_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a fitted model, as counts: scored messages, sums and choices that are
    wrong, labelled and test rows, rounds whose loss is known, rounds whose training loss rose,
    scores that differ after saving and loading."""
    booster, rows, scores = _fitted(spark, sf_dir)
    path = scratch_path(spark, "booster")
    booster.save(spark, path)
    classes = [f"p_{c}" for c in booster.classes]
    again = boosting.Booster.load(spark, path).score(rows, ["message_id"])
    first = booster.score(rows, ["message_id"]).select(
        "message_id", *[F.col(c).alias(f"_{c}") for c in classes])
    changed = again.join(first, "message_id").where(" OR ".join(f"{c} <> _{c}" for c in classes))
    losses = booster.losses["train"]
    checked = scores.agg(
        F.count("*").alias("scored"),
        F.count_if(F.abs(sum(F.col(c) for c in classes) - 1) > 1e-9).alias("wrong_sums"),
        F.count_if(F.col("model_probability") != F.greatest(*classes)).alias("wrong_probabilities"),
        F.count_if(F.element_at(F.create_map(*[x for c in classes for x in (F.lit(c[2:]), F.col(c))]),
                                F.col("model_action")) != F.col("model_probability")).alias("wrong_actions"))
    return (checked.crossJoin(rows.agg(F.count("*").alias("labelled"), F.count_if("is_test").alias("test_rows")))
            .crossJoin(changed.agg(F.count("*").alias("changed_by_saving"))).withColumns({
                "train_rounds": F.lit(len(losses)), "test_rounds": F.lit(len(booster.losses["test"])),
                "rises": F.lit(sum(b > a for a, b in zip(losses, losses[1:])))}))


@query
def route_messages_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The router on all incoming messages with the scores of the fitted model."""
    t = traffic.tables(spark, sf_dir)
    scores = _fitted(spark, sf_dir)[2].select("message_id", "model_action", "model_probability")
    return routing.route(_arrived(t), t.accounts, t.history_tables, ev.TfIdf.fit(t.history), scores).select(*OUT)


# --- streams ---------------------------------------------------------------

# archives are replayed in any order, so nothing may count as late
REPLAY = "60 days"


_arriving: set[str] = set()


def _stream(spark: SparkSession, t: traffic.Traffic, name: str, table: DataFrame | None = None) -> DataFrame:
    """Messages, reactions or another ``table`` as they arrived, about two slices of time a micro-batch."""
    table, path = getattr(t, name) if table is None else table, f"{t.root}/arriving-{name}"
    # what a message was made of does not arrive with it
    table = table.drop("tail")
    if path not in _arriving:
        traffic.arrivals(table, path)
        _arriving.add(path)
    files = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


# what came before is the state that live streams start with
LIVE_START = "2024-01-11"


def _log(t: traffic.Traffic) -> tuple[DataFrame, DataFrame]:
    """The log of messages and reactions before and from the start of live streams."""
    passing = [c for c in live.ROUTED]
    events = live.message_events(t.messages, passing).unionByName(
        live.reaction_events(t.reactions, t.messages), allowMissingColumns=True)
    # files are cut by created_at, which a reaction lacks
    events = events.withColumn("created_at", F.coalesce("created_at", "at"))
    new = events.where(F.col("at") >= F.lit(LIVE_START).cast("timestamp"))
    return events.where(F.col("at") < F.lit(LIVE_START).cast("timestamp")), new.unionByName(live.closing_events(new))


@query
def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages routed as they arrive, several micro-batches."""
    t = traffic.tables(spark, sf_dir)
    out = scratch_path(spark, "stream-route")
    routed = streams.route_stream(_stream(spark, t, "messages"), t.accounts, t.history_tables)
    streams.drain(routed.select(*OUT), f"{out}/checkpoint", f"{out}/data")
    return spark.read.parquet(f"{out}/data")


@query
def stream_route_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming messages routed with evidence per micro-batch and consistency across them."""
    t = traffic.tables(spark, sf_dir)
    out = scratch_path(spark, "stream-batches")
    arriving = _stream(spark, t, "messages").where("period = 'incoming'")
    routed = streams.route_stream(arriving, t.accounts, t.history_tables, traffic.scored(t.incoming))
    streams.drain(routed, f"{out}/checkpoint", sink=streams.finish_batches(
        t.history, ev.TfIdf.fit(t.history), f"{out}/data"))
    return streams.finished(spark, f"{out}/data").select(*OUT)


@query
def stream_sender_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running reaction counts per recipient and sender, summed over days."""
    t = traffic.tables(spark, sf_dir)
    out = scratch_path(spark, "stream-senders")
    counted = streams.sender_stats_stream(_stream(spark, t, "reactions"), t.history, REPLAY)
    streams.drain(counted, f"{out}/checkpoint", sink=streams.upsert_batches(f"{out}/data"),
                  mode="update")
    days = streams.latest(spark, f"{out}/data", ["day", "user_id", "sender_key"])
    return days.groupBy("user_id", "sender_key").agg(*[F.sum(c).alias(c) for c in [
        "message_count", "opened", "replied", "dismissed", "reported"]])


@query
def stream_daily_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily notification load per user."""
    t = traffic.tables(spark, sf_dir)
    out = scratch_path(spark, "stream-load")
    streams.drain(streams.daily_load_stream(_stream(spark, t, "reactions"), REPLAY),
                  f"{out}/checkpoint", sink=streams.upsert_batches(f"{out}/data"), mode="update")
    return streams.latest(spark, f"{out}/data", ["user_id", "date"]).select(
        "user_id", F.col("date").cast("string").alias("date"), "notifications_sent",
        "notifications_dismissed")


@query
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message delivered twice, kept once."""
    t = traffic.tables(spark, sf_dir)
    out = scratch_path(spark, "stream-dedup")
    once = _stream(spark, t, "messages").select("message_id", "user_id", "created_at")
    again = _stream(spark, t, "messages").select("message_id", "user_id", "created_at")
    streams.drain(streams.deduplicated(once.unionAll(again), REPLAY),
                  f"{out}/checkpoint", f"{out}/data")
    return spark.read.parquet(f"{out}/data").select("message_id", "user_id")


@query
def stream_live_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sender, user and category features of arriving messages, by counts that follow the reactions."""
    t = traffic.tables(spark, sf_dir)
    out = scratch_path(spark, "stream-live")
    past, new = _log(t)
    start = staged(live.starting_counts(past), "live-start")
    with live.rocksdb(spark):
        streams.drain(live.live_features(_stream(spark, t, "log", new), start), f"{out}/checkpoint", f"{out}/data")
    return _rounded(spark.read.parquet(f"{out}/data").where(F.col("message_id") != live.CLOSING).select(
        "message_id", *live.FEATURES))


@query
def stream_route_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving messages routed with counts that follow the reactions."""
    t = traffic.tables(spark, sf_dir)
    out = scratch_path(spark, "stream-route-live")
    past, new = _log(t)
    start = staged(live.starting_counts(past), "live-start")
    with live.rocksdb(spark):
        routed = live.route_live(_stream(spark, t, "log", new), t.accounts, t.history_tables, start)
        streams.drain(routed.select(*OUT), f"{out}/checkpoint", f"{out}/data")
    return spark.read.parquet(f"{out}/data").where(F.col("message_id") != live.CLOSING)


@query
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving messages with their reaction within an hour, or without one: two streams joined."""
    t = traffic.tables(spark, sf_dir)
    out = scratch_path(spark, "stream-answers")
    _, new = _log(t)
    sides = [_stream(spark, t, "log", new).where(F.col("kind") == k) for k in ("message", "reaction")]
    streams.drain(live.answers(*sides), f"{out}/checkpoint", f"{out}/data")
    return spark.read.parquet(f"{out}/data").where(F.col("message_id") != live.CLOSING)
