"""Readers, artefacts, writers, enrichment, model persistence and streams."""

import json

from pyspark.sql import functions as F

from beckon.operators import enrich as en
from beckon.operators import model as ml
from beckon.operators import reports
from beckon.sources import artefacts, tables
from beckon.streaming import streams


def test_multiline_csv_and_missing_table(spark, tmp_path):
    (tmp_path / "messages.csv").write_text(
        "message_id,user_id,conversation_type,group_id,business_id,sender_user_id,created_at,"
        "message_text,media_type,media_id,forwarded_count\n"
        'm1,u1,personal,,,u2,2026-07-30 22:19,"two\nlines, ""quoted""",,,0\n'
        "m2,u1,group,g1,,u2,2026-07-30 22:20,,voice,vn_1,3\n")
    rows = tables.read_table(spark, str(tmp_path), "messages").orderBy("message_id").collect()
    assert rows[0]["message_text"] == 'two\nlines, "quoted"'
    assert rows[1]["message_text"] is None and rows[1]["forwarded_count"] == 3
    assert str(rows[0]["created_at"]) == "2026-07-30 22:19:00"
    assert tables.read_table(spark, str(tmp_path), "images", missing_ok=True).count() == 0


def test_csv_keeps_blanks_quotes_and_lines(spark, tmp_path):
    texts = ["  two blanks ", 'a "quoted", text\nof two lines', None, "\t", "a\\b", '"']
    rows = [(f"m{i}", "mute", "spam", t, 0.5, "none") for i, t in enumerate(texts)]
    decided = spark.createDataFrame(rows, tables.SCHEMAS["output"])
    tables.write_predictions(decided, str(tmp_path / "output.csv"), "csv")
    back = tables.read_table(spark, str(tmp_path), "output")
    assert sorted(map(tuple, back.collect())) == rows


def test_artefacts_enrich_messages(spark, tmp_path, make_messages):
    (tmp_path / "voice.json").write_text(json.dumps({"m0": "spoken words", "m1": None}))
    (tmp_path / "image.json").write_text(json.dumps({"m2": {"urgency": "high", "category": None}}))
    voice = artefacts.transcripts(artefacts.json_objects(spark, str(tmp_path / "voice.json"), whole_file=True))
    image = artefacts.analyses(artefacts.json_objects(spark, str(tmp_path / "image.json"), whole_file=True))
    assert artefacts.json_objects(spark, str(tmp_path / "none.json")).count() == 0
    messages = make_messages({"message_text": " ", "media_type": "voice"},
                             {"message_text": None, "media_type": "voice"},
                             {"message_text": "x", "media_type": "image"})
    rows = {r["message_id"]: r for r in en.enrich(messages, voice, image).collect()}
    assert rows["m0"]["message_text"] == "spoken words" and rows["m0"]["transcript_used"]
    assert rows["m1"]["message_text"] is None
    assert rows["m2"]["image_urgency"] == "high" and rows["m2"]["image_category"] == "unknown"
    assert rows["m2"]["image_has_deadline"] is False and rows["m0"]["image_urgency"] is None


def test_model_responses(spark):
    df = spark.createDataFrame([
        ("fence", '```json\n{"urgency": "HIGH", "has_deadline": true}\n```'),
        ("text", "sorry, no idea"), ("broken", "{not json}"), ("empty", None)],
        "id string, response string")
    rows = {r["id"]: r for r in artefacts.parse_responses(df, "response").collect()}
    assert (rows["fence"]["urgency"], rows["fence"]["category"]) == ("high", "unknown")
    assert rows["fence"]["has_deadline"] and rows["fence"]["parsed"]
    assert not rows["text"]["parsed"] and rows["text"]["extracted_text"] == "sorry, no idea"
    assert not rows["broken"]["parsed"] and not rows["empty"]["parsed"]


def test_media_paths_and_extractor(spark, make_messages):
    messages = make_messages({"media_type": "image", "media_id": "i1"},
                             {"media_type": "image", "media_id": "i2"}, {})
    images = spark.createDataFrame([("i1", "a/i1.jpg")], tables.SCHEMAS["images"])
    notes = spark.createDataFrame([], tables.SCHEMAS["voice_notes"])
    rows = {r["message_id"]: r["media_path"]
            for r in en.with_media_path(messages, images, notes).collect()}
    assert rows == {"m0": "dataset/a/i1.jpg", "m1": None, "m2": None}

    def look(batches):
        for pdf in batches:
            yield pdf[["message_id"]].assign(
                image_type="photo", image_urgency="low", image_content="", image_suspicious=False,
                image_has_text=False, image_text_content="")

    assert en.extract_media(messages.select("message_id", "media_type"), look, "image").count() == 2


def test_model_round_trip(spark, tmp_path):
    df = spark.range(120).selectExpr(
        "id", "double(id % 3) AS a", "double(id % 7) AS b",
        "element_at(array('digest', 'mute', 'notify'), int(id % 3) + 1) AS action")
    fitted = ml.train(df, ["a", "b"], rounds=3, depth=2)
    ml.save(fitted, str(tmp_path / "model"))
    scored = ml.score(ml.load(str(tmp_path / "model")), df, ["id", "action"])
    result = reports.accuracy(scored, "model_action", "action").first()
    assert result["n"] == 120 and result["accuracy"] == 1.0
    total = scored.select(F.col("p_digest") + F.col("p_mute") + F.col("p_notify")).first()[0]
    assert abs(total - 1) < 1e-9
    assert ml.importances(spark, fitted).first()["feature"] == "a"
    assert ml.loss_history(spark, fitted, {"train": df}).count() == 9


def test_stream_keeps_one_copy(spark, tmp_path, make_messages):
    messages = make_messages({}, {}, {"message_id": "m0"})
    messages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in"))
    streams.drain(streams.deduplicated(stream), str(tmp_path / "cp"), str(tmp_path / "out"))
    ids = [r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("message_id").collect()]
    assert sorted(ids) == ["m0", "m1"]
