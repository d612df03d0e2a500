import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from beckon.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", 4)
    yield session
    session.stop()


MESSAGE_DEFAULTS = {
    "message_id": "m1", "user_id": "u_1", "conversation_type": "personal", "group_id": None,
    "business_id": None, "sender_user_id": "u_9", "created_at": "2024-02-01 10:00:00",
    "message_text": "hello", "media_type": None, "media_id": None, "forwarded_count": 0,
}


@pytest.fixture(scope="session")
def make_messages(spark):
    from pyspark.sql import functions as F

    def make(*rows):
        schema = ", ".join(f"{c} {'int' if c == 'forwarded_count' else 'string'}"
                           for c in MESSAGE_DEFAULTS)
        data = [tuple({**MESSAGE_DEFAULTS, "message_id": f"m{i}", **row}.values())
                for i, row in enumerate(rows)]
        return spark.createDataFrame(data, schema).withColumn(
            "created_at", F.to_timestamp("created_at"))

    return make
