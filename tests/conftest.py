import json
import sys
import uuid
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from hashwave.session import prepare  # noqa: E402
from hashwave.sources.tweets import read_tweets  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("hashwave-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    session = session.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield prepare(session)
    session.stop()


def message(id, text="", **fields):
    """A post as its JSON message; named fields replace the plain ones."""
    post = {
        "id": id,
        "created_at": "Mon Apr 06 20:00:00 +0000 2015",
        "text": text,
        "retweet_count": 0,
        "user": {"id": 1, "screen_name": "ann"},
        "in_reply_to_screen_name": None,
        "coordinates": None,
        "place": None,
        "entities": {"hashtags": [], "user_mentions": []},
        "retweeted_status": None,
    }
    return post | fields


def at(clock):
    return f"Mon Apr 06 {clock} +0000 2015"


def place(lng, lat, name="Town"):
    return {"full_name": name, "bounding_box": {"coordinates": [[[lng, lat], [0.0, 0.0]]]}}


def point(lng, lat):
    return {"coordinates": [lng, lat]}


def entities(hashtags=(), mentions=()):
    return {
        "hashtags": [{"text": tag} for tag in hashtags],
        "user_mentions": [{"screen_name": name} for name in mentions],
    }


def reshare_of(name):
    return {"id": 0, "user": {"screen_name": name}}


def author(name):
    return {"id": 1, "screen_name": name}


@pytest.fixture
def write_messages(tmp_path):
    def write(messages, folder=None):
        folder = Path(folder or tmp_path / uuid.uuid4().hex)
        folder.mkdir(exist_ok=True)
        lines = "\n".join(json.dumps(m) for m in messages)
        (folder / f"{uuid.uuid4().hex}.json").write_text(lines)
        return str(folder)

    return write


@pytest.fixture
def tweets(spark, write_messages):
    return lambda *messages: read_tweets(spark, write_messages(messages))


def rows(df, *names):
    """Rows as sorted tuples of the named columns, or of all."""
    return sorted(
        (tuple(r) for r in df.select(*(names or df.columns)).collect()),
        key=lambda r: tuple((v is not None, str(v)) for v in r),
    )
