import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from vigilume.session import local_session  # noqa: E402

EVENT = (
    "id string, datetime timestamp_ntz, user_id string, pc string, activity string, to_addr string, cc string, "
    "bcc string, attachments string, url string, filename string"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, name="vigilume-tests", memory="8g", shared=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture
def events(spark):
    """Build an event table from (time, user, pc, activity, extra fields) tuples."""

    def build(*rows):
        full = []
        for i, (time, user, pc, activity, *extra) in enumerate(rows):
            more = extra[0] if extra else {}
            full.append(
                {
                    "id": str(i), "datetime": datetime.fromisoformat(time), "user_id": user, "pc": pc, "activity": activity,
                    **{c: more.get(c) for c in ("to_addr", "cc", "bcc", "attachments", "url", "filename")},
                }
            )
        names = [f.split()[0] for f in EVENT.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], EVENT)

    return build
