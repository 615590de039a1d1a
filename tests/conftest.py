import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from reviewlens.session import build_session
    s = build_session("local[*]", 8, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="rl-ckpt-")})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="rl-test-")


REVIEW_SCHEMA = ("slug string, pos long, name string, rating int, text string, text_translated string, "
                 "lang string, date string, owner_reply string, photos int, date_abs string")


def reviews_df(spark, rows):
    """rows: dicts with any subset of review fields."""
    cols = [c.split()[0] for c in REVIEW_SCHEMA.split(", ")]
    defaults = {"name": "", "rating": 5, "text": "", "text_translated": "", "lang": "zh", "date": "",
                "owner_reply": "", "photos": 0, "date_abs": None}
    data = [tuple({**defaults, **r}.get(c) for c in cols) for r in rows]
    return spark.createDataFrame(data, REVIEW_SCHEMA)
