"""Short named secrets."""

import pytest
from pyspark.sql import functions as F

from quernel.llm import secrets

FOUND = {
    "login with password=hunter2 today": "hunter2",
    "pwd: Tr0ub4dor&3 is set": "Tr0ub4dor&3",
    'passwd = "x9!Kq2zP"': "x9!Kq2zP",
    "api_key=aB3xK9mQ7r.Lp8HnV4sJ.yGcD1u2w": "aB3xK9mQ7r.Lp8HnV4sJ.yGcD1u2w",
}
CLEAN = ["the password: required here", "author: Johnson2 wrote it", "token = get_name()", "password: \"your_password\"", "a secret garden with 12 trees", "note: hunter2 won", None, ""]


@pytest.fixture(scope="module")
def scanned(spark):
    texts = [*FOUND, *CLEAN]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.text: r for r in rows}


def test_short_named_values(scanned):
    for text, value in FOUND.items():
        assert value in [f.value for f in scanned[text].findings] and value not in scanned[text].redacted, text
    for text in CLEAN:
        assert not scanned[text].findings and scanned[text].redacted == text, text


def test_distinct_characters_of_whole_values(spark):
    values = ["=" * 1200 + "0123456789abcdefXYZ", "a", "abcabc", "Tr0ub4dor&3", "pässwörd"]
    c = F.struct(F.col("v").alias("value"), F.col("v").alias("word"), F.lit("").alias("before"), F.lit("").alias("after"), F.lit(False).alias("named"))
    k = secrets.FEATURES.index("distinct")
    for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.features(c)[k].alias("x")).collect():
        assert r.x == pytest.approx(len(set(r.v)) / min(len(r.v), 60)), r.v
