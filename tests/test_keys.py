"""Key vectors derived by hand, checked against the expressions and a plain reading of the rules."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyweave.functions.casts import clean, strict_double
from keyweave.functions.keys import CITY_CODES, CITY_NAMES, Gazetteer

VECTORS = [
    ("경상북도 포항시 북구 중앙로 1", None, "포항시", None),
    ("포항북구", None, "포항시", None),
    ("포항군", None, None, None),
    ("47111", None, "포항시", None),
    ("4711110100", None, "포항시", "포항시|47111101"),
    ("99999", "포항시", None, None),
    ("영천시 금호읍 1-2", None, "영천시", "영천시|금호읍"),
    ("포항시 장량동1", None, "포항시", "포항시|장량동"),
    ("장량동", "포항시", None, "포항시|장량동"),
    ("장량동", None, None, None),
    ("고령인구", None, "고령군", None),
    (" nan ", None, None, None),
    ("구미시 산동면(임천)", None, "구미시", "구미시|산동면"),
    ("포항로 포항시 장량동", None, "포항시", "포항시|장량동"),
    ("경주동", "포항시", "경주시", None),
    ("4711", None, None, None),
]


@pytest.mark.parametrize("position", range(len(VECTORS)))
def test_vectors(spark, position):
    value, default, city, town = VECTORS[position]
    g = Gazetteer()
    df = spark.createDataFrame([(value, default)], "v string, d string")
    assert df.select(g.city("v"), g.town("v", F.col("d"))).first()[:] == (city, town)


def plain_city(text):
    text = text.strip()
    if not text or text.lower() in ("nan", "none", "null"):
        return None
    if re.fullmatch(r"\d{5,10}", text):
        return CITY_CODES.get(text[:5])
    hits = [(text.find(n), n) for n in CITY_NAMES if n in text]
    if hits:
        return min(hits)[1]
    stems = {n[:-1]: n for n in CITY_NAMES}
    hits = [(m.start(), stems[s]) for s in stems for m in re.finditer(f"{s}(?![시군])", text)]
    return min(hits)[1] if hits else None


PIECES = st.sampled_from(["포항", "경주", "시", "군", "구미시", "북구", " ", "47111", "0", "금호읍", "동", "nan", "\t", "a,("])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=6).map("".join), min_size=20, max_size=20))
def test_city_matches_plain_rules(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", Gazetteer().city("v").alias("c")).collect()
    assert [r.c for r in rows] == [plain_city(r.v) for r in rows]


def test_stem_can_be_switched_off(spark):
    df = spark.createDataFrame([("고령인구",), ("고령군",)], "v string")
    assert [r[0] for r in df.select(Gazetteer(allow_stem=False).city("v")).collect()] == [None, "고령군"]


def test_keys_need_no_python(spark):
    df = spark.createDataFrame([("포항시",)], "v string").select(Gazetteer().town("v", "포항시"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_clean_and_numbers(spark):
    texts = ["　 x\xa0", "NULL", "", " None ", "a nan", "1d", "1,234", "1e3", ".5", "5.", "inf", "nan", "1_0", " 7 "]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    rows = df.select(clean("v").alias("c"), strict_double("v").cast("string").alias("n")).collect()
    assert [r.c for r in rows[:5]] == ["x", None, None, None, "a nan"]
    assert [r.n for r in rows[5:]] == [None, None, "1000.0", "0.5", "5.0", "Infinity", "NaN", None, "7.0"]
