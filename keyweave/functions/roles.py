"""What a column is for, from its name or from its values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyweave.functions.casts import as_column
from keyweave.functions.keys import Gazetteer

# Hints inside a column name, by role, first role wins (fixed values).
NAME_HINTS = {
    "region_code": (
        "시군구코드", "법정동코드", "행정동코드", "지역코드", "sggcd", "admcd", "bjdcd", "signgucd",
        "signgu_cd", "sggcode", "ldongcd", "emdcd", "dongcode", "dong_cd", "admcode",
    ),
    "region_name": (
        "시군구", "시군", "지역명", "행정구역", "시도군구", "소재지", "지자체", "읍면동", "법정동", "행정동",
        "주소", "addr", "adres", "signgu", "sigungu", "emd", "dong", "area_nm", "areanm", "rdnmadr", "lnmadr",
    ),
    "sido": ("시도", "광역", "ctprvn"),
    "lat": ("위도", "lat", "y좌표", "ycoord", "_la", "latitude"),
    "lon": ("경도", "lon", "lng", "x좌표", "xcoord", "_lo", "longitude"),
    "date": ("일자", "날짜", "date", "일시", "_de", "_dt", "ymd"),
    "year": ("연도", "년도", "기준연도", "year", "_yr"),
}
NAME_CONFIDENCE = 0.7

# First syllables of province names (fixed values).
PROVINCES = (
    "서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기", "강원",
    "충청", "충북", "충남", "전라", "전북", "전남", "경상", "경북", "경남", "제주",
)


# What the values of some roles look like (fixed values).
VALUE_PATTERNS = {
    "region_code10": r"(?U)^\d{10}$",
    "region_code5": r"(?U)^\d{5}$",
    "sido": "^(?:" + "|".join(PROVINCES) + ")",
    "year": r"(?U)^(?:19|20)\d{2}$",
    "date": r"(?U)^\d{4}[-/.]?\d{2}[-/.]?\d{2}",
    "numeric": r"(?U)^-?[\d,]+(?:\.\d+)?$",
}


def value_tests(value: Column | str, gazetteer: Gazetteer) -> dict[str, Column]:
    """Boolean test per value-based role."""
    text = as_column(value)
    patterns = {"region_name": "|".join(gazetteer.names), **VALUE_PATTERNS}
    return {role: text.rlike(pattern) for role, pattern in patterns.items()}


# Share of values that must pass, and the confidence it gives, in order (fixed values).
VALUE_RULES = {
    "region_name": (0.5, 0.95),
    "region_code10": (0.8, 0.9),
    "region_code5": (0.8, 0.85),
    "sido": (0.7, 0.8),
    "year": (0.8, 0.85),
    "date": (0.7, 0.85),
    "numeric": (0.9, 0.8),
}


def role_by_name(name: Column | str) -> Column:
    """Role whose hint occurs in the lower-case name, NULL when none does."""
    low = F.lower(as_column(name))
    chosen = F.lit(None).cast("string")
    for role, hints in reversed(NAME_HINTS.items()):
        chosen = F.when(low.rlike("|".join(hints)), role).otherwise(chosen)
    return chosen


def role_by_shares(shares: dict[str, Column], filled: Column) -> Column:
    """``struct(role, confidence)`` from the share of values passing each test."""

    def verdict(role: str, confidence: float) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"))

    chosen = verdict("text", 0.3)
    for role, (least, confidence) in reversed(VALUE_RULES.items()):
        chosen = F.when(shares[role] > least, verdict(role, confidence)).otherwise(chosen)
    return F.when(filled == 0, verdict("text", 0.0)).otherwise(chosen)
