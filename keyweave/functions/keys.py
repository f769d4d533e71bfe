"""Place-name normalization as Catalyst expressions, driven by a gazetteer.

Every expression is made of built-in functions, so it stays inside whole-stage code
generation and no Python runs per row. Each pattern below settles all rules for one part
of a key in a single pass, so an expression mentions its input once per part and stays
small however deeply the input is computed. Missing-value words hold no place name, so
they need no separate treatment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyweave.functions.casts import SPACE_CLASS, as_column

# Cities and counties of the default gazetteer (fixed values).
CITY_NAMES = (
    "포항시", "경주시", "김천시", "안동시", "구미시", "영주시", "영천시", "상주시",
    "문경시", "경산시", "군위군", "의성군", "청송군", "영양군", "영덕군", "청도군",
    "고령군", "성주군", "칠곡군", "예천군", "봉화군", "울진군", "울릉군",
)

# First five digits of an administrative code (fixed values).
CITY_CODES = {
    "43720": "군위군", "47111": "포항시", "47113": "포항시", "47130": "경주시",
    "47150": "김천시", "47170": "안동시", "47190": "구미시", "47210": "영주시",
    "47230": "영천시", "47250": "상주시", "47280": "문경시", "47290": "경산시",
    "47720": "군위군", "47730": "의성군", "47750": "청송군", "47760": "영양군",
    "47770": "영덕군", "47820": "청도군", "47830": "고령군", "47840": "성주군",
    "47850": "칠곡군", "47900": "예천군", "47920": "봉화군", "47930": "울진군",
    "47940": "울릉군",
}

# Romanised place names that a question may use (fixed values).
ENGLISH_NAMES = {
    "pohang": "포항시", "gyeongju": "경주시", "gimcheon": "김천시", "andong": "안동시",
    "gumi": "구미시", "yeongju": "영주시", "yeongcheon": "영천시", "sangju": "상주시",
    "mungyeong": "문경시", "gyeongsan": "경산시", "uiseong": "의성군", "cheongsong": "청송군",
    "yeongyang": "영양군", "yeongdeok": "영덕군", "cheongdo": "청도군", "goryeong": "고령군",
    "seongju": "성주군", "chilgok": "칠곡군", "yecheon": "예천군", "bonghwa": "봉화군",
    "uljin": "울진군", "ulleung": "울릉군",
}

LEVELS = ("sgg", "emd", "raw")

_TOWN = "[가-힣]{1,7}(?:읍|면|동)"
_TOWN_END = rf"(?={SPACE_CLASS}|$|[,(\d])"


def _alternation(words) -> str:
    return "(" + "|".join(re.escape(word) for word in words) + ")"


def _first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])


@dataclass(frozen=True)
class Gazetteer:
    """Names, codes and foreign spellings of the places one deployment cares about.

    A gazetteer is configuration: some hundreds of names at most, so it is compiled into
    the expressions instead of being joined.
    """

    names: tuple[str, ...] = CITY_NAMES
    codes: dict[str, str] = field(default_factory=lambda: dict(CITY_CODES))
    english: dict[str, str] = field(default_factory=lambda: dict(ENGLISH_NAMES))
    allow_stem: bool = True

    @property
    def stems(self) -> dict[str, str]:
        return {name[:-1]: name for name in self.names}

    def full_name_in(self, value: Column | str) -> Column:
        """The leftmost full place name inside a text, or NULL."""
        return _first_match(as_column(value), _alternation(self.names))

    @cached_property
    def _stem_hit(self) -> str:
        """A stem that stands for its city: not followed by a name suffix."""
        return f"(?:{'|'.join(map(re.escape, self.stems))})(?![시군])" if self.allow_stem else "(?!)"

    @cached_property
    def _city_pattern(self) -> str:
        """Group 1 is the code, full name or stem that decides the city, in this order."""
        names, stems = "|".join(map(re.escape, self.names)), "|".join(map(re.escape, self.stems))
        return (
            rf"(?sU)^(?:{SPACE_CLASS}*(?=\d{{5,10}}{SPACE_CLASS}*$)|.*?(?=(?:{names}))|.*?(?={self._stem_hit}))"
            rf"(\d{{5}}|{names}|{stems})"
        )

    @cached_property
    def _town_pattern(self) -> str:
        """Group 3 is the eight-digit code, or the first town name after the city's stem."""
        full = "|".join(f"{re.escape(name[:-1])}(?={re.escape(name[-1])})" for name in self.names)
        return (
            rf"(?sU)^(?:{SPACE_CLASS}*(?=\d{{8,10}}{SPACE_CLASS}*$)"
            rf"|(?=.*?({full})|.*?({self._stem_hit}))(?>.*?(?:\1|\2))"
            rf"(?:(?:시|군){SPACE_CLASS}*(?:남구|북구)?{SPACE_CLASS}*)?+.*?(?={_TOWN}{_TOWN_END}))"
            rf"(\d{{8}}|{_TOWN}{_TOWN_END})"
        )

    @cached_property
    def _bare_town_pattern(self) -> str:
        """Group 1 is the value itself when it is one town name without any city."""
        return (
            rf"(?sU)^(?!.*(?:{'|'.join(map(re.escape, self.names))}|{self._stem_hit}))"
            rf"{SPACE_CLASS}*({_TOWN}){SPACE_CLASS}*$"
        )

    @cached_property
    def _city_of_token(self) -> dict[str, str]:
        return {**self.codes, **self.stems, **{name: name for name in self.names}}

    def city(self, value: Column | str) -> Column:
        """City key: known code, else full name, else stem; NULL when nothing matches."""
        token = F.regexp_extract(as_column(value), self._city_pattern, 1)
        return _lookup(self._city_of_token)[token]

    def town(self, value: Column | str, default: Column | str | None = None) -> Column:
        """Town key ``city|town``.

        ``default`` (a place name as text, or a column) completes a value that is a bare
        town name without any city.
        """
        text = as_column(value)
        named = F.concat(self.city(text), F.lit("|"), _first_match(text, self._town_pattern, 3))
        if default is None:
            return named
        home = F.lit(default) if isinstance(default, str) else default
        bare = _first_match(text, self._bare_town_pattern)
        return F.coalesce(named, F.concat(home, F.lit("|"), bare))

    def key(self, value: Column | str, level: str, default: Column | str | None = None) -> Column:
        """Key of a column at a level; any level other than the two named ones is raw."""
        if level == "sgg":
            return self.city(value)
        if level == "emd":
            return self.town(value, default)
        return as_column(value).cast("string")

    def default_region(self, provider: Column | str, title: Column | str) -> Column:
        """The single place a dataset belongs to: named by its provider, else its title."""
        return F.coalesce(self.full_name_in(provider), self.full_name_in(title))

    def question_region(self, question: Column | str) -> Column:
        """The place a question mentions: full name, bare stem or English spelling."""
        words = _alternation([*self.names, *self.stems, *self.english])
        hit = F.regexp_extract(as_column(question), "(?i)" + words, 1)
        names = {**{name: name for name in self.names}, **self.stems, **self.english}
        return _lookup(names)[F.lower(hit)]
