"""The notation of Korean road and lot addresses as small state tables, and the patterns made of them.

An address is written from large to small: region (province, one or two districts), town,
then either a road with a building number or a place with a lot number, then in either
order the unit inside a building and a note in brackets. Each part is a table: from a
state, which words may come, what sets them off from what follows, and which state is
next; earlier rows go first. Words are token shapes; a row without a word skips.
"""

from __future__ import annotations

import re

from maskloom.functions import vocab as V

_BLANKS = r"[ \t]{0,16}"
_LINE = rf"{_BLANKS}\r?\n{_BLANKS}"
SET_OFF = {
    "": "",
    "blanks": _BLANKS,  # none or some
    "apart": rf"(?:[ \t]{{1,16}}|{_LINE})",  # some, or a line break
    "loose": rf"(?:{_BLANKS}|{_LINE})",
    "listed": rf"(?:[ \t,]{{0,16}}|{_LINE})",  # commas too
    "comma or apart": rf"(?:{_BLANKS},{_BLANKS}|[ \t]{{1,16}}|{_LINE})",
}

#: Shapes of tokens: a stem of some length in some characters, and its ending.
WORDS = {
    "": "",
    "province": "(?:" + "|".join(sorted(map(re.escape, V.PROVINCES), key=len, reverse=True)) + ")",
    "sejong": "(?:" + "|".join(p for p in V.PROVINCES if p.startswith("세종")) + ")",
    "district": "[가-힣]{1,12}[시군구]",
    "town": "[가-힣0-9·]{1,12}[읍면]",
    "road": "[가-힣0-9·.]{1,30}(?:대로|로|길)",
    "place": "[가-힣0-9·]{1,15}[동리가]",
    "number": "[1-9][0-9]{0,4}(?:-[0-9]{1,4})?",
    "below ground": "지하",
    "hill": "산",
    "lot": "번지",
    "building": "[가-힣A-Za-z0-9]{1,24}(?:아파트|빌라|오피스텔|빌딩)",
    "block": "(?:[0-9]{1,5}|[A-Z])동",
    "floor": rf"(?:지하{_BLANKS}|B)?[0-9]{{1,4}}층",
    "door": "[0-9]{1,5}호",
    "open": r"\(",
    "close": r"\)",
    "comma": ",",
    "name": "[가-힣A-Za-z0-9·]{1,30}",
}

UNITS = ("block", "floor", "door")
Row = tuple[str, str, str]
#: part -> state -> rows of (word or part, what sets it off from what follows, next state)
PARTS: dict[str, dict[str, tuple[Row, ...]]] = {
    "districts": {"start": (("district", "apart", "second"),), "second": (("district", "apart", "end"), ("", "", "end"))},
    "region": {"start": (("province", "apart", "districts"), ("sejong", "apart", "end")), "districts": (("districts", "", "end"),)},
    "known region": {"start": (("province", "apart", "districts"), ("", "", "districts")), "districts": (("districts", "", "end"), ("", "", "end"))},
    "town, if any": {"start": (("town", "apart", "end"), ("", "", "end"))},
    "site": {
        "start": (("road", "apart", "on road"), ("place", "apart", "in place")),
        "on road": (("below ground", "blanks", "house"), ("", "", "house")), "house": (("number", "", "end"),),
        "in place": (("hill", "blanks", "parcel"), ("", "", "parcel")), "parcel": (("number", "", "parcel end"),),
        "parcel end": (("lot", "", "end"), ("", "", "end"))},
    "unit": {"start": tuple((u, "", "end") for u in UNITS)},
    "further unit": {"start": (("", "listed", "unit"),), "unit": (("unit", "", "end"),)},
    "inside": {
        "start": (("", "comma or apart", "building"),), "building": (("building", "apart", "first"), ("", "", "first")),
        "first": (("unit", "", "more"),), "more": (("further unit", "", "last"), ("", "", "end")), "last": (("further unit", "", "end"), ("", "", "end"))},
    "note": {
        "start": (("", "loose", "open"),), "open": (("open", "blanks", "what"),), "what": (("place", "", "named"), ("building", "blanks", "close")),
        "named": (("", "blanks", "comma"),), "comma": (("comma", "blanks", "name"), ("", "", "close")), "name": (("name", "blanks", "close"),),
        "close": (("close", "", "end"),)},
    "rest": {
        "start": (("inside", "", "then note"), ("note", "", "then inside"), ("", "", "end")),
        "then note": (("note", "", "end"), ("", "", "end")), "then inside": (("inside", "", "end"), ("", "", "end"))},
}


def spelt(part: str, state: str = "start") -> str:
    """The pattern of a part from a state on."""
    if state == "end":
        return ""
    ways = [(spelt(word) if word in PARTS else WORDS[word]) + SET_OFF[off] + spelt(part, after) for word, off, after in PARTS[part][state]]
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def address(region: str) -> str:
    return "".join(map(spelt, (region, "town, if any", "site", "rest")))


_BEGIN = "(?<![가-힣A-Za-z0-9_])"
_LABEL = rf"(?:{'|'.join(V.ADDRESS_LABELS)})(?:는|은)?[\"']?{_BLANKS}[:：=]?{_BLANKS}(?:\r?\n{_BLANKS})?[\"']?"
FULL = rf"{_BEGIN}({address('region')}){V.RIGHT}"
LABELLED = rf"{_BEGIN}{_LABEL}({address('known region')}){V.RIGHT}"
