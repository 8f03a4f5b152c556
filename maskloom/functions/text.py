"""Unicode folding that keeps offsets into the untouched text (NRM1-7)."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions import vocab as V
from maskloom.functions.kernel import find, let, none_of, running

CUT = "struct<at:int,n:int>"
_NEIGHBOUR = r"[A-Za-z0-9@._+\-]"
_RUN = rf"(?<={_NEIGHBOUR})[{V.INVISIBLE}]+(?={_NEIGHBOUR})"
_UNUSUAL = rf"[[^\x00-\x7F가-힣]&&[！-～{V.DASHES}{V.SPACES}{V.INVISIBLE}\p{{Nd}}]]"


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Code points that fold and what they become, one for one."""
    pairs = {chr(c): chr(c - V.FULLWIDTH_SHIFT) for c in range(V.FULLWIDTH_FIRST, V.FULLWIDTH_LAST + 1)}
    pairs |= dict.fromkeys(V.DASHES, "-") | dict.fromkeys(V.SPACES, " ")
    for code in range(128, sys.maxunicode + 1):
        if unicodedata.category(chr(code)) == "Nd":
            pairs[chr(code)] = str(unicodedata.decimal(chr(code)))
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Full-width ASCII, hyphens, fixed spaces and decimal digits as ASCII; same length."""
    source, target = fold_table()
    needed = rf"[[^\x00-\x7F가-힣]&&[！-～{V.DASHES}{V.SPACES}\p{{Nd}}]]"  # most characters fail the first, cheap part
    return F.when(text.rlike(needed), F.translate(text, source, target)).otherwise(text)


def squeeze(folded: Column) -> Column:
    """Folded text without invisible runs between identifier characters."""
    return F.when(folded.rlike(f"[{V.INVISIBLE}]"), F.regexp_replace(folded, _RUN, "")).otherwise(folded)


def cuts(folded: Column) -> Column:
    """Removed runs as array<struct<at,n>>: the position in the squeezed text, and the length."""
    def placed(hits: Column) -> Column:
        gone = running(F.transform(hits, lambda h: h["e"] - h["s"]), 0, lambda a, b: a + b)
        return let(gone, lambda g: F.transform(hits, lambda h, i: F.struct((h["s"] - F.get(g, i)).alias("at"), (h["e"] - h["s"]).alias("n"))))

    some = let(find(folded, _RUN), lambda hits: F.when(F.size(hits) == 0, none_of(CUT)).otherwise(placed(hits)))
    return F.when(folded.rlike(f"[{V.INVISIBLE}]"), some).otherwise(none_of(CUT))


def original(position: Column, removed: Column) -> Column:
    """The offset in the untouched text of a character of the squeezed one."""
    before = F.filter(removed, lambda cut: cut["at"] <= position)
    return F.when(F.size(removed) == 0, position).otherwise(position + F.aggregate(before, F.lit(0), lambda total, cut: total + cut["n"]))


def unusual(text: Column) -> Column:
    """Whether folding or squeezing may change the text: one search, where each of them needs its own."""
    return text.rlike(_UNUSUAL)


def normalize(text: Column) -> Column:
    return F.when(unusual(text), squeeze(fold(text))).otherwise(text)


def positions(text: Column) -> Column:
    """For each character of the normalised text its offset in ``text``; null where all are unchanged.

    Between two cuts all move alike, so the text is read once, whatever its length and number of cuts.
    """
    def every(view: Column) -> Column:
        removed, size = view["removed"], view["size"]
        at = lambda k, ends: F.coalesce(F.get(removed, k)["at"], ends)
        between = lambda gone, k: F.transform(F.sequence(at(k - 1, F.lit(0)), at(k, size) - 1), lambda i: i + gone)
        gone = running(F.transform(removed, lambda cut: cut["n"]), 0, lambda a, b: a + b)
        return F.when(F.size(removed) > 0, F.flatten(F.transform(gone, between)))

    return let(fold(text), lambda folded: let(F.struct(cuts(folded).alias("removed"), F.length(squeeze(folded)).alias("size")), every))


def fingerprint(text: Column, normalized: bool = False) -> Column:
    """SHA-256 of the text, or of what it normalises to."""
    return F.sha2(normalize(text) if normalized else text, 256)


def json_fingerprint(document: Column) -> Column:
    """SHA-256 of a JSON document with sorted keys and no blanks."""
    return F.sha2(F.to_json(F.parse_json(document)), 256)
