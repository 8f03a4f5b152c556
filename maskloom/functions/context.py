"""Korean context words before a candidate (CTX0-2, FN8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions import vocab as V
from maskloom.functions.kernel import any_word, let

_PLAIN = rf"(?<![A-Za-z0-9]){any_word(V.ACCOUNT_WORDS)}"
_PLACED = rf"(?<![\p{{L}}\p{{N}}]){any_word(V.ACCOUNT_AMBIGUOUS)}(?=(?:은행)?[\s\p{{Z}}:：=\[\]()]*\z)"
_LAST_WORD = rf"(?s)\A(.*)(?:{_PLAIN}|{_PLACED})"
_LAST_BLOCKER = rf"(?s)\A(.*){any_word(V.ACCOUNT_BLOCKERS)}"


def clause(ahead: Column) -> Column:
    """Of the text before a candidate, at most ``WINDOW`` characters, what stands in its clause."""
    ended = F.regexp_extract(ahead, rf"[^{V.CLAUSE_END}]*\z", 0)
    return F.when(ahead.rlike(f"[{V.CLAUSE_END}]"), ended).otherwise(ahead)


def has_word(prefix: Column, entity: str) -> Column:
    """Whether the clause holds one of the entity's words."""
    words = V.KEYWORDS[entity]
    kept = [w for w in words if not any(o != w and o in w for o in words)]  # a contained word decides alone
    return reduce(lambda a, b: a | b, (F.contains(prefix, F.lit(w)) for w in kept))


def _last(prefix: Column, pattern: str) -> Column:
    """Where the last match starts; -1 without any (the greedy prefix is its position)."""
    return F.when(prefix.rlike(pattern), F.length(F.regexp_extract(prefix, pattern, 1))).otherwise(-1)


def account_context(prefix: Column) -> Column:
    """struct<has, blocked>: whether the nearest label speaks for an account, or against one."""
    places = F.struct(_last(prefix, _LAST_WORD).alias("yes"), _last(prefix, _LAST_BLOCKER).alias("no"))
    return let(places, lambda at: F.struct(
        ((at["yes"] >= 0) & (at["yes"] > at["no"])).alias("has"), ((at["no"] >= 0) & (at["no"] > at["yes"])).alias("blocked")))


def nearest_bank(prefix: Column) -> Column:
    """The bank label that starts last in the clause; null without one."""
    pattern = rf"(?s)\A.*({any_word(V.BANK_LABELS)})"
    return F.nullif(F.regexp_extract(prefix, pattern, 1), F.lit(""))


def has_context(prefix: Column, entity: Column) -> Column:
    """Whether the clause speaks for the candidate's entity."""
    out = account_context(prefix)["has"]
    for name in V.KEYWORDS:
        out = F.when(entity == name, has_word(prefix, name)).otherwise(out)
    return out


def boosted(score: Column, wanted: Column) -> Column:
    return F.when(wanted, F.least(F.lit(1.0), F.round(score + V.BOOST, 10))).otherwise(score)
