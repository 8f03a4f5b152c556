"""Name fields, addresses, and the veto on names that a model proposes (SCN16-17, GAT11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions import addresses as notation
from maskloom.functions import vocab as V
from maskloom.functions.kernel import before, chained, find, let, matches, none_of, piece
from maskloom.functions.spans import SPAN, span

NAME_REACH, FIELD_REACH = 600, 120
_DELIMITED = "[:=：]"


def _placeholder(value: Column) -> Column:
    compact = F.regexp_replace(value, r"[\s\p{Z}]+", "")
    return compact.isin(*V.ROLE_PLACEHOLDERS) | compact.rlike(V.ROLE_ORGANIZATION)


def _unlabelled(view: Column, label: Column) -> Column:
    """A label without a delimiter that does not lead its line: a word in prose."""
    near = label["b"].rlike(r"[^\s\p{Z}*•>-][^\n]*\z")  # something else stands close before it in the line
    ahead = F.when(near | label["b"].contains("\n"), label["b"]).otherwise(F.when(label["s"] == 0, "").otherwise(piece(view, F.lit(0), label["s"])))
    line = F.trim(F.regexp_extract(ahead, r"[^\n]*\z", 0))
    return ~label["v"].rlike(_DELIMITED) & ~F.regexp_replace(line, r"\A[\s\p{Z}]+|[\s\p{Z}]+\z", "").isin(*V.LINE_LEADS)


def _trimmed(value: Column) -> Column:
    """Without an honorific."""
    bare = F.regexp_replace(value, V.HONORIFIC, "")
    short = (bare == value) & (F.length(value) >= 4) & value.rlike(r"[님씨]\z")
    return F.when(short, F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(bare)


def _name_after(view: Column, label: Column) -> Column:
    """The field's value as array of at most one span."""

    def judge(found: Column) -> Column:
        value, name, after = found["value"], found["name"], found["after"]
        instruction = value.rlike(V.INSTRUCTION) | (
            ~label["v"].rlike(_DELIMITED) & value.rlike(rf"\A{V.ACTION}(?:[ \t]|\z)"))
        words = F.split(F.lower(name), r"[\s\p{Z}]+")
        refused = (
            (F.length(F.replace(name, F.lit(" "), F.lit(""))) < 2) | F.lower(name).isin(*V.NOT_NAMES)
            | F.exists(words, lambda w: w.isin(*V.NOT_NAMES)) | name.rlike(V.NOT_NAME_ENDS)
            | (label["v"].rlike(V.ROLE_FIELD) & _placeholder(name))
        )
        fits = (value != "") & ~after.rlike(r"\A[\p{L}\p{N}_\-@·]") & ~instruction & ~refused
        end = label["e"] + F.length(name)
        named = span(F.lit("KR_NAME"), F.lit(V.PRIORITY["KR_NAME"]), label["e"], end, F.lit(V.SCORE["name"]))
        return F.when(fits, F.array(named)).otherwise(none_of(SPAN))

    def cut(window: Column) -> Column:
        near = F.substring(window, F.lit(1), F.lit(FIELD_REACH))
        next_field = rf"(?s)\A(.*?)(?:{V.NEXT_FIELD})"
        region = F.when(near.rlike(next_field), F.regexp_extract(near, next_field, 1)).otherwise(window)
        value = F.regexp_extract(region, rf"\A(?:{V.NAME_VALUE})", 0)
        return let(value, lambda v: let(F.struct(
            v.alias("value"), _trimmed(v).alias("name"), F.substring(window, F.length(v) + 1, F.lit(1)).alias("after")), judge))

    owned = F.substring(label["b"], F.lit(-15), F.lit(15)).rlike(V.NON_PERSON_OWNER)
    return F.when(owned | _unlabelled(view, label), none_of(SPAN)).otherwise(
        let(piece(view, label["e"], NAME_REACH), cut))


def name_fields(text: Column, view: Column) -> Column:
    """Names in explicit fields. ``view`` is the text in pages."""
    return F.flatten(F.transform(find(text, V.NAME_LABEL), lambda label: _name_after(view, label)))


def _addresses(text: Column, view: Column, pattern: str, score: float) -> Column:
    def quantity(hit: Column) -> Column:
        after = piece(view, hit["e"], 3)
        return after.rlike(r"\A[가-힣]") & ~after.rlike(V.ADDRESS_PARTICLE)

    kept = F.filter(find(text, pattern, group=True), lambda hit: ~quantity(hit))
    return F.transform(kept, lambda hit: span(
        F.lit("KR_ADDRESS"), F.lit(V.PRIORITY["KR_ADDRESS"]), hit["e"] - F.length(hit["g"]), hit["e"], F.lit(score)))


def addresses(text: Column, view: Column) -> Column:
    """Addresses by grammar; where both patterns find the same span the labelled one stands."""
    full = _addresses(text, view, notation.FULL, V.SCORE["address"])
    labelled = _addresses(text, view, notation.LABELLED, V.SCORE["address_labeled"])
    same = lambda x, y: (x["s"] == y["s"]) & (x["e"] == y["e"])
    return let(labelled, lambda second: chained(
        F.filter(full, lambda x: ~F.exists(second, lambda y: same(x, y))), second))


def contextual_name(view: Column, s: Column, e: Column) -> Column:
    """Whether nothing explicit speaks against a name that a model found at [s, e)."""
    value = piece(view, s, e - s)
    left = before(view, s, 40)
    shaped = value.rlike(r"\p{L}") & matches(value, r"[\p{L}\p{M} .·'’\-\t]+")
    owner = rf"{V.NON_PERSON_OWNER[:-2]}{V.NAME_LABEL.replace('(?<![가-힣A-Za-z0-9_])', '')}\z"
    relation = piece(view, s, (e - s) + 24).rlike(V.NAMED_OBJECT) & (
        F.length(F.regexp_extract(piece(view, s, (e - s) + 24), rf"(?s)\A(.*?)(?:{V.NAMED_OBJECT})", 1)) <= e - s)
    return (
        shaped & ~F.lower(value).isin(*V.NOT_NAMES) & ~value.rlike(V.INSTRUCTION) & ~left.rlike(V.NON_PERSON_FIELD)
        & ~before(view, s, 70).rlike(owner) & ~(_placeholder(value) & left.rlike(V.ROLE_FIELD)) & ~relation
    )
