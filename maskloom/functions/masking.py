"""Replacement of findings (FN1-4, WIN4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions import vocab as V
from maskloom.functions.kernel import let, none_of, pages, piece, running

REDACTION = "struct<entity:string,start:int,end:int,score:double,output_start:int,output_end:int>"
_ALNUM, _OTHER = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"


def partial(value: Column, entity: Column) -> Column:
    """Keep the entity's number of leading letters or digits, but never all of them; keep everything else."""

    def keep(count: int) -> Column:
        head = F.regexp_extract(value, rf"\A(?:{_OTHER}*{_ALNUM}){{{count}}}", 0)
        rest = F.substring(value, F.length(head) + 1, F.length(value))
        hidden = F.concat(head, F.regexp_replace(rest, _ALNUM, "*"))
        fewer = F.regexp_replace(value, rf"{_ALNUM}({_OTHER}*)\z", r"*$1")
        enough = value.rlike(rf"\A(?:{_OTHER}*{_ALNUM}){{{count + 1}}}")
        return F.when(enough, hidden).otherwise(fewer) if count else hidden

    out = keep(V.PARTIAL_DEFAULT)
    for count in sorted(set(V.PARTIAL_KEEP.values())):
        names = [e for e, n in V.PARTIAL_KEEP.items() if n == count]
        out = F.when(entity.isin(names), keep(count)).otherwise(out)
    return out


def replacement(value: Column, entity: Column, style: str) -> Column:
    if style == "tag":
        return F.concat(F.lit("<"), entity, F.lit(">"))
    if style == "stars":
        return F.repeat(F.lit("*"), F.length(value))
    if style == "partial":
        return partial(value, entity)
    raise ValueError(f"Unknown mask style: {style}")


def splice(text: Column, findings: Column, style: str) -> Column:
    """The text with every finding (ordered, disjoint) replaced."""

    def part(view: Column, finding: Column, at: Column) -> Column:
        since = F.when(at == 0, F.lit(0)).otherwise(F.get(findings, at - 1)["end"])
        value = piece(view, finding["start"], finding["end"] - finding["start"])
        kept = F.when(finding["start"] > since, piece(view, since, finding["start"] - since)).otherwise("")
        return F.concat(kept, replacement(value, finding["entity"], style))

    def joined(view: Column) -> Column:
        end = F.get(findings, F.size(findings) - 1)["end"]
        rest = F.length(text) - end
        tail = F.when(rest > 0, piece(view, end, rest)).otherwise("")
        return F.concat(F.array_join(F.transform(findings, lambda f, i: part(view, f, i)), ""), tail)

    return F.when(F.size(findings) == 0, text).otherwise(let(pages(text), joined))


def redactions(text: Column, findings: Column, style: str) -> Column:
    """Source and output coordinates of each replacement, without its value."""

    def grown(view: Column) -> Column:
        return F.transform(findings, lambda f: F.length(replacement(piece(view, f["start"], f["end"] - f["start"]), f["entity"], style)))

    def row(f: Column, size: Column, shift: Column) -> Column:
        begin = f["start"] + shift
        return F.struct(
            f["entity"].alias("entity"), f["start"].alias("start"), f["end"].alias("end"), f["score"].alias("score"),
            begin.alias("output_start"), (begin + size).alias("output_end"))

    def placed(sizes: Column) -> Column:
        change = F.zip_with(findings, sizes, lambda f, n: n - (f["end"] - f["start"]))
        return let(running(change, 0, lambda a, b: a + b), lambda shift: F.transform(
            findings, lambda f, i: row(f, F.get(sizes, i), F.get(shift, i))))

    return F.when(F.size(findings) == 0, none_of(REDACTION)).otherwise(let(let(pages(text), grown), placed))
