"""Order-dependent operators over labelled characters and lines (WIN9-11, SEL9, PRE1, ML2, ML4, ML14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.kernel import none_of

RUN = "struct<entity:string,start:int,end:int,score:double>"


def runs(rows: DataFrame, value: str, threshold: float, by: str = "doc_id", position: str = "pos") -> DataFrame:
    """Contiguous positions whose value reaches the threshold: start, end, mean (WIN9; gaps and islands)."""
    kept = rows.where(F.col(value) >= threshold)
    island = F.col(position) - F.row_number().over(Window.partitionBy(by).orderBy(position))
    return kept.withColumn("__i", island).groupBy(by, "__i").agg(
        F.min(position).alias("start"), (F.max(position) + 1).alias("end"), F.avg(value).alias("score")).drop("__i")


def decode_tags(rows: DataFrame, threshold: float = 0.0, by: str = "doc_id", position: str = "pos") -> DataFrame:
    """BIO or BIOES tags (tag, score per position) to spans with mean score (WIN10, ML2).

    B and S open a span, so does a change of entity; E and S close it; O ends it.
    """
    ordered = Window.partitionBy(by).orderBy(position)
    mark, entity = F.substring_index("tag", "-", 1), F.when(F.col("tag").contains("-"), F.substring_index("tag", "-", -1))
    tagged = rows.withColumn("__m", mark).withColumn("__e", entity)
    before, closed = F.lag("__e").over(ordered), F.lag("__m").over(ordered).isin("E", "S")
    opens = F.col("__m").isin("B", "S") | ~before.eqNullSafe(F.col("__e")) | F.coalesce(closed, F.lit(False))
    opened = tagged.withColumn("__o", opens.cast("int"))
    island = opened.withColumn("__i", F.sum("__o").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = island.where(F.col("__e").isNotNull()).groupBy(by, "__i", F.col("__e").alias("entity")).agg(
        F.min(position).alias("start"), (F.max(position) + 1).alias("end"), F.avg("score").alias("score"))
    return spans.where(F.col("score") >= threshold).drop("__i")


def spans_to_tags(text: Column, spans: Column) -> Column:
    """The BIO tag of each character (PRE1); ``spans`` is array<struct<entity,start,end>>, disjoint."""

    def tag(i: Column) -> Column:
        over = F.filter(spans, lambda s: (s["start"] <= i) & (i < s["end"]))
        first = F.get(over, F.lit(0))
        return F.when(F.size(over) == 0, "O").when(first["start"] == i, F.concat(F.lit("B-"), first["entity"])).otherwise(
            F.concat(F.lit("I-"), first["entity"]))

    return F.when(F.length(text) == 0, none_of("string")).otherwise(F.transform(F.sequence(F.lit(0), F.length(text) - 1), tag))


def header_documents(lines: DataFrame, header: str = "## ", order: str = "line_no") -> DataFrame:
    """Lines of ``<char>TAB<tag>`` under ``## id TAB ...`` headers as documents: id, text, tags (WIN11, SRC9).

    ``lines`` has file, line_no and line; carrying the header forward is local to a file.
    A line before any header, or an I- tag that continues nothing, fails.
    """
    ordered = Window.partitionBy("file").orderBy(order)
    is_header = F.col("line").startswith(header)
    name = F.when(is_header, F.split_part(F.substring(F.col("line"), F.lit(len(header) + 1), F.length("line")), F.lit("\t"), F.lit(1)))
    carried = lines.withColumn("id", F.last(name, ignorenulls=True).over(ordered)).where(~is_header & (F.col("line") != ""))
    parts = carried.select("file", "id", order, F.split_part("line", F.lit("\t"), F.lit(1)).alias("char"), F.split_part("line", F.lit("\t"), F.lit(2)).alias("tag"))
    inside = Window.partitionBy("file", "id").orderBy(order)
    before = F.coalesce(F.lag("tag").over(inside), F.lit("O"))
    orphan = F.col("tag").startswith("I-") & (F.substring_index(before, "-", -1) != F.substring_index("tag", "-", -1))
    bad = F.col("id").isNull() | orphan | ~F.col("tag").rlike(r"\A(?:O|[BI]-.+)\z")
    checked = parts.withColumn("tag", F.when(bad, F.raise_error(F.concat(F.lit("Bad tag line "), F.col(order).cast("string")))).otherwise(F.col("tag")))
    rows = checked.groupBy("file", "id").agg(F.array_sort(F.collect_list(F.struct(order, "char", "tag"))).alias("all"))
    return rows.select("id", F.array_join(F.transform("all", lambda x: x["char"]), "").alias("text"), F.transform("all", lambda x: x["tag"]).alias("tags"))


def header_ids(lines: DataFrame, header: str = "## ") -> DataFrame:
    """Ids of header lines, without looking at bodies (SRC10)."""
    rest = F.substring(F.col("line"), F.lit(len(header) + 1), F.length("line"))
    return lines.where(F.col("line").startswith(header)).select(F.split_part(rest, F.lit("\t"), F.lit(1)).alias("id"))


def interior_wins(rows: DataFrame, by: list[str], value: list[str]) -> DataFrame:
    """Of overlapping windows' values for a position keep the one deepest inside its window (SEL9, ML14).

    ``rows`` has window_no, left, right (the window's bounds) and pos; the first window wins ties.
    """
    depth = F.least(F.col("pos") - F.col("left"), F.col("right") - 1 - F.col("pos"))
    best = F.max_by(F.struct(*value), F.struct(depth, -F.col("window_no")))
    return rows.groupBy(*by, "pos").agg(best.alias("v")).select(*by, "pos", *(F.col(f"v.{c}") for c in value))


def narrowest_token(chars: DataFrame, tokens: DataFrame) -> DataFrame:
    """For each character the narrowest token that covers it, the earlier one on ties (ML4)."""
    from maskloom.operators.spanjoin import overlap_pairs

    cells = chars.select("doc_id", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    pairs = overlap_pairs(cells, tokens.select("doc_id", "start", "end", "token"))
    return pairs.groupBy("doc_id", F.col("start").alias("pos")).agg(
        F.min_by("token_r", F.struct(F.col("end_r") - F.col("start_r"), F.col("start_r"))).alias("token"))


def lexicon_boost(score: Column, surface: Column, lexicon: list[str], bonus: float = 0.05) -> Column:
    """A higher score for listed surfaces (ML16)."""
    return F.when(surface.isin(*lexicon), F.least(F.lit(1.0), score + bonus)).otherwise(score)
