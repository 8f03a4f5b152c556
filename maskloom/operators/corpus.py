"""Corpus preparation: sampling, splits, deduplication, contamination, conversions (SEL4-5, SEL10, WIN6-8, JOI10-15, SET4, SET8, PRE*)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions import text as texts


MAX_TEMPLATES = 10_000


def hash_rank(key: Column, salt: str = "") -> Column:
    """The order of a salted, reproducible draw."""
    return F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)


def hash_sample(rows: DataFrame, key: str, count: int, salt: str = "") -> DataFrame:
    """The first ``count`` rows by salted hash (SEL4); a distributed top-k, not a sort."""
    if count < 1:
        raise ValueError("count must be positive")
    return rows.orderBy(hash_rank(F.col(key), salt), key).limit(count)


def first_ids(rows: DataFrame, key: str, count: int) -> DataFrame:
    return rows.select(key).orderBy(key).limit(count)


def rank_in_stratum(rows: DataFrame, strata: Iterable[str], key: str, rank: int = 0) -> DataFrame:
    """Of each stratum the row at ``rank`` by hashed key (WIN6)."""
    ordered = Window.partitionBy(*strata).orderBy(hash_rank(F.col(key)), key)
    return rows.withColumn("__n", F.row_number().over(ordered)).where(F.col("__n") == rank + 1).drop("__n")


def fraction_split(rows: DataFrame, source: str, key: str, fraction: float, salt: str = "") -> DataFrame:
    """``split``: the first int(n * fraction) rows of each source by salted hash are validation (SEL5).

    Counts by hash prefix tell which prefix holds a source's last validation row, so only
    the rows of that one prefix are ranked: a source with a third of all rows is never
    sorted in one task. A null source is a source of its own.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    hashed = rows.withColumn("__h", hash_rank(F.col(key), salt)).withColumn("__p", F.substring("__h", 1, 3))
    counts = hashed.groupBy(F.col(source).alias("__s"), "__p").agg(F.count("*").alias("__c"))
    ordered = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = counts.withColumn("__to", F.sum("__c").over(ordered)).withColumn(
        "__k", F.floor(F.sum("__c").over(Window.partitionBy("__s")) * F.lit(fraction)))
    edge = reach.where(F.col("__to") > F.col("__k")).groupBy("__s").agg(
        F.min(F.struct("__p", (F.col("__k") - F.col("__to") + F.col("__c")).alias("left"))).alias("__e"))
    marked = hashed.join(edge, F.col(source).eqNullSafe(F.col("__s")))
    inside = marked.where(F.col("__p") == F.col("__e.__p")).withColumn(
        "__n", F.row_number().over(Window.partitionBy(source, "__p").orderBy("__h", key)))
    named = lambda df, ok: df.select(*rows.columns, F.when(ok, "validation").otherwise("train").alias("split"))
    return named(inside, F.col("__n") <= F.col("__e.left")).unionByName(
        named(marked.where(F.col("__p") != F.col("__e.__p")), F.col("__p") < F.col("__e.__p")))


def dedup_by_priority(rows: DataFrame, text: str, order: Iterable[Column | str], label: str | None = None) -> DataFrame:
    """One row of each text, by priority; texts whose rows disagree on ``label`` are dropped (WIN7, PRE2-3)."""
    hashed = rows.withColumn("__h", texts.fingerprint(F.col(text)))
    if label is not None:
        clash = hashed.groupBy("__h").agg(F.min(label).alias("a"), F.max(label).alias("b")).where(F.col("a") != F.col("b"))
        hashed = hashed.join(clash.select("__h"), "__h", "left_anti")
    ordered = Window.partitionBy("__h").orderBy(*order)
    return hashed.withColumn("__n", F.row_number().over(ordered)).where(F.col("__n") == 1).drop("__n", "__h")


def conflicts(rows: DataFrame, text: str, key: str, label: str) -> DataFrame:
    """(text_sha256, key) of the rows whose text carries more than one label, one row each."""
    hashed = rows.withColumn("text_sha256", texts.fingerprint(F.col(text)))
    clash = hashed.groupBy("text_sha256").agg(F.min(label).alias("a"), F.max(label).alias("b")).where(F.col("a") != F.col("b"))
    return hashed.join(clash.select("text_sha256"), "text_sha256", "left_semi").select("text_sha256", key)


def dedup_by_signatures(rows: DataFrame, text: str, signatures: Iterable[str], order: Iterable[Column | str], excluded: DataFrame | None = None) -> DataFrame:
    """One row of each text, by priority (PRE3). Texts whose rows disagree on any signature are dropped
    (null is no opinion), and so are texts whose hash, as they are or normalised, ``excluded`` has in column h."""
    hashed = rows.withColumn("__h", texts.fingerprint(F.col(text)))
    if excluded is not None:
        banned = excluded.select(F.col("h").alias("__b")).distinct()
        normal = hashed.withColumn("__n", texts.fingerprint(F.col(text), normalized=True))
        hashed = normal.join(banned, F.col("__h") == F.col("__b"), "left_anti").join(banned, F.col("__n") == F.col("__b"), "left_anti").drop("__n")
    names = list(signatures)
    views = hashed.groupBy("__h").agg(*(F.min(n).alias(f"a{i}") for i, n in enumerate(names)), *(F.max(n).alias(f"b{i}") for i, n in enumerate(names)))
    clash = F.lit(False)
    for i in range(len(names)):
        clash = clash | F.coalesce(F.col(f"a{i}") != F.col(f"b{i}"), F.lit(False))
    kept = hashed.join(views.where(clash).select("__h"), "__h", "left_anti")
    ordered = Window.partitionBy("__h").orderBy(*order)
    return kept.withColumn("__n", F.row_number().over(ordered)).where(F.col("__n") == 1).drop("__n", "__h")


def manifest(rows: DataFrame, by: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """Rows of each part of a corpus and a digest of them that no order changes (PRE8): the sum of the
    first 60 bits of each row's SHA-256 over the columns, a null standing as nothing between separators."""
    line = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    bits = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(bits).cast("string").alias("digest"))


def next_version(old: DataFrame, fresh: DataFrame, text: str, retire: str, freeze: str) -> DataFrame:
    """A corpus's next version (PRE10): rows of the split ``retire`` become training rows, and fresh rows
    whose text the corpus does not have form the new split ``freeze``."""
    kept = old.withColumn("split", F.when(F.col("split") == retire, "train").otherwise(F.col("split")))
    known = old.select(texts.fingerprint(F.col(text), normalized=True).alias("__h")).distinct()
    new = fresh.withColumn("__h", texts.fingerprint(F.col(text), normalized=True)).join(known, "__h", "left_anti")
    first = Window.partitionBy("__h").orderBy(*(c for c in fresh.columns if c != text))
    new = new.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1).drop("__n", "__h")
    return kept.unionByName(new.withColumn("split", F.lit(freeze)).select(*old.columns))


def reserve_unique(reserve: DataFrame, consumed: DataFrame, text: str = "text") -> DataFrame:
    """Reserve rows (domain, position, id, text) with a verdict: already consumed, repeated, or selected (WIN8).

    Equal texts normalise equally, so the first of each normalised text that is not
    consumed is the one selected. Rows without a text have no verdict.
    """
    # never null: else the joins infer a filter that hashes every text in the scan, before rows are dealt out
    h = F.coalesce(texts.fingerprint(F.col(text), normalized=True), F.lit(""))
    used = consumed.where(F.col(text).isNotNull()).select(h.alias("h")).distinct().withColumn("used", F.lit(True))
    rows = reserve.where(F.col(text).isNotNull()).withColumn("h", h)
    firsts = rows.groupBy("h").agg(F.min(F.struct("domain", "position", "id")).alias("first"))  # combined before the shuffle
    judged = rows.join(firsts, "h").join(used, "h", "left")
    again = F.struct("domain", "position", "id") != F.col("first")
    verdict = F.when(F.col("used"), "consumed").when(again, "reserve_duplicate").otherwise("selected")
    return judged.withColumn("verdict", verdict).withColumn(
        "duplicate_of", F.when(verdict == "reserve_duplicate", F.struct("first.domain", "first.id"))).drop("h", "used", "first")


def contaminated(rows: DataFrame, held_out: DataFrame, text: str = "text", anti: bool = False) -> DataFrame:
    """Rows whose exact or normalised text is also held out (JOI10), or with ``anti`` the others (JOI11)."""
    marks = held_out.select(F.explode(F.array(texts.fingerprint(F.col(text)), texts.fingerprint(F.col(text), True))).alias("h")).distinct()
    hashed = rows.withColumn("__exact", texts.fingerprint(F.col(text))).withColumn("__norm", texts.fingerprint(F.col(text), True))
    if anti:
        left = hashed.join(marks.withColumnRenamed("h", "__exact"), "__exact", "left_anti")
        return left.join(marks.withColumnRenamed("h", "__norm"), "__norm", "left_anti").select(*rows.columns)
    flagged = marks.withColumn("__hit", F.lit(True))
    both = hashed.join(flagged.select(F.col("h").alias("__exact"), F.col("__hit").alias("__a")), "__exact", "left").join(
        flagged.select(F.col("h").alias("__norm"), F.col("__hit").alias("__b")), "__norm", "left")
    return both.where(F.col("__a") | F.col("__b")).select(*rows.columns)


def split_overlaps(rows: DataFrame, split: str, columns: Iterable[str]) -> DataFrame:
    """Values that occur in more than one split, counted by column (SET4)."""
    names = list(columns)
    long = rows.select(split, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in names))).alias("x"))
    shared = long.select(split, "x.field", "x.value").where("value is not null").groupBy("field", "value").agg(
        F.count_distinct(split).alias("n")).where(F.col("n") > 1)
    return shared.groupBy("field").agg(F.count("*").alias("shared"))


def remaining(population: DataFrame, consumed: DataFrame, key: str) -> DataFrame:
    """The population without what was consumed (SET8)."""
    return population.join(consumed.select(key).distinct(), key, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences between two tables as multisets: empty when shards reassemble exactly (JOI15, EVL11)."""
    names = a.columns
    tag = lambda df, n: df.select(*names, F.lit(n).alias("__d"))
    return tag(a, 1).unionByName(tag(b, -1)).groupBy(*names).agg(F.sum("__d").alias("surplus")).where(F.col("surplus") != 0)


def select_records(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the wanted ids (``key``, ``position``) in their order; a missing id fails (SRC11)."""
    found = ids.join(rows, key, "left").withColumn("__there", F.lit(True) if set(rows.columns) == {key} else F.coalesce(
        *(F.when(F.col(c).isNotNull(), F.lit(True)) for c in rows.columns if c != key), F.lit(False)))
    checked = found.withColumn(key, F.when(F.col("__there"), F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit("Selected record is missing: "), F.col(key).cast("string"))).cast(dict(rows.dtypes)[key])))
    return checked.drop("__there").orderBy("position")


def offset_slice(lines: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Rows [offset, offset + limit) in order (SRC14)."""
    return lines.orderBy(order).offset(offset).limit(limit)


def cross_templates(surfaces: DataFrame, templates: DataFrame) -> DataFrame:
    """Each surface in each template, with the gold span (PRE9). Templates hold one ``{}``. The crossing
    is the feature; templates are a written list, so more than ``MAX_TEMPLATES`` of them fail."""
    listed = templates.take(MAX_TEMPLATES + 1)
    if len(listed) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    pairs = surfaces.join(F.broadcast(templates))
    at = F.locate("{}", F.col("template")) - 1
    return pairs.select(
        "*", F.replace("template", F.lit("{}"), F.col("surface")).alias("text"), at.alias("start"), (at + F.length("surface")).alias("end"))


def convert_spans(rows: DataFrame, mapping: dict[str, str], ignored: Iterable[str]) -> DataFrame:
    """Source spans to gold and ignore spans (PRE4-6). ``rows``: id, text, spans array<struct<start,end,category,surface>>.

    Mapped categories become gold unless their surface is fully masked already; those
    and the ignored categories become ignore spans. A span that does not fit fails.
    """

    def entity_of(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for category, entity in mapping.items():
            out = F.when(s["category"] == category, entity).otherwise(out)
        return out

    masked = lambda s: s["surface"].rlike(r"\A(?:\**|<[A-Z][A-Z0-9_]*>)\z")
    fits = F.forall("spans", lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length("text")) & (
        F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) == s["surface"]))
    gold = F.transform(F.filter("spans", lambda s: entity_of(s).isNotNull() & ~masked(s)), lambda s: F.struct(
        entity_of(s).alias("entity"), s["start"].alias("start"), s["end"].alias("end")))
    skip = F.transform(F.filter("spans", lambda s: s["category"].isin(*ignored) | (entity_of(s).isNotNull() & masked(s))), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end")))
    checked = rows.withColumn("text", F.when(fits, F.col("text")).otherwise(F.raise_error(F.lit("A source span does not fit its text"))))
    return checked.select("id", "text", gold.alias("entities"), skip.alias("ignore"))


def spans_to_record(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Gold spans as typed JSON fields (PRE7): {field name of the entity: surface}."""
    named = reduce(lambda out, item: F.when(F.col("x.entity") == item[0], item[1]).otherwise(out), fields.items(), F.col("x.entity"))
    long = rows.select("id", "text", F.posexplode("entities").alias("n", "x"))
    cells = long.select("id", "n", named.alias("field"), F.expr("substring(text, x.start + 1, x.end - x.start)").alias("surface"))
    kept = cells.groupBy("id", "field").agg(F.min_by("surface", "n").alias("surface"))
    return kept.groupBy("id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "surface"))))).alias("record"))


def corpus_counts(rows: DataFrame) -> DataFrame:
    """Rows, positives, negatives, distinct surfaces and contexts by track (AGG21)."""
    return rows.groupingSets([[], [F.col("track")]], "track").agg(
        F.count("*").alias("rows"), F.count_if("positive").alias("positive"), F.count_if(~F.col("positive")).alias("negative"),
        F.count_distinct("surface").alias("surfaces"), F.count_distinct("context").alias("contexts"))


def case_key(text: Column, spans: Column) -> Column:
    """SHA-256 of a case's text and sorted spans (FN19)."""
    return F.sha2(F.to_json(F.struct(text.alias("text"), F.array_sort(spans).alias("spans"))), 256)
