"""Personal data and what gives it away (DataFrame functions only).

Base spans come from patterns; matches failing their check are dropped. Beyond them
an information-theoretic step looks for terms that reveal a protected value: with
document counts over the whole corpus, a value e has information content
IC(e) = log2(N / df(e)), and a term t of its documents discloses
PMI(e, t) = log2(N * co(e, t) / (df(e) * df(t))). A term that discloses at least
``disclosure`` of IC(e) gets a span in every document with e; sanitising removes it,
while base spans are generalised to their kind. Every value is estimated, by the
counts as they are: of a value in a single text, the terms found (almost) nowhere else
point to that text and so to the value. ``min_texts`` above 1 leaves out values, and
terms of a value, seen in fewer different texts.

Exact copies of a text are joined before terms are paired with values and count
with their number. Values that stand in the same texts (in one text only, for most) have
equal counts with every term and are estimated as one. A text's terms that are too common
for a value are not paired with it. Groups are combined map-side; what is gathered for
one text is bounded by that text.

Defined results: null text is empty and has no spans; offsets are code points, ends
exclusive; kinds are searched apart, so spans of different kinds may overlap (when
text is rewritten, the earlier and then the longer one wins); terms are runs of
letters and digits of any length, case folded, outside base spans; repeated rows count as documents;
empty input gives empty output. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import named
from maskloom.runtime import cut

KINDS = ("email", "ip", "card", "phone")
DISCLOSURE, MIN_TEXTS, STEP = 0.95, 1, 256
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The patterns of the docstring of ``base_spans``, with guards that change no match but keep
#: the search linear: a match can only begin where a run begins, or where the last match ended.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MAYBE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{11}", "phone": r"\+[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_APART, _INSIDE = r"[^\p{L}\p{N}]+", r"[\p{L}\p{N}]"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _with(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(text: Column, pattern: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches as an array of (kind, start, end, value).

    Offsets are summed by blocks of ``STEP`` matches and then inside each block, so that the
    arrays that a sum copies stay short in texts of many matches.
    """
    none = F.array().cast(_SPAN)

    def size(pair: Column) -> Column:
        return F.length(pair["gap"]) + F.length(F.coalesce(pair["hit"], F.lit("")))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(F.coalesce(pair["hit"], F.lit("")))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        found = F.when(pair["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(span)))
        return F.struct(end.alias("at"), found.alias("found"))

    def in_blocks(pairs: Column) -> Column:
        number = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / STEP).cast("int"))
        return F.transform(number, lambda b: F.slice(pairs, b * STEP + 1, F.lit(STEP)))

    def begins(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, p: acc + size(p)))
        return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def spans(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("found")), step, lambda acc: acc["found"])

    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)),
                       lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    return _with(pairs, lambda p: _with(in_blocks(p), lambda blocks: F.flatten(
        F.zip_with(blocks, F.slice(begins(blocks), F.lit(1), F.size(blocks)), spans))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans, by kind and then start.

    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip four dotted numbers,
    each at most 255; card ``[0-9]([ -]?[0-9])+`` of 13 to 19 digits that pass Luhn; phone
    ``\\+[0-9][ ().0-9-]+[0-9]`` of 9 to 15 digits.
    """
    none = F.array().cast(_SPAN)

    def of(kind: str) -> Column:
        spans = F.filter(find_all(text, F.lit(PATTERNS[kind]), kind), lambda s: _valid(kind, s["value"]))
        return F.when(text.rlike(_MAYBE[kind]), spans).otherwise(none)

    return F.concat(*map(of, KINDS))


def _terms(text: Column, spans: Column) -> Column:
    """Distinct folded terms of a text, its base spans blanked out."""
    left = F.aggregate(spans, text, lambda t, s: F.replace(t, s["value"], F.lit(" ")))
    return F.array_distinct(F.filter(F.split(F.lower(left), _APART), lambda t: F.length(t) > 0))


def _identity(span: Column) -> Column:
    """One name for the spellings of a protected value."""
    value = F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def _any_of(terms: Column) -> Column:
    """A pattern of terms grouped by their first two characters, so that a word of the text is not tried against all."""
    heads = F.array_distinct(F.transform(terms, lambda t: F.substring(t, 1, 2)))
    tails = lambda h: F.transform(F.filter(terms, lambda t: F.substring(t, 1, 2) == h), lambda t: F.substring(t, 3, 2**31 - 1))
    return F.array_join(F.transform(heads, lambda h: F.concat(h, F.lit("(?:"), F.array_join(tails(h), "|"), F.lit(")"))), "|")


def _revealing(docs: DataFrame, text_col: str, base: DataFrame, disclosure: float, min_texts: int) -> DataFrame | None:
    """(key, extra): by text, spans of the terms that reveal its values."""
    texts = cut(base.where(F.size("spans") > 0).groupBy("key").agg(
        F.count("*").alias("copies"), F.first("body").alias("body"), F.first("spans").alias("spans")))
    values = texts.select("key", "copies", F.explode(F.array_distinct(F.transform("spans", _identity))).alias("entity"))
    of = lambda seed: F.sum(F.xxhash64(F.lit(seed), "key").cast("decimal(38,0)"))
    known = values.groupBy("entity").agg(F.sum("copies").alias("df_e"), F.count("*").alias("texts"), of(1).alias("one"), of(2).alias("two"))
    known = known.where(F.col("texts") >= min_texts).drop("texts")
    # values of the same texts count the same with every term: they are one entity, named by hashes of those texts
    same = F.concat_ws(":", F.col("one").cast("string"), F.col("two").cast("string"))
    held = values.join(known, "entity").groupBy("key").agg(F.collect_set(F.struct(same.alias("entity"), "df_e")).alias("held"))
    held = cut(held)
    if not held.take(1):
        return None
    total = float(base.count())
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    everywhere = docs.select(F.explode(F.array_distinct(F.split(F.lower(text), _APART))).alias("term")).where(
        F.length("term") > 0).groupBy("term").agg(F.count("*").alias("df_t"))
    # no term of e with df(t) above this can pass, as co(e, t) <= df(e): common words go before values are paired with them
    limit = lambda h: h["df_e"] * F.pow(total / h["df_e"], F.lit(1 - disclosure)) * (1 + 1e-9)
    reach = F.array_max(F.transform("held", limit))
    words = texts.join(held, "key").select("key", reach.alias("reach"), F.explode(_terms(F.col("body"), F.col("spans"))).alias("term"))
    rare = words.join(everywhere, "term").where(F.col("df_t") <= F.col("reach")).select("key", "term", "df_t")
    pairs = cut(rare.join(held, "key").join(texts.select("key", "copies"), "key").select(
        "key", "copies", "term", "df_t", F.explode(F.filter("held", lambda h: F.col("df_t") <= limit(h))).alias("held")).select("key", "copies", "term", "df_t", "held.*"))
    together = pairs.groupBy("entity", "term").agg(
        F.sum("copies").alias("co"), F.count("*").alias("texts"), F.max("df_e").alias("df_e"), F.max("df_t").alias("df_t"))
    pmi = F.log2(F.lit(total) * F.col("co") / (F.col("df_e") * F.greatest("df_t", "co")))
    content = F.log2(F.lit(total) / F.col("df_e"))
    telling = together.where((F.col("texts") >= min_texts) & (content > 0) & (pmi >= F.lit(disclosure) * content)).select("entity", "term")
    by_text = pairs.join(telling, ["entity", "term"]).groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    pattern = F.concat(F.lit(rf"(?iu)(?<!{_INSIDE})(?:"), _any_of(F.col("terms")), F.lit(rf")(?!{_INSIDE})"))
    found = texts.join(by_text, "key").withColumn("found", find_all(F.col("body"), pattern, "term"))
    apart = F.filter("found", lambda t: ~F.exists("spans", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return found.select("key", apart.alias("extra"))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE,
                 min_texts: int = MIN_TEXTS) -> DataFrame:
    """Every row: id, body (text if it has spans), spans (base) and extra (revealing terms)."""
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    base = docs.select(named(id_col).alias("id"), text.alias("body"), base_spans(text).alias("spans"))
    has = F.size("spans") > 0
    base = cut(base.select("id", "spans", F.when(has, F.col("body")).alias("body"), F.when(has, F.sha2("body", 256)).alias("key")))
    extra = _revealing(docs, text_col, base, disclosure, min_texts)
    none = F.array().cast(_SPAN)
    if extra is None:
        return base.select(F.col("id").alias(id_col), "body", "spans", none.alias("extra"))
    clean = base.where(~has).select("id", "body", "spans", none.alias("extra"))
    rest = base.where(has).join(extra, "key", "left").select("id", "body", "spans", F.coalesce("extra", none).alias("extra"))
    return clean.union(rest).withColumnRenamed("id", id_col)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column, extra: Column) -> Column:
    """The text with base spans generalised to ``<KIND>`` and revealing terms removed."""
    order = F.array_sort(F.transform(F.concat(spans, extra), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("behind"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        label = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label)
        return F.when(s["start"] >= acc["at"], F.struct(out.alias("out"), (-s["behind"]).alias("at"))).otherwise(acc)

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(order, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row with spans: id and its sanitised text (rows without spans need no change and are not listed)."""
    return find_private(docs, id_col, text_col, **options).where(F.size("spans") > 0).select(
        id_col, sanitised(F.col("body"), F.col("spans"), F.col("extra")).alias(text_col))
