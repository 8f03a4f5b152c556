"""Array kernels around a name model that need no tensor library (ML6-7, ML14, ML17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.kernel import let
from maskloom.operators import decode
from maskloom.operators.sequence import interior_wins, narrowest_token

NEAR = 16
PERSON = ("private_person", "NAME")
STATES = tuple(decode.LABELS)


def _folded(rows: Column, zero: Column, op) -> Column:
    return F.aggregate(rows, zero, lambda acc, row: F.zip_with(acc, row, op))


def _mean(rows: Column, zero: Column) -> Column:
    """The mean vector of rows; zeros of none."""
    total = _folded(rows, zero, lambda a, b: a + b)
    return F.when(F.size(rows) == 0, zero).otherwise(F.transform(total, lambda x: x / F.size(rows)))


def span_context(features: Column, spans: Column, local: bool = False, near: int = NEAR) -> Column:
    """For each span one vector (ML6): the mean of all rows, the span's mean and maximum, with ``local``
    the means of up to ``near`` rows before and after it (zeros of none), and where it lies.

    ``features`` is array<array<double>>, a row a character; spans are half-open. A span outside fails.
    """

    def of(f: Column) -> Column:
        zero = F.transform(F.get(f, F.lit(0)), lambda x: F.lit(0.0))
        size = F.size(f)
        bad = lambda s: F.coalesce(~((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= size)), F.lit(True))

        def one(s: Column, whole: Column, z: Column) -> Column:
            inside = F.slice(f, s["start"] + 1, s["end"] - s["start"])
            parts = [whole, _mean(inside, z), _folded(inside, F.get(inside, F.lit(0)), lambda a, b: F.greatest(a, b))]
            if local:
                first = F.greatest(s["start"] - near, F.lit(0))
                parts += [_mean(F.slice(f, first + 1, s["start"] - first), z), _mean(F.slice(f, s["end"] + 1, F.lit(near)), z)]
            return F.concat(*parts, F.array(s["start"] / size, s["end"] / size))

        vectors = let(zero, lambda z: let(_mean(f, z), lambda whole: F.transform(spans, lambda s: one(s, whole, z))))
        return F.when(F.exists(spans, bad), F.raise_error(F.lit("A candidate span lies outside the text")).cast("array<array<double>>")).otherwise(vectors)

    return let(features, of)


def reject_confident(spans: Column, probability: Column, threshold: float = 0.99, entity: str = "KR_NAME") -> Column:
    """Spans without those of ``entity`` that a filter calls no person with ``threshold`` or more (ML7).

    ``probability`` has one number for each span; null keeps its span.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    judged = F.zip_with(spans, probability, lambda s, p: F.struct(s.alias("s"), p.alias("p")))
    kept = F.filter(judged, lambda x: (x["s"]["entity"] != entity) | ~F.coalesce(x["p"] >= threshold, F.lit(False)))
    return F.transform(kept, lambda x: x["s"])


def merged_decode(windows: DataFrame, lengths: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Window logits merged, the value deepest inside its window winning, then decoded as one path (ML14).

    ``windows`` has doc_id, window_no, left, right, pos and logits (five numbers); ``lengths`` doc_id
    and n. A character that no window covers stays outside any name.
    """
    best = interior_wins(windows, ["doc_id"], ["logits"])
    outside = F.array(F.lit(0.0), *[F.lit(-1e4)] * (len(STATES) - 1))
    rows = best.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "logits"))).alias("known"))
    full = lengths.join(rows, "doc_id", "left").withColumn("matrix", F.when(F.col("n") > 0, F.transform(
        F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("known", i), outside))).otherwise(F.array().cast("array<array<double>>")))
    return full.select("doc_id", F.explode(decode.decode_best(F.col("matrix"), threshold)).alias("x")).select("doc_id", "x.*")


def character_prior(chars: DataFrame, tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """Token class probabilities as probabilities of a character's label (ML17).

    ``chars`` has doc_id and pos, ``tokens`` doc_id, token, start and end, ``classes`` doc_id, token,
    label (like B-NAME) and p. A character takes its narrowest token's classes: a person's B counts as
    B on the token's first character, E as E on its last, S as B, E or, where it is both, S; what is
    left of them counts as I; any other class as O. A character of no token is O.
    """
    owned = narrowest_token(chars, tokens)
    spots = owned.join(tokens.select("doc_id", "token", "start", "end"), ["doc_id", "token"])
    mass = spots.join(classes, ["doc_id", "token"])
    mark, first, last = F.substring_index("label", "-", 1), F.col("pos") == F.col("start"), F.col("pos") == F.col("end") - 1
    person = F.substring_index("label", "-", -1).isin(*PERSON) & F.col("label").contains("-") & mark.isin("B", "I", "E", "S")
    state = (F.when(~person, "O").when((mark == "S") & first & last, "S").when(mark.isin("B", "S") & first, "B")
             .when(mark.isin("E", "S") & last, "E").otherwise("I"))
    sums = mass.groupBy("doc_id", "pos").agg(*(F.round(F.sum(F.when(state == s, F.col("p")).otherwise(0.0)), 9).alias(s) for s in STATES))
    out = chars.select("doc_id", "pos").join(sums, ["doc_id", "pos"], "left")
    return out.select("doc_id", "pos", *(F.coalesce(F.col(s), F.lit(1.0 if s == "O" else 0.0)).alias(s) for s in STATES))
