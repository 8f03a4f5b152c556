"""The detector: text to disjoint findings, and findings to masked text, as Column expressions.

A :class:`Detector` holds the choices (entities, threshold, folding) and turns a text
column into ``array<struct<entity,start,end,score,text>>`` without leaving the row, so a
plan with it has no shuffle, and it works in batch and streaming queries alike. The
steps are those of a fixed sequence: fold, scan, boost by context, gates, calendar,
account evidence, identifier veto, threshold, greedy choice, names and addresses,
original offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import checks, context, fields, masking, spans
from maskloom.functions import vocab as V
from maskloom.functions.kernel import built, chained, find, let, matches, none_of, pages, piece, stored
from maskloom.functions.text import CUT, cuts, fold, original, squeeze, unusual

FINDING = "struct<entity:string,start:int,end:int,score:double,text:string>"
MODEL_SPAN = "struct<entity:string,start:int,end:int,score:double>"


def _candidate(entity: str, hit: Column, score: Column | float, proof: Column | None = None) -> Column:
    score = score if isinstance(score, Column) else F.lit(score)
    return spans.span(F.lit(entity), F.lit(V.PRIORITY[entity]), hit["s"], hit["e"], score, proof)


def _some(condition: Column, candidate: Column) -> Column:
    return F.when(condition, F.array(candidate)).otherwise(none_of(spans.SPAN))


@dataclass(frozen=True)
class Detector:
    """What to look for. Names and addresses are found only when named in ``entities``."""

    entities: tuple[str, ...] = field(default=V.STRUCTURED)
    threshold: float = V.THRESHOLD
    normalize: bool = True

    def __post_init__(self) -> None:
        if isinstance(self.threshold, bool) or not isinstance(self.threshold, (int, float)) or not 0 <= self.threshold <= 1:
            raise ValueError("threshold must be a number from 0 to 1")
        if isinstance(self.entities, (str, bytes)):
            raise TypeError("entities must be a collection of names, not one string")
        names = tuple(self.entities)
        if not names:
            raise ValueError("entities must not be empty")
        if any(not isinstance(name, str) for name in names):
            raise TypeError("entities must hold only strings")
        if unknown := sorted(set(names) - set(V.ENTITIES)):
            raise ValueError(f"Unsupported entities: {unknown}")
        object.__setattr__(self, "entities", names)

    # --- scans ---------------------------------------------------------------------------

    @cached_property
    def _scanned(self) -> frozenset[str]:
        """Accounts need every identifier, for the veto."""
        wanted = set(self.entities) & set(V.STRUCTURED)
        return frozenset(V.STRUCTURED if "KR_ACCOUNT" in wanted else wanted)

    def _token_candidates(self, hit: Column) -> Column:
        """All readings of one stand-alone number of digits and hyphens, scores final."""
        value = hit["v"]

        def read(at: Column) -> Column:
            number, prefix = at["number"], at["prefix"]
            sized = lambda low, high=None: at["digits"].between(low, high or low)  # noqa: E731 - far cheaper than a pattern
            out = []
            shaped = sized(13) & matches(value, V.REGISTRATION)
            seventh = F.substring(number, 7, 1)
            for entity, marks, shift in (("KR_RRN", "[0-49]", 11), ("KR_FRN", "[5-8]", 13)):
                if entity in self._scanned:
                    word = context.has_word(prefix, entity)
                    score = F.when(checks.registration_checksum(number, shift), V.SCORE["certain"]).otherwise(V.SCORE["registration"])
                    dated = checks.birth_date_valid(F.lit(entity), value)
                    out.append(_some(
                        shaped & seventh.rlike(marks) & (dated | word), _candidate(entity, hit, context.boosted(score, word))))
            if "KR_BRN" in self._scanned:
                out.append(_some(sized(10) & matches(value, V.BUSINESS) & checks.business_checksum(number), _candidate("KR_BRN", hit, V.SCORE["certain"])))
            if "KR_DRIVER_LICENSE" in self._scanned:
                word = context.has_word(prefix, "KR_DRIVER_LICENSE")
                plain = F.when(value.contains("-"), V.SCORE["license"]).otherwise(min(V.SCORE["license"], V.UNDELIMITED))
                score = F.when(word, context.boosted(F.lit(V.SCORE["license"]), F.lit(True))).otherwise(plain)
                out.append(_some(sized(12) & matches(value, V.LICENSE), _candidate("KR_DRIVER_LICENSE", hit, score)))
            if "CREDIT_CARD" in self._scanned:
                out.append(_some(
                    sized(13, 17) & matches(value, V.CARD) & ~matches(value, "1[0-9]{12}") & checks.luhn(number),
                    _candidate("CREDIT_CARD", hit, V.SCORE["certain"])))
            if "KR_ACCOUNT" in self._scanned:
                out.append(F.when(sized(10, 14), self._account(hit, number, prefix)).otherwise(none_of(spans.SPAN)))
            return chained(*out)

        number = F.replace(value, F.lit("-"), F.lit(""))
        return let(F.struct(number.alias("number"), F.octet_length(number).alias("digits"), context.clause(hit["b"]).alias("prefix")), read)

    def _account(self, hit: Column, number: Column, prefix: Column) -> Column:
        value = hit["v"]
        layouts = "|".join(p for _, _, p, groups in V.ACCOUNT_LAYOUTS if groups == 4)
        bare = value == number  # 10 to 14 digits by now

        def shaped(three: Column) -> Column:
            read = let(context.account_context(prefix), lambda ctx: gate(ctx, three))
            return F.when(bare | three | matches(value, layouts), read).otherwise(none_of(spans.SPAN))

        def gate(ctx: Column, three: Column) -> Column:
            score = context.boosted(F.when(bare, V.SCORE["account_bare"]).otherwise(V.SCORE["account"]), ctx["has"])
            passed = ~ctx["blocked"] & (three | ctx["has"])  # a date has too few digits
            evident = (  # a documented layout of the bank that the clause names for an account
                ctx["has"] & (score >= float(self.threshold)) & prefix.contains("계좌") & (context.nearest_bank(prefix) == checks.account_bank(value)))
            return _some(passed, _candidate("KR_ACCOUNT", hit, score, evident))

        return let(~bare & matches(value, V.ACCOUNT_GROUPS), shaped)

    def _candidates(self, text: Column) -> Column:
        """Candidates of all scans, each with its context and gates applied."""
        out = []
        if self._scanned - {"KR_PASSPORT", "PHONE_NUMBER", "EMAIL_ADDRESS"}:
            out.append(F.flatten(F.transform(find(text, V.DIGIT_TOKEN), self._token_candidates)))
        if "PHONE_NUMBER" in self._scanned:
            out.append(F.transform(find(text, V.PHONE), self._phone))
        if "CREDIT_CARD" in self._scanned:
            right = F.filter(find(text, V.CARD_SPACED), lambda hit: checks.luhn(checks.digits(hit["v"])))
            out.append(F.transform(right, lambda hit: _candidate("CREDIT_CARD", hit, V.SCORE["certain"])))
        if "KR_PASSPORT" in self._scanned:
            out.append(F.transform(find(text, V.PASSPORT), self._passport))
        if "EMAIL_ADDRESS" in self._scanned:
            out.append(self._emails(text))
        return F.when(text.rlike(r"[0-9]{2}|@"), chained(*out)).otherwise(none_of(spans.SPAN))

    @staticmethod
    def _phone(hit: Column) -> Column:
        value = hit["v"]
        base = F.when(matches(value, V.MOBILE), V.SCORE["mobile"]).otherwise(V.SCORE["phone"])
        foreign = matches(value, "[1-9][0-9]*")  # +82 without its plus sign

        def judge(word: Column) -> Column:
            plain = F.when(foreign, F.least(base, F.lit(V.UNDELIMITED))).otherwise(base)
            return _candidate("PHONE_NUMBER", hit, F.when(word, context.boosted(base, word)).otherwise(plain))

        return let(context.has_word(context.clause(hit["b"]), "PHONE_NUMBER"), judge)

    @staticmethod
    def _passport(hit: Column) -> Column:
        base = F.when(hit["v"].rlike("[A-Za-z]...[A-Za-z]"), V.SCORE["passport"]).otherwise(V.SCORE["passport_old"])
        word = context.has_word(context.clause(hit["b"]), "KR_PASSPORT")
        return _candidate("KR_PASSPORT", hit, context.boosted(base, word))

    @staticmethod
    def _emails(text: Column) -> Column:
        def valid(pattern: str) -> Column:
            kept = F.filter(find(text, pattern), lambda hit: checks.email_valid(hit["v"]))
            return F.transform(kept, lambda hit: _candidate("EMAIL_ADDRESS", hit, V.SCORE["certain"]))

        wide = F.when(text.rlike(r"[^\x00-\x7F]@|@[^\x00-\x7F]|@[^\s@]*\.[^\x00-\x7F]|[^\x00-\x7F][^\s@]*@"), valid(V.EMAIL_WIDE))
        both = chained(valid(V.EMAIL), F.coalesce(wide, none_of(spans.SPAN)))
        return F.when(text.contains("@"), spans.drop_contained(both)).otherwise(none_of(spans.SPAN))

    # --- conflicts -----------------------------------------------------------------------

    def _structured(self, text: Column) -> Column:
        """Disjoint structured findings in the folded text: evidence, veto, threshold and choice, cluster by cluster."""
        is_account = lambda x: x["entity"] == "KR_ACCOUNT"

        def choose(found: Column) -> Column:
            def disproved(x: Column) -> Column:
                same = lambda y: (x["s"] == y["s"]) & (x["e"] == y["e"]) & y["proof"]
                return (x["entity"] == "CREDIT_CARD") & F.exists(found, same)

            def vetoed(x: Column) -> Column:
                guard = lambda g: ~is_account(g) & (g["score"] >= V.PROTECT) & spans.touches(x, g) & ~disproved(g)
                return is_account(x) & F.exists(found, guard)

            wanted = lambda x: x["entity"].isin(*self.entities) & (x["score"] >= float(self.threshold))
            settled = lambda x: wanted(x) & ~disproved(x) & ~vetoed(x)
            return let(F.filter(found, settled if "KR_ACCOUNT" in self.entities else wanted), spans.greedy)

        return let(self._candidates(text), lambda found: F.when(F.size(found) == 0, found).otherwise(spans.by_cluster(found, choose)))

    def _model(self, text: Column, view: Column, model: Column, rules: Column) -> Column:
        """A model's spans after their contract, the rules' priority and the vetoes."""
        def bad(x: Column) -> Column:
            fits = (
                x["entity"].isin(*V.OPTIONAL) & (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length(text))
                & x["score"].between(0.0, 1.0) & ~F.isnan(x["score"]))
            return ~F.coalesce(fits, F.lit(False))

        given = model.cast(f"array<{MODEL_SPAN}>")
        checked = F.when(F.exists(given, bad), F.raise_error(F.lit("The model returned an invalid name or address span")).cast(
            f"array<{MODEL_SPAN}>")).otherwise(given)
        turned = F.transform(checked, lambda x: spans.span(
            x["entity"], F.when(x["entity"] == "KR_NAME", V.PRIORITY["KR_NAME"]).otherwise(V.PRIORITY["KR_ADDRESS"]),
            x["start"], x["end"], x["score"]))
        firm = F.filter(rules, lambda x: x["score"] >= float(self.threshold))
        admitted = lambda x: F.when(
            x["entity"] == "KR_NAME", fields.contextual_name(view, x["s"], x["e"])
        ).otherwise(piece(view, x["s"], x["e"] - x["s"]).rlike(r"\p{Nd}"))
        return let(firm, lambda f: F.filter(turned, lambda x: ~spans.overlaps_any(x, f) & admitted(x)))

    def _extras(self, text: Column, view: Column, structured: Column, model: Column | None) -> Column:
        """Names and addresses that leave the structured findings alone."""
        rules = chained(
            fields.name_fields(text, view) if "KR_NAME" in self.entities else none_of(spans.SPAN),
            fields.addresses(text, view) if "KR_ADDRESS" in self.entities else none_of(spans.SPAN))
        wanted = lambda x: x["entity"].isin(*self.entities) & (x["score"] >= float(self.threshold))

        def arbitrate(found: Column) -> Column:
            def settle(open_: Column) -> Column:
                places = F.filter(open_, lambda x: x["entity"] == "KR_ADDRESS")
                return let(places, lambda p: let(
                    F.filter(open_, lambda x: (x["entity"] != "KR_NAME") | ~spans.overlaps_any(x, p)), spans.select_greedy))

            return let(spans.without_overlap(F.filter(found, wanted), structured), settle)

        proposals = rules if model is None else let(
            rules, lambda r: chained(r, F.coalesce(self._model(text, view, model, r), none_of(spans.SPAN))))
        return let(proposals, lambda found: F.when(F.size(found) == 0, found).otherwise(arbitrate(found)))

    def _spans(self, text: Column, view: Column, model: Column | None) -> Column:
        wanted = self._scanned and set(self.entities) & set(V.STRUCTURED)
        structured = self._structured(text) if wanted else none_of(spans.SPAN)
        if not set(self.entities) & set(V.OPTIONAL):
            return structured
        return let(structured, lambda s: let(self._extras(text, view, s, model), lambda more: F.when(F.size(more) == 0, s).otherwise(
            F.array_sort(chained(s, more)))))

    # --- results -------------------------------------------------------------------------

    def _report(self, text: Column, model: Column | None) -> Column:
        def row(x: Column, removed: Column, own: Column) -> Column:
            s, e = original(x["s"], removed), original(x["e"] - 1, removed) + 1
            return F.struct(
                x["entity"].alias("entity"), s.alias("start"), e.alias("end"), F.round(x["score"], 3).alias("score"),
                piece(own, s, e - s).alias("text"))

        def analysed(view: Column) -> Column:
            leaf = pages(view["clean"]) if set(self.entities) & set(V.OPTIONAL) else F.array(view["clean"])  # only fields read by pages
            found = let(leaf, lambda leaf: self._spans(view["clean"], leaf, model))
            told = lambda f: let(pages(text), lambda own: F.transform(f, lambda x: row(x, view["removed"], own)))
            return let(found, lambda f: F.when(F.size(f) == 0, none_of(FINDING)).otherwise(told(f)))

        def views(folded: Column) -> Column:
            hidden = folded.rlike(f"[{V.INVISIBLE}]")
            return F.struct(
                F.when(hidden, squeeze(folded)).otherwise(folded).alias("clean"),
                F.when(hidden, cuts(folded)).otherwise(none_of(CUT)).alias("removed"))

        plain = F.struct(text.alias("clean"), none_of(CUT).alias("removed"))
        found = let(F.when(unusual(text), let(fold(text), views)).otherwise(plain) if self.normalize else plain, analysed)
        nothing = text.isNull()
        if not set(self.entities) & set(V.OPTIONAL):  # every other scan needs digits or an at sign, of any width
            nothing = nothing | ~(text.rlike("[@0-9]") | text.rlike(r"[＠\p{Nd}]"))
        return F.when(nothing, none_of(FINDING)).otherwise(found)

    @built
    def findings(self, text: Column, model: Column | None = None) -> Column:
        """Findings of a text in its own offsets, ordered by start; none for null.

        ``model`` is an optional column array<struct<entity,start,end,score>> of a name
        and address model, in offsets of ``maskloom.functions.text.normalize(text)``.
        """
        if model is None:
            return stored(("findings", self), text, lambda t: self._report(t, None))
        return let(text, lambda t: self._report(t, model))

    @built
    def findings_with(self, rows: DataFrame, column: str, model: str, into: str = "findings") -> DataFrame:
        """Rows with findings of a text column beside a column of a model's spans.

        The same steps as :meth:`findings`, one projection each, so that the plan stays shallow.
        """
        view = fold(F.col(column)) if self.normalize else F.col(column)
        removed = cuts(F.col("__fold")) if self.normalize else none_of(CUT)
        given = rows.withColumn("__fold", F.coalesce(view, F.lit(""))).withColumn("__cuts", removed)
        clean = given.withColumn("__clean", squeeze(F.col("__fold")) if self.normalize else F.col("__fold"))
        wanted = self._scanned and set(self.entities) & set(V.STRUCTURED)
        clean = clean.withColumn("__pages", pages(F.col("__clean"))).withColumn("__own", pages(F.coalesce(F.col(column), F.lit(""))))
        first = clean.withColumn("__first", self._structured(F.col("__clean")) if wanted else none_of(spans.SPAN))
        more = first.withColumn("__more", self._extras(F.col("__clean"), F.col("__pages"), F.col("__first"), F.col(model)))

        def row(x: Column) -> Column:
            s, e = original(x["s"], F.col("__cuts")), original(x["e"] - 1, F.col("__cuts")) + 1
            return F.struct(x["entity"].alias("entity"), s.alias("start"), e.alias("end"), F.round(x["score"], 3).alias("score"),
                            piece(F.col("__own"), s, e - s).alias("text"))

        out = more.withColumn("__all", F.array_sort(chained(F.col("__first"), F.col("__more")))).withColumn(into, F.transform("__all", row))
        return out.drop("__fold", "__cuts", "__clean", "__pages", "__own", "__first", "__more", "__all")

    @built
    def contains(self, text: Column, model: Column | None = None) -> Column:
        return F.size(self.findings(text, model)) > 0

    def _applied(self, text: Column, should_mask: Callable[[Column], Column] | None, model: Column | None) -> Column:
        found = self.findings(text, model)
        return found if should_mask is None else F.filter(found, should_mask)

    @built
    def mask(self, text: Column, style: str = "tag", should_mask: Callable[[Column], Column] | None = None,
             model: Column | None = None) -> Column:
        """Text with its findings replaced; ``should_mask`` takes a finding and says whether to replace it."""
        check_style(style)
        body = lambda t: let(self._applied(t, should_mask, model), lambda found: masking.splice(t, found, style))
        return stored(("mask", self, style), text, body) if should_mask is None and model is None else let(text, body)

    @built
    def mask_with_details(self, text: Column, style: str = "tag", should_mask: Callable[[Column], Column] | None = None,
                          model: Column | None = None) -> Column:
        """struct<text,redactions> of one analysis; redactions hold no values."""
        check_style(style)
        body = lambda t: let(self._applied(t, should_mask, model), lambda found: F.struct(
            masking.splice(t, found, style).alias("text"), masking.redactions(t, found, style).alias("redactions")))
        return stored(("details", self, style), text, body) if should_mask is None and model is None else let(text, body)


def check_style(style: str) -> None:
    if style not in V.STYLES:
        raise ValueError(f"Unknown mask style: {style}")


def all_entities(**options) -> Detector:
    """A detector that looks for names and addresses too."""
    return Detector(entities=options.pop("entities", V.ENTITIES), **options)


def pick(entities: Iterable[str] | None, **options) -> Detector:
    return Detector(**options) if entities is None else Detector(entities=entities if isinstance(entities, (str, bytes)) else tuple(entities), **options)
