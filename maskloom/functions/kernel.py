"""Column kernels: bind a value once, and find every match with its offsets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

try:  # building is faster with these; without them, as with Spark Connect, all works by public functions
    from pyspark.errors import utils as _origin
    from pyspark.sql.classic.column import _to_seq
    from pyspark.sql.functions.builtin import _create_lambda
except ImportError:
    _origin = _to_seq = _create_lambda = None

HIT = "struct<s:int,e:int,v:string,g:string,b:string>"
REACH, PAGE, ROUNDS = 20, 1024, 500


@contextmanager
def _plain_calls() -> Iterator[None]:
    """Without call-site capture, which costs four JVM calls for each column function."""
    if not hasattr(_origin, "_enable_debugging_cache"):
        yield
        return
    before = _origin._enable_debugging_cache
    _origin._enable_debugging_cache = False
    try:
        yield
    finally:
        _origin._enable_debugging_cache = before


_ROUNDS = "spark.sql.analyzer.maxIterations"


def built(function: Callable) -> Callable:
    """Build a large expression without recording the call site of each of its parts.

    The analyzer resolves one level of nested lambdas a round, so the session's bound on
    rounds is raised where it is too low for the expression's depth.
    """

    @wraps(function)
    def build(*args, **kwargs):
        session = SparkSession.active()
        if int(session.conf.get(_ROUNDS)) < ROUNDS:
            session.conf.set(_ROUNDS, str(ROUNDS))
        with _plain_calls():
            return function(*args, **kwargs)

    return build


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: the last step of an aggregate over nothing.

    Element 0 of a lambda over a one-element array is the same, but makes and reads two arrays.
    """
    return F.aggregate(F.array(), value, lambda kept, _: kept, body)


_stored: dict[tuple, object] = {}


def stored(key: tuple, value: Column, body: Callable[[Column], Column]) -> Column:
    """``let`` whose lambda is built once per application and key, then only applied."""
    context = SparkContext._active_spark_context
    if _create_lambda is None or context is None or not hasattr(value, "_jc"):
        return let(value, body)
    key = (context.applicationId, *key)
    if key not in _stored:
        with _plain_calls():
            _stored[key] = _create_lambda(lambda kept, _: kept), _create_lambda(body)
    return Column(context._jvm.PythonSQLUtils.fn("aggregate", _to_seq(context, [F.array()._jc, value._jc, *_stored[key]])))


def none_of(kind: str) -> Column:
    """An empty array of elements of type ``kind``."""
    return F.array().cast(f"array<{kind}>")


def chained(*arrays: Column) -> Column:
    """The elements of all arrays; ``concat`` of arrays builds a lazy list for every row."""
    return F.flatten(F.array(*arrays))


def matches(text: Column, pattern: str) -> Column:
    """Whether the whole of ``text`` matches."""
    return text.rlike(rf"\A(?:{pattern})\z")


def any_word(words) -> str:
    """A pattern for any of some literal words, longer ones first."""
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


def running(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """For each value of array<int> the fold of those before it, and one more for all.

    Only integers accumulate: an accumulated array of structs would be copied deeply at
    every step.
    """
    return F.aggregate(values, F.array(F.lit(zero)), lambda done, x: chained(done, F.array(op(F.element_at(done, -1), x))))


def find(text: Column, pattern: str, group: bool = False) -> Column:
    """All leftmost, disjoint matches of two characters or more each: array<struct<s,e,v,g,b>>.

    Offsets count code points and ends are exclusive; ``g`` is the pattern's one capture
    group when ``group`` is set, ``b`` the ``REACH`` characters before the match. Every
    match is taken with the gap before it (``\\G`` ties it to the previous match, hence
    one pass over the text), and the gaps' lengths add up to offsets. A text without a
    match costs one search. (Shorter matches are found too; only their ``b`` may be short.)
    """
    flags = ""
    while pattern.startswith("(?i)"):
        flags, pattern = "(?i)", pattern[4:]
    tied = F.lit(rf"{flags}(?s)\G(.*?)({pattern})")
    part = lambda n: F.regexp_extract_all(text, tied, F.lit(n))
    last = lambda value: F.substring(value, F.lit(-REACH), F.lit(REACH))
    parts = F.struct(part(1).alias("gap"), part(2).alias("v"), *([part(3).alias("g")] if group else []))

    def hits(p: Column, at: Column) -> Column:
        def hit(gap: Column, i: Column) -> Column:
            v, s = F.get(p["v"], i), F.get(at, i) + F.length(gap)
            first = F.greatest(i - REACH // 2, F.lit(0))
            near = F.zip_with(F.slice(p["gap"], first + 1, i - first), F.slice(p["v"], first + 1, i - first), lambda a, b: F.concat(a, b))
            ahead = F.when((F.length(gap) >= REACH) | (i == 0), gap).otherwise(F.concat(F.array_join(near, ""), gap))
            g = F.get(p["g"], i) if group else v
            return F.struct(s.alias("s"), (s + F.length(v)).alias("e"), v.alias("v"), g.alias("g"), last(ahead).alias("b"))

        return F.transform(p["gap"], hit)

    def located(p: Column) -> Column:
        sizes = F.zip_with(p["gap"], p["v"], lambda a, b: F.length(a) + F.length(b))
        starts = F.when(F.size(p["gap"]) == 1, F.array(F.lit(0))).otherwise(running(sizes, 0, lambda a, b: a + b))
        return let(starts, lambda at: hits(p, at))

    return F.when(text.rlike(flags + pattern), let(parts, located)).otherwise(none_of(HIT))


def pages(text: Column) -> Column:
    """The text in parts of PAGE code points, so that reading at an offset need not walk from its start."""
    return F.when(F.length(text) <= PAGE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PAGE}}}"), F.lit(0)))


def piece(pages_: Column, start: Column, length: Column | int) -> Column:
    """``length`` code points from the zero-based ``start`` of a text in pages; less at its end."""
    length = length if isinstance(length, Column) else F.lit(length)
    whole = F.substring(F.get(pages_, F.lit(0)), start + 1, length)
    first = F.floor(start / PAGE).cast("int")
    last = F.greatest(F.floor((start + length - 1) / PAGE).cast("int"), first)
    joined = F.array_join(F.slice(pages_, first + 1, last - first + 1), "")
    return F.when(F.size(pages_) == 1, whole).otherwise(F.substring(joined, start - first * PAGE + 1, length))


def before(pages_: Column, start: Column, window: int) -> Column:
    """At most ``window`` code points that end at ``start``."""
    return piece(pages_, F.greatest(start - window, F.lit(0)), F.least(start, F.lit(window)))
