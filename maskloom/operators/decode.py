"""Exact decoding of BIOES label lattices and weighted intervals (ML9-13, SEL2-3).

A case's logits (characters x labels O, B, I, E, S) are small dense matrices and the
recurrences are sequential, so these run as NumPy over Arrow batches, all cases of one
length at once, one row per case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.runtime import ship

LABELS = "OBIES"
#: fixed values: which label may follow which
FOLLOW = {"O": "OBS", "B": "IE", "I": "IE", "E": "OBS", "S": "OBS"}
STARTS, ENDS = "OBS", "OES"
_MOVE = np.array([[0.0 if b in FOLLOW[a] else -np.inf for b in LABELS] for a in LABELS])
_FIRST = np.array([0.0 if a in STARTS else -np.inf for a in LABELS])
_LAST = np.array([0.0 if a in ENDS else -np.inf for a in LABELS])
_CLOSED = [LABELS.index(x) for x in ENDS]
SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def _matrix(logits) -> np.ndarray:
    out = np.array([list(row) for row in logits], dtype=np.float64).reshape(-1, len(LABELS)) if len(logits) else np.zeros((0, 5))
    if not np.isfinite(out).all():
        raise ValueError("logits must be finite, five for each character")
    return out


def _lse(values: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(values, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


# The recurrences run over cases x characters x labels, all cases of one length at once.


def _paths(unary: np.ndarray) -> np.ndarray:
    n = unary.shape[1]
    back = np.zeros(unary.shape, np.int64)
    state = unary[:, 0] + _FIRST
    for at in range(1, n):
        options = state[:, :, None] + _MOVE
        back[:, at] = options.argmax(1)
        state = options.max(1) + unary[:, at]
    path = np.empty(unary.shape[:2], np.int64)
    path[:, -1] = (state + _LAST).argmax(1)
    for at in range(n - 1, 0, -1):
        path[:, at - 1] = np.take_along_axis(back[:, at], path[:, at, None], 1)[:, 0]
    return path


def _sums(unary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log weights of all legal prefixes and suffixes at each character, and of all paths."""
    ahead, behind = np.empty(unary.shape), np.empty(unary.shape)
    ahead[:, 0], behind[:, -1] = unary[:, 0] + _FIRST, _LAST
    for at in range(1, unary.shape[1]):
        ahead[:, at] = unary[:, at] + _lse(ahead[:, at - 1, :, None] + _MOVE, 1)
        behind[:, -at - 1] = _lse(_MOVE + (unary[:, -at] + behind[:, -at])[:, None, :], 2)
    return ahead, behind, _lse(ahead[:, -1] + _LAST, 1)


def _inside(unary: np.ndarray) -> np.ndarray:
    ahead, behind, total = _sums(unary)
    return np.clip(1.0 - np.exp(ahead[:, :, 0] + behind[:, :, 0] - total[:, None]), 0.0, 1.0)


def _spanning(unary: np.ndarray, sums: tuple, width: int) -> np.ndarray:
    # log P = (what comes before s, and B there) + (the I's up to e, E there, and what comes after), with
    # the I's as a difference of running sums: one term by start plus one by end
    n = unary.shape[1]
    ahead, behind, total = sums
    before = np.zeros(unary.shape[:2])
    before[:, 1:] = _lse(ahead[:, :-1, _CLOSED], 2)
    inner = np.cumsum(unary[:, :, LABELS.index("I")], axis=1)
    begin = before + unary[:, :, LABELS.index("B")] - inner
    end = inner - unary[:, :, LABELS.index("I")] + unary[:, :, LABELS.index("E")] + behind[:, :, LABELS.index("E")] - total[:, None]
    starts, sizes = np.arange(n)[:, None], np.arange(1, width + 1)[None, :]
    last = starts + sizes - 1
    log = np.where((sizes > 1) & (last < n), begin[:, :, None] + end[:, np.minimum(last, n - 1)], -np.inf)
    log[:, :, 0] = before + unary[:, :, LABELS.index("S")] + behind[:, :, LABELS.index("S")] - total[:, None]
    return np.minimum(np.exp(log), 1.0)


def _outside(unary: np.ndarray, sums: tuple, case: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    ahead, behind, total = sums
    first = np.zeros((len(unary), 1))
    entry = np.concatenate((first, _lse(ahead[:, :, _CLOSED], 2)), 1)
    plain = np.concatenate((first, np.cumsum(unary[:, :, 0], axis=1)), 1)
    return np.clip(np.exp(entry[case, s] + plain[case, e] - plain[case, s] + behind[case, e - 1, 0] - total[case]), 0.0, 1.0)


def _means(values: np.ndarray, case: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The mean of values[case, s:e] for disjoint intervals in order."""
    if not len(case):
        return np.zeros(0)
    base = case * values.shape[1]
    return np.add.reduceat(np.append(values.ravel(), 0.0), np.column_stack((base + s, base + e)).ravel())[::2] / (e - s)


def _path_spans(unary: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    path = _paths(unary)
    share = np.take_along_axis(np.exp(unary - _lse(unary, 2)[:, :, None]), path[:, :, None], 2)[:, :, 0]
    case, s = np.nonzero((path == 1) | (path == 4))
    e = np.nonzero((path == 3) | (path == 4))[1] + 1
    score = _means(share, case, s, e)
    kept = score >= threshold
    return case[kept], s[kept], e[kept], score[kept]


def _coverage_spans(unary: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    p = _inside(unary)
    case, edge = np.nonzero(np.diff(np.pad((p >= threshold).astype(np.int8), ((0, 0), (1, 1))), axis=1))
    case, s, e = case[::2], edge[::2], edge[1::2]
    return case, s, e, _means(p, case, s, e)


def best_path(logits) -> np.ndarray:
    """The legal label sequence of the highest sum (ties: the first label)."""
    unary = _matrix(logits)
    return _paths(unary[None])[0] if len(unary) else np.zeros(0, np.int64)


def inside_probability(logits) -> np.ndarray:
    """For each character the probability of any label but O, over all legal paths."""
    unary = _matrix(logits)
    return _inside(unary[None])[0] if len(unary) else np.zeros(0)


def _check_widest(widest: int | None) -> None:
    if widest is not None and (isinstance(widest, bool) or widest < 1):
        raise ValueError("widest must be a positive integer")


def span_probability(logits, widest: int | None = None) -> np.ndarray:
    """P(a complete name fills [s, s + w)), at [s, w - 1]; zero beyond the end."""
    unary = _matrix(logits)
    _check_widest(widest)
    if not len(unary):
        return np.zeros((0, 0))
    return _spanning(unary[None], _sums(unary[None]), min(len(unary), widest or len(unary)))[0]


def outside_probability(logits, intervals: Iterable[tuple[int, int]]) -> np.ndarray:
    """P(all of [s, e) is O) for each interval."""
    unary, pairs = _matrix(logits), list(intervals)
    if any(not 0 <= s < e <= len(unary) for s, e in pairs):
        raise ValueError("intervals must lie within the text")
    if not pairs:
        return np.zeros(0)
    s, e = (np.array(x) for x in zip(*pairs))
    return _outside(unary[None], _sums(unary[None]), np.zeros(len(pairs), np.int64), s, e)


def _single(function, logits, *options) -> list[tuple[int, int, float]]:
    unary = _matrix(logits)
    return list(zip(*(x.tolist() for x in function(unary[None], *options)[1:]))) if len(unary) else []


def path_spans(logits, threshold: float = 0.0) -> list[tuple[int, int, float]]:
    """Spans of the best path with the mean probability of its labels (ML10)."""
    return _single(_path_spans, logits, threshold)


def coverage_spans(logits, threshold: float) -> list[tuple[int, int, float]]:
    """Contiguous characters whose inside probability reaches the threshold, with its mean (ML11)."""
    return _single(_coverage_spans, logits, threshold)


def best_intervals(items: Sequence[tuple[int, int, float]], margin: float = 0.0, blocked: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int, float]]:
    """Disjoint intervals of the greatest sum of (score - margin); the earlier solution on ties (SEL2)."""
    from bisect import bisect_right

    if not np.isfinite(margin) or any(not (0 <= s < e and np.isfinite(x)) for s, e, x in items) or any(not 0 <= s < e for s, e in blocked):
        raise ValueError("intervals need finite scores and 0 <= start < end")
    top: dict[tuple[int, int], float] = {}
    for s, e, score in items:
        if score > margin and not any(s < b and a < e for a, b in blocked):
            top[s, e] = max(score, top.get((s, e), score))
    rows = sorted(((e, s, score) for (s, e), score in top.items()))
    ends, gain, back = [e for e, _, _ in rows], [0.0], []
    for at, (_, s, score) in enumerate(rows):
        rest = bisect_right(ends, s, 0, at)
        with_it = gain[rest] + score - margin
        back.append(rest if with_it > gain[-1] else None)
        gain.append(max(with_it, gain[-1]))
    out, at = [], len(rows)
    while at:
        if back[at - 1] is None:
            at -= 1
        else:
            e, s, score = rows[at - 1]
            out.append((s, e, score))
            at = back[at - 1]
    return out[::-1]


def _around(items: Sequence[tuple[int, int, float]], n: int, threshold: float, anchors: Sequence[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    fixed = sorted(anchors)
    if any(not 0 <= s < e <= n for s, e, _ in fixed) or any(a[1] > b[0] for a, b in zip(fixed, fixed[1:])):
        raise ValueError("anchors must be disjoint and lie within the text")
    chosen = best_intervals(items, threshold, [(s, e) for s, e, _ in fixed])
    return sorted([*chosen, *fixed])


def evidence_spans(probability: np.ndarray, threshold: float, anchors: Sequence[tuple[int, int, float]] = ()) -> list[tuple[int, int, float]]:
    """Disjoint spans of the greatest sum of (probability - threshold) around fixed anchors (SEL3, ML12)."""
    starts, widths = np.nonzero(probability > threshold)
    items = [(int(s), int(s + w + 1), float(probability[s, w])) for s, w in zip(starts, widths)]
    return _around(items, len(probability), threshold, anchors)


def selective_spans(logits, add: float, remove: float, anchors: Sequence[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Drop anchors that are outside with probability above ``remove``, then add evidence above ``add`` (ML13)."""
    outside = outside_probability(logits, [(s, e) for s, e, _ in anchors])
    kept = [a for a, p in zip(anchors, outside) if p <= remove]
    return evidence_spans(span_probability(logits), add, kept)


#: cells of one block of cases
BLOCK = 1 << 20
_ARROW = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def _blocks(logits: pa.Array, width: Callable[[int], int] = lambda n: len(LABELS)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The cases of a batch by length, in blocks: their places, and cases x characters x labels.

    ``width`` is the number of cells that a character of a case of n characters needs. Null and empty cases are left out.
    """
    inner = logits.flatten()
    five = pc.all(pc.equal(pc.list_value_length(inner), len(LABELS))).as_py()
    flat = inner.flatten().to_numpy(zero_copy_only=False)
    if inner.null_count or five is False or not np.isfinite(flat).all():
        raise ValueError("logits must be finite, five for each character")
    sizes = pc.fill_null(pc.list_value_length(logits), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, rows = np.cumsum(sizes) - sizes, flat.reshape(-1, len(LABELS))
    order = np.argsort(sizes, kind="stable")
    lengths, begins = np.unique(sizes[order], return_index=True)
    for n, places in zip(lengths.tolist(), np.split(order, begins[1:])):
        step = max(1, BLOCK // max(1, n * max(len(LABELS), width(n))))
        for at in range(0, len(places) if n else 0, step):
            some = places[at:at + step]
            yield some, rows[first[some, None] + np.arange(n)]


def _lists(logits: pa.Array, parts: list[tuple[np.ndarray, ...]]) -> pa.Array:
    """Parts of (place, start, end, score) as one list of spans for each case."""
    place, s, e, score = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [()] * 4))
    order = np.argsort(place, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(np.bincount(place.astype(np.int64), minlength=len(logits)))))
    spans = pa.StructArray.from_arrays([pa.array(s[order], pa.int32()), pa.array(e[order], pa.int32()), pa.array(score[order], pa.float64())], fields=list(_ARROW))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans, mask=logits.is_null())


def _blockwise(function: Callable[..., tuple[np.ndarray, ...]], *options) -> Callable[[Column], Column]:
    """Spans by a function of a block of cases."""
    ship(SparkSession.active())

    @F.arrow_udf(SPANS)
    def run(logits: pa.Array) -> pa.Array:
        parts = []
        for places, unary in _blocks(logits):
            case, *rest = function(unary, *options)
            parts.append((places[case], *rest))
        return _lists(logits, parts)

    return run


def _flat(places: Iterable[int], spans: Iterable[list[tuple[int, int, float]]]) -> tuple[np.ndarray, ...]:
    rows = [(place, *span) for place, found in zip(places, spans) for span in found]
    place, s, e, score = zip(*rows) if rows else ((), (), (), ())
    return np.array(place, np.int64), np.array(s, np.int64), np.array(e, np.int64), np.array(score, np.float64)


def _evidence(probability: np.ndarray, threshold: float, fixed: Sequence[Sequence[tuple[int, int, float]]]) -> Iterator[list[tuple[int, int, float]]]:
    """``evidence_spans`` of each case of a block."""
    case, s, w = np.nonzero(probability > threshold)
    items = list(zip(s.tolist(), (s + w + 1).tolist(), probability[case, s, w].tolist()))
    bounds = np.searchsorted(case, np.arange(len(probability) + 1)).tolist()
    for at, anchors in enumerate(fixed):
        yield _around(items[bounds[at]:bounds[at + 1]], probability.shape[1], threshold, anchors)


def decode_best(logits: Column, threshold: float = 0.0) -> Column:
    return _blockwise(_path_spans, threshold)(logits)


def decode_coverage(logits: Column, threshold: float) -> Column:
    return _blockwise(_coverage_spans, threshold)(logits)


def decode_evidence(logits: Column, threshold: float, widest: int | None = None) -> Column:
    ship(SparkSession.active())
    _check_widest(widest)

    @F.arrow_udf(SPANS)
    def run(logits: pa.Array) -> pa.Array:
        parts = []
        for places, unary in _blocks(logits, lambda n: min(n, widest or n)):
            n = unary.shape[1]
            found = _evidence(_spanning(unary, _sums(unary), min(n, widest or n)), threshold, [()] * len(places))
            parts.append(_flat(places.tolist(), found))
        return _lists(logits, parts)

    return run(logits)


def marginals(logits: Column) -> Column:
    ship(SparkSession.active())

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(logits: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(logits), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(offsets[-1])
        for places, unary in _blocks(logits):
            out[offsets[places][:, None] + np.arange(unary.shape[1])] = _inside(unary)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out), mask=logits.is_null())

    return run(logits)


def _udf(function, kind):
    ship(SparkSession.active())

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else function(x) for x in column])

    return run


def _rows(spans) -> list[dict]:
    return [{"start": s, "end": e, "score": p} for s, e, p in spans]


def select_intervals(items: Column, margin: float = 0.0) -> Column:
    """``items``: array<struct<start,end,score>>."""
    return _udf(lambda x: _rows(best_intervals([(r["start"], r["end"], r["score"]) for r in x], margin)), SPANS)(items)


def decode_selective(logits: Column, anchors: Column, add: float, remove: float) -> Column:
    """``anchors``: array<struct<start,end,score>>."""

    ship(SparkSession.active())

    @F.arrow_udf(SPANS)
    def run(logits: pa.Array, anchors: pa.Array) -> pa.Array:
        given, parts = anchors.to_pylist(), []
        for places, unary in _blocks(logits, lambda n: n):
            n, sums = unary.shape[1], _sums(unary)
            fixed = [[(a["start"], a["end"], a["score"]) for a in given[p]] for p in places.tolist()]
            if any(not 0 <= s < e <= n for case in fixed for s, e, _ in case):
                raise ValueError("intervals must lie within the text")
            case = np.repeat(np.arange(len(fixed)), [len(x) for x in fixed])
            ends = np.array([(s, e) for x in fixed for s, e, _ in x], np.int64).reshape(-1, 2)
            drop = iter((_outside(unary, sums, case, ends[:, 0], ends[:, 1]) > remove).tolist())
            kept = [[a for a in x if not next(drop)] for x in fixed]
            parts.append(_flat(places.tolist(), _evidence(_spanning(unary, sums, n), add, kept)))
        return _lists(logits, parts)

    return run(logits, anchors)
