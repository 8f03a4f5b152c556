"""SentencePiece encoding by sampling, and lossless decoding.

A text's piece lattice holds every way to spell it in vocabulary pieces. Forward
filtering sums the weights of all spellings of each prefix; backward sampling then
draws a spelling from the end, each piece with its posterior probability. No piece
of the vocabulary has a space mark after another character or spans a newline, so
the lattice has cut points there and each chunk between is filtered once and
sampled wherever it occurs, all chunks of many rows at a time. Random numbers are
counted off a hash of the row key, hence a row gets the same pieces in any
partitioning. A chunk of more than ``LONG`` characters is filtered and sampled block by
block, in the memory of a block. A character without a piece of its own becomes its UTF-8 byte pieces.

A piece of rank r weighs ``(r + RANK_OFFSET) ** -alpha``: the model holds merge
ranks, not probabilities. As ``alpha`` grows, spellings by few, frequent pieces win.

Defined results: null text has null ids and decodes to null; empty text has no ids;
a literal space mark is spelt in bytes, so that decoding returns every text exactly;
rows repeating a key and text get equal ids; empty input gives empty output. A
column named like the added one is replaced. The vocabulary (bounded by its file)
is read on the driver and broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.llm.common import fresh, give_back, named
from maskloom.runtime import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, RANK_OFFSET, SEED = 1.0, 50.0, 7
MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
_LITERAL = "\ud800"  # no text holds a lone surrogate: it stands for a literal space mark
CHARS_AT_ONCE, IDS_AT_ONCE = 400_000, 250_000
LONG, BLOCK = 2_000, 1 << 16
BYTE_WEIGHT = 1e-6


@dataclass
class Vocabulary:
    pieces: list[str]
    kinds: list[int]  # 0 piece, 1 byte, 2 never used
    ranks: list[float]

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        kinds = [1 if model.is_byte(i) else 2 if special(i) else 0 for i in every]
        return Vocabulary([model.id_to_piece(i) for i in every], kinds, [min(-model.get_score(i), float(len(kinds))) for i in every])


class _Trie:
    """The vocabulary as one hash table of (node, character) -> node, and the piece that ends at a node."""

    EMPTY = np.uint64(2**64 - 1)

    def __init__(self, pieces: dict[str, int]):
        edges, self.ends = {}, [-1]
        for piece, number in pieces.items():
            node = 0
            for char in piece:
                node = edges.setdefault((node << 21) | ord(char), len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = number
        self.ends = np.array(self.ends, np.int32)
        self.bits = max(10, (8 * len(edges)).bit_length())
        self.keys = np.full(1 << self.bits, self.EMPTY, np.uint64)
        self.nodes = np.zeros(1 << self.bits, np.int32)
        keys, nodes = np.fromiter(edges, np.uint64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges))
        slots = self._slot(keys)
        while len(keys):  # linear probing: of those that want a slot, the first gets it
            free = np.flatnonzero(self.keys[slots] == self.EMPTY)
            _, first = np.unique(slots[free], return_index=True)
            own = free[first]
            self.keys[slots[own]], self.nodes[slots[own]] = keys[own], nodes[own]
            keys, nodes, slots = (np.delete(x, own) for x in (keys, nodes, slots))
            slots = (slots + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The next node of each pair, -1 where there is none."""
        keys = (nodes.astype(np.uint64) << np.uint64(21)) | chars
        slots = self._slot(keys)
        got = self.keys[slots]
        out = np.where(got == keys, self.nodes[slots], -1)
        open_ = np.flatnonzero((got != keys) & (got != self.EMPTY))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slots[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.nodes[slots[open_[hit]]]
            open_ = open_[~hit & (got != self.EMPTY)]
        return out


class Sampler:
    """Forward filtering and backward sampling of all chunks of a batch at a time."""

    def __init__(self, vocab: Vocabulary, alpha: float = ALPHA):
        v = vocab
        usable = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == 0}
        self.trie = _Trie(usable)
        self.longest = max(map(len, usable))
        self.weight = (np.array(v.ranks) + RANK_OFFSET) ** -alpha
        by_byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == 1}
        self.byte_ids = np.array([by_byte.get(b, 0) for b in range(256)], np.int32)

        self.surface = Surface(v)

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> list[str]:
        return self.surface.decode(ids, per_text)

    @staticmethod
    def chunks(text: str) -> list[str]:
        if MARK not in text:
            return _CHUNK.findall(MARK + text.replace(" ", MARK))
        out: list[str] = []
        for i, part in enumerate(text.split(MARK)):
            if i:
                out.append(_LITERAL)
            out += _CHUNK.findall((MARK if i == 0 else "") + part.replace(" ", MARK))
        return out

    def lattice(self, chunks: list[str]):
        """State (k, j) is the prefix of k characters of chunk j; states lie k by k, longest
        chunks first, so that what one step reads is contiguous. Returns, by chunk, its
        place j and length, then by k the first state, and for every state the running
        posterior and the piece of its last-piece lengths 1, 2, ... (piece -1: the
        character in bytes) and the character that it ends with."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        ranked, begin = sizes[order], (np.cumsum(sizes) - sizes)[order]
        many = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(ranked[0] + 1), side="left")  # chunks of k characters or more
        off = np.concatenate(([0], np.cumsum(many)))
        total = int(off[-1])
        code = np.zeros(total, np.uint64)
        for k in range(1, len(many)):
            code[off[k] : off[k + 1]] = codes[begin[: many[k]] + (k - 1)]
        live = np.arange(off[1], total)  # where a piece would end; at first, with its first character
        depth = np.repeat(np.arange(1, len(many), dtype=np.int32), many[1:])
        nth = live - off[depth]
        node, weights, pieces = np.zeros(len(live), np.int32), [], []
        for _ in range(self.longest):
            node = self.trie.step(node, code[live])
            ok = node >= 0
            if not ok.any():
                break
            live, depth, nth, node = live[ok], depth[ok], nth[ok], node[ok]
            found = self.trie.ends[node]
            hit = found >= 0
            weight, piece = np.zeros(total, np.float32), np.full(total, -2, np.int32)
            weight[live[hit]], piece[live[hit]] = self.weight[found[hit]], found[hit]
            weights.append(weight)
            pieces.append(piece)
            depth = depth + 1
            on = depth < len(many)
            live, depth, nth, node = live[on], depth[on], nth[on], node[on]
            on = nth < many[depth]
            depth, nth, node = depth[on], nth[on], node[on]
            live = off[depth] + nth
        if not weights:
            weights, pieces = [np.zeros(total, np.float32)], [np.full(total, -2, np.int32)]
        bare = pieces[0] == -2
        weights[0][bare], pieces[0][bare] = BYTE_WEIGHT, -1
        used, forward = len(weights), np.ones(total)
        running = np.zeros((used, total), np.float32)
        for k in range(1, len(many)):
            here, n, width = slice(off[k], off[k + 1]), many[k], min(k, used)
            sums = np.zeros(n)
            parts = []
            for back in range(1, width + 1):
                sums = sums + forward[off[k - back] : off[k - back] + n] * weights[back - 1][here]
                parts.append(sums)
            for back, part in enumerate(parts):
                running[back, here] = part / sums
            running[width:, here] = 1.0
            forward[here] = sums
            if k % 8 == 0:  # only ratios matter: scale the prefixes that are still in reach
                for back in range(min(k, self.longest) + 1):
                    forward[off[k - back] : off[k - back] + n] /= sums
        del weights, forward, live, depth, nth, node  # the widest arrays: free them before the copies below
        running = np.ascontiguousarray(running.T)
        return place, sizes, off, running, np.stack(pieces, 1), code

    def long_chunk(self, chunk: str, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one chunk of any length, with the character that each ends with. The filter runs
        over blocks and keeps what it needs at their starts; sampling goes back block by block and
        filters each again, so that memory is that of a block."""
        codes = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts, reach = range(0, len(codes), BLOCK), self.longest

        def pieces_of(first: int) -> tuple[np.ndarray, np.ndarray]:
            """By prefix of the block, and by length of its last piece, weight and piece."""
            low = max(0, first - reach)
            part = codes[low : first + BLOCK]
            weight, piece = np.zeros((len(part), reach)), np.full((len(part), reach), -2, np.int32)
            at, node = np.arange(len(part)), np.zeros(len(part), np.int32)
            for size in range(1, reach + 1):
                at, node = at[(on := at + size <= len(part))], node[on]
                node = self.trie.step(node, part[at + size - 1])
                at, node = at[(on := node >= 0)], node[on]
                found = self.trie.ends[node]
                hit = found >= 0
                weight[at[hit] + size - 1, size - 1], piece[at[hit] + size - 1, size - 1] = self.weight[found[hit]], found[hit]
            bare = piece[:, 0] == -2
            weight[bare, 0], piece[bare, 0] = BYTE_WEIGHT, -1
            return weight[first - low :], piece[first - low :]

        def posterior(weight: np.ndarray, window: np.ndarray, running: np.ndarray | None) -> np.ndarray:
            """Filter a block from the window of the last prefixes' sums, latest first; returns the next window."""
            held = np.concatenate((np.zeros(len(weight)), window))  # written from its middle to its front
            for k in range(len(weight)):
                at = len(weight) - k
                parts = np.cumsum(held[at : at + reach] * weight[k])
                if running is not None:
                    running[k] = parts / parts[-1]
                held[at - 1] = parts[-1]
                if k % 8 == 7:
                    held[at - 1 : at - 1 + reach] /= parts[-1]
            return held[:reach] / held[0]

        windows, window = [], np.zeros(reach)
        window[0] = 1.0
        for first in starts:
            windows.append(window)
            window = posterior(pieces_of(first)[0], window, None)
        ids, ends, at, step = [], [], len(codes), 0
        for first, window in zip(reversed(starts), reversed(windows)):
            weight, piece = pieces_of(first)
            running = np.empty_like(weight)
            posterior(weight, window, running)
            draws = _uniform(np.full(at - first, base), np.arange(step, step + at - first))
            begun = step
            while at > first:
                row = at - first - 1
                back = min(int((running[row] <= draws[step - begun]).sum()), reach - 1)
                ids.append(piece[row, back])
                ends.append(codes[at - 1])
                at -= back + 1
                step += 1
        return np.array(ids[::-1], np.int32), np.array(ends[::-1], np.uint64)

    def encode(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has. keys: uint64 by text."""
        cut = [self.chunks(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        row = np.repeat(np.arange(len(cut)), sizes)
        nth = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        with np.errstate(over="ignore"):
            base = keys[row] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        length = np.fromiter(map(len, flat), np.int64, len(flat))
        long_ones = {int(i): self.long_chunk(flat[i], base[i]) for i in np.flatnonzero(length > LONG)}
        short = np.flatnonzero(length <= LONG)
        many, seen = np.zeros(len(flat), np.int64), []
        for i, (drawn, _) in long_ones.items():
            many[i] = len(drawn)
        if len(short):
            number = dict(zip(dict.fromkeys(flat[i] for i in short.tolist()), count()))
            kind = np.zeros(len(flat), np.int64)
            kind[short] = np.fromiter((number[flat[i]] for i in short.tolist()), np.int64, len(short))
            place, lengths, off, running, piece, code = self.lattice(list(number))
            which, left = place[kind], lengths[kind]
            live, step = short, 0
            while len(live):
                at = off[left[live]] + which[live]
                back = (running[at] <= _uniform(base[live], step)[:, None]).sum(1)
                np.minimum(back, running.shape[1] - 1, out=back)
                drawn = piece[at, back]
                seen.append((live, drawn, code[at]))
                many[live] += 1
                left[live] -= back + 1
                step += 1
                live = live[left[live] > 0]
        start = np.cumsum(many) - many
        ids, last = np.empty(int(many.sum()), np.int32), np.empty(int(many.sum()), np.uint64)
        for t, (who, drawn, codes) in enumerate(seen):
            to = start[who] + many[who] - 1 - t
            ids[to], last[to] = drawn, codes
        for i, (drawn, codes) in long_ones.items():
            ids[start[i] : start[i] + many[i]], last[start[i] : start[i] + many[i]] = drawn, codes
        per_text = np.bincount(row, many, len(cut)).astype(np.int64)
        if (bare := np.flatnonzero(ids < 0)).size:
            ids, per_text = self._in_bytes(ids, bare, last[bare], per_text)
        return ids, per_text

    def _in_bytes(self, ids, bare, codes, per_text):
        """Put the byte pieces of characters without a piece in their places."""
        odd, which = np.unique(codes, return_inverse=True)
        spelt = [np.frombuffer(chr(int(c)).encode("utf-8", "surrogatepass"), np.uint8) for c in odd]
        spelt = [np.frombuffer(MARK.encode(), np.uint8) if int(c) == ord(_LITERAL) else x for c, x in zip(odd, spelt)]
        sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        pool, at = self.byte_ids[np.concatenate(spelt)], np.cumsum(sizes) - sizes
        repeat = np.ones(len(ids), np.int64)
        repeat[bare] = sizes[which]
        text_of = np.repeat(np.arange(len(per_text)), per_text)
        out = np.repeat(ids, repeat)
        starts = (np.cumsum(repeat) - repeat)[bare]
        inside = np.arange(int(repeat[bare].sum())) - np.repeat(np.cumsum(repeat[bare]) - repeat[bare], repeat[bare])
        out[np.repeat(starts, repeat[bare]) + inside] = pool[np.repeat(at[which], repeat[bare]) + inside]
        return out, np.bincount(text_of, repeat, len(per_text)).astype(np.int64)


class Surface:
    """What pieces spell: all that decoding needs."""

    def __init__(self, vocab: Vocabulary):
        spelt = [
            bytes([int(p[3:5], 16)]) if k == 1 else p.replace(MARK, " ").encode("utf-8") if k == 0 else b""
            for p, k in zip(vocab.pieces, vocab.kinds)
        ]
        self.surface = np.frombuffer(b"".join(spelt), np.uint8)
        self.lengths = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> list[str]:
        """The texts that runs of ids spell; the space put before a text goes."""
        sizes = self.lengths[ids]
        total = int(sizes.sum())
        where = np.arange(total) + np.repeat(self.starts[ids] - np.cumsum(sizes) + sizes, sizes)
        raw = self.surface[where].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(per_text)))].tolist()
        return [raw[a + 1 : b].decode("utf-8", "surrogatepass") if b > a else "" for a, b in zip(ends, ends[1:])]


def _uniform(base: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """SplitMix64 of a counter, as numbers in [0, 1)."""
    with np.errstate(over="ignore"):
        z = base + np.uint64(0xD1B54A32D192ED03) * (np.asarray(step).astype(np.uint64) + np.uint64(1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)) * 2.0**-53


def _sampler(shared, alpha: float, kept={}) -> Sampler:  # noqa: B006 - one for each worker process
    if alpha not in kept:
        kept.clear()
        kept[alpha] = Sampler(shared.value, alpha)
    return kept[alpha]


def _with_column(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    df = df.drop(name)
    return df, T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", model: str = MODEL,
           alpha: float = ALPHA, seed: int = SEED, decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the sampled piece ids of each text, and the text that they spell if
    ``decoded_col`` is given (as ``decode`` gives it, without handing the ids to another worker)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    docs, schema = _with_column(docs.drop(decoded_col) if decoded_col else docs, ids_col, T.ArrayType(T.IntegerType()))
    if decoded_col:
        schema = schema.add(decoded_col, T.StringType())
    key = fresh(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(F.lit(seed), named(id_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(shared, alpha)
        for whole in batches:
            for batch in _slices(whole, pc.utf8_length(whole.column(text_col)).to_pylist(), CHARS_AT_ONCE):
                texts = batch.column(text_col).to_pylist()
                keys = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                ids, sizes = sampler.encode(texts, keys)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets, mask=np.array([*(t is None for t in texts), False])), pa.array(ids, pa.int32()))
                added = {ids_col: lists}
                if decoded_col:
                    spelt = sampler.decode(ids, sizes)
                    added[decoded_col] = pa.array([None if t is None else d for t, d in zip(texts, spelt)], pa.string())
                kept = [n for n in batch.schema.names if n != key]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *added.values()], names=[*kept, *added])
        give_back()

    return keyed.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, sizes: list[int | None], most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose rows' sizes add up to about ``most``, one row at least."""
    total = np.cumsum([n or 0 for n in sizes])
    at = 0
    while at < batch.num_rows:
        floor = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, floor + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def decode(encoded: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text that its piece ids spell."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    encoded, schema = _with_column(encoded, text_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = Surface(shared.value)
        for whole in batches:
            for batch in _slices(whole, whole.column(ids_col).value_lengths().to_pylist(), IDS_AT_ONCE):
                lists = batch.column(ids_col)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
                texts = [t if ok else None for t, ok in zip(surface.decode(flat, sizes), lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])
        give_back()

    return encoded.mapInArrow(run, schema)
