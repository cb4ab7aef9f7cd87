"""Language-model scores: unigrams of words, and context mixing over the bits of bytes.

A text is read token by token: a run of bytes that are no white space (it may be empty), and the
white space byte or the text's end after it. The model predicts each bit of a token's next byte from
five predictors, whose hashed contexts are the last 1, 2, 3 or 5 bytes of the token or all of it so
far, most of them together with the class of the text so far; each is a pair of counts of the bits 0
and 1 seen there with the byte's earlier bits. A logistic mixer adds the predictors' log odds with
weights chosen by a gate (the bit, and how often three of the contexts were seen), learned online; a
last table, indexed by the mixed odds and the byte's earlier bits, refines the result. The class is
the side of three planes, the main axes of all texts' byte pairs, on which the text so far lies.

Everything that grows with the corpus stays in Spark. Tasks read chunks of documents once, and send
each slice of the hash space their distinct tokens with counts; a slice merges them, and sends each
slice of the context space what its tokens add to its contexts. Contexts' merged counts return to
the slices that met them, where the mixer learns from every training byte (itself left out of the
counts), weights are averaged by examples between rounds, and each distinct token is scored once.
Scores and word counts go back to the chunks, as in `route`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm import route, text
from assay.llm.shared import cut

PAIRS, PLANES = 512, 3
NO_CLASS = 1 << PLANES
#: Bytes of the token that each predictor sees (0: all so far), and whether it sees the class.
SEEN = ((1, True), (2, True), (3, True), (5, False), (0, True))
PREDICTORS = len(SEEN)
LEVELS = 6
GATES = 8 * LEVELS**3
APM = 33
_PRIOR = 0.05
_LIMIT = 12.0
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BYTE = np.uint64(0xFF)


def held_out(doc_id: int | None, modulus: int, remainder: int) -> bool:
    """By the CRC-32 of doc_id as text; a null doc_id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == remainder


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, schema)], schema=schema)


# --- the class of the text so far


def pair_slots(data: np.ndarray) -> np.ndarray:
    """A slot for each byte and the one before it (a line feed before a text)."""
    after = data.astype(np.int64)
    return (np.concatenate([[10], after[:-1]])[: len(after)] * 197 + after * 59) % PAIRS


@dataclass
class Planes:
    """weights: what each byte pair adds to a text's side of each plane, in whole numbers so that sums are exact."""

    weights: np.ndarray  # PLANES x PAIRS


def fit_planes(rows: DataFrame, modulus: int, remainder: int) -> Planes:
    """From the second moments of all training texts' shares of byte pairs; whole numbers, so that sums don't depend on their order."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PAIRS + 1, PAIRS + 1))
        for batch in batches:
            for part in text.pieces(batch, "text", 4 << 20):
                own = [t.lower() for i, t in zip(part.column("doc_id").to_pylist(), text.as_bytes(part.column("text"))) if t and not held_out(i, modulus, remainder)]
                for lo in range(0, len(own), 512):
                    block = own[lo : lo + 512]
                    data, at = text.joined(block)
                    doc = np.repeat(np.arange(len(block)), np.diff(at))
                    n = np.bincount(doc * PAIRS + pair_slots(data), minlength=len(block) * PAIRS).reshape(-1, PAIRS)
                    x = np.ones((len(block), PAIRS + 1))
                    x[:, :PAIRS] = np.rint(n * 1024 / n.sum(axis=1, keepdims=True))
                    total += x.T @ x
        for i, r in enumerate(total.astype(np.int64)):
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([route.pack(r)], pa.binary())], names=["i", "x"])

    def added(table: pa.Table) -> pa.Table:
        x = sum(route.unpack(v.as_py(), np.int64) for v in table.column("x"))
        return pa.table([table.column("i").slice(0, 1), pa.array([route.pack(x)], pa.binary())], names=["i", "x"])

    total = np.zeros((PAIRS + 1, PAIRS + 1))
    for r in rows.mapInArrow(moments, "i int, x binary").groupBy("i").applyInArrow(added, "i int, x binary").toLocalIterator():  # as many rows as slots
        total[r["i"]] = route.unpack(r["x"], np.int64)
    n = max(total[-1, -1], 1.0)
    mean = total[:PAIRS, -1] / n
    _, vectors = np.linalg.eigh(total[:PAIRS, :PAIRS] / n - np.outer(mean, mean))
    axes = vectors[:, -PLANES:]
    return Planes(np.rint((axes - mean @ axes / max(mean.sum(), 1e-12)).T * (1 << 20)).astype(np.int64))


# --- chunks


class Chunk:
    """Tokens of some texts: which word, class and ending each is, and where each text's start (and the end)."""

    def __init__(self, texts: list[bytes], planes: Planes):
        self.data, at = text.joined([t.lower() for t in texts])
        ends = np.flatnonzero(~text.SPACED[self.data])
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        self.first = np.searchsorted(ends, at)
        opening, slots, kind = np.repeat(at[:-1], np.diff(self.first)), pair_slots(self.data), np.zeros(len(ends), np.int64)
        for k, w in enumerate(planes.weights):
            side = np.concatenate([[0], np.cumsum(w[slots])])
            kind |= (side[starts] > side[opening]).astype(np.int64) << k
        kind[starts == opening] = NO_CLASS
        ending = self.data[ends].astype(np.int64)
        ending[np.searchsorted(ends, at[1:] - 1)] = 0
        words, head, self.word = text.grouped(text.word_hashes(self.data, starts, ends))
        self.hashes, self.starts, self.ends = words, starts[head], ends[head]
        self.filled = (ends > starts)[head]
        self.variants, _, self.of = text.grouped(self.word << 16 | kind << 8 | ending)

    def words(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]


_ASK = "slice int, chunk long, words binary, spelled binary, variants binary, counts binary, ids binary"
_ASK_SCHEMA = pa.schema([("slice", pa.int32()), ("chunk", pa.int64()), *[(n, pa.binary()) for n in ("words", "spelled", "variants", "counts", "ids")]])


def _spelled(words: list[bytes]) -> bytes:
    return route.pack(np.frombuffer(b"\n".join([*words, b""]), np.uint8)) if words else b""


def _chunks(slices: int, modulus: int, remainder: int, planes: Planes, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in text.pieces(batch, "text", chunk_bytes):
                c, ids = Chunk(text.as_bytes(part.column("text")), planes), part.column("doc_id")
                learns = np.array([not held_out(i, modulus, remainder) for i in ids.to_pylist()])
                n = np.bincount(c.of, np.repeat(learns, np.diff(c.first)), len(c.variants)).astype(np.int64)
                words, owner, rows = c.words(), c.variants >> 16, []
                for s, a, b in route.cuts(route.slice_of(c.hashes, slices)):
                    x, y = np.searchsorted(owner, [a, b])
                    rows.append((s, chunk, route.pack_sorted(c.hashes[a:b]), _spelled(words[a:b]), route.pack(c.variants[x:y] - (a << 16)), route.pack(n[x:y]), None))
                # what the texts are made of stays with the chunk: for each token its variant, and for each variant its word
                known = np.concatenate([ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), learns])
                rows.append((-1, chunk, route.pack(c.filled.astype(np.uint8)), route.pack(c.first), route.pack(owner), route.pack(c.of.astype(np.uint32)), route.pack(known)))
                yield _batch(rows, _ASK_SCHEMA)
                chunk += 1

    return run


# --- slices of the words


_VOCABULARY = "slice int, words binary, spelled binary, variants binary, counts binary, n_words long, n_tokens long, n_ends long"
_VOCABULARY_SCHEMA = pa.schema([("slice", pa.int32()), *[(n, pa.binary()) for n in ("words", "spelled", "variants", "counts")], *[(n, pa.int64()) for n in ("n_words", "n_tokens", "n_ends")]])


def _vocabulary(table: pa.Table) -> pa.Table:
    """All chunks' words and variants of a slice, each once, with the counts of the training texts."""
    hashes = [route.unpack_sorted(x.as_py()) for x in table.column("words")]
    spelled = [w for x in table.column("spelled") for w in route.unpack(x.as_py(), np.uint8).tobytes().split(b"\n")[:-1]]
    words, head, of = text.grouped(np.concatenate(hashes))
    base = np.cumsum([0, *[len(h) for h in hashes]])
    each = [route.unpack(x.as_py(), np.int64) for x in table.column("variants")]
    variants = np.concatenate([of[b + (v >> 16)] << 16 | v & 0xFFFF for b, v in zip(base, each)])
    variants, _, back = text.grouped(variants)
    n = np.bincount(back, np.concatenate([route.unpack(x.as_py(), np.int64) for x in table.column("counts")]), len(variants)).astype(np.int64)
    spelled = [spelled[k] for k in head.tolist()]
    of_word = np.bincount(variants >> 16, n, len(words)).astype(np.int64) * np.array([len(w) > 0 for w in spelled])
    row = (table.column("slice")[0].as_py(), route.pack_sorted(words), _spelled(spelled), route.pack(variants), route.pack(n), int((of_word > 0).sum()), int(of_word.sum()), int(n[variants & 0xFF == 0].sum()))
    return _table([row], _VOCABULARY_SCHEMA)


class Nodes:
    """The distinct bytes of a slice's tokens, each with the class and all bytes of its token before it, and what they are in each predictor.

    entries: for each predictor, the distinct contexts with the byte (56 bits of hash, 8 of the byte).
    """

    def __init__(self, spelled: bytes, variants: np.ndarray, counts: np.ndarray):
        data = np.frombuffer(spelled, np.uint8)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        before = text.prefix_hashes(data, text.SPACED)
        word = variants >> 16
        size = (ends - starts)[word] + 1
        self.from_ = np.cumsum(size) - size
        depth = np.arange(int(size.sum())) - np.repeat(self.from_, size)
        at, kind = np.repeat(starts[word], size) + depth, np.repeat(variants >> 8 & 0xFF, size).astype(np.uint64)
        byte = data[at].astype(np.uint64)
        byte[self.from_ + size - 1] = (variants & 0xFF).astype(np.uint64)
        salt = (kind + np.uint64(1)) * _M2
        key = (text.mix(before[at] ^ salt) & ~_BYTE | byte)
        nodes, head, self.of = text.grouped(key)
        self.weight = np.bincount(self.of, np.repeat(counts, size), len(nodes))
        at, salt, self.byte, depth, before = at[head], salt[head], byte[head], depth[head], before[at[head]]
        last, code = [], np.zeros(len(head), np.uint64)
        for k in range(1, 6):  # bytes before the token count as 0
            code = code | np.where(depth >= k, data[np.maximum(at - k, 0)], 0).astype(np.uint64) << np.uint64(8 * (k - 1))
            last.append(code)
        self.entries, self.entry = [], []
        for p, (size, with_class) in enumerate(SEEN):
            h = (last[size - 1] if size else before) * _M1 + np.uint64(p + 1)
            entries, _, entry = text.grouped(text.mix(h ^ salt if with_class else h) & ~_BYTE | self.byte)
            self.entries.append(entries)
            self.entry.append(entry)


def _nodes(words: dict) -> Nodes:
    return Nodes(route.unpack(words["spelled"], np.uint8).tobytes(), route.unpack(words["variants"], np.int64), route.unpack(words["counts"], np.int64))


# --- slices of the contexts


_CONTEXT = "slice int, asker int, keys binary, counts binary"
_CONTEXT_SCHEMA = pa.schema([("slice", pa.int32()), ("asker", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ADDED = "slice int, asker int, counts binary, place binary, byte binary, extra binary"
_ADDED_SCHEMA = pa.schema([("slice", pa.int32()), ("asker", pa.int32()), *[(n, pa.binary()) for n in ("counts", "place", "byte", "extra")]])


def _contexts(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch.to_pylist():
                nodes = _nodes(words)
                keys, _, of = text.grouped(np.concatenate(nodes.entries))
                counts = np.concatenate([np.bincount(e, nodes.weight, len(k)) for e, k in zip(nodes.entry, nodes.entries)])
                counts = np.bincount(of, counts, len(keys)).astype(np.int64)
                yield _batch([(s, words["slice"], route.pack_sorted(keys[a:b]), route.pack(counts[a:b])) for s, a, b in route.cuts(route.slice_of(keys, slices))], _CONTEXT_SCHEMA)

    return run


def _added(table: pa.Table) -> pa.Table:
    """For each asker the counts, over all askers, of what it asked for, and of all other bytes in the same contexts.

    The latter come with the place of one of the asked keys of their context. Slice and asker change places.
    """
    asked = [route.unpack_sorted(x.as_py()) for x in table.column("keys")]
    keys, _, back = text.grouped(np.concatenate(asked))
    counts = np.bincount(back, np.concatenate([route.unpack(x.as_py(), np.int64) for x in table.column("counts")]), len(keys)).astype(np.int64)
    context = np.cumsum(np.concatenate([[0], keys[1:] >> np.uint64(8) != keys[:-1] >> np.uint64(8)])) if len(keys) else np.zeros(0, np.int64)
    rows, at = [], np.cumsum([0, *[len(x) for x in asked]])
    for k, asker in enumerate(table.column("asker").to_pylist()):
        own = back[at[k] : at[k + 1]]  # in order, as the asked keys are
        place = np.full(int(context[-1]) + 1 if len(context) else 1, -1)
        place[context[own]] = np.arange(len(own))
        other = place[context] >= 0
        other[own] = False
        other = np.flatnonzero(other & (counts > 0))
        rows.append((asker, table.column("slice")[0].as_py(), route.pack(counts[own]), route.pack(place[context[other]]), route.pack((keys[other] & _BYTE).astype(np.uint8)), route.pack(counts[other])))
    return _table(rows, _ADDED_SCHEMA)


# --- predictors and mixer


def level_of(n: np.ndarray) -> np.ndarray:
    """0: never seen, then once, up to 3, 11 and 99 times, more often."""
    return ((n >= 0.5).astype(np.uint8) + (n >= 1.5) + (n >= 3.5) + (n >= 11.5) + (n >= 99.5)).astype(np.uint8)


def odds_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(_PRIOR)) / (zeros + np.float32(_PRIOR)))


@dataclass
class Mixer:
    weights: np.ndarray  # gates x predictors
    refine: np.ndarray  # APM buckets x byte's earlier bits: probability of a 1

    @staticmethod
    def fresh() -> Mixer:
        return Mixer(np.full((GATES, PREDICTORS), 0.3), np.repeat((1 / (1 + np.exp(-np.linspace(-_LIMIT, _LIMIT, APM))))[:, None], 256, axis=1))

    def refined(self, stretch: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Probability of a 1: the mixer's, averaged with the table's between its two nearest buckets."""
        x = (stretch + _LIMIT) * ((APM - 1) / (2 * _LIMIT))
        lo = np.minimum(x.astype(np.int64), APM - 2)
        part, flat, at = x - lo, self.refine.ravel(), lo * 256 + earlier
        table = flat[at] * (1 - part) + flat[at + 256] * part
        return np.clip((1 / (1 + np.exp(-stretch)) + table) / 2, 1e-6, 1 - 1e-6)


class Predictions:
    """Log odds and levels of each node's bits in each predictor. apart: with the node's own occurrence left out."""

    def __init__(self, nodes: Nodes, keys: np.ndarray, counts: np.ndarray, apart: bool):
        self.nodes, self.odds, self.levels = nodes, [], []
        need = np.sort(np.concatenate(nodes.entries))
        at = np.searchsorted(keys, need)
        odds, levels = np.empty((8, len(need)), np.float32), np.empty((8, len(need)), np.uint8)
        for bit in range(8):
            group = keys >> np.uint64(8 - bit)
            new = np.concatenate([[True], group[1:] != group[:-1]])
            head, of = np.flatnonzero(new), (np.cumsum(new) - 1)[at]
            one = keys >> np.uint64(7 - bit) & np.uint64(1) == 1
            total, ones = (np.add.reduceat(x, head).astype(np.float32)[of] for x in (counts, counts * one))
            zeros, mine = total - ones, one[at]
            if apart:
                ones, zeros = np.maximum(ones - mine, 0), np.maximum(zeros - ~mine, 0)
            odds[bit], levels[bit] = odds_of(zeros, ones), level_of(zeros + ones)
        place = [np.searchsorted(need, e)[i].astype(np.int32) for e, i in zip(nodes.entries, nodes.entry)]
        self.place, self._odds, self._levels = place, odds, levels

    def of(self, at: np.ndarray | slice, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log odds by predictor, gates, bits seen and the byte's earlier bits, of some nodes."""
        place = [p[at] for p in self.place]
        odds = np.array([self._odds[bit][p] for p in place])
        level = [self._levels[bit][place[p]].astype(np.int64) for p in (4, 3, 2)]
        byte = self.nodes.byte[at].astype(np.int64)
        return odds, ((bit * LEVELS + level[0]) * LEVELS + level[1]) * LEVELS + level[2], byte >> (7 - bit) & 1, (byte | 0x100) >> (8 - bit)

    def log10(self, mixer: Mixer, block: int = 1 << 17) -> np.ndarray:
        """log10 of the probability of each node's byte."""
        out, weights = np.zeros(len(self.nodes.byte)), mixer.weights
        for lo in range(0, len(out), block):
            at = slice(lo, lo + block)
            for bit in range(8):
                odds, gate, seen, earlier = self.of(at, bit)
                one = mixer.refined(np.clip((odds * weights[gate].T).sum(axis=0), -_LIMIT, _LIMIT), earlier)
                out[at] += np.log10(np.where(seen == 1, one, 1 - one))
        return out

    def learn(self, mixer: Mixer, rate: float, batch: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The mixer's weights after all training bytes, in batches in order of hash; examples of each gate, and tallies of the refining table."""
        weights, seen_at = mixer.weights.copy(), np.zeros(GATES)
        square, tally = np.full((GATES, PREDICTORS), 1.0), np.zeros((2, APM * 256))
        order = np.flatnonzero(self.nodes.weight > 0)
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            n = self.nodes.weight[at]
            for bit in range(8):
                odds, gate, seen, earlier = self.of(at, bit)
                stretch = np.clip((odds * weights[gate].T).sum(axis=0), -_LIMIT, _LIMIT)
                error = (seen - 1 / (1 + np.exp(-stretch))) * n
                x = np.rint((stretch + _LIMIT) * (APM - 1) / (2 * _LIMIT)).astype(np.int64) * 256 + earlier
                tally[0] += np.bincount(x, n, APM * 256)
                tally[1] += np.bincount(x, n * seen, APM * 256)
                seen_at += np.bincount(gate, n, GATES)
                for p in range(PREDICTORS):
                    step = np.bincount(gate, error * odds[p], GATES)
                    square[:, p] += step * step
                    weights[:, p] += rate * step / np.sqrt(square[:, p])
        return weights, seen_at, tally


def _predictions(words: pa.Table, contexts: pa.Table, apart: bool) -> Predictions:
    nodes = _nodes(words.to_pylist()[0])
    keys, counts, base = text.grouped(np.concatenate(nodes.entries))[0], [], 0
    more, extra = [], []
    for r in sorted(contexts.to_pylist(), key=lambda r: r["asker"]):  # slices are in the order of keys
        counts.append(route.unpack(r["counts"], np.int64))
        more.append(keys[base + route.unpack(r["place"], np.int64)] & ~_BYTE | route.unpack(r["byte"], np.uint8))
        extra.append(route.unpack(r["extra"], np.int64))
        base += len(counts[-1])
    keys, counts = np.concatenate([keys, *more]), np.concatenate([*counts, *extra])
    order = np.argsort(keys)
    return Predictions(nodes, keys[order], counts[order], apart)


def _taught(shared, rate: float):
    schema = pa.schema([("at", pa.int32()), ("value", pa.float64())])

    def run(key: tuple[pa.Scalar, ...], words: pa.Table, contexts: pa.Table) -> pa.Table:
        if not words.num_rows or not contexts.num_rows:
            return schema.empty_table()
        w, seen, tally = _predictions(words, contexts, True).learn(shared.value, rate)
        value = np.concatenate([(w * seen[:, None]).ravel(), seen, tally.ravel()])
        at = np.flatnonzero(value)
        return pa.table([at.astype(np.int32), value[at]], schema=schema)

    return run


_TOLD = "slice int, words binary, variants binary, counts binary, scores binary"
_TOLD_SCHEMA = pa.schema([("slice", pa.int32()), *[(n, pa.binary()) for n in ("words", "variants", "counts", "scores")]])


def _evaluated(shared):
    def run(key: tuple[pa.Scalar, ...], words: pa.Table, contexts: pa.Table) -> pa.Table:
        if not words.num_rows or not contexts.num_rows:
            return _TOLD_SCHEMA.empty_table()
        p = _predictions(words, contexts, False)
        told, own = np.add.reduceat(p.log10(shared.value)[p.nodes.of], p.nodes.from_), words.to_pylist()[0]
        variants = route.unpack(own["variants"], np.int64)
        n = np.bincount(variants >> 16, route.unpack(own["counts"], np.int64)).astype(np.int64)
        return _table([(key[0].as_py(), own["words"], own["variants"], route.pack(n), route.pack(told))], _TOLD_SCHEMA)

    return run


_ANSWER = "chunk long, slice int, counts binary, scores binary"
_ANSWER_SCHEMA = pa.schema([("chunk", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary()), ("scores", pa.binary())])


def _answer(key: tuple[pa.Scalar, ...], asks: pa.Table, told: pa.Table) -> pa.Table:
    """For each chunk the counts of its words and the scores of its variants, in its own order."""
    if not asks.num_rows:
        return _ANSWER_SCHEMA.empty_table()
    own = told.to_pylist()[0]
    words, variants, n, scores = route.unpack_sorted(own["words"]), route.unpack(own["variants"], np.int64), route.unpack(own["counts"], np.int64), route.unpack(own["scores"], np.float64)
    rows = []
    for x in asks.select(["chunk", "words", "variants"]).to_pylist():
        at, v = np.searchsorted(words, route.unpack_sorted(x["words"])), route.unpack(x["variants"], np.int64)
        rows.append((x["chunk"], key[0].as_py(), route.pack(n[at]), route.pack(scores[np.searchsorted(variants, at[v >> 16] << 16 | v & 0xFFFF)])))
    return _table(rows, _ANSWER_SCHEMA)


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, log10_counts double, score double"
_OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log10_counts", pa.float64()), ("score", pa.float64())])


def _scored(ends: int):
    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _OUT_SCHEMA.empty_table()
        x = own.to_pylist()[0]
        got = sorted((r["slice"], r["counts"], r["scores"]) for r in answers.to_pylist())
        n, scores = np.concatenate([route.unpack(c, np.int64) for _, c, _ in got]), np.concatenate([route.unpack(s, np.float64) for _, _, s in got])
        filled, first, owner, of, ids = route.unpack(x["words"], np.uint8) > 0, route.unpack(x["spelled"], np.int64), route.unpack(x["variants"], np.int64), route.unpack(x["counts"], np.uint32), route.unpack(x["ids"], np.int64)
        some, ids, learns = ids.reshape(3, -1)
        word = owner[of]
        total = lambda v: np.add.reduceat(v, first[:-1])
        tokens, known = total(filled[word].astype(np.int64)) + 1, total((filled & (n > 0))[word].astype(np.int64)) + (ends > 0)
        base = total(np.where(filled, np.log10(n + 1.0), 0.0)[word]) + math.log10(ends + 1)
        return pa.table([pa.array(ids, mask=some == 0), learns == 0, tokens, known, base, total(scores[of])], schema=_OUT_SCHEMA)

    return run


@dataclass
class Corpus:
    """What is known of a table of texts: all but planes, mixer and three numbers stays in Spark."""

    asked: DataFrame
    words: DataFrame
    contexts: DataFrame
    planes: Planes
    mixer: Mixer
    n_tokens: int
    n_words: int
    n_ends: int


def read(docs: DataFrame, modulus: int = 7, remainder: int = 2, chunk_bytes: int = 8 << 20, slice_bytes: int = 16 << 20, rounds: int = 1, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> Corpus:
    """Counts and mixer of the texts whose CRC-32 of doc_id isn't `remainder` modulo `modulus`; the others' tokens are only listed.

    slice_bytes: text for each slice of the words and of the contexts. In each of the rounds the
    mixer reads all training bytes once; slices start from the averaged weights of the round before.
    """
    spark, rows = docs.sparkSession, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    slices = max(1, math.ceil(route.text_bytes(docs, text_col) / slice_bytes))
    planes = fit_planes(rows, modulus, remainder)
    asked = cut(rows.mapInArrow(_chunks(slices, modulus, remainder, planes, chunk_bytes), _ASK))
    words = cut(asked.where("slice >= 0").groupBy("slice").applyInArrow(_vocabulary, _VOCABULARY))
    contexts = cut(words.repartition(slices, "slice").mapInArrow(_contexts(slices), _CONTEXT).groupBy("slice").applyInArrow(_added, _ADDED))
    mixer = Mixer.fresh()
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(mixer)
        value = np.zeros(GATES * (PREDICTORS + 1) + 2 * APM * 256)
        taught = words.groupBy("slice").cogroup(contexts.groupBy("slice")).applyInArrow(_taught(shared, rate / (1 + k)), "at int, value double")
        for r in taught.groupBy("at").agg(F.sum("value").alias("value")).toLocalIterator():  # a fixed number
            value[r["at"]] = r["value"]
        w, seen, tally = np.split(value, [GATES * PREDICTORS, GATES * (PREDICTORS + 1)])
        tally, even = tally.reshape(2, APM, 256), Mixer.fresh()
        known = seen[:, None] > 0
        mixer = Mixer(np.where(known, w.reshape(GATES, PREDICTORS) / np.maximum(seen[:, None], 1), even.weights), (tally[1] + 20 * even.refine) / (tally[0] + 20))
        shared.unpersist()
    n = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_words", "n_ends")]).first()
    return Corpus(asked, words, contexts, planes, mixer, *n)


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", **reading) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; a row for each row of docs.

    Learning is from rows whose CRC-32 of doc_id as text isn't `remainder` modulo `modulus` (a null
    doc_id counts as empty text); all rows are scored. A-Z are lower-cased. base_score sums
    log10((c + 1) / (N + V + 1)) over the words `[^\\x20\\x09-\\x0D]+` and one end per text; score is
    log10 of the mixing model's probability of the text's bytes and its end. Null counts as empty:
    one token, the end. Repeated rows count and stay as they are; other columns are not read; an
    empty table gives an empty table. Words are told apart by 64 bits of hash, contexts by 56. One
    text is the least that a task holds, so that the longest text bounds memory. See `read`.
    """
    c = read(docs, modulus, remainder, id_col=id_col, text_col=text_col, **reading)
    shared = docs.sparkSession.sparkContext.broadcast(c.mixer)
    told = c.words.groupBy("slice").cogroup(c.contexts.groupBy("slice")).applyInArrow(_evaluated(shared), _TOLD)
    answers = c.asked.where("slice >= 0").groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(_answer, _ANSWER)
    out = c.asked.where("slice < 0").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored(c.n_ends), _OUT)
    n = c.n_tokens + c.n_ends
    base = F.col("log10_counts") - F.col("n_tokens") * F.lit(math.log10(n + c.n_words + (c.n_ends > 0) + 1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
