"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice; lossless decoding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivolt.llm.common import GOLDEN, column_of, fields_of, mix64, packed, slices, texts_of, uniform

SPACE = "▁"


@dataclass(frozen=True)
class Lattice:
    """model: path of a SentencePiece file on every machine. alpha: exponent of the piece probabilities; 0 draws
    all segmentations alike, a large one nearly always gives the best. seed: of the draws. slice_bytes: text at once."""

    model: str
    alpha: float = 0.5
    seed: int = 1
    slice_bytes: int = 1 << 20


class Vocabulary:
    """A piece model as a trie over symbols, and weights.

    The file is a BPE model: it ranks pieces but has no probabilities. A piece of rank r (0 first) is given
    probability in proportion to 1 / (r + 3), Zipf's law; a character that is no piece is its UTF-8 bytes, each
    as likely as the last rank.
    """

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes_id = np.full(256, -1, np.int64)
        self.raw = [b""] * n
        plain = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.bytes_id[b] = i
                self.raw[i] = bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append((i, piece))
                self.raw[i] = piece.replace(SPACE, " ").encode()
        self.raw = np.array(self.raw, object)
        zipf = np.log(np.arange(len(plain)) + 3.0)
        total = np.log(np.exp(-zipf).sum())
        self.byte_log = -zipf[-1] - total
        chars = sorted({c for _, p in plain for c in p})
        self.symbol = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.symbol[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.longest = max(len(p) for _, p in plain)
        children: dict[int, int] = {}
        piece_at, log_at = [-1], [0.0]
        for rank, (i, piece) in enumerate(plain):
            node = 0
            for c in piece:
                key = node * self.width + int(self.symbol[ord(c)])
                if key not in children:
                    children[key] = len(piece_at)
                    piece_at.append(-1)
                    log_at.append(0.0)
                node = children[key]
            piece_at[node], log_at[node] = i, -zipf[rank] - total
        keys = np.fromiter(children, np.int64, len(children))
        to = np.fromiter(children.values(), np.int64, len(children))
        self.piece_at, self.log_at = np.array(piece_at), np.array(log_at)
        self.first = np.full(self.width, -1, np.int64)  # from the root, by symbol
        root = keys < self.width
        self.first[keys[root]] = to[root]
        self.bits = max(4, int(len(keys)).bit_length() + 2)  # an open hash table, a fifth full
        self.slot_key, self.slot_to = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, -1, np.int64)
        for key, node, slot in zip(keys.tolist(), to.tolist(), self.slot(keys).tolist()):
            while self.slot_key[slot] >= 0:
                slot += 1
            self.slot_key[slot], self.slot_to[slot] = key, node

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The child of each node by a symbol, -1 if there is none."""
        key = node * self.width + symbol
        slot = self.slot(key)
        found = self.slot_key[slot]
        out = np.where(found == key, self.slot_to[slot], -1)
        again = np.flatnonzero((found != key) & (found >= 0))
        while len(again):
            slot[again] += 1
            found = self.slot_key[slot[again]]
            out[again] = np.where(found == key[again], self.slot_to[slot[again]], -1)
            again = again[(found != key[again]) & (found >= 0)]
        return out


@cache
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


class Units:
    """Texts cut where a piece can't reach across: before each run of spaces. A space before the whole text is added.

    codes: distinct unit of each occurrence; doc, ordinal: its text and place there; strings: the distinct units.
    """

    def __init__(self, texts: pa.Array):
        parts = pc.split_pattern(texts, " ")
        n_parts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        encoded = parts.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        strings = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        doc = np.repeat(np.arange(len(texts)), n_parts)
        empty_code = pc.index(encoded.dictionary, "").as_py()
        self.strings = [" " + s for s in strings]
        if empty_code >= 0:
            empty = codes == empty_code
            last = np.zeros(len(codes), bool)
            last[np.cumsum(n_parts) - 1] = True
            at = np.arange(len(codes))
            # empties just before each part, in its text
            stop = np.where(~empty, at, -1)
            stop = np.maximum.accumulate(np.concatenate([[-1], stop[:-1]]))
            begin = np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
            before = at - np.maximum(stop + 1, begin)
            keep = ~empty | last
            whole_empty = empty & last & (before == 0) & (n_parts[doc] == 1)  # an empty text has no unit
            keep &= ~whole_empty
            known: dict[tuple[int, int], int] = {}
            codes = codes.copy()
            for i in np.flatnonzero(keep & ((before > 0) | empty)):
                key = (int(before[i]), int(codes[i]))
                if key not in known:
                    known[key] = len(self.strings)
                    self.strings.append(" " * (key[0] + 1) + strings[key[1]])
                codes[i] = known[key]
            codes, doc = codes[keep], doc[keep]
        self.codes, self.doc = codes, doc
        counts = np.bincount(doc, minlength=len(texts))
        self.ordinal = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)


class Paths:
    """The lattices of distinct units, filtered forward: for each end node its incoming edges and their cumulative odds.

    Units are ranked by falling length, so that node level[r] + rank stands before character r of a unit and
    every level is one run. Edges are made in that order, level by level.
    """

    def __init__(self, v: Vocabulary, strings: list[str], alpha: float):
        length = np.fromiter(map(len, strings), np.int64, len(strings))
        by_length = np.argsort(-length, kind="stable")
        code = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        at0 = np.cumsum(length) - length
        longest = int(length.max(initial=0))
        ranked = length[by_length]
        #: units with more than r characters, for each r; level[r]: the first node before character r
        more = len(strings) - np.searchsorted(ranked[::-1], np.arange(longest + 1), side="right")
        level = np.zeros(longest + 2, np.int64)
        level[1:] = len(strings) + np.concatenate([[0], np.cumsum(more)])[: longest + 1]
        rank = np.empty(len(strings), np.int64)
        rank[by_length] = np.arange(len(strings))
        self.begin_node, self.end_node = rank, level[length] + rank
        rel = np.repeat(np.arange(longest), more[:longest])
        unit = np.arange(len(rel)) - np.repeat(np.cumsum(more[:longest]) - more[:longest], more[:longest])
        code = code[at0[by_length][unit] + rel].astype(np.int64)
        spaced = np.where(code == 0x20, ord(SPACE), np.where(code == ord(SPACE), 0x10FFFF, code))
        symbol = v.symbol[spaced].astype(np.int64)
        char0 = np.cumsum(more[:longest]) - more[:longest]  # the first character of each level
        left = (ranked[unit] - rel).astype(np.int32)
        starts, ends, weights, pieces = [], [], [], []

        def add(at, size, weight, piece):
            starts.append((level[rel[at]] + unit[at]).astype(np.int32))
            ends.append((level[rel[at] + size] + unit[at]).astype(np.int32))
            weights.append(weight)
            pieces.append(piece.astype(np.int32))

        single = v.first[symbol]
        lone = np.flatnonzero((symbol == 0) | (single < 0) | (v.piece_at[np.maximum(single, 0)] < 0))
        points = code[lone]
        n_bytes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        add(lone, 1, np.exp(alpha * n_bytes * v.byte_log), np.where(points < 0x80, v.bytes_id[np.minimum(points, 0x7F)], -points))  # below 0: bytes of a character
        at = np.flatnonzero(single >= 0)
        state, depth, node_weight = single[at], 1, np.exp(alpha * v.log_at)
        while len(at):
            hit = v.piece_at[state] >= 0
            add(at[hit], depth, node_weight[state[hit]], v.piece_at[state[hit]])
            further = left[at] > depth
            at, state = at[further], state[further]
            state = v.step(state, symbol[char0[rel[at] + depth] + unit[at]])
            ok = state >= 0
            at, state = at[ok], state[ok]
            depth += 1
        del symbol, single, lone, points, at, state, left, unit, spaced, code
        b = np.concatenate(ends)
        ends.clear()
        order = np.argsort(b, kind="stable")
        b = b[order]
        self.a = np.concatenate(starts)[order]
        starts.clear()
        self.piece = np.concatenate(pieces)[order]
        pieces.clear()
        weight = np.concatenate(weights)[order]
        weights.clear()
        del order
        nodes = len(strings) + len(rel)
        #: edges into node k (k past the begin nodes): edge0[k - units] up to the next
        self.units = len(strings)
        self.edge0 = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        self.edge1 = np.append(self.edge0[1:], len(b)) - 1 if len(b) else self.edge0
        total = np.ones(nodes)
        odds = np.empty(len(b))
        for r in range(1, longest + 1):
            n = int(more[r - 1])
            k = level[r] - len(strings)
            lo, hi = self.edge0[k], self.edge1[k + n - 1] + 1
            flow = weight[lo:hi] * total[self.a[lo:hi]]
            summed = np.add.reduceat(flow, self.edge0[k : k + n] - lo)
            total[level[r] : level[r] + n] = summed
            odds[lo:hi] = flow / summed[b[lo:hi] - level[r]]
            if r % 8 == 0:  # keep long units in range: scale what later edges can still start from
                for back in range(min(r, v.longest)):
                    total[level[r - back] : level[r - back] + n] /= summed
        del total, weight
        run = np.cumsum(odds)
        del odds
        first = self.edge0[b - len(strings)]
        self.cum = b + (run - np.where(first > 0, run[first - 1], 0.0))  # node + odds so far: rising over all edges

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The incoming edge of each node at which the odds so far reach u."""
        edge, last = self.edge0[node - self.units], self.edge1[node - self.units]
        goal = node + u
        left = np.flatnonzero(edge < last)
        while len(left):
            left = left[self.cum[edge[left]] < goal[left]]
            edge[left] += 1
            left = left[edge[left] < last[left]]
        return edge


def sample(texts: pa.Array, row_seed: np.ndarray, p: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all texts, their number per text); row_seed: 64 bits per text that decide all its draws."""
    v, units = vocabulary(p.model), Units(texts)
    n = len(texts)
    if not len(units.codes):
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    paths = Paths(v, units.strings, p.alpha)
    node = paths.end_node[units.codes]
    begin = paths.begin_node[units.codes]
    live = np.arange(len(node))
    seed = mix64(row_seed[units.doc] + GOLDEN * (units.ordinal.astype(np.uint64) << np.uint64(20)))
    taken, step = [], 0
    while len(live):
        u = uniform(mix64(seed[live] + np.uint64(step * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)))
        edge = paths.draw(node[live], u)
        taken.append((live, paths.piece[edge].astype(np.int32)))
        node[live] = paths.a[edge]
        live = live[node[live] != begin[live]]
        step += 1
    count = np.zeros(len(node), np.int64)
    for who, _ in taken:
        count[who] += 1
    last = np.cumsum(count) - 1
    ids = np.empty(int(count.sum()), np.int32)
    for k, (who, piece) in enumerate(taken):
        ids[last[who] - k] = piece
    doc = np.repeat(units.doc, count)
    if (ids < 0).any():  # characters that are no piece become their bytes
        point = -ids.astype(np.int64)
        wide = np.where(ids < 0, 2 + (point > 0x7FF) + (point > 0xFFFF), 1)
        first = np.cumsum(wide) - wide
        out = np.repeat(ids, wide)
        for size in (2, 3, 4):
            at = np.flatnonzero((ids < 0) & (wide == size))
            for j in range(size):
                shift = 6 * (size - 1 - j)
                lead = (0, 0, 0xC0, 0xE0, 0xF0)[size] if j == 0 else 0x80
                out[first[at] + j] = v.bytes_id[lead | (point[at] >> shift if j == 0 else (point[at] >> shift) & 0x3F)]
        ids, doc = out, np.repeat(doc, wide)
    return ids, np.bincount(doc, minlength=n)


def _texts(raw: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The UTF-8 text of each run of ids; the space put before it goes."""
    return [b"".join(raw[ids[a:b]].tolist())[1:] for a, b in zip(ends, ends[1:])]


def _encoded(p: Lattice, text_at: int, id_at: int, keep: list[int] | None, ids_wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = vocabulary(p.model).raw
        for batch in batches:
            for part in slices(batch, text_at, p.slice_bytes):
                texts = texts_of(part, text_at)
                key = pc.fill_null(column_of(part, id_at).cast(pa.int64()), -1).to_numpy(zero_copy_only=False).view(np.uint64)
                ids, n = sample(texts, mix64(mix64(key + np.uint64(p.seed)) + GOLDEN), p)
                ends = np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:])]
                if ids_wanted:
                    last, name = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), "ids"
                else:
                    back = pa.array(_texts(raw, ids, ends), pa.binary())
                    last, name = pc.equal(back, texts.cast(pa.binary())), "lossless"
                yield pa.RecordBatch.from_arrays([fields_of(part.column("row"), keep), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64()), last], ["row", "n_pieces", "ids_crc32", name])

    return run


def _decoded(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = vocabulary(model).raw
        for batch in batches:
            lists = batch.column("ids")
            for lo in range(0, batch.num_rows, 256):
                part = lists.slice(lo, 256)
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))])
                ids = part.flatten().to_numpy(zero_copy_only=False)
                out = _texts(raw, ids, ends)
                piece = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(out, pa.binary()).cast(pa.string())], ["row", "decoded"])

    return run


DIGEST = [T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType())]


def _run(docs: DataFrame, p: Lattice, id_col: str, text_col: str, keep: list[str] | None, last: T.StructField) -> DataFrame:
    rows, text_at = packed(docs, text_col)
    kept = None if keep is None else [docs.columns.index(c) for c in keep]
    fields = rows.schema["row"].dataType.fields
    row = T.StructType(fields if kept is None else [fields[i] for i in kept])
    run = _encoded(p, text_at, docs.columns.index(id_col), kept, last.name == "ids")
    return rows.mapInArrow(run, T.StructType([T.StructField("row", row), *DIGEST, last]))


def encode(docs: DataFrame, p: Lattice, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) packed as `row`, with n_pieces, ids_crc32 (little-endian 32-bit ids) and ids (pieces of one sampled segmentation).

    The draws of a row depend on p.seed and its id_col alone (null as -1), not on partitions or other rows; repeated
    rows get the same pieces. Null and empty texts have no pieces. Texts are taken whole; a space is put
    before each, as the model does, and a literal U+2581 is spelt in bytes, so decode() always gives the
    text back. Other columns stay in `row`; an empty table gives no rows.
    """
    return _run(docs, p, id_col, text_col, keep, T.StructField("ids", T.ArrayType(T.IntegerType())))


def round_trip(docs: DataFrame, p: Lattice, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As encode(), but the ids are decoded where they were made: lossless tells whether they give the text back."""
    return _run(docs, p, id_col, text_col, keep, T.StructField("lossless", T.BooleanType()))


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """encoded packed as `row`, with decoded: the text that the ids stand for (no ids: empty)."""
    rows = encoded.select(F.struct(*(F.col(f"`{c}`") for c in encoded.columns if c != ids_col)).alias("row"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(_decoded(model), T.StructType([rows.schema["row"], T.StructField("decoded", T.StringType())]))
