"""SentencePiece encoding and decoding by suffix-array matching.

A text is a space and the text, with spaces for the vocabulary's word mark, cut before each run of spaces and around line
feeds: no piece crosses such a cut.  Of a chunk's parts the new distinct ones are concatenated and indexed by a suffix array;
every piece is looked up by binary search for its range of occurrences, which gives the edges (place, length, piece).
Sorted by place, the edges are relaxed from left to right, in all parts at once.

For a unigram model a place takes its best path.  For a BPE model it takes the one edge that the merges allow: a sequence of
pieces is what merging by score gives if each two neighbours are, and two neighbours are if undoing their merges, latest first,
never shows a pair over their boundary that would have merged before (of equal scores the left pair merges first).  So each place has one last piece, and is reached by one edge.
Characters outside the vocabulary become byte pieces (or the unknown piece, if there are none; neighbouring ones are one).

Parts of more than ``LONG`` characters are relaxed one by one, in windows of ``INDEXED`` bytes, so time and memory follow
their length.  The vocabulary is read on the driver, from a path that is a parameter, and broadcast: its size is fixed.  Null texts
have null ids, empty ones none; decoding gives the text back exactly but for a word mark in it, which becomes a space; repeated
rows and other columns change nothing; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import bounded
from .wordhash import _BYTES, U64, chunks, spans

MARK = "▁"
#: Distinct parts that a task remembers, bytes that are indexed at a time, and characters of a part that is relaxed alone.
REMEMBERED, INDEXED, LONG = 400_000, 1 << 18, 64


@dataclass
class Vocabulary:
    """Pieces as bytes with spaces for word marks, scores, and the ids of byte pieces (-1: none)."""

    pieces: list[bytes]
    score: np.ndarray
    normal: np.ndarray  # ids that text is matched with
    byte: np.ndarray  # id of each byte's piece
    unknown: int
    unigram: bool = False
    left: np.ndarray | None = None  # the pieces whose merge made a piece (-1: a character)
    right: np.ndarray | None = None
    rank: np.ndarray | None = None  # of the merge by its score, from the best; -1 for characters
    late: np.ndarray | None = None  # the worst rank of all merges that made a piece: it is there when those have had their turn

    @staticmethod
    def load(path: str, unigram: bool = False) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        byte = np.full(256, -1, np.int32)
        pieces, normal = [], []
        for k in range(size):
            text = m.id_to_piece(k)
            if m.is_byte(k):
                byte[int(text[3:5], 16)] = k
                pieces.append(bytes([int(text[3:5], 16)]))
            elif m.is_control(k) or m.is_unknown(k) or m.is_unused(k):
                pieces.append(b" \xe2\x81\x87 " if m.is_unknown(k) else b"")
            else:
                normal.append(k)
                pieces.append(text.replace(MARK, " ").encode())
        return Vocabulary.of(pieces, np.array([m.get_score(k) for k in range(size)]), np.array(normal, np.int64), byte, m.unk_id(), unigram)

    @staticmethod
    def of(pieces: list[bytes], score: np.ndarray, normal: np.ndarray, byte: np.ndarray, unknown: int, unigram: bool = False) -> Vocabulary:
        """Checked: no piece may cross a cut, and a BPE model's pieces are of characters that are pieces; those that merging never makes go."""
        for k in normal.tolist():
            p = pieces[k]
            if not p or b" " in p.lstrip(b" ") or b"\n" in p and p != b"\n" or b"\0" in p:
                raise ValueError(f"piece {k} ({p!r}) is empty or has a space or line feed within")
        out = Vocabulary(pieces, score, normal, byte, unknown, unigram)
        if not unigram:
            out._undo()
        return out

    def _undo(self) -> None:
        """The last merge of each piece."""
        known = {self.pieces[k]: k for k in self.normal.tolist()}
        self.left, self.right, self.rank = (np.full(len(self.pieces), -1, np.int64) for _ in range(3))
        made = []
        for k in self.normal.tolist():
            now = [c.encode() for c in self.pieces[k].decode()]
            if len(now) == 1:
                continue
            if any(c not in known for c in now):
                raise ValueError(f"piece {k} ({self.pieces[k]!r}) has a character that is no piece")
            while len(now) > 2:
                best = max(((self.score[known[a + b]], -x) for x, (a, b) in enumerate(zip(now, now[1:], strict=False)) if a + b in known), default=None)
                if best is None:
                    break
                now[-best[1] : 2 - best[1]] = [now[-best[1]] + now[1 - best[1]]]
            if len(now) == 2:
                self.left[k], self.right[k] = known[now[0]], known[now[1]]
                made.append(k)
        self.rank[made] = np.unique(-self.score[made], return_inverse=True)[1]
        self.late = self.rank.copy()
        for k in sorted(made, key=lambda k: len(self.pieces[k])):
            self.late[k] = max(self.rank[k], self.late[self.left[k]], self.late[self.right[k]])
        characters = [k for k in self.normal.tolist() if len(self.pieces[k].decode()) == 1]
        self.normal = np.array(sorted([*made, *characters]), np.int64)


class Table:
    """Numbers by key, looked up for whole arrays: open addressing in a table that is an eighth full at most."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        bits = max(4, int(8 * len(key)).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.key, self.value, self.most = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64), 0
        left, at = np.arange(len(key)), self._slot(key)
        while len(left):
            self.most += 1
            free = left[self.key[at] < 0]
            slot = at[self.key[at] < 0]
            self.key[slot] = key[free]  # of several that want a slot the last has it
            self.value[slot] = value[free]
            more = self.key[at] != key[left]
            left, at = left[more], (at[more] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(U64) * U64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, key: np.ndarray, other: int) -> np.ndarray:
        at = self._slot(key)
        found = self.key[at]
        out = np.where(found == key, self.value[at], other)
        again = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.most - 1):
            if not len(again):
                break
            at[again] = (at[again] + 1) & self.mask
            found = self.key[at[again]]
            hit = found == key[again]
            out[again[hit]] = self.value[at[again[hit]]]
            again = again[~hit & (found >= 0)]
        return out


class Pairs:
    """Which pieces of a BPE model may stand one after another."""

    def __init__(self, v: Vocabulary):
        self.left, self.right, self.late = v.left, v.right, v.late
        made = np.flatnonzero(v.left >= 0)
        key = v.left[made] << 32 | v.right[made]
        self.merged = Table(key, v.rank[made])
        # until when a pair over the boundary can merge before the piece to its left or right is made; of equal ranks the left pair goes first
        self.before_left, self.before_right = np.maximum(v.rank, np.where(v.left >= 0, v.late[v.left], -1)), np.maximum(v.rank, np.where(v.left >= 0, v.late[v.right], -1)) + 1
        self.known = dict(zip(key.tolist(), v.rank[made].tolist(), strict=True))
        self.lists = [x.tolist() for x in (v.left, v.right, v.late, self.before_left, self.before_right)]
        self.met: dict[int, bool] = {}

    def allow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of pieces (-1: a character outside of the vocabulary, which merges with nothing)."""
        out = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[at], b[at]
        limit = np.full(len(at), 1 << 40)
        while len(at):
            # would the pair over the boundary have merged before what is undone?
            bad = self.merged.get(a << 32 | b, 1 << 40) < limit
            out[at[bad]] = False
            ra, rb = self.late[a], self.late[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb  # the later merge is undone; of equal ones the right one
            limit = np.where(first, self.before_left[a], self.before_right[b])
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def allows(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return True
        asked = a << 32 | b
        out = self.met.get(asked)
        if out is None:
            left, right, late, before_left, before_right = self.lists
            limit, out = 1 << 40, True
            while True:
                if self.known.get(a << 32 | b, limit) < limit:
                    out = False
                    break
                if late[a] < 0 and late[b] < 0:
                    break
                if late[a] > late[b]:
                    limit, a = before_left[a], right[a]
                else:
                    limit, b = before_right[b], left[b]
            if len(self.met) > REMEMBERED:
                self.met.clear()
            self.met[asked] = out
        return out


class Names:
    """The pieces as keys of a binary search: their first eight bytes, and all bytes of those that have more."""

    def __init__(self, v: Vocabulary):
        names = [v.pieces[k] for k in v.normal.tolist()]
        self.wide = max(map(len, names), default=1)
        self.low, self.high = (np.array([int.from_bytes(p[:8].ljust(8, fill), "big") for p in names], U64) for fill in (b"\0", b"\xff"))
        self.size, self.piece, self.names = np.array([len(p) for p in names], np.int64), v.normal, np.array(names, f"S{self.wide}")


class Edges:
    """Occurrences of every piece in a text, in no order: place, length and piece."""

    def __init__(self, names: Names, text: bytes):
        padded = np.frombuffer(text + bytes(max(8, names.wide)), np.uint8)
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text)].view(">u8").ravel().astype(U64)
        order = np.argsort(eight)
        suffix = eight[order]
        first = np.searchsorted(suffix, names.low, "left")
        count = np.maximum(np.searchsorted(suffix, names.high, "right") - first, 0)
        name = np.repeat(np.arange(len(count)), count)
        place = order[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(name))]
        # the range of a longer piece is that of its first eight bytes; the others are compared
        long = np.flatnonzero(names.size[name] > 8)
        if len(long):
            stands = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, names.wide)[place[long]])
            stands[np.arange(names.wide) >= names.size[name[long]][:, None]] = 0
            keep = np.ones(len(name), bool)
            keep[long] = stands.view(f"S{names.wide}").ravel() == names.names[name[long]]
            place, name = place[keep], name[keep]
        self.place, self.length, self.piece = place, names.size[name], names.piece[name]


class Encoder:
    """Encodes and decodes texts; remembers the parts that it has met."""

    def __init__(self, v: Vocabulary):
        self.v, self.names = v, Names(v)
        self.pairs = None if v.unigram else Pairs(v)
        self.fallback = bool((v.byte >= 0).all())
        #: what a character without a piece costs in a unigram model: 10 more than the worst piece
        self.alone = float(v.score[v.normal].min(initial=0.0)) - 10
        self.forget()
        sizes = np.array([len(p) for p in v.pieces])
        self.size, self.at = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = np.frombuffer(b"".join(v.pieces), np.uint8)

    def forget(self) -> None:
        """Known parts by hash, with their ids' place and number in a store."""
        self.known, self.where, self.count = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the range of each (null: none)."""
        texts = pc.replace_substring(texts.cast(pa.string()).fill_null(""), MARK, " ")
        full = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        texts = pc.if_else(pa.array(full), pc.binary_join_element_wise("", texts, " "), texts)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        texts = pa.concat_arrays([texts]) if texts.offset else texts
        if not ends[-1]:
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        base = int(np.frombuffer(texts.buffers()[1], np.int32, 1, texts.offset * 4)[0])
        data = np.frombuffer(texts.buffers()[2], np.uint8)[base : base + ends[-1]]
        begins = np.empty(len(data), bool)
        begins[0] = True
        begins[1:] = ((data[1:] == 32) & (data[:-1] != 32)) | (data[1:] == 10) | (data[:-1] == 10)
        begins[ends[:-1][np.diff(ends) > 0]] = True
        start = np.flatnonzero(begins)
        stop = np.append(start[1:], len(data))
        hashed = spans(_BYTES[data], start, stop) + (stop - start).astype(U64)
        unique, where, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != unique[inside]
        if new.any():
            if len(self.known) > REMEMBERED:
                self.forget()
                new[:] = True
            self.learn(unique[new], data, start[where[new]], stop[where[new]])
        at = np.searchsorted(self.known, unique)[inverse]
        count = self.count[at]
        range_ = np.concatenate([[0], np.cumsum(count)])
        ids = self.store[np.repeat(self.where[at] - range_[:-1], count) + np.arange(range_[-1])]
        first = range_[np.searchsorted(start, ends)]
        if self.fallback:
            return ids, first
        again = np.zeros(len(ids), bool)  # of unknown characters side by side the first stands for all
        again[1:] = (ids[1:] == self.v.unknown) & (ids[:-1] == self.v.unknown)
        again[first[:-1][np.diff(first) > 0]] = False
        return ids[~again], first - np.concatenate([[0], np.cumsum(again)])[first]

    def learn(self, hashed: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Encode new parts (from start to stop) of data and remember them by hash, which are sorted."""
        size = stop - start
        count, found = np.zeros(len(size), np.int64), []
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        long = heads[stop] - heads[start] > LONG
        short = np.flatnonzero(~long)
        ends, i = np.cumsum(size[short] + 1), 0
        order = []
        while i < len(short):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + INDEXED, "right")))
            some = short[i:j]
            n = size[some] + 1
            text = data[np.minimum(np.arange(n.sum()) + np.repeat(start[some] - np.cumsum(n) + n, n), len(data) - 1)]
            text[np.cumsum(n) - 1] = 10
            count[some], ids = self.segment(text[:-1].tobytes(), size[some])
            found.append(ids)
            i = j
        order.append(short)
        for k in np.flatnonzero(long).tolist():
            found.append(self.stretch(data[start[k] : stop[k]].tobytes()))
            count[k] = len(found[-1])
            order.append([k])
        order = np.concatenate(order).astype(np.int64)
        where = np.empty(len(size), np.int64)
        where[order] = len(self.store) + np.cumsum(count[order]) - count[order]
        self.store = np.concatenate([self.store, *found]).astype(np.int32)
        spot = np.searchsorted(self.known, hashed)
        self.known, self.where, self.count = np.insert(self.known, spot, hashed), np.insert(self.where, spot, where), np.insert(self.count, spot, count)

    def segment(self, text: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each part of ``text``, whose parts of ``size`` bytes stand one byte apart, and all ids."""
        data = np.frombuffer(text, np.uint8)
        begin = np.cumsum(size + 1) - size - 1
        edges = Edges(self.names, text)
        lead = (data & 0xC0) != 0x80
        lead[begin[1:] - 1] = False  # the bytes between parts
        start = np.flatnonzero(lead)
        part = np.searchsorted(begin, start, "right") - 1
        nth = np.arange(len(start)) - np.searchsorted(start, begin)[part]  # character of its part
        until = np.minimum(np.append(start[1:], len(data)), (begin + size)[part])
        # characters without a piece are edges too
        ends = np.zeros(len(data) + 1, bool)
        single = np.zeros(len(data), bool)
        length_of = np.zeros(len(data), np.int64)
        length_of[start] = until - start
        single[edges.place[edges.length == length_of[edges.place]]] = True
        bare = ~single[start]
        place = np.concatenate([edges.place, start[bare]])
        end = np.concatenate([edges.place + edges.length, until[bare]])
        piece = np.concatenate([edges.piece, np.full(int(bare.sum()), -1)])
        step = np.full(len(data), LONG, np.uint8)
        step[start] = nth
        at = step[place]
        by = np.argsort(at, kind="stable")  # by position in their parts
        place, end, piece, at = place[by], end[by], piece[by], at[by]
        cuts = np.searchsorted(at, np.arange(int(nth.max()) + 2))
        last, back = np.full(len(data) + 1, -2), np.zeros(len(data) + 1, np.int64)
        best = np.full(len(data) + 1, -np.inf)
        best[begin] = 0
        for k in range(len(cuts) - 1):  # edges that begin at the k-th character of their parts; those of one part end at different places
            p, e, t = place[cuts[k] : cuts[k + 1]], end[cuts[k] : cuts[k + 1]], piece[cuts[k] : cuts[k + 1]]
            if self.pairs is not None:
                take = self.pairs.allow(last[p], t) if k else np.ones(len(p), bool)
            else:
                value = best[p] + np.where(t >= 0, self.v.score[t], self.alone)
                take = value > best[e]
                best[e[take]] = value[take]
            last[e[take]], back[e[take]] = t[take], p[take]
        now = begin + size
        while len(now):
            ends[now] = True
            now = back[now]
            now = now[step[now] > 0]
        stop = np.flatnonzero(ends)
        first, ids = back[stop], last[stop]
        part = np.searchsorted(begin, first, "right") - 1
        return self.with_bytes(data, first, stop, ids, part, len(size))

    def with_bytes(self, data: np.ndarray, first: np.ndarray, stop: np.ndarray, ids: np.ndarray, part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        lost = ids < 0
        if not lost.any():
            return np.bincount(part, minlength=parts), ids
        if not self.fallback:
            return np.bincount(part, minlength=parts), np.where(lost, self.v.unknown, ids)
        count = np.where(lost, stop - first, 1)
        spot = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(np.repeat(part, count), minlength=parts), np.where(np.repeat(lost, count), self.v.byte[data[spot]], np.repeat(ids, count))

    def stretch(self, text: bytes) -> np.ndarray:
        """Ids of one long part, whose edges are found window by window."""
        data = np.frombuffer(text, np.uint8)
        n = len(data)
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), n)
        last, back = [-2] * (n + 1), [0] * (n + 1)
        best = [-np.inf] * (n + 1)
        best[0] = 0.0
        score, allows = self.v.score.tolist(), self.pairs and self.pairs.allows
        for w in range(0, n, INDEXED):
            edges = Edges(self.names, text[w : w + INDEXED + self.names.wide])
            by = np.argsort(edges.place)
            place, end, piece = ((x[by]).tolist() for x in (edges.place + w, edges.place + edges.length + w, edges.piece))
            x = 0
            inside = lead[np.searchsorted(lead, w) : np.searchsorted(lead, min(n, w + INDEXED)) + 1].tolist()
            for here, to in zip(inside, inside[1:], strict=False):
                prior, value, single = last[here], best[here], False
                while x < len(place) and place[x] < here:
                    x += 1
                while x < len(place) and place[x] == here:
                    e, t = end[x], piece[x]
                    single = single or e == to
                    if allows is None:
                        if value + score[t] > best[e]:
                            best[e], last[e], back[e] = value + score[t], t, here
                    elif allows(prior, t):
                        last[e], back[e] = t, here
                    x += 1
                if not single and (allows is not None or value + self.alone > best[to]):
                    best[to], last[to], back[to] = value + self.alone, -1, here
        stops, now = [], n
        while now:
            stops.append(now)
            now = back[now]
        stop = np.array(stops[::-1], np.int64)
        first = np.concatenate([[0], stop[:-1]])
        return self.with_bytes(data, first, stop, np.array([last[x] for x in stop.tolist()], np.int64), np.zeros(len(stop), np.int64), 1)[1]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The texts of the ids' ranges."""
        count = self.size[ids]
        edge = np.concatenate([[0], np.cumsum(count)])
        data = self.bytes[np.repeat(self.at[ids] - edge[:-1], count) + np.arange(edge[-1])].tobytes()
        cuts = edge[first].tolist()
        return [data[a + 1 : b].decode("utf-8", "replace") if data[a : a + 1] == b" " else data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ids of every row."""
    sent = bounded(docs.sparkSession).sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            for i, j in chunks(batch.column("text"), 1 << 20):
                text = batch.column("text").slice(i, j - i)
                ids, first = encoder.encode(text)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pc.is_null(text))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""
    sent = bounded(rows.sparkSession).sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            ids = batch.column("ids")
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
            texts = encoder.decode(ids.flatten().to_numpy(zero_copy_only=False), offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.if_else(pc.is_null(ids), None, pa.array(texts, pa.string()))], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digest(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and round_trip (whether decoding gives the text back)."""
    sent = bounded(docs.sparkSession).sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            for i, j in chunks(batch.column("text"), 1 << 20):
                text = batch.column("text").slice(i, j - i)
                ids, first = encoder.encode(text)
                raw = ids.astype("<i4")
                sums = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                same = pc.equal(pa.array(encoder.decode(ids, first), pa.string()), text.fill_null(""))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first)), pa.array(sums), same], ["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, round_trip boolean")


#: A public vocabulary, by its place on the driver.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def query(spark: SparkSession, sf_dir: str, path: str = MODEL) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), Vocabulary.load(path))
