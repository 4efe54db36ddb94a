"""Fuzzy line dedup: signatures of normalised lines, joined by blocks, edit similarity, one occurrence per group.

A line is what stands between line feeds; normalised, it is its words of letters, digits and non-ASCII characters, A-Z
lower-cased, joined by spaces.  Equal normalised lines are one; distinct ones link if their edit similarity, 1 - distance / longer
length, is at least ``similarity``.  Of each connected group the first occurrence, by document and place, stays.

Lines meet where they agree in a key that fits their length: MinHashes over words (long lines) or character n-grams, every choice of one
word left out of lines up to ``FEW_WORDS`` words (unless it is most of the line), and every choice of up to two characters left out
of lines up to ``FEW_CHARS`` characters.  Lines that meet by MinHash are compared by their SimHash before their texts are
fetched.  Pigeonhole blocks of the SimHash alone lose most near lines, and MinHash keys miss some by chance: README has the figures.

All lines of a key whose SimHashes are near meet, whatever their number: a key of many lines is dealt into blocks, and each pair of
blocks is compared by SimHash in a task of its own; clusters of more than ``BLOCK`` lines are compared block against block.

Lines without a word stay; null texts stay null; a text loses the line and its line feed; texts that lose nothing stay
as they are, byte for byte; documents are ordered by doc_id, nulls first, and those that share one by a hash of their text; equal
rows are one document, and each gives its own result; empty tables give no rows; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, keep_memory, small
from .components import Forest, components
from .wordhash import _BASE, LOWER, U64, _offsets, _powers, _translated, chunks, mix, split

NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x41:0x5B] = NOT_WORD[0x61:0x7B] = NOT_WORD[0x80:] = False
LANES = U64(0x0101010101010101)


class Lines:
    """Lines with a word of one chunk of texts."""

    def __init__(self, texts: pa.Array):
        w = split(texts, lower=True, separator=NOT_WORD)
        self.w = w
        feeds = np.flatnonzero(w.data == 10)
        opens = np.zeros(len(w.start) + 1, bool)  # the first word after each line feed and of each text
        opens[np.searchsorted(w.start, feeds)] = True
        opens[w.first[:-1]] = True
        self.at = np.flatnonzero(opens[:-1])
        self.doc = np.searchsorted(w.first, self.at, side="right") - 1
        self.place = np.searchsorted(feeds, w.start[self.at]) - np.searchsorted(feeds, w.base[:-1])[self.doc]
        self.count = np.diff(np.append(self.at, len(w.start)))

    def hash(self, seed: int = 0) -> np.ndarray:
        """A hash of each line's words in order; of another seed another one."""
        w, at = self.w, self.at
        if not len(at):
            return np.zeros(0, U64)
        power = _powers(int(self.count.max()))[np.arange(len(w.hash)) - np.repeat(at, self.count)]
        return mix(np.add.reduceat((mix(w.hash ^ U64(seed)) if seed else w.hash) * power, at))


class Places:
    """Lines of one chunk of texts (null: none), each with its line feed, by bytes alone."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        texts = texts.fill_null("") if texts.null_count else texts
        ends = _offsets(texts).astype(np.int64)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.base = ends - ends[0]
        begins = np.zeros(len(self.data) + 1, bool)
        begins[1:] = self.data == 10
        begins[self.base[:-1]] = True
        self.start = np.flatnonzero(begins[:-1])
        #: of each text its first line, and the end
        self.first = np.searchsorted(self.start, self.base)
        #: numbers of the lines with a word, and of each its text and its place in it
        self.at = np.flatnonzero(np.logical_or.reduceat(_translated(self.data, ~NOT_WORD), self.start)) if len(self.start) else self.start
        self.doc = np.searchsorted(self.first, self.at, side="right") - 1
        self.place = self.at - self.first[self.doc]

    def without(self, gone: np.ndarray) -> pa.Array:
        """The texts without the lines ``gone``, a flag for each line with a word, and a line feed of each."""
        stays = np.ones(len(self.start), bool)
        stays[self.at[gone]] = False
        size = np.diff(np.append(self.start, len(self.data)))
        kept = np.repeat(stays, size)
        # a text that loses its last line ends without the line feed of the last that stays; what ends in one has an empty last line
        full = np.flatnonzero(np.diff(self.base) > 0)
        full = full[~stays[self.first[full + 1] - 1]]
        last = np.maximum.accumulate(np.where(stays, np.arange(len(stays)), -1))[self.first[full + 1] - 1]
        full, last = full[last >= self.first[full]], last[last >= self.first[full]]
        ends_open = self.data[self.base[full + 1] - 1] != 10
        kept[(self.start + size)[last[ends_open]] - 1] = False
        total = np.concatenate([[0], np.cumsum(size * stays)])[self.first]
        total[1:] -= np.cumsum(np.bincount(full[ends_open], minlength=len(self.base) - 1))
        body = pa.StringArray.from_buffers(len(self.texts), pa.py_buffer(total.astype(np.int32)), pa.py_buffer(self.data[kept]))
        return pc.if_else(self.texts.is_valid(), body, pa.scalar(None, pa.string())) if self.texts.null_count else body


def places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each line with a word its text's number and its place in it."""
    x = Places(texts)
    return x.doc, x.place


def simhash(hashed: np.ndarray, count: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each group of ``count`` hashes, one group after another."""
    out = np.zeros(len(count), U64)
    if not len(count):
        return out
    at = np.cumsum(count) - count
    if count.max() > 0xFF:
        few = count <= 0xFF
        if few.any():
            of_few = np.repeat(few, count)
            out[few], out[~few] = simhash(hashed[of_few], count[few]), simhash(hashed[~of_few], count[~few])
            return out
        for b in range(64):
            out |= (2 * np.add.reduceat((hashed >> U64(b)) & U64(1), at).astype(np.int64) > count).astype(U64) << U64(b)
        return out
    # eight counters of 8 bits in a word
    sums = np.stack([np.add.reduceat((hashed >> U64(b)) & LANES, at) for b in range(8)])
    more = sums.view(np.uint8).reshape(8, -1, 8) > (count // 2).astype(np.uint8)[:, None]
    return np.ascontiguousarray(np.packbits(more, axis=0, bitorder="little")[0]).view("<u8").ravel().astype(U64, copy=False)


#: Keys by MinHash: of words for lines of ``MANY_WORDS`` and more, of character n-grams for lines of up to ``SOME_WORDS`` (n, and the
#: bytes of the lines that have them); keys, and MinHashes of a key.  The ranges overlap so that lines of edit similarity 0.8 share one.
MANY_WORDS, SOME_WORDS = 12, 15
OF_WORDS, OF_GRAMS = (7, 5), (8, 4)
GRAMS = ((4, 12, 250), (6, 180, 1 << 40))
FEW_WORDS, FEW_CHARS, WORD_SHARE = 12, 14, 0.7
#: Bits of the SimHash that may differ: near lines differ in 4 (of words) or 6 (of n-grams) of 64 on average, others in 27 and 29.
BITS = 19
#: A key's lowest bits name its kind: family and key, and the two kinds after them.
KIND = 31
_SEEDS = np.random.default_rng(7).integers(1, 2**31, 64, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
#: Lines of a crowd; lines that a task knows as sent; lines of a block of a key, two of which are compared by SimHash in one task.
CROWD, HELD, CROWD_BLOCK = 256, 1 << 19, 4096


def _shorter(line: str) -> set[str]:
    """The line without the characters that may be edited, up to two, in all ways, and itself."""
    out = last = {line}
    for _ in range(len(line) // 5):
        last = {x[:k] + x[k + 1 :] for x in last for k in range(len(x))}
        out = out | last
    return out


def _least(value: np.ndarray, first: np.ndarray, keys: int, rows: int) -> Iterator[np.ndarray]:
    """Keys of ``rows`` MinHashes each of the values from each ``first`` to the next, the last to the end."""
    turned = np.empty_like(value)
    for k in range(keys):
        key = np.zeros(len(first), U64)
        for j in range(rows):
            key = mix((key << U64(1)) + np.minimum.reduceat(np.multiply(value, _SEEDS[k * rows + j], out=turned), first).astype(U64))
        yield key


def signatures(x: Lines, only: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the lines ``only`` (numbers in order): the line's place in ``only``, key, and SimHash to compare under it (0: none)."""
    w = x.w
    kind = lambda key, k: (key & ~U64(KIND)) | U64(k)
    words_of = lambda lines: np.repeat(x.at[lines] - (np.cumsum(x.count[lines]) - x.count[lines]), x.count[lines]) + np.arange(int(x.count[lines].sum()))
    number = 0

    many = np.flatnonzero(x.count[only] >= MANY_WORDS)
    if len(many):
        count, hashed = x.count[only[many]], w.hash[words_of(only[many])]
        bits, end = simhash(hashed, count), np.cumsum(count)
        for key in _least((hashed >> U64(32)).astype(np.uint32), end - count, *OF_WORDS):
            yield many, kind(key, number), bits
            number += 1

    # the others are few; their normalised text, a space after each word
    some = np.flatnonzero(x.count[only] <= SOME_WORDS)
    if not len(some):
        return
    words, count = words_of(only[some]), x.count[only[some]]
    start, size, hashed = w.start[words], (w.end - w.start)[words], w.hash[words]
    first = np.concatenate([[0], np.cumsum(count)])
    out_at = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(int(out_at[-1]) + 8, 0x20, np.uint8)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[place + np.repeat(out_at[:-1], size)] = w.data[place + np.repeat(start, size)]
    begin, stop = out_at[first[:-1]], out_at[first[1:]] - 1
    length = stop - begin
    eight = np.lib.stride_tricks.sliding_window_view(text, 8).view("<u8").ravel()
    for n, least, most in GRAMS:
        rows = np.flatnonzero((length >= least) & (length <= most))
        number = OF_WORDS[0] + OF_GRAMS[0] * (n != GRAMS[0][0])
        if len(rows):
            grams = length[rows] - n + 1
            end = np.cumsum(grams)
            value = mix(eight[np.arange(int(end[-1])) + np.repeat(begin[rows] - end + grams, grams)] & U64((1 << 8 * n) - 1))
            bits = simhash(value, grams)
            for key in _least((value >> U64(32)).astype(np.uint32), end - grams, *OF_GRAMS):
                yield some[rows], kind(key, number), bits
                number += 1
    number = OF_WORDS[0] + 2 * OF_GRAMS[0]

    # one word left out
    few = np.flatnonzero(count <= FEW_WORDS)
    if len(few):
        nth = np.arange(len(hashed)) - np.repeat(first[:-1], count)
        power = _powers(FEW_WORDS + 1)
        near = np.minimum(nth, FEW_WORDS)
        before = np.concatenate([np.zeros(1, U64), np.cumsum(hashed * power[near])])
        after = np.concatenate([np.zeros(1, U64), np.cumsum(hashed * power[np.maximum(near - 1, 0)])])
        yield some[few], kind(mix(before[first[few + 1]] - before[first[few]]), number), np.zeros(len(few), U64)
        row = np.repeat(np.arange(len(some)), count)
        out = np.flatnonzero((count[row] <= FEW_WORDS) & (size <= (1 - WORD_SHARE) * length[row]))
        r = row[out]
        yield some[r], kind(mix(before[out] - before[first[r]] + after[first[r + 1]] - after[out + 1]), number), np.zeros(len(out), U64)

    # up to two characters left out
    chars = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    raw, rows, found = text.tobytes(), [], []
    for r in np.flatnonzero(chars[stop] - chars[begin] <= FEW_CHARS).tolist():
        line = raw[begin[r] : stop[r]].decode("utf-8", "replace")
        for k in _shorter(line):
            rows.append(some[r])
            found.append(zlib.crc32(k.encode()))
    yield np.array(rows, np.int64), kind(mix(np.array(found, U64)), number + 1), np.zeros(len(rows), U64)


def balls(s: np.ndarray) -> Iterator[np.ndarray]:
    """Places in ``s`` of lines that may be near: connected by near SimHashes, of however many lines."""
    left = np.arange(len(s))
    while len(left):
        found = [left[:1]]
        left, k = left[1:], 0
        front = [int(found[0][0])]
        while k < len(front) and len(left):
            near = np.bitwise_count(s[left] ^ s[front[k]]) <= BITS
            k += 1
            if near.any():
                found.append(left[near])
                front += left[near].tolist()
                left = left[~near]
        yield np.sort(np.concatenate(found))


def gather(key: np.ndarray, ids: np.ndarray, s: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From rows by key, each line once in it: name and id of the lines of each ball, and which rows are the first of theirs.

    Keys of fewer lines than ``least`` are left as they are.  A ball is named by its lines, so that it is one under all keys.
    """
    cuts = np.flatnonzero(np.diff(key)) + 1
    first = np.concatenate([[0], cuts])
    size = np.diff(np.append(first, len(key)))
    stands = np.ones(len(key), bool)
    names, found = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    if least <= 2:  # most keys that have more than one line have two
        pair = first[size == 2]
        pair = pair[np.bitwise_count(s[pair] ^ s[pair + 1]) <= BITS]
        total = mix(mix(ids[pair].view(U64)) + mix(ids[pair + 1].view(U64)))
        names += [total, total]
        found += [ids[pair], ids[pair + 1]]
    for a, n in zip(first[size >= max(least, 3)].tolist(), size[size >= max(least, 3)].tolist(), strict=True):
        inside = np.zeros(n, bool)
        for ball in balls(s[a : a + n]):
            if len(ball) > 1:
                own = ids[a + ball]
                names.append(np.repeat(mix(mix(own.view(U64)).sum(keepdims=True)), len(own)))
                found.append(own)
            inside[ball[1:]] = True
            inside[ball[0]] = False
        stands[a : a + n] = ~inside
    return np.concatenate(names).view(np.int64), np.concatenate(found), stands


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, s) of each task's distinct lines."""
    keep_memory()
    known = np.zeros(0, U64)
    for batch in batches:
        for i, j in chunks(batch.column("text")):
            x = Lines(batch.column("text").slice(i, j - i))
            if not len(x.at):
                continue
            h = x.hash()
            by = np.argsort(h, kind="stable")
            by = by[np.diff(h[by], prepend=~h[by[:1]]) != 0]
            if len(known):
                by = by[known[np.minimum(np.searchsorted(known, h[by]), len(known) - 1)] != h[by]]
            only = np.sort(by)
            if not len(only):
                continue
            known = np.sort(np.concatenate([known, h[only]]))
            ids = h[only].view(np.int64)
            found = [(key.view(np.int64), ids[row], s.view(np.int64)) for row, key, s in signatures(x, only)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*found, strict=True)], ["key", "id", "s"])
        if len(known) > HELD:
            known = np.zeros(0, U64)


def _by(column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of rows sorted by ``column``, all rows of a value together."""
    rest: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if not len(now[column]):
            continue
        if rest and rest[column][-1][-1] == now[column][0] == now[column][-1]:
            for c, v in now.items():
                rest[c].append(v)
            continue
        now = {c: np.concatenate([*rest.get(c, ()), v]) for c, v in now.items()}
        open_from = int(np.searchsorted(now[column], now[column][-1]))
        rest = {c: [v[open_from:]] for c, v in now.items()}
        if open_from:
            yield {c: v[:open_from] for c, v in now.items()}
    if rest:
        yield {c: np.concatenate(v) for c, v in rest.items()}


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, id, s) sorted by key: (cluster, id, s, open) of lines that may be near.

    A key of more than two blocks of ``CROWD_BLOCK`` lines is dealt: its lines go to each pair of blocks that they are in, ``open``.
    """
    keep_memory()
    for x in _by("key", batches):
        key, ids, s = x["key"], x["id"], x["s"]
        more = np.zeros(len(key) + 1, bool)
        more[1:-1] = key[1:] == key[:-1]
        more = np.flatnonzero(more[1:] | more[:-1])
        if not len(more):
            continue
        more = more[np.lexsort((ids[more], key[more]))]
        key, ids, s = key[more], ids[more], s[more]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids, s = key[once], ids[once], s[once]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        size = np.diff(np.append(first, len(key)))
        crowded = np.repeat(size > 2 * CROWD_BLOCK, size)
        names, members, _ = gather(key[~crowded], ids[~crowded], s[~crowded].view(U64))
        yield _rows(names, members, np.zeros(len(names), np.int64), False)
        for a, n in zip(first[size > 2 * CROWD_BLOCK].tolist(), size[size > 2 * CROWD_BLOCK].tolist(), strict=True):
            blocks = -(-n // CROWD_BLOCK)
            block = (mix(ids[a : a + n].view(U64)) % U64(blocks)).astype(np.int64)
            for other in range(blocks):
                at = np.flatnonzero(block != other)
                low, high = np.minimum(block[at], other), np.maximum(block[at], other)
                part = mix(key[a : a + 1].view(U64) + mix((low * blocks + high + 1).astype(U64))).view(np.int64)
                yield _rows(part, ids[a + at], s[a + at], True)


def _rows(cluster: np.ndarray, ids: np.ndarray, s: np.ndarray, opened: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(ids), pa.array(s), pa.array(np.full(len(ids), opened))], ["cluster", "id", "s", "open"])


def _crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From what ``_met`` gives, sorted by cluster: (cluster, home, id); lines that met in pairs of blocks by their SimHashes.

    A cluster's home is its least line: clusters that overlap, as those of a line's other keys do, have it in common more often than not.
    """
    for x in _by("cluster", batches):
        dealt = x["open"]
        names, members, _ = gather(x["cluster"][dealt], x["id"][dealt], x["s"][dealt].view(U64)) if dealt.any() else (np.zeros(0, np.int64),) * 3
        cluster, ids = np.concatenate([x["cluster"][~dealt], names]), np.concatenate([x["id"][~dealt], members])
        by = np.lexsort((ids, cluster))
        cluster, ids = cluster[by], ids[by]
        first = np.flatnonzero(np.diff(cluster, prepend=~cluster[:1]))
        home = np.repeat(ids[first], np.diff(np.append(first, len(ids))))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (cluster, home, ids)], ["cluster", "home", "id"])


#: Lines of a cluster that a task compares one with another: two blocks of so many.
BLOCK = 512


#: Pairs of a cluster that are looked at together, and lines and pairs that a task remembers.
PAIRS, REMEMBERED = 4096, 1 << 18


class Links:
    """A forest of links by edit similarity between lines, cluster by cluster.

    All pairs of a cluster are compared, but those that are connected by then, by this cluster or an earlier one, and those
    that were found apart before.
    """

    def __init__(self, similarity: float):
        self.similarity, self.forest, self.apart = similarity, Forest(), set()

    def near(self, i: int, j: int, a: str, b: str) -> bool:
        """Whether the lines i and j link; lines that were found apart are not compared again."""
        pair = (i, j) if i < j else (j, i)
        if pair in self.apart:
            return False
        if alike(a, b, self.similarity):
            return True
        self.apart.add(pair)
        return False

    def close(self, clusters: list[tuple[list[int], list[str]]]) -> Iterator[tuple[int, int]]:
        """Links of clusters (ids, lines) that are looked at together, so that pairs far apart are told by the arrays of ``far``."""
        if len(self.forest.up) > REMEMBERED or len(self.apart) > REMEMBERED:
            self.forest, self.apart = Forest(), set()
        # neighbours in the order of the texts first: copies of many lines are connected by them, and few pairs are left
        yield from self._compared([(ids, lines, *self._nearest(ids, lines, True)) for ids, lines in clusters])
        rest = [(ids, lines, *self._nearest(ids, lines, False)) for ids, lines in clusters if len(ids) > 2]
        most = PAIRS // 16
        while rest := [x for x in rest if len(x[2])]:
            # what connects a large cluster comes early, and most of its pairs need no look then
            yield from self._compared([(ids, lines, one[:most], two[:most]) for ids, lines, one, two in rest])
            rest = [(ids, lines, *self._open(ids, one[most:], two[most:])) for ids, lines, one, two in rest]
            most *= 2

    def _open(self, ids: list[int], one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are not connected yet."""
        if not len(one):
            return one, two
        group = np.array([self.forest.root(i) for i in ids])
        open_ = group[one] != group[two]
        return one[open_], two[open_]

    def _nearest(self, ids: list[int], lines: list[str], neighbours: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs, nearest first, that are not connected and that lengths and counts of characters leave open."""
        n = len(ids)
        if neighbours:
            by = np.array(sorted(range(n), key=lines.__getitem__))
            one, two = self._open(ids, by[:-1], by[1:])
        else:
            group = np.array([self.forest.root(i) for i in ids])
            one, two = np.nonzero(np.tril(group[:, None] != group, -1))
        if neighbours or n == 2 or not len(one):  # grams tell neighbours apart
            return one, two
        size = np.array([len(x) for x in lines])
        bag = np.bincount(np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32) % 64 + 64 * np.repeat(np.arange(n), size), minlength=64 * n).reshape(n, 64)
        longer = np.maximum(size[one], size[two])
        most = longer - self.similarity * longer + 1e-9
        # characters that only one of two lines has take an edit for each two
        apart = np.concatenate([np.zeros(0, np.int64), *(np.abs(bag[one[k : k + PAIRS]] - bag[two[k : k + PAIRS]]).sum(1) for k in range(0, len(one), PAIRS))])
        may = (np.abs(size[one] - size[two]) <= most) & (apart <= 2 * most)
        nearest = np.argsort((apart / longer)[may], kind="stable")
        return one[may][nearest], two[may][nearest]

    def _compared(self, clusters: list[tuple[list[int], list[str], np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
        """The links among the pairs of lines."""
        pairs = []
        for ids, lines, one, two in clusters:
            for x, y in zip(one.tolist(), two.tolist(), strict=True):
                i, j = ids[x], ids[y]
                if ((i, j) if i < j else (j, i)) not in self.apart:
                    pairs.append((i, j, lines[x], lines[y]))
        share = grams_share([x[2:] for x in pairs], self.similarity)
        # most pairs of few unlike grams link, and aligned words show it; pieces tell others apart
        for k in np.flatnonzero(share < LIKELY).tolist():
            yield from self._joined(*pairs[k])
        for i, j, *_ in (pairs[k] for k in np.flatnonzero(share > 1).tolist()):
            self.apart.add((i, j) if i < j else (j, i))
        pairs = [x for x in (pairs[k] for k in np.flatnonzero((share >= LIKELY) & (share <= 1)).tolist()) if self.forest.root(x[0]) != self.forest.root(x[1])]
        by_length = sorted(range(len(pairs)), key=lambda k: len(pairs[k][2]))
        apart = np.zeros(len(pairs), bool)
        for k in range(0, len(pairs), AT_ONCE):
            apart[by_length[k : k + AT_ONCE]] = far([pairs[m][2:] for m in by_length[k : k + AT_ONCE]], self.similarity)
        for (i, j, a, b), gone in zip(pairs, apart.tolist(), strict=True):
            if gone:
                self.apart.add((i, j) if i < j else (j, i))
            else:
                yield from self._joined(i, j, a, b)

    def _joined(self, i: int, j: int, a: str, b: str) -> Iterator[tuple[int, int]]:
        """The link of i and j, if they are not connected yet and link."""
        if self.forest.root(i) != self.forest.root(j) and self.near(i, j, a, b):
            self.forest.join(i, j)
            yield i, j


def _verify(similarity: float):
    """From (cluster, part, id, line), the rows of a cluster's part together: a forest of links by edit similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        links, now, ids, lines = Links(similarity), None, [], []
        for batch in batches:
            whole: list[tuple[list[int], list[str]]] = []
            for cluster, part, i, line in zip(*(batch.column(n).to_pylist() for n in ("cluster", "part", "id", "line")), strict=True):
                if (cluster, part) != now:
                    if len(ids) > 1:
                        whole.append((ids, lines))
                    now, ids, lines = (cluster, part), [], []
                ids.append(i)
                lines.append(line)
            yield pack(list(links.close(whole)))
        yield pack(list(links.close([(ids, lines)] if len(ids) > 1 else [])))

    def pack(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(2)], ["a", "b"])

    return run


#: Characters of a piece, one for each bit of a word; lines that are looked at by pieces have so many characters at most.
PIECE, PIECED = 64, 4096
#: Pairs that are looked at by pieces at once.
AT_ONCE = 512


def far(pairs: list[tuple[str, str]], similarity: float) -> np.ndarray:
    """Which pairs have pieces that alone need more edits than are allowed; of the others nothing is known.

    A piece of the longer line lies, in an alignment of few edits, within that many characters of its place in the other line.
    Its least distance to any part of the other line there is counted for all at once (Myers 1999), with some characters taken
    for equal; no alignment needs fewer edits than the sum.  Every second piece is looked at: of lines without relation these suffice.
    """
    out = np.zeros(len(pairs), bool)
    size = np.array([(len(a), len(b)) for a, b in pairs], np.int64).reshape(-1, 2)
    at = np.flatnonzero((size.max(1) >= PIECE) & (size.max(1) <= PIECED))
    if not len(at):
        return out
    longer, shorter = size[at].max(1), size[at].min(1)
    most = longer - similarity * longer + 1e-9
    slack = most.astype(np.int64)
    out[at] = longer - shorter > most
    at, longer, shorter, most, slack = (v[~out[at]] for v in (at, longer, shorter, most, slack))
    if not len(at):
        return out
    code = lambda x: np.frombuffer("".join(x).encode("utf-32-le"), np.uint32).astype(np.int64) % 64
    whole = code([max(pairs[k], key=len) for k in at.tolist()])
    # the shorter lines with room before and after, which equals nothing
    room = np.full(int((shorter + 3 * slack).sum()) + PIECE, 64)
    place = np.cumsum(shorter + 3 * slack) - shorter - 2 * slack
    other = [min(reversed(pairs[k]), key=len) for k in at.tolist()]  # of two of one length not the same
    room[np.arange(int(shorter.sum())) + np.repeat(place - np.cumsum(shorter) + shorter, shorter)] = code(other)
    count = (longer // PIECE + 1) // 2
    pair = np.repeat(np.arange(len(at)), count)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    by = np.argsort(-slack[pair], kind="stable")
    pair, nth = pair[by], nth[by]
    n = len(pair)
    lane = np.arange(n)
    same = np.zeros((n, 65), U64)
    begin = (np.cumsum(longer) - longer)[pair] + 2 * nth * PIECE
    for k in range(PIECE):
        same[lane, whole[begin + k]] |= U64(1) << U64(k)
    same, row = same.ravel(), lane * 65
    start = place[pair] + 2 * nth * PIECE - slack[pair]
    steps = PIECE + 2 * slack[pair]
    active = np.searchsorted(-steps, -np.arange(int(steps[0])))
    up, down = np.full(n, ~U64(0)), np.zeros(n, U64)
    score = np.full(n, PIECE, np.int64)
    least = score.copy()
    for t, k in enumerate(active.tolist()):
        equal = same.take(row[:k] + room.take(start[:k] + t, mode="clip"), mode="clip")
        u, d = up[:k], down[:k]
        diagonal = (((equal & u) + u) ^ u) | equal | d
        more, less = d | ~(diagonal | u), u & diagonal
        score[:k] += (more >> U64(63)).view(np.int64)
        score[:k] -= (less >> U64(63)).view(np.int64)
        np.minimum(least[:k], score[:k], out=least[:k])
        more <<= U64(1)  # any part of the other line may begin here
        less <<= U64(1)
        np.bitwise_or(less, ~(diagonal | more), out=u)
        np.bitwise_and(more, diagonal, out=d)
    out[at] = np.bincount(pair, least, len(at)) > most
    return out


#: Pairs that are compared without a look at their pieces: with so small a share of the unlike 3-grams that are allowed; pairs whose
#: 3-grams are counted at once.
LIKELY, COUNTED = 0.4, 64


def grams_share(pairs: list[tuple[str, str]], similarity: float) -> np.ndarray:
    """Of each pair the 3-grams that only one has, by ``_grams``, as a share of those that the allowed edits can make: over 1 no link."""
    out = np.zeros(len(pairs))
    for at in range(0, len(pairs), COUNTED):
        now = pairs[at : at + COUNTED]
        nth: dict[str, int] = {}
        one, two = (np.array([nth.setdefault(x[k], len(nth)) for x in now]) for k in range(2))
        size = np.array([len(x) for x in nth])
        gram = _grams("".join(nth) + "  ").astype(np.int64)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        own = place < np.repeat(size - 2, size)  # within one line
        bag = np.bincount((gram + np.repeat(np.arange(len(size)) * 4096, size))[own], minlength=4096 * len(size)).reshape(-1, 4096).astype(np.float32)
        longer = np.maximum(size[one], size[two])
        apart = [np.abs(bag[one[k : k + 32]] - bag[two[k : k + 32]]).sum(1) for k in range(0, len(now), 32)]
        out[at : at + COUNTED] = np.concatenate(apart) / (6 * (longer - similarity * longer + 1e-9))
    return out


#: Characters after which a distance is looked at for whether it can still be small enough.
LOOK = 64


def edit_distance(a: str, b: str, most: float = float("inf")) -> int:
    """Levenshtein distance, a bit vector for each character of ``b`` (Myers 1999, Hyyro 2003); some number above ``most`` if it is."""
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    same = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, n, m = (1 << len(a)) - 1, len(a), len(b)
    up, down = full, 0  # bits above ``full`` mean nothing, and reach none below
    place, grams = np.arange(1, n + 1), None
    for k in range(0, m, LOOK):
        if k and most < n:
            # the distances of all beginnings of a from that of b so far, and what their rests differ in length or in 3-grams
            grams = grams or (_grams(a), _grams(b))
            up, down = up & full, down & full
            bits = [np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), count=n, bitorder="little") for v in (up, down)]
            so_far = k + np.cumsum(bits[0].astype(np.int32) - bits[1])
            apart = _bags_apart(grams[0][k:], grams[1][k:])  # of other rests of a it is less by one at most for each character
            rest = np.maximum(6 * np.abs(n - place - (m - k)), apart - np.abs(place - k))
            if min(6 * k + max(6 * abs(n - m + k), apart - k), int((6 * so_far + rest).min())) > 6 * most:
                return int(most) + 1
        for c in b[k : k + LOOK]:
            same = places.get(c, 0)
            diagonal = (((same & up) + up) ^ up) | same | down
            more, less = (down | (full ^ (diagonal | up))) << 1 | 1, (up & diagonal) << 1
            up, down = less | (full ^ (diagonal | more)), more & diagonal
    return m + (up & full).bit_count() - (down & full).bit_count()


#: Words that an alignment looks ahead for the next common one.
AHEAD = 10


def aligned(a: str, b: str, most: float) -> bool:
    """Whether an alignment of words needs at most ``most`` edits: then the distance is no more; else it is not known."""
    one, two = a.split(" "), b.split(" ")
    i = j = edits = 0
    n, m = len(one), len(two)
    while i < n and j < m:
        if one[i] == two[j]:
            i, j = i + 1, j + 1
            continue
        for ahead in range(1, AHEAD):
            step = next((k for k in range(max(0, ahead - (m - 1 - j)), min(ahead, n - 1 - i) + 1) if one[i + k] == two[j + ahead - k]), None)
            if step is not None:
                break
        else:
            break
        gone, new = one[i : i + step], two[j : j + ahead - step]
        edits += max(sum(map(len, gone)) + len(gone), sum(map(len, new)) + len(new))
        if edits > most:
            return False
        i, j = i + step, j + ahead - step
    gone, new = one[i:], two[j:]
    return edits + max(sum(map(len, gone)) + len(gone), sum(map(len, new)) + len(new)) <= most


def alike(a: str, b: str, similarity: float) -> bool:
    """Whether the edit similarity is reached; exact distances are counted only where aligned words do not show it."""
    longer = max(len(a), len(b))
    most = longer - similarity * longer + 1e-9  # edits that are allowed
    if abs(len(a) - len(b)) > most:
        return False
    return aligned(a, b, most) or _grams_apart(a, b) <= 6 * most and edit_distance(a, b, most) <= most


def _grams_apart(a: str, b: str) -> int:
    """Of how many character 3-grams only one has, by their hashes: an edit takes three and makes three at most."""
    return _bags_apart(_grams(a), _grams(b))


def _grams(x: str) -> np.ndarray:
    """Hashes, of 12 bits, of the character 3-grams."""
    c = np.frombuffer(x.encode("utf-32-le"), np.uint32)
    return (c[:-2] * np.uint32(961) + c[1:-1] * np.uint32(31) + c[2:]) & np.uint32(4095)


def _bags_apart(a: np.ndarray, b: np.ndarray) -> int:
    return int(np.abs(np.bincount(a, minlength=4096) - np.bincount(b, minlength=4096)).sum())


#: Of bytes, only A-Z become lower.
_SPACED = bytes(0x20 if gap else byte for gap, byte in zip(NOT_WORD.tolist(), LOWER.tolist(), strict=True))


def normalised(line: bytes) -> bytes:
    """The words of a line."""
    return b" ".join(line.translate(_SPACED).split())


#: Words of 64 bits of the filter that says which lines are wanted, at most, as a power of two; bits of it for each line.
FILTER, PER_LINE = 20, 16


def _filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of line ids: at most 2 ** FILTER words, whatever their number; ids are hashes, so their bits choose word and bits."""
    size = min(FILTER, max(4, (ids.count() * PER_LINE // 64).bit_length()))
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(id, {6 * k}) & 63 as int))" for k in range(3))
    words = ids.groupBy(F.expr(f"shiftrightunsigned(id, {64 - size})").alias("word")).agg(F.bit_or(F.expr(bits)).alias("bits")).toArrow()
    out = np.zeros(1 << size, U64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(U64)
    return out


def passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the filter may hold: all that it does, and a few others."""
    mask = np.zeros(len(ids), U64)
    for k in range(3):
        mask |= U64(1) << ((ids >> U64(6 * k)) & U64(63))
    return (words[(ids >> U64(64 - (len(words).bit_length() - 1))).astype(np.int64)] & mask) == mask


def _scan(words) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's distinct lines at their first place; a line that passes the filter, which is broadcast, with its text once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        known = np.zeros(0, U64)
        for batch in batches:
            ids, versions = batch.column("doc_id"), batch.column("v")
            for i, j in chunks(batch.column("text")):
                x = Lines(batch.column("text").slice(i, j - i))
                if not len(x.at):
                    continue
                h, g = x.hash(), x.hash(0xD6E8FEB86659FD93)
                own = h ^ (x.doc.astype(U64) * _BASE)
                once = np.argsort(own, kind="stable")
                once = once[np.diff(own[once], prepend=~own[once[:1]]) != 0]
                only = np.flatnonzero(passes(words.value, h[once]))
                only = only[np.unique(h[once[only]], return_index=True)[1]]
                if len(known):
                    only = only[known[np.minimum(np.searchsorted(known, h[once[only]]), len(known) - 1)] != h[once[only]]]
                only = np.sort(only)
                at = once[only]
                known = np.sort(np.concatenate([known if len(known) < HELD else known[:0], h[at]]))
                raw, start, end = x.w.data.tobytes(), x.w.start[x.at[at]].tolist(), x.w.end[x.at[at] + x.count[at] - 1].tolist()
                lines = pa.array([normalised(raw[a:b]) for a, b in zip(start, end, strict=True)], pa.binary()).cast(pa.string())
                which = np.full(len(once), -1)
                which[only] = np.arange(len(only))
                doc = pa.array(x.doc[once] + i)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(doc), versions.take(doc), pa.array(x.place[once].astype(np.int32)), *(pa.array(v[once].view(np.int64)) for v in (h, g)), lines.take(pa.array(which, mask=which < 0))], ["doc_id", "v", "place", "h", "g", "line"])

    return run


def meetings(texts: DataFrame) -> DataFrame:
    """(cluster, home, id): the distinct lines of ``texts`` (text) that may be near others, with these."""
    near = texts.mapInArrow(_signed, "key long, id long, s long")
    near = near.repartition("key").sortWithinPartitions("key").mapInArrow(_met, "cluster long, id long, s long, open boolean")
    return cut(near.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_crowds, "cluster long, home long, id long").distinct())


def links(near: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """A forest (a, b) of the links between lines (id, line) that meet, by their ids."""
    # a large cluster is dealt into blocks, each of which meets each other one
    blocks = near.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")).where("blocks > 1")
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: k != block), lambda k: F.least(k, block) * F.col("blocks") + F.greatest(k, block)))
    # clusters of a home go to one task, which passes over what is connected already; the parts of a large one to a task each
    home = F.when(F.col("blocks").isNull(), F.col("home")).otherwise(F.col("cluster")).alias("home")
    dealt = near.join(small(blocks), "cluster", "left").select(home, "cluster", "id", F.explode(parts).alias("part"))
    place = ["home", "cluster", "part", "id"]
    return dealt.join(lines, "id").select(*place, "line").repartition("home", "part").sortWithinPartitions(*place).mapInArrow(_verify(similarity), "a long, b long")


def first_places(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, v, first): the places, from 0, of the lines that stay among those with words of the document doc_id with text hash v."""
    bounded(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("v"), "text")
    near = meetings(rows.select("text"))
    # the texts of the lines that meet come with the places of all lines, so no document is shuffled for them
    words = docs.sparkSession.sparkContext.broadcast(_filter(near.select("id").distinct()))
    found = rows.mapInArrow(_scan(words), f"doc_id {kind}, v long, place int, h long, g long, line string")
    distinct = cut(found.groupBy("h", "g").agg(F.min(F.struct("doc_id", "v", "place")).alias("f"), F.min("line").alias("line")).select("h", "f.*", "line"))
    lines = distinct.where("line IS NOT NULL").select(F.col("h").alias("id"), "line").dropDuplicates(["id"])
    distinct = distinct.drop("line")
    group = small(components(links(near, lines, similarity)))
    grouped = distinct.join(group, distinct.h == group.node, "left")
    alone = grouped.where("root IS NULL").select("doc_id", "v", "place")
    firsts = alone.unionByName(grouped.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "v", "place")).alias("f")).select("f.*"))
    return firsts.groupBy("doc_id", "v").agg(F.collect_list("place").alias("first"))


def dedup(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents with repeated lines taken out of text, and _n_lines and _n_removed (lines with words) beside."""
    first = first_places(docs, similarity).select(F.col("doc_id").alias("_line_dedup_id"), F.col("v").alias("_line_dedup_v"), F.col("first").alias("_line_dedup_first"))
    joined = docs.join(first, docs.doc_id.eqNullSafe(first._line_dedup_id) & (F.xxhash64(docs.text) == first._line_dedup_v), "left").drop("_line_dedup_id", "_line_dedup_v")
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", _n_lines long, _n_removed long"
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for batch in batches:
            for i, j in chunks(batch.column("text")):
                part = batch.slice(i, j - i)
                x = Places(part.column("text"))
                total = np.bincount(x.doc, minlength=j - i)
                stays = part.column("_line_dedup_first")
                own = np.repeat(np.arange(j - i), stays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                gone = ~np.isin(x.doc << 32 | x.place, own << 32 | stays.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                lost = np.bincount(x.doc[gone], minlength=j - i)
                kept = x.without(gone) if gone.any() else x.texts
                columns = [kept if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total), pa.array(lost)], [*names, "_n_lines", "_n_removed"])

    return joined.mapInArrow(run, schema)


def stage(docs: DataFrame) -> DataFrame:
    """Documents without their repeated lines, n_chars counted anew; those that had only repeated lines go."""
    out = dedup(docs).where("_n_removed = 0 OR _n_removed < _n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
