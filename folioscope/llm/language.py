"""Language identification by word-first backoff.

A known word scores by its log frequency in each language.  An unseen word scores by character n-grams: at each
of its positions the longest n-gram that the model knows counts, from five characters down to one.  A text takes
the language with the largest sum; the score is that language's share of exp(mean by word), so it tells how clearly the words speak
for the language, and does not grow with the text.

The model is fitted on a sample of ``max_train`` distinct labelled texts (all, if there are no more), chosen by a hash of the
text: of each language the same number at most, so that languages with fewer texts give them all and none is left out
(one text of each, if there are more languages than ``max_train``); so its size is bounded, and it is sent to the executors.  Null texts and texts without a letter are
``und`` with score 0; rows without a label are not learned from; equal sums take the language that sorts first; with
nothing to learn from, every text is ``und``; repeated rows and other columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded, release
from .wordhash import U64, chunks, split, windows

#: Distinct labelled texts that the model is fitted on, at most.
MAX_TRAIN = 6000
ORDERS = (5, 4, 3, 2, 1)
#: Words seen fewer times are left to the n-grams.
MIN_COUNT = 2
SMOOTH = 0.5
#: Words whose n-grams the driver counts at a time.
WORDS_AT_ONCE = 20_000

NOT_LETTER = np.ones(256, bool)
NOT_LETTER[0x41:0x5B] = NOT_LETTER[0x61:0x7B] = NOT_LETTER[0x80:] = False


def letters(texts: pa.Array):
    """Words of letters and non-ASCII characters, lower-cased (A-Z, and the Latin-1 capitals)."""
    texts = texts.cast(pa.string()) if not pa.types.is_string(texts.type) else texts
    return split(_latin_lower(texts), lower=True, separator=NOT_LETTER)


def _latin_lower(texts: pa.Array) -> pa.Array:
    texts = texts.fill_null("") if texts.null_count else texts
    _, offsets, raw = texts.buffers()
    if raw is None:
        return texts
    ends = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4)
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]].copy()  # of the slice only
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    value = data[second]
    data[second[(value >= 0x80) & (value <= 0x9E) & (value != 0x97)]] += 0x20
    return pa.Array.from_buffers(texts.type, len(texts), [None, pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(data)])


def _sum_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words with their edges marked, and the number of characters left in the word from each."""
    joined = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    return joined, np.repeat(np.cumsum(sizes), sizes) - np.arange(len(joined))


@dataclass
class LanguageModel:
    languages: list[str]
    word: np.ndarray  # sorted hashes
    word_log: np.ndarray  # words x languages
    gram: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: sorted hashes, log frequencies

    @staticmethod
    def fit(counts: pa.Table) -> LanguageModel:
        """From lang, word and n: arrays only, for the driver's memory is small."""
        if not counts.num_rows:
            return LanguageModel([], np.zeros(0, U64), np.zeros((0, 0), np.float32), {})
        languages = sorted(pc.unique(counts["lang"]).to_pylist())
        lang = pc.index_in(counts["lang"], pa.array(languages, pa.string())).combine_chunks().to_numpy()
        coded = counts["word"].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        words, place = coded.dictionary, coded.indices.to_numpy()
        table = np.zeros((len(words), len(languages)))
        np.add.at(table, (place, lang), counts["n"].to_numpy())
        known = table.sum(1) >= MIN_COUNT
        hashed = letters(words).hash
        order = np.argsort(hashed[known])
        gram = {n: LanguageModel._count(words, table, n) for n in ORDERS}
        return LanguageModel(languages, hashed[known][order], LanguageModel.log_frequency(table)[known][order], gram)

    @staticmethod
    def _count(words: pa.Array, table: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words' n-grams, and their log frequency by language; some words at a time, for the driver's memory is small.

        Longer n-grams that stand once in all tell nothing, and are left to the shorter ones.
        """
        keys, sums = np.zeros(0, U64), np.zeros((0, table.shape[1]), np.float32)
        for a in range(0, len(words), WORDS_AT_ONCE):
            points, rest = _grams(words.slice(a, WORDS_AT_ONCE).to_pylist())
            owner = a + np.cumsum(points == 1) - 1  # each word is opened by a 1
            ok = np.flatnonzero(rest >= n)
            new, inverse = np.unique(windows(points, n)[ok], return_inverse=True)
            found = np.stack([np.bincount(inverse, table[owner[ok], k], len(new)).astype(np.float32) for k in range(table.shape[1])], 1)
            both, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.zeros((len(both), table.shape[1]), np.float32)
            total[place[: len(keys)]] += sums
            total[place[len(keys) :]] += found
            keys, sums = both, total
        if n > 2 and (many := sums.sum(1) >= MIN_COUNT).any():
            keys, sums = keys[many], sums[many]
        return keys, LanguageModel.log_frequency(sums)

    @staticmethod
    def log_frequency(table: np.ndarray) -> np.ndarray:
        return np.log((table + SMOOTH) / (table.sum(0) + SMOOTH * max(1, len(table)))).astype(np.float32)

    def unseen(self, words: list[str]) -> np.ndarray:
        """Mean over a word's positions of the longest known n-gram's log frequency; nothing for positions without one."""
        points, rest = _grams(words)
        out = np.zeros((len(points), len(self.languages)))
        left = np.arange(len(points))
        for n in ORDERS:
            keys, log = self.gram[n]
            ask = left[rest[left] >= n]
            value = windows(points, n)[ask]
            at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            found = keys[at] == value
            out[ask[found]] = log[at[found]]
            left = np.setdiff1d(left, ask[found], assume_unique=True)
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        return _sum_by_text(out, first) / sizes[:, None]

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1: und) and score of each text."""
        pred, score = np.full(len(texts), -1), np.zeros(len(texts))
        if not self.languages:
            return pred, score
        for i, j in chunks(texts):
            part = texts.slice(i, j - i)
            w = letters(part)
            if not len(w.hash):
                continue
            value = np.zeros((len(w.hash), len(self.languages)), np.float32)
            if len(self.word):
                at = np.minimum(np.searchsorted(self.word, w.hash), len(self.word) - 1)
                known = self.word[at] == w.hash
                value[known] = self.word_log[at[known]]
            else:
                known = np.zeros(len(w.hash), bool)
            new = np.flatnonzero(~known)
            if len(new):
                _, where, inverse = np.unique(w.hash[new], return_index=True, return_inverse=True)
                raw = w.data.tobytes()
                value[new] = self.unseen([raw[w.start[k] : w.end[k]].decode("utf-8", "replace") for k in new[where]])[inverse]
            total = _sum_by_text(value, w.first)
            has = np.diff(w.first) > 0
            for k in np.flatnonzero(has & ~_ascii_letter(w)):
                has[k] = any(map(str.isalpha, part[int(k)].as_py() or ""))
            best = total.argmax(1)
            mean = total / np.maximum(1, np.diff(w.first))[:, None]
            share = 1 / np.exp(mean - mean.max(1, keepdims=True)).sum(1)
            pred[i:j] = np.where(has, best, -1)
            score[i:j] = np.where(has, share, 0)
        return pred, score


def _ascii_letter(w) -> np.ndarray:
    """Whether a text has a word that starts with an ASCII letter."""
    count = np.concatenate([[0], np.cumsum(w.data[w.start] < 0x80)])
    return count[w.first[1:]] > count[w.first[:-1]]


def quota(sizes: list[int], total: int) -> int:
    """The most that each language may give so that all give ``total`` together at most; one at least."""
    left, ordered = total, sorted(sizes)
    for k, n in enumerate(ordered):
        if n * (len(ordered) - k) > left:
            return max(1, left // (len(ordered) - k))
        left -= n
    return max([1, *ordered])


def sample(labelled: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """text and lang of at most ``max_train`` distinct labelled texts, of each language up to the same number."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", F.xxhash64("text", F.lit(7)).alias("_h"))
    # copies count once, so that a text of a third of the rows neither fills the sample nor weighs in it
    sizes = rows.select("lang", "_h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()
    most = quota([r["n"] for r in sizes], max_train)
    # somewhat more than the quota by a threshold, so that no language is ranked as a whole; what is over goes by rank
    spare = most + 4 * int(most**0.5) + 16
    kept = [(r["lang"], 1 << 30 if r["n"] <= spare else int(spare / r["n"] * (1 << 30)) + 1) for r in sizes]
    limits = rows.sparkSession.createDataFrame(kept, "_l string, _limit long")
    draw = F.pmod("_h", F.lit(1 << 30))
    drawn = rows.join(F.broadcast(limits), rows.lang.cast("string") == F.col("_l")).where(draw < F.col("_limit")).select("text", "lang", "_h").dropDuplicates(["lang", "text"])
    first = W.partitionBy("lang").orderBy(draw, "_h", "text")
    return drawn.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most).select("text", "lang")


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> LanguageModel:
    """From text and lang of a sample of ``max_train`` distinct texts at most."""
    bounded(labelled.sparkSession)
    rows = sample(labelled, max_train)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for lang in langs.unique().to_pylist():
                texts = batch.column("text").filter(pc.equal(langs, lang))
                for i, j in chunks(texts):
                    w = letters(texts.slice(i, j - i))
                    _, where, n = np.unique(w.hash, return_index=True, return_counts=True)
                    raw = w.data.tobytes()
                    words = [raw[w.start[k] : w.end[k]].decode("utf-8", "replace") for k in where]
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(words), pa.string()), "word": pa.array(words, pa.string()), "n": pa.array(n, pa.int64())})

    found = rows.mapInArrow(counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    model = LanguageModel.fit(found.toArrow())
    release(labelled.sparkSession)
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    sent = bounded(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*sent.value.languages, "und"], object)
        for batch in batches:
            pred, score = sent.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[pred], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.0) -> DataFrame:
    """The documents whose language is known with a score above ``least``, with all their columns; equal rows all stay or all go."""
    sent = bounded(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = sent.value.predict(batch.column("text"))
            yield batch.filter(pa.array((pred >= 0) & (score > least)))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
