"""Quality rules by tokeniser fertility.

Base rules: too few words, or too many words in eight-word windows that repeat.  The method's: a public vocabulary's
tokens of the text give characters per token, the share of byte-fallback tokens and the entropy of the tokens in bits; a
text outside the bands of its language, which the column lang names if there is one, is rejected; languages without bands of
their own take those of the script.  The script is that of most of its non-ASCII-aware lead bytes.

``fit`` takes the bands of languages from all labelled good documents: just outside of the extremes of
those that pass the base rules, so that what is rejected is what no good document is like.  Languages with fewer than
``LEAST_FIT`` of them have no bands of their own.

Null texts have no words and fail; texts of a script without bands of its own take those of ``other``; the entropy asked
for grows with the tokens up to ENTROPY_TOKENS and not beyond, as a language's own entropy levels off; repeated rows and other columns change nothing; every text is judged alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, small
from .pieces import MODEL, Encoder, Vocabulary
from .wordhash import _BYTES, SPACE, U64, Words, _powers, chunks, mix, split, windows

WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30


@dataclass(frozen=True)
class Band:
    """Characters per token, the most byte-fallback tokens as a share, and the least entropy as a share of log2(tokens, ENTROPY_TOKENS at most)."""

    fewest: float
    most: float
    fallback: float
    entropy: float


#: Tokens from which on the least entropy grows no more.
ENTROPY_TOKENS = 512
#: Bands of each script, for languages without statistics: wide around what running text has in a vocabulary that was made
#: mostly from Latin script.
BANDS = {"latin": Band(1.25, 7.0, 0.15, 0.6), "greek": Band(0.6, 4.0, 0.15, 0.4), "cyrillic": Band(0.9, 5.0, 0.15, 0.4), "hebrew": Band(0.5, 3.0, 0.3, 0.35),
         "arabic": Band(0.5, 3.0, 0.3, 0.35), "cjk": Band(0.35, 2.5, 0.7, 0.3), "hangul": Band(0.35, 2.5, 0.7, 0.3), "other": Band(0.3, 7.0, 0.9, 0.3)}
#: Labelled good documents of a language that bands are fitted on, at least.
LEAST_FIT = 50
#: How far outside of their extremes a band lies, as a share of the extreme.
MARGIN = 0.02
SCRIPTS = [*BANDS]

#: Script by a character's first byte in UTF-8 (-1: no letter).
_SCRIPT = np.full(256, -1, np.int8)
for _first, _last, _name in ((0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC3, 0xC9, "latin"), (0xCA, 0xCD, "other"), (0xCE, 0xCF, "greek"), (0xD0, 0xD3, "cyrillic"), (0xD4, 0xD5, "other"),
                             (0xD6, 0xD7, "hebrew"), (0xD8, 0xDD, "arabic"), (0xE0, 0xE2, "other"), (0xE3, 0xE9, "cjk"), (0xEA, 0xED, "hangul"), (0xEE, 0xF4, "other")):
    _SCRIPT[_first : _last + 1] = SCRIPTS.index(_name)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, base: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[base[1:]] - total[base[:-1]]


def repeated_lines(w: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    n = len(w.base) - 1
    if not len(w.data):
        return np.zeros(n, np.int64)
    feed = w.data == 10
    begins = np.zeros(len(w.data) + 1, bool)
    begins[1:][feed] = True
    begins[w.base] = True
    start = np.flatnonzero(begins[:-1])
    size = np.diff(np.append(start, len(w.data)))
    value = _BYTES[w.data] * _powers(int(size.max()))[np.arange(len(w.data)) - np.repeat(start, size)]
    value[feed] = 0
    word = np.add.reduceat((~SPACE[w.data]).astype(np.int64), start) > 0
    doc = np.searchsorted(w.base, start, side="right") - 1
    hashed = mix(np.add.reduceat(value, start))[word]
    doc = doc[word]
    _, once = np.unique(hashed ^ mix(doc.astype(U64) + U64(1)), return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[once], minlength=n)


def repeated_words(w: Words, width: int) -> np.ndarray:
    """Words in ``width``-word windows that stand in their text twice or more."""
    n = len(w.base) - 1
    at = np.flatnonzero(w.rest >= width) if len(w.hash) else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(n, np.int64)
    key = windows(w.hash, width)[at] ^ mix(w.doc[at].astype(U64) + U64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(w.hash) + width + 1, np.int32)
    edge[at[twice]] += 1
    np.add.at(edge, at[twice] + width, -1)
    return _per_text(np.cumsum(edge)[: len(w.hash)] > 0, w.first)


def entropy(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Entropy in bits of each range of ids."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    key, count = np.unique(doc * 2**20 + ids, return_counts=True)
    share = count / n[key >> 20]
    return np.bincount(key >> 20, -share * np.log2(share), len(n))


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", "n_tokens", "chars_per_token", "fallback_share", "token_entropy"]


def measure(docs: DataFrame, vocabulary: Vocabulary, bands: dict[str, Band] = BANDS, languages: dict[str, Band] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, script, n_tokens, chars_per_token, fallback_share and token_entropy of every row."""
    sent = bounded(docs.sparkSession).sparkContext.broadcast((vocabulary, bands, languages or {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value[0])
        band = np.array([[b.fewest, b.most, b.fallback, b.entropy] for b in [*(sent.value[1].get(s, sent.value[1]["other"]) for s in SCRIPTS), *sent.value[2].values()]])
        by_lang = {name: k for k, name in enumerate(sent.value[2], len(SCRIPTS))}
        is_byte = np.zeros(len(encoder.v.pieces), bool)
        is_byte[encoder.v.byte[encoder.v.byte >= 0]] = True
        for batch in batches:
            for i, j in chunks(batch.column("text")):
                text = batch.column("text").slice(i, j - i)
                w = split(text)
                lead = (w.data & 0xC0) != 0x80
                words = np.diff(w.first)
                code = _SCRIPT[w.data]
                script = np.zeros((j - i, len(SCRIPTS)), np.int64)
                for k in set(_SCRIPT[np.flatnonzero(np.bincount(w.data, minlength=256))].tolist()) - {-1}:  # those that stand here
                    script[:, k] = _per_text(code == k, w.base)
                which = np.where(script.sum(1) > 0, script.argmax(1), SCRIPTS.index("other"))
                ids, first = encoder.encode(text)
                n = np.diff(first)
                some = np.maximum(n, 1)
                fertility = _per_text(lead, w.base) / some
                fallback = _per_text(is_byte[ids], first) / some
                bits = entropy(ids, first)
                repeats = repeated_words(w, WINDOW)
                failed = (words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * words)
                own = np.array([by_lang.get(x, -1) for x in batch.column("lang").slice(i, j - i).to_pylist()])
                own = np.where((own >= 0) & (which == SCRIPTS.index("latin")), own, which)
                low, high, most, least = band[own].T
                good = (fertility >= low) & (fertility <= high) & (fallback <= most) & (bits >= least * np.log2(np.clip(n, 2, ENTROPY_TOKENS)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), *map(pa.array, (words, _per_text(lead & ~SPACE[w.data], w.base), _per_text(_SYMBOL[w.data], w.base), repeated_lines(w), repeats, failed, ~failed & good)),
                     pa.array(np.array(SCRIPTS, object)[which], pa.string()), *map(pa.array, (n, fertility, fallback, bits))], NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    return docs.select("doc_id", "text", lang).mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, n_tokens long, chars_per_token double, fallback_share double, token_entropy double")


def fit(docs: DataFrame, labels: DataFrame, vocabulary: Vocabulary, max_fit: int | None = None) -> dict[str, Band]:
    """Bands by language from all documents that ``labels`` (doc_id, quality) call good; copies of a text count once.

    Null ids, texts and languages are left out; without good documents there are no bands.  Only with ``max_fit`` a sample of so many
    is drawn, by a hash of doc_id.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    if max_fit is not None and (n := good.count()) > max_fit:  # a threshold leaves a few more or fewer than asked for, and the limit the bound
        draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
        good = good.where(draw < int(max_fit / n * (1 << 30))).limit(max_fit)
    rows = docs.select("doc_id", "text", "lang").join(small(cut(good)), "doc_id", "left_semi").where("text IS NOT NULL AND lang IS NOT NULL").dropDuplicates(["text"])
    # the language goes beside the id, so that nothing is joined to find it again
    named = rows.select(F.struct("doc_id", F.col("lang").cast("string").alias("lang")).alias("doc_id"), "text", "lang")
    found = measure(named, vocabulary).where("NOT base_failed AND script = 'latin'").withColumn("_lang", F.col("doc_id.lang"))
    share = F.col("token_entropy") / F.log2(F.least(F.greatest(F.lit(2), F.col("n_tokens")), F.lit(ENTROPY_TOKENS)))
    ends = found.groupBy("_lang").agg(F.count("*").alias("n"), F.min("chars_per_token").alias("low"), F.max("chars_per_token").alias("high"), F.max("fallback_share").alias("fallback"), F.min(share).alias("entropy"))
    return {r["_lang"]: Band(r["low"] * (1 - MARGIN), r["high"] * (1 + MARGIN), r["fallback"] * (1 + MARGIN) + MARGIN / 4, r["entropy"] * (1 - MARGIN)) for r in ends.where(F.col("n") >= LEAST_FIT).collect()}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of the languages from the labelled good documents, all documents held to them."""
    docs, vocabulary = spark.read.parquet(f"{sf_dir}/documents.parquet"), Vocabulary.load(MODEL)
    return measure(docs, vocabulary, languages=fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), vocabulary))
