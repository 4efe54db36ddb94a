"""Operators 2, 4, 5, 7, 8, 9, 10 and the pipeline."""

import base64
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import ALNUM, LOWER, WORD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import counts, decontamination, language, licenses, pieces, quality, urls
from folioscope.llm.queries import ORACLES, QUERIES


# ---- URL filters ---------------------------------------------------------------------------------------------


def test_urls(spark):
    cases = {None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://X.Example.COM/en/a?q#f": ("x.example.com", "/en/a", "example.com/en/", "block"), "http://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
             "http://example.com/fr": ("example.com", "/fr", "com/", "allow"), "http://example.com": ("example.com", "", None, "allow"), "http://b.net/es/1": ("b.net", "/es/1", "net/es/", "block"), "http://bnet/es/": ("bnet", "/es/", None, "allow"),
             "x://t.org/p.html": ("t.org", "/p.html", None, "block"), "http://www.t.org/p/": ("www.t.org", "/p/", None, "block"), "http://?": ("", "", None, "allow"), "http://c.org/\u00e9?": ("c.org", "/\u00e9", None, "allow")}
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(cases)] + [(3, "http://a.www.example.com/en/", "again")], "page_id long, url string, host string")
    blocked = urls.spelled_twice(pages)
    assert [r.canonical for r in blocked.collect()] == ["t.org/p"]
    for rows in (500_000, 0):
        got = [tuple(r) for r in urls.filter_urls(pages, urls.RULES, blocked, rows).collect()]
        assert sorted(got) == sorted([(k, *v) for k, v in enumerate(cases.values())] + [(3, *cases["http://a.www.example.com/en/"])])
    assert urls.filter_urls(pages.limit(0), urls.RULES, blocked).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages, [], blocked.limit(0)).collect()} == {"allow"}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).selectExpr("cast(id as string) key")
    assert urls.bloom(keys, 200).count() == 200


@pytest.mark.parametrize("name", [n for n in ORACLES])
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(names).collect()))) == sorted(map(str, con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()))


# ---- decontamination -----------------------------------------------------------------------------------------


def test_decontamination(spark, docs, rows, empty):
    r = random.Random(1)
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 30]
    items = []
    for k in range(12):
        words = ALNUM.findall(r.choice(texts).translate(LOWER).lower())
        at = r.randrange(max(1, len(words) - 40))
        words = words[at : at + r.randint(6, 40)]
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = "other"
        items.append((k, " ".join(words), "x"))
    items += [(50, None, "x"), (51, "too short", "x"), (52, "", "x")]
    benchmark = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [ALNUM.findall((t or "").lower())] for k in range(len(w) - 4)}
    want = {}
    for i, t, *_ in rows:
        for j, u, _ in items:
            n = shingles(u)
            if n and len(n & shingles(t)) >= 0.8 * len(n) - 1e-9:
                want[i, j] = (len(n), len(n & shingles(t)))
    assert want
    assert {(x.doc_id, x.item_id): (x.n_shingles, x.n_shared) for x in decontamination.contained(docs, benchmark).collect()} == want
    assert {x.doc_id for x in decontamination.clean(docs, benchmark).collect()} == {i for i, *_ in rows} - {i for i, _ in want}
    assert decontamination.contained(empty, benchmark).count() == 0 and decontamination.contained(docs, benchmark.limit(0)).count() == 0


def test_very_long_urls(spark):
    long = "x" * 200_000
    cases = {"http://a.com/" + long: "com/", "http://" + "a." * 400 + "net/es/" + long: "net/es/", "http://" + long + "?q": None, long: None}
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = urls.filter_urls(pages, urls.RULES, urls.spelled_twice(pages)).orderBy("page_id").collect()
    assert [r.rule for r in got] == list(cases.values()) and [len(r.path) for r in got] == [200_001, 200_004, 0, 0]


# ---- licenses ------------------------------------------------------------------------------------------------


def expand(template, filler="zz"):
    """Every text that a template accepts, replaceable regions at their least and most words."""
    m = re.search(r"<<var;[^>]*words=(\d+)-(\d+)>>", template)
    if m:
        return [y for n in sorted({int(m[1]), int(m[2])}) for y in expand(template[: m.start()] + " " + " ".join([filler] * n) + " " + template[m.end() :], filler)]
    m = re.search(r"<<beginOptional>>((?:(?!<<).)*)<<endOptional>>", template)
    return [y for part in ("", m[1]) for y in expand(template[: m.start()] + " " + part + " " + template[m.end() :], filler)] if m else [template]


@pytest.mark.parametrize("label", list(licenses.TEMPLATES))
def test_templates_accept_what_they_stand_for_and_nothing_else(label):
    machine = licenses.Automaton.compile(label, licenses.TEMPLATES[label])
    for text in expand(licenses.TEMPLATES[label]):
        words = licenses.words_of(text)
        assert machine.accept(w.encode() for w in [*words, "and", "more"])[0] >= len(words)
        need = licenses.words_of(re.sub("<<.*?>>", " ", expand(licenses.TEMPLATES[label])[0]))
        k = len(need) // 2
        if need[k] != "zz":
            at = words.index(need[k])
            assert machine.accept(w.encode() for w in [*words[:at], "wrong", *words[at + 1 :]]) is None or words.count(need[k]) > 1


def test_whole_wordings_are_told_from_their_openings(spark):
    fill = lambda x: re.sub(r"<<var[^>]*>>", "holder", re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", x))
    mit, two, three = (fill(licenses.TEMPLATES[k]) for k in ("mit-text", "bsd-2-clause", "bsd-3-clause"))
    texts = [mit, two, three, mit.split("without restriction")[0] + "without restriction", mit.replace("AND NONINFRINGEMENT", "")]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["mit-grant-notice,mit-text", "bsd-2-clause,bsd-notice", "bsd-3-clause,bsd-notice", "mit-grant-notice", "mit-grant-notice"]


def test_one_mandatory_word_changed_is_not_the_license(spark):
    fill = lambda x: re.sub(r"<<var[^>]*>>", "holder", re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", x))
    whole = {k: fill(licenses.TEMPLATES[k]) for k in ("mit-text", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "apache-2.0-notice")}
    rows = []
    for name, text in whole.items():
        words = text.split()
        for k in (len(words) // 2, len(words) * 3 // 4, len(words) - 1):
            at = next(x for x in range(k, 0, -1) if "holder" not in words[x])
            rows.append((f"{name} {k}", " ".join([*words[:at], "changed", *words[at + 1 :]])))
        rows.append((name, text + " and so on"))
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all((name.split()[0] in labels) == (" " not in name) for name, labels in got.items())


def test_license_scan(spark, docs, rows, empty):
    extra = [(9001, "CC-by, cc BY! General Public License. All rights\nreserved", None, None, 0, "", ""), (9002, "Released under the MIT open source License", None, None, 0, "", ""), (9003, "Released under the MIT no License", None, None, 0, "", "")]
    out = {r.doc_id: r for r in licenses.scan(docs.unionByName(spark.createDataFrame(extra, docs.schema))).collect()}
    phrases = {tuple(p.split()): label for p, label in licenses.PHRASES.items()}
    for i, t, *_ in rows + extra:
        w = ALNUM.findall((t or "").translate(LOWER))
        hits = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(hits), min([k for k, _ in hits], default=None), max([k for k, _ in hits], default=None), ",".join(sorted({x for _, x in hits})))
        assert 0 <= r.score <= 1
    assert out[9001].labels == "cc-by,gpl,reserved" and out[9002].labels == "mit" and out[9002].score == 1 and out[9003].labels == ""
    assert licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.Automaton.compile("x", "a <<beginOptional>> b")


# ---- token counts --------------------------------------------------------------------------------------------


def encoder():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(counts.RANKS, "rb"))}
    return tiktoken.Encoding("x", pat_str=counts.PATTERN, mergeable_ranks=ranks, special_tokens={})


def summed(rows):
    out = defaultdict(lambda: [0, 0, 0])
    for t, lang, source in rows:
        out[source, lang] = [a + b for a, b in zip(out[source, lang], (1, len(encoder().encode_ordinary(t or "")), len(t or "")), strict=True)]
    return dict(out)


def test_token_rollups(spark, docs, rows, empty, tmp_path):
    rollup = counts.Rollup(spark, f"file://{tmp_path}/t")
    get = lambda: {(r.source, r.lang): [r.n_docs, r.n_tokens, r.n_chars] for r in rollup.totals().collect()}
    assert get() == {}
    counted = counts.count_tokens(docs, "v1")
    assert rollup.commit("a", counted)
    state = {i: (t, lang, source) for i, t, lang, source, *_ in rows}
    assert get() == summed(state.values())
    assert not rollup.commit("a", counted) and get() == summed(state.values())
    gone = [i for i in state][:7]
    new = [(gone[0], "back again", "fr", "s9", 1, "", ""), (99999, "brand new", "en", "s1", 1, "", "")]
    for i in gone:
        state.pop(i)
    state |= {i: (t, lang, source) for i, t, lang, source, *_ in new}
    deleted = spark.createDataFrame([(i, "v1") for i in [*gone, 123456]], "doc_id long, tokenizer_version string")
    # a batch that stopped half-way left rows behind, but no marker
    changed = counts.count_tokens(spark.createDataFrame(new, docs.schema), "v1")
    changed.select("doc_id").write.parquet(f"file://{tmp_path}/t/ledger/b")
    assert rollup.commit("b", changed, deleted) and rollup.committed() == ["a", "b"]
    assert get() == summed(state.values())
    assert rollup.commit("c", counts.count_tokens(empty, "v1")) and get() == summed(state.values())
    with pytest.raises(ValueError):
        rollup.commit("a/b", counted)


def test_rollup_query_revises(spark, sf_dir):
    rollup = counts.replayed(spark, sf_dir)
    assert rollup.committed() == ["0-insert", "1-revise", "2-delete"]
    batch = spark.read.parquet(f"{rollup.folder}/ledger/1-revise")
    signs = Counter(r.n_docs for r in batch.collect())
    assert signs[1] == signs[-1] > 0
    docs, toxic = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id")
    plain = counts.count_tokens(docs.join(toxic, "doc_id", "left_anti"), "byte_bpe_50k").groupBy("source", "lang").agg({"n_tokens": "sum", "n_chars": "sum", "*": "count"})
    want = {(r.source, r.lang): (r["count(1)"], r["sum(n_tokens)"], r["sum(n_chars)"]) for r in plain.collect()}
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_chars) for r in rollup.totals().collect()} == want


def test_rollup_compacts_and_takes_turns(spark, tmp_path):
    schema = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, n_chars long"
    rows = lambda *x: spark.createDataFrame([(i, s, "en", "v", n, 2 * n) for i, s, n in x], schema)
    rollup = counts.Rollup(spark, str(tmp_path))
    total = lambda: {r.source: (r.n_docs, r.n_tokens, r.n_chars) for r in rollup.totals().collect()}
    rollup.compact()
    assert total() == {} and rollup.commit("a", rows((1, "s", 5), (2, "s", 7), (None, "t", 1)))
    for batch, changed, gone, want in (
        ("b", rows((1, "s", 6), (3, "t", 2)), None, {"s": (2, 13, 26), "t": (2, 3, 6)}),
        ("c", rows(), spark.createDataFrame([(2, "v"), (9, "v")], "doc_id long, tokenizer_version string"), {"s": (1, 6, 12), "t": (2, 3, 6)}),
        ("d", rows((None, "s", 4)), None, {"s": (2, 10, 20), "t": (1, 2, 4)})):
        rollup.compact()
        assert rollup.commit(batch, changed, gone) and not rollup.commit("a", rows((1, "s", 99)))
        assert total() == want
        rollup.compact()
        assert total() == want
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rollup.current().collect()) == [(0, 4), (1, 6), (3, 2)]

    class Late(counts.Rollup):
        """Another batch is committed while this one's rows are written."""

        def _sums(self, signed):
            rollup.commit("first", rows((7, "s", 1)))
            return counts.Rollup._sums(signed)

    with pytest.raises(RuntimeError, match="again"):
        Late(spark, str(tmp_path)).commit("second", rows((7, "s", 2)))
    assert rollup.commit("second", rows((7, "s", 2))) and total()["s"] == (3, 12, 24)


# ---- SentencePiece -------------------------------------------------------------------------------------------


def odd_texts():
    r = random.Random(2)
    out = ["Hello  world", "a\n b", " x", "日本 語🙂", "a\tb\r\n", "", "   ", "ab\x00c", None, "\n\n", "<s> </s> <0x0A>", "x" * 3000, "é" * 70]
    return out + ["".join(r.choice("abcdeth   \nёжÅ日🙂.,<>0") for _ in range(r.randint(0, 60))) for _ in range(300)]


def test_encoding_equals_the_library(rows):
    import sentencepiece

    texts = odd_texts() + [t for _, t, *_ in rows]
    e = pieces.Encoder(pieces.Vocabulary.load(pieces.MODEL))
    want = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode([t or "" for t in texts])
    for _ in range(2):  # the second time from memory
        ids, first = e.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == want
    assert e.decode(ids, first) == [t or "" for t in texts]


def test_a_unigram_vocabulary_takes_the_best_path():
    names = [b"a", b"b", b"ab", b"ba", b"aba", b" ", b" a"]
    score = np.array([-1.0, -1.5, -1.2, -2.6, -2.0, -0.5, -1.4])
    v = pieces.Vocabulary([*names, b"?"], np.append(score, 0.0), np.arange(len(names)), np.full(256, -1, np.int32), len(names), unigram=True)

    def best(text):
        top = [0.0] + [-math.inf] * len(text)
        for p in range(len(text)):
            for n, s in zip(names, score, strict=True):
                if text.startswith(n, p):
                    top[p + len(n)] = max(top[p + len(n)], top[p] + s)
        return top[-1]

    for text in ("abab", "baba", "aabba", "a", "bbbabab"):
        ids, first = pieces.Encoder(v).encode(pa.array([text]))
        assert b"".join(names[k] for k in ids) == b" " + text.encode() and abs(score[ids].sum() - best(b" " + text.encode())) < 1e-9


def test_long_parts_are_relaxed_window_by_window(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "INDEXED", 100)
    r = random.Random(3)
    texts = ["".join(r.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "the", "aeé日字🙂", "  a", "0123456789") for n in (64, 65, 99, 100, 101, 700)]
    ids, first = pieces.Encoder(pieces.Vocabulary.load(pieces.MODEL)).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(texts)


def test_long_unspaced_text_takes_time_in_proportion():
    e = pieces.Encoder(pieces.Vocabulary.load(pieces.MODEL))
    r, took = random.Random(4), []
    for n in (16_000, 128_000):
        text = pa.array(["".join(r.choice("abcdefghijklmnopqrstuvwxyzABC0123456789+/") for _ in range(n))])
        began = time.process_time()
        e.encode(text)
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0] + 1


def plain_merges(score, text):
    """Merging as it is defined: the best-scored neighbours, the leftmost of equal ones."""
    now = list(text)
    while True:
        best = max(((score[a + b], -k) for k, (a, b) in enumerate(zip(now, now[1:], strict=False)) if a + b in score), default=None)
        if best is None:
            return now
        k = -best[1]
        now[k : k + 2] = [now[k] + now[k + 1]]


@given(st.lists(st.tuples(st.text(alphabet="abc", min_size=2, max_size=5), st.integers(0, 4)), max_size=14), st.text(alphabet="abc", min_size=1, max_size=14))
@settings(max_examples=300, deadline=None)
def test_allowed_pairs_are_those_of_merging(made, text):
    score = {c: -100.0 for c in "abc "} | {p: -float(n) for p, n in made}
    names = list(score)
    v = pieces.Vocabulary.of([*(x.encode() for x in names), b"?"], np.array([*score.values(), 0.0]), np.arange(len(names)), np.full(256, -1, np.int32), len(names))
    e = pieces.Encoder(v)
    want = plain_merges(score, " " + text)
    ids, _ = e.encode(pa.array([text]))
    assert [names[k] for k in ids] == want
    assert [names[k] for k in e.stretch((" " + text).encode())] == want


def test_pieces_that_cannot_be_matched_are_refused():
    def of(*names):
        return pieces.Vocabulary.of([*names, b"?"], np.arange(len(names) + 1.0), np.arange(len(names)), np.full(256, -1, np.int32), len(names))

    for bad in (b"a b", b"", b"a\nb", b"ab\0"):
        with pytest.raises(ValueError, match="piece 2"):
            of(b"a", b"b", bad)
    with pytest.raises(ValueError, match="no piece"):
        of(b"a", b"b", b"abc")
    long = pieces.Encoder(of(b"a", b" ", *(b"a" * 2**k for k in range(1, 8))))  # longer than any bound on a piece's bytes
    assert long.encode(pa.array(["a" * 200]))[0].tolist() == [1, 8, 7, 4]


def test_neighbouring_unknown_characters_are_one():
    v = pieces.Vocabulary.of([b"a", b" ", b"?"], np.zeros(3), np.arange(2), np.full(256, -1, np.int32), 2)
    ids, first = pieces.Encoder(v).encode(pa.array(["ayza", "yz", "z\ny", None, "a"]))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [[1, 0, 2, 0], [1, 2], [1, 2], [], [1, 0]]


def test_encode_and_decode_rows(spark, docs, rows, empty):
    v = pieces.Vocabulary.load(pieces.MODEL)
    encoded = pieces.encode(docs, v)
    assert {r.doc_id: r.text for r in pieces.decode(encoded, v).collect()} == {i: t for i, t, *_ in rows}
    assert all(r.round_trip for r in pieces.digest(docs, v).collect()) and pieces.digest(empty, v).count() == 0


# ---- quality -------------------------------------------------------------------------------------------------


def test_quality(docs, rows, empty):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    v = pieces.Vocabulary.load(pieces.MODEL)
    texts = {i: (t or "", lang) for i, t, lang, *_ in rows}
    bands = {"en": quality.Band(1.0, 2.0, 0.2, 0.75), "fr": quality.Band(1.2, 2.5, 0.01, 0.5)}
    kept = 0
    for r in quality.measure(docs, v, languages=bands).collect():
        t, lang = texts[r.doc_id]
        w = WORD.findall(t)
        own = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {q for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for q in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(covered), failed)
        ids = m.encode(t)
        assert abs(r.chars_per_token - len(t) / max(1, len(ids))) < 1e-9
        assert abs(r.token_entropy + sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())) < 1e-6
        script = Counter("latin" if c < "\u0250" else "other" for c in t if c.isalpha()).most_common(1)
        band = bands.get(lang, quality.BANDS["latin"]) if script and script[0][0] == "latin" else quality.BANDS["other"]
        share = sum(m.is_byte(x) for x in ids) / max(1, len(ids))
        inside = band.fewest <= r.chars_per_token <= band.most and share <= band.fallback and r.token_entropy >= band.entropy * math.log2(min(512, max(2, len(ids))))
        assert r.kept == (not failed and inside), (r, band)
        kept += r.kept
    assert 0 < kept < len(rows)
    assert quality.measure(empty, v).count() == 0


def test_long_unspaced_texts_are_measured(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60_000)), "".join(r.choice("日本語文字化水火木金土") for _ in range(20_000)), "a" * 50_000]
    got = quality.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces.Vocabulary.load(pieces.MODEL)).orderBy("doc_id").collect()
    assert [(x.n_words, x.word_chars, x.base_failed, x.script) for x in got] == [(1, 60_000, True, "latin"), (1, 20_000, True, "cjk"), (1, 50_000, True, "latin")]
    assert all(x.n_tokens > 0 and abs(x.chars_per_token * x.n_tokens - x.word_chars) < 1 for x in got)


def test_bands_reject_what_tokenises_badly(spark):
    prose = "The people of the town came to see the old house by the river and talked about what they had seen there in the winter before."
    junk = " ".join("".join(chr(0x13000 + (k * 7 + j) % 900) for j in range(6)) for k in range(30))
    rows = spark.createDataFrame([(1, prose), (2, " ".join(["aaaa"] * 40)), (3, junk), (4, " ".join(f"x{k}q9z" for k in range(40)))], "doc_id long, text string")
    got = {r.doc_id: (r.script, r.base_failed, r.kept) for r in quality.measure(rows, pieces.Vocabulary.load(pieces.MODEL)).collect()}
    assert got[1] == ("latin", False, True) and got[2][1:] == (True, False) and got[3] == ("other", False, False)


def test_long_clean_text_is_held_to_no_more_entropy_than_a_shorter_one(spark):
    r = random.Random(4)
    known = sorted({w for x in WORDS.values() for w in x.split()})
    said = known + [a + b for a in known[::5] for b in known[1::17]]
    rows = [(k, " ".join(r.choice(said) for _ in range(n))) for k, n in enumerate((20_000, 600))]
    got = quality.measure(spark.createDataFrame(rows, "doc_id long, text string"), pieces.Vocabulary.load(pieces.MODEL)).collect()
    assert [x.kept for x in got] == [True, True]


def test_latin_junk_beyond_the_base_rules_is_rejected_and_long_clean_text_is_not(spark):
    r = random.Random(4)
    known = sorted({w for x in WORDS.values() for w in x.split()})
    junk, said = r.sample(known, 22), known + [a + b for a in known[::5] for b in known[1::17]]
    text = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    rows = [(1, text(junk, 600), "en"), (2, text(said, 20_000), "de"), (3, text(said, 600), "de"), (4, text(said, 600), None), (5, text(junk, 600), None)]
    bands = {k: quality.Band(1.9, 7.0, 0.08, 0.69) for k in ("en", "de")}
    got = {x.doc_id: x for x in quality.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string"), pieces.Vocabulary.load(pieces.MODEL), languages=bands).collect()}
    assert not any(x.base_failed for x in got.values()) and {x.script for x in got.values()} == {"latin"}
    assert {k: x.kept for k, x in got.items()} == {1: False, 2: True, 3: True, 4: True, 5: False}


def test_fitted_bands_reject_bad_documents_and_no_good_ones(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    v = pieces.Vocabulary.load(pieces.MODEL)
    bands = quality.fit(docs, labels, v)
    assert set(bands) <= {"en", "de", "fr", "es"} and bands
    found = quality.measure(docs, v, languages=bands).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = ([x.kept for x in found if x.quality == q and True] for q in (1, 0))
    assert all(good) and len(good) > 100 and sum(bad) < 0.7 * len(bad)
    assert quality.fit(docs, labels.limit(0), v) == {} and quality.fit(docs.limit(0), labels, v) == {}
    assert 0 < len(quality.fit(docs, labels, v, 250)) <= len(bands)


def test_bands_are_of_all_good_documents(spark):
    # one of 6,500 good documents, and one that a sample of 6,000 leaves out, is unlike the others
    good = spark.range(6500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    odd = good.where(draw >= int(6000 / 6500 * (1 << 30))).agg(F.min("doc_id")).first()[0]
    words = F.transform(F.sequence(F.lit(1), F.lit(24)), lambda k: F.conv((k * 7919 + F.col("doc_id") * 104729).cast("string"), 10, 26))
    plain = F.transform(F.sequence(F.lit(1), F.lit(24)), lambda k: F.concat(F.lit("house "), F.conv(k + F.col("doc_id"), 10, 26)))
    docs = good.select("doc_id", F.array_join(F.when(F.col("doc_id") == odd, words).otherwise(plain), " ").alias("text"), F.lit("en").alias("lang"))
    v = pieces.Vocabulary.load(pieces.MODEL)
    got = quality.measure(docs, v, languages=quality.fit(docs, good, v))
    assert got.where("kept").count() == got.where("NOT base_failed").count() and got.where(F.col("doc_id") == odd).first().kept


# ---- language ------------------------------------------------------------------------------------------------

WORDS = {"en": "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were", "fr": "le de un à être et en avoir que pour dans ce il qui ne sur se pas plus par je avec tout faire son mettre autre on mais nous", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach"}


def labelled(spark, seed, n=150):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        lang = r.choice(list(WORDS))
        rows.append((k, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(3, 30))), lang))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(spark):
    rows, docs = labelled(spark, 1)
    model = language.fit(docs.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    held = [(i, lang) for i, _, lang in rows if i % 3 == 1]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 + ... €€ 😀", "x"), (4, "É", "x"), (5, "THE PEOPLE", "x"), (6, "日本語", "x")], "doc_id long, text string, lang_pred string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert [out[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and out[5][0] == "en" and "und" not in (out[4][0], out[6][0])
    assert {r.doc_id for r in language.keep_identified(odd, model).collect()} == {4, 5, 6}


def plain_language(rows, texts):
    """The same model and scores, word by word."""
    counts = defaultdict(Counter)
    for t, lang in {(t, lang) for _, t, lang in rows}:
        for w in t.split():
            counts[w][lang] += 1
    langs = sorted({lang for *_, lang in rows})

    def logs(table):
        total = {x: sum(c[x] for c in table.values()) for x in langs}
        return {k: [math.log((c[x] + 0.5) / (total[x] + 0.5 * max(1, len(table)))) for x in langs] for k, c in table.items()}

    known = {w: v for w, v in logs(counts).items() if sum(counts[w].values()) >= 2}
    grams = {}
    for n in range(1, 6):
        table = defaultdict(Counter)
        for w, c in counts.items():
            edged = f"<{w}>"
            for k in range(len(edged) - n + 1):
                for x in langs:
                    table[edged[k : k + n]][x] += c[x]
        often = {k: c for k, c in table.items() if sum(c.values()) >= 2}
        grams[n] = logs(often if n > 2 and often else table)
    out = []
    for t in texts:
        total, words = [0.0] * len(langs), t.split()
        for w in words:
            if w in known:
                mine = known[w]
            else:
                edged, mine = f"<{w}>", [0.0] * len(langs)
                for k in range(len(edged)):
                    found = next((grams[n][edged[k : k + n]] for n in range(5, 0, -1) if k + n <= len(edged) and edged[k : k + n] in grams[n]), [0.0] * len(langs))
                    mine = [a + b / len(edged) for a, b in zip(mine, found, strict=True)]
            total = [a + b for a, b in zip(total, mine, strict=True)]
        mean = [x / len(words) for x in total]
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        out.append((langs[best], 1 / sum(math.exp(x - mean[best]) for x in mean)))
    return out


def test_language_equals_the_plain_model(spark):
    rows, docs = labelled(spark, 5, 60)
    r = random.Random(6)
    texts = [" ".join(r.choice([*WORDS[r.choice(list(WORDS))].split(), "nouveau", "gewesen", "something", "zzz"]) for _ in range(r.randint(1, 12))) for _ in range(60)]
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), language.fit(docs)).orderBy("doc_id").collect()
    for x, (lang, score) in zip(got, plain_language(rows, texts), strict=True):
        assert abs(x.score - score) < 1e-3 and (x.lang_pred == lang or abs(score - 0.5) < 1e-3 or score < 0.34), (texts[x.doc_id], x, lang, score)


def test_the_score_tells_clear_texts_from_mixed_ones(spark):
    _, docs = labelled(spark, 3)
    en, fr = WORDS["en"].split(), WORDS["fr"].split()
    mixed = [w for pair in zip(en, fr, strict=False) for w in pair]
    texts = [" ".join(en), " ".join(en * 50), " ".join(mixed), " ".join(mixed * 50)]
    got = [r.score for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), language.fit(docs)).orderBy("doc_id").collect()]
    assert got[0] > 0.9 and got[2] < 0.8 and abs(got[0] - got[1]) < 1e-3 and abs(got[2] - got[3]) < 1e-3


def test_ties_and_repeated_rows_in_language(spark):
    docs = spark.createDataFrame([(k, t, lang) for k in range(4) for t, lang in (("uno dos", "b"), ("uno dos", "a"))], "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = language.identify(spark.createDataFrame([(1, "uno"), (1, "uno"), (None, "dos"), (2, "zzz")], "doc_id long, text string"), model).collect()
    assert {r.lang_pred for r in got} == {"a"} and len(got) == 4 and language.identify(docs.limit(0), model).count() == 0


def test_language_without_labels_and_sampled(spark):
    rows, docs = labelled(spark, 2)
    assert {r.lang_pred for r in language.identify(docs, language.fit(docs.limit(0))).collect()} == {"und"}
    model = language.fit(docs, max_train=60)
    assert model.languages == ["de", "en", "fr"]
    assert len(model.word) <= len(language.fit(docs).word)


def test_every_labelled_language_is_learned(spark):
    assert language.MAX_TRAIN == 6000
    rows = [(k, f"the people of house {k} and the town", "en") for k in range(4000)] + [(9000 + k, "one text that stands again and again", "en") for k in range(4000)] + [(8000 + k, f"le village numéro {k} est dans la forêt", "fr") for k in range(3)] + [(8100, "der alte Turm steht nicht im Wald", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = Counter(r.lang for r in language.sample(docs, 60).collect())
    assert taken == {"en": 56, "fr": 3, "de": 1}
    got = language.identify(spark.createDataFrame([(1, "est dans le village"), (2, "der Turm steht im Wald"), (3, "the people")], "doc_id long, text string"), language.fit(docs, 60))
    assert [r.lang_pred for r in got.orderBy("doc_id").collect()] == ["fr", "de", "en"]
    assert [language.quota(*x) for x in (([10, 1, 5], 9), ([3, 4], 60), ([], 5), ([9, 9, 9], 2))] == [4, 4, 1, 1]


# ---- pipeline and queries ------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, kept = documents, [documents.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == documents.columns, k
        kept.append(docs.count())
    assert sorted(kept, reverse=True) == kept and kept[-1] > 0.5 * kept[0]
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(out) == kept[-1] and all(r.round_trip for r in out)


def odd_documents(spark):
    text = "the people of the town came to see the old house by the river in the winter"
    rows = [(1, text, "en"), (1, text, "en"), (None, "null id " + text, "en"), (2, None, "en"), (3, "", None), (4, "12 34 +", "en"), (5, text + " and\n" + text, "en"), (6, "x" * 20_000, "en"), (7, text + " again", "fr")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "own", 0) for r in rows], "doc_id long, text string, lang string, n_chars long, first string, score int")


@pytest.mark.parametrize("empty_table", [False, True])
def test_stages_take_nulls_repeats_and_empty_tables(spark, sf_dir, empty_table):
    import corpus_pipeline

    docs = odd_documents(spark)
    docs = docs.limit(0) if empty_table else docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        kept.append(sorted((r.doc_id or 0) for r in out.collect()))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    if empty_table:
        assert kept == [[]] * 4 and last == []
    else:
        assert kept[0] == [0, 1, 1, 5, 6, 7]  # without a letter or a text they go
        assert kept[1][:2] == [0, 2] and set(kept[1]) >= {2, 3, 4, 6}  # all others repeat a line of the first
        assert kept[3] == sorted((r.doc_id or 0) for r in docs.collect()) and len(last) == 9 and all(r.round_trip for r in last)
        assert {2, 3, 4} <= set(kept[2])


@pytest.mark.parametrize("name", [n for n in QUERIES if n.split("_")[0] in ("op1", "op3", "op4", "op6", "op9", "op10")])
def test_every_document_has_its_row(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
