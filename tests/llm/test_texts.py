"""Licences, repetition, packing, encoding and counts against plain versions of each."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canopyq.llm import kernels as K
from canopyq.llm import licenses as L
from canopyq.llm import repetition as R
from canopyq.llm.bpe import WordEndCodec, bpe_round_trip
from canopyq.llm.packing import OpenBins, cut, pack_documents
from canopyq.llm.queries import QUERIES
from canopyq.llm.token_counts import EditedDocument, LeafSplitter, edited_token_counts, ordered_edits, personal_data_edits, token_state
from canopyq.llm.tokens import ByteLevelEncoder, default_path, load_tokenizer

SF = "/root/testdata/sf0.001"
MESSY = st.text(alphabet="abcXYZ019'''  \n\t.,!-stmdrvleé ñßÀ", max_size=60) | st.text(max_size=30)


@pytest.fixture(scope="module")
def byte_level():
    return load_tokenizer(default_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_end():
    return load_tokenizer(default_path("word_bpe_49k.json"))


def test_licences(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op3_license_scans"](spark, SF).collect()}
    for i, text in texts:
        words, places, kinds = L.words(text), [], set()
        for phrase, kind in L.PHRASES.items():
            p = phrase.split()
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    places.append(k)
                    kinds.add(kind)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(kinds)))
        assert kinds <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_matching_statistics():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 4, 30).tolist() for _ in range(4)]
    automaton = L.SuffixAutomaton(sequences)
    known = {tuple(s[a:b]) for s in sequences for a in range(30) for b in range(a + 1, 31)}
    text = rng.integers(0, 5, 200).tolist()
    for i, (state, length) in enumerate(automaton.statistics(text)):
        best = max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in known), default=0)
        assert length == best
        for k, end in automaton.ends[state].items():
            assert not length or sequences[k][end + 1 - length : end + 1] == text[i + 1 - length : i + 1]


def test_template_span_is_covered():
    scanner = L.LicenceScanner(L.TEMPLATES, L.ScanRules())
    body = L.TEMPLATES["mit-text"][1].split()
    body[10:12] = ["altered"]
    data, offsets = K.string_parts(pa.array(["before it " + " ".join(body) + " and after"]))
    (row,) = scanner.scan(data, offsets)
    (span,) = [s for s in row[7] if s["label"] == "mit-text"]
    assert span["first_word"] == 2 and span["share"] > 0.9


def test_repetition(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, SF).collect()}
    for i, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        inside = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words)) and not (r.base_failed and r.kept)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40), st.integers(3, 6))
def test_coverage_of_ngrams(words, n):
    data, offsets = K.string_parts(pa.array([" ".join(words)]))
    m = R.measure(data, offsets, R.RepetitionRules(ngram_limits=((n, 1.0),)))
    seen = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    inside = {k + j for k in range(len(words) - n + 1) if seen[tuple(words[k : k + n])] > 1 for j in range(n)}
    assert abs(m["dup_ngram_char_share"][0, 0] - len(inside) / max(1, len(words))) < 1e-12


def test_coverage_limits_reject_beyond_the_base_rule():
    fresh = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    passage, line = fresh(20, 1), "said twice"
    texts = [f"{fresh(40, 0)} {passage} {fresh(20, 2)} {passage}", f"{fresh(100, 3)}\n{line}\n{line}", fresh(60, 4)]
    m = R.measure(*K.string_parts(pa.array(texts)), R.RepetitionRules())
    assert m["base_failed"].tolist() == [False, False, False] and m["kept"].tolist() == [False, True, True]


def check_packing(rows, texts, library):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // 1024)
        assert all(p.length == 1024 for p in pieces[1:]) and sum(p.length for p in pieces) == len(ids)
        for p in pieces:
            part = np.array(ids[p.start : p.start + p.length], "<u4")
            assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    return len(by_sequence)


def test_packing(spark, texts, byte_level):
    rows = QUERIES["op5_best_fit_packing"](spark, SF).collect()
    used = check_packing(rows, texts, byte_level)
    assert used <= -(-sum(r.length for r in rows) // 1024) * 1.05 + 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60), st.integers(1, 5))
def test_best_fit_rule(lengths, bound):
    bins, free = OpenBins(16, bound), {}
    for n in lengths:
        fits = [f for f in free.values() if f >= n]
        number, offset = bins.place(n)
        if fits:
            assert free[number] == min(fits) and offset == 16 - free[number]
        elif len(free) == bound and n < 16:
            full = min(free.values())
            del free[next(k for k, f in free.items() if f == full and (k not in {b for v in bins.bins.values() for b in v}))]
        free[number] = free.get(number, 16) - n
        if not free[number]:
            del free[number]
        assert len(free) <= bound and sorted(free.values()) == sorted(f for f, v in bins.bins.items() for _ in v)


def test_cut():
    assert cut(5, 8) == [(0, 5)] and cut(8, 8) == [(0, 8)] and cut(17, 8) == [(0, 1), (1, 8), (9, 8)] and cut(0, 8) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(MESSY, min_size=1, max_size=5))
def test_encoders_equal_the_library(byte_level, word_end, items):
    items = [t.encode("utf-8", "replace").decode() for t in items]
    encoder = test_encoders_equal_the_library.__dict__.setdefault("encoder", ByteLevelEncoder(default_path("byte_bpe_50k.json")))
    codec = test_encoders_equal_the_library.__dict__.setdefault("codec", WordEndCodec(default_path("word_bpe_49k.json")))
    flat, at = encoder.encode(*K.string_parts(pa.array(items)))
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in byte_level.encode_batch(items, add_special_tokens=False)]
    for (n, ids, names), e in zip(codec.digest(items), word_end.encode_batch(items, add_special_tokens=False), strict=True):
        assert n == len(e.ids) and ids == sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert names == sha256(word_end.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_query(spark, texts, word_end):
    got = {r.doc_id: r for r in QUERIES["op6_bpe_round_trip"](spark, SF).collect()}
    for i, text in texts:
        ids = word_end.encode(text, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == sha256(word_end.decode(ids, skip_special_tokens=False).encode()).hexdigest()


PARTS = st.lists(st.sampled_from(["a", "b1", " ", "  ", "\n", "'", "'ll", "s", "<|", "endoftext", "|>", "<|endoftext|>", "“quoted”", "’s", "日本", "é", "😀", "."]), max_size=14).map("".join)
EDITS = st.lists(st.tuples(st.integers(0, 70), st.integers(0, 6), PARTS), max_size=5)


@settings(max_examples=400, deadline=None)
@given(PARTS, EDITS)
def test_any_edits_count_as_the_library(byte_level, text, edits):
    splitter = test_any_edits_count_as_the_library.__dict__.setdefault("splitter", LeafSplitter(default_path("byte_bpe_50k.json")))
    document, new = EditedDocument(text, *splitter.count(text), splitter.count, splitter.reach), text
    for start, size, to in edits:
        document.apply(start, start + size, to)
        start = min(start, len(new))
        new = new[:start] + to + new[start + size :]
        assert document.text == new and document.n_tokens == len(byte_level.encode(new, add_special_tokens=False).ids)
        counts, lengths = document.state()
        want = splitter.count(new)
        assert counts.tolist() == want[0].tolist() and lengths.tolist() == want[1].tolist()


def test_edits_that_complete_or_break_a_special_token(spark, byte_level):
    rows = [(1, "a   <|endoftext|X> b", [(15, 16, "")]), (2, "a   <|endoftext|> b", [(10, 10, "X")]), (3, "x" * 300 + "<|endof", [(307, 307, "text|>" + " more" * 200)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, e array<struct<start:int,end:int,replacement:string>>")
    for r in edited_token_counts(docs, "e", keep=True).collect():
        assert r.n_tokens_edited == len(byte_level.encode(r.text, add_special_tokens=False).ids)


def test_edit_column_with_nulls_and_overlaps(spark):
    given = [None, {"start": None, "end": 3, "replacement": "x"}, {"start": 4, "end": 9, "replacement": None}, {"start": 1, "end": 6, "replacement": "u"}, {"start": -5, "end": 1, "replacement": "v"}, {"start": 90, "end": 99, "replacement": "w"}]
    assert ordered_edits(given, 10) == [(0, 1, "v"), (1, 4, "u"), (4, 9, ""), (10, 10, "w")] and ordered_edits(None, 3) == []
    rows = [(1, "0123456789", [None if e is None else tuple(e.values()) for e in given]), (2, None, [(0, 0, "new text")]), (3, "", None), (4, "same", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, e array<struct<start:int,end:int,replacement:string>>")
    got = {r.doc_id: (r.text, r.n_edits) for r in edited_token_counts(docs, "e", keep=True).collect()}
    assert got == {1: ("vu9w", 4), 2: ("new text", 1), 3: ("", 0), 4: ("same", 0)}


def test_edits_start_from_a_stored_state(spark, byte_level):
    texts = ["one two  three", "“quoted” ’s 日本 text", "", "a <|endoftext|> b"]
    first = token_state(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    step = F.expr("array(named_struct('start', 1, 'end', 2, 'replacement', ' 日 ll'))")
    for _ in range(2):
        docs = first.select("doc_id", "text", "leaf_counts", "leaf_lengths", step.alias("e"))
        first = edited_token_counts(docs, "e", state=("leaf_counts", "leaf_lengths"), keep=True)
    texts = [t[:1] + " 日 ll" + t[2:] for t in texts]
    texts = [t[:1] + " 日 ll" + t[2:] for t in texts]
    assert {r.doc_id: (r.text, r.n_tokens_edited) for r in first.collect()} == {i: (t, len(byte_level.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)}


def test_registered_counts(spark, texts, byte_level):
    got = {r.doc_id: r for r in QUERIES["op10_token_counts"](spark, SF).collect()}
    for i, text in texts:
        new = text
        for a, b, to in reversed(personal_data_edits(text)):
            new = new[:a] + to + new[b:]
        sizes = [len(e.ids) for e in byte_level.encode_batch([text, new], add_special_tokens=False)]
        assert [got[i].n_tokens, got[i].n_tokens_edited, got[i].n_chars_edited] == [*sizes, len(new)]


def test_edited_counts(spark, byte_level):
    rng = np.random.default_rng(4)
    letters = list("abc012'''   \n\n.,sltmdveé日")
    rows = []
    for i in range(400):
        text = "".join(rng.choice(letters, int(rng.integers(0, 80))))
        places = sorted(rng.integers(0, len(text) + 1, 6).tolist())
        edits = [(a, b, "".join(rng.choice(letters, int(rng.integers(0, 5))))) for a, b in zip(places[::2], places[1::2], strict=True)]
        rows.append((i, text, edits if i % 7 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,replacement:string>>")
    got = {r.doc_id: r for r in edited_token_counts(docs, "edits").collect()}
    for i, text, edits in rows:
        new = text
        for a, b, to in sorted(edits or [], reverse=True):
            new = new[:a] + to + new[b:]
        count = lambda t: len(byte_level.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_tokens_edited, got[i].n_chars_edited) == (count(text), count(new), len(new))


def test_edits_without_digits_and_other_phones():
    kinds = lambda t: [to for _, _, to in personal_data_edits(t)]
    assert kinds("write to john@example.com now") == ["<mail>"] and kinds("no data at all") == []
    for phone in ("+1 (017) 555-7713", "+49 30 123456", "+442079460958", "(212) 555-0187", "212-555-0187"):
        assert personal_data_edits(f"call {phone} now") == [(5, 5 + len(phone), "<phone>")]
    assert kinds("card 9807915762804490 or 4111 1111 1111 1111 at 10.0.0.1") == ["<card>", "<card>", "<address>"]


def test_counts_recode_little(spark):
    text = "word " * 5000 + "mail me.1@host.example.com now " + "word " * 5000
    (r,) = edited_token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.n_edits == 1 and r.n_chars_recoded < 100


def test_odd_input(spark, odd, byte_level):
    n = odd.count()
    for made in (L.scan_licences(odd), R.repetition_rules(odd, keep=("doc_id", "score")), bpe_round_trip(odd), edited_token_counts(odd)):
        assert made.count() == n
    assert L.scan_licences(odd.limit(0)).count() == R.repetition_rules(odd.limit(0)).count() == bpe_round_trip(odd.limit(0)).count() == pack_documents(odd.limit(0)).count() == 0
    assert {r.n_words for r in R.repetition_rules(odd).where("doc_id in (1, 2, 3)").collect()} == {0}
    assert {(r.n_tokens, r.ids_sha256) for r in bpe_round_trip(odd).where("doc_id in (1, 2)").collect()} == {(0, sha256(b"").hexdigest())}
    pieces = pack_documents(odd)
    assert pieces.where("piece = 0").count() == n
    ids = {r.n_tokens for r in edited_token_counts(odd).where("doc_id = 8").collect()}
    assert ids == {len(byte_level.encode("x <|endoftext|> y <|startoftext|> 'll 's", add_special_tokens=False).ids)}


def twins(n):
    """Two different strings of ``n`` letters whose polynomial hashes modulo a power of two agree whatever the base (Thue-Morse words)."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return a, a.translate({97: 98, 98: 97})


def test_words_that_fool_hashes_modulo_powers_of_two(byte_level, word_end):
    a, b = twins(2048)
    data, offsets = K.string_parts(pa.array([a, b, a]))
    x, y, z = K.Prefix(data, K.BYTE_VALUES).span(offsets[:-1], offsets[1:])
    assert x == z != y
    pair = [np.array([1 + (c == "b") for c in t], np.uint64) for t in (a, b)]
    assert K.window_hashes(pair[0], 2048) != K.window_hashes(pair[1], 2048)
    lines = R.measure(*K.string_parts(pa.array([f"{a}\n{b}", f"{a}\n{b}\n{a}"])), R.RepetitionRules())
    assert lines["n_dup_lines"].tolist() == [0, 1]
    flat, at = ByteLevelEncoder(default_path("byte_bpe_50k.json")).encode(*K.string_parts(pa.array([f"{a} {b}", b])))
    assert [flat[p:q].tolist() for p, q in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in byte_level.encode_batch([f"{a} {b}", b])]
    for (n, ids, _), t in zip(WordEndCodec(default_path("word_bpe_49k.json")).digest([a, b]), (a, b), strict=True):
        want = word_end.encode(t, add_special_tokens=False).ids
        assert (n, ids) == (len(want), sha256(" ".join(map(str, want)).encode()).hexdigest())


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    from canopyq.llm.tokens import WordTable

    monkeypatch.setattr(K.Prefix, "span", lambda self, starts, ends: np.zeros(len(starts), np.uint64))
    table = WordTable(lambda words: [[len(w), w[0]] for w in words])
    data = np.frombuffer(b"ab cd ab xyz cd", np.uint8)
    starts, ends, _ = K.runs(K.NONSPACE[data], np.array([0, len(data)]))
    for _ in range(2):
        flat, at = table.ids(table.look_up(data, starts, ends))
        assert flat.reshape(-1, 2).tolist() == [[2, 97], [2, 99], [2, 97], [3, 120], [2, 99]]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "ab", "abcdefgh", "abcdefgx", "abcdefghij", "abcdefghik", "é日本語", ""]), min_size=2, max_size=8))
def test_same_spans(words):
    raw = [w.encode() for w in words]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(w) for w in raw])
    starts = ends - [len(w) for w in raw]
    for i in range(len(raw)):
        both = np.minimum(len(raw[i]), ends - starts)
        got = K.same_spans(data, np.full(len(raw), starts[i]), starts, both)
        assert got.tolist() == [raw[i][:n] == w[:n] for w, n in zip(raw, both.tolist(), strict=True)]


def test_words_are_encoded_without_the_library_splitting_them_again(byte_level):
    """Pre-tokens and special tokens by the model alone give the ids of the whole library, without a call to it for texts."""
    from canopyq.llm.tokens import library_table

    class ModelAlone:
        model, get_added_tokens_decoder = byte_level.model, byte_level.get_added_tokens_decoder

    words = [" the", "Ünïcode", " ", "\n\n", "'ll", "...", "1234567", "<|endoftext|>", "日本語", "\x00", " zyzzyva"]
    data, offsets = K.string_parts(pa.array(words))
    table = library_table(ModelAlone())
    flat, at = table.ids(table.look_up(data, offsets[:-1], offsets[1:]))
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [byte_level.encode(w, add_special_tokens=False).ids for w in words]


def test_neighbouring_pairs_are_indexed_at_once(word_end):
    """The occurrence index against a plain loop over neighbours; merges of overlapping pairs against the library."""
    from canopyq.llm.bpe import _SHIFT, PairIndex

    index = PairIndex(default_path("word_bpe_49k.json"))
    symbols = np.array([-1, *index.inner[np.frombuffer(b"aaaathetheaa", np.uint8)], -1, *index.inner[np.frombuffer(b"zq", np.uint8)], -1, -1])
    want = {}
    for i, (a, b) in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)):
        if a >= 0 and b >= 0 and (r := index.rank.get(a << _SHIFT | b)) is not None:
            want.setdefault(r, []).append(i)
    assert want and index.occurrences(symbols) == want
    assert index.occurrences(np.full(4, -1)) == {}
    words = [b"aaaaaaa", b"banana", b"mississippi", b"", b"x", b"ooooohhhh"]
    assert index.encode(words) == [word_end.encode(w.decode(), add_special_tokens=False).ids for w in words]


def test_word_tables_are_bounded_by_bytes(byte_level):
    from canopyq.llm.tokens import WordTable

    seen = []
    table = WordTable(lambda words: seen.append(len(words)) or [[len(w)] for w in words], most_bytes=10_000)
    for k in range(40):
        words = [f"{k}-{j}".encode() * 50 for j in range(8)] + [b"again"]
        data, offsets = K.string_parts(pa.array([w.decode() for w in words]))
        rows = table.look_up(data, offsets[:-1], offsets[1:])
        assert table.flat[table.begin[rows]].tolist() == [len(w) for w in words]
        assert table.held <= 10_000
    assert sum(seen) > 40 * 8
