"""Fill-in-middle, substring removal and the Merkle manifest against plain versions of each, on odd tables too."""

import re
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyq.llm import fill_in_middle as M
from canopyq.llm import merkle, substrings
from canopyq.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd_rows(odd):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd.collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.select(*got.columns).fetchall())


# --- fill in middle


def plain_fill(doc_id, text, rate=50, spm=80, seed=42):
    text = text or ""
    units = re.findall(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def check_fill(df, rows):
    got = [(r.doc_id, r.n, r.form, *(None if c is None else len(c) for c in (r.prefix, r.middle)), r.output, r.restored) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(str((i, *plain_fill(i, text, 100), text or "")) for i, text in rows)


def test_fill_of_odd_rows(spark, odd, odd_rows):
    check_fill(M.fill_in_middle(odd, rate=100), [r[:2] for r in odd_rows])


def test_fill_of_odd_texts(spark):
    texts = ["  two  words  ", "\n\n", "a", " a", "a ", "tab\tnew\x0bline\r\n", "has <P> mark", "<M", "M>", "<", ">", "a<S>b", "x y  z", "emoji 😀 😀😀 \U0001f600end", "$1 \\ {3} (x) [", "P> <S <M> >", None, ""] * 7
    rows = list(enumerate(texts))
    check_fill(M.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=100), rows)


def test_fill_of_a_very_long_text(spark):
    rows = [(i, "wörd  " * 400_000) for i in range(4)]
    check_fill(M.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=100), rows)


def test_fill_of_nothing(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- substrings


def test_cover_meets_at_every_distance():
    for d in range(substrings.PERIOD):
        assert any((k % substrings.PERIOD in substrings.COVER) and ((k + d) % substrings.PERIOD in substrings.COVER) for k in range(substrings.PERIOD))
    assert substrings.PERIOD + substrings.ANCHOR - 1 == substrings.WINDOW


def plain_substrings(rows):
    first = {}
    docs = [(i, re.findall(rf"[^{SPACE}]+", t or "")) for i, t in rows]
    for i, words in docs:
        if i is not None:
            for k in range(len(words) - 12):
                w = tuple(words[k : k + 13])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, words in docs:
        gone = {k + j for k in range(len(words) - 12) if i is not None and first[tuple(words[k : k + 13])] < i for j in range(13)}
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def check_substrings(df, rows, **more):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(df, **more).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_substrings(rows)))


def test_substrings_of_odd_rows(spark, odd, odd_rows):
    check_substrings(odd, [r[:2] for r in odd_rows])


def test_substrings_at_every_offset(spark):
    """Shared passages of 11 to 40 words at all places modulo the period, over many small blocks, with copies, overlaps, repeats within a text, rows without id and repeated ids."""
    rng = np.random.default_rng(5)
    fresh = iter(range(10**9))
    new = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    passages = [new(n) for n in (11, 12, 13, 14, 19, 26, 40)]
    rows = []
    for i in range(160):
        words = new(int(rng.integers(0, 9)))
        for _ in range(int(rng.integers(0, 4))):
            words += passages[rng.integers(len(passages))] + new(int(rng.integers(0, 8)))
        rows.append((int(rng.permutation(500)[0]) if i % 9 else None, "  ".join(words)))
    rows += [(1000 + k, rows[5][1]) for k in range(30)] + [(3, rows[7][1]), (2000, rows[7][1]), (2000, rows[7][1])] + [(i, " ".join(["same"] * n)) for i, n in ((700, 12), (701, 13), (702, 30), (699, 14))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_substrings(df, rows, block_bytes=2000)
    check_substrings(df, rows)


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    """With first hashes of two bits, second hashes still tell windows apart."""
    monkeypatch.setattr(substrings.Words, "window_hashes", lambda self, at: (substrings._window_hashes(self.hashes, 13)[at] >> np.uint64(62)).view(np.int64))
    known = substrings.pa.table({"doc_id": substrings.pa.array([], "int64"), "key": substrings.pa.array([], "int64"), "hash": substrings.pa.array([], "int64")})
    words = lambda k: " ".join(f"{k}x{i}" for i in range(20))
    rows = [(1, words("a")), (2, words("b") + " " + words("a")), (3, words("c")), (4, words("b"))]
    table = substrings.pa.table({"doc_id": [i for i, _ in rows], "key": [i for i, _ in rows], "text": [t for _, t in rows], "block": [0] * 4})
    anchors = substrings.block_anchors(table, known)
    shared = substrings.pa.table({"hash": anchors.filter(anchors["several"])["hash"], "doc_id": substrings.pa.nulls(anchors["several"].to_pylist().count(True), "int64"), "key": substrings.pa.nulls(anchors["several"].to_pylist().count(True), "int64")})
    windows = substrings.block_windows(table, shared)
    rows_back = [w for w in windows.to_pylist() if w["several"]]
    back = substrings.pa.table({"hash": [w["hash"] for w in rows_back], "first": [w["low"] for w in rows_back], "second": substrings.pa.array([w["second"] if w["clash"] else None for w in rows_back], "int32"), "doc_id": substrings.pa.nulls(len(rows_back), "int64"), "key": substrings.pa.nulls(len(rows_back), "int64")})
    got = substrings.block_texts(table, back)
    assert [tuple(r.values()) for r in got.to_pylist()] == plain_substrings(rows)


def test_substrings_of_nothing(spark):
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- Merkle manifest


def plain_tree(leaves):
    """Root, and for each leaf its siblings as (digest, whether it stands first), None where a node is alone."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, k in enumerate(at):
            paths[i].append((level[k ^ 1], k % 2 == 1) if k ^ 1 < len(level) else None)
            at[i] = k // 2
        level = [sha("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
    return level[0], paths


def plain_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(part, (r[0], r[3], r[2], r[4], r[1]))))
    groups = {}
    for r in rows:
        bump = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        groups.setdefault(r[2], []).append((r[0], leaf(r), leaf((*r[:4], r[4] + 1)) if bump else leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = plain_tree([x[1] for x in groups[g]])
    root, crowns = plain_tree([trees[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for (doc_id, own, other), path in zip(groups[g], trees[g][1], strict=True):
            steps, value = path + crowns[k], other
            for s in steps:
                value = sha(value) if s is None else sha(s[0] + value) if s[1] else sha(value + s[0])
            out.append((doc_id, own, trees[g][0], root, sha("".join(s[0] for s in steps if s)), value, value == root))
    return out


def check_manifest(df, rows):
    tampered = F.crc32(df["doc_id"].cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(df, changes={"n_chars": F.when(tampered, df["n_chars"] + 1).otherwise(df["n_chars"])})
    assert sorted(map(str, map(tuple, merkle.digests(found).collect()))) == sorted(map(str, plain_manifest(rows)))
    return found


def test_manifest_of_odd_rows(spark, odd, odd_rows):
    check_manifest(odd, odd_rows)


def test_manifest_of_blocks_and_groups(spark):
    """One group of several blocks, many groups of one leaf and of a few, and null groups."""
    rows = [(i, f"t{i}", "en", "s", i) for i in range(2500)] + [(i, "x", f"g{i}", None, None) for i in range(1100)] + [(i, None, None, None, 3) for i in range(5)] + [(i, "é", "Zü", "s", 1) for i in range(3)] + [(7, "t7", "en", "s", 7)]
    found = check_manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows)
    copied = found.groupBy("copied").count().collect()
    assert max(r.copied for r in copied) == 1 + 12 + 11 and min(r.copied for r in copied) == 0


def test_versions_share_nodes():
    leaves = [sha(str(i)) for i in range(1000)]
    tree = merkle.PersistentTree(leaves, 10)
    before, size = list(tree.digests), len(tree.digests)
    one = tree.updated(17, sha("other"))
    assert len(tree.digests) == size + 11 and tree.digests[:size] == before
    two = tree.updated(900, sha("more"), one)
    changed = list(leaves)
    changed[17] = sha("other")
    assert tree.digests[one] == plain_tree(changed)[0] != tree.digests[tree.root] == plain_tree(leaves)[0]
    changed[900] = sha("more")
    assert tree.digests[two] == plain_tree(changed)[0]


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")).count() == 0
