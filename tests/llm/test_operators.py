"""The training-data operators against brute force, on tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from readloom.llm import bytebpe, counts, knn, langid, licenses, lines, media, packing, simhash, substrings

RNG = random.Random(7)
VOCAB = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]
PASSAGE = " ".join(RNG.choice(VOCAB) for _ in range(60))


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


BASE = prose(150)
TEXTS = [
    BASE, BASE, BASE + " extra", None, "", "  \n\t ", "123 456 !!", prose(30) + " " + PASSAGE + " " + prose(80), prose(90) + "\n" + PASSAGE.upper() + "\n" + prose(10),
    prose(8000), "Eau " * 3000, "don't it's WE'LL\r\n", "日本語のテキスト 🙂", prose(200), "one two", "a", "a <|endoftext|> b<|startoftext|>", "² ½ Ⅷ",
]
ROWS = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i else None, 0, i, "x", "y") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[13], (None, prose(60), "en", "s1", 0, 5, None, None), (None, None, None, None, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, line string, root string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_fingerprint(text):
    ws = (text or "").encode().lower().split()
    grams = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_simhash(docs, none, hot):
    got = simhash.near_dedup(docs, hot=hot).collect()
    rows = sorted((r[0], r[1]) for r in ROWS if r[0] is not None)
    prints = {i: plain_fingerprint(t) for i, t in rows}
    label = {i: i for i in prints}
    for _ in prints:
        label = {i: min(label[j] for j in prints if bin(prints[i] ^ prints[j]).count("1") <= 3) for i in prints}
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] is not None:
            assert int(r["fingerprint"], 16) == prints[r["doc_id"]] and r["component_id"] == label[r["doc_id"]]
    assert simhash.near_dedup(none).count() == 0


def test_simhash_links_many(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(40)]
    fps = np.unique(np.array(fps, np.uint64))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    label = np.arange(len(fps))
    while (nxt := np.where(near, label[None], len(fps)).min(axis=1)).tolist() != label.tolist():
        label = nxt
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    true = dict(zip(fps.view(np.int64).tolist(), label.tolist()))
    for hot in (simhash.HOT, 10):
        parent = {int(x): int(x) for x in fps.view(np.int64)}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in simhash.links(df, hot).collect():
            assert true[u] == true[v]
            parent[find(u)] = find(v)
        roots = [find(int(x)) for x in fps.view(np.int64)]
        assert len({(a, b) for a, b in zip(roots, label.tolist())}) == len(set(roots)) == len(set(label.tolist()))


def test_compact_windows():
    rng = np.random.default_rng(1)
    for n, least, ties in ((200, 7, False), (60, 5, True), (500, 46, False), (3, 5, False)):
        h = rng.integers(1, 6 if ties else 2**40, n).astype(np.uint64) << np.uint64(23)
        h[rng.integers(0, n, 3)] = 0
        want = set()
        for i in np.flatnonzero(h):
            left, right = i, i
            while left > 0 and h[left - 1] > h[i]:
                left -= 1
            while right < n - 1 and h[right + 1] >= h[i]:
                right += 1
            if right - left + 1 >= least:
                want.add((i, left, right))
        assert set(zip(*(x.tolist() for x in substrings.compact_windows(h, least)))) == want


def test_passages(docs, none):
    found = substrings.passages(docs)
    pairs = {(r["doc_id"], r["first_doc_id"]): r for r in found.collect()}
    assert (8, 7) in pairs and (1, 0) in pairs and not {i for p in pairs for i in p} & {3, 4, 9, 10, 13, 14, None}
    r = pairs[8, 7]
    assert ROWS[8][1].encode()[r["start_byte"] : r["end_byte"]].decode().lower().split() == PASSAGE.split()
    kept = substrings.remove_passages(docs, found)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == docs.columns and 1 not in texts and texts[7] == ROWS[7][1] and PASSAGE.upper() not in texts[8] and texts[9] == ROWS[9][1] and texts[3] is None
    assert substrings.passages(none).count() == 0


def test_passages_past_a_signatures_first(spark):
    """A passage that documents share is found though each of its shingles, or all but the smallest, is first in an unrelated earlier document."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [words(55) for _ in range(4)]
    rows = []
    for n, p in enumerate(passages):
        smallest = substrings.mix((substrings._hashed(" ".join(p).encode())[2] | np.uint64(1 << 63)) ^ substrings.mix(np.array([0x9E3779B97F4A7C15], np.uint64))[0]).argmin()
        for i in (i for i in range(len(p) - 4) if n % 2 or i != smallest):  # one earlier document a shingle, in another context
            rows.append((1000 * n + i, " ".join(words(50) + p[i : i + 5] + words(50))))
        rows += [(1000 * n + 100 + i, " ".join(words(60) + p + words(60))) for i in range(3)]
    found = substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["first_doc_id"], r["doc_id"]) for r in found if r["start_word"] <= 60 and r["end_word"] >= 114}
    assert got >= {(1000 * n + 100, 1000 * n + 100 + i) for n in range(4) for i in (1, 2)}


@pytest.mark.parametrize("sides, gone, new", [(49, 0, 6), (49, 6, 0), (45, 0, 10), (45, 10, 0), (40, 0, 6), (40, 6, 0), (49, 6, 6), (60, 0, 20)])
def test_verify_finds_passages_with_a_changed_run(sides, gone, new):
    """Two sides of a passage, between which the later document lacks `gone` words and has `new` others, are one passage if similar enough."""
    words = lambda n: [f"w{RNG.randrange(10**6)}" for _ in range(n)]
    shingles = lambda ws: substrings._hashed(" ".join(ws).encode())[2]
    one, two = words(sides), words(sides)
    first, later = one + words(gone) + two, one + words(new) + two
    x, y = (set(shingles(w).tolist()) for w in (first, later))
    assert len(x & y) / len(x | y) >= 0.8
    phrase = words(7)
    for around in (0, 300):
        mine, theirs = (shingles(words(around) + phrase + words(12) + w + words(around)) for w in (later, first))
        found = substrings.verify(mine, theirs, 50, 0.8)
        assert [(s, e) for s, e, _ in found] == [(around + 19, around + 19 + len(later) - 1)] and found[0][2] >= 0.8


def test_verify_finds_all_that_is_shared():
    """Every stretch of min_words that the other document holds is in a passage, whatever lies around it."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        theirs = rng.integers(1, 2**62, 400).astype(np.uint64)
        mine = theirs.copy()
        changed = rng.integers(0, 400, 12)
        for i in changed:
            mine[i : i + 5] = rng.integers(1, 2**62, len(mine[i : i + 5]))
        found = substrings.verify(mine, theirs, 50, 0.8)
        got = {i for s, e, _ in found for i in range(s, e + 1)}
        known = set(theirs.tolist())
        for i in range(400 - 45):
            if all(x in known for x in mine[i : i + 46].tolist()):
                assert got >= set(range(i, i + 50))
        assert all(e - s + 1 >= 50 and sim >= 0.8 for s, e, sim in found)
    assert substrings.verify(mine[:0], theirs, 50, 0.8) == [] == substrings.verify(mine, theirs[:0], 50, 0.8)


def test_knn(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (304, []), (350, [1.0] * 8), (None, [1.0]), (7, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = knn.top_k(knn.integer_vectors(df, "vec_id", "embedding"), F.col("vec_id") % 50 == 0, pivots=4, slice_rows=60, query_rows=2).collect()
    fine = [(i, np.pad(np.floor(256 * np.array(v)), (0, 8 - len(v)))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, x in fine:
        if q % 50 == 0:
            want = sorted(((-int(x @ y), i) for i, y in fine if i != q))[:5]
            assert [(r["vec_id"], -r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, s) for s, i in want]
    assert knn.top_k(knn.integer_vectors(df.where("false"), "vec_id", "embedding"), F.col("vec_id") % 50 == 0).count() == 0


def test_knn_repeated_query_rows(spark):
    """Rows of a query's own id, as many as there are, do not crowd out what belongs to its result."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(200)]
    rows += [(i, v) for i, v in rows if i % 50 == 0] * 8 + [(7, rows[7][1])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = knn.top_k(knn.integer_vectors(df, "vec_id", "embedding"), F.col("vec_id") % 50 == 0).collect()
    fine = [(i, np.floor(256 * np.array(v))) for i, v in rows]
    for q in range(0, 200, 50):
        want = sorted((-int(fine[q][1] @ y), i) for i, y in fine if i != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_bytebpe(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    v = bytebpe.vocabulary(path, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    want = sorted((str(r[0]), len(ids := enc.encode_ordinary(r[1] or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ROWS)
    assert sorted((str(r[0]), *r[1:]) for r in bytebpe.digests(docs, path, public_tokenizers.PATTERN).collect()) == want
    coded = bytebpe.encode_texts(docs, path, public_tokenizers.PATTERN)
    back = bytebpe.decode_ids(coded, path, public_tokenizers.PATTERN)
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((r[1] or "").encode() for r in ROWS)
    assert v.one_by_one(b"a" * 500) == enc.encode_ordinary("a" * 500) and bytebpe.digests(none, path, public_tokenizers.PATTERN).count() == 0


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path, capacity=256, part=12).collect()
    t = tokenizers.Tokenizer.from_file(path)
    want = {r[0]: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in ROWS if r[0] is not None}
    assert sum(r["length"] for r in got) == sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)
    bins = {}
    for r in got:
        if r["doc_id"] is not None:
            ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == packing.zlib.crc32(ids.tobytes()) and len(ids) == r["length"] and r["start"] == 256 * r["piece"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 256
    bound = packing.lower_bound(np.array([r["length"] for r in got]), 256)
    assert bound <= len(bins) <= bound + 3
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3 and packing.lower_bound(np.array([34] * 4), 100) == 2 and packing.pack_documents(none, path).count() == 0


def test_langid(spark):
    letters = {"xx": "abcde", "yy": "defgh", "zz": "ijklé"}
    rows = [(i, " ".join("".join(RNG.choice(a) for _ in range(4)) for _ in range(RNG.randint(5, 60))), n) for i, (n, a) in enumerate(list(letters.items()) * 60)]
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "12 34 !", "yy"), (903, rows[0][1], None), (None, rows[1][1], "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, ~langid.held_out())
    got = langid.predict(df.withColumn("held_out", langid.held_out()), model).collect()
    held = [r for r in got if r["held_out"] and r["lang"] and r["text"] and r["doc_id"] < 900]
    assert len(held) > 30 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (900, 901, 902)} == {("und", 0.0)} and all(0 <= r["score"] <= 1 for r in got)
    blank = langid.fit(df.where("false"), ~langid.held_out())
    assert {r["lang_pred"] for r in langid.predict(df, blank).collect()} == {"und"}


def test_lines(spark, none):
    same, rare = "Cookies help us.", "Only here."
    rows = [(i, f"doc {i}\n  {same}\t\n\n{rare if i < 9 else 'z'}\n{same}", f"s{i}", "k") for i in range(12)] + [(50, None, "s1", "k"), (51, "", "s1", "k"), (None, same, None, "k"), (None, same, "s2", "k"), (3, f"doc 3\n  {same}\t\n\n{rare}\n{same}", "s3", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key string")
    got = lines.remove_boilerplate(df)
    out = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in got.collect()}
    assert got.columns == [*df.columns, "lines_removed"] and got.count() == len(rows)
    assert out[0] == (f"doc 0\n  {same}\t\n\n{rare}", 1) and out[5] == (f"doc 5\n\n{rare}", 2) and out[50] == (None, 0) and out[51] == ("", 0) and out[None] == ("", 1)
    assert lines.remove_boilerplate(none).count() == 0


def test_licenses(spark, docs, none):
    known = licenses.known_digests(spark.createDataFrame(licenses.KNOWN, "license_id string, text string"))
    text = "Copyright (c) 2020 Somebody\n" + licenses.MIT.upper().replace(" ", "\n").replace("LICENSE", "LICENCE")
    df = spark.createDataFrame([(1, text), (2, "Hello.\nReleased  under the MIT licence!\nx"), (3, None), (4, ""), (2, "Hello.\nReleased  under the MIT licence!\nx")], "doc_id long, text string")
    for limit in (licenses.LITERAL, -1):
        got = {r["doc_id"]: (r["license_id"], r["line_licenses"]) for r in licenses.scan(df, known, literal=limit).collect()}
        assert got == {1: ("MIT", ""), 2: (None, "MIT"), 3: (None, ""), 4: (None, "")} and licenses.scan(df, known, literal=limit).count() == 5 and licenses.scan(none, known, literal=limit).count() == 0
    assert licenses.scan(docs, known).count() == len(ROWS)


def test_media(docs, none):
    got = media.features(media.store(docs)).collect()
    want = sorted((len(p := (r[1] or "").encode()), hashlib.sha256(media.payload(p)).hexdigest()) for r in ROWS)
    assert sorted((r["n_bytes"], r["payload_sha256"]) for r in got) == want and all(r["payload_bytes"] % 64 == 0 and r["media_bytes"] > r["payload_bytes"] for r in got)
    assert media.MULAW[[0xFF, 0x7F, 0x80, 0x00]].tolist() == [0, 0, 32124, -32124] and media.ALAW[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    rng = np.random.default_rng(2)
    raw = rng.integers(0, 256, 64 * 5).astype(np.uint8)
    fast = media.adpcm(raw)
    for b, row in zip(raw.reshape(-1, 64), fast):
        value, index, out = int(b[:2].copy().view("<i2")[0]), min(int(b[2]), 88), []
        out.append(value)
        for byte in b[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = int(media.STEPS[index])
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + int(media.MOVES[code & 7])))
                out.append(value)
        assert row.tolist() == out
    assert media.resample_double(np.array([100, 100, 100], np.int16)).tolist() == [100] * 6 and media.resample_half(np.array([4, 8, 4, 4, 8], np.int16)).tolist() == [5, 5, 7] and media.pcm16k(media.store(docs)).count() == len(ROWS) and media.features(media.store(none)).count() == 0


def test_rollup(spark, docs, tmp_path):
    roll = counts.TokenRollup(spark, f"file://{tmp_path}/rollup")
    assert roll.totals().count() == 0
    image = counts.IMAGE
    change = lambda rows: spark.createDataFrame(rows, f"before {image}, after {image}")
    total = lambda: {(r[0], r[1], r[2]): (r[3], r[4]) for r in roll.totals().collect()}
    first = change([(None, ("a", "en", "v1", 5)), (None, ("a", "en", "v1", 7)), (None, (None, None, "v1", 1)), (None, ("b", "de", "v1", 3))])
    assert roll.commit("one", first) and not roll.commit("one", first)
    assert total() == {("a", "en", "v1"): (2, 12), (None, None, "v1"): (1, 1), ("b", "de", "v1"): (1, 3)}
    second = change([(("a", "en", "v1", 5), ("a", "en", "v1", 9)), (("b", "de", "v1", 3), None), (("a", "en", "v1", 7), ("a", "en", "v2", 6))])
    roll.commit("two", second)
    want = {("a", "en", "v1"): (1, 9), ("a", "en", "v2"): (1, 6), (None, None, "v1"): (1, 1)}
    assert total() == want
    roll.compact()
    assert total() == want and not roll.commit("two", second) and roll.commit("three", change([])) and total() == want
    counted = counts.count_tokens(docs.select("source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert counted.count() == len(ROWS) and counted.where("n_tokens = 0").count() >= 3


def test_pipeline(spark, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, "")
        if name != "best-fit packing":
            assert kept.columns == before.columns
        ids = {r["doc_id"] for r in kept.collect()}
        assert {0, 7, 8, 9, 13} <= ids
        assert name == "language ID" or 1 not in ids or name == "line dedup"
        assert not ids & {3, 4, 5, 6}
