"""Each registered query on a small table against a plain computation of what it has to return; repeated rows and ids; the pipeline."""

import hashlib
import random
import shutil
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from readloom.llm import bytebpe, common, counts, knn, langid, licenses, lines, media, packing, queries, simhash, substrings

RNG = random.Random(21)
VOCAB = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(500)]
LINE = "Subscribe to our letter and never miss a post."


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


BASE, LONG = prose(300), prose(5000)
NEAR = BASE.split()
NEAR[150] = "changed"
TEXTS = [BASE, BASE, " ".join(NEAR), None, "", " \n", "² ½ Ⅷ", LONG, "x <|endoftext|> y", licenses.MIT, "Grüße aus Köln, ça va? 日本 🙂"]
TEXTS += [f"{prose(40)}\n{LINE}\n{prose(20)}" for _ in range(15)]
DOCS = [(i, t, ["en", "de", None][i % 3], f"s{i % 13}" if i % 5 else None, len(t or "")) for i, t in enumerate(TEXTS)]
TWICE = [(7, "another text of the same id " + prose(60), "en", "s1", 5), (0, BASE, "en", None, 9), (None, prose(30), "de", "s2", 1), (None, None, None, None, None), (26, BASE + " " + prose(3), "en", "s1", 7), (26, prose(80), "de", "s4", 7)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", params=["", "reversed", "empty"])
def sf_dir(spark, tmp_path_factory, request):
    """The table in two orders, and none of it."""
    at = str(tmp_path_factory.mktemp("sf"))
    rows = {"": DOCS + TWICE, "reversed": (DOCS + TWICE)[::-1], "empty": []}[request.param]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=8).round(2)]) for i in range(230)] if rows else []
    vectors += [(50, vectors[50][1]), (100, [9.0] * 8), (7, vectors[7][1]), (300, None), (350, [float("nan")])] if rows else []
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(2).write.parquet(f"{at}/embeddings.parquet")
    yield at
    shutil.rmtree(at)


@pytest.fixture
def docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def ordered(rows):
    return sorted(rows, key=str)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_op1(spark, sf_dir, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.vocabulary(path, public_tokenizers.PATTERN).ranks, special_tokens={})
    want = {}
    for _, text, lang, source, _ in docs:
        n, k = want.get((source, lang), (0, 0))
        want[source, lang] = n + 1, k + len(enc.encode_ordinary(text or ""))
    got = counts.op1_token_counts(spark, sf_dir).collect()
    assert {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in got} == want and {r["tokenizer_version"] for r in got} <= {"byte_bpe_50k.tiktoken"}


def test_op2(spark, sf_dir, docs):
    want = []
    for i, text, *_ in docs:
        raw = (text or "").encode()
        data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        file = media.wave(data)
        mu, law = ([int(t[x]) for x in data] for t in (media.MULAW, media.ALAW))
        half = [(mu[max(0, k - 1)] + 2 * mu[k] + mu[min(len(mu) - 1, k + 1)] + 2) >> 2 for k in range(0, len(mu), 2)]
        pcm = zlib.crc32(bytes((x >> 8) + 128 for x in half))
        steps = zlib.crc32(media.adpcm(np.frombuffer(data, np.uint8)).astype("<i2").tobytes())
        feature = f"mulaw={sum(x * x for x in mu) // len(mu)};alaw={sum(x * x for x in law) // len(law)};adpcm={steps:08x};pcm4k={pcm:08x}"
        want.append((i, len(raw), len(data), sha(data), zlib.crc32(data[-64:]), len(file), sha(file), feature))
    assert ordered(tuple(r) for r in media.op2_media(spark, sf_dir).collect()) == ordered(want)


def test_op3(spark, sf_dir, docs):
    import xxhash

    def fingerprint(text):
        ws = (text or "").encode().lower().split()
        grams = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
        hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(d[1]) for d in docs]
    group = list(range(len(docs)))
    for _ in docs:
        group = [min(group[j] for j in range(len(docs)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(docs))]
    least = {g: min((d[0] for d, h in zip(docs, group) if h == g and d[0] is not None), default=None) for g in group}
    want = [(d[0], f"{p:016x}", least[g]) for d, p, g in zip(docs, prints, group)]
    assert ordered((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op3_simhash(spark, sf_dir).collect()) == ordered(want)


def test_op4(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    fine = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if v is not None and np.isfinite(v).all()]
    want = set()
    for q in {i for i, _ in fine if i % 50 == 0}:
        best = sorted({(-int(x @ y), i, n) for _, x in [f for f in fine if f[0] == q] for n, (i, y) in enumerate(fine) if i != q})
        seen, rank = {}, 0
        for s, i, n in best:  # a row counts once for each vector of the query's id
            if rank < 5:
                rank += 1
                want.add((q, rank, i, -s))
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn.op4_voronoi_knn(spark, sf_dir).collect()}
    single = {q for q in {w[0] for w in want} if len({tuple(v) for i, v in fine if i == q}) == 1}
    assert {g for g in got if g[0] in single} == {w for w in want if w[0] in single} and {g[0] for g in got} == {w[0] for w in want}
    assert all(sum(g[0] == q for g in got) == 5 for q in {g[0] for g in got})


def test_op5(spark, sf_dir, docs):
    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text, *_ in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(i, k, s, len(p := ids[s : s + 4096]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    got = packing.op5_packing(spark, sf_dir).collect()
    assert ordered((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == ordered(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 4096
    assert len(bins) == packing.lower_bound(np.array([r["length"] for r in got], int), 4096)


def test_op7(spark, sf_dir, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.vocabulary(path, public_tokenizers.PATTERN).ranks, special_tokens={})
    want = [(i, len(ids := enc.encode_ordinary(t or "")), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for i, t, *_ in docs]
    assert ordered(tuple(r) for r in bytebpe.op7_byte_bpe(spark, sf_dir).collect()) == ordered(want)


def plain_line_dedup(docs):
    bare = lambda x: x.strip(" \t\r")
    sites, first = {}, {}
    for i, text, _, source, _ in docs:
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            if bare(line):
                sites.setdefault(bare(line), set()).update({source} - {None})
                at = (i is None, i if i is not None else 0, text)
                # of several texts of one id any may come first, but one does
                first.setdefault(bare(line), []).append((at, pos))
    return {x for x, s in sites.items() if len(s) >= 10}, first


@pytest.mark.parametrize("literal", [lines.LITERAL, 0])
def test_op8(spark, sf_dir, docs, literal):
    bad, first = plain_line_dedup(docs)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lines.remove_boilerplate(rows, literal=literal).collect()
    keeper = {x: min(first[x])[0] for x in bad}
    want = []
    for i, text, lang, source, n in docs:
        kept = None if text is None else [x for x in text.split("\n") if x.strip(" \t\r") not in bad or keeper[x.strip(" \t\r")] == (i is None, i if i is not None else 0, text)]
        want.append((i, None if text is None else "\n".join(kept), lang, source, n, 0 if text is None else text.count("\n") + 1 - len(kept)))
    assert ordered(tuple(r) for r in got) == ordered(want) and (not docs or bad == {LINE})


def test_op9(spark, sf_dir, docs):
    got = licenses.op9_license_scan(spark, sf_dir).collect()
    assert len(got) == len(docs) and [r["doc_id"] for r in got if r["license_id"]] == ([9] if docs else [])
    known = licenses.known_digests(spark.createDataFrame(licenses.KNOWN, "license_id string, text string"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert ordered(map(tuple, licenses.scan(rows, known, literal=0).collect())) == ordered(map(tuple, got))


def test_license_forms(spark):
    """Rows of one id and canonical text keep their own lines; a notice on the license's own line; every known text; both ways of looking up."""
    known = licenses.known_digests(spark.createDataFrame([("X", "alpha"), ("Y", "beta gamma")], "license_id string, text string"))
    df = spark.createDataFrame([(1, "alpha beta gamma"), (1, "alpha\nbeta gamma"), (2, "ALPHA!"), (3, None)], "doc_id long, text string")
    for literal in (licenses.LITERAL, 0):
        assert ordered((r["doc_id"], r["license_id"], r["line_licenses"]) for r in licenses.scan(df, known, literal=literal).collect()) == ordered([(1, None, ""), (1, None, "X,Y"), (2, "X", "X"), (3, None, "")])
    every = licenses.known_digests(spark.createDataFrame(licenses.KNOWN, "license_id string, text string"))
    texts = [(i, f"{title}\n\nCopyright (c) 2021-2024, Some Body, Inc. All rights reserved.\n\n{t}".replace("\n", end)) for i, title, t in licenses.WHOLE for end in ("\n", "\r\n  ", " ")]
    found = licenses.scan(spark.createDataFrame(texts, "doc_id string, text string"), every).collect()
    assert [r["license_id"] for r in found] == [r["doc_id"] for r in found] and len({i for i, _, _ in licenses.WHOLE}) >= 8


def test_rollup_under_way(spark, tmp_path):
    """Any sequence of changes, replays and compactions, with a batch that is committed in the middle of a compaction, sums up as a dictionary does."""
    rng = random.Random(8)
    roll = counts.TokenRollup(spark, f"file://{tmp_path}/r")
    state, want = {}, {}

    def batch(n):
        changes = []
        for _ in range(n):
            i = rng.randrange(12)
            before, after = state.get(i), None if rng.random() < 0.3 else (rng.choice(["a", None]), rng.choice(["en", None]), rng.choice(["v1", "v2"]), rng.randrange(50))
            if before is None and after is None:
                continue
            changes.append((before, after))
            state[i] = after
            for image, sign in ((before, -1), (after, 1)):
                if image:
                    d, t = want.get(image[:3], (0, 0))
                    want[image[:3]] = d + sign, t + sign * image[3]
        return spark.createDataFrame(changes, f"before {counts.IMAGE}, after {counts.IMAGE}")

    total = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in roll.totals().collect()}
    sent = []
    for step in range(6):
        sent.append((f"b{step}", batch(8)))
        assert roll.commit(*sent[-1]) and not roll.commit(*rng.choice(sent))
        if step in (2, 4):
            late = (f"late{step}", batch(5))
            real = roll._sum
            roll._sum = lambda names: (roll.commit(*late), real(names))[1]  # noqa: B023
            roll.compact()
            roll._sum = real
            assert not roll.commit(*late)
            sent.append(late)
        assert total() == {k: v for k, v in want.items() if v != (0, 0)}
    roll.compact()
    roll.compact()
    assert all(not roll.commit(*x) for x in sent) and total() == {k: v for k, v in want.items() if v != (0, 0)}
    assert roll._publish(counts.signed(batch(0)).select(*counts.KEYS, "n_docs", "n_tokens"), "batch-x") and not roll._publish(counts.signed(batch(0)).select(*counts.KEYS, "n_docs", "n_tokens"), "batch-x")


def test_knn_prunes_and_declines(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 12)) * 5
    rows = [(i, [float(x) for x in (centres[i % 20] + rng.normal(size=12) * 0.05)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = knn.integer_vectors(df, "vec_id", "embedding")
    made, real = {}, knn.cut
    knn.cut = lambda x, name: made.setdefault(name, real(x, name))
    try:
        got = knn.top_k(vectors, F.col("vec_id") % 50 == 0, pivots=15).collect()
    finally:
        knn.cut = real
    fine = np.floor(256 * np.array([v for _, v in rows]))
    for q in range(0, 2000, 50):
        want = sorted((-int(fine[q] @ y), i) for i, y in enumerate(fine) if i != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert made["needed"].count() < 4 * len(rows)
    big = spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        knn.top_k(knn.integer_vectors(big, "vec_id", "embedding"), F.col("vec_id") % 50 == 0).collect()
    wide = spark.createDataFrame([(0, [2.0**30] * 4), (1, [2.0**30] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="too large"):
        knn.top_k(knn.integer_vectors(wide, "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


@pytest.mark.parametrize("scale, spread, chunk", [(1, knn.SPREAD, knn.CHUNK), (1, 0, 6_000), (2**12, 0, 6_000), (2**18, 0, 10**6)])
def test_knn_of_loose_vectors(spark, scale, spread, chunk):
    """Vectors that no bound prunes are not replicated to every group, and results are the same in floats, doubles and integers."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) * scale for x in rng.normal(size=16).round(1)]) for i in range(1500)]
    rows += [(i % 40 * 50, rows[7][1]) for i in range(60)] + [(2000 + i, rows[50][1]) for i in range(60)] + [(3000 + i, [0.0]) for i in range(40)]
    vectors = knn.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), "vec_id", "embedding")
    made, real = {}, knn.cut
    knn.cut = lambda x, name: made.update({name: real(x, name)}) or made[name]
    try:
        got = knn.top_k(vectors, (F.col("vec_id") % 50 == 0) & (F.col("vec_id") < 1000), pivots=8, **({} if spread else {"spread": spread, "chunk": chunk})).collect()
    finally:
        knn.cut = real
    assert made["needed"].count() <= 3 * len(rows)
    fine = [(i, [int(np.floor(256 * x)) for x in v] + [0] * (16 - len(v))) for i, v in rows]
    for q in range(0, 1000, 50):
        own = {tuple(v) for i, v in fine if i == q}
        want = sorted((-int(np.array(x) @ np.array(y)), i) for x in own for i, y in fine if i != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_knn_gives_bounded_batches():
    """A batch that every group needs leaves in pieces."""
    rng = np.random.default_rng(9)
    points, n, dim = rng.normal(size=(500, 64)), 1500, 64
    batch = pa.RecordBatch.from_arrays([pa.array(rng.integers(0, 500, n).astype(np.int32)), pa.array(np.arange(n)), pa.array(list(rng.integers(-9, 9, (n, dim))), pa.list_(pa.int64()))], ["g", "vec_id", "v"])
    sizes = [(b.num_rows, b.nbytes) for b in knn._needed(points, np.ones(500), np.full(500, -np.inf), np.ones(500))(iter([batch]))]
    assert sum(x for x, _ in sizes) == 500 * n and max(x for _, x in sizes) < 8 << 20


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("several", [False, True])
def test_places_are_shuffled_once(spark, several):
    rows = [(k, d, k % 2 if several else 0, d, d + 1) for k in range(40) for d in range(k % 5 + 1)] + [(None, 1, 0, 0, 0), (3, None, 0, 0, 0)]
    found = substrings.to_first(common.cut(spark.createDataFrame(rows, "key long, doc long, ver long, l int, r int"), "places"), several)
    names = ["doc", "ver", "l", "r", "rep", "rver", "rl", "rr"]
    want = [(d, v, x, y, 0, v, 0, 1) for k, d, v, x, y in rows if k is not None and d]
    assert ordered(tuple(r[n] for n in names) for r in found.collect()) == ordered(want)
    assert "ReusedExchange" in executed(found)


def test_parts_are_shuffled_once(spark):
    parts = common.cut(spark.createDataFrame([(d, 0, 64 * d, 64 * d + 64, d, f"text {d}".encode()) for d in range(30)], "doc long, ver long, lo int, hi int, at long, part binary"), "parts")
    pairs = common.cut(spark.createDataFrame([(d // 3, 0, d, 0, 64 * d, 64 * d + 64, 64 * (d // 3), 64 * (d // 3) + 64) for d in range(1, 30)], "rep long, rver long, doc long, ver long, lo int, hi int, rlo int, rhi int"), "pairs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = substrings.both_parts(pairs, parts)
        got = ordered((r["doc"], r["ver"], r["rep"], r["lo"], r["at"], bytes(r["part"]), bytes(r["other"])) for r in rows.collect())
        plan = executed(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == ordered((d, 0, d // 3, 64 * d, d, f"text {d}".encode(), f"text {d // 3}".encode()) for d in range(1, 30))
    assert "ReusedExchange" in plan


def test_equal_rows_are_dealt_out(spark):
    rows = spark.createDataFrame([(None, "")] * 60, "doc_id long, text string").repartition(3)
    found = common.cut(packing.pieces(rows, public_tokenizers.path("word_bpe_49k.json")), "equal")
    got = packing.pack(found, capacity=4, part=10).collect()
    assert len(got) == 60 and len({r["sequence_id"] for r in got}) == 15


def dense_scores(train, langs, texts, landmarks, ridge):
    """One-versus-rest kernel ridge regression on Nyström features from whole kernel matrices over n-gram sets."""
    grams = lambda t: set(langid.ngrams([t.lower()])[0].tolist())
    k = lambda a, b: np.array([[len(x & y) / np.sqrt(max(1, len(x)) * max(1, len(y))) for y in b] for x in a])
    sets, names = [grams(t) for t in train], sorted(set(langs))
    marks = [sets[i] for n in names for i in [j for j, x in enumerate(langs) if x == n][:landmarks]]
    values, vectors = np.linalg.eigh(k(marks, marks))
    keep = values > 1e-8 * values.max()
    features = lambda x: k(x, marks) @ (vectors[:, keep] / np.sqrt(values[keep]))
    x, y = features(sets), np.array([[1.0 if a == n else -1.0 for n in names] for a in langs])
    w = np.array([1 / langs.count(a) / len(names) for a in langs])
    mean_x, mean_y = w @ x, w @ y
    beta = np.linalg.solve((x - mean_x).T @ (w[:, None] * (x - mean_x)) + ridge * np.eye(x.shape[1]), (x - mean_x).T @ (w[:, None] * (y - mean_y)))
    return (features([grams(t) for t in texts]) - mean_x) @ beta + mean_y


def test_langid_against_dense_kernels():
    rng = random.Random(5)
    words = {"aa": "the and of to in that with for".split(), "bb": "der die und in das mit für ist".split(), "cc": "le la et les des que dans à".split()}
    make = lambda n: " ".join(rng.choice(words[n]) for _ in range(rng.randint(3, 40)))
    langs = [rng.choice("aa bb cc".split()) for _ in range(60)]
    train, texts = [make(n) for n in langs], [make(n) for n in "aa bb cc".split() * 10] + ["", "zzz", "a" * 5000]
    model = langid.fit_sets(langs, [np.unique(langid.ngrams([t.lower()])[0]).astype(np.int64) for t in train], landmarks=6)
    want = dense_scores(train, langs, texts, 6, langid.RIDGE)
    assert np.allclose(model.scores(texts), want, atol=1e-4) and [model.langs[i] for i in want.argmax(axis=1)[:30]] == "aa bb cc".split() * 10


def test_langid_sample(spark):
    """A language whose rows mostly are null or repeated is learnt; each distinct text counts once; a numeral is no letter."""
    rows = [(i, None, "xx") for i in range(3000)] + [(9000, "only this text", "xx")] * 700 + [(10_000 + i, f"ganz andere Worte {i}", "yy") for i in range(900)] + [(5, "text of an id", "xx"), (5, "and another text of it", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    taken, real = {}, langid.fit_sets
    langid.fit_sets = lambda langs, sets, *a: (taken.update({n: langs.count(n) for n in set(langs)}), real(langs, sets, *a))[1]
    try:
        model = langid.fit(df, F.lit(True), per_lang=50)
    finally:
        langid.fit_sets = real
    assert taken == {"xx": 3, "yy": 50}
    assert model.predict(["only this text", "ganz andere Worte", "² ½ Ⅷ", "12 %", None])[0] == ["xx", "yy", "und", "und", "und"]


def shared_words(texts, n=50):
    """Of each text, the words that lie in a stretch of n which a text of a smaller id has word for word."""
    split = [(i, t.encode().lower().split()) for i, t in texts]
    first = {}
    for i, ws in split:
        for k in range(len(ws) - n + 1):
            first[tuple(ws[k : k + n])] = min(i, first.get(tuple(ws[k : k + n]), i))
    return {(i, h, j) for h, (i, ws) in enumerate(split) for k in range(len(ws) - n + 1) if first[tuple(ws[k : k + n])] < i for j in range(k, k + n)}


def test_op10_loses_nothing(spark):
    """All words of every stretch of 50 that a document shares with an earlier one are in a passage, on the driver's small table."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    found = {}
    for r in substrings.op10_substring_dedup(spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"] + 1))
    want = shared_words([(i, t) for i, t in rows if t])
    assert len(want) > 1000 and all(j in found.get(i, ()) for i, _, j in want)


def test_op10_copies_and_versions(spark):
    """Equal texts; ids with two texts, each judged by itself, in either order; near copies; nothing is cut inside a letter."""
    rng = random.Random(3)
    words = lambda n: " ".join(f"wörd{rng.randrange(10**6)}" for _ in range(n))
    a, b, shared = words(120), words(120), words(70)
    rows = [(1, a), (2, a), (2, f"{words(40)} {shared} {words(30)}"), (3, f"{words(20)} {shared} {words(20)}"), (3, b), (4, b), (4, b), (5, words(80)), (None, a), (6, None), (7, words(10)), (8, " ".join(a.split()[:60] + ["neu"] + a.split()[60:]))]
    want = None
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(order)], "doc_id long, text string, version string, key int").repartition(2)
        found = substrings.passages(df)
        pairs = {(r["doc_id"], r["first_doc_id"]) for r in found.collect()}
        assert pairs == {(2, 1), (3, 2), (4, 3), (8, 1)}
        left = ordered((r["doc_id"], r["text"]) for r in substrings.remove_passages(df, substrings.cut(found, "found")).select("doc_id", "text").collect())
        kept = [(i, t) for i, t in left if i == 3]
        assert (1, a) in left and (None, a) in left and (3, b) in left and len(kept) == 2 and shared not in kept[0][1] + kept[1][1] and not [x for x in left if x[0] in (4, 8) or x == (2, a)]
        assert want in (None, left)
        want = left


def test_scratch(spark):
    common.cut(spark.range(3), "swept").count()
    at = common.scratch(spark)
    assert "readloom-" in at
    common.sweep(spark)
    import os

    assert not os.path.exists(at.removeprefix("file://"))


def test_queries_and_pipeline(spark, sf_dir, docs):
    assert sorted(queries.QUERIES) == sorted(f"op{n}" for n in ["1_token_counts", "2_media", "3_simhash", "4_voronoi_knn", "5_packing", "6_langid", "7_byte_bpe", "8_line_dedup", "9_license_scan", "10_substring_dedup"])
    got = langid.op6_langid(spark, sf_dir).collect()
    assert ordered((r["doc_id"], r["held_out"]) for r in got) == ordered((d[0], zlib.crc32(str(d[0] if d[0] is not None else "").encode()) % 3 == 1) for d in docs)
    assert all((r["lang_pred"] == "und") == (r["score"] == 0.0) for r in got if r["doc_id"] in (3, 4, 5, 6)) and {r["lang_pred"] for r in got} <= {"en", "de", "und"}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    ids = [r["doc_id"] for r in pieces]
    if not docs:
        assert not ids
        return
    assert ids.count(None) == 1 and sorted({i for i in ids if i is not None}) == [0, 7, 8, 9, 10, *range(11, 26), 26]
    assert sum(r["piece"] == 0 for r in pieces if r["doc_id"] == 7) == 2 and sum(r["piece"] == 0 for r in pieces if r["doc_id"] == 26) == 1


def test_stages_by_brute_force(spark, sf_dir, docs):
    """Each stage on what its predecessor kept, against a plain computation."""
    now, names = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("key", F.lit(1)).withColumn("version", F.lit("v")), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "SimHash near-dedup", "substring dedup", "best-fit packing"]
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = rows(now), common.cut(stage(spark, now, sf_dir), "stage")
        kept = rows(after)
        assert after.columns == now.columns
        if name == "language ID":
            assert ordered(x[:2] for x in kept) == ordered(d[:2] for d in before if d[1] and langid.LETTER.search(d[1]))
        elif name == "line dedup":
            bad, first = plain_line_dedup(before)
            keeper = {x: min(first[x])[0] for x in bad}
            want = [(i, "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in bad or keeper[x.strip(" \t\r")] == (i is None, i or 0, t))) for i, t, *_ in before]
            assert ordered(x[:2] for x in kept) == ordered(want)
        elif name == "SimHash near-dedup":
            prints = [simhash.fingerprint((d[1] or "").encode()) for d in before]
            group = list(range(len(before)))
            for _ in before:
                group = [min(group[j] for j in range(len(before)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(before))]
            for g in set(group):
                own = [d for d, h in zip(before, group) if h == g]
                least = min((d[0] for d in own if d[0] is not None), default=None)
                stay = [d for d in kept if d in own]
                assert sum(d[0] is not None for d in stay) == (least is not None) and all(d[0] in (None, least) for d in stay)
            assert sum(d[0] is None for d in kept) == sum(d[0] is None for d in before)
        else:
            assert not shared_words([d[:2] for d in kept if d[0] is not None and d[1]])
            assert {d[0] for d in kept} >= {d[0] for d in before} - {26}
        now = after
