"""Language ID by a string kernel.

The kernel of two texts is the number of character n-grams (n = 1 to 3, lower case) that both have, over the root of the
product of the numbers that each has: a blended-spectrum presence kernel, over n-grams hashed to 2**BITS places. Nyström
landmarks (documents of the training sample) turn it into features, and kernel ridge regression, one language versus
the rest, is solved on them. A batch of documents is scored by two matrix products: presence by landmarks' presence, and
kernel values by the weights.

Training takes at most PER_LANG distinct texts with a letter of each language, those of least hash, of the rows with a
language that the filter lets through, and MAX_LANGS languages at most, the most frequent; that is the documented bound of
the sample. Whole texts are scored.

A null text, or one without a letter (Unicode category L), is `und` with score 0. Ties go to the first language by name. With no training
document at all every prediction is `und`. Repeated rows give repeated result rows and count once in training, as do other
rows of the same text and language; rows of one id and different texts are different documents. An empty table gives an empty
result. Only the id, text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readloom.llm.common import blocks, tidy, version

BITS, ORDERS = 16, 3
PER_LANG, MAX_LANGS, LANDMARKS, RIDGE = 300, 200, 32, 1e-3
"""Training documents of a language at most; languages at most; landmarks of a language; the ridge."""
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of texts, and where each text's begin. Texts are lower-cased; no n-gram spans two of them."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = np.cumsum([0, *(len(t) for t in texts)])
    doc = np.repeat(np.arange(len(texts)), np.diff(cuts))
    codes, owners = [], []
    h = np.zeros(len(cp), np.uint32)
    for n in range(1, ORDERS + 1):
        h = (h[: len(cp) - n + 1] if n > 1 else h) * np.uint32(0x01000193) + cp[n - 1 :] if len(cp) >= n else h[:0]
        inside = doc[n - 1 :] == doc[: len(h)] if n > 1 else slice(None)
        mixed = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
        codes.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS))[inside])
        owners.append(doc[: len(h)][inside])
    return np.concatenate(codes), np.concatenate(owners)


def presence(texts: list[str], places: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """Of each text: its distinct n-grams (or, given places, whether each is there as 0 or 1), and how many it has."""
    lowered = [t.lower() for t in texts]
    for s, e in blocks([len(t) for t in lowered], 1 << 19):
        codes, owner = ngrams(lowered[s:e])
        there = np.zeros((e - s) << BITS, bool) if (e - s) <= 64 else None
        if there is not None:
            there[(owner << BITS) | codes] = True
            for row in there.reshape(e - s, 1 << BITS):
                yield (np.flatnonzero(row) if places is None else row[places]), int(np.count_nonzero(row))
            continue
        order = np.argsort(owner, kind="stable")
        codes, ends = codes[order], np.cumsum(np.bincount(owner, minlength=e - s))
        row = np.zeros(1 << BITS, bool)
        for a, z in zip(np.concatenate(([0], ends[:-1])), ends):
            row[codes[a:z]] = True
            yield (np.flatnonzero(row) if places is None else row[places]), int(np.count_nonzero(row))
            row[codes[a:z]] = False


@dataclass
class Model:
    """places: the n-grams of any landmark; presence: landmarks' presence there, over the root of their counts."""

    langs: list[str]
    places: np.ndarray
    presence: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str], rows: int = 256) -> np.ndarray:
        """A row of one-versus-rest outputs (about 1 for the language, -1 for others) per text."""
        out, batch, counts = [], [], []

        def flush() -> None:
            if batch:
                kernel = np.stack(batch).astype(np.float32) @ self.presence
                out.append(kernel / np.sqrt(np.maximum(counts, 1))[:, None] @ self.weights[:-1] + self.weights[-1])
                batch.clear()
                counts.clear()

        for row, count in presence(texts, self.places):
            batch.append(row)
            counts.append(count)
            if len(batch) == rows:
                flush()
        flush()
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.langs:
            known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
            found = self.scores([texts[i] for i in known])
            for i, k, x in zip(known, found.argmax(axis=1), found.max(axis=1) if len(found) else []):
                langs[i], scores[i] = self.langs[k], float(min(1.0, max(0.0, (x + 1) / 2)))
        return langs, scores


def fit_sets(langs: list[str], sets: list[np.ndarray], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model from the distinct n-grams and languages of training documents."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((1, 0)))
    marks = [i for n in names for i in [k for k, x in enumerate(langs) if x == n][:landmarks]]
    places = np.unique(np.concatenate([sets[i] for i in marks]))
    table = np.zeros((len(places), len(marks)), np.float32)
    for m, i in enumerate(marks):
        table[np.searchsorted(places, sets[i]), m] = 1 / np.sqrt(max(1, len(sets[i])))
    kernel = np.zeros((len(sets), len(marks)))
    for i, x in enumerate(sets):
        at = np.minimum(np.searchsorted(places, x), len(places) - 1) if len(places) else x[:0]
        at = at[places[at] == x] if len(places) else at
        kernel[i] = table[at].sum(axis=0) / np.sqrt(max(1, len(x)))
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-8 * max(values.max(), 1e-300)
    white = vectors[:, keep] / np.sqrt(values[keep])
    feats = kernel @ white
    goal = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    share = np.array([1 / langs.count(x) for x in langs])[:, None] / len(names)  # each language weighs the same
    mean_x, mean_y = (share * feats).sum(axis=0), (share * goal).sum(axis=0)
    x = feats - mean_x
    solved = np.linalg.solve(x.T @ (share * x) + ridge * np.eye(x.shape[1]), x.T @ (share * (goal - mean_y)))
    return Model(names, places, table, np.vstack((white @ solved, mean_y - mean_x @ solved)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [np.asarray(x, np.int32) for x, _ in presence([t or "" for t in b.column(1).to_pylist()])]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], ["lang", "ngrams"])


def fit(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, max_langs: int = MAX_LANGS) -> Model:
    """Learns from the text and language of documents where `usable` is true. Only n-gram sets of the sample come to the driver.

    The per_lang least hashes of a language lie under a bound that its number of rows foretells, so every task returns a
    few rows of each language; the bound is raised where repeated texts have left too few.
    """
    ready = docs.where(usable).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    ready = ready.withColumn("h", F.shiftrightunsigned(version("text"), 11).cast("double") / float(1 << 53))
    sizes = {r[0]: r[1] for r in ready.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    spread = {lang: 1.2 * per_lang + 60 for lang in sizes}
    chosen: dict[str, list[float]] = {}
    while todo := [x for x in sizes if x not in chosen]:
        below = F.create_map(*[F.lit(v) for x in todo for v in (x, min(2.0, spread[x] / sizes[x]))])
        got: dict[str, list[float]] = {x: [] for x in todo}
        for r in ready.where(F.col("lang").isin(todo) & (F.col("h") < below[F.col("lang")])).select("lang", "h").distinct().collect():
            got[r["lang"]].append(r["h"])
        for x in todo:
            if len(got[x]) >= per_lang or spread[x] >= 2 * sizes[x]:
                chosen[x] = sorted(got[x])[:per_lang]
            spread[x] *= 8
    if not chosen:
        return fit_sets([], [])
    rows = docs.sparkSession.createDataFrame([(x, h) for x, hs in chosen.items() for h in hs], "lang string, h double")
    sample = ready.join(F.broadcast(rows), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")
    found = sample.mapInArrow(tidy(_sets), "lang string, ngrams array<int>").collect()
    found = sorted((r for r in found if len(r[1])), key=lambda r: (r[0], len(r[1]), r[1]))
    order = np.random.default_rng(0).permutation(len(found))  # landmarks of all sizes
    return fit_sets([found[i][0] for i in order], [np.array(found[i][1], np.int64) for i in order])


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred: str = "lang_pred", score: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with the predicted language and its score; other columns stay, and the text if asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            langs, scores = m.predict(b.column(at).to_pylist())
            cols = [b.column(i) for i in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)

    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]
    schema = StructType([docs.schema.fields[i] for i in kept]).add(pred, "string").add(score, "double")
    return docs.mapInArrow(tidy(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out())
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep_text=False)
