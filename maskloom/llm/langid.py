"""Language ID by nearest centroid over normalised TF-IDF character n-grams.

A text becomes counts of its 1- to 3-grams of lower-cased letters (anything else
is one word boundary), hashed into ``DIMS`` cells, log-scaled, weighted by inverse
document frequency and scaled to length one. Each language has several centroids,
found by spherical k-means. A text gets the language of the centroid with the
largest cosine; it is rejected if it is further away than that language's radius
allows.

Document frequencies cover all labelled rows. The centroids are fitted on a
bounded sample of them: about ``SAMPLE_PER_LANG`` rows per language, chosen by a
hash of id and text, each language in a task of its own. The driver gets the
document frequencies of DIMS cells, and ``CENTROIDS`` of 32 KB for each language
that has labelled rows.

Defined results: null text, and text without a letter, is ``und`` with score 0 and
is rejected; ties go to the language first in code point order; without labelled
rows all is ``und``; repeated rows count as often as they come in the document
frequencies, and once in the fit; texts of any length are read whole; empty input
gives empty output. Other columns are kept, but for those named like an added one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import fresh, give_back, named
from maskloom.runtime import cut, ship

DIMS = 1 << 13
SAMPLE_PER_LANG = 400
CENTROIDS, ROUNDS = 4, 8
RADIUS_SHARE, RADIUS_QUANTILE = 0.5, 0.001
UNKNOWN = "und"
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts; None if there is no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(0))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters, the first stands for the boundary
    codes = np.concatenate((np.zeros(1, np.uint32), codes[keep], np.zeros(1, np.uint32)))
    total = np.zeros(DIMS, np.int64)
    shift = np.uint32(32 - 13)
    with np.errstate(over="ignore"):
        one = codes * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (codes[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
        three = (two[:-1] ^ (codes[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
    for grams, mask in ((one, codes > 0), (two, (codes[:-1] > 0) | (codes[1:] > 0)), (three, codes[1:-1] > 0)):
        total += np.bincount(grams[mask] >> shift, minlength=DIMS)
    return total


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray  # float32, DIMS
    centroids: np.ndarray  # float32, (k, DIMS)
    owner: np.ndarray  # index into langs of each centroid
    radius: np.ndarray  # least cosine by language

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        langs, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for at in range(0, len(texts), 256):
            found = [(i, c) for i, t in enumerate(texts[at : at + 256], at) if (c := counts(t)) is not None]
            if not found or not self.langs:
                continue
            cosines = weighted(np.stack([c for _, c in found]), self.idf) @ self.centroids.T
            best = np.stack([cosines[:, self.owner == k].max(1) for k in range(len(self.langs))], 1)
            pick = best.argmax(1)
            for (i, _), k, row in zip(found, pick.tolist(), best):
                langs[i], score[i] = self.langs[k], min(1.0, max(0.0, float(row[k])))
                rejected[i] = row[k] < self.radius[k]
        return langs, score, rejected


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(rows, dtype=np.float32) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _kmeans(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; the same rows give the same centroids."""
    mean = rows.mean(0)
    picks = [int((rows @ mean).argmax())]
    near = rows @ rows[picks[0]]
    while len(picks) < min(k, len(rows)):
        picks.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[picks[-1]])
    centroids = rows[picks]
    for _ in range(rounds):
        own = (rows @ centroids.T).argmax(1)
        new = np.stack([rows[own == j].mean(0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    return centroids.astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, mod 5, is 0 (null ids belong to it)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_per_lang: int = SAMPLE_PER_LANG, centroids: int = CENTROIDS) -> Model:
    """Learn from the rows given, of which those with a null label are left out."""
    ship(rows.sparkSession)
    rows = rows.select(named(id_col).cast("string").alias("id"), named(text_col).cast("string").alias("text"),
                       named(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0))
    modulus = 1 << 30
    shares = {lang: min(modulus, modulus * sample_per_lang // n + 1) for lang, n in sizes.items()}
    share = F.element_at(F.from_json(F.lit(json.dumps(shares)), "map<string,long>"), F.col("lang"))
    marked = rows.withColumn("sampled", F.pmod(F.xxhash64(F.lit("langid"), "id", "text"), F.lit(modulus)) < share)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Document frequencies of the partition (lang null), and the sampled rows' counts."""
        df = np.zeros(DIMS, np.int64)
        for batch in batches:
            langs, cells = [], []
            for text, lang, sampled in zip(batch["text"], batch["lang"], batch["sampled"]):
                if (c := counts(text)) is not None:
                    df += c > 0
                    if sampled:
                        langs.append(lang)
                        cells.append(np.log1p(c).astype(np.float16).tobytes())
            if langs:
                yield pd.DataFrame({"lang": langs, "cell": -1, "df": 0, "cells": cells})
        at = np.flatnonzero(df)
        yield pd.DataFrame({"lang": None, "cell": at, "df": df[at], "cells": None})
        give_back()

    learned = marked.select("text", "lang", "sampled").mapInPandas(learn, "lang string, cell int, df long, cells binary")
    pooled = cut(learned.groupBy("lang", "cell", "cells").agg(F.sum("df").alias("df")))
    total, df = sum(sizes.values()), np.zeros(DIMS)
    for r in pooled.where(F.col("lang").isNull()).select("cell", "df").collect():  # DIMS rows at most
        df[r["cell"]] = r["df"]
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    def centres(group: pd.DataFrame) -> pd.DataFrame:
        """A language's centroids as bytes, and its radius. A group is the bounded sample of one language."""
        logs = np.stack([np.frombuffer(x, np.float16) for x in sorted(map(bytes, group["cells"]))]).astype(np.float32)
        unit = logs * idf
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
        own = _kmeans(unit, centroids, ROUNDS)
        radius = RADIUS_SHARE * float(np.quantile((unit @ own.T).max(1), RADIUS_QUANTILE))
        give_back()
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "centroids": [own.tobytes()], "radius": [radius]})

    fitted = pooled.where(F.col("lang").isNotNull()).select("lang", "cells").groupBy("lang").applyInPandas(
        centres, "lang string, centroids binary, radius double").collect()
    fitted.sort(key=lambda r: r["lang"])
    vectors = [np.frombuffer(bytes(r["centroids"]), np.float32).reshape(-1, DIMS) for r in fitted]
    return Model([r["lang"] for r in fitted], idf, np.concatenate(vectors) if vectors else np.zeros((0, DIMS), np.float32),
                 np.repeat(np.arange(len(vectors)), [len(v) for v in vectors]).astype(int), np.array([r["radius"] for r in fitted]))


def _found(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    """``docs`` with the struct ``name`` of lang_pred, score and rejected."""
    ship(docs.sparkSession)
    from pyspark.sql.functions import pandas_udf

    shared = docs.sparkSession.sparkContext.broadcast(model)  # 32 KB for each centroid

    @pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            langs, score, rejected = shared.value.predict(part.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": score, "rejected": rejected})
        give_back()

    return docs.withColumn(name, predict(named(text_col).cast("string")))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected added; columns that had these names are replaced."""
    name = fresh(docs, "found")
    added = ("lang_pred", "score", "rejected")
    kept = [named(c) for c in docs.columns if c.lower() not in added]
    return _found(docs, model, text_col, name).select(*kept, *(F.col(f"{name}.{c}") for c in added))


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose language is known, as they are: those that the classifier rejects go."""
    name = fresh(docs, "found")
    return _found(docs, model, text_col, name).where(~F.col(f"{name}.rejected")).drop(name)
