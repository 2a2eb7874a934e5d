"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn by hashing its code point. A letter trigram is
the product of its letters' vectors, each rotated by its place; a text is the sum of its trigrams'
vectors weighted by their counts, and a language's prototype is the sum over its training documents.
A document gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.repeats import chunks
from folioflow.llm.shared import small_batches

DIMENSIONS = 512
UNKNOWN = "und"
MASK = 0xFFFFFFFFFFFFFFFF


class Letters:
    """Vectors of letters by code point, made when first seen; index 0 is the gap between words."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 1):
        self.dimensions, self.seed = dimensions, seed
        self.index = np.full(0x110000, -1, np.int32)
        self.tables = [np.zeros((0, dimensions), np.int8)] * 3
        self.points: list[int] = []
        self._add([0x20])

    def _add(self, points: list[int]) -> None:
        words = np.arange(self.dimensions // 64, dtype=np.uint64)
        rows = []
        for p in points:
            self.index[p] = len(self.points)
            self.points.append(p)
            z = words + np.uint64((p * 0x9E3779B97F4A7C15 + self.seed * 0xD1B54A32D192ED03) & MASK)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
            rows.append(np.unpackbits(z.astype("<u8").view(np.uint8)).astype(np.int8) * 2 - 1)
        new = np.array(rows, np.int8).reshape(-1, self.dimensions)
        self.tables = [np.concatenate([t, np.roll(new, k, axis=1)]) for k, t in zip((2, 1, 0), self.tables)]

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigram codes and their counts; none without a letter."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        at = self.index[points]
        if (at < 0).any():
            fresh = [int(p) for p in np.unique(points[at < 0])]
            self._add([p for p in fresh if chr(p).isalpha()])
            for p in fresh:
                if self.index[p] < 0:
                    self.index[p] = 0
            at = self.index[points]
        at = np.concatenate([[0], at, [0]])
        at = at[(at > 0) | (np.concatenate([[1], at[:-1]]) > 0)].astype(np.int64)
        if len(at) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.unique((at[:-2] << 40) | (at[1:-1] << 20) | at[2:], return_counts=True)

    def vector(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        low = (1 << 20) - 1
        out = np.zeros(self.dimensions, np.float32)
        for k in range(0, len(codes), 4096):
            c = codes[k : k + 4096]
            bound = self.tables[0][c >> 40] * self.tables[1][(c >> 20) & low] * self.tables[2][c & low]
            out += weights[k : k + 4096].astype(np.float32) @ bound.astype(np.float32)
        return out


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def prototypes(docs: DataFrame, text: str = "text", label: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes by label, from every row with text and label. Partitions bundle their own
    rows, so what is shuffled and collected is languages times dimensions."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, sums = Letters(), {}
        for batch in chunks(batches, "text"):
            for name, some in batch.groupby("label"):
                pairs = [(c, n / n.sum()) for c, n in map(letters.trigrams, some["text"]) if len(c)]
                if not pairs:
                    continue
                codes, where = np.unique(np.concatenate([c for c, _ in pairs]), return_inverse=True)
                v = letters.vector(codes, np.bincount(where, np.concatenate([n for _, n in pairs])))
                sums[name] = sums.get(name, 0) + v.astype(np.float64)
        for name, v in sums.items():
            yield pd.DataFrame({"label": name, "i": np.arange(len(v)), "v": v})

    rows = small_batches(docs).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).filter("text IS NOT NULL AND label IS NOT NULL")
    sums = rows.mapInPandas(bundle, "label string, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    found: dict[str, np.ndarray] = {}
    for r in sums:
        found.setdefault(r["label"], np.zeros(DIMENSIONS))[r["i"]] = r["v"]
    return {k: v / (np.linalg.norm(v) or 1.0) for k, v in sorted(found.items())}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", languages: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its cosine, from the text alone. ``und`` and 0 for a
    text that is null or has no letter, or without any profile; equal cosines go to the first name. Texts of any length count
    whole; columns of ``docs`` by the two new names, or _p, are replaced, all others stay."""
    names = list(profiles)
    matrix = np.array([profiles[k] for k in names], np.float32).reshape(-1, DIMENSIONS)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = Letters()
        for batch in batches:
            out = []
            for x in batch:
                codes, counts = letters.trigrams(x)
                if not len(codes) or not names:
                    out.append((UNKNOWN, 0.0))
                    continue
                v = letters.vector(codes, counts)
                cosines = matrix @ v / (np.linalg.norm(v) or 1.0)
                k = int(cosines.argmax())
                out.append((names[k], float(min(1.0, max(0.0, cosines[k])))))
            yield pd.DataFrame(out, columns=["lang", "score"])

    return small_batches(docs).withColumn("_p", predict(F.col(text))).withColumn(languages, F.col("_p.lang")).withColumn(score, F.col("_p.score")).drop("_p")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = prototypes(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
