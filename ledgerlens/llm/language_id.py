"""Language identification by hierarchical discrimination.

A text is the set of hashed byte n-grams of its letters (A-Z lower-cased, what
is no letter a blank).  Its language family is predicted first, by naive Bayes
over the n-grams; within the family one-versus-one linear support vector
machines, a machine per pair of its languages, vote for the language.

Families are learned with the rest: languages are merged by average linkage of
the cosines of their profiles while these lie nearer to the closest pair's cosine
than to the mean of all pairs, up to MAX_FAMILY languages.

Fitting takes at most ROWS_PER_LANG documents a language, of each at most
GRAMS_PER_ROW n-grams (those of smallest hash).  Profiles are counted by one
task a language and machines fitted by one task a pair; the model is 2^BITS
numbers per family and per pair, so it grows with the languages, not with the
documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed, fold

ROWS_PER_LANG = 1_000
GRAMS_PER_ROW = 8_192
MAX_FAMILY = 12
BITS = 16
ORDERS = (2, 3, 4)
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_PIECE = 1 << 20                 # bytes hashed at a time
_LETTERS = bytes(32 if c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def grams(text: str) -> np.ndarray:
    """Distinct hashed n-grams of a whole text, ascending."""
    b = b" " + (text or "").encode("utf-8", "surrogatepass").lower().translate(_LETTERS) + b" "
    seen = np.zeros(1 << BITS, dtype=bool)
    if len(b) == 2:
        return np.zeros(0, dtype=np.int64)
    for start in range(0, len(b), _PIECE):
        data = np.frombuffer(b[start:start + _PIECE + max(ORDERS) - 1], dtype=np.uint8).astype(np.uint64)
        h = data.copy()
        for n in range(2, min(len(data), max(ORDERS)) + 1):
            h = (h[:-1] ^ data[n - 1:]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            if n in ORDERS:
                seen[(h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    families: list[list[int]] = field(default_factory=list)              # indices of languages
    likelihoods: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << BITS), np.float32))   # log, a row a family
    machines: dict[tuple[int, int], tuple[np.ndarray, float]] = field(default_factory=dict)         # positive: the first

    def predict(self, text: str) -> tuple[str, float]:
        """Language and score (its family's share times its mean share of the
        pairs it takes part in)."""
        if not self.languages:
            return UNKNOWN, 0.0
        at = grams(text)
        n = max(1, len(at))
        fits = self.likelihoods[:, at].sum(axis=1, dtype=np.float64) / np.sqrt(n)   # n-grams of a text are no independent draws
        share = np.exp(fits - fits.max())
        share /= share.sum()
        best = int(share.argmax())
        members = self.families[best]
        votes, shares = np.zeros(len(members)), np.zeros(len(members))
        for i, j in combinations(range(len(members)), 2):
            w, bias = self.machines[members[i], members[j]]
            p = 1 / (1 + np.exp(-np.clip(2 * (w[at].sum(dtype=np.float64) / np.sqrt(n) + bias), -35, 35)))
            votes[i if p >= 0.5 else j] += 1
            shares[i] += p
            shares[j] += 1 - p
        win = int(np.lexsort((-shares, -votes))[0])                       # ties by share, then by name
        within = shares[win] / (len(members) - 1) if len(members) > 1 else 1.0
        return self.languages[members[win]], float(min(1.0, max(0.0, share[best] * within)))


def families(profiles: np.ndarray, largest: int = MAX_FAMILY) -> list[list[int]]:
    """Groups of rows by average linkage of their cosines, merged while the
    closest two groups are nearer to the closest pair of rows than to the
    average of all pairs."""
    unit = profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)
    near = unit @ unit.T
    groups = [[i] for i in range(len(unit))]
    if len(unit) < 3:
        return groups
    apart = near[~np.eye(len(unit), dtype=bool)]
    usual = (apart.mean() + apart.max()) / 2
    while True:
        pairs = [(near[np.ix_(a, b)].mean(), i, j) for (i, a), (j, b) in combinations(enumerate(groups), 2) if len(a) + len(b) <= largest]
        if not pairs:
            return groups
        closeness, i, j = max(pairs, key=lambda x: (x[0], -x[1], -x[2]))
        if closeness <= usual:
            return groups
        groups[i] = sorted(groups[i] + groups.pop(j))


def pair_machine(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, passes: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Hinge-loss machine over unit-length indicator rows; y is 1 or -1.
    Classes weigh alike."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    upper = np.where(y > 0, cost * len(y) / max(1, 2 * (y > 0).sum()), cost * len(y) / max(1, 2 * (y < 0).sum()))
    scale = np.array([1 / np.sqrt(max(1, len(r))) for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]].sum() * scale[i] + bias) - 1.0
            new = min(max(alpha[i] - slope / 2.0, 0.0), upper[i])          # a row and its constant have length 2
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * scale[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def sample(docs: DataFrame, allowed: Column, rows: int, text: str, lang: str) -> DataFrame:
    """(lang, h, text): at most ``rows`` different texts of every language, those
    of smallest hash, among the documents that ``allowed`` admits."""
    known = (docs.where(allowed & F.col(lang).isNotNull() & F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
             .select(F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text")))
    first = Window.partitionBy("lang").orderBy("h")
    chosen = (known.select("lang", "h").distinct().withColumn("nr", F.row_number().over(first))
              .where(F.col("nr") <= rows).select("lang", "h"))
    # The broadcast side has at most ``rows`` short rows a language.
    return known.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, allowed: Column, rows: int = ROWS_PER_LANG, text: str = "text", lang: str = "lang") -> Model:
    """Model of the languages named by the documents that ``allowed`` admits."""
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [grams(t) for t in b["text"]]
            yield pd.DataFrame({"lang": b["lang"], "h": b["h"], "grams": [g[np.argsort(g * 40503 % 65521, kind="stable")[:GRAMS_PER_ROW]]
                                                                          .astype(np.uint16).tobytes() for g in found]})

    def profile(of: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(1 << BITS, dtype=np.float32)
        for g in of["grams"]:
            n[np.frombuffer(g, np.uint16)] += 1
        return pd.DataFrame([{"lang": of["lang"].iat[0], "rows": len(of), "n": n.tobytes()}])

    kept = checkpointed(sample(docs, allowed, rows, text, lang).mapInPandas(sets, "lang string, h bigint, grams binary"))
    found = sorted(kept.groupBy("lang").applyInPandas(profile, "lang string, rows bigint, n binary").collect())   # one row a language
    names = [r["lang"] for r in found]
    if not names:
        return Model()
    counts = np.stack([np.frombuffer(r["n"], np.float32) for r in found])
    shares = counts / np.array([[r["rows"]] for r in found], dtype=np.float32)
    groups = families(shares)
    # Languages of a family weigh alike, however many documents each has.
    smoothed = np.stack([shares[g].mean(axis=0) for g in groups]) + 0.5 / max(1, rows)
    model = Model(names, groups, np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32))

    pairs = [(names[i], names[j]) for g in groups for i, j in combinations(g, 2)]
    if pairs:
        spark = docs.sparkSession
        sides = spark.createDataFrame([(a if s > 0 else b, a, b, s) for a, b in pairs for s in (1, -1)], "lang string, a string, b string, y int")

        def learn(of: pd.DataFrame) -> pd.DataFrame:
            of = of.sort_values(["y", "h"])
            w, bias = pair_machine([np.frombuffer(g, np.uint16).astype(np.int64) for g in of["grams"]], of["y"].to_numpy(dtype=float))
            return pd.DataFrame([{"a": of["a"].iat[0], "b": of["b"].iat[0], "w": w.astype(np.float32).tobytes(), "bias": bias}])

        at = {name: i for i, name in enumerate(names)}
        for r in (kept.join(F.broadcast(sides), "lang").groupBy("a", "b")                 # two languages' samples
                  .applyInPandas(learn, "a string, b string, w binary, bias double").toLocalIterator()):
            model.machines[at[r["a"]], at[r["b"]]] = np.frombuffer(r["w"], np.float32), r["bias"]
    return model


def languages(docs: DataFrame, rows: int = ROWS_PER_LANG, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs``.

    Learned from the texts and languages of documents outside the held-out fold
    only.  A null text and one without a letter is ``und`` with score 0, as is
    every row if nothing could be learned; rows without a language teach
    nothing and are predicted like others; with one known language that is the
    answer.  Repeated rows each get their row; an empty table gives no rows;
    other columns are ignored.
    """
    model = fit(docs, fold(F.col(doc_id), FOLDS) != HELD_OUT, rows, text, lang)

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return (docs.select(F.col(doc_id).alias("doc_id"), lettered.alias("lettered"), predicted(F.col(text)).alias("found"))
            .select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
                    F.when(F.col("lettered"), F.col("found.lang")).otherwise(UNKNOWN).alias("lang_pred"),
                    F.when(F.col("lettered"), F.col("found.score")).otherwise(0.0).alias("score")))
