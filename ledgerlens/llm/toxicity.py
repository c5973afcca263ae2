"""Toxic spans by a linear-chain conditional random field.

Tokens are tagged toxic or not.  Labels come with documents, so tokens of the
training sample are labelled first: a token is toxic in a toxic document if
its word, or a word beginning of three to five letters, occurs in enough
toxic documents and in practically no other.

The field has one weight per hashed token feature (word, beginnings, endings)
for the toxic tag, transition weights between tags and a start weight; it is
fitted by gradient ascent on the likelihood of the tagged texts.  Forward
and backward sums give each token's probability of the toxic tag.  A
document's score rises with its most toxic token and its expected number of
toxic tokens, through a logistic curve fitted on rows the field did not see;
offending spans are runs of tokens above SPAN_AT.

A chain runs over a whole text.  To take the sums of many texts at once, texts
are laid out in segments of SEGMENT tokens; each segment's product of
transitions carries the sums over its borders, so that the result does not
depend on where they lie.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import fold
from ledgerlens.llm.labelled import training_sample

SAMPLE_ROWS = 3_000
FOLDS, HELD_OUT = 4, 2
BITS = 18
SEGMENT = 48
SPAN_AT = 0.5
CACHE = 200_000                  # words remembered, each of at most CACHED_CHARS characters
CACHED_CHARS = 40
_EDGE = "\"'.,;:!?()[]{}<>*#$%&|-_=+/\\~`“”„«»…–—"


def normal(token: str) -> str:
    return token.strip(_EDGE).lower()


def parts(word: str) -> list[str]:
    """Features of a token: word, beginnings, endings."""
    if not word:
        return ["-"]
    out = ["w" + word]
    out += [f"p{n}{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n]
    out += [f"s{n}{word[-n:]}" for n in (3, 4) if len(word) > n]
    return out


def _numbers(word: str) -> list[int]:
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for p in parts(word)]


def toxic_parts(words: list[set[str]], y: np.ndarray, copies: list) -> set[str]:
    """Words (w...) and beginnings (p...) that mark toxic documents.

    At least max(4, 0.4 %) toxic documents have them, and of the documents that
    have them at least 97 % are toxic.  Documents with one entry in ``copies``
    count as one in their class.
    """
    toxic: dict[str, set] = {}
    other: dict[str, set] = {}
    for ws, label, copy in zip(words, y, copies):
        for p in {p for w in ws for p in parts(w) if p[0] == "w" or p[:2] in ("p4", "p5", "p6")}:
            (toxic if label else other).setdefault(p, set()).add(copy)
    least = max(4, 0.004 * int((y == 1).sum()))
    return {p for p, h in toxic.items() if len(h) >= least and len(other.get(p, ())) <= 0.03 * len(h)}


def _segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of tokens in a (segments x SEGMENT) grid of documents of ``sizes``
    tokens: (segment, column) per token."""
    within = np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else np.zeros(0, np.int64)
    count = -(-sizes // SEGMENT)
    first = np.concatenate(([0], np.cumsum(count)[:-1])) if len(sizes) else np.zeros(0, np.int64)
    return np.repeat(first, sizes) + within // SEGMENT, within % SEGMENT


@dataclass
class Chain:
    """Two-tag chain: emission weights by feature, transition and start weights."""
    weights: np.ndarray
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def marginals(self, emission: np.ndarray, sizes: np.ndarray, pairs: bool = False):
        """P(toxic) per token by forward-backward, text after text of ``sizes``
        tokens; with ``pairs`` also the log-likelihood normaliser, the expected
        transition counts and P(toxic) of the texts' first tokens."""
        sizes = np.asarray(sizes)[np.asarray(sizes) > 0]
        seg, col = _segments(sizes)
        count = -(-sizes // SEGMENT)
        n = int(count.sum())
        begin = np.concatenate(([0], np.cumsum(count)[:-1])) if len(sizes) else np.zeros(0, np.int64)
        first = np.zeros(n, dtype=bool)
        first[begin] = True
        grid = np.zeros((SEGMENT, n))
        there = np.zeros((SEGMENT, n), dtype=bool)
        grid[col, seg] = emission
        there[col, seg] = True
        e = np.exp(np.clip(grid, -30, 30))
        a, s = np.exp(self.trans), np.exp(self.start)
        # Step into a segment: from the one before, or the start of its text.
        into = (np.where(first, s[0], a[0, 0]), np.where(first, s[1], a[0, 1]) * e[0],
                np.where(first, s[0], a[1, 0]), np.where(first, s[1], a[1, 1]) * e[0])

        # Product of a segment's steps; past the end of a text they change nothing.
        m = np.stack(into)
        for t in range(1, SEGMENT):
            m00, m01, m10, m11 = m
            step = np.stack([m00 * a[0, 0] + m01 * a[1, 0], (m00 * a[0, 1] + m01 * a[1, 1]) * e[t],
                             m10 * a[0, 0] + m11 * a[1, 0], (m10 * a[0, 1] + m11 * a[1, 1]) * e[t]])
            m = np.where(there[t], step, m)
            if t % 6 == 0:                               # a step changes it by some e^40 at most
                m /= m.sum(axis=0)
        m00, m01, m10, m11 = m / m.sum(axis=0)

        # Sums before and behind every segment, carried along the texts side by side.
        v0, v1, b0, b1 = np.ones(n), np.zeros(n), np.ones(n), np.ones(n)
        longest = int(count.max()) if n else 0
        reach = [begin[count > k] + k for k in range(1, longest)]
        for here in reach:
            from_ = here - 1
            x0 = v0[from_] * m00[from_] + v1[from_] * m10[from_]
            x1 = v0[from_] * m01[from_] + v1[from_] * m11[from_]
            v0[here], v1[here] = x0 / (x0 + x1), x1 / (x0 + x1)
        for here in reversed(reach):
            x0, x1 = m00[here] * b0[here] + m01[here] * b1[here], m10[here] * b0[here] + m11[here] * b1[here]
            b0[here - 1], b1[here - 1] = x0 / (x0 + x1), x1 / (x0 + x1)

        f0, f1 = np.empty((SEGMENT, n)), np.empty((SEGMENT, n))
        log_z = 0.0
        p0, p1 = v0 * into[0] + v1 * into[2], v0 * into[1] + v1 * into[3]
        for t in range(SEGMENT):
            if t:
                p0 = f0[t - 1] * a[0, 0] + f1[t - 1] * a[1, 0]
                p1 = (f0[t - 1] * a[0, 1] + f1[t - 1] * a[1, 1]) * e[t]
            total = p0 + p1
            f0[t], f1[t] = p0 / total, p1 / total
            if pairs:
                log_z += np.log(total[there[t]]).sum()
        toxic = np.zeros((SEGMENT, n))
        moves = np.zeros((2, 2))
        for t in range(SEGMENT - 1, -1, -1):
            here = there[t]
            toxic[t] = f1[t] * b1 / (f0[t] * b0 + f1[t] * b1)
            if pairs:
                if t:
                    moved, before0, before1 = here, f0[t - 1], f1[t - 1]
                else:
                    moved, before0, before1 = here & ~first, v0, v1
                w = b1 * e[t]
                q = np.stack([before0 * a[0, 0] * b0, before0 * a[0, 1] * w, before1 * a[1, 0] * b0, before1 * a[1, 1] * w])[:, moved]
                moves += (q / q.sum(axis=0)).sum(axis=1).reshape(2, 2)
            if t:
                c0, c1 = a[0, 0] * b0 + a[0, 1] * e[t] * b1, a[1, 0] * b0 + a[1, 1] * e[t] * b1
                scale = c0 + c1
                b0, b1 = np.where(here, c0 / scale, b0), np.where(here, c1 / scale, b1)
        return (toxic[col, seg], log_z, moves, toxic[0, begin]) if pairs else toxic[col, seg]


@dataclass
class Model:
    chain: Chain
    slope: np.ndarray = field(default_factory=lambda: np.array([8.0, 1.0, -4.0]))   # of top, log(1 + expected), constant
    known: dict[str, float] = field(default_factory=dict)

    def emissions(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = float(self.chain.weights[_numbers(normal(t))].sum())
        found = np.fromiter(map(known.__getitem__, tokens), dtype=np.float64, count=len(tokens))
        for t in [t for t in known if len(t) > CACHED_CHARS]:           # few and long: not kept
            del known[t]
        return found

    def token_marginals(self, texts: list[str | None], block: int = 200_000) -> Iterator[np.ndarray]:
        """P(toxic) of every token, text by text."""
        group: list[list[str]] = []

        def flush():
            sizes = np.array([len(g) for g in group], dtype=np.int64)
            p = self.chain.marginals(self.emissions([t for g in group for t in g]), sizes)
            yield from np.split(p, np.cumsum(sizes)[:-1])

        held = 0
        for text in texts:
            group.append((text or "").split())
            held += len(group[-1])
            if held > block:
                yield from flush()
                group, held = [], 0
        if group:
            yield from flush()

    def tagged(self, texts: list[str | None], at: float = SPAN_AT) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and (start, end) character offsets of runs of toxic tokens,
        from one walk over the texts."""
        x, spans = [], []
        for text, p in zip(texts, self.token_marginals(texts)):
            x.append(_summary(p))
            spans.append(_runs(text, p >= at) if len(p) and p.max() >= at else [])
        z = np.array(x).reshape(-1, 3) @ self.slope
        return 1 / (1 + np.exp(-np.clip(z, -35, 35))), spans

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.tagged(texts)[0]

    def spans(self, text: str | None, at: float = SPAN_AT) -> list[tuple[int, int]]:
        return self.tagged([text], at)[1][0]


def _runs(text: str, marked: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    last = -2
    for i, (start, end) in enumerate(_word_places(text)):
        if marked[i]:
            if last == i - 1:
                out[-1][1] = end
            else:
                out.append([start, end])
            last = i
    return [(a, b) for a, b in out]


def _word_places(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for w in text.split():
        at = text.index(w, at)
        yield at, at + len(w)
        at += len(w)


def _summary(p: np.ndarray) -> tuple[float, float, float]:
    return (float(p.max()), float(np.log1p(p[p > 0.05].sum())), 1.0) if len(p) else (0.0, 0.0, 1.0)


def fit_chain(texts: list[str], y: np.ndarray, rounds: int = 30, rate: float = 0.3, ridge: float = 1e-5) -> Chain:
    """Field fitted on the tagged texts; texts of the same words are copies."""
    tokens = [[normal(t) for t in (x or "").split()] for x in texts]
    marks = toxic_parts([set(t) for t in tokens], y, [hashlib.blake2b(" ".join(t).encode("utf-8", "surrogatepass")).digest() for t in tokens])
    flat = [t for ts in tokens for t in ts]
    words = sorted(set(flat))
    place = {w: i for i, w in enumerate(words)}
    at = np.fromiter((place[t] for t in flat), dtype=np.int64, count=len(flat))
    toxic_word = np.array([any(p in marks for p in parts(w)) for w in words] or [False])
    owner = np.repeat(np.asarray(y) == 1, [len(t) for t in tokens])
    tags = toxic_word[at] & owner if len(at) else np.zeros(0, bool)
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    feats = [_numbers(w) for w in words]
    row = np.repeat(np.arange(len(words)), [len(f) for f in feats])
    cols = np.array([c for f in feats for c in f], dtype=np.int64)
    chain = Chain(np.zeros(1 << BITS), np.zeros((2, 2)), np.array([0.0, -4.0]))
    if not tags.any():
        chain.start[1] = -8.0
        chain.trans[:, 1] = -8.0
        return chain
    # Counts of the given tags.
    starts = np.zeros(len(at), bool)
    starts[np.cumsum(sizes[sizes > 0])[:-1]] = True
    starts[:1] = True
    same = ~starts
    given_moves = np.zeros((2, 2))
    np.add.at(given_moves, (tags[:-1][same[1:]].astype(int), tags[1:][same[1:]].astype(int)), 1)
    given_start = float(tags[starts].sum())
    given = np.bincount(at, tags, minlength=len(words))
    step = np.zeros(1 << BITS) + 1e-8
    steps_t, steps_s = np.zeros((2, 2)) + 1e-8, 1e-8
    for _ in range(rounds):
        word_score = np.bincount(row, chain.weights[cols], minlength=len(words))
        p, _, moves, first = chain.marginals(word_score[at], sizes, pairs=True)
        miss = given - np.bincount(at, p, minlength=len(words))
        g = np.bincount(cols, miss[row], minlength=1 << BITS) - ridge * len(at) * chain.weights / 100
        step += g * g
        chain.weights += rate * g / np.sqrt(step)
        gt = given_moves - moves
        gt[:, 0] = 0.0                                   # tag 0 is the reference
        steps_t += gt * gt
        chain.trans += rate * gt / np.sqrt(steps_t)
        gs = given_start - float(first.sum())
        steps_s += gs * gs
        chain.start[1] += rate * gs / np.sqrt(steps_s)
    return chain


def fit_texts(texts: list[str], y: np.ndarray) -> Model:
    """Field and score curve; without toxic and other rows, a constant model."""
    y = np.asarray(y)
    if len(np.unique(y)) < 2:
        return Model(fit_chain([], np.zeros(0)), np.array([0.0, 0.0, 4.0 if len(y) and y[0] else -4.0]))
    part = np.arange(len(y)) % 4 == 0
    model = Model(fit_chain([t for t, x in zip(texts, part) if not x], y[~part]))
    if len(np.unique(y[part])) == 2:
        x = np.array([_summary(p) for p in model.token_marginals([t for t, u in zip(texts, part) if u])])
        model.slope = _logistic(x, y[part])
    whole = fit_chain(texts, y)
    return Model(whole, model.slope)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    theta, prior = np.array([8.0, 1.0, -4.0]), np.array([8.0, 1.0, -4.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        gradient = x.T @ (p - y) + 0.05 * (theta - prior)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.05 * np.eye(3), gradient)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return theta


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int = SAMPLE_ROWS,
        doc_id: str = "doc_id", text: str = "text") -> Model:
    """Model fitted by one task on at most ``rows`` labelled documents."""
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("doc_id", key=lambda ids: ids.map(lambda i: (len(i), i)))
        m = fit_texts(list(sample["text"]), sample["label"].to_numpy(dtype=np.int64))
        used = np.nonzero(m.chain.weights)[0]
        return pd.DataFrame([{"places": used.astype(np.int32).tobytes(), "weights": m.chain.weights[used].tobytes(),
                              "rest": [*m.chain.trans.ravel(), *m.chain.start, *m.slope]}])

    sample = training_sample(docs, labels, label, allowed, rows, doc_id, text)
    got = (sample.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "label")
           .groupBy().applyInPandas(run, "places binary, weights binary, rest array<double>").first())
    if got is None:                                     # no labelled row at all
        return fit_texts([], np.zeros(0))
    weights = np.zeros(1 << BITS)
    weights[np.frombuffer(got["places"], dtype=np.int32)] = np.frombuffer(got["weights"])
    rest = np.array(got["rest"])
    return Model(Chain(weights, rest[:4].reshape(2, 2), rest[4:6]), rest[6:])


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS,
                    threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) per row of ``docs``.

    ``spans`` holds (start, end) code point offsets of offending words.
    Fitted on labelled rows outside fold HELD_OUT only.  Empty and null texts
    have no tokens: the lowest score, no spans; repeated rows each get their
    row; without labelled rows of both classes every score is the same; an
    empty table gives no rows; other columns are ignored.
    """
    model = fit(docs, labels, label, fold(F.col("doc_id"), FOLDS) != HELD_OUT, rows, doc_id, text)

    @F.pandas_udf("struct<score:double,spans:array<struct<start:bigint,end:bigint>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            scores, spans = model.tagged(list(texts))
            yield pd.DataFrame({"score": scores, "spans": [[{"start": a, "end": b} for a, b in found] for found in spans]})

    return (docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("r"))
            .select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "r.score",
                    (F.col("r.score") >= threshold).cast("int").alias("predicted"), "r.spans"))
