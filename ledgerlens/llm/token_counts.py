"""Token counts of whole texts, huge ones by overlap resynchronisation.

The tokenizer first cuts a text into pieces (words with the blank before them,
runs of marks, white space) from left to right without looking back, then
encodes each piece on its own.

Texts up to ``chunk`` characters: they are cut at blanks that stand between
two other characters, where a piece always begins; the counts of the strings
in between are looked up in a bounded cache and encoded by the library when
missing.

Longer texts: overlapping chunks are encoded with offsets and spliced at a
common stable boundary.  A piece boundary that both chunks have is stable if
it lies far enough from the end of the earlier chunk: from a boundary on,
pieces depend only on what follows, so the later chunk goes on exactly as the
whole text would; and a piece that ended before the chunk's last MARGIN
characters, not within its final white space, ended in full sight.  Without
such a boundary in the overlap, the overlap is doubled.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 15          # characters encoded at once
OVERLAP = 1 << 10
CACHE = 600_000          # strings whose counts a worker remembers
LIMIT = 512

_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")


class Counter:
    """Counts tokens as the library does for ``path``, for byte-level tokenizers
    that neither normalise nor add a leading blank."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        definition = json.loads(self.tokenizer.to_str())
        pre = definition["pre_tokenizer"] or {}
        # What the cuts at blanks and the splicing rest on.
        self.sliceable = (definition["normalizer"] is None and pre.get("type") == "ByteLevel"
                          and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                          and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in definition["added_tokens"]))
        specials = [len(t["content"]) for t in definition["added_tokens"]]
        self.margin = max([4, *specials])
        self.chunk, self.overlap, self.limit = chunk, max(overlap, 2 * self.margin), cache
        self.heads: dict[str, int] = {}            # tokens of a text's first string
        self.known: dict[str, int] = {}            # tokens of a string with a blank before it

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _counted(self, text: str) -> int:
        parts = text.split(" ")
        try:                                       # only strings cut at safe blanks are known
            return self.heads[parts[0]] + sum(map(self.known.__getitem__, parts[1:]))
        except KeyError:
            pass
        if any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
            parts = _SAFE_BLANK.split(text)
        total = 0
        for known, strings, blank in ((self.heads, parts[:1], ""), (self.known, parts[1:], " ")):
            missing = [s for s in dict.fromkeys(strings) if s not in known]
            if len(known) + len(missing) > self.limit:
                known.clear()
                missing = list(dict.fromkeys(strings))
            new = dict(zip(missing, self._encode([blank + s for s in missing])))
            total += sum(known[s] if s in known else new[s] for s in strings)
            known.update((s, n) for s, n in new.items() if s and not s[0].isspace() and not s[-1].isspace())
        return total

    def count(self, texts: list[str | None]) -> list[int]:
        if not self.sliceable:
            return [self._encode([t or ""])[0] for t in texts]
        return [self.spliced(t) if t and len(t) > self.chunk else self._counted(t or "") for t in texts]

    def _boundaries(self, text: str, start: int, end: int) -> dict[int, int]:
        """Piece boundary in the text -> tokens of text[start:end] before it."""
        e = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        found, last = {}, object()
        for i, (word, (a, _)) in enumerate(zip(e.word_ids, e.offsets)):
            if word != last or word is None:      # special tokens have no word
                found[start + a] = i
                last = word
        found[end] = len(e)
        return found

    def spliced(self, text: str) -> int:
        """Tokens of a long text from overlapping chunks."""
        start, end, total = 0, min(self.chunk, len(text)), 0
        here = self._boundaries(text, start, end)
        since = 0                                  # tokens of this chunk counted already
        while end < len(text):
            overlap = self.overlap
            # Boundaries up to here are in full sight of this chunk's end.
            sight = min(end - self.margin, start + len(text[start:end].rstrip()) - self.margin)
            while True:
                begin = max(start, end - overlap)
                stop = min(len(text), begin + max(self.chunk, 2 * overlap))
                there = self._boundaries(text, begin, stop)
                common = [p for p in here if begin + self.margin < p <= sight and p in there]
                if common:
                    at = max(common)
                    total += here[at] - since
                    start, end, here, since = begin, stop, there, there[at]
                    break
                if begin == start:                 # no boundary at all: a wider chunk
                    end = stop
                    here, there = there, None
                    if end == len(text):
                        break
                    sight = min(end - self.margin, start + len(text[start:end].rstrip()) - self.margin)
                overlap *= 2
        return total + here[len(text)] - since


@lru_cache(maxsize=4)
def _counter(path: str, chunk: int, overlap: int) -> Counter:
    """One per Python worker, so its cache serves all of the worker's tasks."""
    return Counter(path, chunk, overlap)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    ``path`` names the tokenizer file on every machine.  A null text counts as
    empty: 0 tokens; repeated rows each get their row; an empty table gives no
    rows; other columns are ignored.
    """
    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path, chunk, overlap)
        for texts in batches:
            yield pd.Series(counter.count(list(texts)), dtype="int64")

    return (docs.select(F.col(doc_id).alias("doc_id"),
                        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint").alias("n_bytes"),
                        count(F.col(text)).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
