"""Token counts without token ids.

A pre-token is a run of spaces with the other characters up to the next space. The model has no
piece in which a space mark follows another character, so no merge spans the place between two
pre-tokens and the count of a text is the sum over its pre-tokens. A batch of documents becomes
pre-token frequencies per document; the batch's distinct pre-tokens not met before are counted
once, the counts are joined to the frequencies by pre-token and summed by document.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from cohortlane.llm.frames import per_text

#: Fixed value: the mark that the model writes for a space.
SPACE_MARK = "▁"
PRE_TOKEN = re.compile(" +[^ ]*")
MAX_HELD = 300_000


class PieceCounter:
    """Counts of a sentencepiece BPE model, kept by pre-token."""

    def __init__(self, path: str, max_held: int = MAX_HELD):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.model.get_piece_size()):
            if SPACE_MARK in self.model.id_to_piece(i).lstrip(SPACE_MARK):
                raise ValueError("a piece of this model spans the end of a pre-token")
        self.max_held = max_held
        #: A last single space; alone it would be the empty text, which has no pieces.
        self.last_space = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.held: dict[str, int] = {}
        self.before: dict[str, int] = {}

    def count_new(self, pre_tokens: list[str]) -> None:
        """Count pieces once per distinct pre-token; the model itself adds the leading space."""
        if len(self.held) + len(pre_tokens) > self.max_held:
            self.before, self.held = self.held, {}
        again = [p for p in pre_tokens if p in self.before]
        self.held.update((p, self.before[p]) for p in again)
        new = [p for p in pre_tokens if p not in self.before]
        ids = self.model.encode([p[1:] for p in new], num_threads=1)
        self.held.update(zip(new, map(len, ids)))
        self.held[" "] = self.last_space

    def totals(self, texts: list[str]) -> list[int]:
        frequencies = [Counter(pre_tokens(text)) for text in texts]
        distinct = set().union(*frequencies)
        counts: dict[str, int] = {}
        missing = [p for p in distinct if p not in self.held]
        for i in range(0, len(missing), self.max_held):
            part = missing[i : i + self.max_held]
            kept = self.held
            self.count_new(part)
            if kept is not self.held:  # a new generation: this batch still needs the one before
                counts.update(kept)
        counts = {**counts, **self.held} if counts else self.held
        sizes = np.fromiter(map(len, frequencies), np.int64, len(frequencies))
        times = np.fromiter(chain.from_iterable(f.values() for f in frequencies), np.int64, int(sizes.sum()))
        pieces = np.fromiter(map(counts.__getitem__, chain.from_iterable(frequencies)), np.int64, int(sizes.sum()))
        sums = np.concatenate([[0], np.cumsum(times * pieces)])
        ends = np.cumsum(sizes)
        return (sums[ends] - sums[ends - sizes]).tolist()


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens, each with its leading spaces; the first gets the model's own."""
    if not text:
        return []
    if SPACE_MARK in text:
        text = text.replace(SPACE_MARK, " ")
    parts = text.split(" ")
    if all(parts):
        return [" " + part for part in parts]
    return PRE_TOKEN.findall(" " + text)


@lru_cache(maxsize=4)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(df: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text", portion: int = 256) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens``, ``over_limit`` per row.

    Null and empty texts have no bytes and no tokens. Every row stands for itself: repeated rows
    and equal keys give as many rows, an empty table gives none, other columns are not read.
    ``portion`` texts at a time are held as frequencies.
    """
    add = StructType([StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def factory():
        counter = piece_counter(path)

        def compute(texts: list) -> dict:
            whole = [t or "" for t in texts]
            totals = list(chain.from_iterable(counter.totals(whole[i : i + portion]) for i in range(0, len(whole), portion)))
            return {"n_bytes": [len(t.encode("utf-8")) for t in whole], "n_tokens": totals, "over_limit": [n > limit for n in totals]}

        return compute

    return per_text(df, [key], text, add, factory)
