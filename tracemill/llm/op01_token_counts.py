"""Edit-aware token counts: a segment tree over each document's pre-tokens.

Leaves hold blocks of pre-tokens with their token counts; inner
nodes hold sums of characters and tokens. An edit finds its place by
descending the character sums, re-encodes from the last pre-token that
could be affected up to the first old boundary that the new splitting meets again,
and updates the sums above the touched leaves. The counts of all other pre-tokens are kept, those of the touched leaves
too. Leaves take up what is inserted until one holds FULLEST blocks; only then is the tree laid out anew, from the kept counts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import BoundedCache, batches

BLOCK = 256
#: Blocks' worth of pre-tokens that a leaf may come to hold by insertions.
FULLEST = 4
#: How far past its end the splitting pattern may look before it fixes a pre-token: a contraction's letters or the character after white space.
LOOKAHEAD = 3


class Counter:
    def __init__(self, vocabulary: str, pattern: str):
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.count = BoundedCache(lambda piece: len(encoding.encode_ordinary(piece)))

    def counts(self, pieces: list[str]) -> list[int]:
        return list(map(self.count.__getitem__, pieces))


@cache
def counter(vocabulary: str, pattern: str) -> Counter:
    """One per worker process."""
    return Counter(vocabulary, pattern)


class CountTree:
    """Blocks of pre-tokens under a binary tree of (characters, tokens) sums."""

    def __init__(self, text: str, tool: Counter):
        self.tool, self.encoded = tool, 0
        pieces = tool.split.findall(text)
        self._lay_out(pieces, tool.counts(pieces))

    def _lay_out(self, pieces: list[str], counts: list[int]) -> None:
        starts = range(0, max(len(pieces), 1), BLOCK)
        self.blocks, self.counts = [pieces[k : k + BLOCK] for k in starts], [counts[k : k + BLOCK] for k in starts]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(self.blocks)] = [(sum(map(len, b)), sum(c)) for b, c in zip(self.blocks, self.counts, strict=True)]
        level = self.size
        while level > 1:  # a level's sums at once
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    def _replace(self, low: int, high: int, pieces: list[str], counts: list[int]) -> None:
        """These pre-tokens in place of those of the leaves from low to high, dealt evenly to the same leaves."""
        share = -(-len(pieces) // (high - low))
        if share > FULLEST * BLOCK:
            kept = lambda lists, new: [x for part in (*lists[:low], new, *lists[high:]) for x in part]
            self._lay_out(kept(self.blocks, pieces), kept(self.counts, counts))
            return
        for k in range(low, high):
            cut = slice((k - low) * share, (k - low + 1) * share)
            self.blocks[k], self.counts[k] = pieces[cut], counts[cut]
            self.sums[self.size + k] = sum(map(len, pieces[cut])), sum(counts[cut])
        first, last = (self.size + low) // 2, (self.size + high - 1) // 2
        while first:
            self.sums[first : last + 1] = self.sums[2 * first : 2 * last + 2].reshape(-1, 2, 2).sum(axis=1)
            first, last = first // 2, last // 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def pretokens(self) -> int:
        return sum(map(len, self.blocks))

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character `at` and the block's first character."""
        node, base = 1, 0
        while node < self.size:
            node *= 2
            if at - base >= self.sums[node, 0] and self.sums[node + 1, 0]:
                base += int(self.sums[node, 0])
                node += 1
        return min(node - self.size, len(self.blocks) - 1), base

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Replace `remove` characters from `at` with `insert`; places outside the text are moved to its ends."""
        at = min(max(at, 0), self.chars)
        stop = min(at + max(remove, 0), self.chars)
        low, base = self._find(max(0, at - LOOKAHEAD))
        start = base
        skip = 0
        for piece in self.blocks[low]:  # pre-tokens that end well before the edit stay
            if start + len(piece) > at - LOOKAHEAD:
                break
            start += len(piece)
            skip += 1
        old, counts = self.blocks[low][skip:], self.counts[low][skip:]
        high = low + 1
        span = start + sum(map(len, old))
        while span < stop and high < len(self.blocks):
            old, counts = old + self.blocks[high], counts + self.counts[high]
            span += int(self.sums[self.size + high, 0])
            high += 1
        while True:
            text = "".join(old)
            new = text[: at - start] + insert + text[stop - start :]
            shift = len(insert) - (stop - at)
            bounds, place = set(), start
            for piece in old:
                if place >= stop:
                    bounds.add(place + shift)
                place += len(piece)
            fresh, place, met = [], start, None
            last = high == len(self.blocks)
            for match in self.tool.split.finditer(new):
                place = start + match.start()
                if place in bounds and place > at + len(insert):
                    met = place - shift
                    break
                if not last and start + match.end() + LOOKAHEAD > start + len(new):
                    break  # it may go on in the next block
                fresh.append(match.group())
            else:
                met = start + len(text)
                if not last:
                    met = None
            if met is not None:
                break
            old, counts = old + self.blocks[high], counts + self.counts[high]
            high += 1
        rest, place = len(old), start
        for k, piece in enumerate(old):
            if place >= met:
                rest = k
                break
            place += len(piece)
        self.encoded += len(fresh)
        merged = self.blocks[low][:skip] + fresh + old[rest:]
        self._replace(low, high, merged, self.counts[low][:skip] + self.tool.counts(fresh) + counts[rest:])

    def text(self) -> str:
        return "".join(piece for block in self.blocks for piece in block)


def count_with_edits(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_after, n_pretokens, n_reencoded) for docs (doc_id, text, edits).

    edits: array of struct(at, remove, insert) in characters, applied in order; null
    counts as none, null parts as 0 or empty, null text as empty. One row per
    input row, repeated rows and null ids included; other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = counter(vocabulary, pattern)
        for frame in batches(frames, "text"):
            rows = []
            for doc_id, text, edits in zip(frame["doc_id"], frame["text"], frame["edits"], strict=True):
                tree = CountTree(text or "", tool)
                before = tree.tokens
                for e in edits if edits is not None else ():
                    if e is not None:
                        tree.edit(int(e["at"] or 0), int(e["remove"] or 0), e["insert"] or "")
                rows.append((doc_id, before, tree.tokens, tree.pretokens, tree.encoded))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "n_tokens_after", "n_pretokens", "n_reencoded"]).astype(
                {"doc_id": "Int64"}
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits")
    return slim.mapInPandas(run, "doc_id long, n_tokens long, n_tokens_after long, n_pretokens long, n_reencoded long")
