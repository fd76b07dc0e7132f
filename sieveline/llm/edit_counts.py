"""Token counts that follow edits: a segment tree of pre-token runs per document.

A text is cut into runs of about ``RUN`` characters, at places where a
pre-token boundary is certain whatever stands on either side (a single space or
line feed between two characters that aren't white space). Token counts of runs
add up, so a tree of sums over the runs gives the count of the text. An edit
touches the runs that hold it and two characters more on each side: the places
that bound those runs then still are certain boundaries. Only these runs are
encoded again; their first one takes the new count, and the sums above follow.

Trees are heaps in arrays: node 1 is the root, leaves start at half the length;
``tokens`` and ``chars`` hold sums of tokens and characters.

Trees are rows of a table: write it, and later edits start from there. Texts of any
length have a tree of as many runs. Extra columns are left behind. Nulls: a null text is an empty one (a tree with one empty run). Edits must not
overlap; an edit outside the text is cut to it; null edits are none. Repeated
rows have a tree each. An empty table gives no rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, ship
from .tokens import PieceTokenizer, tokenizer

RUN = 512
_CERTAIN = re.compile(r"(?<=\S)(?=[ \n]\S)")
Edit = tuple[int, int, str]


def runs(text: str, size: int = RUN) -> list[str]:
    cuts, at = [0], size
    while at < len(text):
        m = _CERTAIN.search(text, at)
        if m is None:
            break
        cuts.append(m.start())
        at = m.start() + size
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def _heap(leaves: list[int]) -> np.ndarray:
    half = 1 << max(0, len(leaves) - 1).bit_length()
    heap = np.zeros(2 * half, np.int64)
    heap[half : half + len(leaves)] = leaves
    while half > 1:
        heap[half // 2 : half] = heap[half : 2 * half].reshape(-1, 2).sum(axis=1)
        half //= 2
    return heap


class Tree:
    def __init__(self, tokens: np.ndarray, chars: np.ndarray):
        self.tokens, self.chars = tokens, chars
        self.half = len(tokens) // 2

    @classmethod
    def build(cls, text: str, encoder: PieceTokenizer, size: int = RUN) -> Tree:
        parts = runs(text, size)
        return cls(_heap([len(encoder.ids(p)) // 4 for p in parts]), _heap([len(p) for p in parts]))

    def total(self) -> int:
        return int(self.tokens[1])

    def leaf(self, at: int) -> tuple[int, int]:
        """The run that holds character ``at``, and where it starts."""
        node, start = 1, 0
        while node < self.half:
            node *= 2
            left = int(self.chars[node])
            if at - start >= left and self.chars[node + 1]:
                start += left
                node += 1
        return node - self.half, start

    def put(self, leaf: int, tokens: int, chars: int) -> None:
        node = leaf + self.half
        d_tokens, d_chars = tokens - int(self.tokens[node]), chars - int(self.chars[node])
        while node:
            self.tokens[node] += d_tokens
            self.chars[node] += d_chars
            node //= 2

    def update(self, text: str, edits: list[Edit], encoder: PieceTokenizer) -> tuple[str, int]:
        """Apply edits (places in ``text``); the new text and how many characters were encoded again."""
        groups: list[list] = []  # first leaf, last leaf, start, end, edits
        for start, end, new in sorted(edits, key=lambda e: e[:2]):
            start, end = min(max(0, start), len(text)), min(max(start, end), len(text))
            (i, a), (j, b) = self.leaf(max(0, start - 2)), self.leaf(max(0, min(len(text), end + 2) - 1))
            b += int(self.chars[self.half + j])
            if groups and i <= groups[-1][1]:
                g = groups[-1]
                g[1], g[3] = max(g[1], j), max(g[3], b)
                g[4].append((start, end, new))
            else:
                groups.append([i, j, a, b, [(start, end, new)]])
        out, done, again = [], 0, 0
        for i, j, a, b, own in groups:
            parts, at = [], a
            for start, end, new in own:
                parts += [text[at:start], new]
                at = max(at, end)
            region = "".join([*parts, text[at:b]])
            out += [text[done:a], region]
            done, again = b, again + len(region)
            self.put(i, len(encoder.ids(region)) // 4, len(region))
            for k in range(i + 1, j + 1):
                self.put(k, 0, 0)
        return "".join([*out, text[done:]]), again


_COLUMNS = [("doc_id", pa.int64()), ("text", pa.string()), ("tokens", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64()))]
_DDL = "doc_id long, text string, tokens array<long>, chars array<long>"


def build_trees(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = RUN) -> DataFrame:
    """``doc_id, text, tokens, chars``: each text with its tree. Nothing is shuffled."""
    ship(docs.sparkSession)

    def run(batches):
        encoder = tokenizer(vocabulary)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            trees = [Tree.build(t, encoder, size) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string()), pa.array([t.tokens for t in trees], pa.list_(pa.int64())), pa.array([t.chars for t in trees], pa.list_(pa.int64()))], schema=pa.schema(_COLUMNS))

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, _DDL)


def update_trees(trees: DataFrame, vocabulary: str, edits_of: Callable[[str], list[Edit]]) -> DataFrame:
    """Edit each text and its tree: adds ``n_before, n_tokens, n_edits, reencoded_chars``; ``text`` is the new one."""
    ship(trees.sparkSession)
    more = [("n_before", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int64()), ("reencoded_chars", pa.int64())]

    def run(batches):
        encoder = tokenizer(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for text, tokens, chars in zip(batch.column(1), batch.column(2), batch.column(3)):
                text, tree = text.as_py(), Tree(np.array(tokens.as_py(), np.int64), np.array(chars.as_py(), np.int64))
                before, edits, again = tree.total(), edits_of(text), 0
                if edits:
                    text, again = tree.update(text, edits, encoder)
                rows.append((text, tree.tokens, tree.chars, before, tree.total(), len(edits), again))
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(columns, _COLUMNS[1:] + more))], schema=pa.schema(_COLUMNS + more))

    return trees.mapInArrow(run, _DDL + ", n_before long, n_tokens long, n_edits long, reencoded_chars long")


_LOCAL = string.ascii_letters + string.digits + "._+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++\.[A-Za-z0-9.-]*[A-Za-z0-9]")
_NUMBER = re.compile(r"\+?\(?\d[\d ().-]{7,30}\d")


def mail_addresses(text: str) -> list[tuple[int, int]]:
    """Places of mail addresses, from each ``@`` outward, so the time is linear however long a run without white space is."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = len(before.rstrip(_LOCAL)) + free
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            out.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return out


def redactions(text: str) -> list[Edit]:
    """The edits of the registered query: mail addresses and long numbers become placeholders."""
    mails = [(a, b, "<email>") for a, b in mail_addresses(text)]
    numbers, i = [], 0
    for m in _NUMBER.finditer(text):  # both in order: each address is passed once
        while i < len(mails) and mails[i][1] <= m.start():
            i += 1
        if i == len(mails) or mails[i][0] >= m.end():
            numbers.append((m.start(), m.end(), "<number>"))
    return mails + numbers
