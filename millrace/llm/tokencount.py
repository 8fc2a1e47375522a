"""Token counts that follow edits.

A document's pre-tokens stand in leaves of about LEAF each; a segment tree over the leaves sums their
characters and tokens. An edit replaces a span of characters. Pre-tokens are cut from left to right, and a
cut depends only on the text from there on, so only the leaves that edits touch, with the leaf before them
as boundary context, are cut and encoded anew, until a cut falls where an old one fell beyond the edits;
from there on the old counts hold. Leaves' sums are then updated along their paths to the root.

Texts that hold a special token's string, which may merge across pre-tokens, have one leaf and are
counted whole. Other texts outside the range of pretokens.py are cut with the vocabulary's own pattern.

Defined results: null text is empty and counts 0; edits must be ordered, within the text and apart (else
ValueError); edits of length 0 insert; repeated rows are counted each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table
from .pii import base_spans
from .pretokens import BYTE_PATTERN, OTHER, PretokenEncoder, encoder

LEAF = 64
_any = regex.compile(public_tokenizers.PATTERN)
Edit = tuple[int, int, str]


class TokenTree:
    """Counts of a text by leaf, summed in a segment tree."""

    def __init__(self, text: str, code: PretokenEncoder) -> None:
        self.text, self.code = text, code
        self.whole = "<|" in text
        self.encoded = 0
        if self.whole:
            parts = [[text]]
        else:
            cut = (_any if OTHER.search(text) else BYTE_PATTERN).findall(text)
            parts = [cut[i : i + LEAF] for i in range(0, len(cut), LEAF)] or [[]]
        self.leaves = [(list(map(len, p)), self.count(p)) for p in parts]
        self.encoded = 0  # of what follows only
        self.build()

    def count(self, parts: list[str]) -> list[int]:
        self.encoded += len(parts)
        if self.whole:
            return [len(self.code.whole(x)) >> 2 for x in parts]
        known = self.code.known
        return [len(known[x]) >> 2 for x in parts]

    def build(self) -> None:
        self.size = 1 << max(len(self.leaves) - 1, 0).bit_length()
        pad = [0] * (self.size - len(self.leaves))
        self.chars = [0] * self.size + [sum(x) for x, _ in self.leaves] + pad
        self.tokens = [0] * self.size + [sum(x) for _, x in self.leaves] + pad
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def put(self, i: int, sizes: list[int], counts: list[int]) -> None:
        """Replace a leaf and update the sums above it."""
        self.leaves[i] = (sizes, counts)
        i += self.size
        self.chars[i], self.tokens[i] = sum(sizes), sum(counts)
        while i > 1:
            i >>= 1
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character; the last one for the end."""
        i, before = 1, 0
        place = min(place, max(self.chars[1] - 1, 0))
        while i < self.size:
            i *= 2
            if place - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def edit(self, edits: list[Edit]) -> int:
        """Apply edits (start, end, text), ordered and apart; return the total."""
        last, out = 0, []
        for a, b, new in edits:
            if not last <= a <= b <= len(self.text):
                raise ValueError("edits must be ordered, apart and within the text")
            out += [self.text[last:a], new]
            last = b
        if not edits:
            return self.total()
        text = "".join([*out, self.text[last:]])
        if self.whole or "<|" in text:
            self.__init__(text, self.code)
            self.encoded += 1
            return self.total()
        # the same pattern must cut the old text and the new
        find = _any if OTHER.search(text) else BYTE_PATTERN
        shift, number = 0, 0
        while number < len(edits):
            a = edits[number][0]
            leaf, begin = self.leaf_at(max(a - 1, 0))
            if leaf:  # the leaf before is context; its own first cut stands, as an edit is a leaf away
                leaf -= 1
                begin -= self.chars[self.size + leaf]
            end = a
            # old cuts from here on, walked along with the new ones
            at_leaf, at_cut, old = leaf, 0, begin
            fresh: list[str] = []
            synced = False
            for m in find.finditer(text, begin + shift):
                while number < len(edits) and edits[number][0] + shift <= m.end():
                    # an edit that the new cut reaches belongs to this run
                    end = edits[number][1]
                    shift += len(edits[number][2]) - (edits[number][1] - edits[number][0])
                    number += 1
                fresh.append(m[0])
                place = m.end() - shift
                if place < end:
                    continue
                while old < place and at_leaf < len(self.leaves):
                    sizes = self.leaves[at_leaf][0]
                    if at_cut < len(sizes):
                        old += sizes[at_cut]
                        at_cut += 1
                    else:
                        at_leaf, at_cut = at_leaf + 1, 0
                if old == place and (number == len(edits) or edits[number][0] > place + 1):
                    synced = True
                    break
            if not synced:  # to the end of the text
                while number < len(edits):
                    shift += len(edits[number][2]) - (edits[number][1] - edits[number][0])
                    number += 1
                at_leaf, at_cut = len(self.leaves), 0
            tail = self.leaves[at_leaf] if at_leaf < len(self.leaves) else ([], [])
            self.splice(leaf, at_leaf, fresh, (tail[0][at_cut:], tail[1][at_cut:]))
            # later edits are given in old places; the tree now holds new ones up to here
            edits = [(x + shift, y + shift, t) for x, y, t in edits[number:]]
            number, shift = 0, 0
        self.text = text
        return self.total()

    def splice(self, first: int, last: int, fresh: list[str], tail: tuple[list[int], list[int]]) -> None:
        """Leaves first to last give way to fresh pre-tokens and the rest of leaf last."""
        sizes, counts = [len(x) for x in fresh] + tail[0], self.count(fresh) + tail[1]
        stop = min(last + 1, len(self.leaves))
        if len(sizes) <= 2 * LEAF * max(stop - first, 1):
            n = stop - first
            step = -(-len(sizes) // max(n, 1)) or 1
            for i in range(n):
                self.put(first + i, sizes[i * step : (i + 1) * step], counts[i * step : (i + 1) * step])
            return
        # much longer than before: more leaves
        self.leaves[first:stop] = [(sizes[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(sizes), LEAF)] or [([], [])]
        self.build()


def recount(docs: DataFrame, edits_of: object, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_pretokens, n_reencoded; edits_of(text) gives the edits."""
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_pretokens", "n_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        for b in chunks(batches, "text"):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                tree = TokenTree(text, code)
                before, cut, edits = tree.total(), sum(len(x) for x, _ in tree.leaves), edits_of(text)
                rows.append((doc_id, before, len(edits), tree.edit(edits), cut, tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names)

    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def masking_edits(text: str) -> list[Edit]:
    """The edits that masking personal data makes: each base span gives way to its kind."""
    out: list[Edit] = []
    for kind, a, b in sorted(base_spans(text), key=lambda s: (s[1], -s[2])):
        if not out or a >= out[-1][1]:
            out.append((a, b, f"[{kind.upper()}]"))
    return out


def op10_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recount(table(spark, sf_dir, "documents"), masking_edits)
