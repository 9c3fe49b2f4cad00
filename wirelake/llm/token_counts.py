"""Token counts that survive edits. Each document keeps a segment tree over its pre-tokens: leaves are runs of them with their length and token
count, inner nodes are sums. An edit re-encodes the leaves it touches and the context at their borders, and updates the sums above."""
import base64
from collections.abc import Iterator
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import env_path, small_batches

#: ranks of a public byte-level vocabulary and the pre-token pattern that belongs to it
VOCABULARY = env_path("WIRELAKE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: characters of a leaf, at least
LEAF = 2_048
#: where the pre-token pattern surely ends a piece, in every script: white space occurs only at the start of pieces or in pieces of its own, so one ends
#: before each run of it; and letters and digits end before punctuation, of which the ideographic kind is taken, for texts without blanks. What
#: follows is matched from the cut on, so it doesn't depend on what is before
_CUT = re.compile(r"(?<=\S)(?=\s)|(?<=[^\W_])(?=[\u3001\u3002\u3008-\u3011\u3014-\u301b\uff01\uff0c\uff1a\uff1b\uff1f])")
#: an edit has to be so far from a cut to leave it a cut: the character before it and the one or two after it
_BEFORE, _AFTER = 2, 1

TREE = "struct<lengths:array<int>,counts:array<int>,sums:array<bigint>>"


class Encoder:
    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def count(self, text: str) -> int:
        return len(self.encode(text))


def cut(text: str) -> list[str]:
    """Leaves: the text at the first safe cut after every LEAF characters. Encoded on their own they give the tokens of the whole text. A run without white
    space and ideographic punctuation is never cut."""
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + LEAF) if at + LEAF < len(text) else None
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


def _sums(counts: list[int]) -> list[int]:
    """Inner nodes, level after level from the leaves' parents to the root; a node without a brother passes its sum up."""
    out, level = [], counts
    while len(level) > 1:
        level = [sum(level[i:i + 2]) for i in range(0, len(level), 2)]
        out += level
    return out


def _update(counts: list[int], sums: list[int], leaf: int, value: int) -> None:
    """Sets a leaf's count and the sums on the path above it."""
    change, width, at, base = value - counts[leaf], len(counts), leaf, 0
    counts[leaf] = value
    while width > 1:
        at, width = at // 2, (width + 1) // 2
        sums[base + at] += change
        base += width


def total(tree: dict) -> int:
    return int(tree["sums"][-1]) if len(tree["sums"]) else int(sum(tree["counts"]))


def build(text: str | None, encoder: Encoder) -> dict:
    leaves = cut(text or "")
    counts = [encoder.count(x) for x in leaves]
    return {"lengths": [len(x) for x in leaves], "counts": counts, "sums": _sums(counts)}


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text after edits (start, end, replacement), sorted, not overlapping, places in the text before them."""
    out, at = [], 0
    for s, e, r in edits:
        out += [text[at:s], r]
        at = e
    return "".join([*out, text[at:]])


def apply(tree: dict, text: str, edits: list[tuple[int, int, str]], encoder: Encoder) -> tuple[dict, int]:
    """The tree of the edited text, and the number of characters that were encoded for it. `text` is the text before the edits."""
    lengths, counts = [int(x) for x in tree["lengths"]], [int(x) for x in tree["counts"]]
    starts, at = [], 0
    for n in lengths:
        starts.append(at)
        at += n
    # runs of leaves [lo, hi) that edits touch, each widened until its borders are untouched cuts
    runs: list[list] = []
    i = 0
    for edit in edits:
        s, e, _ = edit
        while i + 1 < len(starts) and starts[i + 1] + _BEFORE <= s:
            i += 1
        j = i
        while j < len(starts) and j + 1 < len(starts) and starts[j + 1] - _AFTER < e + (e == s):
            j += 1
        if runs and runs[-1][1] > i:
            runs[-1][1] = max(runs[-1][1], j + 1)
            runs[-1][2].append(edit)
        else:
            runs.append([i, j + 1, [edit]])
    new, encoded, shift = [], 0, False
    for lo, hi, own in runs:
        first = starts[lo] if starts else 0
        last = starts[hi - 1] + lengths[hi - 1] if starts else 0
        leaves = cut(edited(text[first:last], [(s - first, e - first, r) for s, e, r in own]))
        encoded += sum(map(len, leaves))
        new.append((lo, min(hi, len(starts)), [len(x) for x in leaves], [encoder.count(x) for x in leaves]))
        shift |= len(leaves) != min(hi, len(starts)) - lo
    if not shift:
        sums = [int(x) for x in tree["sums"]]
        for lo, _, ls, cs in new:
            for k, (n, c) in enumerate(zip(ls, cs, strict=True)):
                lengths[lo + k] = n
                _update(counts, sums, lo + k, c)
        return {"lengths": lengths, "counts": counts, "sums": sums}, encoded
    # leaves came or went: the sums are laid out anew from the leaves' counts, nothing else is encoded
    for lo, hi, ls, cs in reversed(new):
        lengths[lo:hi], counts[lo:hi] = ls, cs
    return {"lengths": lengths, "counts": counts, "sums": _sums(counts)}, encoded


def index(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds tree and n_tokens to every row. Null and empty texts have an empty tree and 0 tokens. Keep it as a table beside the texts."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(f"struct<tree:{TREE},n:bigint>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary)
        for texts in batches:
            trees = [build(t, encoder) for t in texts]
            yield pd.DataFrame({"tree": trees, "n": [total(t) for t in trees]})
    return docs.withColumn("_x", made(F.col(text))).withColumns({"tree": F.col("_x.tree"), "n_tokens": F.col("_x.n")}).drop("_x")


def update(indexed: DataFrame, edits: str, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds new_tree, n_tokens_after and n_encoded (characters encoded for the edits) to rows with text, tree and edits, an array of (start, end,
    replacement) in code points of the text. Edits are sorted by place; one that overlaps the one before it, is reversed or lies outside the text is left
    out, and so is one with a null. Rows without edits keep their tree. Repeated rows are edited each."""
    @F.pandas_udf(f"struct<tree:{TREE},n:bigint,encoded:bigint>")
    def changed(batches: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        encoder = None
        for texts, trees, lists in batches:
            out = []
            for (t, es), tree in zip(zip(texts, lists, strict=True), trees.to_dict("records"), strict=True):
                t, fine, at = t or "", [], 0
                for e in sorted(((x["start"], x["end"], x["replacement"]) for x in (es if es is not None else []) if None not in x.values()), key=lambda x: x[:2]):
                    if at <= e[0] <= e[1] <= len(t):
                        fine.append(e)
                        at = e[1]
                if fine:
                    encoder = encoder or Encoder(vocabulary)
                    tree, n = apply(tree, t, fine, encoder)
                else:
                    n = 0
                out.append((tree, total(tree), n))
            yield pd.DataFrame(out, columns=["tree", "n", "encoded"])
    return (indexed.withColumn("_x", changed(F.col(text), F.col("tree"), F.col(edits)))
            .withColumns({"new_tree": F.col("_x.tree"), "n_tokens_after": F.col("_x.n"), "n_encoded": F.col("_x.encoded")}).drop("_x"))
