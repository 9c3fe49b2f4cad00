"""Quality by line sequence labelling: every line of a text that has a word is a step of a linear-chain conditional random field with two labels,
content and boilerplate. The best labels of the whole text come by Viterbi decoding; the share of words in content lines decides.

The weights are learnt by maximum likelihood (forward-backward, L-BFGS) on a bounded sample of pieces of labelled documents, every line of which
carries the label of its document: features that good and bad documents share get weights near nothing, and the chain decides for lines
that show little by themselves. Batches are read as bytes, so that what is counted for a line costs a few passes of numpy over them."""
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bounds of the training sample: documents with a label, pieces of them, and lines of a piece
TRAIN_DOCS, TRAIN_PIECES, PIECE = 6_000, 6_000, 64
#: a document with a smaller share of its words in content lines goes
MIN_SHARE = 0.5
#: base rules: fewer words fail, as does a larger percentage of words in repeated windows of WINDOW words
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
#: bytes of text that are counted at once
BLOCK = 4 << 20
#: strength of the prior that keeps weights small
RIDGE = 0.05

#: fixed value: the characters that count as symbols
SYMBOLS = b"#*$%&|<>"


def _lookup(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SPACE = _lookup(b" \t\n\x0b\x0c\r")
_SYMBOL = _lookup(SYMBOLS)
_UPPER, _LOWER, _DIGIT = _lookup(bytes(range(65, 91))), _lookup(bytes(range(97, 123))), _lookup(b"0123456789")
_BANG = _lookup(b"!?")
#: one byte of each code point that is no space
_TALL = ~_SPACE & ~_lookup(bytes(range(0x80, 0xC0)))

#: features of a line: name and the borders of its bins; each feature is in one bin, so a line has one weight of each group
FEATURES = [
    ("symbols in 100 characters", (0.1, 2, 5, 10)), ("capitals in 100 ASCII letters", (2, 10, 30, 60)), ("digits in 100 characters", (0.1, 5, 20)),
    ("characters of a word", (2.5, 3.5, 4.5, 5.5, 7, 9)), ("words", (2, 4, 10, 30, 100)), ("words of up to 3 characters in 100", (5, 15, 25, 35, 50)),
    ("marks !? for 100 words", (1, 20, 60)), ("words equal to the one before in 100", (3, 10, 30)), ("words in repeated windows in 100", (10, 30, 60)),
    ("equal to an earlier line", (0.5,)), ("ends a sentence", (0.5,)), ("first or last line", (0.5, 1.5, 2.5))]
_AT = np.cumsum([0] + [len(b) + 1 for _, b in FEATURES])
WEIGHTS = int(_AT[-1])


class Lines:
    """What is counted in a block of texts: of each text (words, word_chars, symbols, dup_lines, repeat_words) and, for the lines with a word, doc and codes."""

    def __init__(self, texts: list[bytes]):
        # each text is closed by a line break, so that each begins a line of its own, words and lines never cross, and no line is without a byte
        joined = b"".join(t + b"\n" for t in texts)
        b = np.frombuffer(joined, np.uint8)
        starts = np.concatenate(([0], np.flatnonzero(b == 10) + 1))[:-1]
        docs = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))[:-1]
        doc = np.searchsorted(docs, starts, side="right") - 1
        space = _SPACE[b]
        begin = ~space
        begin[1:] &= space[:-1]
        begins = np.flatnonzero(begin)
        nd, nl = len(texts), len(starts)

        def by_line(mask: np.ndarray) -> np.ndarray:
            return np.add.reduceat(mask, starts, dtype=np.int64)
        chars, symbols = by_line(_TALL[b]), by_line(_SYMBOL[b])
        capitals, small, digits, bangs = by_line(_UPPER[b]), by_line(_LOWER[b]), by_line(_DIGIT[b]), by_line(_BANG[b])
        words = by_line(begin)
        line = np.repeat(np.arange(nl), words)  # of each word
        # words by number, equal words equally
        known: dict[bytes, int] = {}
        x = np.fromiter((known.setdefault(w, len(known)) for w in joined.split()), np.int64, len(begins))
        length = np.concatenate((begins[1:], [len(b)])) - begins if len(begins) else begins
        short = np.bincount(line[length <= 4], minlength=nl)  # with the space after it
        same = np.bincount(line[1:][(x[1:] == x[:-1]) & (line[1:] == line[:-1])], minlength=nl) if len(x) else words
        repeated = _in_repeats(x, doc[line])
        again = np.bincount(line[repeated], minlength=nl)
        dup = _earlier(joined.split(b"\n")[:-1], doc, words)
        # the last character that is no space, of lines that have one
        ends = np.zeros(nl, bool)
        held = np.flatnonzero(~space)
        if len(held):
            last = held[np.searchsorted(held, np.concatenate((starts[1:], [len(b)])), side="left") - 1]
            ends = np.isin(b[last], list(b'.!?:;,"')) & (words > 0)

        def by_doc(values: np.ndarray) -> np.ndarray:
            return np.bincount(doc, weights=values, minlength=nd).astype(np.int64)
        self.words, self.word_chars, self.symbols = by_doc(words), by_doc(chars), by_doc(symbols)
        self.dup_lines, self.repeat_words = by_doc(dup), by_doc(again)
        on = np.flatnonzero(words > 0)
        self.doc, self.line_words = doc[on], words[on]
        self.number = on - np.searchsorted(doc, self.doc, side="left")  # of the line in its text
        n, c = np.maximum(words[on], 1), np.maximum(chars[on], 1)
        first = np.concatenate(([True], self.doc[1:] != self.doc[:-1])) if len(on) else np.zeros(0, bool)
        final = np.concatenate((self.doc[1:] != self.doc[:-1], [True])) if len(on) else first
        values = [100 * symbols[on] / c, 100 * capitals[on] / np.maximum(capitals[on] + small[on], 1), 100 * digits[on] / c, c / n, n, 100 * short[on] / n,
                  100 * bangs[on] / n, 100 * same[on] / n, 100 * again[on] / n, dup[on], ends[on], first + 2 * final]
        self.codes = np.stack([_AT[k] + np.searchsorted(borders, v, side="right") for k, ((_, borders), v) in enumerate(zip(FEATURES, values, strict=True))], 1).astype(np.int16)


def _in_repeats(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words lie in a window of WINDOW words that its text has twice or more."""
    m = len(x) - WINDOW + 1
    out = np.zeros(len(x), bool)
    if m < 2:
        return out
    columns = [doc[:m], *(x[k:m + k] for k in range(WINDOW))]
    h = np.zeros(m, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    whole = np.flatnonzero(doc[:m] == doc[WINDOW - 1:])
    order = whole[np.argsort(h[whole], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    if not all((c[order[1:][same]] == c[order[:-1][same]]).all() for c in columns):  # different windows with one hash: compare the words themselves
        order = whole[np.lexsort([c[whole] for c in columns])]
        same = np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in columns])
    twice = np.concatenate((order[1:][same], order[:-1][same]))
    for k in range(WINDOW):
        out[twice + k] = True
    return out


def _earlier(lines: list[bytes], doc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """1 for each line with a word that equals an earlier line of its text."""
    out, seen, at = np.zeros(len(lines), np.int64), set(), -1
    for i, (s, d, w) in enumerate(zip(lines, doc.tolist(), words.tolist(), strict=True)):
        if d != at:
            seen, at = set(), d
        if w:
            if s in seen:
                out[i] = 1
            else:
                seen.add(s)
    return out


def viterbi(score: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels (0 content, 1 boilerplate) of a sequence: score[i] is what label 1 has over label 0 at step i, move[a, b] the weight of b after a.
    Ties go to content."""
    n = len(score)
    (m00, m01), (m10, m11) = move.tolist()
    a, b, back = 0.0, float(score[0]), []
    for s in score[1:].tolist():
        from_b0, from_b1 = b + m10 > a + m00, b + m11 > a + m01
        back.append((from_b0, from_b1))
        a, b = (b + m10 if from_b0 else a + m00), s + (b + m11 if from_b1 else a + m01)
    out = np.zeros(n, np.int8)
    state = out[-1] = int(b > a)
    for i in range(n - 2, -1, -1):
        state = out[i] = int(back[i][state])
    return out


def _likelihood(p: np.ndarray, codes: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Minus log-likelihood of the labels y[piece] (each line has that of its piece) and its gradient. p: weights of label 1, then move. codes: piece x step x
    feature, real: which steps there are."""
    w, move = p[:WEIGHTS], p[WEIGHTS:].reshape(2, 2)
    n, steps = real.shape
    s = np.zeros((n, steps, 2))
    s[:, :, 1] = w[codes].sum(2)
    alpha, beta = np.zeros((steps, n, 2)), np.zeros((steps, n, 2))
    alpha[0] = s[:, 0]
    for t in range(1, steps):
        a = np.logaddexp(alpha[t - 1][:, 0, None] + move[0], alpha[t - 1][:, 1, None] + move[1]) + s[:, t]
        alpha[t] = np.where(real[:, t, None], a, alpha[t - 1])
    total = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
    for t in range(steps - 2, -1, -1):
        ahead = s[:, t + 1] + beta[t + 1]
        b = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
        beta[t] = np.where(real[:, t + 1, None], b, 0.0)
    mark = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total).T * real  # chance of label 1
    off = (mark - y[:, None]) * real
    gw = np.bincount(codes.ravel(), np.repeat(off.ravel(), codes.shape[2]), WEIGHTS)
    gm = np.zeros((2, 2))
    got = 0.0
    for t in range(1, steps):
        on = real[:, t]
        for a, b in itertools.product((0, 1), (0, 1)):
            gm[a, b] += np.exp(alpha[t - 1][on, a] + move[a, b] + s[on, t, b] + beta[t][on, b] - total[on]).sum()
    pairs = real[:, 1:].sum(1)
    for k in (0, 1):
        gm[k, k] -= pairs[y == k].sum()
        got += move[k, k] * pairs[y == k].sum()
    got += (s[:, :, 1] * real * y[:, None]).sum() - total.sum()
    return -got, np.concatenate((gw, gm.ravel()))


def _minimise(f, p: np.ndarray, rounds: int = 150, memory: int = 8) -> np.ndarray:
    """L-BFGS with halving steps, until the gradient is small or nothing gets better."""
    value, g = f(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            alphas.append(a := (s @ q) / (s @ y))
            q -= a * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(g).sum()))
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        step, slope = 1.0, float(g @ q)
        while step > 1e-6 and (new := f(p - step * q))[0] > value - 1e-4 * step * slope:
            step /= 2
        if step <= 1e-6:
            break
        s, y = -step * q, new[1] - g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = value - new[0] < 1e-6 * abs(value) or np.abs(new[1]).max() < 1e-4
        p, (value, g) = p + s, new
        if done:
            break
    return p


def fit(pieces: list[tuple[int, np.ndarray]]) -> dict:
    """Weights and moves from (label, codes of the lines) of each piece. Without both labels every line is content, or boilerplate if there is only that."""
    y = np.array([k for k, _ in pieces], np.int64)
    if not len(y) or y.min() == y.max():
        return {"weights": np.full(WEIGHTS, 1.0 if len(y) and y[0] == 1 else -1.0), "move": np.zeros((2, 2))}
    # pieces of about one length are one table
    size, tables = np.array([len(c) for _, c in pieces]), []
    for width in sorted({1 << (int(n) - 1).bit_length() for n in size}):
        at = np.flatnonzero((size <= width) & (2 * size > width))
        codes, real = np.zeros((len(at), width, len(FEATURES)), np.int64), np.zeros((len(at), width), bool)
        for i, k in enumerate(at.tolist()):
            codes[i, :size[k]], real[i, :size[k]] = pieces[k][1], True
        tables.append((codes, real, y[at]))

    def whole(p: np.ndarray) -> tuple[float, np.ndarray]:
        parts = [_likelihood(p, *t) for t in tables]
        return sum(v for v, _ in parts) + RIDGE * float(p @ p) / 2, np.sum([g for _, g in parts], 0) + RIDGE * p
    p = _minimise(whole, np.zeros(WEIGHTS + 4))
    return {"weights": p[:WEIGHTS], "move": p[WEIGHTS:].reshape(2, 2)}


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in turn, about BLOCK bytes at a time."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > BLOCK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", docs_bound: int = TRAIN_DOCS, pieces_bound: int = TRAIN_PIECES) -> dict:
    """The model from at most `docs_bound` documents with a label (1 good, 0 bad; others and null keys are ignored, a key with both counts as bad), cut into
    pieces of PIECE lines, of which at most `pieces_bound` reach the driver: always those with the smallest hashes. Rows of equal key and text count once."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(label).cast("int").alias("_y"))
    d = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_h", F.xxhash64(F.lit(5), F.col("_k").cast("string"), "_text"))
    # hashes only are sorted; texts come by a join with a broadcast of at most docs_bound rows
    least = d.select("_k", "_h").join(known, "_k").select("_h", "_y").distinct().orderBy("_h", "_y").limit(docs_bound)
    chosen = d.select("_h", "_text").join(F.broadcast(least), "_h").dropDuplicates(["_h"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, at = [], 0
            for block in _blocks([t.encode("utf-8", "surrogatepass") for t in b["_text"]]):
                found = Lines(block)
                edges = np.searchsorted(found.doc, np.arange(len(block) + 1))
                for i, (lo, hi) in enumerate(itertools.pairwise(edges.tolist())):
                    h, y = b["_h"].iat[at + i], b["_y"].iat[at + i]
                    out += [(h, k, y, found.codes[k:min(k + PIECE, hi)].tobytes()) for k in range(lo, hi, PIECE)]
                at += len(block)
            yield pd.DataFrame(out, columns=["h", "part", "y", "codes"])
    rows = chosen.mapInPandas(cut, "h bigint, part bigint, y int, codes binary").orderBy(F.xxhash64("h", "part"), "h", "part").limit(pieces_bound).collect()
    # label 1 of the chain is boilerplate
    return fit([(1 - r["y"], np.frombuffer(r["codes"], np.int16).reshape(-1, len(FEATURES)).astype(np.int64)) for r in rows])


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words", "boilerplate"]


def judge(docs: DataFrame, model: dict, text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """Adds n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words in windows of
    five that the text has twice or more), base_failed (too few words, or too many repeated ones), content_words, boilerplate (stretches of lines, as
    start and end, exclusive, among all lines of the text from 0) and kept: false if base_failed or if fewer than `min_share` of the words are in content lines.

    Words are runs of anything but space and the controls 9 to 13; lines end at a line feed; lines without words have no label and part
    no stretch. Null is read as empty and fails; texts of any length are labelled whole; repeated rows are judged each. Other columns stay; those
    with the names above are replaced. An empty table gives an empty result. Nothing is shuffled.
    """
    kept = [c for c in docs.columns if c not in _COLUMNS]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WEIGHTS numbers and four more

    @F.pandas_udf("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,kept:boolean,"
                  "content_words:bigint,boilerplate:array<struct<start:bigint,end:bigint>>>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, move = shared.value["weights"], shared.value["move"]
        for texts in batches:
            parts = []
            for block in _blocks([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
                x = Lines(block)
                score = w[x.codes].sum(1)
                edges = np.searchsorted(x.doc, np.arange(len(block) + 1)).tolist()
                content, spans = np.zeros(len(block), np.int64), []
                for i, (lo, hi) in enumerate(itertools.pairwise(edges)):
                    bad = viterbi(score[lo:hi], move) if hi > lo else np.zeros(0, np.int8)
                    content[i] = x.line_words[lo:hi][bad == 0].sum()
                    flips = np.flatnonzero(np.diff(np.concatenate(([0], bad, [0]))))
                    spans.append([{"start": int(x.number[lo + a]), "end": int(x.number[lo + b - 1]) + 1} for a, b in zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True)])
                failed = (x.words < MIN_WORDS) | (100 * x.repeat_words > MAX_REPEATED * x.words)
                parts.append(pd.DataFrame({"n_words": x.words, "word_chars": x.word_chars, "n_symbols": x.symbols, "n_dup_lines": x.dup_lines, "n_repeat_words": x.repeat_words,
                                           "base_failed": failed, "kept": ~failed & (content >= min_share * x.words), "content_words": content, "boilerplate": spans}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=_COLUMNS)
    d = docs.select(*[F.col(f"`{c}`") for c in kept], judged(F.col(text)).alias("_judged"))
    return d.select(*[F.col(f"`{c}`") for c in kept], "_judged.*")
