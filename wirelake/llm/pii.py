"""Personal data in text. Generators of high recall propose overlapping spans, boosted trees learnt from all documents judge them by format and context,
thresholds calibrated on held-out candidates decide which of them are redacted besides the spans of the fixed patterns."""
import bisect
import itertools
import random
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

KINDS = ("email", "ip", "card", "phone")
# fixed patterns of the base kinds; the e-mail pattern is applied from its "@" on
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# looser shapes, for recall
LOOSE = {"email": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?:(?:\.| ?(?:\(dot\)|\[dot\]| dot ) ?)[A-Za-z0-9-]+)*"
                            r"(?:\.| ?(?:\(dot\)|\[dot\]| dot ) ?)[A-Za-z]{2,}"),
         "ip": re.compile(r"[0-9]{1,3}(?:(?:[ .,]|\[\.\]|\(\.\)| dot )[0-9]{1,3}){3}"),
         "card": re.compile(r"[0-9]{4}(?:[ ./-]?[0-9]{2,6}){2,4}"),
         "phone": re.compile(r"\(?[0-9]{2,4}\)?[ ./-]?[0-9]{3}[ ./-]?[0-9]{3,4}")}
CUES = {"email": ("mail", "contact", "@"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "pay", "credit"), "phone": ("tel", "phone", "call", "fax", "mobile")}
N_FEATURES = 17
#: bins of a feature that the trees tell apart
BINS = 32
#: share of positive ones that accepted held-out candidates have to reach
PRECISION = 0.95

CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,f:array<double>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns by kind, then start: leftmost, non-overlapping, failing matches dropped."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        # the groups are told apart by dots; a part is at most 255
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return out


#: signs that are written out
_SPELLED = re.compile(r"\(at\)|\[at\]| at |\(dot\)|\[dot\]| dot |\[\.\]|\(\.\)")
# the digits go on before or after
_GOES_ON, _CAME = re.compile(r"[ .,/-]?[0-9]"), re.compile(r"[0-9][ .,/-]?$")


def _features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context. Whether a check such as Luhn's holds, a "+" or an "@" are not among them: the trees have to generalise beyond the fixed patterns."""
    s = text[start:end]
    before, after = text[max(0, start - 24):start].lower(), text[end:end + 1]
    n = sum(c in "0123456789" for c in s)
    groups = re.findall(r"[0-9]+", s)
    return [float(x) for x in (
        kind, len(s), n, n / max(1, len(s)), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), s.count("."), s.count("-") + s.count(" "),
        len(_SPELLED.findall(s)), bool(_GOES_ON.match(text, end)) or bool(_CAME.search(text[max(0, start - 2):start])), s.count("("), before[-1:].isalnum(), after.isalnum(), any(c in before for c in CUES[KINDS[kind]]), s[:1] in "345",
        len(groups[-1]) if groups else 0)]


class _Spans:
    """Base spans, asked for one that holds or touches a stretch: the furthest end of all that begin so far tells."""

    def __init__(self, base: list[tuple[int, int, int]]):
        at = sorted((s, e) for _, s, e in base)
        self.starts, self.ends = [s for s, _ in at], list(itertools.accumulate((e for _, e in at), max))

    def hold(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.starts, start)
        return i > 0 and self.ends[i - 1] >= end

    def touch(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def propose(text: str | None) -> list[tuple]:
    """All candidates of a text: base spans, and the looser shapes that don't lie in one."""
    if not text:
        return []
    base = base_spans(text)
    covered = _Spans(base)
    out = [(k, s, e, True, _features(text, k, s, e)) for k, s, e in base]
    for k, name in enumerate(KINDS):
        if name == "email" and "@" not in text and "at" not in text:
            continue
        for m in (LOOSE[name].finditer(text) if name != "email" else _loose_mail(text)):
            if not covered.hold(m.start(), m.end()):
                out.append((k, m.start(), m.end(), False, _features(text, k, m.start(), m.end())))
    return out


_MAIL_SIGN = re.compile(r"@|\(at\)|\[at\]| at [A-Za-z0-9-]+(?:\.[A-Za-z]| ?(?:\(dot\)|\[dot\]| dot ))")


def _loose_mail(text: str) -> Iterator[re.Match]:
    """The loose e-mail shape, tried only around its signs."""
    last = 0
    for sign in _MAIL_SIGN.finditer(text):
        start = sign.start()
        if start > 0 and text[start - 1] == " ":
            start -= 1
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = LOOSE["email"].match(text, start)
        if m and m.end() > last:
            last = m.end()
            yield m


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds candidates to every row, over its whole text; null and empty texts have none."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(CANDIDATE)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("kind", "start", "end", "base", "f")
        for batch in texts:
            yield pd.Series([[dict(zip(names, c, strict=True)) for c in propose(t)] for t in batch], dtype=object)
    return docs.withColumn("candidates", found(F.col(text)))


def _disguised(rng: random.Random, kind: int, s: str) -> str:
    """A base span in a form that the fixed patterns don't hold."""
    if kind == 0:
        user, domain = s.split("@", 1)
        return user + rng.choice((" at ", "(at)", " (at) ", "[at]")) + rng.choice((".", " dot ", "(dot)", "[dot]")).join(domain.split("."))
    if kind == 1:
        return rng.choice(("[.]", "(.)", " dot ", " ", ",")).join(s.split("."))
    if kind == 2:
        digits = re.sub("[^0-9]", "", s)
        return rng.choice("./").join(digits[k:k + 4] for k in range(0, len(digits), 4))
    groups = re.findall("[0-9]+", s)
    form = rng.randrange(6)
    if form == 0:
        return s[1:]
    if form == 1:
        return s[1 + len(groups[0]):].lstrip(" .-)")
    return rng.choice(" .-/").join(groups[1:] if form < 5 else groups)


def _ordinary(rng: random.Random, kind: int, near: list[str]) -> str:
    """What has a loose shape in ordinary text: places and sentences after "at", lists of numbers, dates, large numbers."""
    n = rng.randrange
    if kind == 0:
        return f"{rng.choice(near)} at {rng.choice(near)}.{rng.choice(near)}"
    if kind == 1:
        return rng.choice((" ", ",")).join(str(n(1000)) for _ in range(4))
    if kind == 2:
        sign = rng.choice("-/. ")
        day = sign.join((str(1900 + n(150)), f"{1 + n(12):02}", f"{1 + n(28):02}"))
        return rng.choice((day, f"{day} {n(24):02}", "".join(str(n(10)) for _ in range(8 + n(12)))))
    return rng.choice((f"{n(10 ** 7, 10 ** 9):,}".replace(",", rng.choice(" .")), "".join(str(n(10)) for _ in range(8 + n(12))), f"{n(10 ** 4)}-{n(1000):03}-{n(1000):03}"))


def examples(text: str | None, seed: int) -> list[tuple]:
    """Labelled candidates (kind, start, end, label, features): each base span as it is and disguised, in its place; loose shapes cut out of longer runs; and
    ordinary shapes of each kind in place of a word. A loose shape that stands free in the text may be personal data or not, so it has no label."""
    if not text:
        return []
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")) ^ seed)
    base = base_spans(text)
    covered = _Spans(base)
    out = [(k, s, e, True, _features(text, k, s, e)) for k, s, e in base]
    out += [(k, s, e, False, f) for k, s, e, b, f in propose(text) if not b and (f[11] or f[12] or f[13] or covered.touch(s, e))]
    places = [(k, s, e, True, _disguised(rng, k, text[s:e])) for k, s, e in base]
    ws = [m for _ in range(64) if (m := _ASCII_WORD.search(text, rng.randrange(len(text)))) and not covered.touch(m.start(), m.end())]
    if ws:
        near = [m[0] for m in ws]
        places += [(k, m.start(), m.end(), False, _ordinary(rng, k, near)) for k, m in zip(range(len(KINDS)), ws, strict=False)]
    for k, s, e, label, new in places:
        # context of the longest kind suffices
        left = max(0, s - 64)
        around, at = text[left:s] + new + text[e:e + 64], s - left
        for kind, x, y, b, f in propose(around):
            if kind == k and not b and x < at + len(new) and at < y:
                out.append((k, s, e, label, f))
                break
    return out


_ASCII_WORD = re.compile(r"\b[A-Za-z]+\b")


def training_groups(docs: DataFrame, key: str, text: str = "text", seed: int = 5) -> DataFrame:
    """examples() of all documents, equal ones counted: (kind, label, base, held, f, n). One candidate in four is held out."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<kind:int,start:int,end:int,label:boolean,base:boolean,f:array<double>>>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            rows = []
            for t in batch:
                n = len(base_spans(t)) if t else 0  # the first n examples
                rows.append([{"kind": k, "start": s, "end": e, "label": y, "base": i < n, "f": f} for i, (k, s, e, y, f) in enumerate(examples(t, seed))])
            yield pd.Series(rows, dtype=object)
    c = docs.select(key, F.explode(found(F.col(text))).alias("c"))
    held = F.pmod(F.xxhash64(F.lit(seed), F.col(key), "c.kind", "c.start"), F.lit(4)) == 0
    return (c.select("c.kind", F.col("c.label").cast("double").alias("label"), "c.base", held.alias("held"), "c.f")
            .groupBy("kind", "label", "base", "held", "f").agg(F.count("*").cast("double").alias("n")))


def _cuts(groups: DataFrame) -> list[list[float]]:
    """Rising cuts between the bins of each feature, midway between neighbouring values: every value has its bin where there are up to BINS of them, else
    bins hold about equally many examples."""
    v = groups.select("n", F.posexplode("f").alias("feature", "value")).groupBy("feature", "value").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("feature")
    up = own.orderBy("value")
    v = v.withColumns({"_values": F.count("*").over(own), "_all": F.sum("n").over(own), "_rank": F.row_number().over(up), "_upto": F.sum("n").over(up)})
    b = F.when(F.col("_values") <= BINS, F.col("_rank").cast("long")).otherwise(F.floor((F.col("_upto") - F.col("n")) * BINS / F.col("_all")))
    ends = v.groupBy("feature", b.alias("bin")).agg(F.min("value").alias("first"), F.max("value").alias("last"))
    cuts = [[] for _ in range(N_FEATURES)]
    for r in ends.withColumn("next", F.lead("first").over(own.orderBy("bin"))).where("next IS NOT NULL").orderBy("feature", "bin").collect():
        cuts[r["feature"]].append((r["last"] + r["next"]) / 2)
    return cuts


def train(docs: DataFrame, key: str, text: str = "text", seed: int = 5) -> tuple[list, list[float]]:
    """Boosted trees and a threshold for each kind, from examples() of all documents. The trees see the bins of the features, so equal examples are one row with its
    weight. The scores of held-out candidates that aren't base spans give the smallest threshold that reaches PRECISION, beyond 1e8 where none does. Without
    both labels: no trees."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    groups = written(training_groups(docs, key, text, seed), "pii-train")
    if {r[0] for r in groups.where("NOT held").select("label").distinct().collect()} != {0.0, 1.0}:
        return [], [2.0] * len(KINDS)
    cuts = _cuts(groups)
    # the number of cuts below a value
    binned = F.array(*[sum(((F.col("f")[i] > c).cast("int") for c in cuts[i]), F.lit(0)).cast("double") for i in range(N_FEATURES)])
    learnt = written(groups.where("NOT held").select("label", "n", binned.alias("f")).groupBy("label", "f").agg(F.sum("n").alias("n")), "pii-learnt")
    # Spark looks for splits in about maxBins squared rows: with so many it leaves none out
    gbt = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, maxBins=2 ** 15, seed=seed, weightCol="n")
    model = gbt.fit(learnt.select("label", "n", array_to_vector("f").alias("features")))
    trees = list(zip([_tree(t._call_java("rootNode"), cuts) for t in model.trees], model.treeWeights, strict=True))
    held = groups.where("held AND NOT base").select("kind", "n", "label", margin(trees)(F.col("f")).alias("m")).groupBy("kind", "m").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("good"))
    down = Window.partitionBy("kind").orderBy(F.desc("m"))
    reach = held.withColumns({"_n": F.sum("n").over(down), "_good": F.sum("good").over(down)}).where(F.col("_good") >= PRECISION * F.col("_n"))
    least = {r["kind"]: r["m"] for r in reach.groupBy("kind").agg(F.min("m").alias("m")).collect()}
    return trees, [least.get(k, 1e9) for k in range(len(KINDS))]


def _tree(node, cuts: list[list[float]]) -> tuple:
    if node.numDescendants() == 0:
        return (node.prediction(),)
    split = node.split()
    # bins up to a whole number are the values up to its cut
    return split.featureIndex(), cuts[split.featureIndex()][int(split.threshold())], _tree(node.leftChild(), cuts), _tree(node.rightChild(), cuts)


def margin(trees: list):
    """The weighted sum of the trees as a column expression over an array of features."""
    def value(t, f: Column) -> Column:
        if len(t) == 1:
            return F.lit(float(t[0]))
        return F.when(f[t[0]] <= t[1], value(t[2], f)).otherwise(value(t[3], f))

    def total(f: Column) -> Column:
        out = F.lit(0.0)
        for t, w in trees:
            out = out + value(t, f) * F.lit(float(w))
        return out
    return total


def find(docs: DataFrame, model: tuple[list, list[float]], text: str = "text") -> DataFrame:
    """Adds base and spans, arrays of (kind, start, end) in code points, end exclusive, by kind, then start; kind numbers KINDS. spans holds base and the
    candidates that the trees accept; they may overlap. Null and empty texts give empty arrays; repeated rows are searched each; extra
    columns stay, but those named base, spans, candidates are replaced."""
    kept = [c for c in docs.columns if c not in ("base", "spans", "candidates")]
    trees, thresholds = model
    d = with_candidates(docs.select(*kept), text)
    plain = lambda c: F.struct(c["kind"], c["start"], c["end"])
    base = F.sort_array(F.transform(F.filter("candidates", lambda c: c["base"]), plain))
    if not trees:
        return d.withColumn("base", base).withColumn("spans", F.col("base")).select(*kept, "base", "spans")
    least = F.array(*[F.lit(float(t)) for t in thresholds])
    score = margin(trees)
    chosen = F.filter("candidates", lambda c: c["base"] | (score(c["f"]) >= F.element_at(least, c["kind"] + 1)))
    return d.withColumn("base", base).withColumn("spans", F.sort_array(F.transform(chosen, plain))).select(*kept, "base", "spans")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span (column spans of find()) by the name of its kind in brackets; overlapping spans become one, named by the first."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(texts, spans, strict=True):
            if t is None or ss is None or len(ss) == 0:
                out.append(t)
                continue
            pieces, at = [], 0
            for s, e, k in sorted((x["start"], x["end"], x["kind"]) for x in ss):
                if s >= at:
                    pieces += [t[at:s], f"[{KINDS[k].upper()}]"]
                at = max(at, e)
            out.append("".join([*pieces, t[at:]]))
        return pd.Series(out, dtype=object)
    return docs.withColumn(text, F.when(F.size("spans") > 0, cleaned(F.col(text), F.col("spans"))).otherwise(F.col(text)))


def digest_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
