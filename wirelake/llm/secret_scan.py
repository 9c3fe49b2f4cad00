"""Secrets in text: fixed patterns, and a character model. Two Markov chains of characters, one of random strings and one of
ordinary identifiers, give every long token a log-likelihood ratio; a token well on the random side is a secret.
Column functions only."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, prefix_sums

# fixed patterns of the base kinds, in their order
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "random")

#: what the character model judges: whole runs of these characters of this length and more
TOKEN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}+"
ALPHABET = 128
#: nats by which a token has to be likelier as a random string; about the log of the ratio of ordinary long tokens to secrets
MIN_LLR = 10.0
#: bound of the training sample: documents whose tokens are the labelled rows
TRAIN_DOCS = 4_000


def _places(text: str, pattern: str, wanted: Column, kind: int, group: int | None = None, least: int = 0) -> dict[str, Column]:
    """Columns for the leftmost matches of pattern: the pieces between them give their places."""
    none = F.array().cast("array<string>")
    out = {f"m{kind}": F.when(wanted, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none),
           f"g{kind}": F.when(wanted, F.split(text, pattern)).otherwise(none)}
    if group is not None:
        out[f"v{kind}"] = F.when(wanted, F.regexp_extract_all(text, F.lit(pattern), group)).otherwise(none)
    return out


def _with_starts(df: DataFrame, kind: int) -> DataFrame:
    steps = F.zip_with(F.slice(f"g{kind}", 1, F.size(f"m{kind}")), f"m{kind}", lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
    return df.withColumn(f"l{kind}", steps).withColumn(f"s{kind}", prefix_sums(F.col(f"l{kind}")))


def _spans(kind: int) -> Column:
    """Array of (start, kind, end, value) in code points, end exclusive."""
    at = F.arrays_zip(F.col(f"s{kind}").alias("s"), F.slice(f"g{kind}", 1, F.size(f"m{kind}")).alias("g"), F.col(f"m{kind}").alias("m"))
    return F.transform(at, lambda x: F.struct(
        (x["s"] + F.length(x["g"])).alias("start"), F.lit(kind).alias("kind"), (x["s"] + F.length(x["g"]) + F.length(x["m"])).alias("end"), x["m"].alias("value")))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base: the spans of the fixed patterns, sorted by start, then kind. Null text has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    named = F.lit(False)
    for w in ASSIGN_WORDS:
        named = named | F.contains(low, F.lit(w))
    kept = docs.columns
    d = docs.withColumn("_text", t)
    d = d.withColumns(_places("_text", ASSIGN, named, 0, 2) | _places("_text", ACCESS, F.contains(t, F.lit("AKIA")), 1)
                      | _places("_text", HEX, F.rlike(t, F.lit(HEX)), 2))
    for k in range(3):
        d = _with_starts(d, k)
    long_enough = F.filter(F.arrays_zip(_spans(0).alias("a"), F.col("v0").alias("v")), lambda x: F.length(x["v"]) >= 6)
    base = F.sort_array(F.concat(F.transform(long_enough, lambda x: x["a"]), _spans(1), _spans(2)))
    return d.withColumn("base", base).select(*kept, "base")


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds tokens: the spans of all long runs, as candidates of the character model."""
    kept = docs.columns
    d = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    d = _with_starts(d.withColumns(_places("_text", TOKEN, F.rlike("_text", F.lit(TOKEN)), 3)), 3)
    return d.withColumn("tokens", _spans(3)).select(*kept, "tokens")


def labelled_tokens(docs: DataFrame, key: str, text: str = "text", rows: int = TRAIN_DOCS) -> DataFrame:
    """(token, label) from at most `rows` documents. Label 1: values that the fixed patterns find, and for every ordinary token the
    digest of it in hex, base 64 or capitals. Label 0: words of four letters and more, plain and joined to identifiers, and
    long tokens outside the fixed patterns."""
    d = tokens(base_spans(bounded_sample(docs.select(key, text), key, rows), text), text)
    found = d.select(F.explode(F.transform("base", lambda b: b["value"])).alias("token"))
    plain = d.select(F.explode(F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))).alias("t")).select(F.col("t.value").alias("token"))
    word = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[A-Za-z]{4,}"), 0)
    # three words from the middle of a document, joined in five ways
    words = (d.select(word.alias("w")).where(F.size("w") >= 3).select(F.slice("w", (F.size("w") / 2).cast("int"), 3).alias("w"))
             .select(F.explode(F.concat(F.col("w"), F.array(*[F.array_join("w", s) for s in ("_", "-", "/", ".")]),
                                        F.array(F.array_join(F.transform("w", F.initcap), "")))).alias("token")))
    # prose is left out: a token with a sentence's full stop inside is two words
    ordinary = plain.unionByName(words)
    digest = F.unhex(F.sha2("token", 512))
    made = ordinary.select(F.explode(F.array(F.lower(F.substring(F.hex(digest), 1, 32)), F.substring(F.base64(digest), 1, 32),
                                             F.substring(F.upper(F.regexp_replace(F.base64(digest), "[^A-Za-z0-9]", "")), 1, 24))).alias("token"))
    return ordinary.withColumn("label", F.lit(0)).unionByName(found.unionByName(made).withColumn("label", F.lit(1)))


def train(samples: DataFrame) -> list[float]:
    """Log ratio of the two chains for each pair of characters, 128 x 128 values: probability of the second character after the first,
    counts plus one half, among random strings over ordinary ones. All zero without samples of both labels."""
    n = F.length("token")
    pairs = (samples.where((n >= 2) & F.col("token").isNotNull())
             .select("label", "token", F.explode(F.sequence(F.lit(1), n - 1)).alias("i"))
             .select("label", F.ascii(F.expr("substring(token, i, 1)")).alias("a"), F.ascii(F.expr("substring(token, i + 1, 1)")).alias("b"))
             .where((F.col("a") < ALPHABET) & (F.col("b") < ALPHABET)))
    counts = pairs.groupBy("label", "a", "b").count().collect()  # at most 2 x 128 x 128 rows
    import math
    table = {0: {}, 1: {}}
    rows = {0: {}, 1: {}}
    for label, a, b, c in counts:
        table[label][a, b] = c
        rows[label][a] = rows[label].get(a, 0) + c
    if not rows[0] or not rows[1]:
        return [0.0] * (ALPHABET * ALPHABET)
    # 68 characters occur in tokens: smoothing is over these

    def p(label, a, b):
        return math.log((table[label].get((a, b), 0) + 0.5) / (rows[label].get(a, 0) + 34.0))
    return [round(p(1, a, b) - p(0, a, b), 4) for a in range(ALPHABET) for b in range(ALPHABET)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token column. The model is a constant array of fixed size."""
    weights = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.least(F.ascii(c), F.lit(ALPHABET - 1)))
    return F.aggregate(codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), lambda s, c: F.struct(
        c.alias("last"), F.when(s["last"] < 0, F.lit(0.0)).otherwise(s["sum"] + F.element_at(weights, s["last"] * ALPHABET + c + 1)).alias("sum")), lambda s: s["sum"])


def scan(docs: DataFrame, model: list[float], text: str = "text", min_llr: float = MIN_LLR) -> DataFrame:
    """Adds base (spans of the fixed patterns) and spans (these and the random tokens that touch none of them), both arrays of
    (start, kind, end, value) sorted by start, then kind; kind numbers KINDS. Null and empty texts give empty arrays; repeated rows are
    scanned each; extra columns stay, but those named base, spans, tokens are replaced."""
    kept = [c for c in docs.columns if c not in ("base", "spans", "tokens")]
    d = tokens(base_spans(docs.select(*kept), text), text)
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    more = F.filter(free, lambda t: ratio(t["value"], model) >= min_llr)
    return d.withColumn("spans", F.sort_array(F.concat("base", more))).select(*kept, "base", "spans")


def digest_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
