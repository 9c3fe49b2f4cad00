"""Text normalisation and error wording as column expressions."""
from pyspark.sql import Column, functions as F

from ..vocabulary import ERROR_HINTS, NUMERIC_TOKEN, SPELLED_KILO, SPELLED_MEGA, TOKEN

UNICODE = "(?U)"


def tokens(text: Column) -> Column:
    """All tokens of the whole text, in order."""
    t = F.regexp_replace(text, UNICODE + SPELLED_MEGA, "$1M ohm")
    t = F.regexp_replace(t, UNICODE + SPELLED_KILO, "$1k ohm")
    return F.regexp_extract_all(F.replace(t, F.lit("Ω"), F.lit(" ohm")), F.lit(UNICODE + TOKEN), F.lit(0))


def word_shape(token: Column) -> Column:
    return F.when(token.rlike(NUMERIC_TOKEN), "<NUM>").otherwise("<UNK>")


def label_text(s: Column) -> Column:
    """Drawn label for comparison: no ohm sign, lower case, no white space, no 'ohm'."""
    t = F.lower(F.replace(F.coalesce(s, F.lit("")), F.lit("Ω"), F.lit("")))
    return F.replace(F.regexp_replace(t, r"\s+", ""), F.lit("ohm"), F.lit(""))


def character_accuracy(pred: Column, gold: Column) -> Column:
    p, g = label_text(pred), label_text(gold)
    return F.when(F.length(g) == 0, (p == g).cast("double")) \
            .otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(p, g) / F.length(g)))


def error_template(message: Column) -> Column:
    return F.regexp_replace(message, r"\d+", "N")


def explained(message: Column) -> Column:
    hint = F.lit("")
    for key, text in reversed(ERROR_HINTS):
        hint = F.when(F.instr(message, key) > 0, f"  ({text})").otherwise(hint)
    return F.concat(message, hint)
