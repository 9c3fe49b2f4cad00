"""Component values: drawn labels, sentence values, netlist numbers.

The drawn-label rules are case-sensitive and the sentence rules mostly are not,
so the two stay separate."""
from pyspark.sql import Column, functions as F

from ..vocabulary import (DRAWN_LETTER_POINT, DRAWN_R_SUFFIX, DRAWN_VALUE, NETLIST_NUMBER, PREFIX_LETTER, SUFFIX_FACTOR,
                          TEXT_LETTER_POINT, TEXT_R_SUFFIX, TEXT_VALUE, TEXT_VALUE_HEAD, UNIT_CLASS)
from .symbols import literal_map


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(text, pattern, k)


def _mapped(d: dict, c: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(d), c), c)


def drawn_value(text: Column) -> Column:
    """Struct(value, cls) of a label beside a symbol; both NULL when it is not a value."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), ",", "."), r"^[+ ]+", "")
    plain, point = t.rlike(DRAWN_VALUE), t.rlike(DRAWN_LETTER_POINT)
    unit = lambda p, k: F.try_element_at(
        literal_map(UNIT_CLASS), F.when(_group(t, p, k) == "Ω", F.lit("Ω")).otherwise(F.lower(_group(t, p, k))))
    make = lambda v, c: F.struct(v.alias("value"), c.alias("cls"))
    return (F.when(t.rlike(DRAWN_R_SUFFIX), make(_group(t, DRAWN_R_SUFFIX, 1), F.lit("resistor")))
            .when(point, make(F.concat(_group(t, DRAWN_LETTER_POINT, 1), F.lit("."), _group(t, DRAWN_LETTER_POINT, 3),
                                       _mapped(PREFIX_LETTER, _group(t, DRAWN_LETTER_POINT, 2))),
                              unit(DRAWN_LETTER_POINT, 4)))
            .when(plain, make(F.concat(_group(t, DRAWN_VALUE, 1), _mapped(PREFIX_LETTER, _group(t, DRAWN_VALUE, 2))),
                              unit(DRAWN_VALUE, 3)))
            .otherwise(make(F.lit(None).cast("string"), F.lit(None).cast("string"))))


def sentence_value(text: Column, cls: Column) -> Column:
    """Netlist value of a number in a sentence, or NULL when the text is not wholly a value."""
    t = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    lead = F.when(cls == "voltage_source", "DC ").otherwise("")
    suffix = _group(t, TEXT_VALUE_HEAD, 2)
    suffix = F.when(suffix == "M", "meg").otherwise(
        F.coalesce(F.try_element_at(literal_map({"µ": "u", "μ": "u", "K": "k", "G": "g"}), suffix), F.lower(suffix)))
    return (F.when(t.rlike(TEXT_R_SUFFIX), F.when(cls == "resistor", _group(t, TEXT_R_SUFFIX, 1)))
            .when(t.rlike(TEXT_LETTER_POINT),
                  F.concat(lead, _group(t, TEXT_LETTER_POINT, 1), F.lit("."), _group(t, TEXT_LETTER_POINT, 3),
                           _mapped(PREFIX_LETTER, _group(t, TEXT_LETTER_POINT, 2))))
            .when(t.rlike(TEXT_VALUE), F.concat(lead, _group(t, TEXT_VALUE_HEAD, 1), suffix)))


def unit_class(text: Column) -> Column:
    """Class implied by the unit or multiplier of a value, or NULL."""
    t = F.replace(text, F.lit(" "), F.lit(""))
    letter = F.lower(F.substring(_group(t, TEXT_LETTER_POINT, 4), 1, 1))
    by_letter = F.try_element_at(literal_map({"f": "capacitor", "h": "inductor", "v": "voltage_source"}), letter)
    small = _group(t, TEXT_LETTER_POINT, 2).isin(*"pnuµμ")
    big = _group(t, TEXT_LETTER_POINT, 2).isin(*"kKMGR")
    has_head = text.rlike(TEXT_VALUE_HEAD)
    tail = F.when(has_head, F.lower(F.regexp_replace(text, TEXT_VALUE_HEAD, ""))).otherwise("")
    mult = F.lower(_group(text, TEXT_VALUE_HEAD, 2))
    return (F.when(t.rlike(TEXT_R_SUFFIX), "resistor")
            .when(t.rlike(TEXT_LETTER_POINT),
                  F.coalesce(by_letter, F.when(small, "capacitor").when(big, "resistor")))
            .when(tail.startswith("ohm"), "resistor").when(tail.startswith("f"), "capacitor")
            .when(tail.startswith("h"), "inductor").when(tail.startswith("v"), "voltage_source")
            .when(has_head & mult.isin("k", "meg"), "resistor"))


def netlist_number(value: Column) -> Column:
    """Struct(num, txt): engineering notation as a number, anything else as upper-case text."""
    v = F.trim(value)
    t = F.trim(F.regexp_replace(F.lower(v), "^dc", ""))
    factor = F.coalesce(F.try_element_at(literal_map(SUFFIX_FACTOR), _group(t, NETLIST_NUMBER, 2)), F.lit(1.0))
    is_num = t.rlike(NETLIST_NUMBER)
    return F.struct(F.when(is_num, F.nullif(_group(t, NETLIST_NUMBER, 1), F.lit("")).cast("double") * factor).alias("num"),
                    F.when(~is_num, F.upper(v)).alias("txt"))


def six_digits(num: Column) -> Column:
    return F.format_string("%.6g", num).cast("double")


def value_label(prefix: Column, num: Column, txt: Column, values: bool = True) -> Column:
    """Comparison label of an element: its prefix, with the rounded value when asked."""
    if not values:
        return prefix
    return F.concat_ws("|", prefix, F.when(num.isNotNull(), six_digits(num).cast("string")), txt)
