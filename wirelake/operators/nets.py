"""Wire fragments and symbol boxes -> nets, terminals, components.

Tables: hits(image_id, det_idx, side, frag) says which fragment touches which side of a symbol;
detections(image_id, det_idx, cls, rotation, x1..y2, txt); symbols are detections with their hits as an array (side, frag)."""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import boxes as B, symbols as S
from ..session import cut, in_place, spread
from ..vocabulary import ELEMENT_DEFAULT, ELEMENT_PREFIX, OPPOSITE, SIDES
from .components import connected
from .matching import attach_values
from .ranking import numbered

C = F.col


def crossover_edges(hits: DataFrame, detections: DataFrame) -> DataFrame:
    """Fragments on opposite sides of a crossover belong together: edges from the lowest to the others."""
    x = detections.filter("cls = 'crossover'").select("image_id", "det_idx")
    axis = F.when(C("side").isin("left", "right"), "h").otherwise("v")
    d = hits.join(x, ["image_id", "det_idx"]).withColumn("axis", axis)
    low = d.groupBy("image_id", "det_idx", "axis").agg(F.min("frag").alias("u"))
    return d.join(low, ["image_id", "det_idx", "axis"]).filter("frag <> u").select("image_id", "u", C("frag").alias("v")).distinct()


def net_numbers(components: DataFrame) -> DataFrame:
    """Nets numbered from 1 in the order of their lowest fragment: (image_id, frag, net)."""
    roots = numbered(components.select("image_id", "root").distinct(), ["image_id"], ["root"], "net")
    return components.join(roots, ["image_id", "root"]).select("image_id", C("node").alias("frag"), "net")


def net_table(hits: DataFrame, detections: DataFrame) -> DataFrame:
    """(image_id, frag, net) of tables that are read more than once."""
    nodes = hits.select("image_id", C("frag").alias("node")).distinct()
    return net_numbers(connected(nodes, crossover_edges(hits, detections)))


def side_order(positive: Column, wide: Column) -> Column:
    """The sides in order: positive first if known, else along the longer direction of the box."""
    arr = lambda xs: F.array(*map(F.lit, xs))
    known = F.lit(None).cast("array<string>")
    for p in SIDES:
        order = [p, OPPOSITE[p]] + [s for s in SIDES if s not in (p, OPPOSITE[p])]
        known = F.when(positive == p, arr(order)).otherwise(known)
    return F.coalesce(known, F.when(wide, arr(["left", "right", "top", "bottom"])).otherwise(arr(["top", "bottom", "left", "right"])))


def side_rank(side: Column, positive: Column, wide: Column) -> Column:
    return F.array_position(side_order(positive, wide), side)


def terminals(hits: DataFrame, detections: DataFrame, nets: DataFrame) -> DataFrame:
    """Distinct nets of every symbol in terminal order, as an array (a symbol touches few fragments)."""
    det = detections.filter(~C("cls").isin("crossover", "text", "junction"))
    wide = (C("x2") - C("x1")) >= (C("y2") - C("y1"))
    rank = side_rank(C("side"), S.positive_side(C("cls"), C("rotation")), wide)
    d = hits.join(det, ["image_id", "det_idx"]).join(nets, ["image_id", "frag"]).withColumn("rank", rank)
    rows = F.array_sort(F.collect_list(F.struct("rank", "frag", "net")))
    t = d.groupBy("image_id", "det_idx").agg(F.array_distinct(F.transform(rows, lambda x: x["net"])).alias("nets"))
    return det.join(t, ["image_id", "det_idx"], "left").withColumn("nets", F.coalesce("nets", F.array().cast("array<bigint>")))


RULES = {"symbol": "symbol", "source": "implicit: first source, second terminal", "degree": "implicit: most connected net", "none": "none"}


def ground_rule(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(image_id, rule) and the nets that become node 0."""
    gnd = terms.filter("cls = 'gnd'").select("image_id", F.explode("nets").alias("net")).distinct()
    src = terms.filter((C("cls") == "voltage_source") & (F.size("nets") == 2)).groupBy("image_id").agg(
        F.min_by(F.get("nets", F.lit(1)), "det_idx").alias("src_net"))
    el = terms.filter(C("cls").isin(*ELEMENT_PREFIX)).select("image_id", "det_idx", F.posexplode("nets").alias("pos", "net"))
    deg = el.groupBy("image_id", "net").agg(F.count("*").alias("n"), F.min(F.struct("det_idx", "pos")).alias("seen"))
    top = deg.groupBy("image_id").agg(F.min_by("net", F.struct((-C("n")).alias("n"), "seen")).alias("top_net"))
    has = gnd.select("image_id", F.lit(True).alias("has_gnd")).distinct()
    images = terms.select("image_id").distinct()
    d = images.join(has, "image_id", "left").join(src, "image_id", "left").join(top, "image_id", "left")
    rule = F.when(C("has_gnd"), RULES["symbol"]).when(C("src_net").isNotNull(), RULES["source"]) \
            .when(C("top_net").isNotNull(), RULES["degree"]).otherwise(RULES["none"])
    d = d.withColumn("rule", rule)
    implicit = d.filter("has_gnd IS NULL").select("image_id", F.coalesce("src_net", "top_net").alias("net")).filter("net IS NOT NULL")
    return d.select("image_id", "rule"), gnd.unionByName(implicit)


def components(terms: DataFrame) -> DataFrame:
    """Elements with running reference names and their nets, ground nets replaced by 0, plus the rule."""
    terms = spread(cut(terms), "image_id")
    rules, zero = ground_rule(terms)
    el = terms.filter(C("cls").isin(*ELEMENT_PREFIX)).withColumn("prefix", F.try_element_at(S.literal_map(ELEMENT_PREFIX), C("cls")))
    pos = el.select("image_id", "det_idx", F.posexplode("nets").alias("pos", "net"))
    el = numbered(el, ["image_id", "prefix"], ["det_idx"], "no").withColumn("ref", F.concat("prefix", C("no").cast("string")))
    pos = pos.join(zero.withColumn("zero", F.lit(0).cast("long")), ["image_id", "net"], "left")
    node = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("zero", "net").alias("node"))))
    nodes = pos.groupBy("image_id", "det_idx").agg(F.transform(node, lambda x: x["node"]).alias("nodes"))
    d = el.drop("nets").join(nodes, ["image_id", "det_idx"], "left").join(rules, "image_id")
    return d.select("image_id", "det_idx", "ref", "cls", F.coalesce("nodes", F.array().cast("array<bigint>")).alias("nets"), "rule")


# ---- images as rows of arrays ----
#: images of up to so many detections are one row, and fragments, nets, ground and references are settled inside it; larger ones go through the joins above
FEW_SYMBOLS = 64
NO_TERMINALS = ("crossover", "text", "junction")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once though f uses it for each element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def few_and_many(symbols: DataFrame, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Symbols of images of up to FEW_SYMBOLS, and of the others (None: there is none). Rows without an image belong nowhere. images(image_id) may be a
    cheaper table with as many rows of each image."""
    d = symbols.filter("image_id IS NOT NULL")
    sizes = (d if images is None else images).groupBy("image_id").agg(F.count("*").alias("n"))
    many = cut(sizes.filter(C("n") > FEW_SYMBOLS).select("image_id"))
    if many.isEmpty():
        return d, None
    return d.join(F.broadcast(many), "image_id", "left_anti"), d.join(many, "image_id", "left_semi")


def image_terminals(symbols: DataFrame) -> DataFrame:
    """terminals() with one row for each image: (image_id, terms: det_idx, cls, nets by det_idx). Where the symbols are dealt by image nothing is shuffled."""
    horizontal = lambda h: F.coalesce(h["side"].isin("left", "right"), F.lit(False))
    wide = (C("x2") - C("x1")) >= (C("y2") - C("y1"))
    symbols = symbols.withColumn("_plus", S.positive_side(C("cls"), C("rotation")))
    at = F.filter(F.coalesce("hits", F.array().cast(symbols.schema["hits"].dataType)), lambda h: h["frag"].isNotNull())
    ranked = _let(side_order(C("_plus"), wide), lambda order: F.transform(at, lambda h: F.struct(F.array_position(order, h["side"]).alias("rank"), h["frag"].alias("frag"))))
    frags = F.transform(F.sort_array(ranked), lambda x: x["frag"])

    def edges(along):
        on_axis = F.transform(F.filter(at, along), lambda h: h["frag"])
        return _let(on_axis, lambda fs: _let(F.array_min(fs), lambda low: F.transform(
            F.filter(fs, lambda f: f != low), lambda f: F.struct(low.alias("u"), f.alias("v")))))
    crossed = F.when(C("cls") == "crossover", F.concat(edges(horizontal), edges(lambda h: ~horizontal(h))))
    d = symbols.select("image_id", F.struct("det_idx", "cls", frags.alias("frags"), crossed.alias("edges")).alias("s"))
    d = d.groupBy("image_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    d = d.select("image_id", "s", F.array_distinct(F.flatten("s.frags")).alias("nodes"), F.flatten(F.array_compact("s.edges")).alias("edges"))

    # the lowest fragment of each fragment's component: an edge gives the higher of two roots the lower one
    def merge(roots, e):
        a, b = roots[e["u"]], roots[e["v"]]
        return _let(F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")), lambda p: F.transform_values(
            roots, lambda _, r: F.when(r == p["high"], p["low"]).otherwise(r)))
    d = d.select("image_id", "s", F.aggregate("edges", F.map_from_arrays("nodes", "nodes"), merge).alias("roots"))
    number = _let(F.sort_array(F.array_distinct(F.map_values("roots"))), lambda order: F.transform_values("roots", lambda _, r: F.array_position(order, r)))
    parts = F.filter("s", lambda s: ~s["cls"].isin(*NO_TERMINALS))
    terms = _let(number, lambda net: F.transform(parts, lambda s: F.struct(
        s["det_idx"].alias("det_idx"), s["cls"].alias("cls"), F.array_distinct(F.transform(s["frags"], lambda f: net[f])).alias("nets"))))
    return d.select("image_id", terms.alias("terms")).filter(F.size("terms") > 0)


def image_ground(images: DataFrame) -> DataFrame:
    """ground_rule() of image_terminals(): adds rule and zero, the nets that become node 0."""
    of = lambda keep: F.filter("terms", keep)
    nets = lambda terms: F.flatten(F.transform(terms, lambda t: t["nets"]))
    source = of(lambda t: (t["cls"] == "voltage_source") & (F.size(t["nets"]) == 2))
    # nets in the order in which elements meet them; the first of the most frequent ones
    top = _let(nets(of(lambda t: t["cls"].isin(*ELEMENT_PREFIX))), lambda ends: F.array_min(F.transform(
        F.array_distinct(ends), lambda n, i: F.struct((-F.size(F.filter(ends, lambda e: e == n))).alias("a"), i.alias("b"), n.alias("net")))))
    d = images.select("*", F.array_distinct(nets(of(lambda t: t["cls"] == "gnd"))).alias("gnd"),
                      F.get(F.get(source, F.lit(0))["nets"], F.lit(1)).alias("src_net"), top["net"].alias("top_net"))
    has = F.size("gnd") > 0
    rule = F.when(has, RULES["symbol"]).when(C("src_net").isNotNull(), RULES["source"]) \
            .when(C("top_net").isNotNull(), RULES["degree"]).otherwise(RULES["none"])
    zero = F.when(has, C("gnd")).otherwise(F.array_compact(F.array(F.coalesce("src_net", "top_net"))))
    return d.select(*images.columns, rule.alias("rule"), zero.alias("zero"))


def image_components(images: DataFrame) -> DataFrame:
    """components() of image_ground(): one row for each element."""
    prefix = S.literal_map(ELEMENT_PREFIX)
    number = lambda names, t, i: F.size(F.filter(F.slice(names, 1, i + 1), lambda n: n == t["cls"]))
    rows = _let(F.filter("terms", lambda t: t["cls"].isin(*ELEMENT_PREFIX)), lambda el: _let(F.transform(el, lambda t: t["cls"]), lambda names: F.transform(
        el, lambda t, i: F.struct(t["det_idx"].alias("det_idx"), F.concat(F.try_element_at(prefix, t["cls"]), number(names, t, i).cast("string")).alias("ref"),
                                  t["cls"].alias("cls"), t["nets"].alias("nets")))))
    d = images.select("image_id", "rule", "zero", F.explode(rows).alias("c"))
    grounded = F.transform("c.nets", lambda n: F.when(F.array_contains("zero", n), F.lit(0).cast("long")).otherwise(n))
    return d.select("image_id", "c.det_idx", "c.ref", "c.cls", grounded.alias("nets"), "rule")


def _terminals_by_rows(symbols: DataFrame) -> DataFrame:
    d = cut(symbols)
    hits = d.select("image_id", "det_idx", F.explode("hits").alias("h")).select("image_id", "det_idx", "h.side", "h.frag").filter("frag IS NOT NULL")
    det = d.drop("hits").filter("cls IS NOT NULL")
    return terminals(hits, det, net_table(hits, det))


def symbol_grounds(symbols: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Rule of each image and the nets that become node 0: (image_id, rule, zero)."""
    few, many = few_and_many(symbols, images)
    d = image_ground(image_terminals(few)).select("image_id", "rule", "zero")
    if many is None:
        return d
    rules, zero = ground_rule(cut(_terminals_by_rows(many)))
    z = zero.groupBy("image_id").agg(F.collect_list("net").alias("zero"))
    return d.unionByName(rules.join(z, "image_id", "left").withColumn("zero", F.coalesce("zero", F.array().cast("array<bigint>"))))


def symbol_components(symbols: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """components() of symbols."""
    few, many = few_and_many(symbols, images)
    d = image_components(image_ground(image_terminals(few)))
    return d if many is None else d.unionByName(components(_terminals_by_rows(many)))


def trace(hits: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections and fragment hits -> components with references, nets, values and the ground rule."""
    return trace_written(cut(hits), cut(detections))


def trace_written(hits: DataFrame, detections: DataFrame) -> DataFrame:
    """trace() of written tables. Hits, symbols and terminals are dealt by image once; all steps from fragments to components join them in place."""
    vals = attach_values(detections.withColumn("idx", C("det_idx"))).select("image_id", C("element_idx").alias("det_idx"), "value")
    with in_place(hits.sparkSession):
        h, det = spread(hits, "image_id"), spread(detections, "image_id")
        comps = components(terminals(h, det, net_table(h, det)))
        return cut(comps.join(vals, ["image_id", "det_idx"], "left"))


def element_lines(comps: DataFrame) -> DataFrame:
    """Element lines (section 2) and warnings (section 4) of a netlist text as rows (image_id, section, ord, line)."""
    val = F.coalesce("value", F.try_element_at(S.literal_map(ELEMENT_DEFAULT), C("cls")))
    two = F.size("nets") == 2
    net = lambda k: F.get("nets", F.lit(k)).cast("string")
    line = F.when(two, F.concat_ws(" ", "ref", net(0), net(1), val)).otherwise(
        F.concat(F.lit("* WARNING "), "ref", F.lit(": found "), F.size("nets").cast("string"), F.lit(" terminals ["),
                 F.concat_ws(", ", C("nets").cast("array<string>")), F.lit("], skipped")))
    return comps.select("image_id", F.when(two, 2).otherwise(4).alias("section"), C("det_idx").alias("ord"), line.alias("line"))


def netlist_lines(comps: DataFrame, title: Column, note: Column) -> DataFrame:
    """Netlist text as rows (image_id, section, ord, line): title, note, elements, model, warnings, trailer."""
    two = F.size("nets") == 2
    per = comps.groupBy("image_id").agg(F.max(two & (C("cls") == "diode")).alias("model"), F.first("rule").alias("rule"))
    frame = F.array_compact(F.array(
        F.struct(F.lit(0).alias("section"), F.concat(F.lit("* "), title).alias("line")),
        F.struct(F.lit(1).alias("section"), F.concat(F.lit("* "), note).alias("line")),
        F.when(C("model"), F.struct(F.lit(3).alias("section"), F.lit(".model DMOD D").alias("line"))),
        F.struct(F.lit(5).alias("section"), F.lit(".op").alias("line")), F.struct(F.lit(6).alias("section"), F.lit(".end").alias("line"))))
    head = per.select("image_id", F.explode(frame).alias("f")).select("image_id", "f.section", F.lit(0).cast("long").alias("ord"), "f.line")
    return head.unionByName(element_lines(comps))


def warnings(comps: DataFrame, detections: DataFrame, doubles: DataFrame, low: float = 0.5) -> DataFrame:
    """What a reader must check: rows (image_id, kind, ord, text)."""
    two = F.size("nets") == 2
    default = F.try_element_at(S.literal_map(ELEMENT_DEFAULT), C("cls"))
    text = (F.when(~two, F.concat("ref", F.lit(" was left out: "), F.size("nets").cast("string"), F.lit(" wire ends were found at it instead of 2.")))
            .when(C("value").isNull() & (C("cls") != "diode"), F.concat("ref", F.lit(": no value label was read; the default "), default, F.lit(" was used.")))
            .when(C("value").isNotNull(), F.concat("ref", F.lit(" = "), "value", F.lit(": read from a handwritten label by OCR; check it against the drawing (e.g. a '+' is easily read as '4')."))))
    part = comps.select("image_id", F.when(two, 1).otherwise(0).alias("kind"), C("det_idx").alias("ord"), text.alias("text")).filter("text IS NOT NULL")
    ground = comps.select("image_id", "rule").distinct().filter(C("rule").startswith("implicit")).select(
        "image_id", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("ord"),
        F.concat(F.lit("No ground symbol: ground was chosen automatically ("), "rule", F.lit(").")).alias("text"))
    twice = doubles.select("image_id", F.lit(3).alias("kind"), (C("l_det_idx") * 2 ** 31 + C("r_det_idx")).cast("long").alias("ord"), F.concat(
        F.lit("One symbol was detected as both "), "l_cls", F.format_string(" (%.2f) and ", "l_conf"), "r_cls", F.format_string(" (%.2f)", "r_conf"),
        F.lit("; one of them is wrong, so the netlist has an extra part.")).alias("text"))
    weak = detections.filter((C("conf") < low) & ~C("cls").isin("junction", "crossover", "text")).select("image_id").distinct().select(
        "image_id", F.lit(4).alias("kind"), F.lit(0).cast("long").alias("ord"),
        F.lit(f"Some parts were detected with confidence below {low}; check them on the overlay.").alias("text"))
    return part.unionByName(ground).unionByName(twice).unionByName(weak)


def same_partition(terms: DataFrame, key: list[str]) -> DataFrame:
    """Per key: do predicted and true labels of the terminals agree up to renaming? terms holds one row
    per terminal with pred and true; a NULL on one side means the terminal exists only on the other."""
    one = lambda a, b: terms.groupBy(*key, a).agg((F.min(b).eqNullSafe(F.max(b)) & (F.count(b) == F.count("*"))).alias("u")) \
        .groupBy(*key).agg(F.bool_and("u").alias("ok_" + a))
    return one("pred", "true").join(one("true", "pred"), key).select(*key, (C("ok_pred") & C("ok_true")).alias("same"))


def extraction_benchmark(terms: DataFrame, extract, circuits: list[str]) -> DataFrame:
    """Score any extractor (DataFrame -> DataFrame adding `pred`): exact rate per condition and circuit."""
    ok = same_partition(terms.transform(extract), ["condition", "circuit", "seed"])
    d = ok.groupBy("condition").pivot("circuit", circuits).agg(F.avg(C("same").cast("double")))
    mean = sum((F.coalesce(C(c), F.lit(0.0)) for c in circuits), F.lit(0.0)) / sum((C(c).isNotNull().cast("int") for c in circuits), F.lit(0))
    return d.withColumn("mean", mean)
