"""Projections, filters, scalar functions on the derived views."""
from pyspark.sql import functions as F

from ..functions import boxes as B, symbols as S, values as V, wording as T
from ..vocabulary import CLASSES, POLARISED
from .fixtures import view
from .registry import query

VAL, TEST = ["drafter_11"], ["drafter_12"]
C = F.col


@query("p1_class_map", "SELECT image_id, obj_idx, label, cls FROM fx_obj LEFT JOIN fx_map ON lab = lower(trim(label))")
def p1(spark, sf):
    return view(spark, sf, "fx_obj").select("image_id", "obj_idx", "label", S.canonical_class(C("label")).alias("cls"))


@query("p2_scope_modes", """
SELECT image_id, obj_idx, label AS raw_cls, coalesce(cls, 'other') AS other_cls, cls AS dropped_cls
FROM fx_obj LEFT JOIN fx_map ON lab = lower(trim(label))""")
def p2(spark, sf):
    return view(spark, sf, "fx_obj").select(
        "image_id", "obj_idx", S.scoped_class(C("label"), raw=True).alias("raw_cls"),
        S.scoped_class(C("label"), keep_other=True).alias("other_cls"), S.scoped_class(C("label")).alias("dropped_cls"))


@query("p3_split", """SELECT photo_id, drafter, CASE drafter WHEN 'drafter_11' THEN 'val' WHEN 'drafter_12' THEN 'test'
ELSE 'train' END AS split FROM fx_photo""")
def p3(spark, sf):
    return view(spark, sf, "fx_photo").select("photo_id", "drafter", S.split_of(C("drafter"), VAL, TEST).alias("split"))


_CLIP = """SELECT *, cx2 - cx1 >= 1 AND cy2 - cy1 >= 1 AS ok FROM (
  SELECT image_id, obj_idx, label, x1, y1, x2, y2, w, h, greatest(0.0, CAST(least(x1, x2) AS DOUBLE)) AS cx1, greatest(0.0, CAST(least(y1, y2) AS DOUBLE)) AS cy1,
         least(CAST(w AS DOUBLE), greatest(x1, x2)) AS cx2, least(CAST(h AS DOUBLE), greatest(y1, y2)) AS cy2 FROM fx_obj)"""


@query("p4_clip_box", f"""SELECT image_id, obj_idx, CASE WHEN ok THEN CAST(cx1 AS DOUBLE) END AS bx1, CASE WHEN ok THEN CAST(cy1 AS DOUBLE) END AS by1,
CASE WHEN ok THEN CAST(cx2 AS DOUBLE) END AS bx2, CASE WHEN ok THEN CAST(cy2 AS DOUBLE) END AS by2 FROM ({_CLIP})""")
def p4(spark, sf):
    d = view(spark, sf, "fx_obj").withColumn("b", B.clip(*B.corners(), C("w"), C("h")))
    return d.select("image_id", "obj_idx", *[C(f"b.{k}").alias(f"b{k}") for k in ("x1", "y1", "x2", "y2")])


@query("p5_normalised_line", f"""SELECT image_id, obj_idx, printf('%d %.6f %.6f %.6f %.6f', cls_id, (cx1 + cx2) / 2 / w, (cy1 + cy2) / 2 / h,
(cx2 - cx1) / w, (cy2 - cy1) / h) AS line FROM ({_CLIP}) JOIN fx_map ON lab = lower(trim(label)) WHERE ok""")
def p5(spark, sf):
    d = (view(spark, sf, "fx_obj").withColumn("b", B.clip(*B.corners(), C("w"), C("h")))
         .withColumn("cls", S.canonical_class(C("label"))).filter("b IS NOT NULL AND cls IS NOT NULL"))
    return d.select("image_id", "obj_idx", B.label_line(S.class_id(C("cls")), C("b"), C("w"), C("h")).alias("line"))


_TURN = "CAST(CAST(round_even({r} / 90, 0) AS BIGINT) * 90 % 360 AS INTEGER)"
_ROT = f"""SELECT *, {_TURN.format(r='deg')} AS rot FROM (
  SELECT *, CASE WHEN label = 'voltage.dc' THEN (try_cast(rotation AS DOUBLE) + 270) % 360 ELSE try_cast(rotation AS DOUBLE) END AS deg FROM fx_obj)"""


@query("p6_rotation_bin", f"SELECT image_id, obj_idx, rot AS rotation_bin, (360 - rot) % 360 AS clockwise_bin FROM ({_ROT})")
def p6(spark, sf):
    return view(spark, sf, "fx_obj").select(
        "image_id", "obj_idx", S.rotation_bin(C("label"), C("rotation")).alias("rotation_bin"),
        S.rotation_bin(C("label"), C("rotation"), clockwise=True).alias("clockwise_bin"))


@query("p7_mirror_flag", """SELECT image_id, obj_idx, CASE WHEN mirror IS NULL THEN NULL
ELSE CAST(lower(trim(mirror)) IN ('1','true','yes','y') AS INTEGER) END AS mirrored FROM fx_obj""")
def p7(spark, sf):
    return view(spark, sf, "fx_obj").select("image_id", "obj_idx", S.mirrored(C("mirror")).cast("int").alias("mirrored"))


@query("p8_positive_side", f"""SELECT image_id, obj_idx, CASE WHEN cls IN ('diode','voltage_source') AND rot IS NOT NULL
THEN (['left','bottom','right','top'])[CAST(rot // 90 % 4 AS INTEGER) + 1] END AS side,
CASE WHEN cls IN ('diode','voltage_source') AND rot IS NOT NULL
THEN (['left','bottom','right','top'])[CAST((3 + rot // 90) % 4 AS INTEGER) + 1] END AS side_plus_top
FROM ({_ROT}) LEFT JOIN fx_map ON lab = lower(trim(label))""")
def p8(spark, sf):
    cls, rot = S.canonical_class(C("label")), S.rotation_bin(C("label"), C("rotation"))
    return view(spark, sf, "fx_obj").select("image_id", "obj_idx", S.positive_side(cls, rot).alias("side"),
                                            S.positive_side(cls, rot, "top").alias("side_plus_top"))


_HDR = """SELECT *, CASE WHEN exif IN (5,6,7,8) THEN raw_h ELSE raw_w END AS sw, CASE WHEN exif IN (5,6,7,8) THEN raw_w ELSE raw_h END AS sh FROM fx_hdr"""
_HDR_COLS = ("raw_w", "raw_h", "exif", "readable", "w", "h")


@query("p9_frame_class", f"""SELECT image_id, CASE WHEN NOT readable THEN 'unreadable' WHEN exif = 1 THEN 'upright'
WHEN sw = w AND sh = h AND raw_w = w AND raw_h = h THEN 'ambiguous' WHEN raw_w = w AND raw_h = h THEN 'raw'
WHEN sw = w AND sh = h THEN 'displayed' ELSE 'mismatch' END AS frame FROM ({_HDR})""")
def p9(spark, sf):
    return view(spark, sf, "fx_hdr").select("image_id", S.frame_class(*map(C, _HDR_COLS)).alias("frame"))


@query("p10_placeholder_size", f"""SELECT image_id, CASE WHEN keep THEN w ELSE sw END AS w, CASE WHEN keep THEN h ELSE sh END AS h,
CAST(NOT keep AS INTEGER) AS placeholder FROM (SELECT *, NOT readable OR (sw = w AND sh = h) OR (raw_w = w AND raw_h = h) AS keep FROM ({_HDR}))""")
def p10(spark, sf):
    d = view(spark, sf, "fx_hdr").select("image_id", S.repaired_size(*map(C, _HDR_COLS)).alias("s"))
    return d.select("image_id", "s.w", "s.h", C("s.placeholder").cast("int").alias("placeholder"))


@query("p11_size_check", f"""SELECT image_id, CASE WHEN NOT readable THEN 'unreadable_image' WHEN sw = w AND sh = h THEN 'xml_matches_displayed'
WHEN raw_w = w AND raw_h = h THEN 'xml_matches_raw_only(EXIF rotated)' ELSE 'xml_size_mismatch' END AS size_check FROM ({_HDR})""")
def p11(spark, sf):
    return view(spark, sf, "fx_hdr").select("image_id", S.size_check(*map(C, _HDR_COLS)).alias("size_check"))


_RAWROT = f"""SELECT *, CASE WHEN rotation IS NULL THEN NULL WHEN deg IS NULL THEN 'unparsable' WHEN abs(off) <= 5 THEN '<=5'
WHEN abs(off) <= 15 THEN '<=15' ELSE '>15' END AS bucket FROM (SELECT *, (deg - bin + 180 + 360) % 360 - 180 AS off FROM (
SELECT *, {_TURN.format(r='deg')} AS bin FROM (SELECT *, try_cast(rotation AS DOUBLE) % 360 AS deg FROM fx_obj)))"""


@query("p12_rotation_offset", f"SELECT image_id, obj_idx, bin, off AS offset_deg, bucket FROM ({_RAWROT})")
def p12(spark, sf):
    f = S.raw_rotation_facts(C("rotation"))
    return view(spark, sf, "fx_obj").select("image_id", "obj_idx", f["bin"].alias("bin"), f["offset"].alias("offset_deg"),
                                            f["offset_bucket"].alias("bucket"))


@query("p13_box_shape", """SELECT image_id, obj_idx, CASE WHEN x2 - x1 > CAST(1.2 AS DOUBLE) * (y2 - y1) THEN 'wide'
WHEN y2 - y1 > CAST(1.2 AS DOUBLE) * (x2 - x1) THEN 'tall' ELSE 'square' END AS shape FROM fx_obj""")
def p13(spark, sf):
    return view(spark, sf, "fx_obj").select("image_id", "obj_idx", B.shape_class(*B.corners()).alias("shape"))


_QUAL = """SELECT image_id, obj_idx, CAST(x1 IS NULL AS INTEGER) AS unparsable,
CAST(x1 IS NOT NULL AND (x2 <= x1 OR y2 <= y1) AS INTEGER) AS inverted_or_empty,
CAST(x1 IS NOT NULL AND (x1 < 0 OR y1 < 0 OR (w <> 0 AND x2 > w) OR (h <> 0 AND y2 > h)) AS INTEGER) AS out_of_bounds
FROM (SELECT * REPLACE (CASE WHEN rotation = 'n/a' THEN NULL ELSE x1 END AS x1) FROM fx_obj)"""


def box_texts(objects):
    """Corner texts as an annotation holds them; some cannot be read as numbers."""
    return objects.withColumn("x1", F.when(C("rotation") == "n/a", "n/a").otherwise(C("x1").cast("string")).try_cast("double"))


@query("p14_box_quality", _QUAL)
def p14(spark, sf):
    q = B.quality(*B.corners(), C("w"), C("h"))
    return box_texts(view(spark, sf, "fx_obj")).select(
        "image_id", "obj_idx", *[F.coalesce(v, F.lit(False)).cast("int").alias(k) for k, v in q.items()])


@query("p15_name_parts", r"""SELECT photo_id, CAST(replace(drafter, 'drafter_', '') AS BIGINT) AS drafter_no,
regexp_extract(stem, '^(C-?\d+)_(D\d+)_', 1) AS circuit, regexp_extract(stem, '^(C-?\d+)_(D\d+)_', 2) AS drawing FROM fx_photo""")
def p15(spark, sf):
    return view(spark, sf, "fx_photo").select("photo_id", S.drafter_number(C("drafter")).alias("drafter_no"),
                                              S.circuit_of(C("stem")).alias("circuit"), S.drawing_of(C("stem")).alias("drawing"))


@query("p16_scorable", f"""SELECT image_id, obj_idx, cls, rot FROM ({_ROT}) JOIN fx_map ON lab = lower(trim(label))
WHERE cls IN ('diode','voltage_source') AND rot IS NOT NULL AND coalesce(mirror, '0') <> '1'""")
def p16(spark, sf):
    d = view(spark, sf, "fx_obj").select("image_id", "obj_idx", S.canonical_class(C("label")).alias("cls"),
                                         S.rotation_bin(C("label"), C("rotation")).alias("rot"), S.mirrored(C("mirror")).alias("m"))
    return d.filter(S.scorable(C("cls"), C("rot"), C("m"))).drop("m")


@query("p17_in_scope", """SELECT image_id, CAST(count(*) - count(cls) AS BIGINT) AS unsupported, CAST(count(*) = count(cls) AS INTEGER) AS in_scope
FROM fx_obj LEFT JOIN fx_map ON lab = lower(trim(label)) GROUP BY image_id""")
def p17(spark, sf):
    d = view(spark, sf, "fx_obj").select("image_id", S.scoped_class(C("label"), keep_other=True).alias("cls"))
    return d.groupBy("image_id").agg(F.count_if(C("cls") == "other").alias("unsupported")) \
            .withColumn("in_scope", (C("unsupported") == 0).cast("int"))


# Label values written out once more with plain SQL for the checking engine.
_PV = r"""SELECT *, CASE WHEN regexp_matches(t, '^\s*(\d+(?:\.\d+)?)\s*R\s*$') THEN regexp_extract(t, '(\d+(?:\.\d+)?)', 1)
WHEN regexp_matches(t, '^\s*(\d+)([pnuµμmkKMGR])(\d+)\s*(ohms?|Ω|[fFhHvV])?\s*$') THEN concat(regexp_extract(t, '^\s*(\d+)', 1), '.',
  regexp_extract(t, '[pnuµμmkKMGR](\d+)', 1), pfx(regexp_extract(t, '\d([pnuµμmkKMGR])\d', 1)))
WHEN regexp_matches(t, '^\s*(\d+(?:\.\d+)?)\s*(meg|[pnuµμmkKMG])?\s*(ohms?|Ω|[fFhHvV])?\s*$') THEN concat(regexp_extract(t, '(\d+(?:\.\d+)?)', 1),
  pfx(regexp_extract(t, '^\s*(\d+(?:\.\d+)?)\s*(meg|[pnuµμmkKMG])?', 2))) END AS value,
CASE WHEN regexp_matches(t, '^\s*\d+(?:\.\d+)?\s*R\s*$') OR regexp_matches(t, '^\s*\d+(\.\d+)?(meg|[pnuµμmkKMGR])?\d*\s*(ohms?|Ω)\s*$') THEN 'resistor'
WHEN regexp_matches(t, '^\s*\d+(\.\d+)?\s*(meg|[pnuµμmkKMGR])?\d*\s*[fF]\s*$') THEN 'capacitor'
WHEN regexp_matches(t, '^\s*\d+(\.\d+)?\s*(meg|[pnuµμmkKMGR])?\d*\s*[hH]\s*$') THEN 'inductor'
WHEN regexp_matches(t, '^\s*\d+(\.\d+)?\s*(meg|[pnuµμmkKMGR])?\d*\s*[vV]\s*$') THEN 'voltage_source' END AS unit_cls
FROM (SELECT *, regexp_replace(replace(trim({col}), ',', '.'), '^[+ ]+', '') AS t FROM {src})"""


def drawn_value_sql(src: str, col: str) -> str:
    out = _PV.replace("{col}", col).replace("{src}", src)
    for tail in (r"regexp_extract(t, '\d([pnuµμmkKMGR])\d', 1)", r"regexp_extract(t, '^\s*(\d+(?:\.\d+)?)\s*(meg|[pnuµμmkKMG])?', 2)"):
        out = out.replace(f"pfx({tail})", f"CASE {tail} WHEN 'µ' THEN 'u' WHEN 'μ' THEN 'u' WHEN 'K' THEN 'k' WHEN 'M' THEN 'meg' "
                                          f"WHEN 'G' THEN 'g' WHEN 'R' THEN '' ELSE {tail} END")
    return out


@query("p18_value_like", f"SELECT id, CAST(value IS NOT NULL AS INTEGER) AS value_like FROM ({drawn_value_sql('fx_txt', 'value_text')})")
def p18(spark, sf):
    return view(spark, sf, "fx_txt").select("id", V.drawn_value(C("value_text"))["value"].isNotNull().cast("int").alias("value_like"))


@query("p19_confidence_filter", """SELECT image_id, pred_idx, cls, conf, CAST(conf < 0.5 AS INTEGER) AS uncertain FROM fx_pred
WHERE conf >= 0.35 AND cls IN ('resistor','capacitor','inductor','voltage_source','diode','gnd','junction','crossover','text')""")
def p19(spark, sf):
    return view(spark, sf, "fx_pred").filter((C("conf") >= 0.35) & C("cls").isin(*CLASSES)).select(
        "image_id", "pred_idx", "cls", "conf", (C("conf") < 0.5).cast("int").alias("uncertain"))


@query("p20_error_template", r"""SELECT regexp_replace(line, '\d+', 'N', 'g') AS template, count(*) AS n FROM fx_lines GROUP BY 1""")
def p20(spark, sf):
    return view(spark, sf, "fx_lines").groupBy(T.error_template(C("line")).alias("template")).agg(F.count("*").alias("n"))


_MSG = """SELECT circuit_id, ord, CASE ord % 5 WHEN 0 THEN 'no ground node (0)' WHEN 1 THEN concat('node ', n1, ' is floating (1 connection)')
WHEN 2 THEN concat(ref, ' is shorted (both terminals on node ', n1, ')') WHEN 3 THEN concat('syntax error at line ', n2, ' near x')
ELSE concat(ref, ' uses undefined model DMOD') END AS message FROM fx_net"""


@query("p21_error_hints", f"""SELECT circuit_id, ord, concat(message, CASE
WHEN contains(message, 'no ground node') THEN '  (no part was connected to a reference node, usually because no wires were traced)'
WHEN contains(message, 'is floating') THEN '  (a wire end connects to only one part: a wire gap, or a part whose terminals were not found)'
WHEN contains(message, 'is shorted') THEN '  (both ends of a part landed on the same wire)'
WHEN contains(message, 'syntax error') THEN '  (the netlist text is malformed)' ELSE '' END) AS explained FROM ({_MSG})""")
def p21(spark, sf):
    d = view(spark, sf, "fx_net")
    m = (F.when(C("ord") % 5 == 0, "no ground node (0)")
         .when(C("ord") % 5 == 1, F.concat(F.lit("node "), "n1", F.lit(" is floating (1 connection)")))
         .when(C("ord") % 5 == 2, F.concat("ref", F.lit(" is shorted (both terminals on node "), "n1", F.lit(")")))
         .when(C("ord") % 5 == 3, F.concat(F.lit("syntax error at line "), "n2", F.lit(" near x")))
         .otherwise(F.concat("ref", F.lit(" uses undefined model DMOD"))))
    return d.select("circuit_id", "ord", T.explained(m).alias("explained"))


@query("p22_reduced_reference", """SELECT circuit_id, CAST(max(CAST(starts_with(line, '* omitted:') AS INTEGER)) AS INTEGER) AS reduced
FROM fx_lines GROUP BY circuit_id""")
def p22(spark, sf):
    return view(spark, sf, "fx_lines").groupBy("circuit_id").agg(
        F.max(C("line").startswith("* omitted:").cast("int")).alias("reduced"))


@query("p23_group_list_limit", """SELECT photo_id, drafter, stem FROM fx_photo WHERE drafter IN ('drafter_11','drafter_12','drafter_-1')
ORDER BY CAST(replace(drafter, 'drafter_', '') AS BIGINT), stem LIMIT 50""")
def p23(spark, sf):
    d = view(spark, sf, "fx_photo").filter(C("drafter").isin("drafter_11", "drafter_12", "drafter_-1"))
    return d.orderBy(S.drafter_number(C("drafter")), "stem").limit(50).select("photo_id", "drafter", "stem")


@query("str3_sentence_value", r"""SELECT id, CASE
WHEN regexp_matches(t, '^\d+(\.\d+)?R$') THEN CASE WHEN cls = 'resistor' THEN regexp_extract(t, '^(\d+(\.\d+)?)R', 1) END
WHEN regexp_matches(t, '^\d+[pnuµμmkKMGR]\d+(ohms?|Ω|[fFhHvV])?$') THEN concat(lead, regexp_extract(t, '^(\d+)', 1), '.', regexp_extract(t, '^\d+[a-zA-Zµμ](\d+)', 1),
  CASE regexp_extract(t, '^\d+([a-zA-Zµμ])', 1) WHEN 'R' THEN '' WHEN 'µ' THEN 'u' WHEN 'μ' THEN 'u' WHEN 'K' THEN 'k' WHEN 'M' THEN 'meg' WHEN 'G' THEN 'g' ELSE regexp_extract(t, '^\d+([a-zA-Zµμ])', 1) END)
WHEN regexp_matches(t, '(?i)^\d+(\.\d+)?(meg|[pnuµμmkKMG])?(ohms?|Ω|[fhv]|volts?)?$') THEN concat(lead, regexp_extract(t, '^(\d+(\.\d+)?)', 1),
  CASE WHEN suf = 'M' THEN 'meg' WHEN suf IN ('µ','μ') THEN 'u' ELSE lower(suf) END) END AS value
FROM (SELECT *, regexp_extract(t, '(?i)^\d+(?:\.\d+)?(meg|[pnuµμmkKMG])?', 1) AS suf, CASE WHEN cls = 'voltage_source' THEN 'DC ' ELSE '' END AS lead
  FROM (SELECT id, replace(replace(value_text, ' ', ''), ',', '.') AS t, CASE id % 3 WHEN 0 THEN 'voltage_source' ELSE 'resistor' END AS cls FROM fx_txt))""")
def str3(spark, sf):
    cls = F.when(C("id") % 3 == 0, "voltage_source").otherwise("resistor")
    return view(spark, sf, "fx_txt").select("id", V.sentence_value(C("value_text"), cls).alias("value"))


@query("str4_unit_class", r"""SELECT id, CASE WHEN regexp_matches(t, '^\d+(\.\d+)?R$') THEN 'resistor'
WHEN regexp_matches(t, '^\d+[pnuµμmkKMGR]\d+(ohms?|Ω|[fFhHvV])?$') THEN CASE
  WHEN regexp_matches(t, '[fF]$') THEN 'capacitor' WHEN regexp_matches(t, '[hH]$') THEN 'inductor' WHEN regexp_matches(t, '[vV]$') THEN 'voltage_source'
  WHEN regexp_matches(t, '^\d+[pnuµμ]') THEN 'capacitor' WHEN regexp_matches(t, '^\d+[kKMGR]') THEN 'resistor' END
WHEN NOT regexp_matches(value_text, '^\d') THEN NULL
WHEN starts_with(tail, 'ohm') THEN 'resistor' WHEN starts_with(tail, 'f') THEN 'capacitor' WHEN starts_with(tail, 'h') THEN 'inductor'
WHEN starts_with(tail, 'v') THEN 'voltage_source'
WHEN lower(regexp_extract(value_text, '(?i)^\d+(?:\.\d+)?\s*(meg|[pnuµμmkKMG])?', 1)) IN ('k','meg') THEN 'resistor' END AS cls
FROM (SELECT *, replace(value_text, ' ', '') AS t, lower(regexp_replace(value_text, '(?i)^\d+(?:\.\d+)?\s*(meg|[pnuµμmkKMG])?', '')) AS tail FROM fx_txt)""")
def str4(spark, sf):
    return view(spark, sf, "fx_txt").select("id", V.unit_class(C("value_text")).alias("cls"))


@query("str5_drawn_value", f"SELECT id, value, unit_cls FROM ({drawn_value_sql('fx_txt', 'value_text')})")
def str5(spark, sf):
    d = view(spark, sf, "fx_txt").select("id", V.drawn_value(C("value_text")).alias("v"))
    return d.select("id", C("v.value").alias("value"), C("v.cls").alias("unit_cls"))


NUMBER_SQL = r"""CAST(regexp_extract(lower(regexp_replace(trim({v}), '(?i)^dc\s*', '')), '^(-?\d+(\.\d+)?(e-?\d+)?)', 1) AS DOUBLE) *
CASE regexp_extract(lower(regexp_replace(trim({v}), '(?i)^dc\s*', '')), '^-?\d+(?:\.\d+)?(?:e-?\d+)?(meg|[fpnumkgt])?', 1)
WHEN 'f' THEN 1e-15 WHEN 'p' THEN 1e-12 WHEN 'n' THEN 1e-9 WHEN 'u' THEN 1e-6 WHEN 'm' THEN 1e-3 WHEN 'k' THEN 1e3 WHEN 'meg' THEN 1e6
WHEN 'g' THEN 1e9 WHEN 't' THEN 1e12 ELSE 1e0 END"""
IS_NUMBER_SQL = r"regexp_matches(regexp_replace(trim({v}), '(?i)^dc\s*', ''), '^-?\d')"


@query("str6_netlist_number", f"""SELECT circuit_id, ord, CASE WHEN {IS_NUMBER_SQL.format(v='val')} THEN {NUMBER_SQL.format(v='val')} END AS num,
CASE WHEN NOT {IS_NUMBER_SQL.format(v='val')} THEN upper(trim(val)) END AS txt FROM fx_net""")
def str6(spark, sf):
    d = view(spark, sf, "fx_net").select("circuit_id", "ord", V.netlist_number(C("val")).alias("v"))
    return d.select("circuit_id", "ord", "v.num", "v.txt")


@query("str7_label_text", r"""SELECT id, replace(regexp_replace(lower(replace(pred, 'Ω', '')), '\s+', '', 'g'), 'ohm', '') AS pred_norm,
replace(regexp_replace(lower(replace(value_text, 'Ω', '')), '\s+', '', 'g'), 'ohm', '') AS value_norm FROM fx_txt""")
def str7(spark, sf):
    return view(spark, sf, "fx_txt").select("id", T.label_text(C("pred")).alias("pred_norm"),
                                            T.label_text(C("value_text")).alias("value_norm"))


CHAR_ACC_SQL = r"""SELECT *, CASE WHEN g = '' THEN CAST(p = g AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), 1 - CAST(levenshtein(p, g) AS DOUBLE) / length(g)) END AS acc
FROM (SELECT *, replace(regexp_replace(lower(pred), '\s+', '', 'g'), 'ohm', '') AS p, replace(regexp_replace(lower(gold), '\s+', '', 'g'), 'ohm', '') AS g FROM fx_txt)"""


@query("str8_character_accuracy", f"SELECT id, round(acc, 6) AS char_acc FROM ({CHAR_ACC_SQL})")
def str8(spark, sf):
    return view(spark, sf, "fx_txt").select("id", F.round(T.character_accuracy(C("pred"), C("gold")), 6).alias("char_acc"))


@query("str13_rounded_label", f"""SELECT circuit_id, ord, CAST(printf('%.6g', {NUMBER_SQL.format(v='val')} / 3) AS DOUBLE) AS rounded
FROM fx_net WHERE {IS_NUMBER_SQL.format(v='val')}""")
def str13(spark, sf):
    d = view(spark, sf, "fx_net").withColumn("num", V.netlist_number(C("val"))["num"]).filter("num IS NOT NULL")
    return d.select("circuit_id", "ord", V.six_digits(C("num") / 3).alias("rounded"))


@query("mth1_box_measures", f"""SELECT image_id, obj_idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(x2 - x1, y2 - y1) AS longer,
sqrt(((x1 + x2) / 2) * ((x1 + x2) / 2) + ((y1 + y2) / 2) * ((y1 + y2) / 2)) AS dist, round(inter / ((x2 - x1) * (y2 - y1) + ia - inter + 1e-9), 6) AS iou_with_image
FROM (SELECT *, CAST(w * h AS DOUBLE) AS ia, greatest(CAST(0 AS DOUBLE), least(x2, w) - greatest(x1, CAST(0 AS DOUBLE))) * greatest(CAST(0 AS DOUBLE), least(y2, h) - greatest(y1, CAST(0 AS DOUBLE))) AS inter FROM fx_obj)""")
def mth1(spark, sf):
    b = B.corners()
    cx, cy = B.centre(*b)
    frame = (F.lit(0.0), F.lit(0.0), C("w").cast("double"), C("h").cast("double"))
    return view(spark, sf, "fx_obj").select("image_id", "obj_idx", cx.alias("cx"), cy.alias("cy"), B.longer_side(*b).alias("longer"),
                                            F.sqrt(cx * cx + cy * cy).alias("dist"), F.round(B.iou(b, frame), 6).alias("iou_with_image"))


_NOISE = lambda slot: f"((CAST('0x' || substr(md5(concat(image_id, '/', pred_idx, '/7/{slot}')), 1, 8) AS BIGINT) % 1000000) / CAST(1000000 AS DOUBLE) * 2 - 1) * CAST(0.1 AS DOUBLE)"


@query("mth2_box_jitter", f"""SELECT image_id, pred_idx, round(cx - nw / 2 + CAST(3e-10 AS DOUBLE), 6) AS x1, round(cy - nh / 2 + CAST(3e-10 AS DOUBLE), 6) AS y1, round(cx + nw / 2 + CAST(3e-10 AS DOUBLE), 6) AS x2, round(cy + nh / 2 + CAST(3e-10 AS DOUBLE), 6) AS y2 FROM (SELECT image_id, pred_idx,
(x1 + x2) / 2 + {_NOISE(0)} * (x2 - x1) AS cx, (y1 + y2) / 2 + {_NOISE(1)} * (y2 - y1) AS cy, (x2 - x1) * (1 + {_NOISE(2)}) AS nw, (y2 - y1) * (1 + {_NOISE(3)}) AS nh FROM fx_pred)""")
def mth2(spark, sf):
    d = view(spark, sf, "fx_pred").withColumn("j", B.jitter(F.concat_ws("/", "image_id", "pred_idx"), 0.1, 7, *B.corners()))
    return d.select("image_id", "pred_idx", *[F.round(C(f"j.{k}") + 3e-10, 6).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("mth3_terminal_points", """SELECT image_id, det_idx, CAST(t AS INTEGER) AS pos, CASE WHEN v THEN CAST(cx AS DOUBLE) ELSE cx + CAST(60 AS DOUBLE) / 2 * (2 * t - 1) END AS x,
CASE WHEN v THEN cy + CAST(60 AS DOUBLE) / 2 * (2 * t - 1) ELSE CAST(cy AS DOUBLE) END AS y,
CAST((cx - (CASE WHEN v THEN 12 ELSE 30 END)) * 3 AS INTEGER) AS bx1, CAST((cy + (CASE WHEN v THEN 30 ELSE 12 END)) * 3 AS INTEGER) AS by2
FROM (SELECT image_id, det_idx, frag_a * 40 + 20 AS cx, frag_b * 40 + 20 AS cy, side_a IN ('top','bottom') AS v FROM fx_frag), (VALUES (0),(1)) k(t)""")
def mth3(spark, sf):
    d = view(spark, sf, "fx_frag").select("image_id", "det_idx", (C("frag_a") * 40 + 20).cast("double").alias("cx"),
                                          (C("frag_b") * 40 + 20).cast("double").alias("cy"), C("side_a").isin("top", "bottom").alias("v"))
    box = B.part_box(C("cx"), C("cy"), F.lit(60), F.lit(24), C("v"), F.lit(3.0))
    return (d.select("image_id", "det_idx", box.alias("b"), F.posexplode(B.terminal_points(C("cx"), C("cy"), F.lit(60), C("v"))).alias("pos", "p"))
            .select("image_id", "det_idx", "pos", "p.x", "p.y", C("b.x1").alias("bx1"), C("b.y2").alias("by2")))


@query("arr1_rotated_labels", f"""SELECT image_id, obj_idx, CAST(k AS INTEGER) AS k, CAST((rot + 90 * k) % 360 AS INTEGER) AS rot FROM ({_ROT}) JOIN fx_map ON lab = lower(trim(label)),
(VALUES (0),(1),(2),(3)) q(k) WHERE cls IN ('diode','voltage_source') AND rot IS NOT NULL""")
def arr1(spark, sf):
    d = view(spark, sf, "fx_obj").select("image_id", "obj_idx", S.canonical_class(C("label")).alias("cls"),
                                         S.rotation_bin(C("label"), C("rotation")).alias("rot0"))
    d = d.filter(C("cls").isin(*POLARISED) & C("rot0").isNotNull())
    return d.select("image_id", "obj_idx", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "rot0") \
            .select("image_id", "obj_idx", "k", F.pmod(C("rot0") + 90 * C("k"), F.lit(360)).alias("rot"))
