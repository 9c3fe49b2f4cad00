"""Box joins, matching and detection metrics."""
from pyspark.sql import functions as F

from ..operators import matching as M, metrics as E
from ..operators.audit import counted
from ..session import cut
from ..vocabulary import ELEMENT_PREFIX, POLARISED
from .fixtures import view
from .registry import query

C = F.col
IOU_SQL = """greatest(CAST(0 AS DOUBLE), least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(CAST(0 AS DOUBLE), least(p.y2, g.y2) - greatest(p.y1, g.y1)) / ((p.x2 - p.x1) * (p.y2 - p.y1)
 + (g.x2 - g.x1) * (g.y2 - g.y1) - greatest(CAST(0 AS DOUBLE), least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(CAST(0 AS DOUBLE), least(p.y2, g.y2) - greatest(p.y1, g.y1)) + CAST(1e-9 AS DOUBLE))"""
PAIRS = f"SELECT p.image_id, p.pred_idx, g.gt_idx, p.cls, g.cls AS gt_cls, p.conf, {IOU_SQL} AS iou FROM fx_pred p JOIN fx_gt g ON p.image_id = g.image_id"


def greedy_sql(edges: str, group: str, left: str, right: str, order: str) -> str:
    """Sequential pass over the sorted edges of every group, one edge per step."""
    on = " AND ".join(f"e.{c} = f.{c}" for c in group.split(", "))
    fg = ", ".join("f." + c for c in group.split(", "))
    ok = f"(NOT list_contains(f.ul, e.{left}) AND NOT list_contains(f.ur, e.{right}))"
    return f"""edges AS ({edges}), eo AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS k FROM edges),
fold AS (SELECT DISTINCT {group}, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ul, CAST([] AS BIGINT[]) AS ur, FALSE AS ok, CAST(NULL AS BIGINT) AS {left}, CAST(NULL AS BIGINT) AS {right} FROM eo
 UNION ALL SELECT {fg}, e.k, CASE WHEN {ok} THEN list_append(f.ul, e.{left}) ELSE f.ul END, CASE WHEN {ok} THEN list_append(f.ur, e.{right}) ELSE f.ur END, {ok}, e.{left}, e.{right}
 FROM fold f JOIN eo e ON {on} AND e.k = f.k + 1), won AS (SELECT {group}, {left}, {right} FROM fold WHERE ok)"""


MATCH_SQL = f"""pairs AS MATERIALIZED (SELECT * FROM ({PAIRS}) WHERE iou >= 0.5), """ + greedy_sql(
    "SELECT * FROM pairs WHERE cls = gt_cls", "image_id", "pred_idx", "gt_idx", "conf DESC, pred_idx, iou DESC, gt_idx") + """,
outc AS (SELECT p.image_id, p.pred_idx, p.cls, p.conf, CASE WHEN w.gt_idx IS NULL THEN 'fp' ELSE 'tp' END AS kind, w.gt_idx,
 CASE WHEN w.gt_idx IS NULL THEN o.other_cls END AS confused_with FROM fx_pred p LEFT JOIN won w ON p.image_id = w.image_id AND p.pred_idx = w.pred_idx
 LEFT JOIN (SELECT image_id, pred_idx, first(gt_cls ORDER BY iou DESC, gt_idx) AS other_cls FROM pairs WHERE cls <> gt_cls GROUP BY 1, 2) o ON o.image_id = p.image_id AND o.pred_idx = p.pred_idx)"""

CROWD_SQL = """crowd AS (SELECT image_id, coalesce(avg(side / (d + 1e-9)), CAST(0 AS DOUBLE)) AS crowding FROM (SELECT a.image_id, a.gt_idx, greatest(any_value(a.x2 - a.x1), any_value(a.y2 - a.y1)) AS side,
 min(sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2))) AS d
 FROM fx_gt a LEFT JOIN fx_gt b ON a.image_id = b.image_id AND a.gt_idx <> b.gt_idx GROUP BY 1, 2) GROUP BY image_id)"""

SCORES_SQL = f"""{MATCH_SQL}, {CROWD_SQL}, scores AS (SELECT coalesce(g.image_id, p.image_id) AS image_id, coalesce(gt, 0) AS gt, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(gt, 0) - coalesce(tp, 0) AS fn,
 coalesce(mis, 0) AS misclassified, coalesce(txt, 0) AS text_confusion, coalesce(crowding, CAST(0 AS DOUBLE)) AS crowding FROM (SELECT image_id, count(*) AS gt FROM fx_gt GROUP BY 1) g
 FULL OUTER JOIN (SELECT image_id, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(confused_with) AS mis,
 count(*) FILTER (confused_with IS NOT NULL AND (cls = 'text' OR confused_with = 'text')) AS txt FROM outc GROUP BY 1) p ON p.image_id = g.image_id LEFT JOIN crowd c ON c.image_id = g.image_id)"""


def shown_crowding(digits: int):
    """Coincident centres give numbers of ten digits and more: these are shown in millions."""
    return F.when(C("crowding") < 1e6, F.round("crowding", digits)).otherwise(F.round(C("crowding") / 1e6) * 1e6)


def gp(spark, sf):
    """Both box tables, written once for all that read them."""
    return cut(view(spark, sf, "fx_gt")), cut(view(spark, sf, "fx_pred"))


def outcomes(spark, sf):
    gt, pred = gp(spark, sf)
    return M.match_predictions(pred, gt)


def scores(spark, sf):
    gt, pred = gp(spark, sf)
    return E.image_scores(pred, gt, cut(M.match_predictions(pred, gt)))


@query("j3_iou_pairs", f"SELECT image_id, pred_idx, gt_idx, round(iou, 6) AS iou FROM ({PAIRS}) WHERE iou > 0")
def j3(spark, sf):
    gt, pred = gp(spark, sf)
    d = M.overlapping_pairs(pred, gt, ["image_id"], 0.0)
    return d.select("image_id", C("l_pred_idx").alias("pred_idx"), C("r_gt_idx").alias("gt_idx"), F.round("iou", 6).alias("iou"))


@query("j4_greedy_match", f"WITH RECURSIVE {MATCH_SQL} SELECT * FROM outc")
def j4(spark, sf):
    return outcomes(spark, sf)


_POLAR = "g.cls IN ('diode','voltage_source') AND g.rotation IS NOT NULL AND NOT g.mirrored"


@query("j5_best_match", f"""SELECT g.image_id, g.gt_idx, g.cls, g.rotation, CAST(coalesce(first(p.cls = g.cls AND p.rotation IS NOT DISTINCT FROM g.rotation AND iou >= 0.5 ORDER BY iou DESC, p.pred_idx), FALSE) AS INTEGER) AS ok
FROM fx_gt g LEFT JOIN (SELECT p.image_id, p.pred_idx, g.gt_idx, p.cls, p.rotation, {IOU_SQL} AS iou FROM fx_pred p JOIN fx_gt g ON g.image_id = p.image_id WHERE p.cls IN ('diode','voltage_source')) p
ON p.image_id = g.image_id AND p.gt_idx = g.gt_idx WHERE {_POLAR} GROUP BY 1, 2, 3, 4""")
def j5(spark, sf):
    gt, pred = gp(spark, sf)
    g = gt.filter(C("cls").isin(*POLARISED) & C("rotation").isNotNull() & ~C("mirrored"))
    d = M.best_match(g, pred.filter(C("cls").isin(*POLARISED)))
    return d.withColumn("ok", C("ok").cast("int"))


_PV_TXT = """CASE txt WHEN '10k' THEN '10k' WHEN '4,7uF' THEN '4.7u' WHEN '4k7' THEN '4.7k' WHEN '330R' THEN '330' WHEN '+5V' THEN '5' WHEN '1M5' THEN '1.5meg' END"""
_PV_CLS = """CASE txt WHEN '4,7uF' THEN 'capacitor' WHEN '330R' THEN 'resistor' WHEN '+5V' THEN 'voltage_source' END"""
ATTACH_SQL = "lab AS (SELECT *, " + _PV_TXT + " AS value, " + _PV_CLS + """ AS ucls FROM fx_gt WHERE cls = 'text'), """ + greedy_sql(
    """SELECT e.image_id, e.gt_idx AS element_idx, l.gt_idx AS label_idx, sqrt(pow((e.x1 + e.x2) / 2 - (l.x1 + l.x2) / 2, 2) + pow((e.y1 + e.y2) / 2 - (l.y1 + l.y2) / 2, 2)) AS dist, l.value
FROM fx_gt e JOIN lab l ON e.image_id = l.image_id WHERE l.value IS NOT NULL AND e.cls IN ('resistor','capacitor','inductor','voltage_source','diode') AND (l.ucls IS NULL OR l.ucls = e.cls)
AND sqrt(pow((e.x1 + e.x2) / 2 - (l.x1 + l.x2) / 2, 2) + pow((e.y1 + e.y2) / 2 - (l.y1 + l.y2) / 2, 2)) <= greatest(CAST(150 AS DOUBLE), 1.5 * greatest(e.x2 - e.x1, e.y2 - e.y1))""",
    "image_id", "element_idx", "label_idx", "dist, element_idx, label_idx")


@query("j6_attach_values", f"WITH RECURSIVE {ATTACH_SQL} SELECT image_id, element_idx, label_idx, value FROM won JOIN (SELECT image_id, gt_idx AS label_idx, value FROM lab) USING (image_id, label_idx)")
def j6(spark, sf):
    d = view(spark, sf, "fx_gt").withColumn("idx", C("gt_idx"))
    return M.attach_values(d).select("image_id", "element_idx", "label_idx", "value")


@query("j7_crowding", f"WITH {CROWD_SQL} SELECT image_id, CASE WHEN crowding < 1e6 THEN round(crowding, 6) ELSE round(crowding / 1e6) * 1e6 END AS crowding FROM crowd")
def j7(spark, sf):
    return M.crowding(view(spark, sf, "fx_gt")).withColumn("crowding", shown_crowding(6))


@query("j8_double_labels", f"""SELECT p.image_id, p.pred_idx AS a_idx, g.pred_idx AS b_idx, p.cls AS a_cls, g.cls AS b_cls FROM fx_pred p JOIN fx_pred g ON p.image_id = g.image_id AND p.pred_idx < g.pred_idx AND p.cls <> g.cls
WHERE {IOU_SQL} > 0.7 UNION ALL SELECT p.image_id, p.pred_idx * 1000, g.gt_idx * 1000 + 1, p.cls, g.cls FROM fx_pred p JOIN fx_gt g ON p.image_id = g.image_id AND p.cls <> g.cls AND p.pred_idx * 1000 < g.gt_idx * 1000 + 1 WHERE {IOU_SQL} > 0.7
UNION ALL SELECT p.image_id, g.gt_idx * 1000 + 1, p.pred_idx * 1000, g.cls, p.cls FROM fx_pred p JOIN fx_gt g ON p.image_id = g.image_id AND p.cls <> g.cls AND p.pred_idx * 1000 > g.gt_idx * 1000 + 1 WHERE {IOU_SQL} > 0.7""")
def j8(spark, sf):
    gt, pred = gp(spark, sf)
    sel = lambda d, idx: d.select("image_id", idx.alias("idx"), "cls", *M.BOX)
    out = lambda d: d.select("image_id", C("l_idx").alias("a_idx"), C("r_idx").alias("b_idx"), C("l_cls").alias("a_cls"), C("r_cls").alias("b_cls"))
    both = sel(pred, C("pred_idx") * 1000).unionByName(sel(gt, C("gt_idx") * 1000 + 1))
    mixed = M.double_labels(both, "idx").filter("l_idx % 1000 <> r_idx % 1000")
    return out(M.double_labels(sel(pred, C("pred_idx")), "idx")).unionByName(out(mixed))


_FRAG_BOX = """SELECT image_id, det_idx, CAST((det_idx * 37 + frag_a * 11) % 380 AS DOUBLE) AS x1, CAST(frag_b * 31 % 280 AS DOUBLE) AS y1, CAST(5 + frag_a * 3 AS DOUBLE) AS w, CAST(3 + frag_b * 2 AS DOUBLE) AS h FROM fx_frag"""


@query("j13_wire_fragments", f"""SELECT image_id, det_idx FROM ({_FRAG_BOX}) f WHERE w * h >= 40 AND NOT EXISTS (SELECT 1 FROM fx_gt g WHERE g.image_id = f.image_id AND g.cls <> 'junction'
AND g.x1 - 40 <= f.x1 AND g.y1 - 40 <= f.y1 AND f.x1 + f.w <= g.x2 + 40 AND f.y1 + f.h <= g.y2 + 40)""")
def j13(spark, sf):
    f = view(spark, sf, "fx_frag").select("image_id", "det_idx", ((C("det_idx") * 37 + C("frag_a") * 11) % 380).cast("double").alias("x1"),
                                          (C("frag_b") * 31 % 280).cast("double").alias("y1"), (5 + C("frag_a") * 3).alias("w"), (3 + C("frag_b") * 2).alias("h"))
    f = f.withColumns({"x2": C("x1") + C("w"), "y2": C("y1") + C("h"), "area": C("w") * C("h")})
    return M.wire_fragments(f, view(spark, sf, "fx_gt").filter("cls <> 'junction'"), ["det_idx"], 40.0, 40.0).select("image_id", "det_idx")


@query("a16_image_scores", f"WITH RECURSIVE {SCORES_SQL} SELECT image_id, gt, tp, fp, fn, misclassified, text_confusion, CASE WHEN crowding < 1e6 THEN round(crowding, 3) ELSE round(crowding / 1e6) * 1e6 END AS crowding FROM scores")
def a16(spark, sf):
    return scores(spark, sf).withColumn("crowding", shown_crowding(3))


@query("a16_totals", f"WITH RECURSIVE {SCORES_SQL} SELECT CAST(sum(gt) AS BIGINT) AS gt, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM scores")
def a16c(spark, sf):
    return scores(spark, sf).agg(*[F.sum(c).alias(c) for c in ("gt", "tp", "fp", "fn")])


@query("a16_confusion_pairs", f"WITH RECURSIVE {MATCH_SQL} SELECT confused_with AS true_cls, cls AS pred_cls, count(*) AS n FROM outc WHERE confused_with IS NOT NULL GROUP BY 1, 2")
def a16b(spark, sf):
    return outcomes(spark, sf).filter("confused_with IS NOT NULL").groupBy(C("confused_with").alias("true_cls"), C("cls").alias("pred_cls")).agg(F.count("*").alias("n"))


_BG = ["resistor", "capacitor", "inductor", "voltage_source", "diode", "gnd", "junction", "crossover", "text", "background"]


_ANY_PAIR = f"pairs AS MATERIALIZED (SELECT * FROM ({PAIRS}) WHERE iou >= 0.5), " + greedy_sql("SELECT * FROM pairs", "image_id", "pred_idx", "gt_idx", "iou DESC, conf DESC, pred_idx, gt_idx")


@query("a17_confusion_matrix", f"""WITH RECURSIVE {_ANY_PAIR}, cells AS (SELECT p.cls AS predicted, coalesce(g.cls, 'background') AS t FROM fx_pred p LEFT JOIN won w ON w.image_id = p.image_id AND w.pred_idx = p.pred_idx
LEFT JOIN fx_gt g ON g.image_id = w.image_id AND g.gt_idx = w.gt_idx
UNION ALL SELECT 'background', g.cls FROM fx_gt g WHERE NOT EXISTS (SELECT 1 FROM won w WHERE w.image_id = g.image_id AND w.gt_idx = g.gt_idx))
SELECT predicted, {', '.join(f"count(*) FILTER (t = '{c}') AS {c}" for c in _BG)} FROM cells GROUP BY predicted""")
def a17(spark, sf):
    gt, pred = gp(spark, sf)
    return E.confusion_matrix(gt, pred)


THR = [round(0.5 + 0.05 * k, 2) for k in range(10)]
CURVE_SQL = f"""pairs AS MATERIALIZED (SELECT * FROM ({PAIRS}) WHERE iou >= 0.5 AND p.cls = g.cls), thrs AS (SELECT CAST(t AS DOUBLE) AS thr FROM (VALUES {', '.join(f'({t})' for t in THR)}) v(t)),
""".replace("p.cls = g.cls", "cls = gt_cls") + greedy_sql("SELECT * FROM pairs JOIN thrs ON thr <= iou", "thr, image_id", "pred_idx", "gt_idx", "conf DESC, pred_idx, iou DESC, gt_idx") + """,
cnt AS (SELECT p.cls, t.thr, p.conf, count(*) AS n, count(w.gt_idx) AS tp FROM fx_pred p CROSS JOIN thrs t LEFT JOIN won w ON w.image_id = p.image_id AND w.pred_idx = p.pred_idx AND w.thr = t.thr GROUP BY ALL),
curve AS MATERIALIZED (SELECT *, cum_tp / cum_n AS prec, cum_tp / n_gt AS rec, max(cum_tp / cum_n) OVER (PARTITION BY cls, thr ORDER BY conf) AS envelope FROM (
 SELECT cls, thr, conf, sum(tp) OVER w AS cum_tp, sum(n) OVER w AS cum_n, n_gt FROM cnt JOIN (SELECT cls, count(*) AS n_gt FROM fx_gt GROUP BY cls) g USING (cls) WINDOW w AS (PARTITION BY cls, thr ORDER BY conf DESC)))"""


@query("win4_precision_curve", f"WITH RECURSIVE {CURVE_SQL} SELECT cls, thr, conf, CAST(cum_tp AS BIGINT) AS cum_tp, CAST(cum_n AS BIGINT) AS cum_n, round(prec, 6) AS prec, round(rec, 6) AS rec, round(envelope, 6) AS envelope FROM curve")
def win4(spark, sf):
    gt, pred = gp(spark, sf)
    d = E.precision_curve(E.threshold_matches(pred, gt, THR), gt)
    return d.select("cls", "thr", "conf", "cum_tp", "cum_n", F.round("precision", 6).alias("prec"), F.round("recall", 6).alias("rec"), F.round("envelope", 6).alias("envelope"))


@query("a18_average_precision", f"""WITH RECURSIVE {CURVE_SQL}, pts AS (SELECT cls, thr, r, coalesce(max(prec) FILTER (rec * 100 + 1e-9 >= r), 0) AS p FROM curve, range(101) q(r) GROUP BY 1, 2, 3),
ap AS (SELECT cls, thr, sum(p) / 101 AS ap FROM pts GROUP BY 1, 2),
per AS (SELECT * FROM (SELECT cls, max(ap) FILTER (thr = 0.5) AS ap50, avg(ap) AS ap50_95 FROM ap GROUP BY cls)
JOIN (SELECT cls, arg_min(prec, conf) AS prec, arg_min(rec, conf) AS rec FROM curve WHERE thr = 0.5 AND conf >= 0.25 GROUP BY cls) USING (cls))
SELECT cls, round(ap50, 6) AS ap50, round(ap50_95, 6) AS ap50_95, round(prec, 6) AS prec, round(rec, 6) AS rec FROM (SELECT cls, ap50, ap50_95, prec, rec FROM per UNION ALL SELECT 'all classes', avg(ap50), avg(ap50_95), avg(prec), avg(rec) FROM per)""")
def a18(spark, sf):
    gt, pred = gp(spark, sf)
    d = E.with_mean(E.average_precision(E.threshold_matches(pred, gt, THR), gt))
    return d.select("cls", *[F.round(a, 6).alias(b) for a, b in (("ap50", "ap50"), ("ap50_95", "ap50_95"), ("precision", "prec"), ("recall", "rec"))])


_KIND_SQL = " UNION ALL ".join(f"SELECT '{k}' AS kind, image_id, {v} AS key FROM scores WHERE {p}" for k, (p, v) in E.KINDS.items())


@query("win5_failure_examples", f"WITH RECURSIVE {SCORES_SQL} SELECT kind, CAST(rn AS INTEGER) AS rn, image_id, CASE WHEN key < 1e6 THEN round(key, 3) ELSE round(key / 1e6) * 1e6 END AS key FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN key < 1e6 THEN round(key, 3) ELSE round(key / 1e6) * 1e6 END DESC, image_id) AS rn FROM ({_KIND_SQL})) WHERE rn <= 6")
def win5(spark, sf):
    s = scores(spark, sf).withColumn("crowding", shown_crowding(3))
    return E.failure_examples(s).select("kind", "rn", "image_id", F.round("key", 3).alias("key"))


@query("a23_counter_ratios", f"""SELECT cls, sum(ok) AS ok, count(*) AS n, round(sum(ok) / count(*), 6) AS share, CASE WHEN sum(ok) > 1000000000 THEN 1.0::DOUBLE END AS empty_share FROM (
SELECT g.image_id, g.gt_idx, g.cls, CAST(coalesce(first(p.cls = g.cls AND p.rotation IS NOT DISTINCT FROM g.rotation AND iou >= 0.5 ORDER BY iou DESC, p.pred_idx), FALSE) AS BIGINT) AS ok
FROM fx_gt g LEFT JOIN (SELECT p.image_id, p.pred_idx, g.gt_idx, p.cls, p.rotation, {IOU_SQL} AS iou FROM fx_pred p JOIN fx_gt g ON g.image_id = p.image_id WHERE p.cls IN ('diode','voltage_source')) p
ON p.image_id = g.image_id AND p.gt_idx = g.gt_idx WHERE {_POLAR} GROUP BY 1, 2, 3) GROUP BY cls""".replace("sum(ok) AS ok", "CAST(sum(ok) AS BIGINT) AS ok"))
def a23(spark, sf):
    return j5(spark, sf).groupBy("cls").agg(F.sum("ok").alias("ok"), F.count("*").alias("n")).select(
        "cls", "ok", "n", F.round(F.try_divide("ok", "n"), 6).alias("share"), F.try_divide(C("ok").cast("double"), F.lit(0.0)).alias("empty_share"))


@query("a30_class_counts", """SELECT image_id, count(*) FILTER (cls NOT IN ('junction','crossover','text')) AS parts, count(*) FILTER (cls = 'junction') AS junctions,
count(*) FILTER (cls = 'crossover') AS crossovers, count(*) FILTER (cls = 'text') AS labels FROM fx_pred GROUP BY image_id""")
def a30(spark, sf):
    n = lambda c: F.count_if(C("cls") == c)
    return view(spark, sf, "fx_pred").groupBy("image_id").agg(F.count_if(~C("cls").isin("junction", "crossover", "text")).alias("parts"),
                                                              n("junction").alias("junctions"), n("crossover").alias("crossovers"), n("text").alias("labels"))


@query("srt3_parts_by_confidence", """SELECT image_id, pred_idx, row_number() OVER (PARTITION BY image_id ORDER BY conf, pred_idx) AS pos,
format('  {:<15} confidence {:.2f}{}', cls, conf, CASE WHEN conf < 0.5 THEN '  <- uncertain' ELSE '' END) AS line
FROM (SELECT * REPLACE (conf + 0.0001 AS conf) FROM fx_pred) WHERE cls NOT IN ('junction','crossover','text')""")
def srt3(spark, sf):
    from ..operators.ranking import numbered
    d = view(spark, sf, "fx_pred").filter(~C("cls").isin("junction", "crossover", "text")).withColumn("conf", C("conf") + 0.0001)  # no exact halves of a hundredth
    d = numbered(d, ["image_id"], ["conf", "pred_idx"], "pos", F.floor(C("conf") * 100))
    line = F.concat(F.format_string("  %-15s confidence %.2f", C("cls"), C("conf")), F.when(C("conf") < 0.5, "  <- uncertain").otherwise(""))
    return d.select("image_id", "pred_idx", "pos", line.alias("line"))
