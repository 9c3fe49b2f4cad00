"""Scores of predictions against ground truth."""
from pyspark.sql import DataFrame, functions as F

from . import matching as M
from .ranking import later_max, running
from ..session import cut
from ..vocabulary import CLASSES

C = F.col


def image_scores(preds: DataFrame, gts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """gt, tp, fp, fn, misclassified, text_confusion and crowding per image."""
    is_text = (C("cls") == "text") | (C("confused_with") == "text")
    p = outcomes.groupBy("image_id").agg(
        F.count_if(C("kind") == "tp").alias("tp"), F.count_if(C("kind") == "fp").alias("fp"),
        F.count("confused_with").alias("misclassified"), F.count_if(C("confused_with").isNotNull() & is_text).alias("text_confusion"))
    g = gts.groupBy("image_id").agg(F.count("*").alias("gt"))
    d = g.join(p, "image_id", "full_outer").join(M.crowding(gts), "image_id", "left")
    d = d.fillna(0, ["gt", "tp", "fp", "misclassified", "text_confusion"]).fillna(0.0, ["crowding"])
    return d.withColumn("fn", C("gt") - C("tp"))


def confusion_matrix(gts: DataFrame, preds: DataFrame, thr: float = 0.5) -> DataFrame:
    """Predicted class x true class counts. Objects and predictions are matched one to one whatever their classes, highest IoU first, so each of
    them is in one cell; 'background' stands for whatever has no partner."""
    won = M.greedy_one_to_one(M._gt_pairs(preds, gts, thr), ["image_id"], "pred_idx", "gt_idx",
                              [(-C("iou")).alias("a"), (-C("conf")).alias("b"), C("pred_idx").alias("c"), C("gt_idx").alias("d")])
    p = preds.select("image_id", "pred_idx", C("cls").alias("predicted")).join(won, ["image_id", "pred_idx"], "left")
    d = p.join(gts.select("image_id", "gt_idx", C("cls").alias("true")), ["image_id", "gt_idx"], "full_outer")
    d = d.select(F.coalesce("predicted", F.lit("background")).alias("predicted"), F.coalesce("true", F.lit("background")).alias("true"))
    d = d.groupBy("predicted", "true").agg(F.count("*").alias("n"))
    return d.groupBy("predicted").pivot("true", [*CLASSES, "background"]).agg(F.sum("n")).fillna(0)


def with_mean(scores: DataFrame) -> DataFrame:
    """Scores per class and their means over the classes."""
    return scores.unionByName(scores.agg(F.lit("all classes").alias("cls"), *[F.avg(c).alias(c) for c in scores.columns if c != "cls"]))


def threshold_matches(preds: DataFrame, gts: DataFrame, thresholds: list[float]) -> DataFrame:
    """Counts of true positives and predictions per (class, threshold, confidence). Rows of equal
    confidence enter the curve together, so its shape does not depend on their order."""
    pairs = M._gt_pairs(preds, gts, min(thresholds)).filter("cls = gt_cls").withColumn("_o", F.struct(*M.match_order()))
    at = F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= C("iou"))).alias("thr")
    # what stands alone at the lowest threshold does so at all of them
    alone, contested = M.alone_and_contested(pairs.select("image_id", "pred_idx", "gt_idx", "iou", "_o"), ["image_id"], "pred_idx", "gt_idx")
    keys = ["thr", "image_id", "pred_idx", "gt_idx"]
    won = alone.select("*", at).select(*keys).unionByName(M.settle(contested.select("*", at), ["thr", "image_id"], "pred_idx", "gt_idx").select(*keys))
    hits = preds.select("image_id", "pred_idx", "cls", "conf").join(won, ["image_id", "pred_idx"]) \
                .groupBy("cls", "thr", "conf").agg(F.count("*").alias("tp"))
    n = preds.groupBy("cls", "conf").agg(F.count("*").alias("n"))
    n = n.withColumn("thr", F.explode(F.array(*map(F.lit, thresholds))))
    return n.join(hits, ["cls", "thr", "conf"], "left").fillna(0, ["tp"])


def precision_curve(counts: DataFrame, gts: DataFrame) -> DataFrame:
    """Cumulative precision and recall in falling confidence, and the envelope of precision."""
    counts = cut(counts)
    total = gts.groupBy("cls").agg(F.count("*").alias("n_gt"))
    fall = [C("conf").desc()]
    d = running(counts, ["cls", "thr"], F.floor((1 - C("conf")) * 1000), fall, {"cum_tp": "tp", "cum_n": "n"})
    d = cut(d).join(total, "cls").withColumns({"precision": C("cum_tp") / C("cum_n"), "recall": C("cum_tp") / C("n_gt")})
    return later_max(d, ["cls", "thr"], fall, "precision", "envelope")


def average_precision(counts: DataFrame, gts: DataFrame, report_conf: float = 0.25) -> DataFrame:
    """Per class: AP at 0.5, mean AP over the thresholds (101 recall points), precision and recall at
    report_conf. A class without predictions scores 0."""
    curve = cut(precision_curve(counts, gts))
    step = F.floor(C("recall") * 100 + 1e-9).cast("int")
    best = curve.groupBy("cls", "thr", step.alias("k")).agg(F.max("precision").alias("p"))
    # at most 101 rows per class and threshold: the best precision at recall k/100 or beyond
    arr = best.groupBy("cls", "thr").agg(F.collect_list(F.struct("k", "p")).alias("a"))
    points = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda k: F.coalesce(
        F.array_max(F.transform(F.filter("a", lambda x: x["k"] >= k), lambda x: x["p"])), F.lit(0.0)))
    ap = arr.select("cls", "thr", (F.aggregate(points, F.lit(0.0), lambda s, x: s + x) / 101).alias("ap"))
    ap = ap.groupBy("cls").agg(F.max(F.when(C("thr") == 0.5, C("ap"))).alias("ap50"), F.avg("ap").alias("ap50_95"))
    pr = curve.filter((C("thr") == 0.5) & (C("conf") >= report_conf)).groupBy("cls").agg(
        F.min_by("precision", "conf").alias("precision"), F.min_by("recall", "conf").alias("recall"))
    total = gts.select("cls").distinct()
    return total.join(ap, "cls", "left").join(pr, "cls", "left").fillna(0.0)


KINDS = {
    "correct": ("fp = 0 AND fn = 0", "CAST(gt AS DOUBLE)"),
    "missed": ("fn > 0", "CAST(fn AS DOUBLE)"),
    "false_positive": ("fp - misclassified > 0", "CAST(fp - misclassified AS DOUBLE)"),
    "text_confusion": ("text_confusion > 0", "CAST(text_confusion AS DOUBLE)"),
    "misclassified": ("misclassified - text_confusion > 0", "CAST(misclassified AS DOUBLE)"),
    "crowded": ("fp + fn > 0", "crowding"),
}


def failure_examples(scores: DataFrame, k: int = 6) -> DataFrame:
    """The k strongest images of every kind; an image may show several kinds."""
    from .audit import first_k
    kinds = F.array_compact(F.array(*[F.when(F.expr(p), F.struct(F.lit(n).alias("kind"), F.expr(v).alias("key")))
                                      for n, (p, v) in KINDS.items()]))
    d = scores.select("image_id", F.explode(kinds).alias("e")).select("image_id", "e.kind", "e.key")
    return first_k(d, ["kind"], [C("key").desc(), C("image_id")], k)
