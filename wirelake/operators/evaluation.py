"""Summaries of evaluation rows."""
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.wording import error_template
from .audit import first_k

C = F.col


def mean(name: str, digits: int | None = None) -> Column:
    """Mean of the values present; NULL when none is. Rounded only for reports."""
    m = F.avg(C(name).cast("double"))
    return m if digits is None else F.round(m, digits)


def by_subset(rows: DataFrame) -> DataFrame:
    """Every row under 'all', in-scope rows once more under 'in_scope_only'."""
    both = F.when(C("in_scope") == 1, F.array(F.lit("all"), F.lit("in_scope_only"))).otherwise(F.array(F.lit("all")))
    return rows.withColumn("subset", F.explode(both))


def summary(rows: DataFrame) -> DataFrame:
    metrics = ["terminals_ok", "valid", "simulates", "topology_match", "exact_match", "op_match", "struct_match_vs_gt_boxes", "isomorphic_to_gt_boxes"]
    return by_subset(rows).groupBy("mode", "subset").agg(
        F.count("*").alias("images"), *[mean(m, 6).alias(m) for m in metrics], F.count("topology_match").alias("reference_rows"))


def category_histograms(rows: DataFrame, top: int = 5) -> DataFrame:
    """Ground rules, and the most common error templates, per mode and subset."""
    d = by_subset(rows)
    rules = d.groupBy("mode", "subset", C("ground").alias("item")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("ground_rule"))
    errs = d.filter("first_error IS NOT NULL").groupBy("mode", "subset", error_template(C("first_error")).alias("item")).agg(F.count("*").alias("n"))
    errs = first_k(errs, ["mode", "subset"], [C("n").desc(), C("item")], top).drop("rn").withColumn("kind", F.lit("top_error"))
    return rules.unionByName(errs)


def scorecard(cases: DataFrame, valid: DataFrame, compared: DataFrame) -> DataFrame:
    """Cases with validity and, where a reference exists, the comparison flags."""
    return cases.join(valid, "circuit_id", "left").join(compared, "circuit_id", "left").select(
        "circuit_id", C("ref_id").isNotNull().alias("reference"), F.coalesce("valid", F.lit(False)).alias("valid"), "topology_match", "exact_match", "op_match")
