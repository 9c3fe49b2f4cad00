"""Intermediate tables lie in one folder of the application and go with it."""
import os

from wirelake.session import clean_up, cut, run_dir


def test_clean_up(spark):
    d = cut(spark.range(10))
    assert d.count() == 10 and os.listdir(run_dir(spark)) and all(f.startswith(f"file:{run_dir(spark)}/") or f.startswith(f"file://{run_dir(spark)}/") for f in d.inputFiles())
    assert clean_up(spark) and not os.path.exists(run_dir(spark)) and not clean_up(spark)
    assert cut(spark.range(3)).count() == 3


def test_dealt_tables_are_joined_in_place(spark):
    import re
    from pyspark.sql import functions as F
    from wirelake.session import in_place, spread
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before, least = spark.conf.get(name), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    d = spark.range(300).select((F.col("id") % 9).alias("k"), "id")

    def shuffles():
        j = spread(d, "k").join(spread(d.withColumn("v", F.col("id") * 2), "k"), ["k", "id"])
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert j.agg(F.sum("v")).first()[0] == 300 * 299
        return len(re.findall(r"Exchange hashpartitioning\(k#\d+L, \d+\)", plan)), plan.count("Exchange hashpartitioning")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        apart = shuffles()
        with in_place(spark):
            together = shuffles()
        try:
            with in_place(spark):
                raise KeyError
        except KeyError:
            pass
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert (together, apart) == ((2, 2), (0, 2)) and spark.conf.get(name) == before


def test_traces_deal_their_inputs_once(spark):
    from wirelake.operators import nets as W
    from wirelake.plans import circuits
    seen, conf = [], "spark.sql.requireAllClusterKeysForCoPartition"
    terminals = W.terminals

    def watched(*args):
        seen.append(spark.conf.get(conf))
        return terminals(*args)
    W.terminals = watched
    try:
        n = circuits.str15(spark, "/root/testdata/sf0.001").count()
    finally:
        W.terminals = terminals
    assert n > 1000 and seen == ["false"] and spark.conf.get(conf) == "true"
