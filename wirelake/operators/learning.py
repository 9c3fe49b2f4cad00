"""Four-way orientation classifiers over given feature vectors."""
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

C = F.col


def quarter_turns(rows: DataFrame, feature: str, label: str, block: int) -> DataFrame:
    """Four copies of each row: the vector turned by k blocks and the label shifted by k quarters."""
    d = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    n = F.size(feature)
    shift = (C("k") * block) % n
    turned = F.concat(F.slice(feature, shift + 1, n - shift), F.slice(feature, 1, shift))
    return d.withColumn(feature, turned).withColumn(label, F.pmod(C(label) + C("k"), F.lit(4))).drop("k")


def orientation_accuracy(rows: DataFrame, classes: list[str], block: int = 16, reg: float = 0.01, iterations: int = 1000) -> DataFrame:
    """rows(cls, features ARRAY<DOUBLE>, label 0..3, is_test) -> per class the test accuracy on plain and
    turned rows. One linear one-vs-rest model per class, trained until the solver stands still (`iterations` is far beyond that)."""
    vec = lambda d: d.withColumn("x", array_to_vector("features")).withColumn("y", C("label").cast("double"))
    out = None
    for cls in classes:
        mine = rows.filter(C("cls") == cls)
        train, test = vec(quarter_turns(mine.filter("NOT is_test"), "features", "label", block)), mine.filter("is_test")
        svm = LinearSVC(featuresCol="x", labelCol="y", regParam=reg, maxIter=iterations)
        model = OneVsRest(classifier=svm, featuresCol="x", labelCol="y", predictionCol="p").fit(train)
        score = lambda d, name: model.transform(vec(d)).agg(F.count("*").alias(name + "_n"), F.avg((C("p") == C("y")).cast("int")).alias(name + "_accuracy"))
        both = score(test, "plain").withColumn("cls", F.lit(cls)).join(
            score(quarter_turns(test, "features", "label", block), "turned").withColumn("cls", F.lit(cls)), "cls")
        out = both if out is None else out.unionByName(both)
    return out
