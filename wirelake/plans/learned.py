"""Classifiers and streams."""
from pyspark.sql import functions as F

from ..operators import learning as L
from ..session import cut, scratch_path
from ..streaming import incremental as R
from .fixtures import table, view
from .registry import query
from .scans import SPLIT_SQL, split_images, xml_docs
from .projections import _CLIP

C = F.col
LABELS = ["resistor", "capacitor.polarized", "inductor", "voltage.dc", "voltage.battery", "diode", " Diode.Zener ", "gnd", "junction",
          "crossover", "text", "transistor.bjt", "lamp"]


@query("lrn1_orientation_classifier")
def lrn1(spark, sf):
    d = view(spark, sf, "fx_vec").select(F.when(C("vec_id") % 2 == 0, "diode").otherwise("voltage_source").alias("cls"),
                                         C("embedding").cast("array<double>").alias("features"), "label", (C("vec_id") % 5 == 0).alias("is_test"))
    return L.orientation_accuracy(cut(d), ["diode", "voltage_source"])


@query("stm1_incremental_counts", f"""SELECT split, item, count(*) AS n FROM (SELECT {SPLIT_SQL} AS split, unnest(list_filter([CASE WHEN ok THEN cls END, CASE WHEN NOT ok THEN 'boxes_dropped'
WHEN cx1 <> x1 OR cx2 <> x2 OR cy1 <> y1 OR cy2 <> y2 THEN 'boxes_clipped' END], lambda x: x IS NOT NULL)) AS item FROM ({_CLIP}) JOIN fx_map ON lab = lower(trim(label)) JOIN fx_photo ON photo_id = image_id WHERE image_id % 37 <> 0) GROUP BY 1, 2""")
def stm1(spark, sf):
    """XML texts arrive twice; the second pass reads the new files only and goes on from the counts of the first."""
    docs, folder = cut(xml_docs(spark, sf).select("image_id", "xml")), scratch_path(spark, "arrivals")
    out, state = R.fresh(spark)
    for k in (0, 1):
        docs.filter(C("image_id") % 2 == k).write.mode("append").parquet(folder)
        R.incremental_counts(R.annotation_stream(spark, folder), split_images(spark, sf), out, state)
    return R.counts(spark, out)


@query("stm2_drift_guard", """SELECT image_id, k, label, CAST(1 AS BIGINT) AS extra, side FROM (SELECT l_orderkey AS image_id, concat(l_partkey, '/', l_suppkey, '/', l_linenumber) AS k, (['resistor','capacitor.polarized','inductor','voltage.dc','voltage.battery','diode',' Diode.Zener ','gnd','junction','crossover','text','transistor.bjt','lamp'])[l_partkey % 13 + 1] AS label, 'approved' AS side FROM lineitem
UNION ALL SELECT l_orderkey, concat(l_partkey, '/', l_suppkey, '/', l_linenumber), 'lamp', 'new' FROM lineitem WHERE l_partkey % 13 <> 12) WHERE image_id % 50 = 0 AND (side = 'new' OR label <> 'lamp')""")
def stm2(spark, sf):
    """Rows of one image arrive in two batches."""
    key = F.concat_ws("/", "l_partkey", "l_suppkey", "l_linenumber")
    rows = table(spark, sf, "lineitem").select(C("l_orderkey").alias("image_id"), key.alias("k"), F.get(F.array(*map(F.lit, LABELS)), (C("l_partkey") % 13).cast("int")).alias("label"), "l_linenumber")
    new = rows.withColumn("label", F.when(C("image_id") % 50 == 0, "lamp").otherwise(C("label")))
    folder = scratch_path(spark, "arrivals")
    out, state = R.fresh(spark)
    for k in (0, 1):
        new.filter(C("l_linenumber") % 2 == k).drop("l_linenumber").write.mode("append").parquet(folder)
        R.drift_guard(spark.readStream.schema("image_id long, k string, label string").parquet(folder), rows.drop("l_linenumber"), "image_id", out, state)
    return R.drift(spark, "image_id", out)
