"""Connected components by image."""
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut

C = F.col
#: images with more edges are labelled by rounds of joins; the others go through one grouped step
LARGE = 100_000
#: rows of one key that a join keeps together; a key with more is split into parts of about so many
SPAN = 100_000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], salt: list[str], how: str = "inner") -> DataFrame:
    """rows join table on keys, where table has one row for each key and `_rows`, the number of rows with it. Keys with more than SPAN rows are split: rows take one
    of the parts by a hash of `salt`, the table's row is there once for each part. So no task gets more than about SPAN rows of one key. Heavy keys are
    at most 1/SPAN of all rows; they are looked up by a join that Spark sizes itself."""
    heavy = cut(table.filter(C("_rows") > SPAN).select(*keys, F.ceil(C("_rows") / SPAN).cast("int").alias("_parts")))
    table = table.drop("_rows")
    if heavy.isEmpty():
        return rows.join(table, keys, how)
    part = F.coalesce(F.pmod(F.xxhash64(*salt), C("_parts")).cast("int"), F.lit(0))
    a = rows.join(heavy, keys, "left").withColumn("_part", part).drop("_parts")
    b = table.join(heavy, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return a.join(b, [*keys, "_part"], how).drop("_part")


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of one image side by side -> (image_id, node, root), root the lowest node of the component."""
    at, parent, out = None, {}, []

    def find(n):
        top = n
        while parent[top] != top:
            top = parent[top]
        while parent[n] != top:
            parent[n], n = top, parent[n]
        return top
    for b in batches:
        for image, u, v in zip(b["image_id"], b["u"], b["v"], strict=True):
            if image != at:
                out += [(at, n, find(n)) for n in parent]
                at, parent = image, {}
            a, c = find(parent.setdefault(u, u)), find(parent.setdefault(v, v))
            parent[max(a, c)] = min(a, c)
        if out:
            yield pd.DataFrame(out, columns=["image_id", "node", "root"])
            out = []
    if parent:
        yield pd.DataFrame([(at, n, find(n)) for n in parent], columns=["image_id", "node", "root"])


def _rounds(edges: DataFrame) -> DataFrame:
    """(image_id, node, root) of large images. Every round a node takes the lowest root among its neighbours and then the root of that root, so the number of rounds
    grows with the logarithm of the diameter. Hubs and roots of large components are split keys."""
    both = cut(edges.unionByName(edges.select("image_id", C("v").alias("u"), C("u").alias("v"))).distinct())
    degree = cut(both.groupBy("image_id", C("u").alias("node")).agg(F.count("*").alias("_rows")))
    lab = degree.select("image_id", "node", C("node").alias("root"))
    while True:
        labels = lab.join(degree, ["image_id", "node"]).withColumnRenamed("node", "v")
        near = spread_join(both, labels, ["image_id", "v"], ["u"]).groupBy("image_id", C("u").alias("node")).agg(F.min("root").alias("near"))
        step = cut(lab.join(near, ["image_id", "node"]).select("image_id", "node", C("root").alias("old"), F.least("root", "near").alias("mid")))
        # roots of roots: what any follower of a root has found is passed on to all of them
        hop = step.groupBy("image_id", C("old").alias("mid")).agg(F.min("mid").alias("hop"))
        hop = hop.join(step.groupBy("image_id", "mid").agg(F.count("*").alias("_rows")), ["image_id", "mid"])
        new = cut(spread_join(step, hop, ["image_id", "mid"], ["node"], "left").select("image_id", "node", "old", F.least("mid", F.coalesce("hop", "mid")).alias("root")))
        lab = new.select("image_id", "node", "root")
        if new.filter("root <> old").isEmpty():
            return lab


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components by image: nodes(image_id, node), edges(image_id, u, v) -> root = lowest node. One shuffle brings the edges of an
    image side by side; images of more than LARGE edges are labelled by rounds of joins instead. Edges with a null don't count."""
    e = edges.select("image_id", "u", "v").dropna().distinct()
    kind = {f.name: f.dataType.simpleString() for f in e.schema}
    big = cut(e.groupBy("image_id").agg(F.count("*").alias("n")).filter(C("n") > LARGE).select("image_id"))
    small = e if big.isEmpty() else e.join(big, "image_id", "left_anti")
    lab = small.repartition("image_id").sortWithinPartitions("image_id").mapInPandas(_union_find, f"image_id {kind['image_id']}, node {kind['u']}, root {kind['u']}")
    if small is not e:
        lab = lab.unionByName(_rounds(e.join(big, "image_id", "left_semi")))
    return nodes.join(lab, ["image_id", "node"], "left").select("image_id", "node", F.coalesce("root", "node").alias("root"))
