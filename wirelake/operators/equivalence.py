"""Circuit equivalence: labelled multigraphs up to renaming of the nets.

Equivalence is a partition, so every circuit gets a class id once and comparing two circuits, or
counting equal pairs in a group, is a comparison of ids. No pairs are formed."""
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import value_label
from ..session import cut
from .canonical import canonical_form

C = F.col
#: circuits with more elements have their colours refined by Spark; the others go through one grouped step
LARGE = 20_000
KINDS = {"topology": False, "exact": True}


def _lanes(h: Column) -> list[Column]:
    """Multiset hash of a group: sums of the two halves of a 64-bit hash (no collect, order-free)."""
    return [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("_lo"), F.sum(F.shiftrightunsigned(h, 32)).alias("_hi"), F.count("*").alias("_n")]


def _edges(elements: DataFrame, kinds: list[str]) -> DataFrame:
    labels = [F.coalesce(value_label(C("prefix"), C("num"), C("txt"), KINDS[k]), F.lit("")).alias(k) for k in kinds]
    return elements.filter("circuit_id IS NOT NULL").select("circuit_id", *labels, C("prefix").isin("D", "V").alias("polar"), "n1", "n2")


def _colours(edges: DataFrame) -> DataFrame:
    """Colour refinement: a net's colour hashes the labels, sides and neighbour colours around it. Rounds go on until the number of
    colours stands still over all circuits, so the result is the coarsest stable colouring whatever the graphs are."""
    side = lambda k: F.when(C("polar"), F.lit(k)).otherwise(F.lit(2))
    ends = cut(edges.select("circuit_id", F.explode(F.array(
        F.struct(C("n1").alias("net"), C("n2").alias("other"), F.xxhash64("label", side(0)).alias("h")),
        F.struct(C("n2").alias("net"), C("n1").alias("other"), F.xxhash64("label", side(1)).alias("h")))).alias("e"))
        .select("circuit_id", "e.net", "e.other", "e.h"))
    fold = lambda d: d.groupBy("circuit_id", "net").agg(*_lanes(C("h"))).select(
        "circuit_id", "net", F.xxhash64("_lo", "_hi", "_n").alias("colour"))
    col, before = cut(fold(ends)), -1
    while True:
        now = col.select("circuit_id", "colour").distinct().count()
        if now == before:
            return col
        before = now
        near = ends.join(col.select("circuit_id", C("net").alias("other"), "colour"), ["circuit_id", "other"])
        new = fold(near.select("circuit_id", "net", F.xxhash64("h", "colour").alias("h")))
        col = cut(new.withColumnRenamed("colour", "c2").join(col, ["circuit_id", "net"]).select(
            "circuit_id", "net", F.xxhash64("colour", "c2").alias("colour")))


def _hashed(form: str) -> str:
    return hashlib.sha256(form.encode()).hexdigest()


def _forms(edges: DataFrame, kinds: list[str], colours: bool = False) -> DataFrame:
    """(circuit_id, one class id for each kind) by the canonical form of each circuit. Rows of a circuit come side by side in a sorted partition,
    so a task holds one circuit at a time. With `colours`, columns c1 and c2 tell the nets apart already."""
    def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows = None, []

        def done() -> list:
            found = {r[-4]: r[-2] for r in rows} | {r[-3]: r[-1] for r in rows} if colours else {}
            rank = {c: i for i, c in enumerate(sorted(set(found.values())))}
            start = {n: rank[c] for n, c in found.items()}
            n = len(kinds)
            return [at, *(_hashed(canonical_form([(r[k], r[n], r[n + 1], r[n + 2]) for r in rows], start or None)) for k in range(n))]
        for b in batches:
            out = []
            for circuit, *row in zip(*[b[c] for c in b.columns], strict=True):
                if circuit != at:
                    if rows:
                        out.append(done())
                    at, rows = circuit, []
                rows.append(row)
            if out:
                yield pd.DataFrame(out, columns=["circuit_id", *kinds])
        if rows:
            yield pd.DataFrame([done()], columns=["circuit_id", *kinds])
    d = edges.select("circuit_id", *kinds, "polar", "n1", "n2", *(["c1", "c2"] if colours else []))
    kind = d.schema["circuit_id"].dataType.simpleString()
    return d.repartition("circuit_id").sortWithinPartitions("circuit_id").mapInPandas(settled, f"circuit_id {kind}, " + ", ".join(f"{k} string" for k in kinds))


def _large(edges: DataFrame, kind: str) -> DataFrame:
    """(circuit_id, class id) of large circuits: a fingerprint of the stable colours where all nets have different ones, else the canonical
    form that starts from them."""
    edges = edges.withColumnRenamed(kind, "label")
    col = cut(_colours(edges))
    c = lambda k: col.select("circuit_id", C("net").alias("n" + k), C("colour").alias("c" + k))
    e = edges.join(c("1"), ["circuit_id", "n1"]).join(c("2"), ["circuit_id", "n2"])
    lo, hi = F.least("c1", "c2"), F.greatest("c1", "c2")
    edge_hash = F.when(C("polar"), F.xxhash64("label", "c1", "c2")).otherwise(F.xxhash64("label", lo, hi))
    by_edge = e.groupBy("circuit_id").agg(*_lanes(edge_hash)).select("circuit_id", F.concat_ws(":", "_lo", "_hi", "_n").alias("fe"))
    per_colour = col.groupBy("circuit_id", "colour").agg(F.count("*").alias("m"))
    by_net = per_colour.groupBy("circuit_id").agg(*_lanes(F.xxhash64("colour", "m")), F.max("m").alias("tied")).select(
        "circuit_id", F.concat_ws(":", "_lo", "_hi", "_n").alias("fn"), "tied")
    fp = cut(by_edge.join(by_net, "circuit_id").select("circuit_id", F.concat_ws("/", "fe", "fn").alias("fp"), (C("tied") > 1).alias("tied")))
    tied = e.join(fp.filter("tied").select("circuit_id"), "circuit_id", "left_semi").withColumnRenamed("label", kind)
    return fp.filter("NOT tied").select("circuit_id", C("fp").alias(kind)).unionByName(_forms(tied, [kind], colours=True))


def _first_alike(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """(circuit_id, first): the lowest circuit whose elements are the same, net names included, in any order."""
    keep = C("polar") | (C("n1") <= C("n2"))
    edge = F.struct(*kinds, "polar", F.when(keep, C("n1")).otherwise(C("n2")).alias("a"), F.when(keep, C("n2")).otherwise(C("n1")).alias("b"))
    d = cut(edges.groupBy("circuit_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(edge))), 256).alias("_print")))
    return d.join(d.groupBy("_print").agg(F.min("circuit_id").alias("first")), "_print").select("circuit_id", "first")


def class_ids(elements: DataFrame, circuits: DataFrame, kinds: list[str]) -> DataFrame:
    """circuit_id and one class id for each of kinds ("topology": labels without values, "exact": with them): equal ids exactly where the
    circuits are equivalent. Circuits that are the same as they stand are settled once; one shuffle by circuit gives the canonical forms of all kinds. No circuit is
    compared with another. Circuits of more than LARGE elements are refined by Spark first, so that only those whose nets stay tied are held by a task.
    Circuits without elements form one class of their own."""
    e = cut(_edges(elements, kinds))
    big = cut(e.groupBy("circuit_id").agg(F.count("*").alias("n")).filter(C("n") > LARGE).select("circuit_id"))
    none = big.isEmpty()
    small = e if none else e.join(big, "circuit_id", "left_anti")
    alike = cut(_first_alike(small, kinds))
    forms = cut(_forms(small.join(alike.filter("circuit_id = first").select("circuit_id"), "circuit_id", "left_semi"), kinds))
    ids = alike.join(forms.withColumnRenamed("circuit_id", "first"), "first").select("circuit_id", *kinds)
    if not none:
        large = big
        for k in kinds:
            large = large.join(_large(cut(e.join(big, "circuit_id", "left_semi").select("circuit_id", k, "polar", "n1", "n2")), k), "circuit_id")
        ids = ids.unionByName(large)
    return circuits.join(ids, "circuit_id", "left").fillna("empty", kinds)


def classes(elements: DataFrame, circuits: DataFrame, values: bool = True) -> DataFrame:
    """(circuit_id, class_id), with or without values."""
    kind = "exact" if values else "topology"
    return class_ids(elements, circuits, [kind]).withColumnRenamed(kind, "class_id")


def compared(pairs: DataFrame, cls: DataFrame, out: str) -> DataFrame:
    """pairs(circuit_id, ref_id) with a flag: same class."""
    r = cls.select(C("circuit_id").alias("ref_id"), C("class_id").alias("_r"))
    d = pairs.join(cls, "circuit_id").join(r, "ref_id")
    return d.withColumn(out, C("class_id") == C("_r")).drop("class_id", "_r")


def consistency(photos: DataFrame, cls: DataFrame) -> DataFrame:
    """photos(circuit_id, drafter, circuit, drawing): photo pairs of one drawing and how many of them are
    equivalent, from the sizes of the equivalence classes."""
    keys = ["drafter", "circuit", "drawing"]
    n = photos.join(cls, "circuit_id").groupBy(*keys, "class_id").agg(F.count("*").alias("m"))
    half = lambda x: F.floor(x * (x - 1) / 2)
    return n.groupBy(*keys).agg(F.sum("m").alias("photos"), F.sum(half(C("m"))).alias("same")) \
            .filter("photos > 1").withColumn("pairs", half(C("photos")))
