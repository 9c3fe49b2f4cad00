"""Near-duplicate documents by a chosen-path set similarity join. In each of several independent trees the documents branch by minwise
values that a hash of their path selects; small nodes are compared exhaustively on sketches, in larger ones the documents branch again;
candidates are confirmed on full sets of shingles."""
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .graph import components

#: words of a shingle and percent of similarity, unless given
SHINGLE, PERCENT = 5, 80
#: minwise values of a sketch
SKETCH = 64
#: independent trees, and branches of a document at a node below the root. A pair of similarity 0.8 shares a root branch of one tree with
#: chance 0.8 and each further level with 1 - 0.2^2 = 0.96, so that all trees miss it with chance (1 - 0.8 x 0.96^2)^TREES < 1e-6
TREES, BRANCHES = 12, 2
#: documents of a node that are compared exhaustively, and levels below the root
NODE, LEVELS = 2_048, 3
#: of SKETCH values, so many less than expected at the threshold still make a candidate: nearly five standard errors
SLACK = 15

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_S = np.uint64(31)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> _S)


_rng = np.random.default_rng(20_240)
_A = _rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


class _Words(dict):
    """Word -> 64-bit hash; emptied when it has grown large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


def shingles(text: str | None, size: int, memo: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. Words are runs of anything but space and the controls 9 to 13, A-Z lower-cased; a text of
    fewer words is one shingle, one without words has none."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
    n = min(size, len(ws))
    out = np.full(len(ws) - n + 1, np.uint64(n))
    for k in range(n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(ws) - n + 1 + k])
    return np.unique(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH minwise values of 32 bits."""
    least = np.full(SKETCH, np.uint64(0xFFFFFFFFFFFFFFFF))
    # in pieces, so that a very long text needs no large table
    for lo in range(0, len(s), 4_096):
        least = np.minimum(least, (_A[:, None] * s[None, lo:lo + 4_096] + _B[:, None]).min(1))
    return (_mixed(least) >> np.uint64(32)).astype(np.uint32)


def sketched(docs: DataFrame, text: str, size: int) -> DataFrame:
    """Adds _n (size of the set), _set (two 64-bit digests of it; null if empty) and _sketch (bytes)."""
    @F.pandas_udf("struct<n:bigint,d:string,s:binary>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = _Words()
        for texts in batches:
            n, d, s = [], [], []
            for t in texts:
                x = shingles(t, size, memo)
                n.append(len(x))
                d.append(xxhash.xxh3_128_hexdigest(x.tobytes()) if len(x) else None)
                s.append(sketch(x).tobytes() if len(x) else None)
            yield pd.DataFrame({"n": n, "d": d, "s": s})
    return docs.withColumn("_m", made(F.col(text))).withColumns({"_n": F.col("_m.n"), "_set": F.col("_m.d"), "_sketch": F.col("_m.s")}).drop("_m")


def _values(sketches: list) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(s) for s in sketches), np.uint32).reshape(-1, SKETCH)


def _branch(nodes: DataFrame, root: bool) -> DataFrame:
    """id, sketch, tree, node -> the same with the child nodes: at the root one coordinate for each tree, below BRANCHES of them, all chosen by a hash of the path."""
    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            values = _values(b["sketch"].tolist()).astype(np.uint64)
            if root:
                # every tree has a path of its own and begins at a coordinate of its own
                path = np.broadcast_to(_mixed(np.arange(1, TREES + 1, dtype=np.uint64)), (len(b), TREES))
                at = np.broadcast_to(np.arange(TREES) * (SKETCH // TREES), (len(b), TREES))
            else:
                path = np.repeat(b["node"].to_numpy(np.int64).astype(np.uint64)[:, None], BRANCHES, 1)
                path = _mixed(path + np.arange(1, BRANCHES + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
                at = (path % np.uint64(SKETCH)).astype(np.int64)
            child = _mixed(path * np.uint64(0x9E3779B97F4A7C15) + np.take_along_axis(values, at, 1)).astype(np.int64)
            row = np.repeat(np.arange(len(b)), child.shape[1])
            yield pd.DataFrame({"id": b["id"].to_numpy()[row], "node": child.ravel()})
    return nodes.mapInPandas(children, "id bigint, node bigint")


def _leaves(reps: DataFrame) -> DataFrame:
    """id, node, part, whole: the nodes of all trees that are compared exhaustively. Nodes of one document are left out. A node that is still large after
    LEVELS levels is dealt into blocks, and every pair of blocks is a leaf of its own."""
    sketches = reps.select("id", "sketch")
    level = _branch(sketches.withColumn("node", F.lit(0).cast("bigint")), True)
    done = None
    for depth in range(LEVELS + 1):
        level = written(level, f"level{depth}")
        sizes = level.groupBy("node").agg(F.count("*").alias("count"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")).where("count > 1")
        # trees agree on most groups of near copies: nodes with the same members are compared once
        fresh = sizes.where(F.col("count") <= NODE).groupBy("count", "x", "y").agg(F.min("node").alias("node")).select("node")
        small = level.join(fresh, "node").select("id", "node", F.lit(0).cast("bigint").alias("part"))
        done = small if done is None else done.unionByName(small)
        level = written(level.join(sizes.where(F.col("count") > NODE).select("node", "count"), "node"), f"large{depth}")
        if level.limit(1).count() == 0:
            return done.withColumn("side", F.lit(0))
        if depth < LEVELS:
            level = _branch(level.select("id", "node").join(sketches, "id"), False)
    blocks = level.withColumn("n", F.ceil(2 * F.col("count") / NODE)).withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("o")
    pairs = (blocks.select("id", "node", "n", "b", other)
             .select("id", "node", (F.least("b", "o") * F.col("n") + F.greatest("b", "o") + 1).alias("part"),
                     F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2).alias("side")))
    return done.withColumn("side", F.lit(0)).unionByName(pairs)


def _dealt(leaves: DataFrame, rows: int, each: int) -> DataFrame:
    """A column bucket: leaves are dealt to groups of about `each` rows, so that a call of Python handles many of them. No leaf has more than NODE rows."""
    return leaves.withColumn("bucket", F.pmod(F.xxhash64("node", "part"), F.lit(max(1, -(-rows // each)))))


def _leaf_ranges(d: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
    d = d.sort_values(["node", "part", "id"], ignore_index=True)
    node, part = d["node"].to_numpy(), d["part"].to_numpy()
    cuts = np.flatnonzero((node[1:] != node[:-1]) | (part[1:] != part[:-1])) + 1
    return d, list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(d)], strict=True))


def _forests(leaves: DataFrame, percent: int) -> DataFrame:
    """(a, b, left = 0): for each leaf a forest of its most alike pairs, among those whose sketches and sizes allow the similarity; at most as many as it has
    documents. A leaf that has more such pairs also gives a row (node, part, how many)."""
    need = SKETCH * percent // 100 - SLACK

    def within(d: pd.DataFrame) -> pd.DataFrame:
        d, ranges = _leaf_ranges(d)
        all_ids, all_n, all_v, all_side = d["id"].to_numpy(), d["n"].to_numpy(), _values(d["sketch"].tolist()), d["side"].to_numpy()
        out = []
        for lo, hi in ranges:
            ids, n, v, side = all_ids[lo:hi], all_n[lo:hi], all_v[lo:hi], all_side[lo:hi]
            if hi - lo == 2 and (side[0] == 0 or side[0] != side[1]):
                if (v[0] == v[1]).sum() >= need and 100 * n.min() >= percent * n.max():
                    out.append((ids[0], ids[1], 0))
                continue
            # Prim's forest over the sketches
            best, link, open_, total, mine = np.zeros(hi - lo, np.int64), np.full(hi - lo, -1), np.ones(hi - lo, bool), 0, 0
            for _ in range(hi - lo):
                i = int(np.where(open_, best, -1).argmax())
                if link[i] >= 0:
                    out.append((ids[link[i]], ids[i], 0))
                    mine += 1
                open_[i] = False
                same = (v == v[i]).sum(1)
                fit = (same >= need) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
                if side[i]:
                    fit &= side != side[i]
                fit[i] = False
                total += int(fit.sum())
                better = open_ & fit & (same > best)
                best[better], link[better] = same[better], i
            if total // 2 > mine:
                # the leaf has to be seen again unless its documents turn out to be one component
                out.append((d["node"].iloc[lo], d["part"].iloc[lo], total // 2 - mine))
        return pd.DataFrame(out, columns=["a", "b", "left"]).astype("int64")
    return leaves.groupBy("bucket").applyInPandas(within, "a bigint, b bigint, left bigint")


def _linked(sets: list[np.ndarray], percent: int, comp: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links between different components of a group, found on full sets until there is one component or no pair is left; comp is merged on the way. Postings
    of the shingles count the intersections of one document with all others at a time."""
    n = np.array([len(x) for x in sets], np.int64)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    posting = np.repeat(np.arange(len(sets)), n)[np.argsort(code, kind="stable")]
    first, at = np.concatenate(([0], np.cumsum(np.bincount(code)))), np.concatenate(([0], np.cumsum(n)))
    for i in range(len(sets)):
        others = comp != comp[i]
        if not others.any():
            return
        own = code[at[i]:at[i + 1]]
        size = first[own + 1] - first[own]
        where = np.repeat(first[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        common = np.bincount(posting[where], minlength=len(sets))
        near = others & (100 * common >= percent * (n + n[i] - common))
        if side is not None and side[i]:
            near &= side != side[i]
        for j in np.flatnonzero(near).tolist():
            if comp[j] != comp[i]:
                yield i, j
                comp[comp == comp[j]] = comp[i]


def _exhaust(leaves: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different components (column root) of each leaf, on full sets (column s)."""
    def within(d: pd.DataFrame) -> pd.DataFrame:
        d, ranges = _leaf_ranges(d)
        out = []
        for lo, hi in ranges:
            part = d.iloc[lo:hi]
            ids = part["id"].tolist()
            _, comp = np.unique(part["root"].to_numpy(), return_inverse=True)
            out += [(ids[i], ids[j]) for i, j in _linked([np.asarray(x, np.int64) for x in part["s"]], percent, comp.copy(), part["side"].to_numpy())]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    return leaves.groupBy("bucket").applyInPandas(within, "a bigint, b bigint")


def _settle(texts: DataFrame, percent: int, size: int) -> DataFrame:
    """id, root (smallest id) of the rows id, comp, text: the groups comp are compared exhaustively on full sets."""
    def within(d: pd.DataFrame) -> pd.DataFrame:
        memo = _Words()
        d = d.sort_values(["comp", "id"], ignore_index=True)
        comp = d["comp"].to_numpy()
        cuts = np.flatnonzero(comp[1:] != comp[:-1]) + 1
        root = d["id"].to_numpy().copy()
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(d)], strict=True):
            sets = [shingles(t, size, memo) for t in d["text"].iloc[lo:hi]]
            if len(sets) == 2:
                k = len(np.intersect1d(*sets, assume_unique=True))
                if 100 * k >= percent * (len(sets[0]) + len(sets[1]) - k):
                    root[lo + 1] = root[lo]
                continue
            label = np.arange(hi - lo)
            for _ in _linked(sets, percent, label):
                pass
            _, at, back = np.unique(label, return_index=True, return_inverse=True)
            root[lo:hi] = d["id"].to_numpy()[lo:hi][at][back]  # rows are in the order of ids: the first of a component is its smallest
        return pd.DataFrame({"id": d["id"], "root": root})
    return texts.groupBy("bucket").applyInPandas(within, "id bigint, root bigint")


#: up to this number of ids (some 40 bytes each) a semi join sends them to every task, so that texts aren't shuffled
BROADCAST_IDS = 300_000


def _texts(named: DataFrame, reps: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """Text beside the rows named (id and more); only their documents are read again. Where the table repeats rows, one of each is taken."""
    named = written(named.join(reps.select("id", F.col("key").alias("_key"), "print"), "id"), "named")
    if named.count() <= BROADCAST_IDS:
        named = F.broadcast(named)
    found = docs.join(named, (docs["print"] == named["print"]) & docs["key"].eqNullSafe(named["_key"])).drop("key", "_key", "print")
    return found.dropDuplicates(["id"]) if repeated else found


def _sets(ids: DataFrame, reps: DataFrame, docs: DataFrame, size: int, repeated: bool) -> DataFrame:
    """id, s (full set) of the ids."""
    @F.pandas_udf("array<bigint>")
    def full(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _Words()
        for texts in batches:
            yield pd.Series([shingles(t, size, memo).astype(np.int64) for t in texts], dtype=object)
    return written(_texts(ids.distinct(), reps, docs, repeated).select("id", full(F.col("text")).alias("s")), "sets")


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, size: int, repeated: bool) -> DataFrame:
    """Those pairs of ids whose full sets are similar enough: 100 x intersection >= percent x union."""
    sets = _sets(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), reps, docs, size, repeated)
    p = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return p.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


#: a group of candidates of at most so many documents and so many shingles is settled in one task
GROUP_DOCS, GROUP_WORDS = 4_096, 4_000_000


def _settle_large(leaves, found, pairs, large, reps, docs, percent: int, size: int, repeated: bool) -> DataFrame:
    """node, root for groups of any size: the forests' pairs are confirmed one by one; leaves that had more pairs and are still several
    components are compared again, exhaustively."""
    links = written(_confirmed(pairs, reps, docs, percent, size, repeated), "links")
    comp = components(links)
    open_ = found.where("left > 0").select(F.col("a").alias("node"), F.col("b").alias("part"))
    rooted = (leaves.join(large, "id", "left_semi").join(open_, ["node", "part"]).join(comp.withColumnRenamed("node", "id"), "id", "left")
              .withColumn("root", F.coalesce("root", "id")))
    several = rooted.groupBy("node", "part").agg((F.min("root") != F.max("root")).alias("m")).where("m").select("node", "part")
    again = written(rooted.join(several, ["node", "part"]), "again")
    rows = again.count()
    if rows:
        more = _exhaust(_dealt(again.join(_sets(again.select("id"), reps, docs, size, repeated), "id"), rows, NODE // 4), percent)
        links = written(links.unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "links")
        comp = components(links)
    return comp


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id (smallest key that links lead to, its own included), kept (key is component_id), print
    (xxhash64 of the text, which with the key names the row).

    Rows with equal sets are one node of the search from the start, so a crowd of exact copies costs nothing further. Null and empty texts and texts
    without words have no shingles and are linked with nothing: component_id is the own key. Null keys are never the smallest; a component of null
    keys only has a null component_id, and kept is false for null keys. Rows that repeat a key stay rows of their own and share its component_id
    where they are linked. Extra columns are ignored. An empty table gives an empty result.

    Links between different sets: none is lost but by the sketches (see TREES, SLACK). A forest of the candidates of each leaf connects the groups; within
    a group every pair is decided on full sets (_settle; _settle_large for groups beyond GROUP_DOCS or GROUP_WORDS, with the same result).
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("print"))
    made = written(sketched(d, "text", size).select("key", "print", F.col("_n").alias("n"), F.col("_set").alias("set"), F.col("_sketch").alias("sketch")), "sketches")
    repeated = made.groupBy("key", "print").count().where("count > 1").limit(1).count() > 0
    # one row for each different set; crowds of copies meet in a partial aggregate
    reps = (made.where(F.col("set").isNotNull()).groupBy("set").agg(F.min(F.struct("key", "print", "n", "sketch")).alias("m"), F.min("key").alias("least"))
            .select("set", "m.*", "least").withColumn("id", F.monotonically_increasing_id()))
    reps = written(reps, "reps")  # ids are settled here
    leaves = written(_leaves(reps), "leaves")
    rows = leaves.count()
    found = written(_forests(_dealt(leaves.join(reps.select("id", "sketch", "n"), "id"), rows, 4 * NODE), percent), "candidates")
    pairs = found.where("left = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # the forests connect what candidates connect. Groups of a bounded size are settled in one task each, every pair of them on full sets
    loose = components(pairs).withColumnRenamed("node", "id").withColumnRenamed("root", "comp")
    sizes = loose.join(reps.select("id", "n"), "id").groupBy("comp").agg(F.count("*").alias("docs"), F.sum("n").alias("words"))
    bounded = (F.col("docs") <= GROUP_DOCS) & (F.col("words") <= GROUP_WORDS)
    loose = written(loose.join(sizes, "comp").withColumn("bounded", bounded), "groups")
    total = loose.where("bounded").agg(F.sum("words"), F.count("*")).first()
    buckets = max(1, -(-(total[1] or 0) // (GROUP_DOCS // 2)))
    near = loose.where("bounded").select("id", "comp", F.pmod(F.xxhash64("comp"), F.lit(buckets)).alias("bucket"))
    comp = written(_settle(_texts(near, reps, d, repeated), percent, size), "settled").withColumnRenamed("id", "node")
    if loose.where("NOT bounded").limit(1).count():
        large = loose.where("NOT bounded").select("id")
        comp = comp.unionByName(_settle_large(leaves, found, pairs.join(large.withColumnRenamed("id", "a"), "a", "left_semi"), large, reps, d, percent, size, repeated))
    rooted = (reps.select("id", "set", "least").join(comp.withColumnRenamed("node", "id"), "id", "left")
              .select("set", F.coalesce("root", "id").alias("root"), "least"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("set", "component")
    out = made.select("key", "n", "set", "print").join(named, "set", "left")
    component = F.when(F.col("set").isNull(), F.col("key")).otherwise(F.col("component"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"), "print")
