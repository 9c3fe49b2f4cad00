"""Tagged sentences -> entities -> series/parallel structure -> netlist.

Each sentence stays one row; its tokens are folded in order with higher-order functions. A structure
is struct(kind, n, text[], leaves[(cls, value, path[])]): kind E, S or P, the number and canonical
texts of its children, and for every leaf the child positions from the root down. Kinds alternate
from level to level, because a child of the same kind is merged into its parent."""
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.symbols import literal_map
from ..functions.wording import explained, tokens
from ..vocabulary import COUNT_WORDS, ELEMENT_DEFAULT, ELEMENT_PREFIX, LEAF, NOUN_CLASS, TOKEN
from ..session import cut, spread
from . import netlists as N, tagging

C = F.col
SPAN = "struct<s:int,e:int,text:string>"
LEAVES = "array<struct<cls:string,value:string,path:array<int>>>"
NODE = f"struct<kind:string,n:int,text:array<string>,leaves:{LEAVES}>"
ITEM = f"struct<pos:double,kind:string,cls:string,value:string,node:{NODE}>"     # node: what a closed parenthesis holds


def _empty(of: str) -> Column:
    return F.array().cast(f"array<{of}>")


def _index(a: str) -> Column:
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(_empty("int"))


def _null(of: str) -> Column:
    return F.lit(None).cast(of)


def staged(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose expression later steps must not take apart: a one-element explode keeps the
    optimizer from copying it into everything that refers to it."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name))


def value_spans() -> Column:
    """VAL tokens, each with the UNIT tokens after it while the whole is still a value."""
    def step(st, i):
        w, t, cur = F.get("words", i), F.get("tags", i), st["cur"]
        joined = F.concat(cur["text"], w)
        glue = cur.isNotNull() & (t == "UNIT") & V.sentence_value(joined, F.lit("resistor")).isNotNull()
        done = F.when(cur.isNotNull() & ~glue, F.array_append(st["done"], cur)).otherwise(st["done"])
        span = lambda s, text: F.struct(s.alias("s"), (i + 1).alias("e"), text.alias("text")).cast(SPAN)
        nxt = F.when(t == "VAL", span(i, w)).when(glue, span(cur["s"], joined)).otherwise(_null(SPAN))
        return F.struct(done.alias("done"), nxt.alias("cur"))
    zero = F.struct(_empty(SPAN).alias("done"), _null(SPAN).alias("cur"))
    return F.aggregate(_index("words"), zero, step, lambda st: F.when(st["cur"].isNotNull(), F.array_append(st["done"], st["cur"])).otherwise(st["done"]))


PICK = f"struct<n:int,tag:string,pick:{SPAN}>"


def noun_values() -> Column:
    """For every noun the value it takes: the nearest free one on its left with no noun between, else
    on its right. Values lie in the gaps between nouns, and only the first value of a gap can already
    be taken (by the noun before it), so one flag carries the whole history."""
    def step(st, k):
        n, before = F.get("nouns", k), F.coalesce(F.get("nouns", k - 1), F.lit(-1))
        before = F.when(k > 0, before).otherwise(-1)
        after = F.coalesce(F.get("nouns", k + 1), F.size("words"))
        left = F.filter("spans", lambda s: (s["s"] > before) & (s["s"] < n))
        right = F.filter("spans", lambda s: (s["s"] > n) & (s["s"] < after))
        free = F.size(left) > F.when(st["taken"], 1).otherwise(0)
        pick = F.when(free, F.get(left, F.size(left) - 1)).otherwise(F.get(right, F.lit(0)))
        tag_ = F.get("tags", n)
        row = F.struct(n.alias("n"), tag_.alias("tag"), pick.alias("pick")).cast(PICK)
        return F.struct(F.array_append(st["out"], row).alias("out"), (~free & (F.size(right) > 0) & (tag_ != "DIO")).alias("taken"))
    return F.aggregate(_index("nouns"), F.struct(_empty(PICK).alias("out"), F.lit(False).alias("taken")), step, lambda st: st["out"])


def copies(p) -> Column:
    """2 for 'a pair of', the number of a count word, else 1; only for a plural noun after its value."""
    s = p["pick"]["s"]
    prev, prev2 = F.lower(F.get("words", s - 1)), F.lower(F.get("words", s - 2))
    n = F.when((prev == "of") & (s > 1) & (prev2 == "pair"), 2).otherwise(F.coalesce(F.try_element_at(literal_map(COUNT_WORDS), prev), F.lit(1)))
    plural = F.lower(F.get("words", p["n"])).endswith("s")
    return F.when(p["pick"].isNotNull() & (s < p["n"]) & (s > 0) & plural, n).otherwise(1)


def _item(pos, kind, cls=None, value=None, node=None):
    s = lambda c: _null("string") if c is None else c
    return F.struct(pos.cast("double").alias("pos"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"),
                    s(cls).alias("cls"), s(value).alias("value"), (_null(NODE) if node is None else node).alias("node")).cast(ITEM)


def claims() -> Column:
    """Nouns with the class and number of copies they stand for."""
    def noun(p):
        text, diode = p["pick"]["text"], p["tag"] == "DIO"
        own = F.try_element_at(literal_map(NOUN_CLASS), p["tag"])
        cls = F.when(diode | p["pick"].isNull(), own).otherwise(F.coalesce(V.unit_class(text), F.when(own == "voltage_source", "resistor").otherwise(own)))
        return F.struct(p["n"].alias("n"), cls.alias("cls"), F.when(~diode, text).alias("text"), F.when(~diode, p["pick"]["s"]).alias("s"), copies(p).alias("copies"))
    return F.transform("picks", noun)


def loose_values() -> Column:
    """Values no noun took, away from diodes, with the class their unit implies."""
    taken = F.transform(F.filter("claims", lambda p: p["s"].isNotNull()), lambda p: p["s"])
    tag_at = lambda k: F.coalesce(F.get("tags", k), F.lit(""))
    by_diode = lambda s: (tag_at(s["s"] + 1) == "DIO") | ((s["s"] > 0) & (tag_at(s["s"] - 1) == "DIO"))
    loose = F.filter("spans", lambda s: ~F.array_contains(taken, s["s"]) & ~by_diode(s))
    return F.transform(loose, lambda s: F.struct(s["s"].alias("s"), s["text"].alias("text"), F.coalesce(V.unit_class(s["text"]), F.lit("resistor")).alias("cls")))


def items() -> Column:
    """Entities, operators, separators and parentheses in text order."""
    def noun(p):
        value = V.sentence_value(p["text"], p["cls"])
        return F.transform(F.sequence(F.lit(0), p["copies"] - 1), lambda k: _item(p["n"] + k / 10, "ENT", p["cls"], value))

    def word(i):
        w, t = F.get("words", i), F.get("tags", i)
        return (F.when(w == "(", _item(i, "LP")).when(w == ")", _item(i, "RP")).when(t == "SER", _item(i, "OP", F.lit("S")))
                .when(t == "PAR", _item(i, "OP", F.lit("P"))).when(t == "SEP", _item(i, "SEP")))
    back_off = F.transform("loose", lambda s: _item(s["s"], "ENT", s["cls"], V.sentence_value(s["text"], s["cls"])))
    parts = [F.flatten(F.transform("claims", noun)), F.filter(back_off, lambda x: x["value"].isNotNull()),
             F.filter(F.transform(_index("words"), word), lambda x: x.isNotNull())]
    return F.array_sort(F.concat(*parts))


def chunked(tagged: DataFrame) -> DataFrame:
    """tagged(id, words, tags, ...) with spans, picks and items."""
    d = staged(tagged, "nouns", F.filter(_index("tags"), lambda i: F.get("tags", i).isin(*NOUN_CLASS)))
    for name, make in (("spans", value_spans), ("picks", noun_values), ("claims", claims), ("loose", loose_values), ("items", items)):
        d = staged(d, name, make())
    return d.drop("nouns", "claims", "loose")


def per_text(sentences: DataFrame, work) -> DataFrame:
    """sentences(id, text, ...) with the columns that work(texts) adds to a table of their distinct texts. What is read out of a sentence depends on its text
    only, so a text that comes often is taken apart once; the texts are dealt over all tasks, however few row groups hold them."""
    texts = work(spread(sentences.select("text").distinct(), "text"))
    rows = spread(sentences, "id").alias("s").join(texts.alias("t"), C("s.text").eqNullSafe(C("t.text")), "inner")
    return rows.select("s.*", *[C(f"t.{c}") for c in texts.columns if c not in sentences.columns])


def entities(chunks: DataFrame) -> DataFrame:
    d = chunks.select("id", F.explode(F.filter("items", lambda x: x["kind"] == "ENT")).alias("x"))
    return d.select("id", "x.pos", "x.cls", "x.value")


# ---- structure ----
def _text(node) -> Column:
    ordered = F.when(node["kind"] == "P", F.array_sort(node["text"])).otherwise(node["text"])
    return F.when(node["kind"] == "E", F.get(node["text"], F.lit(0))).otherwise(F.concat(node["kind"], F.lit("("), F.array_join(ordered, ","), F.lit(")")))


def _leaf(it) -> Column:
    text = F.concat(it["cls"], F.lit(":"), F.coalesce(it["value"], F.lit("-")))
    leaf = F.array(F.struct(it["cls"].alias("cls"), it["value"].alias("value"), _empty("int").alias("path"))).cast(LEAVES)
    return F.struct(F.lit("E").alias("kind"), F.lit(1).alias("n"), F.array(text).alias("text"), leaf.alias("leaves")).cast(NODE)


def _joined(kind, a, b) -> Column:
    """kind(a, b); a side of the same kind gives its children, any other side becomes one child."""
    same = lambda x: x["kind"] == kind
    n = lambda x: F.when(same(x), x["n"]).otherwise(1)
    text = lambda x: F.when(same(x), x["text"]).otherwise(F.array(_text(x)))

    def leaves(x, shift):
        deeper = lambda l: F.when(same(x), F.transform(l["path"], lambda v, i: F.when(i == 0, v + shift).otherwise(v))) \
            .otherwise(F.concat(F.array(shift), l["path"]))
        return F.transform(x["leaves"], lambda l: F.struct(l["cls"].alias("cls"), l["value"].alias("value"), deeper(l).alias("path")))
    return F.struct(kind.alias("kind"), (n(a) + n(b)).alias("n"), F.concat(text(a), text(b)).alias("text"),
                    F.concat(leaves(a, F.lit(0)), leaves(b, n(a))).alias("leaves")).cast(NODE)


CLAUSE = f"struct<opener:string,items:array<{ITEM}>>"


def clauses(source="parts") -> Column:
    """Split at a separator that an operator follows, once the clause holds an entity. Operators that
    open a later clause are kept apart: the last one joins the clauses."""
    def step(st, i):
        it = F.get(source, i)
        nxt = F.get(F.filter(F.slice(source, i + 2, F.size(source)), lambda x: x["kind"] != "SEP"), F.lit(0))
        edge = (it["kind"] == "SEP") & F.coalesce(nxt["kind"] == "OP", F.lit(False)) & F.exists(st["cur"], lambda x: x["kind"] == "ENT")
        lead = (F.size(st["cur"]) == 0) & (it["kind"] == "OP") & (F.size(st["done"]) > 0)
        closed = F.array_append(st["done"], F.struct(st["opener"].alias("opener"), st["cur"].alias("items")).cast(CLAUSE))
        return F.struct(F.when(edge, closed).otherwise(st["done"]).alias("done"),
                        F.when(edge, _null("string")).when(lead, it["cls"]).otherwise(st["opener"]).alias("opener"),
                        F.when(edge, _empty(ITEM)).when(lead, st["cur"]).otherwise(F.array_append(st["cur"], it)).alias("cur"))
    zero = F.struct(_empty(CLAUSE).alias("done"), _null("string").alias("opener"), _empty(ITEM).alias("cur"))
    return F.aggregate(_index(source), zero, step, lambda st: F.array_append(
        st["done"], F.struct(st["opener"].alias("opener"), st["cur"].alias("items")).cast(CLAUSE)))


def clause_facts(c) -> Column:
    ents = F.filter(c["items"], lambda x: x["kind"] == "ENT")
    return F.struct(c["opener"].alias("opener"), c["items"].alias("items"), ents.alias("ents"))


def clause_operators(c) -> Column:
    """The clause's last operator, and whether it is a list: a separator inside, an operator at the end."""
    first, last = F.get(c["ents"], F.lit(0))["pos"], F.get(c["ents"], F.size(c["ents"]) - 1)["pos"]
    tail = F.get(F.filter(c["items"], lambda x: (x["kind"] == "OP") & (x["pos"] > last)), F.lit(0))["cls"]
    inner = F.exists(c["items"], lambda x: (x["kind"] == "SEP") & (x["pos"] > first) & (x["pos"] < last))
    ops = F.filter(c["items"], lambda x: x["kind"] == "OP")
    return F.struct(c["opener"].alias("opener"), c["ents"].alias("ents"), ops.alias("ops"), tail.alias("tail"), inner.alias("inner"))


def clause_tree(c) -> Column:
    """List form, or a chain that attaches to the right; parts without an operator between them take
    the clause's last operator, else series."""
    ents, n = c["ents"], F.size(c["ents"])

    def step(tree, k):
        """k counts from the right: entity n-2-k joins what is built of the entities after it."""
        a, b = F.get(ents, n - 2 - k), F.get(ents, n - 1 - k)
        between = F.array_max(F.transform(F.filter(c["ops"], lambda x: (x["pos"] > a["pos"]) & (x["pos"] < b["pos"])),
                                          lambda x: F.struct(x["pos"].alias("pos"), x["cls"].alias("cls"))))["cls"]
        op = F.when(c["inner"] & c["tail"].isNotNull(), c["tail"]).otherwise(F.coalesce(between, c["tail"], F.lit("S")))
        return _joined(op, _operand(a), tree)
    back = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(_empty("int"))
    return F.when(n > 0, F.aggregate(back, _operand(F.get(ents, n - 1)), step))


def _operand(it) -> Column:
    return F.coalesce(it["node"], _leaf(it))


def _clause_steps():
    return clause_facts, clause_operators, lambda c: F.struct(c["opener"].alias("op"), clause_tree(c).alias("node"))


def _fold_clauses(built) -> Column:
    def fold(acc, c):
        return F.when(acc.isNull(), c["node"]).otherwise(_joined(F.coalesce(c["op"], F.lit("S")), acc, c["node"]))
    return F.aggregate(F.filter(built, lambda c: c["node"].isNotNull()), _null(NODE), fold)


def _structure(items_) -> Column:
    """Structure of items without parentheses, as one expression."""
    built = clauses(items_)
    for make in _clause_steps():
        built = F.transform(built, make)
    return _fold_clauses(built)


def grouped() -> Column:
    """Each closed parenthesis becomes one item that carries its structure, from the inside out. An
    opening one that is never closed is ignored."""
    def step(st, it):
        close = (it["kind"] == "RP") & (F.size(st["stack"]) > 0)
        inner = _structure(st["out"])
        item = F.filter(F.array(_item(it["pos"], "ENT", node=inner)), lambda x: x["node"].isNotNull())
        below = F.get(st["stack"], F.size(st["stack"]) - 1)
        stack = F.when(it["kind"] == "LP", F.array_append(st["stack"], st["out"])).when(close, F.slice(st["stack"], 1, F.size(st["stack"]) - 1)).otherwise(st["stack"])
        out = (F.when(it["kind"] == "LP", _empty(ITEM)).when(close, F.concat(below, item)).when(it["kind"] == "RP", st["out"])
               .otherwise(F.array_append(st["out"], it)))
        return F.struct(stack.alias("stack"), out.alias("out"))
    zero = F.struct(_empty(f"array<{ITEM}>").alias("stack"), _empty(ITEM).alias("out"))
    return F.aggregate("parts", zero, step, lambda st: F.concat(F.flatten(st["stack"]), st["out"]))


def structured(chunks: DataFrame) -> DataFrame:
    """Adds source (struct or NULL), tree (structure), tree_text and error."""
    is_src = lambda x: (x["kind"] == "ENT") & (x["cls"] == "voltage_source")
    d = staged(chunks, "source", F.get(F.filter("items", is_src), F.lit(0)))
    d = staged(d, "parts", F.filter("items", lambda x: ~is_src(x)))
    parens = F.exists("parts", lambda x: x["kind"].isin("LP", "RP"))
    d = staged(d, "parts", F.when(parens, grouped()).otherwise(C("parts")))
    d = staged(d, "clauses", clauses())
    for make in _clause_steps():
        d = staged(d, "clauses", F.transform("clauses", make))
    d = staged(d, "tree", _fold_clauses(C("clauses")))
    error = F.when(C("tree").isNull(), "no components found")
    return staged(d.withColumn("error", error), "tree_text", F.when(C("tree").isNotNull(), _text(C("tree")))).drop("clauses")


# ---- netlist ----
def _level_kind(depth) -> Column:
    """Kind of the structure at a depth: the root's kind and the other one in turn."""
    return F.when((C("tree.kind") == "S") == (depth % 2 == 0), "S").otherwise("P")


def netlist(trees: DataFrame, title: Column) -> DataFrame:
    """Adds `netlist`: source between 1 and 0, load across it. The inner nodes of a series get their
    numbers when the series is first met, from 2 upwards."""
    prefixes = F.array_distinct(F.flatten(F.transform("tree.leaves", lambda l: F.transform(
        F.when(F.size(l["path"]) > 0, F.sequence(F.lit(0), F.size(l["path"]) - 1)).otherwise(_empty("int")), lambda j: F.slice(l["path"], 1, j)))))
    series = F.array_sort(F.filter(prefixes, lambda p: _level_kind(F.size(p)) == "S"))
    width = lambda p: F.array_max(F.transform(F.filter("tree.leaves", lambda l: F.slice(l["path"], 1, F.size(p)) == p), lambda l: F.get(l["path"], F.size(p)))) + 1
    grow = "struct<next:int,out:array<struct<p:array<int>,base:int,m:int>>>"

    def number(st, p):
        m = width(p)
        row = F.struct(p.alias("p"), st["next"].alias("base"), m.alias("m"))
        return F.struct((st["next"] + m - 1).alias("next"), F.array_append(st["out"], row).alias("out")).cast(grow)
    zero = F.struct(F.lit(2).alias("next"), _empty("struct<p:array<int>,base:int,m:int>").alias("out")).cast(grow)
    d = staged(staged(trees, "series", series), "series", F.aggregate("series", zero, number, lambda st: st["out"]))

    def ends(l):
        """Walk down the path: a parallel keeps the end nodes, a series hands on its inner ones."""
        def down(st, j):
            here = F.get(F.filter("series", lambda s: s["p"] == F.slice(l["path"], 1, j)), F.lit(0))
            i = F.get(l["path"], j)
            a = F.when(here.isNull() | (i == 0), st["a"]).otherwise(here["base"] + i - 1)
            b = F.when(here.isNull() | (i == here["m"] - 1), st["b"]).otherwise(here["base"] + i)
            return F.struct(a.alias("a"), b.alias("b")).cast("struct<a:int,b:int>")
        levels = F.when(F.size(l["path"]) > 0, F.sequence(F.lit(0), F.size(l["path"]) - 1)).otherwise(_empty("int"))
        return F.aggregate(levels, F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")).cast("struct<a:int,b:int>"), down)
    prefix = lambda c: F.try_element_at(literal_map(ELEMENT_PREFIX), c)
    default = lambda c: F.try_element_at(literal_map(ELEMENT_DEFAULT), c)
    d = staged(d, "placed", F.transform("tree.leaves", lambda l: F.struct(l["cls"].alias("cls"), l["value"].alias("value"), ends(l).alias("n"))))

    def line(l, i):
        no = F.size(F.filter(F.slice("placed", 1, i + 1), lambda x: x["cls"] == l["cls"]))
        return F.concat_ws(" ", F.concat(prefix(l["cls"]), no.cast("string")), l["n"]["a"].cast("string"), l["n"]["b"].cast("string"), F.coalesce(l["value"], default(l["cls"])))
    src = F.concat(F.lit("V1 1 0 "), F.coalesce(C("source.value"), F.lit(ELEMENT_DEFAULT["voltage_source"])))
    model = F.when(F.exists("placed", lambda x: x["cls"] == "diode"), F.array(F.lit(".model DMOD D"))).otherwise(_empty("string"))
    rows = F.concat(F.array(F.concat(F.lit("* "), title), src), F.transform("placed", line), model, F.array(F.lit(".op"), F.lit(".end")))
    return staged(d, "netlist", F.when(C("tree").isNotNull(), F.concat(F.array_join(rows, "\n"), F.lit("\n")))).drop("series", "placed")


def notes() -> Column:
    """Everything that was assumed rather than read from the sentence."""
    dv = ELEMENT_DEFAULT
    lost = lambda cls: F.size(F.filter("tree.leaves", lambda l: (l["cls"] == cls) & l["value"].isNull()))
    fixed = [F.when(C("source").isNull(), f"No voltage source was described; a default {dv['voltage_source']} V source was placed across the circuit.")
             .when(C("source.value").isNull(), f"The source has no voltage; {dv['voltage_source']} V was assumed.")]
    for cls in sorted(("resistor", "capacitor", "inductor")):
        n = lost(cls)
        fixed.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {cls}"), F.when(n > 1, "s").otherwise(""), F.lit(f" had no value; the default {dv[cls]} was used."))))
    counted = F.exists("words", lambda w: F.lower(w).isin(*COUNT_WORDS, "pair"))
    few = F.size(F.filter("tags", lambda t: t == "VAL")) < 2
    plural = F.filter(F.arrays_zip("words", "tags"), lambda x: x["tags"].isin("RES", "CAP", "IND", "DIO") & F.lower(x["words"]).endswith("s"))
    many = F.when(~counted & few, F.transform(plural, lambda x: F.concat(F.lit("'"), x["words"], F.lit("' is plural but no number of parts was given; only one was built.")))).otherwise(_empty("string"))
    return F.when(C("tree").isNotNull(), F.concat(F.array_compact(F.array(*fixed)), many)).otherwise(_empty("string"))


def described(sentences: DataFrame, model: tagging.Model) -> DataFrame:
    """sentences(id, text) -> words, tags, source, tree_text, netlist, errors, notes, error. A sentence
    without components keeps its row and says so."""
    return per_text(sentences.select("id", "text"), lambda d: _described(d, model))


def _described(texts: DataFrame, model: tagging.Model) -> DataFrame:
    """described() of distinct texts, without id."""
    d = tagging.tag(texts.select(F.sha2("text", 256).alias("id"), "text").withColumn("words", tokens(C("text"))), model)
    d = cut(netlist(structured(chunked(d)), F.substring("text", 1, 60)).withColumn("notes", notes()).select(
        "id", "text", "words", "tags", "source", "tree_text", "netlist", "notes", "error"))
    lines = d.filter("netlist IS NOT NULL").select(C("id").alias("circuit_id"), F.posexplode(F.split("netlist", "\n")).alias("pos", "line")) \
             .select("circuit_id", (C("pos") + 1).cast("long").alias("line_no"), "line")
    e = N.errors(lines).groupBy(C("circuit_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "ord", "message"))), lambda x: x["message"]).alias("errors"))
    return d.join(e, "id", "left").withColumn("errors", F.coalesce("errors", _empty("string"))).drop("id")


def report(d: DataFrame) -> DataFrame:
    """One text per sentence: validation, explained errors and assumptions, or why there is no circuit."""
    lines = F.concat(F.array(F.when(F.size("errors") == 0, "Validation: OK").otherwise("Validation: FAILED")),
                     F.transform("errors", lambda e: F.concat(F.lit("  "), explained(e))),
                     F.when(F.size("notes") > 0, F.concat(F.array(F.lit(""), F.lit("Assumed, not read from your text:")),
                                                          F.transform("notes", lambda n: F.concat(F.lit("  - "), n)))).otherwise(_empty("string")))
    text = (F.when(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0, "Type a circuit description.")
            .when(C("error") == "no components found", "No circuit components were found in that description. Name at least one part.")
            .when(C("error").isNotNull(), C("error")).otherwise(F.array_join(lines, "\n")))
    return d.select("id", text.alias("report"))


def tree_leaves(trees: DataFrame, tree: str = "tree", source: str = "source") -> DataFrame:
    """(id, cls, value) rows of a canonical tree text and its source."""
    found = F.arrays_zip(F.regexp_extract_all(tree, F.lit(LEAF), F.lit(1)).alias("cls"), F.regexp_extract_all(tree, F.lit(LEAF), F.lit(2)).alias("value"))
    src = F.when(C(source).isNotNull(), F.array(F.struct(F.lit("voltage_source").alias("cls"), C(source).alias("value")))).otherwise(_empty("struct<cls:string,value:string>"))
    return trees.select("id", F.explode(F.concat(F.coalesce(found, _empty("struct<cls:string,value:string>")), src)).alias("x")).select("id", "x.cls", "x.value")


def kept_tokens(tokens_: Column) -> Column:
    """Gold tokens without punctuation the tokenizer drops."""
    return F.filter(tokens_, lambda t: t.rlike(TOKEN))


def tag_mismatches(words: Column, gold: Column, pred: Column) -> Column:
    rows = F.arrays_zip(words.alias("w"), gold.alias("g"), pred.alias("p"))
    return F.transform(F.filter(rows, lambda x: x["g"] != x["p"]), lambda x: F.concat(x["w"], F.lit(":"), x["g"], F.lit("->"), x["p"]))
