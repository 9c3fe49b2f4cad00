"""Chat training text in budgeted windows. Prefix sums of turn tokens choose turn-aligned spans; every window keeps the system
turn, repeats a limited history under the mask, and carries loss on the assistant texts that are new in it."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_words, prefix_sums

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Backslash before every backslash and between the two characters that open a control string; see unescape()."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id and turns, an array of (turn, role, text, tokens) in order. A conversation is one
    training document, as a text is. Null texts and roles are empty; ties of the turn number go by role, then text; nulls come first."""
    t = conversations.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    return (t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
            .withColumn("turns", F.transform("t", lambda x: F.struct(x["turn"], x["role"], x["text"], n_words(x["text"]).alias("tokens"))))
            .drop("t"))


def windows(conversations: DataFrame, budget: int = 256, history: int = 64, **columns: str) -> DataFrame:
    """One row for each window: conv_id, window (from 0), n_turns, n_system, n_history, formatted, loss (array of start, end in code
    points of formatted, end exclusive).

    Turns are packed in order while system turn, reserved history and new turns stay within `budget` tokens (words); a turn
    longer than that has a window of its own, whole. A leading system turn opens every window. The history is the longest run of
    turns just before the window with at most `history` tokens in total. Loss lies on the texts of new assistant turns, so each
    assistant text is under it exactly once. Empty tables give no rows; rows that are repeated are turns of their own.
    """
    t = turns(conversations, **columns)
    first = F.try_element_at("turns", F.lit(1))
    t = t.withColumn("n_system", F.when(first["role"] == "system", 1).otherwise(0))
    t = t.withColumn("room", F.greatest(F.lit(1), budget - history - F.when(F.col("n_system") == 1, first["tokens"]).otherwise(0)))
    t = t.withColumn("body", F.slice("turns", F.col("n_system") + 1, F.size("turns")))
    t = t.withColumn("lengths", F.transform("body", lambda x: x["tokens"]))
    t = t.withColumn("sums", prefix_sums(F.col("lengths")))
    ends = F.zip_with("sums", "lengths", lambda s, n: F.struct(s.alias("s"), n.alias("n")))
    # starts of windows: a turn opens one if it would carry the span since the last start beyond the room
    zero = F.struct(F.lit(0).cast("bigint").alias("base"), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("s"))).alias("at"), F.lit(0).alias("i"))
    fold = F.aggregate(ends, zero, lambda a, x: F.when(
        (a["i"] > 0) & (x["s"] + x["n"] - a["base"] > F.col("room")),
        F.struct(x["s"].alias("base"), F.concat(a["at"], F.array(F.struct(a["i"].alias("i"), x["s"].alias("s")))).alias("at"), (a["i"] + 1).alias("i"))).otherwise(
        F.struct(a["base"].alias("base"), a["at"].alias("at"), (a["i"] + 1).alias("i"))), lambda a: a["at"])
    t = t.withColumn("starts", fold)
    # the sums rise, so the turns within the history are a run that ends at the start; its beginning by halving
    def first_from(least: Column, n: Column) -> Column:
        zero = F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi"))
        mid = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        enough = lambda a: F.get("sums", mid(a)) >= least
        return F.aggregate(F.sequence(F.lit(1), F.lit(32)), zero, lambda a, _: F.when(a["lo"] >= a["hi"], a).otherwise(
            F.struct(F.when(enough(a), a["lo"]).otherwise(mid(a) + 1).alias("lo"), F.when(enough(a), mid(a)).otherwise(a["hi"]).alias("hi"))), lambda a: a["lo"])
    # what each window shows is cut out before the windows become rows, so that no row carries the whole conversation
    def piece(x: Column, k: Column) -> Column:
        stop = F.coalesce(F.try_element_at("starts", k + 2)["i"], F.size("body"))
        return F.struct(k.alias("window"), x["i"].alias("i"), stop.alias("stop"), first_from(x["s"] - history, x["i"]).alias("from"))
    t = t.withColumn("pieces", F.transform("starts", piece))
    shown = F.transform("pieces", lambda p: F.struct(p["window"].alias("window"), (p["i"] - p["from"]).alias("n_history"),
                                                     F.concat(F.slice("turns", 1, F.col("n_system")), F.slice("body", p["from"] + 1, p["stop"] - p["from"])).alias("shown")))
    w = t.select("conv_id", "n_system", F.explode(shown).alias("p")).select("conv_id", "n_system", "p.*")
    # role names are percent-encoded: no line break and no control string is left in them
    w = w.withColumn("chunks", F.transform("shown", lambda x: F.struct(
        F.concat(F.lit(START), F.url_encode(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), (x["role"] == "assistant").alias("target"))))
    w = w.withColumn("steps", F.transform("chunks", lambda c: (F.length(c["head"]) + F.length(c["body"]) + len(END) + 1).cast("bigint")))
    w = w.withColumn("offsets", prefix_sums(F.col("steps")))
    n_old = F.col("n_system") + F.col("n_history")
    spans = F.transform("chunks", lambda c, i: F.struct(
        (F.element_at("offsets", i + 1) + F.length(c["head"])).alias("start"),
        (F.element_at("offsets", i + 1) + F.length(c["head"]) + F.length(c["body"])).alias("end"), (c["target"] & (i >= n_old)).alias("on")))
    loss = F.transform(F.filter(spans, lambda s: s["on"]), lambda s: F.struct(s["start"], s["end"]))
    return w.select("conv_id", "window", F.size("shown").alias("n_turns"), "n_system", "n_history",
                    F.array_join(F.transform("chunks", lambda c: F.concat(c["head"], c["body"], F.lit(END + "\n"))), "").alias("formatted"), loss.alias("loss"))


def read_back(w: DataFrame) -> DataFrame:
    """From the output of windows() alone, one row for each conversation: conv_id, turns (role, text), loss_text (all text under the loss, unescaped)
    and formatted_chars. The system turn counts once, history is left out, both by the counts of the window."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    parsed = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        F.url_decode(F.regexp_extract(p, r"^<\|im_start\|>([^\n]*)\n", 1)).alias("role"),
        unescape(F.regexp_replace(p, r"^<\|im_start\|>[^\n]*\n", "")).alias("text")))
    skip = F.when(F.col("window") == 0, 0).otherwise(F.col("n_system") + F.col("n_history"))
    new = F.slice("parsed", skip + 1, F.col("n_turns"))
    under = F.array_join(F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"]))), "")
    rows = (w.withColumn("parsed", parsed)
            .select("conv_id", F.struct("window", new.alias("turns"), under.alias("loss"), F.length("formatted").cast("bigint").alias("chars")).alias("x")))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return rows.select("conv_id", F.flatten(F.transform("x", lambda x: x["turns"])).alias("turns"),
                       F.array_join(F.transform("x", lambda x: x["loss"]), "").alias("loss_text"),
                       F.aggregate("x", F.lit(0).cast("bigint"), lambda s, x: s + x["chars"]).alias("formatted_chars"))
