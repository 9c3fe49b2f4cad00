"""Repair of conversation structure as a shortest path: rows stream by conversation in turn order, a table of four states goes from row to
row and from batch to batch, and what it decided travels with each row as one byte.

Two sorts of the same partitions make the two directions. The first stream runs from the last row of a conversation to the first and carries the
cheapest cost to go of each state; its decisions, two bits a state, are a column of the rows, so Spark's own sort spills them together with the
texts of a giant conversation. The second stream runs forward, follows the decisions and hashes the repaired turns as they pass. Python
holds one batch at a time, whatever the length of a conversation; a lost executor costs the partitions it had."""
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: the white space that texts are judged by (space and the controls 9 to 13), and the ends of a sentence
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: prices of the edits; a kept or renamed row that is cut off costs one more
RENAME, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: edits in the order of their letters, which settles ties
DROP, ADD, KEEP, RENAMED = range(4)
LETTERS = "DIKR"
#: states: nothing yet; a system turn; last turn by the user; last turn by the assistant. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> the role that may follow in an inserted or renamed turn, and the state after it
_NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: state -> first letter of a kept role -> state after it
_KEPT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_LEGAL = {"su", "ua", "au"}
_NEVER = 1 << 60
#: cost to go after the last row
_END = (0, 2 * INSERT, INSERT, 0)


def decide(after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int]:
    """One step towards the start: cost to go of each state before this row, given that after it, and the packed decisions (two bits a state)."""
    more = CUT_OFF if fault == TRUNCATED else 0
    best, how = [], []
    for s in (START, SYSTEM, USER, ASSISTANT):
        cost, op = DELETE + after[s], DROP
        if fault not in (BLANK, DUPLICATE):
            kept = _KEPT[s].get(initial)
            if kept is not None and more + after[kept] < cost:
                cost, op = more + after[kept], KEEP
            renamed = RENAME + more + after[_NEXT[s][1]]
            if renamed < cost:
                cost, op = renamed, RENAMED
        best.append(cost)
        how.append(op)
    # inserted turns lead to another state before the same row; two in a row are worth it only from where a pair is still to come
    whole = list(best)
    for s in (USER, ASSISTANT, START, SYSTEM):
        onward = INSERT + (best if s in (USER, ASSISTANT) else whole)[_NEXT[s][1]]
        if onward < whole[s] or (onward == whole[s] and ADD < how[s]):
            whole[s], how[s] = onward, ADD
    return tuple(whole), how[0] | how[1] << 2 | how[2] << 4 | how[3] << 6


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows from last to first, conversations side by side: adds the decisions."""
    conv, cost, first = None, _END, True
    memo: dict = {}
    for b in batches:
        moves = []
        for c, gone, role, fault in zip(b["_c"], b["_gone"], b["_role"], b["_fault"], strict=True):
            if first or c != conv:
                conv, cost, first = c, _END, False
            if gone:
                moves.append(0)
                continue
            # costs enter as differences from the least, of which there are few
            least = min(cost)
            key = (cost[0] - least, cost[1] - least, cost[2] - least, cost[3] - least, role[:1], fault)
            if key not in memo:
                memo[key] = decide(key[:4], key[4], fault)
            new, move = memo[key]
            cost = tuple(least + x for x in new)
            moves.append(move)
        b["_move"] = moves
        yield b


class _Walk:
    """One conversation, first row to last."""

    def __init__(self):
        self.state, self.cost, self.gaps, self.illegal = START, 0, 0, 0
        self.faults, self.audit = [0, 0, 0, 0], []
        self.turn = self.initial = None
        self.hash, self.empty = hashlib.sha256(), True

    def emit(self, role: str, text: str) -> None:
        self.hash.update((("" if self.empty else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.empty = False

    def insert(self) -> None:
        role, self.state = _NEXT[self.state]
        self.audit.append("I")
        self.cost += INSERT
        self.emit(role, "")

    def row(self, turn: str | None, role: str, text: str, fault: int, move: int) -> None:
        if turn is not None:
            t = int(turn)
            if self.turn is not None and t > self.turn:
                self.gaps += t - self.turn - 1
            self.turn = t
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.illegal += 1
        self.initial = initial
        self.faults[fault] += 1
        while (op := move >> 2 * self.state & 3) == ADD:
            self.insert()
        self.audit.append(LETTERS[op])
        if op == DROP:
            self.cost += DELETE
            return
        if op == KEEP:
            self.state = _KEPT[self.state][initial]
        else:
            role, self.state = _NEXT[self.state]
            self.cost += RENAME
        self.cost += CUT_OFF if fault == TRUNCATED else 0
        self.emit(role, text)

    def result(self, conv) -> tuple:
        while self.state in (SYSTEM, USER):
            self.insert()
        return (conv, self.gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


_OUT = ["_c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows from first to last, conversations side by side: one row for each conversation."""
    conv, walk = None, None
    for b in batches:
        out = []
        for c, turn, role, text, fault, gone, move in zip(*[b[x] for x in ("_c", "_turn", "_role", "_text", "_fault", "_gone", "_move")], strict=True):
            if walk is None or c != conv:
                if walk is not None:
                    out.append(walk.result(conv))
                conv, walk = c, _Walk()
            if not gone:
                walk.row(turn, role, text, fault, move)
        if out:
            yield pd.DataFrame(out, columns=_OUT)
    if walk is not None:
        yield pd.DataFrame([walk.result(conv)], columns=_OUT)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """One row for each conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (a whole number, nulls first), then role, then text. The first fault of a row counts: blank, duplicate (role and text
    seen earlier), truncated (the last character that is not white space ends no sentence). Edits: Keep, Rerole to user or assistant, Delete
    (the only one for blank and duplicate rows), Insert an empty turn; the cheapest edits that give `(s?(ua)+)?` by the first letters of the
    roles, of equal ones those whose letters sort first. An empty role has no letter, so such rows are never kept as they are.
    Null roles and texts are read as one space; a null conversation is one of its own; repeated rows are rows (all but the first are duplicates);
    `gone` names a boolean column of rows that only name their conversation: one that has no other rows has zeros, an empty audit and the
    hash of the empty string. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    kind = rows.schema[conv].dataType
    t = rows.select(
        F.col(conv).cast("string").alias("_c"), F.col(turn).cast("bigint").alias("_t"), F.coalesce(F.col(role), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("_text"), (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("_gone"))
    # rows that are gone need neither text nor place
    t = t.withColumns({c: F.when(~F.col("_gone"), F.col(c)).otherwise(F.lit("")) for c in ("_role", "_text")})
    end = F.substring(F.rtrim("_text", F.lit(SPACE)), -1, 1)
    # one exchange: both the search for duplicates and the two streams work on the partitions by conversation
    t = t.repartition("_c")
    seen = F.row_number().over(Window.partitionBy("_c", "_gone", "_role", "_text").orderBy(F.col("_t").asc_nulls_first()))
    fault = F.when(end == "", BLANK).when(seen > 1, DUPLICATE).when(~end.isin(*ENDS), TRUNCATED).otherwise(NONE)
    t = t.withColumn("_seen", seen).select("_c", "_t", F.col("_t").cast("string").alias("_turn"), "_role", "_text", "_gone", "_seen", fault.alias("_fault"))
    up = [F.col("_c").asc_nulls_first(), F.col("_t").asc_nulls_first(), "_role", "_text", "_seen"]
    down = [F.col("_c").desc_nulls_last(), F.col("_t").desc_nulls_last(), F.desc("_role"), F.desc("_text"), F.desc("_seen")]
    columns = "_c string, _turn string, _role string, _text string, _gone boolean, _seen int, _fault int"
    decided = t.sortWithinPartitions(*down).drop("_t").mapInPandas(_backward, columns + ", _move int")
    walked = decided.withColumn("_t", F.col("_turn").cast("bigint")).sortWithinPartitions(*up).drop("_t", "_seen").mapInPandas(
        _forward, "_c string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
    return walked.select(F.col("_c").cast(kind).alias(conv), *_OUT[1:])


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and gone, with faults by the crc32 of `conv:turn` modulo 20: 0 row gone, 1 text empty, 2 ends of sentences removed, 3 row twice, 4 role
    user. Nulls are one space, in the key too; a null conversation or turn stays null as such."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    d = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
                    F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("_k"))
    changed = F.when(F.col("_k") == 1, F.lit("")).when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return d.select("conv", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), (F.col("_k") == 0).alias("gone"),
                    F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")
