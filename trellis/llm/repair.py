"""Conversation structure repair: the cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

Faults are flagged by windows over a conversation's turns, the turns are collected as sorted structs, and one
``aggregate()`` folds them. The fold carries four structs (cost, audit), one for what the repaired roles so far end
in: nothing, ``s``, ``u`` or ``a``; each step takes the ``least`` of the few ways into a state. Least by (cost, audit)
of prefixes is least of wholes: the cost follows from the audit, so of two audits with equal cost in one state
neither is the other with more insertions behind it, and one that is less stays less whatever follows.

At most one insertion stands before a turn or at the end: two in a row cost 4 and lead from a state to what that
state allows anyway (only an ``s`` at the end needs both, and to delete it costs 3). An insertion before a deletion
is greater, at equal cost, than one behind it.

Inside the fold insertions are I (user) and J (assistant), new roles R and S, which keeps the order of audits (equal
beginnings give equal states) and tells the texts of the repaired turns turn by turn.

Defined cases: null role, text, conv_id or turn: in the digest one space, role and text one space, no turn comes
first, a null conv_id is a conversation; rows of equal turn: by role and text; a role's initial is its first
character (an empty role has none and is never legal); rows repeated whole are duplicates; a conversation without
rows after the damage: zeros, empty audit; empty table: no rows. Only the four columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS

#: Digests are taken modulo so many; what 0 to 4 do to a row.
DAMAGE_OF = 20
DROP, EMPTY, UNSTOP, REPEAT, USER = range(5)
STOPS = ".!?"
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: More than any repair costs.
NEVER = 1 << 60
LEGAL = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage and ``copy`` (0, 1); rows that the damage drops stay, as ``gone``."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % DAMAGE_OF).alias("_k"))
    text = F.when(F.col("_k") == EMPTY, F.lit("")).when(F.col("_k") == UNSTOP, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == USER, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(0), (F.col("_k") == REPEAT).cast("int")))
    return filled.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_k") == DROP).alias("gone"), copies.alias("copy"))


def flag(damaged: DataFrame) -> DataFrame:
    """Damaged rows with ``fault`` (null or one of FAULTS) and ``illegal``: the roles of this and the row before do not follow."""
    conversation = Window.partitionBy("conv_id", "gone")
    ordered = conversation.orderBy("turn", "role", "text", "copy")
    # partitions of these windows are parts of a conversation, so one exchange by conv_id serves all
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn", "copy")
    bare = F.translate("text", SPACE_CHARS, "")
    told = damaged.repartition("conv_id").select("*", F.row_number().over(same).alias("_nth"), bare.alias("_bare"))
    fault = F.when(F.col("_bare") == "", F.lit("blank")).when(F.col("_nth") > 1, F.lit("duplicate")).when(~F.substring("_bare", -1, 1).isin(*STOPS), F.lit("truncated"))
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(ordered), initial)
    return told.select(
        *damaged.columns,
        fault.alias("fault"),
        F.coalesce(~pair.isin(*LEGAL), F.lit(False)).alias("illegal"),
        F.row_number().over(ordered).alias("place"),
    )


def _state(cost, audit) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit"))


def _step(at: Column, turn: Column) -> Column:
    """The four states after one more turn: every edit of it from every state, behind an insertion or not."""
    cut = F.when(turn.fault == "truncated", CUT_OFF).otherwise(0)
    bound = F.coalesce(turn.fault.isin("blank", "duplicate"), F.lit(False))
    via = lambda state, cost, letters: F.struct((at[state].cost + cost).alias("cost"), F.concat(at[state].audit, letters).alias("audit"))

    def stays(state: str, role: str, new: str) -> tuple[Column, Column]:
        kept = turn.initial == role
        return cut + F.when(kept, 0).otherwise(REROLE), F.when(kept, F.lit("K")).otherwise(F.lit(new))

    (u_cost, u), (a_cost, a) = stays("u", "u", "R"), stays("a", "a", "S")
    free = lambda x: F.when(~bound, x)  # noqa: E731  least() passes over nulls
    deleted = lambda state: via(state, DELETE, F.lit("D"))
    behind = lambda letter, x: F.concat(F.lit(letter), x)
    return F.struct(
        deleted("e").alias("e"),
        F.least(deleted("s"), free(F.when(turn.initial == "s", via("e", cut, F.lit("K"))))).alias("s"),
        F.least(deleted("u"), *[free(via(x, u_cost, u)) for x in "esa"], free(via("u", u_cost + INSERT, behind("J", u)))).alias("u"),
        F.least(deleted("a"), free(via("u", a_cost, a)), *[free(via(x, a_cost + INSERT, behind("I", a))) for x in "esa"]).alias("a"),
    )


def _end(at: Column) -> Column:
    closed = F.struct((at.u.cost + INSERT).alias("cost"), F.concat(at.u.audit, F.lit("J")).alias("audit"))
    return F.least(at.e, at.a, closed)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, counts of faults, illegal, cost, audit, and ``turns``: the repaired turns as array<struct<role, text>>."""
    flagged = flag(damage(rows))
    there = ~F.col("gone")
    counts = [F.count_if(there & (F.col("fault") == x)).alias(x) for x in FAULTS]
    span = F.max(F.when(there, F.col("turn"))) - F.min(F.when(there, F.col("turn"))) + 1
    turn = F.struct("place", F.substring("role", 1, 1).alias("initial"), "fault", "role", "text")
    # places are unique in a conversation, so sorting never compares texts
    grouped = flagged.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).alias("_span"),
        F.size(F.collect_set(F.when(there, F.col("turn")))).alias("_turns"),
        *counts,
        F.count_if(there & F.col("illegal")).alias("illegal"),
        F.sort_array(F.collect_list(F.when(there, turn))).alias("_rows"),
    )
    start = F.struct(_state(0, "").alias("e"), *[_state(NEVER, "").alias(x) for x in "sua"])
    slim = F.transform("_rows", lambda t: F.struct(t.initial.alias("initial"), t.fault.alias("fault")))
    folded = grouped.withColumn("_best", F.aggregate(slim, start, _step, _end))
    # one token a turn: its edit, behind an insertion if there is one; the last may be an insertion alone
    tokens = folded.withColumn("_edits", F.regexp_extract_all(F.col("_best.audit"), F.lit("([IJ]?[DKRS]|[IJ]$)"), 1))
    said = lambda role, text: F.array(F.struct(role.alias("role"), text.alias("text")))
    none = F.array().cast("array<struct<role:string,text:string>>")

    def written(t: Column, edit: Column) -> Column:
        inserted = F.when(edit.startswith("I"), said(F.lit("user"), F.lit(""))).when(edit.startswith("J"), said(F.lit("assistant"), F.lit(""))).otherwise(none)
        role = F.when(edit.endswith("R"), F.lit("user")).when(edit.endswith("S"), F.lit("assistant")).otherwise(t.role)
        return F.concat(inserted, F.when(edit.rlike("[KRS]$"), said(role, t.text)).otherwise(none))

    turns = F.flatten(F.zip_with("_rows", "_edits", written))
    return tokens.select(
        "conv_id",
        (F.col("_span") - F.col("_turns")).cast("long").alias("gaps"),
        *FAULTS,
        "illegal",
        F.col("_best.cost").alias("cost"),
        F.translate("_best.audit", "JS", "IR").alias("audit"),
        turns.alias("turns"),
    )


def written_out(turns: Column) -> Column:
    """``role:text`` lines of repaired turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
