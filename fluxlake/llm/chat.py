"""Chat formatting in budgeted windows.

A turn is printed as ``<turn ROLE>TEXT</turn>`` and a line feed; ``\\``, ``<`` and ``>`` in roles and
texts become ``\\0``, ``\\1`` and ``\\2``, so no text can hold a mark, and reading back is exact. A turn
costs a quarter of its printed code points, rounded up.

Prefix sums of the costs place the turns: with room = budget - system turn, the new turns of a window
are those that end within one stride of ``room - history`` tokens, so they never exceed the room: a
turn that begins more than ``history`` tokens before its stride gets a window of its own. What a
window leaves free, up to ``history``, repeats the turns before it; the conversation's first turn, if
its role is ``system``, leads every window. The loss mask covers the text of new assistant turns
only: every target once, repeated ones masked out. Only a turn larger than the room exceeds
the budget; it is kept whole and flagged.

The sums are taken in ranges of all turns in order, with one carried row per conversation and range, windows meet their
turns in an equi-join on (conversation, stride), and no step orders or gathers a whole conversation,
however long. Built-in expressions only.

Cases: null text, role and turn are empty, empty and last; equal turn numbers are ordered by role and
text, repeated rows stay; a null conv_id is a conversation of its own; a conversation of a system
turn only has one window. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxlake.operators.ordered import range_slices
from fluxlake.session import materialize

BUDGET = 2048
HISTORY = 512
CLOSE = "</turn>\n"
LAST_TURN = 2**63 - 1
SYSTEM, TARGET = "system", "assistant"


def escaped(col: str | Column) -> Column:
    out = F.col(col) if isinstance(col, str) else col
    for char, code in (("\\", "\\0"), ("<", "\\1"), (">", "\\2")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def unescaped(col: str | Column) -> Column:
    out = F.col(col) if isinstance(col, str) else col
    for char, code in ((">", "\\2"), ("<", "\\1"), ("\\", "\\0")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def _printed(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        "conv_id", F.col("conv_id").isNull().alias("no_id"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.coalesce("turn", F.lit(LAST_TURN)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit("<turn "), escaped("role"), F.lit(">")))
    rows = rows.withColumn("body", escaped("text"))
    return rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE))).select(
        "conv_id", "no_id", "conv", "turn", "role", "text", "piece",
        F.length("head").alias("head_chars"), F.length("body").alias("body_chars"),
        F.ceil(F.length("piece") / 4).cast("long").alias("cost"))


def placed_turns(conversations: DataFrame, budget: int, history: int) -> DataFrame:
    """Every turn with its number, its start in the prefix sum, and the window that it is new in."""
    key = ["no_id", "conv", "slice"]
    order = ["turn", "role", "text"]
    turns = range_slices(_printed(conversations), ["no_id", "conv", *order]).withColumnRenamed("_slice", "slice")
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = turns.withColumns({
        "inside_cost": F.coalesce(F.sum("cost").over(inside), F.lit(0)),
        "inside_n": F.count("*").over(inside)})
    slices = turns.groupBy(*key).agg(
        F.sum("cost").alias("slice_cost"), F.count("*").alias("slice_n"),
        F.min(F.struct(*order, "piece", "cost")).alias("first"))
    before = Window.partitionBy("no_id", "conv").orderBy("slice")
    carried = slices.select(
        *key,
        F.coalesce(F.sum("slice_cost").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cost_before"),
        F.coalesce(F.sum("slice_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n_before"),
        F.first("first").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("opening"),
    ).select(*key, "cost_before", "n_before",
             F.when(F.col("opening.role") == SYSTEM, F.col("opening.piece")).alias("system_piece"),
             F.when(F.col("opening.role") == SYSTEM, F.col("opening.cost")).otherwise(0).alias("system_cost"))
    room = F.greatest(F.lit(budget) - F.col("system_cost"), F.lit(2))
    out = counted.join(carried, key).withColumns({
        "number": F.col("n_before") + F.col("inside_n"),
        "room": room, "recall": F.least(F.lit(history), F.expr("greatest({0} - system_cost, 2) div 2".format(budget)))})
    leads = (F.col("number") == 0) & F.col("system_piece").isNotNull()
    out = out.withColumns({"leads": leads, "stride": F.col("room") - F.col("recall")}).withColumns({
        "start": F.when(leads, F.lit(0)).otherwise(F.col("cost_before") + F.col("inside_cost") - F.col("system_cost")),
        "own_cost": F.when(leads, F.lit(0)).otherwise(F.col("cost"))})
    at = F.expr("greatest(start + own_cost - 1, 0) div stride")
    alone = F.expr("(greatest(start + own_cost - 1, 0) div stride) * stride - start > recall")
    return out.select(
        "conv_id", "no_id", "conv", "number", "role", "piece", "head_chars", "body_chars", "leads", "start",
        (F.col("start") + F.col("own_cost")).alias("end"), "room", "recall", "stride", "system_piece", "system_cost",
        (2 * at + F.when(alone, 0).otherwise(1)).alias("window"))


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss_spans, n_context, n_new, n_tokens, over_budget.

    ``loss_spans`` are (start, length) in code points of ``formatted``; ``n_context`` leading turns
    repeat what earlier windows showed.
    """
    turns = materialize(placed_turns(conversations, budget, history), "turns")
    key = ["no_id", "conv"]
    spans = turns.groupBy(*key, "window").agg(
        F.min("start").alias("from"), F.max("start").alias("last"), F.max("end").alias("to"),
        F.max("room").alias("w_room"), F.max("recall").alias("w_recall"), F.max("stride").alias("w_stride"),
        F.max("leads").alias("w_leads"))
    spans = spans.withColumn("back", F.greatest(
        F.least(F.col("w_recall"), F.col("w_room") - (F.col("to") - F.col("from"))), F.lit(0)))
    wanted = spans.select(
        *key, F.col("window").alias("w"), "from", "to", "back", "w_room", "w_leads",
        F.explode(F.expr("sequence(greatest(`from` - back, 0) div w_stride, `last` div w_stride)")).alias("cell"))
    dealt = turns.withColumn("cell", F.expr("start div stride"))
    is_new = F.col("window") == F.col("w")
    recalled = ~F.col("leads") & (F.col("start") < F.col("from")) & (F.col("start") >= F.col("from") - F.col("back"))
    met = dealt.join(wanted, [*key, "cell"]).filter(is_new | recalled)
    part = F.struct(
        "number", "piece", "head_chars", "body_chars", is_new.alias("new"),
        (is_new & (F.col("role") == TARGET)).alias("target"))
    opens = F.when(is_new & ~F.col("w_leads"), F.struct("number", "system_piece", "system_cost"))
    grouped = met.groupBy(*key, "w").agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(part)).alias("parts"),
        F.min(opens).alias("opening"), F.sum((~is_new).cast("int")).alias("n_recalled"),
        F.min(F.when(~is_new, F.col("start"))).alias("recalled_from"),
        F.max("from").alias("from"), F.max("to").alias("to"), F.max("w_room").alias("room"))
    system = F.coalesce(F.col("opening.system_piece"), F.lit(""))
    walked = F.expr("""
        aggregate(parts, named_struct('at', length(coalesce(opening.system_piece, '')), 'spans',
                  cast(array() AS array<struct<start:int,length:int>>)),
            (acc, p) -> named_struct('at', acc.at + p.head_chars + p.body_chars + {close},
                'spans', if(p.target, array_append(acc.spans, named_struct('start', acc.at + p.head_chars, 'length', p.body_chars)), acc.spans)),
            acc -> acc.spans)""".format(close=len(CLOSE)))
    has_system = F.col("opening.system_piece").isNotNull()
    used = F.col("to") - F.coalesce("recalled_from", "from")
    return grouped.select(
        "conv_id", F.col("w").alias("window"),
        F.concat(system, F.array_join(F.transform("parts", lambda p: p["piece"]), "")).alias("formatted"),
        walked.alias("loss_spans"),
        (F.col("n_recalled") + has_system.cast("int")).cast("long").alias("n_context"),
        (F.size("parts") - F.col("n_recalled")).cast("long").alias("n_new"),
        used.alias("n_tokens"), (used > F.col("room")).alias("over_budget"))


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and loss text of every conversation, from the printed windows alone.

    A digest of a whole conversation is one value over all its text, so each conversation's text
    meets in one row here; the windows themselves have no such step.
    """
    pieces = F.expr("slice(split(formatted, '</turn>\\n'), cast(n_context AS int) + 1, cast(n_new AS int))")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ">", 1)
        return F.concat(unescaped(F.substring(head, 7, 2**31 - 1)), F.lit("\n"),
                        unescaped(F.substring(piece, F.length(head) + 2, F.length(piece))), F.lit("\n"))

    per_window = windows.select(
        "conv_id", "window", F.length("formatted").cast("long").alias("chars"), F.size(pieces).alias("n"),
        F.array_join(F.transform(pieces, turn), "").alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescaped(
            F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "").alias("loss"))
    whole = per_window.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("all"))
    turns = F.array_join(F.col("all.turns"), "")
    loss = F.array_join(F.col("all.loss"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars")
