"""Chat formatting with prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it are context, only its own text is trained
on. Turns that no assistant turn follows form a last example without a target, so nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The template: marks around a prompt turn and around a reply. Fixed values of the format.
PROMPT = ("[INST] ", " [/INST]")
REPLY = ("<s> ", " </s>")
#: A control string with any number of escapes after its bracket. One more escape is put in, or taken out.
_CONTROL = r"([<\[])(~*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])~(~*)(/?(?:s>|INST\]))"
#: A turn in a formatted text; an escaped text holds no control string.
_TURN = r"(?s)(?:\[INST\] |<s> )(.*?)(?: \[/INST\]| </s>)"


def escape(text: Column) -> Column:
    """Control strings inside a text get a '~' after their bracket; reversible, other text is unchanged."""
    return F.regexp_replace(text, F.lit(_CONTROL), F.lit("$1~$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def _role(role: Column) -> Column:
    """A role is one line: '~' and line ends are escaped."""
    return F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1"))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", reply_role: str = "assistant") -> DataFrame:
    """One row per example: conv_id, alone, example (from 0), n_turns, text, loss_start, loss_chars.

    text is the formatted conversation up to and with the example's last turn; the loss mask is the code
    point range [loss_start, loss_start + loss_chars), the escaped reply alone. The last example of a
    conversation that doesn't end with a reply has its remaining turns and no loss (both null).
    Turns are in the order of `turn` (null first), ties by the formatted turn; a null text is empty and a null
    role is an empty role. A turn with a null conversation id is a conversation of its own, as nothing says
    what it belongs to; `alone` tells such conversations apart and is null for all others. Extra columns are ignored; an empty table gives an empty result. A conversation is
    one string, as every example needs all turns before it; each is held once, and examples are cut from it.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("t"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    body = escape(F.col("text"))
    head = F.concat(escape(_role(F.col("role"))), F.lit("\n"))
    reply = F.coalesce(F.col("role") == reply_role, F.lit(False))
    opens, closes = (F.when(reply, F.lit(a)).otherwise(F.lit(b)) for a, b in zip(REPLY, PROMPT, strict=True))
    # Through a generator, else each use of a turn's text escapes it again.
    one = F.struct(F.concat(opens, head, body, closes).alias("s"), reply.alias("reply"), (F.length(opens) + F.length(head)).alias("skip"), F.length(body).alias("chars"))
    each = rows.select("conv_id", "alone", "t", F.explode(F.array(one)).alias("x")).select("conv_id", "alone", "t", "x.*")
    order = W.partitionBy("conv_id", "alone").orderBy("t", "s")
    # Places are running sums in the conversation's order; the group below has the window's partitioning.
    end = F.sum(F.length("s")).over(order.rowsBetween(W.unboundedPreceding, 0))
    placed = each.withColumns({"n": F.row_number().over(order), "end": end, "last": F.lead(F.lit(1)).over(order).isNull()})
    start = F.when(F.col("reply"), F.col("end") - F.length("s") + F.col("skip"))
    made = F.when(F.col("reply") | F.col("last"), F.struct("n", "end", start.alias("loss_start"), F.when(F.col("reply"), F.col("chars")).alias("loss_chars")))
    whole = placed.groupBy("conv_id", "alone").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "s")))["s"], "").alias("all"), F.array_sort(F.collect_list(made)).alias("made"))
    cut = whole.select("conv_id", "alone", "all", F.posexplode("made").alias("example", "e"))
    return cut.select("conv_id", "alone", "example", F.col("e.n").alias("n_turns"), F.expr("substring(all, 1, int(e.end))").alias("text"), F.col("e.loss_start").cast("int").alias("loss_start"), F.col("e.loss_chars").alias("loss_chars"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from examples alone: turns (role, text), the trained texts in order, formatted_chars."""
    trained = F.when(F.col("loss_start").isNotNull(), F.struct("example", unescape(F.expr("substring(text, loss_start + 1, loss_chars)")).alias("x")))
    per = formatted.groupBy("conv_id", "alone").agg(F.max_by("text", "example").alias("whole"), F.array_sort(F.collect_list(trained)).alias("trained"), F.sum(F.length("text").cast("long")).alias("formatted_chars"))
    parts = F.regexp_extract_all("whole", F.lit(_TURN), F.lit(1))
    cut = F.transform(parts, lambda p: F.struct(_unrole(unescape(F.substring_index(p, "\n", 1))).alias("role"), unescape(F.substring(p, F.instr(p, F.lit("\n")) + 1, F.lit(2**31 - 1))).alias("text")))
    return per.select("conv_id", cut.alias("turns"), F.col("trained.x").alias("trained"), "formatted_chars")
