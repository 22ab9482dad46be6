r"""Chat formatting in budgeted windows, as SQL expressions.

A conversation is cut into windows of at most ``budget`` tokens along turn borders:

* prefix sums of turn tokens give every turn a start; spans are then filled turn by turn
  until the next turn would not fit beside the system turn and the history allowance;
* a leading system turn opens every window;
* up to ``history`` tokens of whole turns before the window are repeated as context;
* only assistant turns that are the window's own carry loss: repeated targets are masked,
  so over all windows each assistant text is a target exactly once.

A turn longer than the budget gets a window of its own, without history, and changes no
other window; no text is cut.

Template: ``<|role|>\ntext<|end|>\n``.  In roles and texts ``&``, ``<`` and ``>`` are written
``&amp;``, ``&lt;`` and ``&gt;``, so no text can hold a mark and reading back is exact.

Nothing but ``digests`` needs a whole conversation in one place: prefix sums come from
sorted ranges (``running_sums``), spans are filled inside stretches of ``STRETCH`` budgets of
the prefix sum, which bounds a row, and history crosses into a stretch from the end of the
one before.  The system turn is joined once a stretch, and only to the stretches of a long
conversation after its first.

Defined results: null texts and roles are empty; turns of equal number are ordered by role
and text; repeated rows are turns of their own; a null conversation id is a conversation; a
very long text is one turn like any other; other columns of the table, whatever their names,
are not read; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.operators.ranking import running_sums
from catalith.plans.storage import write_table

END = "<|end|>\n"
#: A token of the estimate: a run of ASCII word characters or any other visible character.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]"
#: Tokens that a turn's marks take.
MARKS = 3
#: Budgets of the prefix sum that are cut into windows together.
STRETCH = 16


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def token_estimate(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def _stretches(df: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns (i, start, tokens, is_system, role, text) by stretch, with the end of the stretch before and the system turn."""
    plain = df.withColumn("tokens", token_estimate(F.col("text")) + MARKS)
    order = [F.asc("_turn"), F.asc("role"), F.asc("text")]
    turns = running_sums(plain, ["_conv"], order, {"i": F.lit(1).cast("long"), "start": F.col("tokens")}).withColumn("i", F.col("i") + 1)
    row = F.struct("i", "start", "tokens", ((F.col("i") == 1) & (F.col("role") == "system")).alias("is_system"), "role", "text")
    width = STRETCH * budget
    stretch = F.floor(F.col("start") / width)
    own = write_table(turns.groupBy("_conv", stretch.alias("_s")).agg(F.sort_array(F.collect_list(row)).alias("_turns")), "chat-turns")

    # a conversation's first stretch holds its system turn and has nothing before it; only later ones, of long conversations, are joined
    opening = F.when(F.col("_turns")[0]["is_system"], F.col("_turns")[0])
    first = own.where("_s = 0").select("_conv", "_turns", F.slice("_turns", 1, 0).alias("_tail"), opening.alias("_system"))
    last = F.element_at("_turns", -1)
    ends = own.select("_conv", "_s", "_turns", (last["start"] + last["tokens"]).alias("_end"))
    tail = F.filter("_turns", lambda t: t["start"] >= F.col("_end") - history)
    tails = ends.select(F.col("_conv").alias("_tc"), F.floor(F.col("_end") / width).alias("_ts"), tail.alias("_tail"), "_s").where("_ts > _s").drop("_s")
    systems = own.where("_s = 0").where(F.col("_turns")[0]["is_system"]).select(F.col("_conv").alias("_sc"), F.col("_turns")[0].alias("_system"))
    later = own.where("_s > 0").join(tails, F.col("_conv").eqNullSafe(F.col("_tc")) & (F.col("_s") == F.col("_ts")), "left").join(systems, F.col("_conv").eqNullSafe(F.col("_sc")), "left")
    return first.unionByName(later.select("_conv", "_turns", F.coalesce("_tail", F.slice("_turns", 1, 0)).alias("_tail"), "_system"))


def _cuts(turns: Column, system_tokens: Column, budget: int, history: int) -> Column:
    """Where windows begin (positions from 0): a turn that does not fit the open window opens the next."""
    room = lambda first: F.greatest(F.lit(1).cast("long"), budget - system_tokens - F.when(first, F.lit(0)).otherwise(F.lit(history)))
    begin = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array(F.lit(0)).alias("cuts"))

    def add(a: Column, t: Column) -> Column:
        # the conversation's first window has no history to leave room for
        full = (a["used"] > 0) & (a["used"] + t["tokens"] > room((F.size(a["cuts"]) == 1) & (t["i"] == a["at"] + 1)))
        return F.when(t["is_system"], F.struct(a["used"].alias("used"), (a["at"] + 1).alias("at"), a["cuts"].alias("cuts"))).otherwise(
            F.struct(
                (F.when(full, F.lit(0).cast("long")).otherwise(a["used"]) + t["tokens"]).alias("used"),
                (a["at"] + 1).alias("at"),
                F.when(full, F.concat(a["cuts"], F.array(a["at"]))).otherwise(a["cuts"]).alias("cuts"),
            )
        )

    return F.aggregate(turns, begin, add, lambda a: a["cuts"])


def format_windows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 1024, history: int = 192) -> DataFrame:
    """One row per window: ``conv``, first_turn, n_context, n_tokens, formatted, loss_spans.

    ``n_context`` is how many of the window's turns are context (system and history) that
    came in an earlier window; ``loss_spans`` are (start, length) in code points.
    """
    plain = df.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = _stretches(plain, budget, history).withColumn("_system_tokens", F.coalesce(F.col("_system.tokens"), F.lit(0).cast("long")))
    rows = rows.withColumn("_cuts", _cuts(F.col("_turns"), F.col("_system_tokens"), budget, history))

    def window(at: Column, k: Column) -> Column:
        return F.struct(F.slice("_turns", at + 1, F.coalesce(F.get("_cuts", k + 1), F.size("_turns")) - at).alias("own"), at.alias("at"))

    def with_context(w: Column) -> Column:
        first, last = w["own"][0], F.element_at(w["own"], -1)
        tokens = last["start"] + last["tokens"] - first["start"] - F.when(first["is_system"], F.col("_system_tokens")).otherwise(0)
        allowance = F.least(F.lit(history).cast("long"), F.greatest(F.lit(0).cast("long"), budget - F.col("_system_tokens") - tokens))
        reach = lambda t: ~t["is_system"] & (t["start"] >= first["start"] - allowance)
        kept = F.concat(F.filter("_tail", reach), F.filter(F.slice("_turns", F.lit(1), w["at"]), reach))
        return F.struct(w["own"].alias("own"), tokens.alias("tokens"), kept.alias("kept"))

    windows = rows.withColumn("_w", F.explode(F.transform(F.transform("_cuts", window), with_context))).select("_conv", "_system", "_system_tokens", "_w.*")
    first = F.col("own")[0]
    lead = F.when(F.col("_system").isNotNull() & ~first["is_system"], F.array("_system")).otherwise(F.slice("own", 1, 0))
    windows = windows.withColumn("_context", F.concat(lead, "kept")).withColumn("n_context", F.size("_context"))
    show = lambda t, own: F.struct(
        F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n")).alias("head"), escape(t["text"]).alias("body"), (own & (t["role"] == "assistant")).alias("loss")
    )
    windows = windows.withColumn("_all", F.concat(F.transform("_context", lambda t: show(t, F.lit(False))), F.transform("own", lambda t: show(t, F.lit(True)))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    fold = lambda a, t: F.struct(
        (a["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
        F.when(t["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
    )
    repeated = F.when(F.size("kept") > 0, first["start"] - F.col("kept")[0]["start"]).otherwise(0)
    return windows.select(
        F.col("_conv").alias(conv),
        first["i"].alias("first_turn"),
        "n_context",
        (F.col("tokens") + F.col("_system_tokens") + repeated).alias("n_tokens"),
        F.array_join(F.transform("_all", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("_all", begin, fold, lambda a: a["spans"]).alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Adds ``turns`` (role and text of the window's own turns) and ``loss_text`` read from ``formatted`` alone."""
    pieces = F.split("formatted", F.lit(r"<\|end\|>\n"), F.lit(-1))
    marked = F.slice(pieces, F.col("n_context") + 1, F.size(pieces) - 1 - F.col("n_context"))
    one = lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, "|>\n", 1), F.lit(3), F.length(p))).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, "|>\n", 1)) + 4, F.length(p))).alias("text"),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.withColumns({"turns": F.transform(marked, one), "loss_text": F.array_join(loss, "")})


def digests(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation: what reading its windows back gives, as counts and digests."""
    read = read_windows(windows).select(conv, F.struct("first_turn", "turns", "loss_text").alias("_w"), F.length("formatted").cast("long").alias("_chars"))
    each = read.groupBy(conv).agg(F.sort_array(F.collect_list("_w")).alias("_w"), F.sum("_chars").alias("formatted_chars"))
    turns = F.flatten(F.transform("_w", lambda w: w["turns"]))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("_w", lambda w: w["loss_text"]), "")
    each = each.withColumns({"_n": F.size(turns).cast("long"), "_said": said, "_loss": loss})
    return each.select(
        conv,
        F.col("_n").alias("n_turns"),
        F.sha2(F.encode("_said", "UTF-8"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("_loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
