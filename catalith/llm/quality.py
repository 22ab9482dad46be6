"""Rule bitmask ledger.

``ledger`` measures every document once and evaluates every rule once; the outcome is
one row with the measurements and ``fail_mask``, where bit *b* is set when rule *b*
failed.  A policy is just a mask of the rules that count, so policies are versioned,
re-applied and compared without touching a text again (``apply_policy``), and the
effect of leaving out one rule is a bitwise aggregation over the few distinct masks
(``ablation``).

Everything is built from SQL functions; there is no shuffle except in ``ablation``,
which groups by the mask (at most ``2 ** len(RULES)`` rows leave the map side).

Defined results: a null text counts as the empty text (0 words, fails ``few_words``);
repeated rows are measured row by row; texts are measured whole, however long; input columns whose names clash with an output
column are replaced by it; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.names import sheltered

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\f\r"
SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 8

#: Fixed bit order: (name, failing condition over the measurements). Append only.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)"),
    ("shouting", "2 * n_upper > word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, int] = {
    "base": BIT["few_words"] | BIT["repeated_windows"],
    "v1": sum(BIT.values()),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]


def _repeat_words(words: str, n: str) -> list[dict[str, Column]]:
    """Steps that end in ``n_repeat_words``: words inside 8-word windows found twice or more.

    Windows are 64-bit hashes made by doubling (1, 2, 4, 8 words), so the work is linear;
    only documents that do repeat a window pay for the sort that finds the positions.
    """
    c = F.col
    pair = lambda a, b: F.xxhash64(a, b)

    def shift(h: str, by: int) -> Column:
        size = F.size(c(h)) - by
        return F.when(size > 0, F.zip_with(F.slice(c(h), F.lit(1), size), F.slice(c(h), F.lit(by + 1), size), pair))

    same = lambda x, i: (
        (F.get(c("_sorted"), i - 1)["h"].eqNullSafe(x["h"])) | (F.get(c("_sorted"), i + 1)["h"].eqNullSafe(x["h"]))
    )
    fold = lambda acc, p: F.struct(
        (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"), (p + WINDOW).alias("end")
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return [
        {"_h": F.when(c(n) >= WINDOW, F.transform(c(words), lambda w: F.xxhash64(w)))},
        {"_h": shift("_h", 1)},
        {"_h": shift("_h", 2)},
        {"_h": shift("_h", 4)},
        {
            "_sorted": F.when(
                F.size(F.array_distinct("_h")) < F.size("_h"),
                F.sort_array(F.transform(c("_h"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            )
        },
        {"_at": F.sort_array(F.transform(F.filter(c("_sorted"), same), lambda x: x["i"]))},
        {"n_repeat_words": F.coalesce(F.aggregate(c("_at"), start, fold, lambda a: a["n"]), F.lit(0)).cast("long")},
    ]


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus the measurements and ``fail_mask`` (long).

    Input columns of these names, or with a name that begins with an underscore, may be replaced;
    :func:`keep_documents` keeps all.
    """
    c = F.col
    out = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    # Splitting the trimmed text gives the words at less than half the cost of matching them.
    out = out.withColumn("_trim", F.btrim("_text", F.lit(BLANK)))
    out = out.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", GAP, -1)))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD)))
    size = lambda pattern: F.length(F.regexp_replace("_text", pattern, "")).cast("long")
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": size(SYMBOL),
            "n_upper": size(r"\P{Lu}+"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    for step in _repeat_words("_words", "n_words"):
        out = out.withColumns(step)
    mask = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES), F.lit(0))
    # Not a deterministic expression on purpose: a filter on the mask would otherwise be pushed
    # below the steps above, each of which doubles the expression it is rewritten to.
    once = F.when(F.monotonically_increasing_id() >= 0, mask.cast("long"))
    return out.withColumn("fail_mask", once).drop("_text", "_trim", "_words", "_lines", "_h", "_sorted", "_at")


def passes(policy: str, mask: str = "fail_mask") -> Column:
    """True where no rule of the policy failed."""
    return F.col(mask).bitwiseAND(F.lit(POLICIES[policy])) == 0


def apply_policy(ledger_df: DataFrame, policy: str) -> DataFrame:
    """Add ``kept`` under the named policy version."""
    return ledger_df.withColumn("kept", passes(policy))


def ablation(ledger_df: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and kept without it."""
    active = POLICIES[policy]
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in BIT.items() if b & active))
    masks = ledger_df.groupBy("fail_mask").agg(F.count("*").alias("n"))
    rows = masks.withColumn("r", F.explode(rules)).select("fail_mask", "n", "r.rule", "r.bit")
    hit = F.col("fail_mask").bitwiseAND(F.lit(active))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy("rule").agg(
        count(F.col("fail_mask").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(hit == F.col("bit")).alias("n_only_this"),
        count(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )


def keep_documents(df: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of ``df`` that the policy keeps, with the columns of ``df``."""
    return sheltered(df, lambda d, name: ledger(d, name(text)).where(passes(policy)))
