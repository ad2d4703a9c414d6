"""Quality rules of content texts as a ledger of failure bits, judged by versioned policies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from listing_lake.llm.common import BLANKS, count_of, let, pack, settled, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _covered(keys: Column) -> Column:
    """Words inside the windows whose key occurs twice or more, given the key of each window in order."""
    def is_repeated(rows: Column):
        def test(row: Column, j: Column) -> Column:
            before, after = F.get(rows, j - 1)["k"], F.get(rows, j + 1)["k"]
            return F.coalesce(before == row["k"], F.lit(False)) | F.coalesce(after == row["k"], F.lit(False))

        return F.filter(rows, test)

    by_key = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    starts = F.array_sort(F.transform(let(by_key, is_repeated), lambda row: row["i"]))
    return let(starts, lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.when(j == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(p, j - 1)))),
        F.lit(0), lambda total, x: total + x))


# Measurements of a text, all counts. Words are runs of anything but ASCII blanks.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_echo_words",
)


def measure(content: DataFrame) -> DataFrame:
    """Adds the `MEASURES` to packed rows (`content_id`, `summary`, `others`); every text is scanned whole and once."""
    value = F.col("summary")
    lines = F.filter(F.split(value, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    keys = F.when(F.size("words") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    measures = {
        "n_words": F.size("words"),
        "word_chars": F.length(value) - count_of(value, BLANKS),
        "n_symbols": count_of(value, SYMBOLS),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.size(F.array_distinct("keys")) == F.size("keys"), 0).otherwise(_covered(F.col("keys"))),
        "n_letters": F.length(F.regexp_replace(value, r"\P{L}+", "")),
        "n_upper": F.length(F.regexp_replace(value, r"\P{Lu}+", "")),
        "n_echo_words": F.size(F.filter("hashes", lambda h, i: F.coalesce(h == F.get(F.col("hashes"), i - 1), F.lit(False)))),
    }
    # Settled one by one: filters on a ledger would otherwise have the optimiser carry all these expressions as constraints.
    return (
        content.withColumn("words", settled(words(value))).withColumn("lines", settled(lines))
        .withColumn("hashes", settled(F.transform("words", lambda w: F.xxhash64(w)))).withColumn("keys", settled(keys))
        .select(*content.columns, *[settled(measures[name].cast("long")).alias(name) for name in MEASURES])
    )


@dataclass(frozen=True)
class Rule:
    """One bit of the ledger: a name and the condition on the measurements under which a text fails."""

    name: str
    fails: str


# Bit i of `failed` belongs to rule i. New rules go to the end, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("upper_case", "2 * n_upper > n_letters"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length", "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
    Rule("echoed_words", "100 * n_echo_words > 20 * n_words"),
    Rule("no_letters", "2 * n_letters < word_chars"),
)

BASE = ("few_words", "repeated_words")
# Each version of a policy names the rules it heeds; a text must pass all of them.
POLICIES = {
    1: BASE,
    2: (*BASE, "symbols", "upper_case", "repeated_lines"),
    3: tuple(rule.name for rule in RULES),
}


def mask_of(names, rules=RULES) -> int:
    """The bits of the named rules."""
    known = {rule.name: 1 << i for i, rule in enumerate(rules)}
    return sum(known[name] for name in set(names))


def rule_ledger(content: DataFrame, rules=RULES) -> DataFrame:
    """Evaluates every rule once on every content row and keeps the outcome as bits.

    Adds the `MEASURES` and `failed` (bit i set: rule i of `rules` failed). A null or empty summary has no words and fails
    `few_words` only; long texts are measured whole; repeated rows are measured each; no rows give no rows.
    """
    packed, others = pack(content, *MEASURES, "failed")
    bits = [F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(packed).select("content_id", "summary", *others, *MEASURES, settled(failed).alias("failed"))


def passes(names, rules=RULES) -> Column:
    """Whether a ledger row passes all the named rules."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(names, rules))) == 0


def apply_policies(ledger: DataFrame, policies=None, rules=RULES) -> DataFrame:
    """Adds one boolean column `kept_v<version>` per policy; the texts are not read again."""
    policies = POLICIES if policies is None else policies
    return ledger.withColumns({f"kept_v{v}": passes(names, rules) for v, names in policies.items()})


def ablations(ledger: DataFrame, policies=None, rules=RULES) -> DataFrame:
    """What each rule of each policy costs: `version`, `rule`, `n_failed`, `n_only` (kept if this rule alone went), `n_kept`.

    Rows are first counted per `failed`, of which there are at most 2^rules, and the bits of those few patterns are then tested. A
    ledger without rows gives zeros.
    """
    policies = POLICIES if policies is None else policies
    spark = ledger.sparkSession
    plan = spark.createDataFrame(
        [(v, name, mask_of(names, rules), mask_of([name], rules)) for v, names in policies.items() for name in names],
        "version int, rule string, policy_mask long, rule_mask long",
    )
    patterns = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    hit = F.col("failed").bitwiseAND(F.col("policy_mask"))
    # One row per rule of a policy against one row per pattern: both sides are bounded by the rules, not by the table.
    return (
        plan.join(patterns, F.col("failed").isNotNull(), "left")
        .groupBy("version", "rule")
        .agg(
            F.coalesce(F.sum(F.when(hit.bitwiseAND(F.col("rule_mask")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(hit == F.col("rule_mask"), F.col("n"))), F.lit(0)).alias("n_only"),
            F.coalesce(F.sum(F.when(hit == 0, F.col("n"))), F.lit(0)).alias("n_kept"),
        )
    )
