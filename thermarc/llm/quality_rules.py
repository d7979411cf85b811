"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements and
one bit per failed rule; a policy is a named, versioned set of bits, so another
policy, or the effect of leaving a rule out, needs no second look at the texts.

Defined results: a null or empty text has no words, fails `few_words` and is not
kept. Ties and repeated rows are independent of each other (the plan has no
exchange). Existing columns with a measurement's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermarc.llm.text import SPACES, whole_text, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Rule name -> the failing condition over the measurements. A rule's bit is its place in this list.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("short_or_long_words", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
    ("shouting", "100 * n_upper > 50 * word_chars"),
]
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}


def mask(*rules: str) -> int:
    return sum(BITS[r] for r in rules)


#: Versioned policies: the bits that reject a document.
POLICIES: dict[str, int] = {
    "base": mask("few_words", "repeated_windows"),
    "v1": mask("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": mask(*BITS),
}
DEFAULT_POLICY = "v2"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def _window_keys(hashes: Column, n: Column) -> Column:
    return F.when(
        n > WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])),
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements. A window repeats if its eight words stand elsewhere in the same text too.

    Hashes of windows only decide whether a text has any repeat (equal windows have
    equal hashes); the repeats themselves are found by comparing the words.
    """
    t = whole_text(text)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    kept = [c for c in docs.columns if c not in MEASURES]
    df = docs.select(
        *kept,
        words(t).alias("_words"),
        lines.alias("_lines"),
        F.length(F.regexp_replace(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    )
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_lines")
    df = df.withColumn("_keys", _window_keys(F.col("_hashes"), F.size("_words"))).drop("_hashes")
    df = df.withColumn("_again", F.coalesce(F.size(F.array_distinct("_keys")) < F.size("_keys"), F.lit(False))).drop("_keys")
    # Only texts with a repeat: windows in order of their words; equal neighbours are the repeats.
    ordered = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.size("_words") - WINDOW),
            lambda i: F.struct(F.array_join(F.slice("_words", i + 1, WINDOW), " ").alias("k"), i.alias("i")),
        )
    )
    df = df.withColumn("_ordered", F.when(F.col("_again"), ordered)).drop("_words", "_again")
    o = F.col("_ordered")
    starts = F.array_sort(
        F.array_compact(
            F.transform(o, lambda x, j: F.when((F.get(o, j - 1)["k"] == x["k"]) | (F.get(o, j + 1)["k"] == x["k"]), x["i"]))
        )
    )
    df = df.withColumn("_starts", starts).drop("_ordered")
    s = F.col("_starts")
    covered = F.aggregate(
        F.transform(s, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_starts")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and `failure_bits` of every document."""
    bits = [F.when(F.expr(failing), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, failing) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, text).withColumn("failure_bits", total.cast("long"))


def kept(policy: str = DEFAULT_POLICY) -> Column:
    """Over a ledger: True where no rule of the policy failed."""
    return F.col("failure_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(led: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """A row for each rule of the policy: documents that fail it, and those that only it rejects.

    One aggregation with a few counters a task, whatever the number of documents.
    """
    m = POLICIES[policy]
    rules = [(n, b) for n, b in BITS.items() if b & m]
    got = F.col("failure_bits").bitwiseAND(F.lit(m))
    one = led.agg(
        *[F.count_if(got.bitwiseAND(F.lit(b)) != 0).alias(f"fail_{n}") for n, b in rules],
        *[F.count_if(got == b).alias(f"only_{n}") for n, b in rules],
        F.count_if(got != 0).alias("rejected"),
    )
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"fail_{n}").alias("n_failed"), F.col(f"only_{n}").alias("n_only")) for n, _ in rules])
    return one.select(F.lit(policy).alias("policy"), F.inline(rows), F.col("rejected").alias("n_rejected"))


def filter_documents(docs: DataFrame, policy: str = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns."""
    led = ledger(docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text")), "_text")
    # The row number keeps the condition above the measurements; pushed down, it would repeat them many times over.
    led = led.withColumn("_row", F.monotonically_increasing_id())
    return led.where(kept(policy) & (F.col("_row") >= 0)).select("_doc.*")
