"""Line dedup by a log-template tree.

A line's tokens (words; one with a digit is the variable `<*>`) lead down a tree of fixed
depth: token count, then the first DEPTH tokens. Below that, the rest is cut into RUNS runs
of tokens. A line's templates are its path with the whole rest, and, where the rest is long
enough, its path with one run left variable; so lines of equal length that differ within one
run, or only in numbers, share a template. A template in MIN_DOCS documents or more recurs:
the document with the smallest id keeps the line, the others lose it.

With `sentences`, the sentences of a line of several, where of LONG tokens or more, go down the same tree
as lines of their own, so a passage repeated inside a longer line is found; the rest of the line stays as it is.

Columns and joins only. Templates are 96-bit hashes, one row for each document and template, counted before
the shuffle; a very common line meets no single task, as plain joins on it can be split.

Defined results: lines of fewer than MIN_TOKENS tokens are left alone (they recur by chance). Null and
empty texts have no lines to lose. Rows with a null id lose nothing and count for nothing; rows with
equal ids are one document. A document that loses all its words is not kept. Other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermarc.cluster import Scratch
from thermarc.llm.text import whole_text, words

DEPTH, RUNS, MIN_TOKENS, MIN_DOCS = 3, 4, 3, 2
#: Tokens from which on one run may vary: two a run at least.
LONG = DEPTH + 2 * RUNS
VARIABLE = "<*>"
#: Between a sentence's end with its spaces and the next sentence; nothing is cut away.
CUT = r"(?<=[.!?][\x20\x09\x0B-\x0D]{1,8})(?![\x20\x09\x0B-\x0D])"


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def pieces(line: Column) -> Column:
    """The sentences of a line, with their separators."""
    return F.split(line, CUT, -1)


def templates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: bool = False, patterns: bool = False) -> DataFrame:
    """(doc_id, line, t, c): the templates of each distinct line; (t, c) is the template, line its text's hash. With patterns, also n and pattern: tokens, and the template as text."""
    whole = F.split(whole_text(text), "\n", -1)
    least = lambda n: lambda x: F.struct(x.alias("_line"), F.lit(n).alias("_least"))
    units = F.transform(F.array_distinct(whole), least(MIN_TOKENS))
    if sentences:
        cut = F.filter(F.transform(whole, pieces), lambda p: F.size(p) > 1)
        units = F.concat(units, F.transform(F.array_distinct(F.flatten(cut)), least(LONG)))
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.inline(units))
    lines = lines.where(F.col("doc_id").isNotNull() & (F.length("_line") >= 2 * F.col("_least") - 1))
    lines = lines.select("doc_id", "_least", line_hash(F.col("_line")).alias("line"), words(F.col("_line")).alias("_words"))
    lines = lines.where(F.size("_words") >= F.col("_least"))
    lines = lines.select(
        "doc_id", "line", F.size("_words").alias("_n"), F.transform("_words", lambda w: F.when(w.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(w)).alias("_t")
    )
    rest = F.col("_n") - DEPTH
    cut = lambda j: F.floor(rest * j / RUNS).cast("int")
    parts = [F.slice("_t", 1, DEPTH), *[F.slice("_t", cut(j) + DEPTH + 1, cut(j + 1) - cut(j)) for j in range(RUNS)]]
    lines = lines.select("doc_id", "line", "_n", *[F.xxhash64(p).alias(f"_x{j}") for j, p in enumerate(parts)], *[F.hash(p).alias(f"_m{j}") for j, p in enumerate(parts)], *([F.array_join(p, " ").alias(f"_p{j}") for j, p in enumerate(parts)] if patterns else []))

    def template(without: int) -> Column:
        kept = [j for j in range(RUNS + 1) if j != without]
        key = lambda h, f: h(F.lit(without), F.col("_n"), *[F.col(f"{f}{j}") for j in kept])
        shown = [F.filter(F.array(*[F.lit("<...>") if j == without else F.col(f"_p{j}") for j in range(RUNS + 1)]), lambda p: F.length(p) > 0)] if patterns else []
        return F.struct(key(F.xxhash64, "_x").alias("t"), key(F.hash, "_m").alias("c"), *[F.array_join(x, " ").alias("pattern") for x in shown])

    loose = F.array(*[template(j) for j in range(1, RUNS + 1)])
    all_of = F.when(F.col("_n") >= LONG, F.concat(F.array(template(-1)), loose)).otherwise(F.array(template(-1)))
    return lines.select("doc_id", "line", *([F.col("_n").alias("n")] if patterns else []), F.inline(all_of))


def recurring(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(t, c, first_doc) of the templates in at least `min_docs` documents; two are told by the least and greatest id alone."""
    more = [] if min_docs <= 2 else [F.count_distinct("doc_id").alias("n_docs")]
    found = rows.groupBy("t", "c").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), *more).where("first_doc < last_doc")
    return (found.where(F.col("n_docs") >= min_docs) if more else found).select("t", "c", "first_doc")


def recurring_templates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, sentences: bool = False) -> DataFrame:
    """(pattern, n_tokens, n_docs, first_doc) of the templates that recur, as text: `<*>` for a variable token, `<...>` for a variable run."""
    rows = templates(docs, doc_id, text, sentences, patterns=True)
    found = rows.groupBy("t", "c").agg(F.min("pattern").alias("pattern"), F.min("n").alias("n_tokens"), F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return found.where(F.col("n_docs") >= max(2, min_docs)).select("pattern", "n_tokens", "n_docs", "first_doc")


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, sentences: bool = False) -> DataFrame:
    """(doc_id, lines): hashes of the lines (and sentences) that each document loses. Stored."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.put("templates", templates(docs, doc_id, text, sentences))
    often = scratch.put("recurring", recurring(rows, min_docs))
    lost = rows.join(often.hint("merge"), ["t", "c"]).where("first_doc < doc_id")
    lost = scratch.put("lost", lost.groupBy("doc_id").agg(F.collect_set("line").alias("lines")))
    scratch.drop("templates", "recurring")
    return lost


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, sentences: bool = False) -> DataFrame:
    """All rows with their text without the dropped lines, and n_lines, n_dropped, kept. A line that loses all its sentences is a dropped one."""
    lost = dropped_lines(docs, doc_id, text, min_docs, sentences).select(F.col("doc_id").alias("_id"), F.col("lines").alias("_lost"))
    df = docs.join(lost, docs[doc_id] == F.col("_id"), "left").withColumn("_lines", F.split(whole_text(text), "\n", -1))
    stays = lambda x: ~F.array_contains("_lost", line_hash(x))
    stay = F.filter("_lines", stays)
    if sentences:
        rest = lambda x: F.array_join(F.filter(pieces(x), stays), "")
        stay = F.filter(F.transform(stay, lambda x: F.when(F.length(x) > 0, F.nullif(rest(x), F.lit(""))).otherwise(x)), lambda x: x.isNotNull())
    df = df.withColumn("_stay", F.when(F.col("_lost").isNull(), F.col("_lines")).otherwise(stay))
    short = F.array_join("_stay", "\n")
    out = {
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": (F.size("_lines") - F.size("_stay")).cast("long"),
        "kept": (F.size("_stay") == F.size("_lines")) | (F.length(F.regexp_replace(short, r"[\x20\x09-\x0D]+", "")) > 0),
        text: F.when(F.col(text).isNotNull(), short),
    }
    return df.select(*[c for c in docs.columns if c not in out], *[v.alias(k) for k, v in out.items()])
