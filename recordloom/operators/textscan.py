"""Text as rows: sections, code fences, links, references, check boxes, measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of(documents: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """keep, line_no (from 1), line."""
    return documents.where(F.col(text).isNotNull()).select(*keep, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(*keep, (F.col("at") + 1).alias("line_no"), "line")


def sections(lines: DataFrame, key: str) -> DataFrame:
    """lines with in_fence, is_heading and section (running number from 0): headings inside code fences don't count."""
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("line").startswith("```")
    marked = lines.withColumn("fences", F.sum(fence.cast("int")).over(order))
    marked = marked.withColumn("in_fence", (F.col("fences") % 2 == 1) | fence)
    marked = marked.withColumn("is_heading", F.col("line").rlike("^#{1,6} ") & ~F.col("in_fence"))
    return marked.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(order)).drop("fences")


def containing_section(lines_with_sections: DataFrame, key: str) -> DataFrame:
    """Adds ``title``: the last heading at or before each line, null before the first."""
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines_with_sections.withColumn("title", F.last(F.when(F.col("is_heading"), F.regexp_replace("line", "^#+ +", "")), ignorenulls=True).over(order))


def references(text: Column, patterns: tuple[str, ...]) -> Column:
    """All matches of group 1 of the patterns, each once, in the order of the patterns."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))


def words(text: Column) -> Column:
    """Number of words between blanks."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def reading_minutes(text: Column, per_minute: int = 225) -> Column:
    """Minutes to read, rounded up."""
    return F.ceil(words(text) / F.lit(per_minute)).cast("int")


def keyword_hits(text: Column, keywords: tuple[str, ...]) -> Column:
    """How many of the keywords the text holds, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def checkbox(line: Column) -> Column:
    """``done`` or ``open`` for the line of a task list, null for others."""
    mark = F.regexp_extract(line, r"^\s*[-*] \[([ xX])\] ", 1)
    return F.when(F.lower(mark) == "x", "done").when(mark == " ", "open")


def balanced(text: Column) -> Column:
    """Do the brackets of a text open and close in order? Depth is folded over the brackets only."""
    signs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([()\[\]{}])"), F.lit(1))
    closing = F.create_map(F.lit(")"), F.lit("("), F.lit("]"), F.lit("["), F.lit("}"), F.lit("{"))
    step = lambda stack, s: (
        F.when(stack.isNull(), stack).when(s.isin("(", "[", "{"), F.concat(stack, s))
        .when(F.substring(stack, -1, 1) == closing[s], stack.substr(F.lit(1), F.length(stack) - 1))
    )
    return F.coalesce(F.aggregate(signs, F.lit(""), step) == "", F.lit(False))


def file_category(path: Column) -> Column:
    """test, docs, config, code or other, by the first rule that fits."""
    return (
        F.when(path.rlike(r"(_test\.[a-z]+|(^|/)tests?/)"), "test").when(path.rlike(r"\.(md|txt|rst)$|(^|/)docs/"), "docs").when(path.rlike(r"\.(ya?ml|json|toml|ini|cfg|conf)$"), "config")
        .when(path.rlike(r"\.(py|go|rs|c|cc|cpp|h|java|scala|js|ts|sh)$"), "code").otherwise("other")
    )


def safe_path(path: Column) -> Column:
    """No NUL, no backslash, no parent folder (plain or encoded), not absolute, at most 1,024 characters."""
    return F.coalesce((F.length(path) <= 1024) & ~path.rlike(r"[\x00\\]") & ~F.lower(path).rlike(r"(^|/)(\.\.|%2e%2e)(/|$)") & ~path.startswith("/"), F.lit(False))


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob with ``*``, ``**`` and ``?``."""
    import re

    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"
