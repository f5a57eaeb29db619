"""Quality rules that look at lines first: failing lines go, and a document that loses too much of its text goes with them.

One pass of expressions over each row, without shuffle and without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloyscreen.llm.native import SPACE, let, lines, total, words

#: Rules of the line stage (fixed values). Phrases and menus are looked for in short lines only: long prose may speak of them.
SHORT_LINE = 200
BOILERPLATE = (
    r"(?i)all rights reserved|cookie policy|use cookies|privacy policy|terms of (use|service)|enable javascript|lorem ipsum"
    r"|licensed under|released under the|subscribe to our|copyright (©|\(c\))"
)
NAVIGATION = (
    r"(?i)^[\s|>»·/-]*(home|log ?in|sign (in|up)|menu|next|previous|back|share|print|contact( us)?|about( us)?|read more|click here)"
    r"([\s|>»·/-]+(home|log ?in|sign (in|up)|menu|next|previous|back|share|print|contact( us)?|about( us)?|read more|click here))*[\s|>»·/.-]*$"
)
MENU_MARK = r" [|»>·] "
SENTENCE_MARK = r"[.!?…:;。！？]"
UNMARKED_WORDS = 8
SHOUT, SHOUTS = r"[!?]{2,}", 3


def repeated_words(found: Column, width: int = 5) -> Column:
    """How many words of the array lie in windows of ``width`` words that occur twice or more."""

    def covered(starts: Column) -> Column:
        return total(F.transform(starts, lambda p, j: F.least(F.lit(width), F.get(starts, j + 1) - p).cast("long")))

    def again(ordered: Column) -> Column:
        twin = lambda s, j: F.coalesce(s["h"] == F.get(ordered, j)["h"], F.lit(False))
        starts = F.array_sort(F.transform(F.filter(ordered, lambda s, j: twin(s, j - 1) | twin(s, j + 1)), lambda s: s["i"]))
        return let(starts, covered)

    def counted(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, again))

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    return let(found, lambda w: F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(let(windows(w), counted)))


def line_fails(line: Column) -> Column:
    """Whether a line with words fails a rule: boilerplate, navigation, or punctuation (much text without a mark, or shouting)."""
    short = F.char_length(line) <= SHORT_LINE
    unmarked = ~line.rlike(SENTENCE_MARK) & (F.size(words(line)) >= UNMARKED_WORDS)
    return (
        (short & (line.rlike(BOILERPLATE) | line.rlike(NAVIGATION) | (F.regexp_count(line, F.lit(MENU_MARK)) >= 3)))
        | unmarked | (F.regexp_count(line, F.lit(SHOUT)) >= SHOUTS)
    )


def line_first(docs: DataFrame, least_left: int = 50, text_column: str = "text") -> DataFrame:
    """``doc`` (the whole input row as a struct, so that no name can clash), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines (lines with a word), n_failed_lines, kept and cleaned (the text without its failing lines).

    A document is kept unless it fails the base rules (fewer than 10 words, or more than 20 % of its words in repeated windows)
    or its lines that pass hold less than ``least_left`` percent of the characters of its lines with words. A null text counts
    as empty: no words, not kept, cleaned null. Repeated rows and null ids are rows like any other."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    worded = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    each = F.transform(lines(text), lambda x: F.struct(x.alias("line"), worded(x).alias("worded"), F.when(worded(x), line_fails(x)).otherwise(F.lit(False)).alias("fails")))
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), words(text).alias("words"), each.alias("lines"),
        (F.char_length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    own = F.filter("lines", lambda x: x["worded"])
    length = lambda xs: total(F.transform(xs, lambda x: F.char_length(x["line"]).cast("long")))
    repeats = lambda xs: F.size(xs) - F.size(F.array_distinct(F.transform(xs, lambda x: x["line"])))
    found = base.select(
        "doc", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", let(own, repeats).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), F.size(own).cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x["fails"])).cast("long").alias("n_failed_lines"), length(own).alias("chars"),
        length(F.filter("lines", lambda x: x["worded"] & ~x["fails"])).alias("chars_left"),
        F.array_join(F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & (100 * F.col("chars_left") >= least_left * F.col("chars"))
    return found.select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_lines", "n_failed_lines",
        kept.alias("kept"), F.when(F.col(f"doc.`{text_column}`").isNotNull(), F.col("cleaned")).alias("cleaned"),
    )
