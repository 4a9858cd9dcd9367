"""Line-first quality rules in native expressions (operator 6).

Each line is judged by itself; failing lines go, and a document that loses more
than max_loss of its word characters is rejected. A line with words fails if

* punctuation: it has under short_line words and no closing punctuation of any
  of the known scripts, or over heavy_punctuation marks a word and five words at least;
* navigation: two separators or more, with four words for each at most;
* boilerplate: it holds one of the phrases as words of their own, and under
  LONG_LINE words.

In scripts without spaces two characters count as a word of a line.

Narrow: one pass, no shuffle, no Python. Windows of eight words are compared by
64-bit digests of their words within one document.

Null text counts as empty: no words, so the base rule fails. Repeated rows are
judged each on its own. Other columns are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.native import BLANK_CHARS, let, without, words

# Characters and phrases of the rules.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»›•·"
MARKS = ".,;:!?#*$%&|<>{}[]()=~^_+\\/-"
CLOSING = r"""[.!?…:;"'”’»)\]。！？．：；」』】》〉）।॥؟؛۔።။។]\s*$"""
#: of scripts without spaces between words, where two characters count as a word
UNSPACED = r"[^\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
LONG_LINE = 24  # words; a phrase doesn't condemn a line that says so much else
BOILERPLATE = [
    "all rights reserved", "click here", "cookie policy", "cookies", "copyright", "enable javascript", "javascript", "log in",
    "lorem ipsum", "privacy policy", "read more", "share this", "sign in", "sign up", "skip to content", "subscribe", "terms of service", "terms of use",
]
PHRASES = f"(^|[^a-z0-9])({'|'.join(BOILERPLATE)})([^a-z0-9]|$)"
WINDOW = 8


def repeated_words(found: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of size words that occur twice or more. found: the words of a text."""

    def of_hashes(h: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
        return let(keys, of_keys)

    def of_keys(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), of_sorted))

    def of_sorted(pairs: Column) -> Column:
        def again(p: Column, j: Column) -> Column:
            return (F.coalesce(F.get(pairs, j - 1)["k"] == p["k"], F.lit(False))) | (F.coalesce(F.get(pairs, j + 1)["k"] == p["k"], F.lit(False)))

        return let(F.array_sort(F.transform(F.filter(pairs, again), lambda p: p["i"])), of_starts)

    def of_starts(starts: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
        return F.aggregate(starts, start, lambda a, s: F.struct((a["n"] + F.least(F.lit(size), s - a["last"])).alias("n"), s.alias("last")), lambda a: a["n"])

    return F.when(F.size(found) < size, F.lit(0)).otherwise(let(F.transform(found, lambda w: F.xxhash64(w)), of_hashes))


def line_fails(line: Column, short_line: int, heavy_punctuation: float) -> Column:
    marks = F.length(line) - F.length(without(line, MARKS))
    separators = F.length(line) - F.length(without(line, SEPARATORS))

    def judge(n: Column) -> Column:
        punctuation = ((n < short_line) & ~line.rlike(CLOSING)) | ((n >= 5) & (marks > heavy_punctuation * n))
        navigation = (separators >= 2) & (n - separators <= 4 * separators)
        return punctuation | navigation | ((n < LONG_LINE) & F.lower(line).rlike(PHRASES))

    unspaced = F.when(F.octet_length(line) == F.length(line), F.lit(0)).otherwise((F.length(F.regexp_replace(line, UNSPACED, "")) / 2).cast("int"))
    return let(F.size(words(line)) + unspaced, judge)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", max_loss: float = 0.5, short_line: int = 8, heavy_punctuation: float = 0.6) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, lost_chars, kept."""
    body = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(key), body.alias("body"))
    found = read.select(
        key,
        "body",
        let(words(F.col("body")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("again"))).alias("w"),
        F.length(without(F.col("body"), BLANK_CHARS)).cast("long").alias("word_chars"),
        (F.length("body") - F.length(without(F.col("body"), SYMBOLS))).cast("long").alias("n_symbols"),
        let(
            F.filter(F.split("body", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            lambda ls: F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("again"), F.filter(ls, lambda x: ~line_fails(x, short_line, heavy_punctuation)).alias("good")),
        ).alias("lines"),
    )
    kept = found.select("*", F.array_join("lines.good", "\n").alias("clean_text"))
    failed = (F.col("w.n") < 20) | (100 * F.col("w.again") > 30 * F.col("w.n"))
    lost = F.col("word_chars") - F.length(without(F.col("clean_text"), BLANK_CHARS))
    return kept.select(
        key,
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.again").alias("n_dup_lines"),
        F.col("w.again").alias("n_repeat_words"),
        failed.alias("base_failed"),
        "clean_text",
        lost.alias("lost_chars"),
        (~failed & (lost <= max_loss * F.col("word_chars"))).alias("kept"),
    )
