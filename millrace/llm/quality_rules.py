"""Line-first quality rules, in column expressions only.

Every line is judged by itself: punctuation (a line of symbols, shouting, or
decorated words), navigation (menu separators, many tiny entries) and boilerplate
(fixed phrases). Failed lines are removed, and a document that loses too much of
its text is rejected. Base statistics of the whole text come first.

All of it happens within a row: no shuffle, no join. Repeats are found by sorting
window hashes within the row and comparing the words of windows that meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Phrases of page furniture; a line of few words with one of them fails.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "back to top",
    "click here",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share this",
    "sign in",
    "skip to content",
    "subscribe to our newsletter",
    "terms of use",
    "we use cookies",
)


def words_of(text: str | Column) -> Column:
    """Maximal runs of characters outside space and U+0009..U+000D."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def line_fails(line: Column, max_symbols: float = 0.1, min_separators: int = 3, phrase_words: int = 12) -> Column:
    """Why a line is removed: ``navigation``, ``punctuation``, ``boilerplate``
    or null. Lines without a word never fail."""
    chars = F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]", ""))
    n = lambda pattern: F.regexp_count(line, F.lit(pattern))
    separators = n(r" [|>»·•] ")
    symbols = n(r"[#*$%&|<>{}\\^~=_]")
    shouts = n(r"!!")
    phrase = F.lower(line).rlike("|".join(BOILERPLATE)) & (n(r"[^\x20\x09-\x0D]+") <= phrase_words)
    return (
        F.when(chars == 0, None)
        .when(separators >= min_separators, "navigation")
        .when((symbols > max_symbols * chars) | (shouts * 10 > chars), "punctuation")
        .when(phrase, "boilerplate")
    )


def quality(docs: DataFrame, max_lost: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, and n_lines_removed,
    lost_chars and cleaned (the text without failed lines).

    A null text counts as one without words and fails the base; its cleaned
    text is null. Repeated rows each give a row; a null doc_id stays null; an
    empty table gives no rows; other columns are not looked at. Counts are
    exact in texts of any length: hashes only bring equal windows together, and
    words decide.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    t = own.withColumn("t", F.coalesce("text", F.lit("")))
    t = t.withColumn("w", words_of("t")).withColumn("lines", F.split("t", "\n", -1))
    # a window's hash above its place, so that equal windows meet when sorted; the place
    # takes 24 bits, or as many as the text's words need
    t = t.withColumn("n", F.size("w")).withColumn("b", F.when(F.col("n") <= 1 << 24, 24).otherwise(F.ceil(F.log2("n")).cast("int")))
    t = t.withColumn("low", F.expr("shiftleft(1L, b) - 1L"))
    place = F.expr("transform(w, (x, i) -> if(i + 2 < n, (xxhash64(x, w[i + 1], w[i + 2]) & ~low) | cast(i as bigint), null))")
    t = t.withColumn("s", F.sort_array(F.array_compact(place)))
    at = lambda x, k: f"w[cast({x} & low as int) + {k}]"
    words = lambda x, y: " and ".join(f"{at(x, k)} = {at(y, k)}" for k in range(3))
    hashed = lambda x, y: f"(({x} ^ {y}) & ~low) = 0"
    beside = (("i > 0", "s[i - 1]"), ("i + 1 < size(s)", "s[i + 1]"), ("i > 1", "s[i - 2]"), ("i + 2 < size(s)", "s[i + 2]"))
    near = " or ".join(f"({ok} and {hashed('x', y)} and {words('x', y)})" for ok, y in beside)
    # beside a window of other words and the same hash bits, all windows are looked at
    mixed = " or ".join(f"({ok} and {hashed('x', y)})" for ok, y in beside[:2])
    equal = f"{near} or (({mixed}) and exists(s, y -> y <> x and {hashed('x', 'y')} and {words('x', 'y')}))"
    t = t.withColumn("r", F.sort_array(F.expr(f"transform(filter(s, (x, i) -> {equal}), x -> x & low)")))
    covered = F.expr("aggregate(transform(r, (p, i) -> if(i = 0, 3L, least(3L, p - r[i - 1]))), 0L, (a, x) -> a + x)")
    full = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    good = F.filter("lines", lambda x: line_fails(x).isNull())
    chars = lambda a: F.length(F.array_join(a, ""))
    t = t.withColumn("full", full).withColumn("good", good)
    lost = (chars(F.col("lines")) - chars(F.col("good"))).cast("long")
    out = t.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_lines_removed"),
        lost.alias("lost_chars"),
        chars(F.col("lines")).cast("long").alias("line_chars"),
        F.when(F.col("text").isNotNull(), F.array_join("good", "\n")).alias("cleaned"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("line_chars"))).drop("line_chars")
