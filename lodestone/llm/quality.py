"""Line-first quality rules, in DataFrame functions alone.

Every line with a word is judged for punctuation, navigation and boilerplate; lines that fail are taken out,
and a document that loses more than a share of its words goes. Counts of whole
documents come first: sizes, symbols, repeated lines and repeated three-word windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \\t\\n\\x0B\\f\\r"
#: Repeated windows of a text up to which each window is looked up in their list; beyond, windows are sorted with their places.
FEW = 24
SYMBOLS = "#*$%&|<>"
# fixed values: phrases of page furniture
BOILERPLATE = "cookie|javascript|all rights reserved|terms of (use|service)|privacy policy|subscribe|sign (in|up)|log in|click here|read more|copyright|lorem ipsum"


def _without(c: Column, characters: str) -> Column:
    for x in characters:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def _line_fails(line: Column) -> Column:
    words = F.size(F.split(F.trim(line), f"[{SPACE}]+"))
    symbols = F.length(line) - F.length(_without(line, SYMBOLS + "{}=~^"))
    shouts = F.length(line) - F.length(_without(line, "!?"))
    bars = F.length(line) - F.length(_without(line, "|»›·"))
    punctuation = ((symbols >= 3) & (symbols * 4 > words)) | ((shouts >= 3) & (shouts > words)) | ~line.rlike("\\p{L}")
    navigation = (bars >= 3) & (bars * 4 >= words)
    boilerplate = (words <= 30) & F.lower(line).rlike(BOILERPLATE)
    return punctuation | navigation | boilerplate


def _words(c: Column) -> Column:
    """Words of a text or line; an empty array without any."""
    inner = F.btrim(c, F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeat: int = 50, most_lost: int = 50, with_text: bool = False) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_lines_removed, n_words_removed).

    kept is false for documents with fewer than least_words words, with more than most_repeat per cent of words in repeated
    three-word windows, or losing more than most_lost per cent of their words with failing lines. A null text counts as empty and
    fails. Every row gives a row; a null id stays null. Other columns are not read. with_text adds cleaned: the lines that stay, of kept documents.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col), text.alias("t"), _words(text).alias("w"))
    n = F.size("w")
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    triples = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    first = base.select(
        id_col, n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"), lines.alias("lines"), triples.alias("h"),
    )
    second = first.withColumns({"n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "s": F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array("h"))})
    third = second.withColumn("d", F.when(F.col("s").isNotNull(), F.array_distinct(F.filter("s", lambda x, j: F.get("s", j + 1) == x))))
    few = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains("d", x), i)), lambda i: i.isNotNull())
    fourth = third.withColumn("p", F.when(F.size("d") > FEW, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    many = F.sort_array(F.transform(F.filter("p", lambda e, j: F.get("p", j - 1)["x"].eqNullSafe(e["x"]) | F.get("p", j + 1)["x"].eqNullSafe(e["x"])), lambda e: e["i"]))
    fifth = fourth.withColumn("at", F.when(F.col("d").isNull(), F.array().cast("array<int>")).when(F.col("p").isNull(), few).otherwise(many))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")))["n"]
    bad = F.filter("lines", _line_fails)
    judged = fifth.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"), bad.alias("bad"), *[F.array_join(F.filter("lines", lambda line: ~_line_fails(line)), "\n").alias("clean")] * with_text)
    lost = F.aggregate("bad", F.lit(0).cast("long"), lambda a, line: a + F.size(F.split(F.btrim(line, F.lit(" \t\n\x0b\f\r")), f"[{SPACE}]+")))
    out = judged.withColumns({"base_failed": (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words")), "n_lines_removed": F.size("bad").cast("long"), "n_words_removed": lost})
    kept = ~F.col("base_failed") & (100 * F.col("n_words_removed") <= most_lost * F.col("n_words"))
    done = out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_lines", "n_lines_removed", "n_words_removed", *[F.when(kept, F.col("clean")).alias("cleaned")] * with_text)
    # rows come out of a generator, so that a filter on a result is not pushed down into copies of all of the above
    return done.select(F.inline(F.array(F.struct(*done.columns))))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, r, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + o) AS n FROM m, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
k AS (SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, len(string_split_regex(trim(line, ' '), '[\x20\x09-\x0D]+')) AS m,
  length(line) - length(regexp_replace(line, '[#*$%&|<>{}=~^]', '', 'g')) AS s, length(line) - length(regexp_replace(line, '[!?]', '', 'g')) AS e,
  length(line) - length(regexp_replace(line, '[|»›·]', '', 'g')) AS b FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT r, line, n, (s >= 3 AND s * 4 > m) OR (e >= 3 AND e > m) OR NOT regexp_matches(line, '\p{L}') OR (b >= 3 AND b * 4 >= m)
  OR (m <= 30 AND regexp_matches(lower(line), 'cookie|javascript|all rights reserved|terms of (use|service)|privacy policy|subscribe|sign (in|up)|log in|click here|read more|copyright|lorem ipsum')) AS bad FROM k),
x AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad) AS n_lines_removed, coalesce(sum(n) FILTER (bad), 0)::BIGINT AS n_words_removed FROM f GROUP BY r),
y AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(x.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed, coalesce(n_words_removed, 0)::BIGINT AS n_words_removed
  FROM w LEFT JOIN x ON w.r = x.r LEFT JOIN c ON w.r = c.r),
z AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * n_words_removed <= 50 * n_words AS kept, n_lines, n_lines_removed, n_words_removed FROM z
"""
