"""Quality rules, line first, in DataFrame functions only.

Every line of a text is judged by rules of punctuation, navigation and boilerplate; lines that fail go, and a document that loses
too much of its text this way is rejected. Beside it stand the statistics of the whole text that rule documents out by themselves:
too few words, or too many words in runs that the text repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words (white space is ASCII white space), and the characters that count as symbols.
WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: Words of a window that counts as repeated, fewest words of a document, most words of a hundred in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: A line ends as a sentence does with one of these, closing quotes and brackets after it allowed.
ENDED = r"""[.!?…。！？:;]["'”’»)\]]*\s*$"""
#: A line of fewer words must end as a sentence does.
SHORT = 12
#: A word of these marks alone stands between the entries of menus, paths and tables.
BETWEEN = r"^[|»›·•>/\\-]+$"
#: Runs of marks that prose doesn't use.
SHOUTED = r"[!?]{2,}|[#*$%&<>]{2,}"
#: One such mark, or one word that equals the word before it, in so many words, or more, fails a line.
EACH = 5
#: Phrases of pages and not of their text, in lower case.
PHRASES = (
    "all rights reserved", "accept cookies", "add to cart", "click here", "cookie policy", "cookie settings", "enable javascript", "forgot your password", "javascript is disabled",
    "log in to", "lorem ipsum", "privacy policy", "read more", "sign in to", "sign up for", "skip to content", "subscribe to our", "terms of service", "terms of use",
)
#: A line of so many letters or more, of which more than MOST_UPPER of a hundred are capitals, is a heading or shouts.
LETTERS, MOST_UPPER = 12, 70
#: A document stays while its good lines keep so many of a hundred of the characters of its words.
LEAST_KEPT = 50

RULES = ("punctuation", "navigation", "boilerplate")


def _once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def failed_rule(line: Column, words: Column) -> Column:
    """The first rule that a line of these words breaks, null if it breaks none. A line without words breaks none."""
    n, upper, lower = F.size(words), _count(line, r"\p{Lu}"), _count(line, r"\p{Ll}")
    few = (n < SHORT) & ~line.rlike(ENDED)
    loud = _count(line, SHOUTED) * EACH >= n
    menu = F.size(F.filter(words, lambda x: x.rlike(BETWEEN))) * EACH >= n
    stutter = (n >= SHORT) & (F.size(F.filter(words, lambda x, i: x == F.get(words, i - 1))) * EACH >= n)
    capitals = _once(F.struct(upper.alias("u"), lower.alias("l")), lambda x: (x["u"] + x["l"] >= LETTERS) & (x["u"] * 100 > (x["u"] + x["l"]) * MOST_UPPER))
    page = F.lower(line).rlike("|".join(PHRASES))
    return F.when(n == 0, None).when(few | loud, RULES[0]).when(menu, RULES[1]).when(stutter | page | capitals, RULES[2])


def judged_lines(text: Column) -> Column:
    """array<struct<line, words, failed, chars>> of the \\n-split lines, in order; chars are those of the words. A null text has none."""

    def one(line: Column) -> Column:
        own = F.struct(line.alias("line"), F.regexp_extract_all(line, F.lit(WORD), F.lit(0)).alias("words"))
        return _once(own, lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), failed_rule(x["line"], x["words"]).alias("failed"), F.length(F.array_join(x["words"], "")).alias("chars")))

    return F.transform(F.split(text, "\n"), one)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many of the words lie in runs of window words that occur twice or more, the first occurrence included.

    Runs are told apart by two 64-bit hashes of their words. Sorted with their places, equal ones are neighbours; the time is that of
    sorting, whatever repeats.
    """

    def of_many(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        run = lambda i: F.slice(w, i + 1, window)
        keyed = F.transform(starts, lambda i: F.struct(F.xxhash64(run(i)).alias("h"), F.xxhash64(F.lit(1), run(i)).alias("g"), i.alias("at")))
        same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))
        twice = lambda s: F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["at"].alias("at"), (same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))).alias("met"))), lambda x: x["met"]), lambda x: x["at"])
        places = F.sort_array(_once(F.sort_array(keyed), twice))
        covered = lambda p: F.aggregate(F.transform(p, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - at, F.lit(window)))), F.lit(0), lambda a, b: a + b)
        return _once(places, covered)

    return _once(words, lambda w: F.when(F.size(w) > window, of_many(w)).otherwise(0))


def clean_lines(docs: DataFrame, least_kept: int = LEAST_KEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned, n_lines, n_failed (one count for
    each of RULES) of every whole text.

    cleaned holds the lines that break no rule, joined by \\n. base_failed: under LEAST_WORDS words, or over MOST_REPEATED of a hundred
    in repeated windows. kept: not base_failed, and the good lines keep least_kept of a hundred of the words' characters (so a
    document just at a limit stays). n_dup_lines counts lines with a word that equal an earlier line; lines are compared as they are.

    A null text counts as empty: no words, no lines with words, not kept. Null ids stay null, repeated rows give equal rows, an
    empty table gives none. Other columns are not carried on.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    solid = lambda lines: F.aggregate(F.transform(lines, lambda x: x["chars"]), F.lit(0).cast("long"), lambda a, b: a + b)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), judged_lines(text).alias("lines"), _count(text, SYMBOL).cast("long").alias("n_symbols"))

    def failures(lines: Column, rule: str) -> Column:
        return F.size(F.filter(lines, lambda x: x["failed"] == rule)).cast("long")

    def facts(lines: Column) -> Column:
        good = F.filter(lines, lambda x: x["failed"].isNull())
        spoken = F.transform(F.filter(lines, lambda x: F.size(x["words"]) > 0), lambda x: x["line"])
        words = F.flatten(F.transform(lines, lambda x: x["words"]))
        return F.struct(
            _once(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeated"))).alias("words"),
            solid(lines).alias("word_chars"),
            solid(good).alias("good_chars"),
            _once(spoken, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
            F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("cleaned"),
            F.size(spoken).cast("long").alias("n_lines"),
            F.array(*(failures(lines, r) for r in RULES)).alias("n_failed"),
        )

    told = read.select("doc_id", "n_symbols", _once(F.col("lines"), facts).alias("f"))
    told = told.select("doc_id", "n_symbols", F.col("f.words.n").alias("n_words"), F.col("f.words.repeated").alias("n_repeat_words"), "f.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    stays = ~failed & (F.col("good_chars") * 100 >= F.col("word_chars") * least_kept)
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), stays.alias("kept"), "cleaned", "n_lines", "n_failed")


def oracle() -> str:
    """DuckDB SQL of op13's rows, with each rule written out over tables of lines, words and windows."""
    ended, phrases = ENDED.replace("'", "''"), "|".join(PHRASES)
    return rf"""with line as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
    cut as (select *, regexp_extract_all(line, '{WORD}') as w from line),
    told as (select doc_id, line, w, len(w) as n, length(array_to_string(w, ''))::BIGINT as solid,
        (len(w) < {SHORT} and not regexp_matches(line, '{ended}')) or len(regexp_extract_all(line, '{SHOUTED}')) * {EACH} >= len(w) as p,
        len(list_filter(w, lambda x: regexp_matches(x, '{BETWEEN}'))) * {EACH} >= len(w) as m,
        (len(w) >= {SHORT} and len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) * {EACH} >= len(w)) or regexp_matches(lower(line), '{phrases}')
        or (len(regexp_extract_all(line, '[\p{{Lu}}\p{{Ll}}]')) >= {LETTERS} and len(regexp_extract_all(line, '\p{{Lu}}')) * 100 > len(regexp_extract_all(line, '[\p{{Lu}}\p{{Ll}}]')) * {MOST_UPPER}) as b
        from cut where len(w) > 0),
    lines as (select doc_id, sum(solid) as word_chars, sum(case when p or m or b then 0 else solid end) as good, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines,
        count(*) filter (p) as n_punctuation, count(*) filter (m and not p) as n_navigation, count(*) filter (b and not p and not m) as n_boilerplate from told group by doc_id),
    doc as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '{SYMBOL}')) as n_symbols, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
    seen as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from doc),
    win as (select doc_id, i, count(*) over (partition by doc_id, run) as met from (select doc_id, i, array_to_string(list(word) over ahead, ' ') as run, count(*) over ahead as n from seen
        window ahead as (partition by doc_id order by i rows between current row and {WINDOW - 1} following)) where n = {WINDOW}),
    met as (select doc_id, sum(least({WINDOW}, coalesce(after - i, {WINDOW}))) as n_repeat_words from (select doc_id, i, lead(i) over (partition by doc_id order by i) as after from win where met > 1) group by doc_id),
    every as (select doc_id, len(w) as n_words, n_symbols, coalesce(word_chars, 0)::BIGINT as word_chars, coalesce(good, 0) as good, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT as n_repeat_words,
        coalesce(n_lines, 0) as n_lines, coalesce(n_punctuation, 0) as n_punctuation, coalesce(n_navigation, 0) as n_navigation, coalesce(n_boilerplate, 0) as n_boilerplate
        from doc left join lines using (doc_id) left join met using (doc_id))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed,
        not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words) and good * 100 >= word_chars * {LEAST_KEPT} as kept, n_lines, n_punctuation, n_navigation, n_boilerplate from every"""
