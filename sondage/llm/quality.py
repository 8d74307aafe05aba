"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Counts of a text come from array expressions: words, symbols, repeated lines,
words in repeated 3-word windows, stop words, capitals, letters of other languages. The
rules are rows of (name, measure, lowest, highest, unless) and become one boolean column. A
rule abstains where its ``unless``, a measure and the least of it, holds: stop words are
asked for only of texts in the letters of the languages that the list knows.

Windows are compared by their 64-bit hash, so two different windows of one text
would have to collide (below 1e-9 for a text of a hundred thousand words) to be
counted as a repeat.

Defined results: a null, empty or blank text has no words, no lines and fails the
base rule; each row is judged by itself, whatever its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .frames import column, pick

_BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Frequent function words of the languages that the rules know.
STOP_WORDS = """
the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you
der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou mais
el los las del se una por con no su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando
""".split()

#: Characters that texts in those languages hold: Latin-1, the oe ligature, general punctuation, the euro sign.
AT_HOME = r"[\x00-\xFF\x{152}\x{153}\x{2000}-\x{206F}\x{20AC}]+"

#: (rule, measure, lowest, highest, unless); null means no bound. Ratios are per word, per line or per character.
RULES = [
    ("word_length", "mean_word_chars", 1.5, 20.0, None),
    ("symbols", "symbols_per_word", None, 0.25, None),
    ("repeated_lines", "repeated_line_share", None, 0.5, None),
    ("stop_words", "stop_word_share", 0.005, None, ("foreign_share", 0.02)),
    ("capitals", "capital_share", None, 0.4, None),
]


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame with the base counts of its text in a column ``counts`` (a struct); other columns stay."""
    body = F.coalesce(column(text), F.lit(""))
    words = F.array_remove(F.split(body, _BLANK), "")
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    names = df.columns
    # One struct per step: what it reads more than once is then computed once.
    staged = df.select(*[column(n) for n in names], body.alias("_q_body"), words.alias("_q_words"), lines.alias("_q_lines"))
    hashes = F.slice(F.transform("_q_words", lambda word, i: F.struct(
        F.xxhash64(word, F.get("_q_words", i + 1), F.get("_q_words", i + 2)).alias("h"), i.alias("p"))),
        1, F.greatest(F.size("_q_words") - 2, F.lit(0)))
    staged = staged.withColumn("_q_sorted", F.sort_array(hashes))
    twice = F.filter(F.transform("_q_sorted", lambda e, j: F.when(
        (e["h"] == F.get("_q_sorted", j - 1)["h"]) | (e["h"] == F.get("_q_sorted", j + 1)["h"]), e["p"])),
        lambda p: p.isNotNull())
    repeated = F.aggregate(
        F.sort_array(twice), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda done, p: F.struct((done["n"] + F.least(F.lit(3), p - done["last"])).alias("n"), p.alias("last")))["n"]
    joined = F.concat_ws("", "_q_words")
    measured = {
        "n_words": F.size("_q_words"),
        "word_chars": F.length(joined),
        "n_symbols": F.length("_q_body") - F.length(F.translate("_q_body", SYMBOLS, "")),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": repeated,
        "n_lines": F.size("_q_lines"),
        "n_stop_words": F.size(F.filter("_q_words", lambda word: F.lower(word).isin(STOP_WORDS))),
        "n_foreign": F.length(F.regexp_replace(joined, AT_HOME, "")),
        "n_capitals": F.length(joined) - F.length(F.translate(joined, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
    }
    whole = F.struct(*[c.cast("long").alias(n) for n, c in measured.items()])
    # The row number is a barrier: a filter on the counts must not be pushed below the steps above, where each of its
    # references would compute them again, once per word.
    return staged.select(*[column(n) for n in names], F.when(F.monotonically_increasing_id() >= 0, whole).alias("counts"))


def measures(c: Column) -> dict[str, Column]:
    """The ratios that rules refer to; none where there is nothing to divide by."""
    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b)

    return {
        "mean_word_chars": share(c["word_chars"], c["n_words"]),
        "symbols_per_word": share(c["n_symbols"], c["n_words"]),
        "repeated_line_share": share(c["n_dup_lines"], c["n_lines"]),
        "stop_word_share": share(c["n_stop_words"], c["n_words"]),
        "capital_share": share(c["n_capitals"], c["word_chars"]),
        "foreign_share": share(c["n_foreign"], c["word_chars"]),
    }


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def passes(c: Column, rules: list[tuple] = RULES) -> Column:
    """The base rule and every row of the table."""
    values = measures(c)
    verdict = ~base_failed(c)
    for _, measure, low, high, unless in rules:
        holds = F.lit(True)
        if low is not None:
            holds &= F.coalesce(values[measure] >= low, F.lit(False))
        if high is not None:
            holds &= F.coalesce(values[measure] <= high, F.lit(False))
        if unless is not None:
            holds |= F.coalesce(values[unless[0]] >= unless[1], F.lit(False))
        verdict &= holds
    return verdict


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """Per row: ``doc_id``, the counts, the ratios, ``base_failed`` and ``kept``."""
    c = F.col("counts")
    return counts(pick(docs, doc_id=doc_id, text=text)).select(
        "doc_id", "counts.*", *[v.alias(n) for n, v in measures(c).items()],
        base_failed(c).alias("base_failed"), passes(c, rules).alias("kept"))


def keep_good(docs: DataFrame, *, text: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """The rows that pass, with their own columns only."""
    counted = docs.select(F.struct(*[column(n) for n in docs.columns]).alias("_row"), column(text).alias("_text"))
    return counts(counted, "_text").where(passes(F.col("counts"), rules)).select("_row.*")
