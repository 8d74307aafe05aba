"""Text rules as column expressions over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Stop words of keyword extraction.
KEYWORD_STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been being have has had do does did will "
    "would could should may might can this that these those"
).split()

# Stop words of key terms for search queries.
TERM_STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been have has had do does did will would can "
    "could should may might must about above after again against all am any as because before being below between "
    "both during each few from further having here how if into just more most no nor not now only other our out over "
    "own same so some such than that then there these they this those through under until very what when where which "
    "while who whom why you"
).split()

# Stop words of the query variants that name file kinds.
VARIANT_STOP_WORDS = (
    "analyze analysis dataset data about the a an and or but in on at to for of with by is are was were be been have "
    "has had do does did will would could should may might can this that these those study research predict "
    "prediction model machine learning ai artificial intelligence"
).split()

# Stop words of keyword relevance.
RELEVANCE_STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been have has had do does did will would could "
    "should may might can about this that these those analyze analysis dataset data"
).split()

# The characters that separate words, and the punctuation stripped from their edges.
BLANKS = "".join(chr(c) for c in (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
    0x3000))
EDGE_PUNCTUATION = '.,!?()[]{}":;'


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it.

    Column expressions are trees: a value used twice is computed twice, and
    array functions are not shared between the copies.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Lower-case words between blanks."""
    spaced = F.translate(F.lower(text), BLANKS, " " * len(BLANKS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def bare_words(text: Column) -> Column:
    """Words without edge punctuation, those longer than two characters."""
    stripped = F.transform(words(text), lambda w: F.btrim(w, F.lit(EDGE_PUNCTUATION)))
    return F.filter(stripped, lambda w: F.length(w) > 2)


def extract_keywords(text: Column, k: int = 5) -> Column:
    """First k words longer than two characters that are no stop words."""
    kept = F.filter(words(text), lambda w: (F.length(w) > 2) & ~w.isin(KEYWORD_STOP_WORDS))
    return F.slice(kept, 1, k)


def key_terms(text: Column, stop_words: list[str] = TERM_STOP_WORDS) -> Column:
    """Words without edge punctuation, stop words left out; all long words if nothing remains."""
    return let(bare_words(text), lambda bare: let(
        F.filter(bare, lambda w: ~w.isin(stop_words)),
        lambda kept: F.when(F.size(kept) > 0, kept).otherwise(bare)))


def queries_from_terms(text: Column, terms: Column, limit: int = 15) -> Column:
    """The question, each term with and without "dataset" / "data", and combinations of the first terms.

    Terms are made distinct before they are spelt out: repeats would only give
    repeated queries, and no more than ``limit`` distinct terms can show.
    """
    some = F.slice(F.array_distinct(terms), 1, limit)
    single = F.flatten(F.transform(some, lambda t: F.array(t, F.concat(t, F.lit(" dataset")), F.concat(t, F.lit(" data")))))
    none = F.array().cast("array<string>")
    first, second, third = (F.get(terms, F.lit(i)) for i in range(3))
    pair = F.when(F.size(terms) >= 2, F.array(F.concat_ws(" ", first, second),
                                              F.concat_ws(" ", first, second, F.lit("dataset")))).otherwise(none)
    triple = F.when(F.size(terms) >= 3, F.array(F.concat_ws(" ", first, second, third))).otherwise(none)
    return F.slice(F.array_distinct(F.concat(F.array(text), single, pair, triple)), 1, limit)


def generate_search_queries(text: Column, limit: int = 15) -> Column:
    return let(key_terms(text), lambda terms: queries_from_terms(text, terms, limit))


def variants_from_terms(terms: Column, limit: int = 10) -> Column:
    """Term, adjacent-pair, csv and analysis variants."""
    none = F.array().cast("array<string>")

    def suffixed(some: Column, *suffixes: str) -> Column:
        return F.flatten(F.transform(some, lambda t: F.array(*[F.concat(t, F.lit(s)) for s in suffixes])))

    half, quarter = limit // 2, limit // 4
    pairs = F.when(F.size(terms) >= 2, F.transform(
        F.sequence(F.lit(0), F.least(F.size(terms) - 1, F.lit(quarter)) - 1),
        lambda i: F.concat_ws(" ", F.get(terms, i), F.get(terms, i + 1), F.lit("dataset")))).otherwise(none)
    if quarter == 0:
        pairs = none
    parts = F.concat(suffixed(F.slice(terms, 1, half), " dataset", " data"), pairs,
                     suffixed(F.slice(terms, 1, quarter), " csv", " analysis"))
    return F.slice(F.array_distinct(parts), 1, limit)


def generate_search_queries_v2(text: Column, limit: int = 10) -> Column:
    return let(key_terms(text, VARIANT_STOP_WORDS), lambda terms: variants_from_terms(terms, limit))


def relevance_words(question: str) -> list[str]:
    """Distinct words of one question that count for its relevance; a driver-side constant."""
    bare = [w.strip(EDGE_PUNCTUATION) for w in question.lower().split()]
    return list(dict.fromkeys(w for w in bare if len(w) > 2 and w not in RELEVANCE_STOP_WORDS))


def keyword_relevance(text: Column, question: str | Column) -> Column:
    """Share of the question's words found in the text, plus 0.2 if any, at most 1; 0.5 without words.

    For a fixed question the words are constants and the test is a chain of
    ``contains``; a question column is split into words row by row.
    """
    def score(found: Column, total: Column) -> Column:
        share = F.try_divide(found, total)
        boosted = F.when(found > 0, share + 0.2).otherwise(share)
        return F.when(total > 0, F.least(boosted, F.lit(1.0))).otherwise(0.5)

    if isinstance(question, str):
        terms = relevance_words(question)
        if not terms:
            return F.lit(0.5)
        return let(F.lower(text), lambda low: let(
            sum((F.contains(low, F.lit(w)).cast("int") for w in terms), F.lit(0)),
            lambda found: score(found, F.lit(len(terms)))))
    asked = F.array_distinct(F.filter(bare_words(question), lambda w: ~w.isin(RELEVANCE_STOP_WORDS)))
    return let(asked, lambda some: let(F.lower(text), lambda low: let(
        F.size(F.filter(some, lambda w: F.contains(low, w))), lambda found: score(found, F.size(some)))))


def dataset_text(title: Column, description: Column, tags: Column, categories: Column, keywords: Column,
                 subtitle: Column) -> Column:
    """One text of a catalog record; blank parts are skipped."""

    def blank_to_null(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    return F.concat_ws(" ", blank_to_null(title), blank_to_null(description), tags, categories, keywords,
                       blank_to_null(subtitle))


def insight_text(title: Column, description: Column, category: Column) -> Column:
    return F.concat_ws(" ", title, description, F.concat(F.lit("Category: "), category))


def result_text(question: Column, insights: Column, recommendations: Column) -> Column:
    """Labelled text of a result; insights and recommendations are arrays of descriptions."""

    def labelled(items: Column, label: str) -> Column:
        return F.transform(items, lambda d: F.concat(F.lit(label), F.coalesce(d, F.lit(""))))

    return F.concat_ws(" ", F.concat(F.lit("Research question: "), question), labelled(insights, "Insight: "),
                       labelled(recommendations, "Recommendation: "))


def slug(ref: Column) -> Column:
    return F.replace(ref, F.lit("/"), F.lit("_"))


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def coalesce_fields(*alternatives: Column) -> Column:
    """The first alternative that is neither null nor blank."""
    return F.coalesce(*[F.nullif(a, F.lit("")) for a in alternatives])


def dataset_ref(ref: Column, owner: Column, name: Column) -> Column:
    """The given ref, else owner/name when both are there."""
    built = F.concat(F.nullif(owner, F.lit("")), F.lit("/"), F.nullif(name, F.lit("")))
    return F.coalesce(F.nullif(ref, F.lit("")), built)


def truncate_text(text: Column, limit: int, always_mark: bool = False) -> Column:
    """Text cut at ``limit`` characters and marked with dots; ``always_mark`` marks short texts too."""
    cut = F.concat(F.substring(text, 1, limit), F.lit("..."))
    return cut if always_mark else F.when(F.length(text) > limit, cut).otherwise(text)


def format_date(text: Column) -> Column:
    """ISO text as "Month DD, YYYY"; text that is no date stays as it is."""
    iso = F.regexp_replace(text, "Z$", "")
    when = F.coalesce(*[F.try_to_timestamp(iso, F.lit(f)) for f in
                        ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd")])
    return F.coalesce(F.date_format(when, "MMMM dd, yyyy"), text)


def duration_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def selection_reason(similarity: Column, downloads: Column, usability: Column, votes: Column) -> Column:
    # Thresholds and sentences of the selection reasons.
    reasons = F.concat_ws(
        "; ",
        F.when(similarity > 0.7, "High semantic similarity to research question"),
        F.when(downloads > 1000, "Popular dataset with high download count"),
        F.when(usability > 7, "High usability rating"),
        F.when(votes > 10, "Well-voted dataset"),
    )
    return F.coalesce(F.nullif(reasons, F.lit("")), F.lit("Selected based on semantic similarity"))


def describe_column(name: Column, family: Column) -> Column:
    # Name rules, first match wins, then rules by column family.
    rules = [
        (["id"], "Unique identifier for the record"),
        (["date", "time"], "Date/time information"),
        (["price", "cost", "amount"], "Monetary value or price information"),
        (["name", "title"], "Name or title information"),
        (["email"], "Email address"),
        (["phone"], "Phone number"),
        (["address"], "Address information"),
    ]
    lowered = F.lower(name)
    result = F
    for parts, sentence in rules:
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(lowered, F.lit(part))
        result = result.when(hit, sentence)
    return (result.when(family == "numeric", "Numeric value")
            .when(family == "string", "Text or categorical information").otherwise("Data field"))
