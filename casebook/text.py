"""Text rules over documents, pages, conversations and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.functions import parsing, text as t
from sondage.functions.vectors import encoder_udf, hashing_encode

from .fixtures import shape, sql_shape
from .registry import case, table

_BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
_EDGE = r"""^[.,!?()\[\]{}":;]+|[.,!?()\[\]{}":;]+$"""


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{_BLANKS}'), lambda w: w <> '')"


def bare_sql(text: str) -> str:
    return f"list_filter(list_transform({words_sql(text)}, lambda w: regexp_replace(w, '{_EDGE}', '', 'g')), lambda w: length(w) > 2)"


def terms_sql(text: str, stop) -> str:
    kept = f"list_filter({bare_sql(text)}, lambda w: NOT list_contains({listed(stop)}, w))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {bare_sql(text)} END"


def distinct_sql(items: str) -> str:
    """list_distinct loses the order; this keeps it."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def joined(column):
    return F.concat_ws("|", column)


@case("extract_keywords", f"""
    SELECT doc_id, array_to_string(list_filter({words_sql('text')}, lambda w: length(w) > 2 AND NOT list_contains({listed(t.KEYWORD_STOP_WORDS)}, w))[1:5], '|') AS keywords
    FROM documents""")
def extract_keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", joined(t.extract_keywords(F.col("text"))).alias("keywords"))


@case("key_terms", f"SELECT doc_id, array_to_string({terms_sql('text', t.TERM_STOP_WORDS)}, '|') AS terms FROM documents")
def key_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", joined(t.key_terms(F.col("text"))).alias("terms"))


@case("generate_search_queries", f"""
    WITH q AS (SELECT doc_id, text, {terms_sql('text', t.TERM_STOP_WORDS)} AS k FROM documents),
    l AS (SELECT doc_id, [text] || flatten(list_transform(k, lambda w: [w, w || ' dataset', w || ' data']))
            || CASE WHEN len(k) >= 2 THEN [k[1] || ' ' || k[2], k[1] || ' ' || k[2] || ' dataset'] ELSE [] END
            || CASE WHEN len(k) >= 3 THEN [k[1] || ' ' || k[2] || ' ' || k[3]] ELSE [] END AS items FROM q),
    firsts AS (SELECT doc_id, item, MIN(i) AS i FROM (SELECT doc_id, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM l) GROUP BY 1, 2)
    SELECT doc_id, string_agg(item, '|' ORDER BY i) AS queries FROM
      (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM firsts) WHERE n <= 15 GROUP BY doc_id""")
def generate_search_queries(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", joined(t.generate_search_queries(F.col("text"))).alias("queries"))


@case("generate_search_queries_v2", f"""
    WITH q AS (SELECT conv_id, turn, {terms_sql('text', t.VARIANT_STOP_WORDS)} AS k FROM conversations),
    l AS (SELECT conv_id, turn, flatten(list_transform(k[1:5], lambda w: [w || ' dataset', w || ' data']))
            || list_transform(range(1, least(len(k) - 1, 2) + 1), lambda i: k[i] || ' ' || k[i + 1] || ' dataset')
            || flatten(list_transform(k[1:2], lambda w: [w || ' csv', w || ' analysis'])) AS items FROM q)
    SELECT conv_id, turn, array_to_string(({distinct_sql('items')})[1:10], '|') AS queries FROM l""")
def generate_search_queries_v2(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", joined(t.generate_search_queries_v2(F.col("text"))).alias("queries"))


QUESTION = "Analyze the thatin, data about (ononst) and hehely zzzz?"


@case("keyword_relevance", f"""
    WITH w AS (SELECT list_distinct(list_filter({bare_sql("'" + QUESTION + "'")}, lambda w: NOT list_contains({listed(t.RELEVANCE_STOP_WORDS)}, w))) AS k),
    m AS (SELECT doc_id, len(k) AS n, len(list_filter(k, lambda x: contains(lower(text), x))) AS hits FROM documents, w)
    SELECT doc_id, ROUND(CASE WHEN n = 0 THEN 0.5 ELSE LEAST(hits / n + CASE WHEN hits > 0 THEN 0.2 ELSE 0 END, 1.0) END, 6) AS relevance FROM m""")
def keyword_relevance(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.round(t.keyword_relevance(F.col("text"), QUESTION), 6).alias("relevance"))


@case("keyword_relevance_rows", f"""
    WITH c AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    w AS (SELECT conv_id, turn, answer, list_distinct(list_filter({bare_sql('question')}, lambda w: NOT list_contains({listed(t.RELEVANCE_STOP_WORDS)}, w))) AS k FROM c),
    m AS (SELECT conv_id, turn, len(k) AS n, len(list_filter(k, lambda x: contains(lower(answer), x))) AS hits FROM w)
    SELECT conv_id, turn, ROUND(CASE WHEN n = 0 THEN 0.5 ELSE LEAST(hits / n + CASE WHEN hits > 0 THEN 0.2 ELSE 0 END, 1.0) END, 6) AS relevance FROM m""")
def keyword_relevance_rows(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    replies = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.join(replies, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(t.keyword_relevance(F.col("answer"), F.col("text")), 6).alias("relevance"))


@case("dataset_text", f"""
    SELECT doc_id, concat_ws(' ', NULLIF(title, ''), NULLIF(description, ''), lang, 'src', source, lang || 's') AS record FROM {sql_shape('candidates')}""")
def dataset_text(spark, sf_dir):
    record = t.dataset_text(F.col("title"), F.col("description"), F.array("lang"), F.array(F.lit("src"), F.col("source")),
                            F.array().cast("array<string>"), F.concat("lang", F.lit("s")))
    return shape(spark, sf_dir, "candidates").select("doc_id", record.alias("record"))


@case("insight_text", f"""
    SELECT doc_id, concat_ws(' ', title, CASE WHEN doc_id % 4 <> 0 THEN description END, 'Category: ' || source) AS insight FROM {sql_shape('candidates')}""")
def insight_text(spark, sf_dir):
    described = F.when(F.col("doc_id") % 4 != 0, F.col("description"))
    return shape(spark, sf_dir, "candidates").select(
        "doc_id", t.insight_text(F.col("title"), described, F.col("source")).alias("insight"))


@case("result_text", f"""
    SELECT doc_id, concat_ws(' ', 'Research question: ' || title, 'Insight: ' || description, 'Insight: ' || lang, 'Recommendation: ' || source) AS result
    FROM {sql_shape('candidates')}""")
def result_text(spark, sf_dir):
    return shape(spark, sf_dir, "candidates").select("doc_id", t.result_text(
        F.col("title"), F.array("description", "lang"), F.array("source")).alias("result"))


@case("embed_text")
def embed_text(spark, sf_dir):
    encoded = hashing_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return encoded.select("doc_id", "embedding")


@case("embed_text_plugin")
def embed_text_plugin(spark, sf_dir):
    def load():
        import numpy as np

        def encode(texts: list[str]):
            """Letter shares of each whole text: a stand-in for a model that a user plugs in."""
            letters = "abcdefghijklmnopqrstuvwxyz"
            return np.array([[x.count(c) for c in letters] for x in texts], dtype="float32")

        return encode

    return table(spark, sf_dir, "documents").select("doc_id", encoder_udf(load)(F.lower("text")).alias("embedding"))


@case("selection_reason", f"""
    SELECT doc_id, COALESCE(NULLIF(concat_ws('; ', CASE WHEN vote_count / 20.0 > 0.7 THEN 'High semantic similarity to research question' END,
      CASE WHEN download_count > 1000 THEN 'Popular dataset with high download count' END, CASE WHEN usability_rating > 7 THEN 'High usability rating' END,
      CASE WHEN vote_count > 10 THEN 'Well-voted dataset' END), ''), 'Selected based on semantic similarity') AS reason FROM {sql_shape('candidates')}""")
def selection_reason(spark, sf_dir):
    reason = t.selection_reason(F.col("vote_count") / 20, F.col("download_count"), F.col("usability_rating"), F.col("vote_count"))
    return shape(spark, sf_dir, "candidates").select("doc_id", reason.alias("reason"))


@case("extract_code_blocks", rf"""
    WITH b AS (SELECT doc_id, reply, regexp_extract_all(reply, '(?s)```(?:python)?\n(.*?)\n```', 1) AS blocks FROM {sql_shape('replies')})
    SELECT doc_id, CASE WHEN len(blocks) = 0 THEN regexp_replace(reply, '^\s+|\s+$', '', 'g')
           ELSE array_to_string(list_transform(blocks, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), '|') END AS blocks, GREATEST(len(blocks), 1) AS n FROM b""")
def extract_code_blocks(spark, sf_dir):
    blocks = parsing.extract_code_blocks(F.col("reply"))
    return shape(spark, sf_dir, "replies").select("doc_id", joined(blocks).alias("blocks"), F.size(blocks).cast("bigint").alias("n"))


@case("strip_code_blocks", rf"""
    SELECT doc_id, regexp_replace(regexp_replace(reply, '(?s)```.*?```', '', 'g'), '^\s+|\s+$', '', 'g') AS explanation FROM {sql_shape('replies')}""")
def strip_code_blocks(spark, sf_dir):
    return shape(spark, sf_dir, "replies").select("doc_id", parsing.strip_code_blocks(F.col("reply")).alias("explanation"))


_JSON = "(json_valid(reply))"
_SCORE = r"""COALESCE(TRY_CAST(NULLIF(regexp_extract(reply, '(?i)score["\s:]*([0-9]*\.?[0-9]+)', 1), '') AS DOUBLE), 0)"""


@case("parse_json_or_text", rf"""
    SELECT doc_id, CASE WHEN {_JSON} THEN COALESCE(TRY_CAST(json_extract_string(CASE WHEN {_JSON} THEN reply END, '$.score') AS DOUBLE), 0) ELSE {_SCORE} END AS relevance_score,
           CASE WHEN {_JSON} THEN COALESCE(json_extract_string(CASE WHEN {_JSON} THEN reply END, '$.reasoning'), '') ELSE reply END AS reasoning,
           CASE WHEN {_JSON} THEN 'success' ELSE 'parsed_text' END AS status,
           CASE WHEN {_JSON} THEN TRY_CAST(json_extract_string(CASE WHEN {_JSON} THEN reply END, '$.confidence') AS DOUBLE) ELSE 0.5 END AS confidence,
           CASE WHEN {_JSON} THEN 'success' ELSE 'partial' END AS confidence_status,
           CASE WHEN {_JSON} THEN 'a' || doc_id || '|b' ELSE reply END AS recommendations FROM {sql_shape('replies')}""")
def parse_json_or_text(spark, sf_dir):
    reply = F.col("reply")
    relevance = parsing.relevance_reply(reply)
    _, _, confidence, status = parsing.confidence_reply(reply)
    recommended, _ = parsing.analysis_reply(reply)
    return shape(spark, sf_dir, "replies").select(
        "doc_id", *relevance, confidence, status.alias("confidence_status"), joined(recommended).alias("recommendations"))


@case("parse_score", f"SELECT doc_id, {_SCORE} AS score FROM {sql_shape('replies')}")
def parse_score(spark, sf_dir):
    return shape(spark, sf_dir, "replies").select("doc_id", parsing.parse_score(F.col("reply")).alias("score"))


@case("lines_to_list", rf"""
    SELECT doc_id, array_to_string(list_filter(list_transform(string_split(reply, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:10], '|') AS lines
    FROM {sql_shape('replies')}""")
def lines_to_list(spark, sf_dir):
    return shape(spark, sf_dir, "replies").select("doc_id", joined(parsing.lines_to_list(F.col("reply"), 10)).alias("lines"))


@case("slug", f"SELECT path, replace(path, '/', '_') AS slug FROM {sql_shape('files')}")
def slug(spark, sf_dir):
    return shape(spark, sf_dir, "files").select("path", t.slug(F.col("path")).alias("slug"))


@case("file_stem", rf"""
    SELECT path, CASE WHEN contains(n, '.') THEN regexp_replace(n, '\.[^.]*$', '') ELSE n END AS stem
    FROM (SELECT path, string_split(path, '/')[-1] AS n FROM {sql_shape('files')})""")
def file_stem(spark, sf_dir):
    return shape(spark, sf_dir, "files").select("path", t.file_stem(F.col("path")).alias("stem"))


@case("coalesce_fields", f"""
    SELECT doc_id, COALESCE(NULLIF(description, ''), NULLIF(title, ''), source) AS label,
           COALESCE(NULLIF(CASE WHEN doc_id % 2 = 0 THEN ref ELSE '' END, ''), NULLIF(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, '') || '/' || source) AS ref
    FROM {sql_shape('candidates')}""")
def coalesce_fields(spark, sf_dir):
    given = F.when(F.col("doc_id") % 2 == 0, F.col("ref")).otherwise("")
    owner = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return shape(spark, sf_dir, "candidates").select(
        "doc_id", t.coalesce_fields(F.col("description"), F.col("title"), F.col("source")).alias("label"),
        t.dataset_ref(given, owner, F.col("source")).alias("ref"))


@case("truncate_text", """
    SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS abstract, substring(text, 1, 200) || '...' AS teaser FROM documents""")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", t.truncate_text(F.col("text"), 500).alias("abstract"), t.truncate_text(F.col("text"), 200, True).alias("teaser"))


@case("duration_seconds", f"""
    SELECT id, ROUND((epoch_us(completed_at) - epoch_us(started_at)) / 1e6, 6) AS seconds FROM {sql_shape('tasks')}""")
def duration_seconds(spark, sf_dir):
    seconds = t.duration_seconds(F.col("started_at"), F.col("completed_at"))
    return shape(spark, sf_dir, "tasks").select("id", F.round(seconds, 6).alias("seconds"))


@case("format_date", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%B %d, %Y') END AS shown FROM orders""")
def format_date(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = (F.when(key % 10 == 0, "soon").when(key % 10 < 4, F.date_format("o_orderdate", "yyyy-MM-dd"))
           .when(key % 10 < 7, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
           .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.format_date(raw).alias("shown"))
