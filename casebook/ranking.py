"""First, best and latest rows; folds; top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.operators import catalog, clean, insights, models, search, tasks

from sondage.operators.vector_index import VectorIndex
from sondage.session import shared_path

from .fixtures import shape, sql_shape
from .registry import case, table
from .statistics import ALL_TESTS_SQL, all_tests

_AS_OF = "TIMESTAMP '2024-01-15 00:00:00'"


@case("dedup_keep_first", """
    SELECT MIN(o_orderkey) AS o_orderkey, o_orderstatus, day, o_orderpriority FROM
      (SELECT o_orderkey, o_orderstatus, o_custkey % 10 AS day, o_orderpriority FROM orders) GROUP BY 2, 3, 4""")
def dedup_keep_first(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", (F.col("o_custkey") % 10).alias("day"), "o_orderpriority")
    return clean.dedup_keep_first(orders, "o_orderkey")


@case("best_per_dataset", f"""
    SELECT ref, position, query_no, relevance_score::DOUBLE AS relevance_score FROM (
      SELECT *, row_number() OVER (PARTITION BY ref ORDER BY relevance_score DESC, position) AS rn FROM {sql_shape('search_results')}) WHERE rn = 1""")
def best_per_dataset(spark, sf_dir):
    results = shape(spark, sf_dir, "search_results").withColumn("relevance_score", F.col("relevance_score").cast("double"))
    best = catalog.best_per_dataset(results, F.col("ref"), "relevance_score", "position")
    return best.select("ref", "position", "query_no", "relevance_score")


@case("unique_by_ref", f"""
    SELECT ref, query_no, position, title FROM (
      SELECT *, row_number() OVER (PARTITION BY ref ORDER BY query_no, position) AS rn FROM {sql_shape('search_results')}) WHERE rn = 1""")
def unique_by_ref(spark, sf_dir):
    results = shape(spark, sf_dir, "search_results").select("ref", "query_no", "position", "title")
    return catalog.unique_by_ref(results, "ref", "query_no", "position")


@case("kfold_assign", """
    WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, COUNT(*) OVER () AS n FROM part)
    SELECT p_partkey, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
                           ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INT) AS fold FROM p""")
def kfold_assign(spark, sf_dir):
    return models.kfold_assign(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


@case("stratified_kfold_assign", """
    WITH c AS (SELECT c_mktsegment AS label, MIN(c_custkey) AS first, COUNT(*) AS n FROM customer GROUP BY 1),
    s AS (SELECT label, n, COALESCE(SUM(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c),
    dealt AS (SELECT label, f, (SELECT COUNT(*) FROM range(CAST(start AS BIGINT), CAST(start + n AS BIGINT)) t(j) WHERE j % 5 = f) AS size FROM s, range(5) g(f)),
    upto AS (SELECT label, f, SUM(size) OVER (PARTITION BY label ORDER BY f) AS hi, SUM(size) OVER (PARTITION BY label ORDER BY f) - size AS lo FROM dealt),
    placed AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i FROM customer)
    SELECT c_custkey, c_mktsegment, CAST(f AS INT) AS fold FROM placed JOIN upto ON label = c_mktsegment AND i >= lo AND i < hi""")
def stratified_kfold_assign(spark, sf_dir):
    return models.stratified_kfold_assign(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment")


@case("stratified_split", """
    SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || '_42'), c_custkey)
           <= ceil(0.2 * COUNT(*) OVER (PARTITION BY c_mktsegment)) AS is_test FROM customer""")
def stratified_split(spark, sf_dir):
    return models.stratified_split(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment")


_COSINE = "list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), q.v)"
_QUESTION = "(SELECT vec_id AS qid, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IN ($IDS)) q"


def _vectors(spark, sf_dir, *ids):
    vectors = table(spark, sf_dir, "embeddings")
    picked = vectors.where(F.col("vec_id").isin(*ids)).orderBy("vec_id").collect()
    return vectors, [(r["vec_id"], list(r["embedding"])) for r in picked]


@case("semantic_rank", f"""
    SELECT e.vec_id, ROUND({_COSINE}, 6) AS similarity FROM embeddings e, {_QUESTION.replace('$IDS', '0')}""")
def semantic_rank(spark, sf_dir):
    vectors, [(_, question)] = _vectors(spark, sf_dir, 0)
    return search.semantic_rank(vectors, question).select("vec_id", F.round("similarity", 6).alias("similarity"))


@case("semantic_topk", f"""
    SELECT e.vec_id, e.label, ROUND({_COSINE}, 6) AS similarity FROM embeddings e, {_QUESTION.replace('$IDS', '0')}
    ORDER BY ROUND({_COSINE}, 9) DESC, e.vec_id LIMIT 10""")
def semantic_topk(spark, sf_dir):
    vectors, [(_, question)] = _vectors(spark, sf_dir, 0)
    return search.semantic_topk(vectors, question, 10, "vec_id").withColumn("similarity", F.round("similarity", 6))


@case("topk_per_question", f"""
    SELECT q.qid AS question_id, e.vec_id, ROUND({_COSINE}, 6) AS similarity,
           CAST(row_number() OVER (PARTITION BY q.qid ORDER BY ROUND({_COSINE}, 9) DESC, e.vec_id) AS INT) AS rank
    FROM embeddings e, {_QUESTION.replace('$IDS', '1, 2, 3, 5, 8, 13, 21')} QUALIFY rank <= 5""")
def topk_per_question(spark, sf_dir):
    vectors, questions = _vectors(spark, sf_dir, 1, 2, 3, 5, 8, 13, 21)
    return search.topk_per_question(vectors, questions, 5, "vec_id").withColumn("similarity", F.round("similarity", 6))


@case("topk_per_question_indexed", f"""
    SELECT q.qid AS question_id, e.vec_id, ROUND({_COSINE}, 6) AS similarity,
           CAST(row_number() OVER (PARTITION BY q.qid ORDER BY ROUND({_COSINE}, 9) DESC, e.vec_id) AS INT) AS rank
    FROM embeddings e, {_QUESTION.replace('$IDS', '1, 2, 3, 5, 8, 13, 21')} QUALIFY rank <= 5""")
def topk_per_question_indexed(spark, sf_dir):
    """The exact way through the inverted-file index."""
    vectors, questions = _vectors(spark, sf_dir, 1, 2, 3, 5, 8, 13, 21)
    index = VectorIndex.build(vectors, shared_path(spark, "vector-index"), "vec_id")
    found = index.search(questions, 5, exact=True)
    return found.withColumnRenamed("key", "vec_id").withColumn("similarity", F.round("similarity", 6))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_ASKED = "Which dataset holds the opening of another one"


def _letter_counts(df, text: str, output: str):
    """How often each letter occurs: an encoder that SQL can follow."""
    low = F.lower(text)
    return df.withColumn(output, F.array(*[(F.char_length(low) - F.char_length(F.replace(low, F.lit(c), F.lit("")))).cast("double")
                                           for c in _LETTERS]))


def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"(length({text}) - length(replace({text}, '{c}', '')))::DOUBLE" for c in _LETTERS) + "]"


@case("select_for_question", f"""
    WITH c AS (SELECT *, lower(title || ' ' || description) AS t FROM {sql_shape('candidates')}),
      s AS (SELECT *, list_cosine_similarity({_letters_sql('t')}, {_letters_sql(f"lower('{_ASKED}')")}) AS similarity FROM c),
      r AS (SELECT *, CAST(row_number() OVER (ORDER BY ROUND(similarity, 9) DESC NULLS LAST, doc_id) AS INT) AS rank FROM s WHERE NOT isnan(similarity))
    SELECT doc_id, ROUND(similarity, 6) AS similarity_score, rank, COALESCE(NULLIF(concat_ws('; ',
      CASE WHEN similarity > 0.7 THEN 'High semantic similarity to research question' END,
      CASE WHEN download_count > 1000 THEN 'Popular dataset with high download count' END,
      CASE WHEN usability_rating > 7 THEN 'High usability rating' END, CASE WHEN vote_count > 10 THEN 'Well-voted dataset' END), ''),
      'Selected based on semantic similarity') AS selection_reason FROM r WHERE rank <= 3""")
def select_for_question(spark, sf_dir):
    found = search.select_for_question(shape(spark, sf_dir, "candidates"), _ASKED, "doc_id", encode=_letter_counts)
    return found.select("doc_id", F.round("similarity_score", 6).alias("similarity_score"), "rank", "selection_reason")


@case("search_similar_insights", f"""
    SELECT e.vec_id, ROUND({_COSINE}, 6) AS similarity FROM embeddings e, {_QUESTION.replace('$IDS', '4')}
    WHERE e.label < 5 ORDER BY ROUND({_COSINE}, 9) DESC, e.vec_id LIMIT 5""")
def search_similar_insights(spark, sf_dir):
    vectors, [(_, question)] = _vectors(spark, sf_dir, 4)
    found = search.search_similar_insights(vectors, F.col("label") < 5, question, "", F.col("label").cast("string"), 5, "vec_id")
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


@case("cosine_similarity", """
    SELECT a.vec_id, ROUND(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, sf_dir):
    from sondage.functions.vectors import cosine_similarity as cosine

    vectors = table(spark, sf_dir, "embeddings")
    other = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(other, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


_TEST_ORDER = "test_type, variable1 NULLS FIRST, variable2 NULLS FIRST, dependent_variable NULLS FIRST, independent_variable NULLS FIRST"


@case("top_findings", f"""{ALL_TESTS_SQL},
    firsts AS (SELECT * FROM everything WHERE significant ORDER BY {_TEST_ORDER} LIMIT 5)
    SELECT CASE test_type WHEN 'pearson_correlation' THEN 'Strong correlation (' || printf('%.3f', correlation) || ') between ' || variable1 || ' and ' || variable2
                ELSE 'Significant difference in ' || dependent_variable || ' across ' || independent_variable || ' groups' END AS finding
    FROM firsts WHERE test_type IN ('pearson_correlation', 't_test')""")
def top_findings(spark, sf_dir):
    order = [F.asc_nulls_first(c) for c in ("test_type", "variable1", "variable2", "dependent_variable", "independent_variable")]
    return insights.top_findings(all_tests(spark, sf_dir), order)


@case("recent_log", f"SELECT run_id, agent, ts, message FROM {sql_shape('log')} ORDER BY ts DESC LIMIT 5")
def recent_log(spark, sf_dir):
    return catalog.recent(shape(spark, sf_dir, "log"), "ts", tie="event_id").select("run_id", "agent", "ts", "message")


@case("recent_projects", f"""
    SELECT run_id, MAX(ts) AS updated_at, COUNT(*) AS n_results FROM {sql_shape('stage_results')} GROUP BY run_id ORDER BY 2 DESC LIMIT 5""")
def recent_projects(spark, sf_dir):
    projects = shape(spark, sf_dir, "stage_results").groupBy("run_id").agg(
        F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("n_results"))
    return catalog.recent(projects, "updated_at", tie="run_id")


@case("dispatch_order", f"""
    WITH t AS (SELECT * FROM {sql_shape('tasks')}),
    busy AS (SELECT agent_id, COUNT(*) AS n FROM t WHERE status = 'running' GROUP BY 1),
    queued AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY priority DESC, created_at, id) AS place FROM t WHERE status = 'pending')
    SELECT id, q.agent_id, priority, created_at FROM queued q LEFT JOIN busy b ON b.agent_id = q.agent_id WHERE place <= 3 - COALESCE(n, 0)
    ORDER BY priority DESC, created_at, id LIMIT 50""")
def dispatch_order(spark, sf_dir):
    records = shape(spark, sf_dir, "tasks")
    running = records.where("status = 'running'")
    # The limit of ten is reached by the tasks of this table; here fifty more may run than do.
    return tasks.dispatch_order(records.where("status = 'pending'"), running, concurrent=running.count() + 50).select(
        "id", "agent_id", "priority", "created_at")


@case("due_tasks", f"""
    SELECT id, scheduled_for FROM {sql_shape('tasks')} WHERE status = 'pending' AND (scheduled_for IS NULL OR scheduled_for <= {_AS_OF})""")
def due_tasks(spark, sf_dir):
    queued = shape(spark, sf_dir, "tasks").where("status = 'pending'")
    return tasks.due_tasks(queued, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("id", "scheduled_for")
