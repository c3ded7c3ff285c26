"""Vector, retrieval and context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnspark.operators import chunking, dense, documents as D, golden, impact, index as I, latent, questions as Q, reports, retrieval as R, vector_groups
from churnspark.operators.ranking import top_per_group
from churnspark.plans import search_blocks as B
from churnspark.plans.corpus import all_documents
from churnspark.plans.registry import block, query, sql
from churnspark.plans.scoring_blocks import LISTED, filled as filled_sql
from churnspark.session import materialize
from churnspark.sources import tables as T


def asked(wh):
    return wh.table("benchmark").select(F.col("item_id").alias("question_id"), "text")


def corpus(wh):
    return wh.table("documents").select("doc_id", "text")


def document_index(wh):
    """The index of whole documents, built once per session."""
    return wh.kept("document-index", ("documents",), lambda: I.build(corpus(wh), ["doc_id"]))


def retriever(wh, cutter=chunking.fixed):
    """The corpus with its chunk index, built once per session and way of cutting."""

    def make():
        made = R.Retriever(corpus(wh), cutter)
        made.index  # noqa: B018 - written now, as part of what is kept
        return made

    return wh.kept(f"chunk-index-{cutter.__name__}", ("documents",), make)


def shown(hits):
    return hits.withColumn("score", F.round("score", 6))


# Dense vectors ---------------------------------------------------------------------------------


def vectors(wh):
    return wh.table("embeddings").select(F.col("vec_id").alias("vec_id"), F.col("embedding").alias("vec"), "label")


block(
    "centroids",
    """
SELECT label AS query_id, list(x ORDER BY dim) AS vec FROM (
  SELECT label, dim, avg(x) AS x FROM (
    SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1
""",
)


def dense_sql(where):
    return sql(
        f"""
SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM (
    SELECT query_id, vec_id, list_cosine_similarity(vec, embedding::DOUBLE[]) AS s FROM embeddings, centroids {where}))
WHERE rank <= 5
""",
        "centroids",
    )


@query("RET4 JN8", dense_sql(""))
def dense_topk(wh):
    """The nearest vectors to the mean vector of every label."""
    return shown(dense.top_k(vectors(wh), dense.centroids(vectors(wh), "label", "vec"), 5))


@query("RET7 FLT2", dense_sql("WHERE label BETWEEN 2 AND 5"))
def dense_topk_filtered(wh):
    kept = vectors(wh).filter(F.col("label").between(2, 5))
    return shown(dense.top_k(kept, dense.centroids(vectors(wh), "label", "vec"), 5))


PRUNED_SQL = """
SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s
    FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0))
WHERE rank <= 5
"""


@query("RET4 JN8", PRUNED_SQL)
def dense_topk_pruned(wh):
    """The nearest vectors to every fiftieth vector, by groups round centres with their angle bounds."""
    grouped = wh.kept("vector-groups", ("embeddings",), lambda: vector_groups.group(vectors(wh)))
    queries = vectors(wh).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    return shown(vector_groups.top_k(grouped, queries, 5))


# Text retrieval --------------------------------------------------------------------------------


@query(
    "RET3",
    sql(
        """
SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS tokens, round(max(weight), 6) AS top_weight, round(sum(weight * weight), 6) AS norm
FROM doc_post GROUP BY 1
""",
        "doc_post",
    ),
)
def document_vectors(wh):
    postings = document_index(wh).postings
    return postings.groupBy("doc_id").agg(
        F.count("*").alias("terms"),
        F.sum("tf").alias("tokens"),
        F.round(F.max("weight"), 6).alias("top_weight"),
        F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm"),
    )


def latent_vectors(wh):
    """Vectors of documents and questions, written once per session."""
    index = document_index(wh)

    def make():
        texts, questions = latent.text_vectors(index, asked(wh), ["question_id"])
        return materialize(texts, "text-vectors"), materialize(questions, "question-vectors")

    return wh.kept("latent-vectors", ("documents", "benchmark"), make)


@query("RET3", sql("SELECT doc_id, 64 AS dimensions, 1.0::DOUBLE AS length FROM doc_post GROUP BY 1", "doc_post"))
def text_vectors(wh):
    """Dense vectors made from the texts: one direction per document that has a token."""
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return latent_vectors(wh)[0].select("doc_id", F.size("vec").cast("int").alias("dimensions"), F.round(length, 6).alias("length"))


@query("RET3 RET4")
def latent_topk(wh):
    """The nearest documents to every question by these vectors, and whether sparse search finds them as well."""
    texts, questions = latent_vectors(wh)
    found = dense.top_k(texts.withColumnRenamed("doc_id", "vec_id"), questions.withColumnRenamed("question_id", "query_id"), 5)
    near = found.select(F.col("query_id").alias("question_id"), F.col("vec_id").alias("doc_id"), F.round("score", 4).alias("score"), "rank")
    sparse = I.best(document_index(wh), asked(wh), ["question_id"], 5).select("question_id", "doc_id", F.lit(True).alias("sparse"))
    return near.join(sparse, ["question_id", "doc_id"], "left").withColumn("sparse", F.coalesce("sparse", F.lit(False)))


TOP_DOCS = """
SELECT question_id, doc_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {0}) WHERE rank <= 5
"""


def top_documents(wh, allowed=None):
    index = document_index(wh)
    if allowed is not None:
        index = index.within(allowed)
    top = I.best(index, asked(wh), ["question_id"], 5)
    return shown(top.select("question_id", "doc_id", "score", "rank"))


@query("RET5 RET6", sql(TOP_DOCS.format("doc_scored"), "doc_scored"))
def text_topk(wh):
    return top_documents(wh)


block("doc_filtered", "SELECT s.* FROM doc_scored s JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars BETWEEN 500 AND 5000", "doc_scored")


def impact_index(wh):
    """The postings of whole documents by impact, written once per session."""
    index = document_index(wh)
    return wh.kept("impact-index", ("documents",), lambda: impact.order(index))


@query("RET5 RET6", sql(TOP_DOCS.format("doc_scored"), "doc_scored"))
def impact_topk(wh):
    """The same by impact-ordered posting blocks, without those that cannot enter the best five."""
    top = impact.best(impact_index(wh), asked(wh), ["question_id"], 5)
    return shown(top.select("question_id", "doc_id", "score", "rank"))


@query("RET7 FLT2", sql(TOP_DOCS.format("doc_filtered"), "doc_filtered"))
def impact_topk_filtered(wh):
    """Thresholds count only documents that the filter lets through."""
    kept = wh.table("documents").filter((F.col("lang") == "en") & F.col("n_chars").between(500, 5000))
    top = impact.best(impact_index(wh), asked(wh), ["question_id"], 5, allowed=kept.select("doc_id"))
    return shown(top.select("question_id", "doc_id", "score", "rank"))


@query("RET7 FLT2", sql(TOP_DOCS.format("doc_filtered"), "doc_filtered"))
def text_topk_filtered(wh):
    """Filters on metadata reach the scan; corpus statistics stay those of the whole corpus."""
    kept = wh.table("documents").filter((F.col("lang") == "en") & F.col("n_chars").between(500, 5000))
    return top_documents(wh, kept.select("doc_id"))


HIT = "SELECT question_id, method, rank, doc_id, parent_no, child_no, round(score, 6) AS score, text FROM "


def by_strategy(name, wh):
    return shown(R.strategy(name)(retriever(wh), asked(wh), 5))


@query("RET5 RET12", sql(HIT + "naive_hits", "naive_hits"))
def naive(wh):
    return by_strategy("naive", wh)


@query("RET8 SET4", sql(HIT + "multi_hits", "multi_hits"))
def multi_query(wh):
    return by_strategy("multi_query", wh)


@query("RET9 JN1", sql(HIT + "parent_hits", "parent_hits"))
def parent_document(wh):
    return by_strategy("parent_document", wh)


@query("RET10", sql(HIT + "compressed_hits", "compressed_hits"))
def contextual_compression(wh):
    return by_strategy("contextual_compression", wh)


@query("RET11", sql(HIT + "rerank_hits", "rerank_hits"))
def reranking(wh):
    return by_strategy("reranking", wh)


def all_hits(wh):
    return R.run(retriever(wh), asked(wh), 5)


@query("RET12 SET2", sql("SELECT method, question_id, rank, doc_id FROM hits", "hits"))
def all_strategies(wh):
    return all_hits(wh).select("method", "question_id", "rank", "doc_id")


B.index_blocks("separated_kid", "separated_tiers", B.CHILD)
B.strategy_blocks("separated_", "asked", 5, "separated_kid", "separated_tiers")


@query("RET12 RET1", sql(HIT + "separated_naive_hits", "separated_naive_hits"))
def naive_by_separators(wh):
    """Naive retrieval over chunks cut at separators."""
    return shown(R.naive(retriever(wh, chunking.by_separators), asked(wh), 5))


@query(
    "RET18 AGG20",
    sql("SELECT question_id, method, count(*) AS documents, arg_min(doc_id, rank) AS first_doc FROM hits GROUP BY 1, 2", "hits"),
)
def strategy_comparison(wh):
    return all_hits(wh).groupBy("question_id", "method").agg(
        F.count("*").alias("documents"), F.min_by("doc_id", "rank").alias("first_doc")
    )


@query(
    "RET15",
    sql(
        "SELECT question_id, count(*) AS documents, string_agg('[Document ' || rank || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context "
        "FROM naive_hits GROUP BY 1",
        "naive_hits",
    ),
)
def contexts(wh):
    return R.contexts(by_strategy("naive", wh), ["question_id"])


@query(
    "RET15 PRJ19",
    sql(
        """
SELECT question_id, '**Relevant Historical Context:**' || chr(10) || chr(10) || string_agg(chr(10) || rank || '. '
  || CASE WHEN lang = 'en' THEN '📊 Similar Churn Case' WHEN lang = 'de' THEN '🎫 Support Ticket' ELSE '📄 Reference' END
  || ':' || chr(10) || substring(h.text, 1, 500) || '...' || chr(10), chr(10) ORDER BY rank) AS context
FROM naive_hits h JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1
""",
        "naive_hits",
    ),
)
def labelled_contexts(wh):
    kind = F.when(F.col("lang") == "en", "churn_analysis").when(F.col("lang") == "de", "support_ticket").otherwise(F.col("lang"))
    kinds = wh.table("documents").select("doc_id", kind.alias("source_type"))
    return R.labelled_contexts(by_strategy("naive", wh).join(kinds, "doc_id"), D.source_label("source_type"))


# Question classes, routes and external pages -----------------------------------------------------


block(
    "golden_questions",
    """
SELECT 'customer_specific:' || account_name AS question_id, 'customer_specific' AS query_type,
       'Why did ' || account_name || ' churn and what did they switch to?' AS question FROM churned
UNION ALL SELECT DISTINCT 'pattern_analysis:' || primary_reason, 'pattern_analysis',
       'What patterns are common among customers lost to ' || primary_reason || '?' FROM churned
UNION ALL SELECT DISTINCT 'segment_analysis:' || segment, 'segment_analysis',
       'Which risks are unique to the ' || segment || ' segment?' FROM churned
UNION ALL SELECT DISTINCT 'financial_analysis:' || segment, 'financial_analysis',
       'How much recurring revenue did we lose with ' || segment || ' customers?' FROM churned
UNION ALL SELECT DISTINCT 'competitive_intelligence:' || competitor, 'competitive_intelligence',
       'Which customers switch to ' || competitor || ' as an alternative?' FROM lost_to
""",
    "churned",
    "lost_to",
)


def golden_questions(wh, categories=None):
    rivals = T.account_competitors(wh, accounts=wh.churned)
    return golden.questions(wh.churned, rivals, categories)


def class_sql(text):
    def count(words):
        return " + ".join(f"contains(lower({text}), '{w}')::INT" for w in words)

    scores = {t: f"({count(w)})" for t, w in Q.TYPE_WORDS.items()}
    top = f"greatest({', '.join(scores.values())})"
    cases = " ".join(f"WHEN {s} = {top} THEN '{t}'" for t, s in scores.items())
    return f"CASE WHEN {top} = 0 THEN '{Q.DEFAULT_TYPE}' {cases} END"


block("all_asked", "SELECT question_id, question AS text FROM golden_questions", "golden_questions")
B.index_blocks("prof", "profiles", "doc_id", "content")
B.score_blocks("prof_scored", "prof", "doc_id", "all_asked", "question_id")
B.score_blocks("account_scored", "prof", "doc_id", "asked", "question_id")
block(
    "routed",
    f"""
SELECT *, CASE type WHEN 'pattern_analysis' THEN 'multi_query' WHEN 'retention_strategy' THEN 'contextual_compression' ELSE 'naive' END AS method,
       CASE type WHEN 'competitive_intel' THEN 7 ELSE 5 END AS k
FROM (SELECT *, {class_sql("question")} AS type FROM golden_questions)
""",
    "golden_questions",
)


@query("RET13 RET14", sql("SELECT question_id, type, method, k FROM routed", "routed"))
def question_routes(wh):
    typed = golden_questions(wh).withColumn("type", Q.classify("question"))
    method, k = Q.route("type")
    return typed.select("question_id", "type", method.alias("method"), k.alias("k"))


@query(
    "RET14",
    "SELECT event_id, CASE WHEN event_type = 'view' THEN 'general_inquiry' ELSE 'pattern_analysis' END AS query_type FROM events",
)
def validated_labels(wh):
    """Labels made elsewhere: known ones are kept, all others become the default type."""
    label = F.when(F.col("event_type") == "view", " General_Inquiry ").otherwise(F.col("event_type"))
    return wh.events.select("event_id", Q.valid_type(label).alias("query_type"))


def profile_corpus(wh):
    return D.account_documents(T.churn_table(wh)).select("doc_id", F.col("content").alias("text"), "metadata")


def routed_hits(wh):
    """Every question by the strategy and k of its type; one scoring pass for each strategy."""
    # Classified once and written: the type's expression is large, and every strategy reads the routes.
    typed = materialize(golden_questions(wh).select("question_id", "question", Q.classify("question").alias("type")), "typed")
    method, k = Q.route("type")
    typed = typed.select("question_id", F.col("question").alias("text"), method.alias("method"), k.alias("k"))
    routes = materialize(typed, "routes")
    retriever = R.Retriever(materialize(profile_corpus(wh).select("doc_id", "text"), "profiles"))
    deepest = max(k for _, k in Q.ROUTES.values())
    # Each strategy searches only the questions that take it, and only one that needs variants derives them.
    asked_by, found_by = {}, {}
    for name in sorted({m for m, _ in Q.ROUTES.values()}):
        asked_by[name] = routes.where(F.col("method") == name).select("question_id", "text")
        found_by[name] = R.find(retriever, asked_by[name], deepest, with_variants=name == "multi_query", with_parents=False)
    retriever = retriever.holding(*[found.children for found in found_by.values()])
    parts = []
    for name, found in found_by.items():
        depth = max(k for m, k in [*Q.ROUTES.values(), Q.DEFAULT_ROUTE] if m == name)
        hits = R.strategy(name)(retriever, asked_by[name], depth, found)
        parts.append(hits.join(routes.select("question_id", "method", "k"), ["question_id", "method"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # multi_query keeps k per variant, so only the other strategies are cut at their own k.
    return out.filter((F.col("method") == "multi_query") | (F.col("rank") <= F.col("k"))).drop("k")


block("profile_texts", "SELECT doc_id, content AS text FROM profiles", "profiles")
B.chunk_index("routed_", "profile_texts")
B.strategy_blocks("routed_", "all_asked", 7, "routed_kid", "routed_children")
B.strategy_blocks("routed5_", "all_asked", 5, "routed_kid", "routed_children", "routed_variants")


@query(
    "RET13 RET14",
    sql(
        """
SELECT question_id, method, rank, doc_id, parent_no, child_no, round(score, 6) AS score FROM (
  SELECT h.* FROM routed_naive_hits h JOIN routed USING (question_id) WHERE routed.method = 'naive' AND rank <= k
  UNION ALL SELECT h.* FROM routed5_multi_hits h JOIN routed USING (question_id) WHERE routed.method = 'multi_query'
  UNION ALL SELECT h.* FROM routed_compressed_hits h JOIN routed USING (question_id) WHERE routed.method = 'contextual_compression' AND rank <= k)
""",
        "routed",
        "routed_naive_hits",
        "routed5_multi_hits",
        "routed_compressed_hits",
    ),
)
def routed_retrieval(wh):
    return shown(routed_hits(wh)).drop("text")


B.strategy_blocks("research_", "asked", 10, variants="variants")
B.strategy_blocks("writing_", "asked", 8, variants="variants")


@query("RET13 RET8", sql(HIT + "research_multi_hits", "research_multi_hits"))
def research_retrieval(wh):
    """The research stage's route: its own strategy and depth for every question."""
    method, k = Q.STAGE_ROUTES["research"]
    return shown(R.strategy(method)(retriever(wh), asked(wh), k))


@query("RET13 RET11", sql(HIT + "writing_rerank_hits", "writing_rerank_hits"))
def writing_retrieval(wh):
    """The writing stage's route."""
    method, k = Q.STAGE_ROUTES["writing"]
    return shown(R.strategy(method)(retriever(wh), asked(wh), k))


block(
    "own_variants",
    """
SELECT question_id, 0 AS variant, text FROM asked
UNION ALL SELECT question_id, 1, 'customer ' || text FROM asked UNION ALL SELECT question_id, 2, reverse(text) FROM asked
""",
    "asked",
)
B.strategy_blocks("own_", "asked", 5, variants="own_variants")


@query("RET8 SET4", sql(HIT + "own_multi_hits", "own_multi_hits"))
def multi_query_given_variants(wh):
    """Several variants of each question that the caller supplies."""
    questions = asked(wh)
    given = questions.select("question_id", F.lit(1).alias("variant"), F.concat(F.lit("customer "), "text").alias("text")).unionByName(
        questions.select("question_id", F.lit(2).alias("variant"), F.reverse("text").alias("text"))
    )
    return shown(R.multi_query(retriever(wh), questions, 5, own=given))


@query(
    "FLT9",
    sql(
        """
SELECT question_id, (type = 'competitive_intel' OR coalesce(documents, 0) < 2 OR regexp_matches(lower(question), 'industry|benchmark|trend')) AS external
FROM routed LEFT JOIN (SELECT question_id, least(count(*), 5) AS documents FROM prof_scored GROUP BY 1) USING (question_id)
""",
        "routed",
        "prof_scored",
    ),
)
def external_needed(wh):
    """Documents are the profiles that retrieval finds for the question."""
    found = use_cases(wh).groupBy("question_id").agg(F.count("*").alias("documents"))
    typed = golden_questions(wh).withColumn("type", Q.classify("question")).join(found, "question_id", "left")
    typed = typed.withColumn("documents", F.coalesce("documents", F.lit(0)))
    return typed.select("question_id", Q.needs_external("question", "type", "documents").alias("external"))


block("account_filters", "SELECT question_id, text, length(text) % 6 AS kind FROM asked", "asked")
block(
    "account_asked",
    """
SELECT question_id, text, CASE WHEN kind IN (1, 4) THEN 'BUILDING' END AS segment, CASE WHEN kind IN (2, 4) THEN '1-URGENT' END AS churn_reason,
       CASE WHEN kind IN (3, 4) THEN 100000.0::DOUBLE WHEN kind = 5 THEN 0.0::DOUBLE END AS arr_from,
       CASE WHEN kind = 3 THEN 1000000.0::DOUBLE WHEN kind = 5 THEN 0.0::DOUBLE END AS arr_to FROM account_filters
""",
    "account_filters",
)


@query(
    "FLT2 RET7",
    sql(
        """
SELECT question_id, doc_id, round(score, 6) AS score, rank FROM (
  SELECT s.*, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank
  FROM account_scored s JOIN profiles p USING (doc_id) JOIN account_asked a USING (question_id)
  WHERE (a.segment IS NULL OR p.segment = a.segment) AND (a.churn_reason IS NULL OR p.churn_reason = a.churn_reason)
    AND (a.arr_from IS NULL OR p.arr_lost >= a.arr_from) AND (a.arr_to IS NULL OR p.arr_lost <= a.arr_to)) WHERE rank <= 5
""",
        "account_scored",
        "profiles",
        "account_asked",
    ),
)
def accounts_filtered_topk(wh):
    """Each question with its own filters on segment, reason and ARR; NULL is no filter, 0 is a bound."""
    questions = asked(wh).withColumn("kind", F.length("text") % 6).select(
        "question_id",
        "text",
        F.when(F.col("kind").isin(1, 4), "BUILDING").alias("segment"),
        F.when(F.col("kind").isin(2, 4), "1-URGENT").alias("churn_reason"),
        F.when(F.col("kind").isin(3, 4), 100000.0).when(F.col("kind") == 5, 0.0).alias("arr_from"),
        F.when(F.col("kind") == 3, 1000000.0).when(F.col("kind") == 5, 0.0).alias("arr_to"),
    )
    return shown(R.filtered(materialize(profile_corpus(wh), "profiles"), questions, 5))


block(
    "readable",
    r"""
SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages
""",
)
B.index_blocks("page", "readable", "page_id")
block(
    "derived",
    """
SELECT question_id, i AS query_no, ['SaaS customer churn', 'customer retention best practices', 'churn analysis industry trends'][i + 1]
       || ' ' || text AS text FROM asked, range(3) r(i)
""",
    "asked",
)
B.score_blocks("page_scored", "page", "page_id", "derived", "question_id, query_no")


@query("PRJ14", sql("SELECT page_id, text FROM readable", "readable"))
def page_texts(wh):
    return wh.table("pages").select("page_id", R.visible_text("html").alias("text"))


@query(
    "RET19 WIN8",
    sql(
        """
SELECT question_id, query_no, page_id, url, rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id, query_no ORDER BY round(score, 9) DESC, page_id) AS rank FROM page_scored)
JOIN pages USING (page_id) WHERE rank <= 2
""",
        "page_scored",
    ),
)
def external_topk(wh):
    return shown(R.external(wh.table("pages"), asked(wh)))


# Sources, citations and confidence ---------------------------------------------------------------

block(
    "use_cases",
    """
SELECT question_id, rank, doc_id, account_name, segment, churn_reason, arr_lost FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM prof_scored)
JOIN profiles USING (doc_id) WHERE rank <= 5
""",
    "prof_scored",
    "profiles",
)


def use_cases(wh):
    """The five account profiles closest to each question, with their metadata."""
    profiles = materialize(profile_corpus(wh), "profiles")
    questions = golden_questions(wh).select("question_id", F.col("question").alias("text"))
    top = I.best(I.build(profiles.select("doc_id", "text"), ["doc_id"]), questions, ["question_id"], 5)
    return top.join(profiles.select("doc_id", "metadata.*"), "doc_id")


block("rag_asked", "SELECT account_id AS question_id, " + filled_sql(reports.CONTEXT_QUESTION) + " AS text FROM graded", "graded")
B.score_blocks("rag_scored", "prof", "doc_id", "rag_asked", "question_id")
block(
    "rag_contexts",
    """
SELECT question_id AS account_id, '**Relevant Historical Context:**' || chr(10) || chr(10) || string_agg(chr(10) || rank
  || '. 📊 Similar Churn Case:' || chr(10) || substring(content, 1, 500) || '...' || chr(10), chr(10) ORDER BY rank) AS context FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM rag_scored)
JOIN profiles USING (doc_id) WHERE rank <= 3 GROUP BY 1
""",
    "rag_scored",
    "profiles",
)


CONTEXT = "coalesce(context, '')"


@query(
    "SCR18 RET15",
    sql(
        f"SELECT account_id, {filled_sql(reports.REPORT, **LISTED, context=CONTEXT)} AS report "
        "FROM advised LEFT JOIN rag_contexts USING (account_id)",
        "advised",
        "rag_contexts",
    ),
)
def account_reports_with_context(wh):
    """Reports with the three closest churned profiles as their context."""
    from churnspark.plans.scoring import scored

    profiles = materialize(profile_corpus(wh).select("doc_id", "text"), "profiles")
    accounts = materialize(scored(wh), "scored")
    questions = accounts.select(F.col("account_id").alias("question_id"), reports.context_question().alias("text"))
    top = I.best(I.build(profiles, ["doc_id"]), questions, ["question_id"], 3).join(profiles, "doc_id")
    found = R.labelled_contexts(top.withColumn("source_type", F.lit("churn_analysis")), D.source_label("source_type"))
    return reports.with_reports(accounts, found.withColumnRenamed("question_id", "account_id")).select("account_id", "report")


PAGE_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
B.score_blocks("web_scored", "page", "page_id", "all_asked", "question_id")
block(
    "web_hits",
    f"""
SELECT question_id, url, trim(regexp_extract(html, '{PAGE_TITLE}', 1)) AS title, place FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, page_id) AS place FROM web_scored)
JOIN pages USING (page_id) WHERE place <= 3
""",
    "web_scored",
)


def web_hits(wh, questions):
    """The three pages closest to each question, with url and title."""
    readable = wh.table("pages").select("page_id", R.visible_text("html").alias("text"))
    top = I.best(I.build(readable, ["page_id"]), questions, ["question_id"], 3)
    titled = wh.table("pages").select("page_id", "url", F.trim(F.regexp_extract("html", PAGE_TITLE, 1)).alias("title"))
    return top.select("question_id", "page_id", F.col("rank").alias("place")).join(titled, "page_id")


@query(
    "RET17",
    sql(
        """
SELECT question_id, 'UC' || rank AS citation_id, 'use_case' AS type, account_name AS customer, segment, churn_reason,
       '$' || format('{:,}', trunc(arr_lost::DECIMAL(18,2))::BIGINT) || '.' || right('0' || ((arr_lost::DECIMAL(18,2) * 100)::BIGINT % 100), 2) AS arr_lost,
       'high' AS relevance FROM use_cases
""",
        "use_cases",
    ),
)
def citations(wh):
    from churnspark.functions.columns import money2

    return use_cases(wh).select(
        "question_id",
        F.concat(F.lit("UC"), F.col("rank")).alias("citation_id"),
        F.lit("use_case").alias("type"),
        F.col("account_name").alias("customer"),
        "segment",
        "churn_reason",
        money2(F.col("arr_lost").cast("decimal(18,2)")).alias("arr_lost"),
        F.lit("high").alias("relevance"),
    )


@query(
    "RET16 SCR20",
    sql(
        """
SELECT question_id, 'customer_data' AS type, account_name AS source, segment AS detail, 'high' AS relevance, rank AS position FROM use_cases
UNION ALL SELECT question_id, 'knowledge_graph', segments || ' segments', NULL, 'high', 6 FROM all_asked, (SELECT count(DISTINCT segment) AS segments FROM churned)
UNION ALL SELECT question_id, 'web_research', url, title, 'medium', 6 + place FROM web_hits
""",
        "use_cases",
        "all_asked",
        "churned",
        "web_hits",
    ),
)
def source_lists(wh):
    """Five profiles, the graph and the three best pages per question."""
    questions = golden_questions(wh)
    segments = wh.churned.agg(F.countDistinct("segment")).scalar()
    from_documents = use_cases(wh).select(
        "question_id", F.lit("customer_data").alias("type"), F.col("account_name").alias("source"),
        F.col("segment").alias("detail"), F.lit("high").alias("relevance"), F.col("rank").alias("position"),
    )
    from_graph = questions.select(
        "question_id",
        F.lit("knowledge_graph").alias("type"),
        F.concat(segments.cast("string"), F.lit(" segments")).alias("source"),
        F.lit(None).cast("string").alias("detail"),
        F.lit("high").alias("relevance"),
        F.lit(6).cast("bigint").alias("position"),
    )
    from_web = web_hits(wh, questions.select("question_id", F.col("question").alias("text"))).select(
        "question_id", F.lit("web_research").alias("type"), F.col("url").alias("source"), F.col("title").alias("detail"),
        F.lit("medium").alias("relevance"), (F.col("place") + 6).alias("position"),
    )
    return from_documents.unionByName(from_graph).unionByName(from_web)


@query(
    "RET16 RET17",
    sql(
        """
SELECT question_id, 'EXT' || row_number() OVER (PARTITION BY question_id ORDER BY query_no, rank) AS citation_id,
       'external_source' AS type, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, url, 'supporting' AS relevance
FROM (SELECT *, row_number() OVER (PARTITION BY question_id, query_no ORDER BY round(score, 9) DESC, page_id) AS rank FROM page_scored)
JOIN pages USING (page_id) WHERE rank <= 2
""",
        "page_scored",
    ),
)
def external_citations(wh):
    # Six pages per question at most: two for each of three derived queries.
    found = R.external(wh.table("pages"), asked(wh)).withColumnRenamed("rank", "within")
    numbered = top_per_group(found, "question_id", ["query_no", "within"], 6)
    titled = wh.table("pages").select("page_id", F.trim(F.regexp_extract("html", PAGE_TITLE, 1)).alias("title"))
    return numbered.join(titled, "page_id").select(
        "question_id", F.concat(F.lit("EXT"), F.col("rank")).alias("citation_id"), F.lit("external_source").alias("type"),
        "title", "url", F.lit("supporting").alias("relevance"),
    )


@query(
    "SCR20",
    sql(
        """
SELECT question_id, round(greatest(0.0, least(1.0, documents * 0.15::DOUBLE + groups * 0.1::DOUBLE - 0 * 0.2::DOUBLE)), 2) AS confidence
FROM (SELECT question_id, count(*) AS documents FROM naive_hits GROUP BY 1), (SELECT count(DISTINCT segment) AS groups FROM churned)
""",
        "naive_hits",
        "churned",
    ),
)
def answer_confidence(wh):
    groups = wh.churned.agg(F.countDistinct("segment")).scalar()
    counted = by_strategy("naive", wh).groupBy("question_id").agg(F.count("*").alias("documents"))
    return counted.select("question_id", reports.answer_confidence(F.col("documents"), groups, F.lit(0)).alias("confidence"))


@query(
    "JN6 SET5",
    sql(
        """
SELECT account_name FROM churned WHERE primary_reason = '1-URGENT'
INTERSECT SELECT account_name FROM use_cases WHERE question_id = 'pattern_analysis:1-URGENT'
""",
        "churned",
        "use_cases",
    ),
)
def graph_and_retrieval(wh):
    """Accounts that both the graph and retrieval give for one reason."""
    from churnspark.operators import graph as G
    from churnspark.plans.graph import graph

    linked = G.customers_linked_to(*graph(wh), ["REASON:1-URGENT"]).select(F.col("customer").alias("account_name"))
    found = use_cases(wh).filter("question_id = 'pattern_analysis:1-URGENT'").select("account_name")
    return linked.intersect(found)
