"""Evaluation and golden-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnspark.operators import evaluation as E, golden, index as I, questions as Q, retrieval as R
from churnspark.plans import profile  # noqa: F401 - blocks
from churnspark.plans.registry import block, query, sql
from churnspark.plans.retrieval import asked, corpus, golden_questions, retriever
from churnspark.plans.search_blocks import toks
from churnspark.session import fresh_path, materialize
from churnspark.sources import readers, sinks, tables as T

METHODS = list(R.STRATEGIES)
RANKED = ["context_precision", "context_recall"]
LEXICAL = ["semantic_similarity", "support_ratio", "question_overlap", "token_f1"]
METRICS = [*RANKED, *LEXICAL]


@query("JN4 EVL3", sql("SELECT doc_id, question_id FROM relevant", "relevant"))
def relevant_documents(wh):
    """Documents that contain a benchmark passage."""
    return E.contained(corpus(wh), asked(wh))


def overlap_blocks(name, pairs, keys, terms=None):
    """{name}: lexical measures of pair block (keys, question, answer, ground_truth, context text)."""
    sides = {"q": "question", "a": "answer", "t": "ground_truth", "c": "context"}
    rows = " UNION ALL ".join(f"SELECT {keys}, '{s}' AS side, unnest({toks(c)}) AS term FROM {pairs}" for s, c in sides.items())
    counted = ", ".join(f"count(*) FILTER (side = '{s}') AS {s}" for s in sides)
    block(f"{name}_terms", f"SELECT {keys}, term, {counted} FROM ({rows}) GROUP BY ALL", pairs)
    similarity, source, needs = "", f"{name}_terms", ()
    if terms:
        source = (
            f"(SELECT x.*, (ln((n + 1) / (coalesce(df, 0) + 1)::DOUBLE) + 1) ^ 2 AS w FROM {name}_terms x "
            f"LEFT JOIN {terms}_df USING (term), {terms}_n)"
        )
        similarity = ", coalesce(sum(a * t * w) / nullif(sqrt(sum(a * a * w)) * sqrt(sum(t * t * w)), 0), 0) AS semantic_similarity"
        needs = (f"{terms}_df", f"{terms}_n")
    block(
        name,
        f"""
SELECT {keys}, coalesce(sum(CASE WHEN c > 0 THEN a ELSE 0 END)::DOUBLE / nullif(sum(a), 0), 0) AS support_ratio,
       coalesce(count(*) FILTER (q > 0 AND a > 0)::DOUBLE / nullif(count(*) FILTER (q > 0), 0), 0) AS question_overlap,
       coalesce(2.0::DOUBLE * sum(least(a, t)) / nullif(sum(a) + sum(t), 0), 0) AS token_f1 {similarity}
FROM {source} GROUP BY {keys}
""",
        f"{name}_terms",
        *needs,
    )


block(
    "samples",
    """
SELECT method, question_id, asked.text AS question, asked.text AS ground_truth, contexts,
       coalesce(contexts[1], '') AS answer, coalesce(array_to_string(contexts, chr(10)), '') AS context
FROM asked CROSS JOIN methods
LEFT JOIN (SELECT method, question_id, list(text ORDER BY rank) AS contexts FROM hits GROUP BY 1, 2) USING (method, question_id)
""",
    "asked",
    "methods",
    "hits",
)
overlap_blocks("overlap", "samples", "method, question_id", "kid")


class Run:
    """One evaluation run: hits of all strategies and the relevant documents, written once and read by every metric."""

    def __init__(self, wh, k=5):
        documents, questions = corpus(wh), asked(wh)
        chunks = retriever(wh)
        self.index = chunks.index
        self.hits = materialize(R.run(chunks, questions, k), "hits")
        self.relevant = materialize(E.contained(documents, questions), "relevant")
        golden = questions.select("question_id", F.col("text").alias("question"), F.col("text").alias("ground_truth"))
        self.samples = materialize(E.evaluation_set(golden, self.hits, METHODS), "samples")
        self.questions = questions

    @property
    def judged(self):
        return E.precision_recall(self.hits, self.relevant, self.questions, METHODS)

    @property
    def overlap(self):
        return E.text_overlap(self.samples, ["method", "question_id"], self.index)

    @property
    def means(self):
        ranked = E.method_means(self.judged, RANKED)
        return ranked.join(E.method_means(self.overlap, LEXICAL), "method")


def run(wh):
    return wh.kept("evaluation-run", ("documents", "benchmark"), lambda: Run(wh))


@query(
    "EVL1",
    sql(
        "SELECT method, question_id, question, coalesce(len(contexts), 0) AS contexts, answer, ground_truth FROM samples",
        "samples",
    ),
)
def evaluation_set(wh):
    return run(wh).samples.withColumn("contexts", F.size("contexts").cast("bigint"))


@query(
    "EVL2 EVL3",
    sql(
        "SELECT method, question_id, round(context_precision, 6) AS context_precision, round(context_recall, 6) AS context_recall FROM judged",
        "judged",
    ),
)
def precision_recall(wh):
    return run(wh).judged.select("method", "question_id", *[F.round(m, 6).alias(m) for m in RANKED])


@query(
    "EVL4 EVL5",
    sql("SELECT method, question_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in LEXICAL) + " FROM overlap", "overlap"),
)
def answer_overlap(wh):
    return run(wh).overlap.select("method", "question_id", *[F.round(m, 6).alias(m) for m in LEXICAL])


block(
    "turn_pairs",
    """
SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer, u.text AS ground_truth, u.text AS context
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'
""",
)
overlap_blocks("turn_overlap", "turn_pairs", "conv_id, turn")


@query(
    "EVL5",
    sql(
        "SELECT conv_id, turn, round(support_ratio, 6) AS support_ratio, round(question_overlap, 6) AS question_overlap, "
        "round(token_f1, 6) AS token_f1 FROM turn_overlap",
        "turn_overlap",
    ),
)
def answer_support(wh):
    """Every user turn as question and only context, the next turn as its answer."""
    turns = wh.table("conversations")
    asked_turns = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = asked_turns.join(answers, ["conv_id", "turn"]).select(
        "*", F.col("question").alias("ground_truth"), F.array("question").alias("contexts")
    )
    measured = E.text_overlap(pairs, ["conv_id", "turn"])
    return measured.select("conv_id", "turn", *[F.round(m, 6).alias(m) for m in LEXICAL[1:]])


block(
    "means",
    "SELECT * FROM (SELECT method, "
    + ", ".join(f"round(avg({m}), 4) AS {m}" for m in RANKED)
    + " FROM judged GROUP BY 1) JOIN (SELECT method, "
    + ", ".join(f"round(avg({m}), 4) AS {m}" for m in LEXICAL)
    + " FROM overlap GROUP BY 1) USING (method)",
    "judged",
    "overlap",
)
block("long_means", f"UNPIVOT means ON {', '.join(METRICS)} INTO NAME metric VALUE score", "means")


@query("EVL6 AGG20", sql("SELECT * FROM means", "means"))
def retrieval_eval(wh):
    return run(wh).means


@query(
    "AGG21",
    sql(
        "SELECT metric, method, score FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score DESC, method) AS rn FROM long_means) WHERE rn = 1",
        "long_means",
    ),
)
def best_method(wh):
    return E.best_per_metric(run(wh).means, METRICS)


@query(
    "AGG22",
    sql(f"SELECT method, round(({' + '.join(METRICS)}) / 6, 6) AS score FROM means ORDER BY 2 DESC, 1 LIMIT 1", "means"),
)
def best_overall(wh):
    return E.best_overall(run(wh).means, METRICS)


@query(
    "JN9",
    sql(
        """
SELECT l.method, metric, l.score, round((l.score - b.score) / nullif(b.score, 0) * 100, 4) AS improvement
FROM long_means l JOIN (SELECT * FROM long_means WHERE method = 'naive') b USING (metric)
""",
        "long_means",
    ),
)
def versus_naive(wh):
    return E.versus_baseline(run(wh).means, METRICS)


PRETTY = "array_to_string(list_transform(string_split(method, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(
    "PRJ10 SCR23",
    sql(
        f"""
SELECT {PRETTY} AS method, metric, round(score * 100, 1) AS percent,
  CASE WHEN metric IN ('support_ratio', 'context_precision') THEN
    CASE WHEN round(score * 100, 1) >= 85 THEN 'green' WHEN round(score * 100, 1) >= 70 THEN 'yellow' ELSE 'red' END
  ELSE CASE WHEN round(score * 100, 1) >= 75 THEN 'green' WHEN round(score * 100, 1) >= 60 THEN 'yellow' ELSE 'red' END END AS colour,
  CASE WHEN score >= 0.8 THEN 'green' WHEN score >= 0.6 THEN 'yellow' ELSE 'red' END AS plain_colour
FROM long_means
""",
        "long_means",
    ),
)
def metric_percentages(wh):
    means = run(wh).means
    percents = E.as_percentages(means, METRICS).unpivot("method", METRICS, "metric", "percent")
    plain = means.unpivot("method", METRICS, "metric", "score").select(
        E.prettify("method").alias("method"), "metric", E.plain_colour("score").alias("plain_colour")
    )
    return percents.withColumn("colour", E.colour("metric", "percent")).join(plain, ["method", "metric"])


@query(
    "SNK1 PRJ11",
    sql("SELECT method, method AS method_slug, count(*) AS questions, round(sum(context_recall), 4) AS recall FROM judged GROUP BY 1", "judged"),
)
def saved_results(wh):
    """Per-question results as one CSV folder per method, read back."""
    path = sinks.write_csv(run(wh).judged, fresh_path(wh.spark, "results"), by_method=True)
    schema = "method string, question_id bigint, context_precision double, context_recall double, method_slug string"
    return readers.read_csv(wh.spark, path, schema).groupBy("method", "method_slug").agg(
        F.count("*").alias("questions"), F.round(F.sum("context_recall"), 4).alias("recall")
    )


# Golden questions --------------------------------------------------------------------------------

block(
    "named",
    """
SELECT question_id, account_name FROM golden_questions JOIN churned ON contains(lower(question), lower(account_name))
""",
    "golden_questions",
    "churned",
)
block(
    "golden_truth",
    """
SELECT question_id, question, query_type, 'medium' AS difficulty,
  coalesce(nullif(concat_ws(chr(10), a.fact, s.fact, r.fact), ''), o.fact) AS ground_truth
FROM golden_questions g
LEFT JOIN (SELECT question_id, min(account_name) AS account_name FROM named GROUP BY 1) USING (question_id)
LEFT JOIN (
  SELECT account_name, 'Customer: ' || account_name || chr(10) || 'Segment: ' || segment || chr(10) || 'Churn Reason: ' || primary_reason
    || chr(10) || 'Sub Reason: ' || sub_reason || chr(10) || 'ARR Lost: $' || format('{:,}', arr::DECIMAL(28,0)::BIGINT) || chr(10)
    || 'Tenure: ' || round(tenure_years, 1)::DECIMAL(18,1) || ' years' || chr(10) || 'Products: '
    || replace(coalesce(products_rollup, 'N/A'), chr(10), ', ') || chr(10) || 'Competitor 1: ' || coalesce(competitor_1, 'N/A')
    || chr(10) || 'Competitor 2: ' || coalesce(competitor_2, 'N/A') || chr(10) || 'Details: '
    || CASE WHEN length(d) > 200 THEN substring(d, 1, 200) || '...' ELSE d END AS fact
  FROM (SELECT *, coalesce(details, 'No details provided') AS d FROM churn_table)) a USING (account_name)
LEFT JOIN (SELECT question_id, min(segment) AS segment FROM golden_questions JOIN (SELECT DISTINCT segment FROM churned)
           ON contains(lower(question), lower(segment)) GROUP BY 1) USING (question_id)
LEFT JOIN (SELECT segment, segment || ' Segment Summary:' || chr(10) || '- Total customers: ' || count(*) || chr(10) || '- Top churn reasons: '
             || max(top_reasons) || chr(10) || '- Average tenure: ' || round(avg(tenure_years), 1)::DECIMAL(18,1) || ' years' || chr(10)
             || '- Total ARR lost: $' || format('{:,}', sum(arr)::DECIMAL(28,0)::BIGINT) AS fact
           FROM churned JOIN seg_reasons3 USING (segment) GROUP BY segment) s USING (segment)
LEFT JOIN (SELECT question_id, min(primary_reason) AS primary_reason FROM golden_questions JOIN (SELECT DISTINCT primary_reason FROM churned)
           ON contains(lower(question), lower(primary_reason)) GROUP BY 1) USING (question_id)
LEFT JOIN (SELECT primary_reason, primary_reason || ' Churn Reason Summary:' || chr(10) || '- Total customers: ' || count(*) || chr(10)
             || '- Segments affected: ' || max(segments_affected) || chr(10) || '- Average ARR: $'
             || format('{:,}', avg(arr::DOUBLE)::DECIMAL(28,2)::DECIMAL(28,0)::BIGINT) AS fact
           FROM churned JOIN reason_segments USING (primary_reason) GROUP BY 1) r USING (primary_reason),
(SELECT 'Overall Churn Summary:' || chr(10) || '- Total customers: ' || count(*) || chr(10) || '- Segments: '
   || (SELECT string_agg(segment || '=' || cnt, '; ' ORDER BY cnt DESC, segment) FROM
        (SELECT segment, count(*) AS cnt FROM churned WHERE segment IS NOT NULL GROUP BY 1)) || chr(10) || '- Top 3 churn reasons: '
   || (SELECT string_agg(primary_reason || '=' || cnt, '; ' ORDER BY cnt DESC, primary_reason) FROM
        (SELECT primary_reason, count(*) AS cnt FROM churned GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)) || chr(10)
   || '- Average tenure: ' || round(avg(tenure_years), 1)::DECIMAL(18,1) || ' years' || chr(10) || '- Total ARR lost: $'
   || format('{:,}', sum(arr)::DECIMAL(28,0)::BIGINT) AS fact FROM churned) o
""",
    "golden_questions",
    "named",
    "churn_table",
    "churned",
    "seg_reasons3",
    "reason_segments",
)
block(
    "named_anywhere",
    """
SELECT question_id, account_name FROM named
UNION SELECT question_id, account_name FROM golden_truth JOIN (SELECT DISTINCT account_name FROM churned) ON contains(ground_truth, account_name)
""",
    "named",
    "golden_truth",
    "churned",
)
block(
    "golden_set",
    """
SELECT g.*, coalesce(listed, CASE query_type WHEN 'pattern_analysis' THEN 'multiple_customers,aggregate_data'
      WHEN 'competitive_intelligence' THEN 'competitor_data,switching_patterns'
      WHEN 'financial_analysis' THEN 'financial_data,arr_analysis'
      WHEN 'segment_analysis' THEN 'segment_data,comparative_analysis' ELSE '' END) AS expected_context
FROM golden_truth g LEFT JOIN (
  SELECT question_id, string_agg(account_name, ',' ORDER BY account_name) AS listed FROM
    (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY account_name) AS rn FROM named_anywhere) WHERE rn <= 5 GROUP BY 1) USING (question_id)
""",
    "golden_truth",
    "named_anywhere",
)


def golden_set_of(wh):
    # Facts, mentions and sources all read the account table, so it is written once.
    table = materialize(T.churn_table(wh), "accounts")
    rivals = table.select(F.explode(F.array("competitor_1", "competitor_2")).alias("competitor"))
    return golden.golden_set(golden.questions(table, rivals), table)


@query("EVL7 JN4 JN5", sql("SELECT * FROM golden_set", "golden_set"))
def golden_set(wh):
    return golden_set_of(wh)


@query(
    "AGG23",
    sql(
        """
SELECT query_type, count(*) AS questions, round(avg(length(ground_truth)), 4) AS avg_length,
       min(length(ground_truth)) AS min_length, max(length(ground_truth)) AS max_length,
       count(*) FILTER (len(string_split(expected_context, ',')) = 1) AS one_source,
       count(*) FILTER (len(string_split(expected_context, ',')) >= 2) AS several_sources
FROM golden_set GROUP BY 1
""",
        "golden_set",
    ),
)
def golden_profile(wh):
    return golden.profile(golden_set_of(wh))


@query("JN4", sql("SELECT question_id, account_name FROM named", "named"))
def account_mentions(wh):
    return Q.mentions(golden_questions(wh), wh.churned, "question_id", "question", "account_name")


@query(
    "JN5",
    sql("SELECT question_id, expected_context FROM golden_set", "golden_set"),
)
def expected_sources(wh):
    return golden_set_of(wh).select("question_id", "expected_context")
