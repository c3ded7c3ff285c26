"""Check SQL of TF-IDF, retrieval strategies and metrics."""

from __future__ import annotations

from churnspark.plans import corpus
from churnspark.plans.registry import BLOCKS, block

SPLIT = r"'[^\p{L}\p{N}]+'"


def toks(x):
    return f"list_filter(regexp_split_to_array(lower({x}), {SPLIT}), lambda w: w <> '')"


def index_blocks(p, source, keys, text="text"):
    """{p}_tf, {p}_n, {p}_df, {p}_post for a corpus block or table."""
    needs = (source,) if source in BLOCKS else ()
    block(f"{p}_tf", f"SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest({toks(text)}) AS term FROM {source}) GROUP BY ALL", *needs)
    block(f"{p}_n", f"SELECT count(*) AS n FROM {source}", *needs)
    block(f"{p}_df", f"SELECT term, count(*) AS df, ln((n + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM {p}_tf, {p}_n GROUP BY term, n", f"{p}_tf", f"{p}_n")
    block(
        f"{p}_post",
        f"""
SELECT {keys}, term, tf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY {keys})) AS weight,
       sum(tf) OVER (PARTITION BY {keys}) AS length FROM {p}_tf JOIN {p}_df USING (term)
""",
        f"{p}_tf",
        f"{p}_df",
    )


def score_blocks(name, p, keys, questions, ids, where=""):
    """{name}: (ids, keys, score, bm25) of question block ``questions`` (ids, text) against corpus ``p``."""
    block(f"{name}_qtf", f"SELECT {ids}, term, count(*) AS tf FROM (SELECT {ids}, unnest({toks('text')}) AS term FROM {questions}) GROUP BY ALL", questions)
    block(
        f"{name}_qw",
        f"""
SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {ids})) AS q_weight,
       ln(1 + (n - cnt + 0.5::DOUBLE) / (cnt + 0.5::DOUBLE)) AS bm25_idf FROM (
  SELECT {ids}, term, df, n, coalesce(df, 0) AS cnt, tf * (ln((n + 1) / (coalesce(df, 0) + 1)::DOUBLE) + 1) AS raw
  FROM {name}_qtf LEFT JOIN {p}_df USING (term), {p}_n)
""",
        f"{name}_qtf",
        f"{p}_df",
        f"{p}_n",
    )
    block(
        name,
        f"""
SELECT {ids}, {keys}, sum(weight * q_weight) AS score,
       sum(bm25_idf * d.tf * 2.2::DOUBLE / (d.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / (SELECT sum(tf) / max(n)::DOUBLE FROM {p}_tf, {p}_n)))) AS bm25
FROM {p}_post d JOIN {name}_qw USING (term) {where} GROUP BY ALL
""",
        f"{p}_post",
        f"{name}_qw",
    )


CHILD = "doc_id, parent_no, child_no"


def chunk_index(p, source):
    """{p}parents, {p}children and index blocks {p}kid of a block (doc_id, text)."""
    corpus.tier_blocks(f"{p}parents", f"{p}children", source)
    index_blocks(f"{p}kid", f"{p}children", CHILD)


def strategy_blocks(p, questions, k, index="kid", children="children", variants=None):
    """{p}naive_hits, {p}multi_hits, {p}rerank_hits, {p}compressed_hits of question block ``questions`` at depth ``k``."""
    if variants is None:
        variants = f"{p}variants"
        block(variants, variants_sql(questions, index), questions, f"{index}_df")
    score_blocks(f"{p}kid_scored", index, CHILD, variants, "question_id, variant")
    block(
        f"{p}ranked",
        f"SELECT *, row_number() OVER (PARTITION BY question_id, variant ORDER BY round(score, 9) DESC, {CHILD}) AS rank FROM {p}kid_scored",
        f"{p}kid_scored",
    )
    block(
        f"{p}naive_hits",
        f"SELECT question_id, 'naive' AS method, rank, {CHILD}, score, text FROM {p}ranked JOIN {children} USING ({CHILD}) WHERE variant = 0 AND rank <= {k}",
        f"{p}ranked",
        children,
    )
    block(
        f"{p}multi_hits",
        f"""
SELECT question_id, 'multi_query' AS method, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, {CHILD}) AS rank,
       {CHILD}, score, text
FROM (SELECT question_id, {CHILD}, max(score) AS score FROM {p}ranked WHERE rank <= {k} GROUP BY ALL) JOIN {children} USING ({CHILD})
""",
        f"{p}ranked",
        children,
    )
    block(
        f"{p}rerank_hits",
        f"""
SELECT question_id, 'reranking' AS method, place AS rank, {CHILD}, bm25 AS score, text FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(bm25, 9) DESC, round(score, 9) DESC, {CHILD}) AS place
  FROM {p}ranked WHERE variant = 0 AND rank <= {3 * k}) JOIN {children} USING ({CHILD}) WHERE place <= {k}
""",
        f"{p}ranked",
        children,
    )
    block(f"{p}compressed_hits", compressed_sql(f"{p}naive_hits", questions), f"{p}naive_hits", questions)


def compressed_sql(hits, questions):
    return f"""
SELECT question_id, 'contextual_compression' AS method, rank, {CHILD}, score, text FROM (
  SELECT h.* EXCLUDE (text), array_to_string(list_filter(
      string_split(regexp_replace(h.text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
      lambda s: len(list_intersect(list_distinct({toks('s')}), list_distinct({toks('q.text')})))::DOUBLE
                / len(list_distinct({toks('q.text')})) >= 0.2), ' ') AS text
  FROM {hits} h JOIN {questions} q USING (question_id)) WHERE text <> ''
"""


def variants_sql(questions, index):
    return f"""
SELECT question_id, 0 AS variant, text FROM {questions}
UNION ALL
SELECT question_id, 1, string_agg(term, ' ') FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(idf, 9) DESC, term) AS rn
  FROM (SELECT DISTINCT question_id, unnest({toks('text')}) AS term FROM {questions}) JOIN {index}_df USING (term)) WHERE rn <= 5 GROUP BY 1
UNION ALL
SELECT question_id, 1 + row_number() OVER (PARTITION BY question_id ORDER BY pos), part FROM (
  SELECT question_id, unnest(parts) AS part, unnest(range(len(parts))) AS pos
  FROM (SELECT question_id, regexp_split_to_array(text, '[,;?.]| and ') AS parts FROM {questions}))
WHERE len({toks('part')}) >= 3
"""


block("asked", "SELECT item_id AS question_id, text FROM benchmark")
index_blocks("doc", "documents", "doc_id")
score_blocks("doc_scored", "doc", "doc_id", "asked", "question_id")

index_blocks("kid", "children", CHILD)
block("asked0", "SELECT question_id, 0 AS variant, text FROM asked", "asked")
block("variants", variants_sql("asked", "kid"), "asked", "kid_df")
score_blocks("kid_scored", "kid", CHILD, "variants", "question_id, variant")
block(
    "ranked",
    f"""
SELECT *, row_number() OVER (PARTITION BY question_id, variant ORDER BY round(score, 9) DESC, {CHILD}) AS rank FROM kid_scored
""",
    "kid_scored",
)
block(
    "naive_hits",
    "SELECT question_id, 'naive' AS method, rank, doc_id, parent_no, child_no, score, text FROM ranked "
    f"JOIN children USING ({CHILD}) WHERE variant = 0 AND rank <= 5",
    "ranked",
    "children",
)
block(
    "multi_hits",
    f"""
SELECT question_id, 'multi_query' AS method, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, {CHILD}) AS rank,
       {CHILD}, score, text
FROM (SELECT question_id, {CHILD}, max(score) AS score FROM ranked WHERE rank <= 5 GROUP BY ALL) JOIN children USING ({CHILD})
""",
    "ranked",
    "children",
)
block(
    "parent_hits",
    """
SELECT question_id, 'parent_document' AS method, rank, doc_id, parent_no, NULL::BIGINT AS child_no, score, text FROM (
  SELECT question_id, doc_id, parent_no, max(score) AS score,
         row_number() OVER (PARTITION BY question_id ORDER BY round(max(score), 9) DESC, doc_id, parent_no) AS rank
  FROM kid_scored WHERE variant = 0 GROUP BY 1, 2, 3) JOIN parents USING (doc_id, parent_no) WHERE rank <= 5
""",
    "kid_scored",
    "parents",
)
block(
    "rerank_hits",
    f"""
SELECT question_id, 'reranking' AS method, place AS rank, {CHILD}, bm25 AS score, text FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(bm25, 9) DESC, round(score, 9) DESC, {CHILD}) AS place
  FROM ranked WHERE variant = 0 AND rank <= 15) JOIN children USING ({CHILD}) WHERE place <= 5
""",
    "ranked",
    "children",
)
block("compressed_hits", compressed_sql("naive_hits", "asked"), "naive_hits", "asked")
block(
    "hits",
    " UNION ALL ".join(
        f"SELECT question_id, method, rank, doc_id, parent_no, child_no, score, text FROM {h}"
        for h in ("naive_hits", "multi_hits", "parent_hits", "rerank_hits", "compressed_hits")
    ),
    "naive_hits",
    "multi_hits",
    "parent_hits",
    "rerank_hits",
    "compressed_hits",
)
block("relevant", "SELECT doc_id, item_id AS question_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
block(
    "methods",
    "SELECT unnest(['naive', 'multi_query', 'contextual_compression', 'parent_document', 'reranking']) AS method",
)
block(
    "judged",
    """
SELECT method, question_id, coalesce(p, 0) AS context_precision, coalesce(found, 0) / total::DOUBLE AS context_recall
FROM (SELECT question_id, count(*) AS total FROM relevant GROUP BY 1) CROSS JOIN methods
LEFT JOIN (
  SELECT method, question_id, sum(r * so_far / rank::DOUBLE) / nullif(sum(r), 0) AS p,
         count(DISTINCT CASE WHEN r = 1 THEN doc_id END) AS found
  FROM (SELECT *, sum(r) OVER (PARTITION BY method, question_id ORDER BY rank) AS so_far FROM (
          SELECT hits.*, (relevant.doc_id IS NOT NULL)::INT AS r FROM hits LEFT JOIN relevant USING (question_id, doc_id)))
  GROUP BY 1, 2) USING (method, question_id)
""",
    "relevant",
    "methods",
    "hits",
)
