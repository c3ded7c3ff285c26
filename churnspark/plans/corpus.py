"""Document, source, sink and chunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnspark.functions import columns as C
from churnspark.operators import chunking, documents as D, graph as G, scoring as S
from churnspark.plans import profile, scoring_blocks  # noqa: F401 - blocks
from churnspark.plans.registry import block, query, sql
from churnspark.plans.scoring import scored
from churnspark.session import fresh_path
from churnspark.sources import corpora, readers, sinks, tables as T

block(
    "profiles",
    """
SELECT account_id AS doc_id, concat_ws(chr(10), 'Customer Churn Profile' || chr(10) || '======================',
  'Company: ' || account_name, 'Segment: ' || segment, 'Churn Date: ' || close_date,
  'Lost ARR: $' || format('{:,}', trunc(arr)::BIGINT) || '.' || right('0' || ((arr * 100)::BIGINT % 100), 2),
  'Customer Tenure: ' || tenure_years || ' years', 'First Win Date: ' || first_win_date,
  chr(10) || 'Churn Analysis' || chr(10) || '--------------', 'Primary Reason: ' || primary_reason,
  'Sub Reason: ' || sub_reason, chr(10) || 'Competitive Intelligence' || chr(10) || '------------------------',
  'Competitor 1: ' || coalesce(competitor_1, 'None mentioned'), 'Competitor 2: ' || coalesce(competitor_2, 'None mentioned'),
  chr(10) || 'Products Used' || chr(10) || '-------------', coalesce(products_rollup, 'N/A'),
  chr(10) || 'Detailed Churn Story' || chr(10) || '-------------------', coalesce(details, 'No details provided')) AS content,
  account_name, segment, primary_reason AS churn_reason, arr::DOUBLE AS arr_lost
FROM churn_table
""",
    "churn_table",
)


@query(
    "PRJ2 PRJ4 PRJ5",
    sql(
        """
SELECT account_id AS doc_id, content, account_name, p.segment, churn_reason, t.sub_reason AS churn_sub_reason,
       t.close_date::VARCHAR AS churn_date, t.tenure_years, arr_lost, coalesce(t.competitor_1, 'None mentioned') AS competitor_1,
       coalesce(t.competitor_2, 'None mentioned') AS competitor_2, t.first_win_date::VARCHAR AS first_win_date,
       'churned_accounts' AS source, account_id AS record_id
FROM profiles p JOIN churn_table t USING (account_name) WHERE t.account_id = p.doc_id
""",
        "profiles",
        "churn_table",
    ),
)
def account_documents(wh):
    """Content and all twelve metadata fields."""
    return D.account_documents(T.churn_table(wh)).select("doc_id", "content", "metadata.*")


block(
    "tickets",
    f"""
SELECT 'TICKET-' || event_id AS ticket_id, account_name AS company_name, segment,
       {list(S.FEATURE_NAMES)}[feature + 1] AS category,
       CASE WHEN ceil(value) > 24 THEN 'High' WHEN ceil(value) > 8 THEN 'Medium' ELSE 'Low' END AS severity,
       ceil(value)::INT AS resolution_hours, event_id % 5 + 1 AS csat_score
FROM ev JOIN accounts USING (account_id) WHERE event_type = 'error'
""",
    "ev",
    "accounts",
)


block(
    "ticket_docs",
    """
SELECT 'support_ticket-' || ticket_id AS doc_id, company_name, segment,
  'Support Ticket: ' || ticket_id || chr(10) || 'Company: ' || company_name || ' (' || segment || ')' || chr(10)
  || 'Category: ' || category || ' - error' || chr(10) || 'Severity: ' || severity || chr(10) || chr(10)
  || 'Description:' || chr(10) || 'Problem with ' || category || chr(10) || chr(10) || 'Resolution:' || chr(10)
  || 'Fixed in ' || category || chr(10) || chr(10) || 'Resolution Time: ' || resolution_hours || ' hours' || chr(10)
  || 'CSAT Score: ' || csat_score || '/5' AS content,
  ticket_id, category, severity, resolution_hours, csat_score
FROM tickets
""",
    "tickets",
)


@query("PRJ6", sql("SELECT * FROM ticket_docs", "ticket_docs"))
def ticket_documents(wh):
    """Content and metadata of every ticket."""
    fields = "ticket_id string, category string, severity string, resolution_hours int, csat_score int"
    read = D.ticket_documents(corpora.tickets(wh)).withColumn("m", F.from_json("metadata", fields))
    return read.select("doc_id", "company_name", "segment", "content", "m.*")


block(
    "stories",
    """
SELECT 'STORY-' || account_id AS story_id, account_name AS company_name, segment, adoption_before, adoption_after
FROM active JOIN (
  SELECT account_id,
    floor(count(DISTINCT feature) FILTER (ts < middle) * 100 / 8.0)::INT AS adoption_before,
    floor(count(DISTINCT feature) FILTER (ts >= middle) * 100 / 8.0)::INT AS adoption_after
  FROM ev, (SELECT make_timestamp(((epoch(date_trunc('second', min(ts))) + epoch(date_trunc('second', max(ts)))) / 2 * 1000000)::BIGINT) AS middle
            FROM ev) GROUP BY 1) USING (account_id)
""",
    "active",
    "ev",
)


@query(
    "PRJ7",
    sql(
        """
SELECT 'success_story-' || story_id AS doc_id, company_name, segment,
       company_name || ' went from ' || adoption_before || '% to ' || adoption_after || '% feature adoption.' AS content,
       (adoption_after - adoption_before)::DOUBLE AS adoption_improvement FROM stories
""",
        "stories",
    ),
)
def story_documents(wh):
    improvement = F.get_json_object("metadata", "$.adoption_improvement").cast("double")
    return D.story_documents(corpora.stories(wh)).select(
        "doc_id", "company_name", "segment", "content", improvement.alias("adoption_improvement")
    )


block(
    "histories",
    """
SELECT account_name AS company_name, 'Customer Interaction History: ' || account_name || chr(10) || 'Segment: ' || any_value(segment)
  || chr(10) || 'Tenure: ' || floor(any_value(tenure_years) * 12)::INT || ' months' || chr(10) || chr(10)
  || 'Recent Interactions (' || count(*) || ' total):' || chr(10)
  || string_agg('[' || turn || '] ' || role || ': ' || text, chr(10) ORDER BY turn DESC, role, text)
       FILTER (rn <= 10) AS content
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS rn FROM conversations)
JOIN accounts ON account_id = conv_id GROUP BY 1
""",
    "accounts",
)


@query(
    "AGG16 WIN2",
    sql("SELECT 'interaction_history-' || company_name AS doc_id, company_name, content FROM histories", "histories"),
)
def interaction_history(wh):
    return D.interaction_documents(corpora.interactions(wh)).select("doc_id", "company_name", "content")


def all_documents(wh):
    analyses = D.account_documents(T.churn_table(wh)).select(
        F.concat(F.lit("churn_analysis-"), F.col("doc_id")).alias("doc_id"),
        F.lit("churn_analysis").alias("source_type"),
        F.col("metadata.account_name").alias("company_name"),
        F.col("metadata.segment").alias("segment"),
        "content",
    )
    return D.union_documents(
        analyses,
        D.story_documents(corpora.stories(wh)),
        D.ticket_documents(corpora.tickets(wh)),
        D.interaction_documents(corpora.interactions(wh)),
    )


@query(
    "SET1 PRJ19",
    sql(
        """
SELECT 'churn_analysis' AS source_type, '📊 Similar Churn Case' AS label, count(*) AS documents, sum(length(content))::BIGINT AS chars FROM profiles
UNION ALL SELECT 'success_story', '✅ Success Story', count(*),
  sum(length(company_name || ' went from ' || adoption_before || '% to ' || adoption_after || '% feature adoption.')) FROM stories
UNION ALL SELECT 'support_ticket', '🎫 Support Ticket', count(*), sum(length(content)) FROM ticket_docs
UNION ALL SELECT 'interaction_history', '💬 Customer Interaction', count(*), sum(length(content)) FROM histories
""",
        "profiles",
        "stories",
        "ticket_docs",
        "histories",
    ),
)
def corpus_by_source(wh):
    chars = F.length("content")
    return all_documents(wh).groupBy("source_type", D.source_label("source_type").alias("label")).agg(
        F.count("*").alias("documents"), F.sum(chars).alias("chars")
    )


# Sources and sinks -----------------------------------------------------------------------------


@query(
    "SRC1 SNK1 PRJ1 PRJ3",
    sql(
        """
SELECT account_name, segment, close_date, first_win_date, arr::DOUBLE AS arr, tenure_years, primary_reason, sub_reason,
       products_rollup, competitor_1, competitor_2, nullif(details, '') AS details FROM churn_table
""",
        "churn_table",
    ),
)
def account_export_round_trip(wh):
    path = sinks.write_csv(corpora.account_export(wh))
    back = readers.read_account_export(wh.spark, path).drop("opportunity_name", "deal_type")
    return back.withColumn("arr", F.col("arr").cast("double"))


@query(
    "SRC2",
    "SELECT 'ANALYSIS-' || lpad(c_custkey::VARCHAR, 8, '0') AS name, c_name || chr(10) || c_mktsegment || chr(10) AS content, "
    "'churn_analysis' AS source_type, 'churn_analyses' AS collection FROM customer",
)
def text_folder_documents(wh):
    """One text file per customer, read back as one document per file with its name."""
    path = fresh_path(wh.spark, "texts")
    name = F.concat(F.lit("ANALYSIS-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    text = F.concat_ws("\n", "c_name", "c_mktsegment")
    sinks.write_text_folder(wh.table("customer").select(name.alias("name"), text.alias("value")), path)
    files = readers.read_text_folder(wh.spark, path, "churn_analysis", "churn_analyses")
    return files.select(F.regexp_extract("file_path", "name=([^/]+)/", 1).alias("name"), "content", "source_type", "collection")


@query(
    "SRC3",
    sql(
        """
SELECT 'tickets' AS corpus, count(*) AS rows, count(DISTINCT company_name) AS companies, sum(resolution_hours)::BIGINT AS total FROM tickets
UNION ALL SELECT 'stories', count(*), count(DISTINCT company_name), sum(adoption_after)::BIGINT FROM stories
UNION ALL SELECT 'interactions', count(*), count(DISTINCT account_name), sum(length(text))::BIGINT
          FROM conversations JOIN accounts ON account_id = conv_id
""",
        "tickets",
        "stories",
        "accounts",
    ),
)
def corpora_from_csv(wh):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("at").cast("int"))
    rows = corpora.interactions(wh).select(
        "company_name", "segment", day.alias("interaction_date"), F.col("kind").alias("interaction_type"), "content",
        F.col("tenure_months").alias("customer_tenure_months"),
    )

    def round_trip(df, schema, name, total):
        path = fresh_path(wh.spark, name)
        df.write.options(**sinks.CSV_OPTIONS, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
        return readers.read_csv(wh.spark, path, schema).agg(
            F.lit(name).alias("corpus"),
            F.count("*").alias("rows"),
            F.countDistinct("company_name").alias("companies"),
            F.sum(total).cast("bigint").alias("total"),
        )

    return (
        round_trip(corpora.tickets(wh), readers.TICKETS, "tickets", "resolution_hours")
        .unionByName(round_trip(corpora.stories(wh), readers.STORIES, "stories", "adoption_after"))
        .unionByName(round_trip(rows, readers.INTERACTIONS, "interactions", F.length("content")))
    )


@query(
    "SRC4",
    sql(
        "SELECT (SELECT count(*) FROM accounts) AS total_companies, unnest(list_sort(list_distinct(list(segment)))) AS segment FROM accounts",
        "accounts",
    ),
)
def metadata_from_json(wh):
    """Statistics of the accounts written as a metadata file and read back."""
    path = fresh_path(wh.spark, "metadata")
    statistics = wh.accounts.agg(
        F.count("*").alias("total_companies"),
        F.array_sort(F.collect_set("segment")).alias("segments"),
        F.array_sort(F.collect_set("primary_reason")).alias("churn_categories"),
    )
    statistics.select(F.struct("*").alias("statistics")).write.json(path)
    read = readers.read_metadata(wh.spark, path)
    return read.select("statistics.total_companies", F.explode("statistics.segments").alias("segment"))


@query(
    "SRC5",
    sql("SELECT 'success_story' AS source_type, count(*) AS documents FROM stories", "stories"),
)
def missing_corpus_skipped(wh):
    """A corpus without files adds nothing; the others go on."""
    missing = fresh_path(wh.spark, "absent")
    found = readers.optional(wh.spark, lambda: readers.read_csv(wh.spark, missing, readers.TICKETS), readers.TICKETS)
    both = D.union_documents(D.story_documents(corpora.stories(wh)), D.ticket_documents(found))
    return both.groupBy("source_type").agg(F.count("*").alias("documents"))


@query(
    "SNK2",
    sql(
        """
SELECT account_name AS "Name", segment AS "Segment", arr::DOUBLE AS "ARR", risk_score AS "Risk Score",
       days_until_churn AS "Days Until Churn", risk_reason AS "Risk Reason", trend AS "Trend"
FROM scores WHERE risk_score >= 40
""",
        "scores",
    ),
)
def at_risk_export(wh):
    path = sinks.export_at_risk(S.at_risk(scored(wh), 40.0, None))
    schema = "`Name` string, `Segment` string, `ARR` double, `Risk Score` double, `Days Until Churn` bigint, `Risk Reason` string, `Trend` string"
    return readers.read_csv(wh.spark, path, schema)


@query("SNK3", "SELECT 'first' AS collection, count(*) AS points FROM embeddings WHERE label < 5 UNION ALL SELECT 'second', count(*) FROM embeddings")
def replaced_collection(wh):
    """Two collections are written, then the first is replaced; the second stays."""
    points = wh.table("embeddings")
    path = sinks.replace_collection(points, "first")
    sinks.replace_collection(points, "second", path)
    sinks.replace_collection(points.filter("label < 5"), "first", path)
    return wh.spark.read.parquet(path).groupBy("collection").agg(F.count("*").alias("points"))


@query(
    "SNK4",
    """
SELECT event_id % 10 AS point_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS version
FROM events GROUP BY 1
""",
)
def upserted_points(wh):
    """Every event is a new version of one of ten points, the hottest possible keys; every other ten events
    change a table that holds the rest."""
    versions = wh.events.select(
        (F.col("event_id") % 10).alias("point_id"), "event_type", F.col("event_id").alias("version")
    )
    held = (F.floor(F.col("version") / 10) % 2) == 0
    current = versions.filter(held).groupBy("point_id").agg(F.max_by("event_type", "version").alias("event_type"), F.max("version").alias("version"))
    return sinks.upsert(current, versions.filter(~held), "point_id", "version")


@query(
    "SNK4",
    """
SELECT point_id, arg_max(event_type, version) AS event_type, max(version) AS version
FROM (SELECT event_id % 5000 AS point_id, event_type, event_id AS version FROM events) WHERE version % 2 = 0 OR point_id % 50 = 7 GROUP BY 1
""",
)
def stored_points_upserted(wh):
    """A stored collection takes newer versions of some of its points; only the buckets they fall into are rewritten."""
    versions = wh.events.select((F.col("event_id") % 5000).alias("point_id"), "event_type", F.col("event_id").alias("version"))
    newest = lambda df: df.groupBy("point_id").agg(F.max_by("event_type", "version").alias("event_type"), F.max("version").alias("version"))
    path = sinks.store_points(newest(versions.where("version % 2 = 0")), "point_id")
    sinks.upsert_stored(path, newest(versions.where("point_id % 50 = 7")), "point_id", "version")
    return sinks.read_points(wh.spark, path)


@query(
    "SRC1 SRC3",
    sql(
        """
SELECT 'accepted' AS reason, count(*) AS rows, sum(resolution_hours)::BIGINT AS hours FROM tickets
UNION ALL SELECT 'resolution_hours is not int', count(*), NULL FROM tickets WHERE resolution_hours % 7 = 0 HAVING count(*) > 0
UNION ALL SELECT 'too few fields', count(*), NULL FROM tickets WHERE resolution_hours % 7 = 1 HAVING count(*) > 0
UNION ALL SELECT 'too many fields', count(*), NULL FROM tickets WHERE resolution_hours % 7 = 2 HAVING count(*) > 0
""",
        "tickets",
    ),
)
def rejected_csv_rows(wh):
    """Tickets as CSV with broken rows among them: these land in the reject table with their reason."""
    tickets = corpora.tickets(wh)
    names = tickets.columns
    hours = F.col("resolution_hours")
    line = F.to_csv(F.struct(*names), {"quote": '"', "escape": '"'})
    broken = [F.col(n) if n != "resolution_hours" else F.lit("soon").alias(n) for n in names]
    texts = (
        tickets.select(line.alias("value"))
        .union(tickets.where(hours % 7 == 0).select(F.to_csv(F.struct(*broken))))
        .union(tickets.where(hours % 7 == 1).select(F.concat_ws(",", "ticket_id", "company_name")))
        .union(tickets.where(hours % 7 == 2).select(F.concat(line, F.lit(",one,more"))))
    )
    path = fresh_path(wh.spark, "tickets")
    texts.write.text(path)
    good, bad = readers.read_csv_checked(wh.spark, path, readers.TICKETS, header=False)
    rejects = wh.spark.read.parquet(sinks.append_rejects(bad))
    counted = rejects.groupBy("reason").agg(F.count("*").alias("rows"), F.lit(None).cast("bigint").alias("hours"))
    accepted = good.agg(F.lit("accepted").alias("reason"), F.count("*").alias("rows"), F.sum("resolution_hours").cast("bigint").alias("hours"))
    return accepted.unionByName(counted)


@query("SNK6", "SELECT count(DISTINCT vec_id) AS documents, count(*) AS points, max(len(embedding)) AS vector_size FROM embeddings")
def collection_statistics(wh):
    return sinks.collection_stats(wh.table("embeddings"), "embedding", "vec_id")


# Cleaning and scalar work ----------------------------------------------------------------------


@query("PRJ1 PRJ20", sql("SELECT account_id, arr::DOUBLE AS arr FROM accounts", "accounts"))
def money_parsed(wh):
    return wh.accounts.select("account_id", C.parse_money(C.money2("arr")).cast("double").alias("arr"))


@query(
    "PRJ9 PRJ16",
    """
SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS excerpt,
       len(regexp_extract_all(text, '\\S+')) AS words,
       floor(len(regexp_extract_all(text, '\\S+')) * 1.3::DOUBLE)::BIGINT AS token_estimate, length(text) AS chars
FROM documents
""",
)
def document_excerpts(wh):
    return wh.table("documents").select(
        "doc_id",
        C.truncate("text", 200).alias("excerpt"),
        C.word_count("text").alias("words"),
        C.token_estimate("text").alias("token_estimate"),
        F.length("text").cast("bigint").alias("chars"),
    )


@query("PRJ17", "SELECT event_id, strftime(ts::DATE - 90, '%Y-%m-%d') AS day_before, strftime(ts::DATE + 14, '%Y-%m-%d') AS day_after FROM events")
def event_days(wh):
    return wh.events.select(
        "event_id", C.days_from("ts", -90).alias("day_before"), C.days_from("ts", 14).alias("day_after")
    )


@query(
    "PRJ11",
    sql("SELECT account_id, lower(regexp_replace(sub_reason || ' ' || primary_reason, '[ -]', '_', 'g')) AS slug FROM accounts", "accounts"),
)
def reason_slugs(wh):
    return wh.accounts.select("account_id", C.slug(F.concat_ws(" ", "sub_reason", "primary_reason")).alias("slug"))


@query(
    "PRJ14",
    sql(
        """
SELECT account_id, product AS item, row_number() OVER (PARTITION BY account_id ORDER BY product) AS position
FROM products
""",
        "products",
    ),
)
def numbered_list_items(wh):
    """Products as a numbered text, read back as items."""
    numbered = F.transform(
        F.split("products_rollup", "\n"),
        lambda x, i: F.when(i % 2 == 0, F.concat((i + 1).cast("string"), F.lit(". "), x)).otherwise(F.concat(F.lit("- "), x)),
    )
    listed = T.product_rollup(wh).select("account_id", F.array_join(numbered, "\n").alias("text"))
    return listed.select("account_id", F.posexplode(C.list_items("text")).alias("at", "item")).select(
        "account_id", "item", (F.col("at") + 1).cast("bigint").alias("position")
    )


@query(
    "PRJ14",
    """
SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM (
  SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY 1
""",
)
def document_lines(wh):
    """Lines are counted inside the row: no explode, no shuffle."""
    lines = wh.table("documents").select("doc_id", C.text_lines("text").alias("lines")).filter("size(lines) > 0")
    chars = F.aggregate("lines", F.lit(0).cast("bigint"), lambda total, x: total + F.length(x))
    return lines.select("doc_id", F.size("lines").cast("bigint").alias("lines"), chars.alias("chars"))


@query(
    "PRJ13",
    """
SELECT event_id,
  CASE WHEN event_id % 3 = 2 OR event_type = 'error' THEN 'pattern_analysis' ELSE event_type END AS query_type,
  CASE WHEN event_id % 3 <> 2 THEN user_id END AS customer_id,
  CASE WHEN event_id % 3 = 2 THEN 'Query classification error' END AS error,
  CAST(json_extract_string(props, '$.k') AS INT) AS k
FROM events
""",
)
def parsed_answers(wh):
    """Answers in three shapes: fenced JSON, bare JSON, and text that is no JSON."""
    from churnspark.operators.questions import parse_classification

    events = wh.table("events")
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    body = F.to_json(F.struct(kind.alias("query_type"), F.col("user_id").cast("string").alias("customer_id")))
    raw = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\n")))
        .when(F.col("event_id") % 3 == 1, body)
        .otherwise(F.concat(F.lit("It is "), "event_type"))
    )
    parsed = parse_classification(
        events.select("event_id", raw.alias("raw"), F.get_json_object("props", "$.k").cast("int").alias("k")), "raw"
    )
    return parsed.select("event_id", "query_type", F.col("customer_id").cast("bigint").alias("customer_id"), "error", "k")


# Chunks ----------------------------------------------------------------------------------------


def fixed_sql(source, keys, text, size, overlap, no):
    stride = size - overlap
    return f"""
SELECT {keys}, i AS {no}, i * {stride} AS start, substring({text}, (i * {stride} + 1)::BIGINT, {size}) AS text
FROM (SELECT *, unnest(range(CASE WHEN length({text}) = 0 THEN 0
        ELSE greatest(1, ceil((length({text}) - {overlap}) / {stride}.0)) END::BIGINT)) AS i FROM {source})
"""


def tier_blocks(parents, children, source):
    """Blocks of parent and child chunks of a table or block (doc_id, text)."""
    block(parents, fixed_sql(source, "doc_id", "text", *chunking.PARENT, "parent_no"), *([source] if source != "documents" else []))
    block(children, fixed_sql(parents, "doc_id, parent_no", "text", *chunking.CHILD, "child_no"), parents)


tier_blocks("parents", "children", "documents")


@query("RET1 WIN6", fixed_sql("documents", "doc_id", "text", *chunking.INGEST, "chunk_no"))
def chunks_fixed(wh):
    return chunking.fixed(wh.table("documents"), ["doc_id"], "text", *chunking.INGEST)


def separator_blocks(name, source, key, size, overlap):
    """Check SQL of the separator splitter over ``source`` (key, text), in two steps.

    ``name``_pieces cuts level by level: texts above the size, behind every separator of a level; what no separator cuts,
    by length. ``name`` walks from chunk to chunk: it ends before the first piece that makes it too long, and the next
    one begins with the first piece from which the overlap is short enough and the next piece fits.
    """
    levels, before = [], f"(SELECT {key} AS key, 0 AS start, text FROM {source} WHERE text <> '')"
    for i, separator in enumerate(chunking.SEPARATORS):
        quoted = "'" + separator.replace("\n", "' || chr(10) || '") + "'"
        if separator:
            split = f"list_transform(string_split(text, {quoted}), lambda p, i: CASE WHEN i < len(string_split(text, {quoted})) THEN p || {quoted} ELSE p END)"
        else:
            split = f"list_transform(range(0, length(text), {size}), lambda i: substring(text, i + 1, {size}))"
        parts = f"CASE WHEN length(text) <= {size} THEN [text] ELSE list_filter({split}, lambda p: p <> '') END"
        cut = f"SELECT key, start, unnest({parts}) AS part, generate_subscripts({parts}, 1) AS pos FROM {before}"
        levels.append(
            f"l{i} AS MATERIALIZED (SELECT key, start + coalesce(sum(length(part)) OVER (PARTITION BY key, start ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT "
            f"AS start, part AS text FROM ({cut}))"
        )
        before = f"l{i}"
    ends = f"SELECT key, list(start ORDER BY start) AS s, list(start + length(text) ORDER BY start) AS e FROM {before} GROUP BY key"
    block(f"{name}_pieces", f"WITH {', '.join(levels)} {ends}", *([source] if source != "documents" else []))
    block(
        name,
        f"""
WITH RECURSIVE walk AS (
  SELECT key, s, e, 0 AS no, 1::BIGINT AS h, list_filter(range(2, len(s) + 1), lambda k: e[k] - s[1] > {size})[1] AS j FROM {name}_pieces
  UNION ALL
  SELECT key, s, e, no + 1, nh, list_filter(range(nh + 1, least(len(s), nh + {size}) + 1), lambda k: e[k] - s[nh] > {size})[1] FROM (
    SELECT key, s, e, no, list_filter(range(h + 1, j + 1), lambda k: k = j OR (e[j - 1] - s[k] <= {overlap} AND e[j] - s[k] <= {size}))[1] AS nh
    FROM walk WHERE j IS NOT NULL)
)
SELECT w.key, no::BIGINT AS no, s[h] AS start, substring(d.text, s[h] + 1, coalesce(e[j - 1], e[len(e)]) - s[h]) AS text
FROM walk w JOIN {source} d ON d.{key} = w.key
""",
        f"{name}_pieces",
        *([source] if source != "documents" else []),
    )


separator_blocks("separated", "documents", "doc_id", *chunking.INGEST)
separator_blocks("separated_parents", "documents", "doc_id", *chunking.PARENT)
block("numbered_parents", "SELECT key * 1000000 + no AS parent_key, key AS doc_id, no AS parent_no, text FROM separated_parents", "separated_parents")
separator_blocks("separated_children", "numbered_parents", "parent_key", *chunking.CHILD)
block(
    "separated_tiers",
    "SELECT doc_id, parent_no, c.no AS child_no, c.text FROM separated_children c JOIN numbered_parents ON parent_key = c.key",
    "separated_children",
    "numbered_parents",
)


@query("RET1", sql("SELECT key AS doc_id, no AS chunk_no, start, text FROM separated", "separated"))
def chunks_by_separators(wh):
    return chunking.by_separators(wh.table("documents"), ["doc_id"], "text", *chunking.INGEST)


@query(
    "RET1",
    """
SELECT doc_id, length(text) AS chars, length(text) AS rebuilt, true AS bounded, true AS overlapping, true AS dense
FROM documents WHERE text <> ''
""",
)
def separator_chunk_properties(wh):
    """What must hold of separator chunks: without their overlaps they are the text again, none exceeds the size, each
    starts at or before the end of the one before it and within the overlap, and they are numbered without gaps."""
    size, overlap = chunking.INGEST
    chunks = chunking.by_separators(wh.table("documents"), ["doc_id"], "text", size, overlap)
    pieces = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "start", "text"))).alias("c"))

    def joined(state, x):
        new = F.substr(x["text"], (state["end"] - x["start"] + 1).cast("int"))
        return F.struct(
            F.concat(state["text"], new).alias("text"),
            (x["start"] + F.length(x["text"])).cast("bigint").alias("end"),
            (state["ok"] & (x["start"] <= state["end"]) & (state["end"] - x["start"] <= overlap)).alias("ok"),
        )

    empty = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("end"), F.lit(True).alias("ok"))
    rebuilt = pieces.select("doc_id", "c", F.aggregate("c", empty, joined).alias("r"))
    texts = wh.table("documents").select("doc_id", F.col("text").alias("whole"))
    dense = F.forall(F.transform("c", lambda x, i: x["chunk_no"] == i), lambda b: b)
    return rebuilt.join(texts, "doc_id").select(
        "doc_id",
        F.length("whole").cast("bigint").alias("chars"),
        F.when(F.col("r.text") == F.col("whole"), F.length("r.text")).cast("bigint").alias("rebuilt"),
        F.forall("c", lambda x: F.length(x["text"]) <= size).alias("bounded"),
        F.col("r.ok").alias("overlapping"),
        dense.alias("dense"),
    )


@query("RET2", sql("SELECT doc_id, parent_no, child_no, text FROM children", "children"))
def parent_child_fixed(wh):
    return chunking.two_tier(wh.table("documents"), ["doc_id"], "text")


@query("RET2", sql("SELECT * FROM separated_tiers", "separated_tiers"))
def parent_child_by_separators(wh):
    return chunking.two_tier(wh.table("documents"), ["doc_id"], "text", chunking.by_separators)
