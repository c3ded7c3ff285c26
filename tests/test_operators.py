"""Operators against brute force on small fixtures, with hot keys and copies."""

import math
import random
import re
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from churnspark import session
from churnspark.functions import columns as C
from churnspark.operators import chunking, dense, evaluation as E, graph as G, index as I, questions as Q, retrieval as R
from churnspark.operators import ranking
from churnspark.operators.profile import ranked_text
from churnspark.operators.ranking import exact_quantiles
from churnspark.operators.sizing import fits
from churnspark.sources import readers, sinks
from churnspark.streaming import events as S

WORDS = "churn risk segment price support product tenure usage rival value plan team cost".split()


def texts(n, seed=1):
    """A third of all texts are copies of one."""
    rng = random.Random(seed)
    made = [" ".join(rng.choices(WORDS, k=rng.randint(1, 40))) + ". End" for _ in range(n)]
    return [(i, made[0] if i % 3 == 0 else t) for i, t in enumerate(made)]


def test_scalar_columns(spark):
    row = spark.createDataFrame([("$1,234.50", " N/A ", "A; B,\nC,,None", "for Acme Inc (SMB)", "1. one\n- two\nthree\n2) four")], "m string, s string, p string, q string, l string").select(
        C.parse_money("m").alias("money"), C.null_if_missing("s").alias("missing"), C.split_list("p").alias("items"),
        C.name_in_parentheses_question("q").alias("name"), C.list_items("l").alias("list"), C.truncate("q", 3).alias("cut"),
    ).first()
    assert (str(row.money), row.missing, row["items"], row.name) == ("1234.50", None, ["A", "B", "C"], "Acme Inc")
    assert (row.list, row.cut) == (["one", "two", "four"], "for...")


@pytest.mark.parametrize("by", [(), ("g",)])
def test_exact_quantiles_with_hot_value(spark, by):
    rng = random.Random(2)
    rows = [("a" if i % 3 else "b", 7.0 if i % 3 == 0 else rng.lognormvariate(3, 4)) for i in range(999)] + [("c", None), ("d", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"low": 0.25, "mid": 0.5, "high": 0.99}
    got = exact_quantiles(df, "v", probs, by).collect()
    for r in got:
        values = [v for g, v in rows if v is not None and (not by or g == r.g)]
        for name, p in probs.items():
            assert math.isclose(r[name], np.quantile(values, p), rel_tol=1e-12)
    assert len(got) == (3 if by else 1)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_exact_quantiles_with_far_outliers(spark, monkeypatch, by):
    monkeypatch.setattr(ranking, "SORTED", 50)
    monkeypatch.setattr(ranking, "CELLS", 16)
    values = [float(i) for i in range(3000)] + [1e18, -1e300, 1e300] + [5.5] * 400
    rows = [("ab"[i % 7 == 0], v) for i, v in enumerate(values)]
    probs = {"low": 0.25, "mid": 0.5, "top": 0.999}
    got = exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", probs, by).collect()
    assert len(got) == (2 if by else 1)
    for r in got:
        own = [v for g, v in rows if not by or g == r.g]
        for name, p in probs.items():
            assert math.isclose(r[name], np.quantile(own, p), rel_tol=1e-9)


def test_ranked_text_takes_all_items(spark):
    df = spark.createDataFrame([("g", f"i{k:04}") for k in range(1500)], "g string, i string")
    assert ranked_text(df, "g", "i", None, "t").first().t.count(";") == 1499


def test_questions_filter_their_own_profiles(spark):
    rows = [(i, "price " + "risk " * (i % 3), (["A", "B", None][i % 3], f"r{i % 2}", float(i * 100))) for i in range(12)]
    profiles = spark.createDataFrame(rows, "doc_id bigint, text string, metadata struct<segment:string,churn_reason:string,arr_lost:double>")
    asked = [("all", None, None, None, None), ("a", "A", None, None, None), ("r", None, "r1", 300.0, None), ("zero", None, None, None, 0.0), ("none", "C", None, None, None)]
    schema = "question_id string, text string, segment string, churn_reason string, arr_from double, arr_to double"
    questions = spark.createDataFrame([(q, "price", *c) for q, *c in asked], schema)
    found = R.filtered(profiles, questions, 20).collect()
    for q, segment, reason, low, high in asked:
        want = {
            i for i, _, (s, r, arr) in rows
            if (segment is None or s == segment) and (reason is None or r == reason) and (low is None or arr >= low) and (high is None or arr <= high)
        }
        assert {r.doc_id for r in found if r.question_id == q} == want


def test_pieces_of_fixed_texts():
    cut = lambda t, size, overlap: [t[a:b] for a, b in chunking.split_spans(t, size, overlap)]
    assert cut("one two three four", 9, 0) == ["one two ", "three ", "four"]
    assert cut("one two three four", 9, 4) == ["one two ", "three ", "four"]
    assert cut("aa bb cc dd", 6, 3) == ["aa bb ", "bb cc ", "cc dd"]
    assert cut("First. Second. Third", 8, 0) == ["First. ", "Second. ", "Third"]
    assert cut("p one\n\np two\nand more", 12, 0) == ["p one\n\n", "p two\n", "and more"]
    assert cut("abcdefghij", 4, 0) == ["abcd", "efgh", "ij"]
    assert cut("short", 10, 2) == ["short"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=300), st.integers(5, 60), st.integers(0, 20))
def test_split_spans(text, size, overlap):
    overlap = min(overlap, size - 1)
    spans = chunking.split_spans(text, size, overlap)
    assert all(0 < b - a <= size for a, b in spans)
    covered = 0
    for a, b in spans:
        assert a <= covered < b and covered - a <= overlap
        covered = b
    assert covered == len(text)


def test_fixed_chunks_rebuild_text(spark):
    rows = [(0, ""), (1, "x" * 5), (2, "".join(random.Random(3).choices("äb c", k=1234)))]
    out = chunking.fixed(spark.createDataFrame(rows, "doc_id int, text string"), ["doc_id"], "text", 100, 10).collect()
    for key, text in rows:
        pieces = sorted((r.chunk_no, r.text) for r in out if r.doc_id == key)
        assert "".join(t if i == 0 else t[10:] for i, t in pieces) == text


@pytest.mark.parametrize("blocks", [False, True])
def test_dense_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(dense, "MAX_QUERIES", 4 if blocks else 4096)
    monkeypatch.setattr(dense, "BLOCK_VECTORS", 50)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(200, 8))
    vectors[::3] = vectors[0]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, vec array<float>")
    queries = corpus.filter("vec_id < 10").withColumnRenamed("vec_id", "query_id")
    found = dense.top_k(corpus, queries, 7, force_blocks=blocks).collect()
    single = vectors.astype(np.float32).astype(float)
    unit = single / np.linalg.norm(single, axis=1, keepdims=True)
    for q in range(10):
        scores = np.round(unit @ unit[q], 9)
        want = sorted(range(200), key=lambda i: (-scores[i], i))[:7]
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == want


def brute_tfidf(corpus, question):
    tok = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    docs = {i: tok(t) for i, t in corpus}
    n = len(docs)
    df = {w: sum(w in set(d) for d in docs.values()) for d in docs.values() for w in d}
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1
    vec = lambda words: {w: words.count(w) * idf(w) for w in set(words)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q = vec(tok(question))
    scores = {}
    for i, d in docs.items():
        v = vec(d)
        shared = sum(v[w] * q[w] for w in v if w in q)
        if shared:
            scores[i] = shared / norm(v) / norm(q)
    return sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0]))


@pytest.mark.parametrize("round_terms", [I.ROUND_TERMS, 3])
def test_text_top_k(spark, monkeypatch, round_terms):
    from churnspark.operators import sparse

    monkeypatch.setattr(sparse, "BLOCK_QUESTIONS", 2)
    monkeypatch.setattr(sparse, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(sparse, "BUFFER_ROWS", 50)
    corpus = texts(90)
    asked = [("q1", "price risk unknown"), ("q2", "churn"), ("q3", "team plan cost, value"), ("q4", "nothing here")]
    index = I.build(spark.createDataFrame(corpus, "doc_id bigint, text string"), ["doc_id"])
    questions = spark.createDataFrame(asked, "question_id string, text string")
    found = I.best(index, questions, ["question_id"], 6, round_terms=round_terms).collect()
    for key, text in asked:
        got = sorted((r["rank"], r.doc_id, r.score) for r in found if r.question_id == key)
        want = brute_tfidf(corpus, text)[:6]
        assert [g[1] for g in got] == [w[0] for w in want]
        assert all(math.isclose(g[2], w[1], abs_tol=1e-12) for g, w in zip(got, want))


def test_rounds_agree_on_parents(spark):
    documents = spark.createDataFrame([(i, t * 30) for i, t in texts(12)], "doc_id bigint, text string")
    retriever = R.Retriever(documents)
    asked = R.original(spark.createDataFrame([(1, "price risk"), (2, "tenure")], "question_id bigint, text string"))
    ways = [
        I.best(retriever.index, asked, ["question_id", "variant"], 4, parents=True, round_terms=way)
        .select("question_id", "kind", "rank", "doc_id", "parent_no", "child_no", F.round("score", 9), F.round("bm25", 9))
        .collect()
        for way in (I.ROUND_TERMS, 2)
    ]
    assert sorted(map(str, ways[0])) == sorted(map(str, ways[1])) and {r.kind for r in ways[0]} == {"child", "parent"}


def test_both_ways_of_cutting_tokens_agree(spark):
    odd = ["a_b c-d", "Émile ÉCOLE ñ 3½ x² Ⅷ", "naïve\u0301 e\u0301", "日本語 text😀tail", "", "'quoted' 1,000.5", "ß ẞ ﬁ \u200bzero", "tab\tnew\nline"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id bigint, text string")
    native = {(r.doc_id, r.w) for r in df.select("doc_id", F.explode(C.tokens("text")).alias("w")).collect()}
    counted = {(r.doc_id, r.term) for r in I.counted_texts(df, ["doc_id"]).collect() if r.term is not None}
    assert native == counted


def test_filtered_is_part_of_unfiltered(spark):
    documents = spark.createDataFrame(texts(40), "doc_id bigint, text string")
    questions = spark.createDataFrame([(1, "price of support")], "question_id bigint, text string")
    retriever = R.Retriever(documents)
    every = {r.doc_id for r in R.naive(retriever, questions, 40).collect()}
    some = {r.doc_id for r in R.naive(retriever.restricted(documents.filter("doc_id > 20").select("doc_id")), questions, 40).collect()}
    assert some == {d for d in every if d > 20}


def test_unknown_strategy():
    with pytest.raises(ValueError):
        R.strategy("best")


def test_compression_keeps_bearing_sentences(spark):
    row = spark.createDataFrame([("Price is high. We like dogs! Support and price", "price support plan")], "t string, q string")
    assert row.select(R.kept_sentences("t", "q").alias("k")).first().k == "Price is high. Support and price"


def test_contained(spark):
    base = texts(30, 5)
    passages = [(0, base[1][1][3:40]), (1, "x"), (2, "risk"), (3, "d. E"), (4, base[0][1]), (5, "not in there at all, no"), (6, "...")]
    docs = [*base, (100, "a x b"), (101, "..."), (102, "")]
    got = E.contained(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "question_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.question_id) for r in got) == sorted((d, p) for d, t in docs for p, s in passages if s in t)


def test_mentions(spark):
    names = ["Acme", "acme corp", "Übung", "X"]
    asked = [(1, "Why did ACME Corp leave?"), (2, "Die übung"), (3, "none"), (4, "x")]
    got = Q.mentions(spark.createDataFrame(asked, "k int, t string"), spark.createDataFrame([(n,) for n in names], "name string"), "k", "t").collect()
    assert sorted(tuple(r) for r in got) == sorted((k, n) for k, t in asked for n in names if n.lower() in t.lower())


def test_precision_and_recall(spark):
    hits = spark.createDataFrame([("m", 1, 1, 10), ("m", 1, 2, 11), ("m", 1, 3, 12), ("m", 2, 1, 99)], "method string, question_id int, rank int, doc_id int")
    relevant = spark.createDataFrame([(1, 10), (1, 12), (2, 5)], "question_id int, doc_id int")
    got = {r.question_id: (round(r.context_precision, 6), r.context_recall) for r in E.precision_recall(hits, relevant, None, ["m"]).collect()}
    assert got == {1: (round((1 + 2 / 3) / 2, 6), 1.0), 2: (0.0, 0.0)}


ACCOUNTS = "account_id bigint, account_name string, segment string, close_date date, first_win_date date, arr decimal(18,2), tenure_years double, primary_reason string, sub_reason string, products_rollup string, competitor_1 string, competitor_2 string, details string"


def test_graph(spark):
    from datetime import date
    from decimal import Decimal

    row = lambda i, name, rival: (i, name, "SMB", date(2024, 1, i), date(2023, 1, 1), Decimal(i), 1.0, "Price", "N/A", "A\nB; C", rival, "None mentioned", None)
    table = spark.createDataFrame([row(1, "Acme", "R"), row(2, "Beta", "R"), row(3, "Acme", "R")], ACCOUNTS)
    nodes, edges = G.nodes(table), G.edges(table)
    ids = {r.id for r in nodes.collect()}
    assert all(r.src in ids and r.dst in ids for r in edges.collect())
    assert G.relations(table).count() == 18 and edges.count() == 12
    assert nodes.filter("id = 'Acme'").first().arr_lost == 3.0
    assert str(edges.filter("src = 'Acme' and dst = 'REASON:Price'").first().churn_date) == "2024-01-03"
    assert G.nodes(table, C.PRODUCT_DELIMITERS_COMPAT).filter("type = 'Product'").count() == 2
    assert {r.competitor: r.accounts for r in G.competitor_losses(edges).collect()} == {"R": 2}


def test_account_export_with_lines_in_fields(spark, tmp_path):
    header = ",".join(f'"{h}"' for h in readers.EXPORT_NAMES)
    line = 'SMB,"Acme, Inc",Renewal,10/31/2024,Renewal,"$1,250.00","A\nB",Rival,None mentioned,Price,N/A,"He said ""no""\nand left",1/2/2023,1.8'
    (tmp_path / "export.csv").write_text(f"{header}\n{line}\n")
    row = readers.read_account_export(spark, str(tmp_path)).first()
    assert (row.account_name, float(row.arr), row.products_rollup, row.competitor_2, row.sub_reason) == ("Acme, Inc", 1250.0, "A\nB", None, None)
    assert (str(row.close_date), row.details, row.tenure_years) == ("2024-10-31", 'He said "no"\nand left', 1.8)


def test_missing_files(spark):
    gone = "/nonexistent/place"
    with pytest.raises(Exception):
        readers.read_csv(spark, gone, readers.TICKETS).count()
    assert readers.optional(spark, lambda: readers.read_csv(spark, gone, readers.TICKETS), readers.TICKETS).count() == 0


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, version int")
    new = spark.createDataFrame([(1, "c", 2), (3, "d", 1)], "id int, v string, version int")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, "id", "version").collect()) == [(1, "c", 2), (2, "b", 1), (3, "d", 1)]


def test_shared_folder_comes_from_the_session(spark):
    def told(folder, master):
        context = SimpleNamespace(master=master, applicationId=f"test-{master}")
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)

    assert session.fresh_path(told("hdfs://x/shared/", "yarn"), "t").startswith("hdfs://x/shared/t-")
    assert session.shared_dir(spark) == session.shared_dir(spark)
    with pytest.raises(RuntimeError):
        session.shared_dir(told(None, "yarn"))


def test_size_is_measured(spark):
    assert fits(spark.range(10), 10) and not fits(spark.range(11), 10)
    assert not fits(spark.createDataFrame([("x" * 100,)], "t string"), 10, 50)


def test_late_events_are_dropped(spark, tmp_path):
    import time
    from datetime import datetime

    def file(name, rows):
        spark.createDataFrame(rows, S.EVENT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / name))
        time.sleep(1.1)

    at = lambda i, day: (i, datetime(2024, 1, day), 1, "click", 1.0, "{}")
    file("a", [at(1, 1), at(2, 20)])
    file("b", [at(3, 21)])
    file("c", [at(4, 2), at(5, 21)])
    events = S.read_events(spark, str(tmp_path / "*"), max_files=1)
    weeks = {str(r.week_start)[:10]: r.events for r in S.run_available(S.engagement_weekly(events), ["week_start", "account_id"]).collect()}
    # The late event of January 2nd comes after its week is closed.
    assert weeks == {"2023-12-28": 1, "2024-01-18": 3}


@pytest.mark.parametrize("folder,max_files", [(True, 1), (True, 2), (True, 1000), (False, 1)])
def test_no_event_of_a_backlog_is_lost(spark, tmp_path, folder, max_files):
    from datetime import datetime, timedelta

    rng = random.Random(5)
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=rng.randrange(4000)), rng.randrange(5), rng.choice(["error", "click"]), 1.0, "{}") for i in range(300)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, S.EVENT_SCHEMA).repartition(6 if folder else 1).write.parquet(path)
    if not folder:
        path = next(str(p) for p in (tmp_path / "events.parquet").iterdir() if p.suffix == ".parquet")
    table = spark.read.parquet(path)
    delay = S.backlog_delay(table)
    events = S.read_events(spark, path, max_files)
    tickets = S.run_available(S.tickets_sliding(events, delay=delay), ["window_start", "window_end", "account_id"]).collect()
    assert sum(r.tickets for r in tickets) == 30 * sum(r[3] == "error" for r in rows)
    weeks = S.run_available(S.engagement_weekly(events, delay), ["week_start", "account_id"]).collect()
    assert sum(r.events for r in weeks) == len(rows)
    kept = S.run_available(S.deduplicated(events.union(events), delay), ["event_id"], "append").collect()
    assert sorted(r.event_id for r in kept) == list(range(300))
