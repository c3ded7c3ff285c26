"""Whole results where an operator once did less than its whole job."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from churnspark import session
from churnspark.llm import best_fit, char_lm, external_shuffle, html_density, queries
from pyspark.sql import functions as F

# Languages


@pytest.mark.parametrize("part_bytes", [char_lm.PART_BYTES, 100])
def test_model_holds_every_gram(spark, part_bytes):
    rows = [(0, "the cat " * 700_000, "en"), (1, "zyzzyva quartz ", "en"), (2, "der Hund und die Katze jagt 語言模型 ", "de"), (3, "a quiet hat", "en")]
    model = char_lm.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3), part_bytes=part_bytes)
    fold, tables = char_lm.Folder(), {}
    for lang in ("de", "en"):
        keys, counts = np.unique(np.concatenate([char_lm.grams(fold(t)) for _, t, x in rows if x == lang]), return_counts=True)
        tables[lang] = (keys, counts, char_lm._discount(counts))
    known = char_lm.estimate(tables)
    assert model.languages == known.languages and model.floor == pytest.approx(known.floor)
    wanted = np.concatenate([*(t[0] for t in tables.values()), char_lm.grams(fold("the zebra 語 хата"))])
    assert char_lm._back_off(model, wanted, 4) == pytest.approx(char_lm._back_off(known, wanted, 4), rel=1e-4)
    assert (model.parts > 3) == (part_bytes == 100)
    texts = [fold(t[-200:]) for _, t, _ in rows]
    assert char_lm.entropies(model, texts) == pytest.approx(char_lm.entropies(known, texts), rel=1e-4)
    found = char_lm.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {i: x for i, _, x in rows}


# Shards


def test_written_records_lie_in_the_reported_slots(spark, make, monkeypatch):
    paths = []
    monkeypatch.setattr(external_shuffle, "fresh_path", lambda s, label: paths.append(session.fresh_path(s, label)) or paths[-1])
    pairs = [(i, f"text {i} " * (i % 5)) for i in range(300)] + [(None, None), (None, None), (5, "other")]
    docs = make(pairs).withColumns({"shard": F.lit("own"), "bucket": F.col("n") + 1, "pos": F.create_map(F.lit("k"), F.col("n"))})
    found = external_shuffle.external_shuffle(docs, 3, bucket_bytes=500).collect()
    written = spark.read.parquet(paths[0])
    rows = written.collect()
    assert Counter((r["doc_id"], r["text"], r["shard"], r["bucket"], r["pos"]["k"]) for r in rows) == Counter((i, t, "own", k + 1, k) for k, (i, t) in enumerate(pairs))
    buckets = defaultdict(list)
    for r in rows:
        buckets[r["shard_"], r["bucket_"]].append((r["pos_"], r["doc_id"], r["text_crc32"]))
    assert len(buckets) > 9  # by bytes; one bucket per shard by rows
    want, start = {}, Counter()
    for shard, bucket in sorted(buckets):
        for pos, doc, crc in buckets[shard, bucket]:
            want[shard, start[shard] + pos] = (doc, crc)
        start[shard] += len(buckets[shard, bucket])
    assert {(r["shard"], r["slot"]): (r["doc_id"], r["text_crc32"]) for r in found} == want


# Near copies


def test_every_text_is_represented_by_a_near_copy(spark, make):
    a, b, c, d, e = (" ".join(f"w{i}x{j}" for j in range(120)) for i in range(5))
    docs = make([(5, a), (5, b), (3, a), (None, c), (None, d), (None, d), (7, None), (None, ""), (8, e), (None, e), (-(2**63), e)])
    kept = queries.keep_one_of_near_copies(spark, docs, "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(3, a), (5, b), (None, c), (None, d), (7, None), (-(2**63), e)])
    assert queries.keep_one_of_near_copies(spark, docs, "").dtypes == docs.dtypes


# Pages

PLAIN = "plain words of text " * 15
LINKED = "words before " * 20 + "<a href=/x>a link of twenty char</a> and after"
ITEMS = "".join(f"<li>{'item words ' * 18}</li>" for _ in range(10))
LINKS = "<div>" + "".join(f"<a href=/{i}>Some other page</a> " for i in range(12)) + "</div>"


@pytest.mark.parametrize("links", ["", LINKS])
@pytest.mark.parametrize(
    "article",
    [
        f"<div><p>{PLAIN}</p><p>{PLAIN}</p><p>{LINKED}</p><p>{PLAIN}</p><ul>{ITEMS}</ul></div>",
        f"<div><p>{PLAIN}</p><ul>{ITEMS}</ul><p>{LINKED}</p></div>",
        f"<div><p>{PLAIN}</p><p>{PLAIN}</p><p>{PLAIN}</p></div><div><p>{PLAIN}</p><p>{LINKED}</p><p>{PLAIN}</p></div>",
        f"<section><p>{PLAIN}</p><p>{LINKED}</p></section><section><p>{PLAIN}</p><p>{PLAIN}</p></section>",
    ],
)
def test_parts_with_a_link_are_kept(article, links):
    text = html_density.main_text(f"<body>{links}{article}{links}")
    whole = html_density.main_text(f"<body><article>{article}</article>")
    assert text == whole and "a link of twenty char" in text and "other page" not in text


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "." * 2_000_000, "x" + " " * 1_500_000 + "<|endoftext|>\n\ny"])
def test_packing_of_long_runs(make, text):
    """Ids of a text with a very long run of one character are those of the library that the vocabulary is made for."""
    import public_tokenizers
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 0]
    assert [*best_fit.encoder()(text), 0] == ids
    found = best_fit.packed(make([(1, text), (2, "short")])).where("doc_id = 1").orderBy("piece").collect()
    assert sum(r["length"] for r in found) == len(ids)
    assert [r["ids_crc32"] for r in found] == [zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in found]


SENTENCES = " ".join(f"The council met again in week {i} and heard what the harbour office had to say." for i in range(6))


@pytest.mark.parametrize("name", ["legal-history", "ad-hoc", "social-studies", "formAndFunction", "notice-of-1820"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_do_not_cut_an_article(name, tag):
    """A part of an article stays whatever words its class is made of, as long as it is dense."""
    part = f'<div class="{name}"><p>{SENTENCES}</p><p>{SENTENCES} again</p></div>'
    text = html_density.main_text(f"<body><nav><a href=/>Home</a></nav><{tag}><p>{SENTENCES} first</p>{part}<p>{SENTENCES} last</p></{tag}></body>")
    assert text == "\n".join([f"{SENTENCES} first", SENTENCES, f"{SENTENCES} again", f"{SENTENCES} last"])


@pytest.mark.parametrize("tag", ["main", "article", "div"])
def test_links_in_an_article_go(tag):
    links = "<ul>" + "".join(f"<li><a href=/{i}>Page number {i}</a></li>" for i in range(30)) + "</ul>"
    with_link = f'<p>{SENTENCES} See <a href="/x">the report</a>.</p>'
    text = html_density.main_text(f"<body><{tag}><h1>Head</h1><p>{SENTENCES}</p>{links}{with_link}<p>{SENTENCES} last</p></{tag}></body>")
    assert text == "\n".join(["Head", SENTENCES, f"{SENTENCES} See the report.", f"{SENTENCES} last"])


def test_marked_parts_go():
    parts = '<div class="comment-list"><p>I liked this very much, thank you for it all.</p></div><div class="ad">Buy now</div><div class="site-footer"><a href=/>Imprint</a></div>'
    assert html_density.main_text(f"<body><article><p>{SENTENCES}</p>{parts}</article></body>") == SENTENCES


def test_unmatched_end_tags_take_linear_time():
    import time

    def seconds(n):
        start = time.perf_counter()
        html_density.main_text("<div>" * n + "</section>" * n + "<x-y>" * n + "<p>deep" + "</p>" * n)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(20_000) < 20 * seconds(4_000)


def test_many_equal_rows_are_split_over_buckets(spark, make):
    """Repeats of one row share a shard, but no bucket of it holds much more than its bound."""
    docs = make([(7, "the same")] * 20_000 + [(i, f"text {i}") for i in range(2000)] + [(None, None)] * 3000)
    path = external_shuffle.write_shards(docs, 4, bucket_rows=500)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("shard", "bucket").count().collect()]
    assert sum(sizes) == 25_000 and max(sizes) <= 2 * 500
    found = external_shuffle.external_shuffle(docs, 4, bucket_rows=500).collect()
    places = defaultdict(list)
    for r in found:
        places[r["shard"]].append(r["slot"])
    assert len({r["shard"] for r in found if r["doc_id"] == 7}) == 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in places.values())
