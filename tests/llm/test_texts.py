"""Pages, shards, languages, packing, urls and quality against brute force, round trips and held-out labels."""

import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from churnspark.llm import best_fit, char_lm, external_shuffle, html_density, ordinal, url_rules
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

# Pages

PARAGRAPH = "A paragraph of plain text that is long enough to be dense, with commas and a full stop at its end."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain words &amp; more", "plain words & more"),
        (f"<body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{PARAGRAPH}<p>Two  \n lines</article><footer>foot</footer>", f"Head\n{PARAGRAPH}\nTwo lines"),
        (f"<body><div class='top-menu'>Menu</div><div id=main><p>{PARAGRAPH}</p><ul><li>one<li>two</ul></div><div class=sidebar>Side</div>", f"{PARAGRAPH}\none\ntwo"),
        (f"<body><article><p>{PARAGRAPH} <b>bold</b><i>er</i> &eacute;&#233;&lt;</p><script>var x='</p>';</script><style>p{{}}</style><form>Name <input></form></article>", f"{PARAGRAPH} bolder éé<"),
        (f"<body><div><div class='cookie-notice'>We use cookies</div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><div id='comments'><p>{PARAGRAPH} I disagree</p></div></div>", f"{PARAGRAPH}\n{PARAGRAPH}"),
        (f"<p>{PARAGRAPH}<table><tr><td>a<td>b<tr><td>c</table>", f"{PARAGRAPH}\na\nb\nc"),
        (f"<article><div class=ad>Buy</div><p><b>{PARAGRAPH}<br><p>next</article></div></p><p>", f"{PARAGRAPH}\nnext"),
        (f"<!-- c --><body><main><header>Site</header><p>{PARAGRAPH}</p><aside>Note</aside><blockquote>Said</blockquote></main>", f"{PARAGRAPH}\nSaid"),
        (f"<body class='has-sidebar'><div class='wrap with-sidebar no-ads'><p>{PARAGRAPH}</p><ol class=commentlist><li>Me too</ol></div>", PARAGRAPH),
        (f"<div class='pageHeader'>Top</div><div class=story><h2>Head</h2><p>{PARAGRAPH}</p><div id='ad-3'>Buy</div><p>{PARAGRAPH}</p></div>", f"Head\n{PARAGRAPH}\n{PARAGRAPH}"),
        ("<article><p>x", "x"),
        ("<a <b <p>", ""),
    ],
)
def test_main_text(page, text):
    assert html_density.main_text(page) == text


def test_deep_and_long_pages():
    assert html_density.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    long = " ".join(["word"] * 200_000)
    assert html_density.main_text(f"<article><p>{long}</p></article>") == long


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r["page_id"]: r for r in html_density.extract(pages).collect()}
    for page in pages.collect():
        body = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</h1>|</?p>", "\n", body.replace("<br>", " ")))
        want = "\n".join(x for x in (" ".join(line.split()) for line in html.unescape(body).split("\n")) if x)
        row = found[page["page_id"]]
        assert (row["text"], row["url"], row["n_chars"]) == (want, page["url"], len(want))


def test_pages_of_odd_rows(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    rows = [(None, None, None, "t", 1), (1, "u", "<p>x</p>", None, None), (1, "u", "<p>x</p>", None, None)]
    found = html_density.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [(None, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1)]))
    assert html_density.extract(spark.createDataFrame([], schema)).count() == 0


# Shards


@pytest.mark.parametrize("bucket_rows", [50_000, 7])
def test_shards_and_slots(make, bucket_rows):
    pairs = [(i, f"text {i % 50}" if i % 7 else None) for i in range(700)] + [(None, "x"), (None, "x"), (5, "text 5"), (5, "text 5")]
    found = external_shuffle.external_shuffle(make(pairs), 9, bucket_rows=bucket_rows).collect()
    raw = [(i, (t or "").encode()) for i, t in pairs]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len(b) + 16, zlib.crc32(b)) for i, b in raw)
    slots = defaultdict(list)
    shard_of = defaultdict(set)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        shard_of[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 9) and 0 <= r["shard"] < 9
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())
    grown = sum(r["grown_shard"] == 9 for r in found)
    assert 0.4 * len(found) / 10 < grown < 2 * len(found) / 10
    in_order = sum(a < b for s in range(9) for a, b in zip(*(lambda x: (x, x[1:]))([r["doc_id"] or 0 for r in sorted((r for r in found if r["shard"] == s), key=lambda r: r["slot"])])))
    assert 0.35 < in_order / len(found) < 0.65


def test_shards_are_the_same_in_every_run(make):
    docs = make([(i, str(i)) for i in range(300)])
    one, two = (sorted(map(tuple, external_shuffle.external_shuffle(docs, 5).collect())) for _ in range(2))
    assert one == two
    grown = {r[0]: r[4] for r in external_shuffle.external_shuffle(docs, 6).collect()}
    assert all(grown[r[0]] == r[6] for r in one)


def test_written_shards(spark, make, tmp_path):
    pairs = [(i, f"t{i}") for i in range(200)] + [(None, None)]
    path = external_shuffle.write_shards(make(pairs), 4, str(tmp_path / "shards"), bucket_rows=20)
    back = spark.read.parquet(path)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(pairs)
    assert external_shuffle.external_shuffle(make([]), 4).count() == 0


# Languages


def kneser_ney(texts, gram):
    """Interpolated Kneser-Ney probability of the last character of ``gram``, from its definition."""
    counts = Counter()
    for t in texts:
        units = [0, 0, *t]
        counts.update(tuple(units[i : i + 4]) for i in range(len(units) - 3))
    tables = [None, None, None, None, counts]
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    chars = len(tables[1]) + 1

    def discount(table):
        ones, twos = (sum(c == k for c in table.values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    def p(g):
        table, d = tables[len(g)], discount(tables[len(g)])
        if len(g) == 1:
            total = sum(table.values())
            return max(table[g] - d, 0) / total + d * len(table) / total / chars
        same = {h: c for h, c in table.items() if h[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return p(g[1:])
        return max(table[g] - d, 0) / total + d * len(same) / total * p(g[1:])

    return p(gram)


def test_probabilities_equal_their_definition():
    fold = char_lm.Folder()
    texts = [fold(t) for t in ("the cat sat on the mat", "That hat!", "a tomato at the tea", "Ätherische Öle")]
    keys, counts = np.unique(np.concatenate([char_lm.grams(t) for t in texts]), return_counts=True)
    model = char_lm.estimate({"x": (keys, counts, char_lm._discount(counts))})
    r = random.Random(1)
    units = sorted({int(u) for t in texts for u in t})
    for _ in range(200):
        t = texts[r.randrange(len(texts))].tolist()
        i = r.randrange(len(t) - 4)
        gram = tuple(t[i : i + 3]) + (r.choice(units),) if r.random() < 0.6 else tuple(r.choice(units) for _ in range(4))
        key = np.array([sum(u << (16 * (3 - k)) for k, u in enumerate(gram))], np.uint64)
        assert np.exp(char_lm._back_off(model, key, 4))[0, 0] == pytest.approx(kneser_ney([u.tolist() for u in texts], gram), rel=1e-4)


def test_probabilities_sum_to_one():
    fold = char_lm.Folder()
    texts = [fold(t) for t in ("la vida es sueño", "und so weiter und so fort")]
    keys, counts = np.unique(np.concatenate([char_lm.grams(t) for t in texts]), return_counts=True)
    model = char_lm.estimate({"x": (keys, counts, 0.6)})
    for context in ("und", " so", "xyz"):
        base = sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(context))
        every = np.append(model.keys[0], np.uint64(0xFFF0)) | np.uint64(base)
        assert np.exp(char_lm._back_off(model, every, 4)).sum() == pytest.approx(1, rel=1e-4)


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = char_lm.identified(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    tested = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert np.mean([r["lang_pred"] == r["lang"] for r in tested]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in found) and np.mean([r["accepted"] for r in found]) > 0.97


def test_languages_of_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, held_out string, score int"
    rows = [(i, t, l, "h", 1) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)]
    odd = [(100, None, "en", None, None), (101, "", "en", None, None), (102, "123 !?", None, None, None), (None, "the dog", None, None, None),
           (104, "𝔘𝔫𝔡 😀 語", None, None, None), (105, "the " * 50_000, None, None, None), (105, "the " * 50_000, None, None, None)]
    found = char_lm.identified(spark.createDataFrame(rows + odd, schema)).collect()
    assert len(found) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in found}
    assert [by[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and by[None]["lang_pred"] == "en" and by[105]["lang_pred"] == "en"
    assert by[104]["lang_pred"] in ("en", "de") and not by[104]["accepted"]
    assert {r["lang_pred"] for r in char_lm.identified(spark.createDataFrame([(0, "abc", None, "", 1)], schema)).collect()} == {"und"}
    assert char_lm.identified(spark.createDataFrame([], schema)).count() == 0


# Packing


def test_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    known, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), best_fit.encoder()
    texts = ["", " ", "plain  words\n\n and\ttabs", "é ü 語 😀 \u200b", "it's we'll 12,000 x<|endoftext|>y", "a" * 3000, "\x00\x7f"]
    for t in texts:
        assert encode(t) == known.encode(t, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_bin():
    r = random.Random(1)
    bins, free = best_fit.BestFit(50, 10**9), []
    for _ in range(3000):
        n = r.randrange(1, 51)
        fitting = [f for f in free if f >= n]
        number, offset = bins.place(n)
        if fitting:
            assert 50 - offset == min(fitting)
        else:
            assert number == len(free) and offset == 0
            free.append(50)
        assert free[number] == 50 - offset
        free[number] -= n


def test_best_fit_closes_the_fullest():
    bins = best_fit.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # bin 1 has the least space and is closed
    assert bins.place(3) == (0, 6) and bins.place(2) == (2, 8) and bins.place(1) == (0, 9) and bins.place(1) == (3, 0)
    for n in range(1, 10):
        bins.place(n)
        assert bins.open <= 2


def packed_pieces(pairs, found, capacity):
    ids = {}
    for i, t in pairs:
        ids.setdefault((i, t), [*best_fit.encoder()(t or ""), 0])
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in found:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_document[r["doc_id"]].append(r)
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return ids, by_sequence, by_document


@pytest.mark.parametrize("open_bins,per_batch", [(4096, 8192), (3, 20)])
def test_packing_is_a_partition_of_all_ids(make, open_bins, per_batch):
    r = random.Random(2)
    pairs = [(i, " ".join(r.choice(["alpha", "beta", "ç", "12"]) for _ in range(r.randrange(0, 150)))) for i in range(150)] + [(900, None), (901, "")]
    found = best_fit.packed(make(pairs), capacity=64, open_bins=open_bins, per_batch=per_batch).collect()
    ids, by_sequence, by_document = packed_pieces(pairs, found, 64)
    for i, t in pairs:
        whole = ids[i, t]
        rows = sorted(by_document[i], key=lambda x: x["piece"])
        assert [x["piece"] for x in rows] == list(range(len(rows))) and (len(rows) == 1 or len(whole) > 64)
        at = 0
        for x in rows:
            part = np.array(whole[at : at + x["length"]], "<u4")
            assert (x["start"], x["ids_crc32"]) == (at, zlib.crc32(part.tobytes()))
            at += x["length"]
        assert at == len(whole) and all(x["length"] == 64 for x in rows[1:])
    least = sum(map(len, ids.values())) / 64
    assert len(by_sequence) < 1.05 * least + 20


def test_packing_of_odd_rows(make):
    pairs = [(None, "one"), (None, "one"), (3, "two"), (3, "two"), (3, "three")]
    found = best_fit.packed(make(pairs)).collect()
    assert len(found) == 5 and len({r["sequence_id"] for r in found}) == 1
    assert best_fit.packed(make([])).count() == 0


def test_sequences_hold_the_ids(make):
    pairs = [(i, f"document number {i} " * (i % 9)) for i in range(60)]
    got = best_fit.sequences(make(pairs), capacity=50).collect()
    assert all(len(r["ids"]) <= 50 for r in got)
    assert Counter(x for r in got for x in r["ids"]) == Counter(x for _, t in pairs for x in [*best_fit.encoder()(t), 0])


# Urls


def brute_rule(host, path):
    best = None
    for h, p, verdict in url_rules.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


def brute_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


URLS = [
    None, "", "no scheme.net/x", "http://a.net", "http://a.net/", "http://A.NET/x", "http://example.net/en/1", "https://b.example.net/en/", "https://example.net/enx/",
    "http://example.com/de/x?q=/de/", "http://example.com/en/#/de/", "http://x.org/fr/1", "http://notnet/x", "http://xnet/a", "ftp://net/a", "http://É.net/ü", "x://a.net/b://c",
    "http://host.com:80/de/", "http://.net/a", "http://a..net/b", "http://a.net?x", "http://a.net#x",
]


def test_verdicts_equal_brute_force(spark):
    schema = "page_id bigint, url string, html string, host int, rule string"
    pages = spark.createDataFrame([(i, u, "<p>", 1, "r") for i, u in enumerate(URLS)] + [(1, URLS[1], None, 1, "r"), (None, "http://a.net/q", None, 1, None)], schema)
    found = url_rules.judge(pages).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        host, path = brute_parts(URLS[r["page_id"]] if r["page_id"] is not None else "http://a.net/q")
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_blocks_reach_aliases(spark):
    canonical = '<LINK href="{}" rel="canonical">'
    refresh = "<meta http-equiv=refresh content='0; URL={}'>"
    rows = [
        (1, "http://bad.net/x", None),
        (2, "http://a.com/1", canonical.format("http://bad.net/x")),
        (3, "http://b.com/2?s=1#f", refresh.format("http://a.com/1")),
        (4, "http://b.com/3", canonical.format("/2?s=1")),
        (5, "http://example.net/en/ok", canonical.format("http://a.com/1")),
        (6, "http://c.com/1", canonical.format("http://c.com/2")),
        (7, "http://c.com/2", None),
        (8, "http://d.com/1", canonical.format("http://unseen.net/y")),
        (9, "http://e.com/1", '<link rel="stylesheet" href="http://bad.net/x"><link rel=canonical href="http://[">'),
        (10, "https://b.com/2?s=1", None),
    ]
    found = {r["page_id"]: r["verdict"] for r in url_rules.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow", 10: "block"}
    more = spark.createDataFrame([("http://c.com/2", "http://d.com/1")], "a string, b string")
    found = {r["page_id"]: r["verdict"] for r in url_rules.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string"), redirects=more).collect()}
    assert found[6] == found[7] == "block"


# Quality


def test_gradient_of_the_ordinal_loss():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 3))
    score = x @ np.array([2.0, -1.0, 0.0]) + r.logistic(size=600)
    grades = (score > -1).astype(int) + (score > 1.5)
    rows = [(int(g), [5, 6, 7], v.tolist()) for g, v in zip(grades, x)]
    model = ordinal.fit(rows, penalty=1e-4, most=1.0)
    assert model.weights[5] == pytest.approx(2.0, abs=0.4) and model.weights[6] == pytest.approx(-1.0, abs=0.3) and abs(model.weights[7]) < 0.25
    assert model.thresholds[0] == pytest.approx(-1.0, abs=0.6) and model.thresholds[1] == pytest.approx(1.5, abs=0.6)
    expected, top = model.grade(10.0)
    assert expected > 1.95 and top > 0.99 and model.grade(-10.0)[0] < 0.05


def test_grades_of_labelled_documents(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    fitted = labels.where("doc_id % 2 = 0")
    found = ordinal.graded(documents, fitted).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r["accepted"] for r in found if r["quality"] == 1 and r["toxic"] == 0]
    poor = [r["accepted"] for r in found if r["quality"] == 0]
    toxic = [r["accepted"] for r in found if r["toxic"] == 1]
    assert np.mean(clean) > 0.97 and np.mean(poor) < 0.1 and np.mean(toxic) < 0.4
    order = np.mean([r["expected_grade"] for r in found if r["quality"] == 1 and r["toxic"] == 0]) - np.mean([r["expected_grade"] for r in found if r["quality"] == 0 or r["toxic"] == 1])
    assert order > 0.5


def test_grades_of_odd_rows(spark, make):
    pairs = [(i, "good text of words" if i % 2 else "bad!! BAD!! ***") for i in range(60)] + [(None, None), (70, None), (71, ""), (72, "x " * 200_000), (1, "good text of words")]
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(50)] + [(1, 1, 0), (None, 0, 1), (999, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    found = ordinal.graded(make(pairs), labels, extra=("n", "bits")).collect()
    assert len(found) == len(pairs) and {r["row"]["n"] for r in found} == set(range(len(pairs)))
    by = {r["doc_id"]: r for r in found}
    assert by[55]["accepted"] and not by[56]["accepted"]
    assert all(0 <= r["top_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in found)
    assert ordinal.graded(make([]), labels).count() == 0
    assert all(r["accepted"] for r in ordinal.graded(make(pairs), labels.limit(0)).collect())


def test_language_limits_come_from_every_labelled_text(spark):
    """More documents than any sample held before: mean and deviation of all, however they are dealt to tasks."""
    rows = [(i, f"das haus {i % 37} ist alt und klein" if i % 2 else f"the house {i % 41} is old" + " and small" * (i % 7), "de" if i % 2 else "en") for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = char_lm.train(df.repartition(7))
    fold = char_lm.Folder()
    for j, lang in enumerate(model.languages):
        h = char_lm.entropies(model, [fold(t) for _, t, own in rows if own == lang])[:, j]
        assert np.isclose(model.limits[j], h.mean() + 4 * h.std(), rtol=1e-9)
