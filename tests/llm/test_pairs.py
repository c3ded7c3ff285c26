"""Fingerprints, near copies, repeats and contamination against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from churnspark.llm import bwt_repeats, common, imatch, simhash, winnowing
from churnspark.operators import sizing
from pyspark.sql import functions as F


def words_of(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"{r.choice('abcdefgh')}{r.randrange(vocabulary)}é" for _ in range(n))


# Repeats


def brute_repeats(texts, length):
    """Removed byte positions of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return data, out


def repeats_fixture():
    r = random.Random(3)
    base = [words_of(60, s) for s in range(12)]
    shared = words_of(30, 99)
    texts = [*base, None, "", "x", base[0], base[0], base[1][:150] + base[2][20:], "a" * 700, "a" * 130, "ab" * 90 + "c"]
    for b in base[:10]:
        at = r.randrange(len(b))
        texts.append(b[:at] + shared + b[at:])
    texts += [shared[:90], shared[5:140] + "§", shared * 2, "é" * 300, "\0" * 90 + "\0b" * 60]
    return texts


@pytest.mark.parametrize("length,k,max_group", [(60, 16, 20_000), (60, 16, 2), (100, 32, 20_000)])
def test_repeats_equal_brute_force(make, length, k, max_group):
    texts = repeats_fixture()
    pairs = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4]), (None, None)]
    found = bwt_repeats.without_repeats(make(pairs), length=length, k=k, max_group=max_group, extra=("n", "bits")).collect()
    data, gone = brute_repeats([t for _, t in pairs], length)
    want = []
    for (i, _), d, g in zip(pairs, data, gone):
        rest = bytes(np.frombuffer(d, np.uint8)[~g]) if len(d) else b""
        spans = int((np.diff(g.astype(int), prepend=0) == 1).sum())
        want.append((i, len(d), int(g.sum()), spans, hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore")))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:6]) for r in found)
    assert {r["row"]["n"] for r in found} == set(range(len(pairs)))


def test_repeats_in_small_batches(make):
    texts = [t for t in repeats_fixture() if t]
    docs = make(list(enumerate(texts)))

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    few = bwt_repeats.repeats(keyed, 60, 16, batch_rows=2).collect()
    many = bwt_repeats.repeats(keyed, 60, 16).collect()
    assert {(r["doc_id"], tuple(bwt_repeats._merged(r["spans"]))) for r in few} == {(r["doc_id"], tuple(bwt_repeats._merged(r["spans"]))) for r in many}


def test_repeats_without_broadcast(make, monkeypatch):
    monkeypatch.setattr(bwt_repeats, "BROADCAST_ROWS", 0)
    texts = repeats_fixture()[:20]
    found = bwt_repeats.without_repeats(make(list(enumerate(texts))), length=60, k=16).collect()
    _, gone = brute_repeats(texts, 60)
    assert {r["doc_id"]: r["n_removed"] for r in found} == {i: int(g.sum()) for i, g in enumerate(gone)}


def test_repeats_of_an_empty_table(make):
    assert bwt_repeats.without_repeats(make([])).count() == 0


def test_blocks_do_not_change_anchors():
    data = " ".join(words_of(300, s) for s in range(3)).encode() + b"a" * 500
    whole = bwt_repeats.anchors(data, 60, 16)
    for block in (1, 37, 1000):
        assert all((a == b).all() for a, b in zip(whole, bwt_repeats.anchors(data, 60, 16, block)))


def test_many_equal_rows_are_held_once(make, monkeypatch):
    """A row that repeats adds neither kinds to an anchor nor ranges to its class; distances beyond 16 bits are refused."""
    shared = words_of(20, 1)
    pairs = [(1, words_of(20, 2) + shared)] * 3000 + [(2, shared + words_of(20, 3)), (3, "plain")]
    docs = make(pairs, 4).selectExpr("doc_id", "xxhash64(text) AS text_key", "text")
    spans = {r["doc_id"]: r["spans"] for r in bwt_repeats.repeats(docs, 60, 16).collect()}
    assert set(spans) == {1, 2} and len(spans[1]) == len({(s["a"], s["b"]) for s in spans[1]})
    found = bwt_repeats.without_repeats(make(pairs, 4), length=60, k=16).collect()
    assert {(r["doc_id"], r["n_removed"] == r["n_bytes"], r["n_removed"] > 0) for r in found} == {(1, True, True), (2, False, True), (3, False, False)}
    with pytest.raises(ValueError):
        bwt_repeats.without_repeats(make(pairs, 4), length=70_000)


# SimHash


def brute_simhash(text):
    found = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
    parts = [b" ".join(found[i : i + 3]) for i in range(len(found) - 2)] if len(found) >= 3 else [b" ".join(found)] if found else []
    bits = 0
    for b in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(p, 42) >> b & 1 for p in parts) > len(parts):
            bits |= 1 << b
    return bits


def brute_components(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_equal_brute_force(make):
    r = random.Random(1)
    texts = [words_of(r.randrange(1, 200), s) for s in range(60)]
    for t in texts[:25]:
        for _ in range(3):
            w = t.split()
            w[r.randrange(len(w))] = "Changed"
            texts.append(" ".join(w))
    texts += [None, "", " \t\n", "One", "one", "one two", "ONE TWO", "Émile É", texts[0], texts[0]]
    found = {x["doc_id"]: x for x in simhash.near_duplicates(make(list(enumerate(texts)))).collect()}
    prints = [brute_simhash(t) for t in texts]
    assert [found[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [found[i]["component_id"] for i in range(len(texts))] == brute_components(prints, 3)


@pytest.mark.parametrize("max_group", [8192, 8])
def test_links_of_dense_and_hot_groups(spark, max_group):
    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(30)]
    prints = set(centres)
    for _ in range(700):
        p = r.choice(centres[:4])
        for _ in range(r.randrange(1, 7)):
            p ^= 1 << r.randrange(64)
        prints.add(p)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "bits bigint"), max_group=max_group).collect()
    assert all(((x["a"] ^ x["b"]) % 2**64).bit_count() <= 3 for x in found)
    at = {p: i for i, p in enumerate(signed)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in found:
        a, b = find(at[x["a"]]), find(at[x["b"]])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(prints))] == brute_components(prints, 3)


def five_words(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set()


def brute_near(texts, radius=12):
    """Components over pairs of five-word Jaccard similarity of 0.8 or more whose fingerprints are within the radius."""
    prints, sets = [brute_simhash(t) for t in texts], [five_words(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_representatives_of_near_copies(make):
    """Copies with a few changed words go, texts that share less stay; verification drops links of fingerprints alone."""
    r = random.Random(8)
    texts = [words_of(r.randrange(30, 200), 1000 + s) for s in range(40)]
    for t in texts[:30]:
        for changes in (1, 2, 3, 12):
            w = t.split()
            for _ in range(changes):
                w[r.randrange(len(w))] = f"changed{r.randrange(99)}"
            texts.append(" ".join(w))
    texts += [None, "", " \t", "one", "ONE", texts[0], texts[0]]
    kept = simhash.representatives(make(list(enumerate(texts)))).collect()
    classes = brute_near(texts)
    kept = sorted(int(k["row_key"].split(":")[0]) for k in kept)
    assert kept == sorted({classes.index(c) for c in classes})
    sets = [five_words(t) for t in texts]
    similar = [(i, j) for i in range(160) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum(classes[i] == classes[j] for i, j in similar) >= 0.9 * len(similar)


def test_near_duplicates_of_odd_rows(make):
    assert simhash.near_duplicates(make([])).count() == 0
    found = simhash.near_duplicates(make([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "z y")])).collect()
    assert sorted((x["doc_id"] or -1, x["component_id"] or -1) for x in found) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def test_components(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 50)]
    loose = [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    edges = [*chain, *star, *loose, (7, 7), (3, 2), (None, 5)]
    found = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert found == {i: find(i) for i in root}
    assert common.components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


# I-Match


@pytest.mark.parametrize("buckets", [1, 5, 40])
def test_every_text_meets_its_successor(make, buckets):
    texts = [words_of(n, n) for n in range(1, 40)] + [None, "", "A"]
    found = {r["doc_id"]: r for r in imatch.compared(make([(7 * i - 20, t) for i, t in enumerate(texts)]), buckets=buckets).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        row = found[7 * i - 20]
        assert (row["n_chars"], row["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert row["near_next"] == (1.0 if row["fingerprint"][:16] == found[7 * ((i + 1) % len(texts)) - 20]["fingerprint"][:16] else row["near_next"])
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1


def test_fingerprints_of_equal_and_odd_rows(make):
    text = words_of(80, 5)
    pairs = [(1, text), (1, text), (None, text), (2, None), (3, ""), (None, None), (9, "other")]
    found = imatch.compared(make(pairs)).collect()
    assert len(found) == len(pairs)
    assert len({r["fingerprint"] for r in found if r["n_chars"] == len(text)}) == 1 < len({r["fingerprint"] for r in found})
    plain = imatch.fingerprints(make(pairs)).collect()
    assert Counter(r["fingerprint"] for r in plain) == Counter(r["fingerprint"] for r in found)
    assert imatch.compared(make([])).count() == 0
    only = imatch.compared(make([(5, "abc def")])).first()
    assert only["near_next"] == 1.0 and only["edited_sha256"] == hashlib.sha256(b"abc abc").hexdigest()


def test_ids_shared_by_many_texts_fill_several_ranges(make):
    """A third of the rows have no id, a third share one: successors as in one sorted list, no range holds them all."""
    pairs = [(None, f"n{i} " + words_of(5, i)) for i in range(60)] + [(4, f"f{i} " + words_of(6, i)) for i in range(60)] + [(i, words_of(7, i)) for i in range(60)]
    pairs += [(4, "same text")] * 5 + [(None, None)] * 3
    docs = common.documents_of(make(pairs))
    ranges = imatch.beside_next(docs, 12).where("not peek").groupBy("bucket").count().collect()
    assert len(ranges) > 9 and max(r["count"] for r in ranges) < 45
    listed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    listed = sorted(listed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    want = Counter()
    for row, after in zip(listed, [*listed[1:], listed[0]]):
        half = len(row["text"]) // 2
        changed = row["text"][: len(row["text"]) - half] + after["text"][:half]
        want[row["doc_id"], len(row["text"]), hashlib.sha256(changed.encode()).hexdigest()] += 1
    found = imatch.compared(make(pairs), buckets=12).select("doc_id", "n_chars", "edited_sha256").collect()
    assert Counter(tuple(r) for r in found) == want


def brute_print(text, lexicon):
    """Fingerprint by the definition, a term and a subset at a time: (whole, hash or None of every subset)."""
    full, own = 2**64, sorted(set(common.words(text)) & lexicon)
    if not own:
        return xxhash.xxh64_intdigest(b" ".join(sorted(set(common.words(text))))), [0] * 80
    ids = [xxhash.xxh64_intdigest(t, 1) for t in own]

    def drawn(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % full
        x = (x ^ x >> 27) * 0x94D049BB133111EB % full
        return x ^ x >> 31

    signs = []
    for subset in range(80):
        rate = (8, 32, 128, 512, 2048)[subset // 16]
        held = [i for i in ids if drawn((i + (1000 + subset) * 0x9E3779B97F4A7C15) % full) % rate == 0]
        signs.append(xxhash.xxh32_intdigest(b"".join(i.to_bytes(8, "little") for i in held)) % 65535 + 1 if held else 0)
    return xxhash.xxh64_intdigest(b"".join(i.to_bytes(8, "little") for i in ids), 7), signs


def test_fingerprints_and_likeness_equal_their_definition(make):
    texts = [words_of(40 + 9 * s, s, 300) for s in range(30)] + ["", "unseen", "all in all", None]
    texts = [f"all {t}" if t else t for t in texts] + [words_of(40, 0, 300)]
    seen = Counter(w for t in texts for w in set(common.words(t)))
    lexicon = {w for w, n in seen.items() if 0.05 * len(texts) <= n <= 0.6 * len(texts)}
    found = {r["doc_id"]: r for r in imatch.compared(make(list(enumerate(texts))), min_share=0.05, max_share=0.6).collect()}

    def alike(a, b):
        if a[0] == b[0]:
            return 1.0
        used = [(x, y) for x, y in zip(a[1], b[1]) if x or y]
        return sum(x == y for x, y in used) / len(used) if used else 0.0

    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        own, other, following = (brute_print(t, lexicon) for t in (text, text[: len(text) - half] + after[:half], after))
        shown = [f"{p[0]:016x}" + "".join(f"{x:04x}" for x in p[1]) for p in (own, other)]
        assert [found[i]["fingerprint"], found[i]["edited_fingerprint"]] == shown
        assert (found[i]["near_edited"], found[i]["near_next"]) == (pytest.approx(alike(own, other)), pytest.approx(alike(own, following)))


def test_band_of_the_lexicon(make):
    docs = make([(i, f"all half{'x' if i % 2 else 'y'} own{i}") for i in range(40)])
    assert imatch.lexicon(docs, 0.1, 0.6) == [b"halfx", b"halfy"]
    with pytest.raises(ValueError):
        old, imatch.MAX_LEXICON = imatch.MAX_LEXICON, 3
        try:
            imatch.lexicon(docs, 0.0, 1.0)
        finally:
            imatch.MAX_LEXICON = old


def test_edited_texts_are_nearer_than_others(make):
    texts = [words_of(300, s, 4000) for s in range(60)]
    found = imatch.compared(make(list(enumerate(texts))), min_share=0.0).collect()
    assert np.mean([r["near_edited"] for r in found]) > 5 * np.mean([r["near_next"] for r in found])


# Winnowing


def brute_hits(text, items, span=10):
    found = common.words(text)
    hit, names = np.zeros(len(found), bool), set()
    for name, item in items:
        w = common.words(item)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for p in range(len(found) - n + 1):
                if found[p : p + n] == w[i : i + n]:
                    hit[p : p + n] = True
                    if name is not None:
                        names.add(name)
    return len(found), int(hit.sum()), sorted(names)


def leaks():
    r = random.Random(6)
    items = [(f"i{k}", words_of(r.randrange(8, 40), 1000 + k, 50)) for k in range(25)]
    items += [("short", "a1é b2é"), ("one", "Zebra"), ("none", "!!"), ("null", None), (None, words_of(15, 1)), ("rep", "x " * 30), ("i0", words_of(12, 77))]
    docs = []
    for d in range(40):
        w = words_of(r.randrange(5, 120), d, 50).split()
        _, item = r.choice(items[:25])
        item = item.split()
        a = r.randrange(len(item))
        w[len(w) // 2 : len(w) // 2] = item[a : a + r.randrange(6, 30)]
        docs.append(" ".join(w))
    docs += [None, "", "...", "ZEBRA, x", "x " * 9, "X; x " * 20, words_of(15, 1).upper(), items[3][1] + " " + items[4][1], "a1é B2É a1é b2é"]
    return docs, items


@pytest.mark.parametrize("max_rows, block", [(sizing.MAX_ROWS, winnowing.BLOCK_WORDS), (0, 40)])
def test_hits_equal_brute_force(spark, make, monkeypatch, max_rows, block):
    monkeypatch.setattr(winnowing, "BLOCK_WORDS", block)
    docs, items = leaks()
    pairs = [*enumerate(docs), (3, docs[3]), (None, docs[7])]
    table = spark.createDataFrame(items, "item_id string, text string")
    found = winnowing.contaminated(make(pairs), table, max_rows=max_rows).collect()
    want = []
    for i, t in pairs:
        n, hit, names = brute_hits(t, items)
        want.append((i, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found)
    marks = winnowing.marked(make(pairs), table, max_rows=max_rows).select("doc_id", "_contaminated").collect()
    assert sorted(map(str, ((w[0], w[5]) for w in want))) == sorted(str(tuple(r)) for r in marks)


def test_hits_of_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id string, text string")
    assert winnowing.contaminated(make([]), none).count() == 0
    row = winnowing.contaminated(make([(1, "a b c")]), none).first()
    assert tuple(row) == (1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)


def test_a_passage_that_many_items_and_texts_share(spark, make):
    """A third of the texts are copies, and a passage lies in every item: equal items meet the texts once."""
    shared, copy = words_of(14, 5), words_of(40, 6)
    items = [("a", f"{shared} {words_of(9, 7)}")] * 3 + [(f"b{i}", f"{words_of(9, 8)} {shared}") for i in range(40)] + [("c", copy), ("d", copy)]
    docs = [copy] * 60 + [f"{words_of(30, 100 + i)} {shared} x" for i in range(60)] + [words_of(50, 300 + i) for i in range(60)]
    found = {r["doc_id"]: r for r in winnowing.hits(make(list(enumerate(docs))), spark.createDataFrame(items, "item_id string, text string")).collect()}
    for i, text in enumerate(docs):
        assert (found[i]["n_words"], found[i]["n_hit"], found[i]["items"]) == brute_hits(text, items)
        assert sum(b - a for a, b in zip(found[i]["starts"], found[i]["ends"])) == found[i]["n_hit"]


def test_only_measured_sides_are_broadcast(spark, make):
    docs, items = leaks()
    table = spark.createDataFrame(items, "item_id string, text string")
    for bound, hinted in ((0, False), (sizing.MAX_ROWS, True)):
        plan = winnowing.hits(make(list(enumerate(docs))), table, max_rows=bound)._jdf.queryExecution().toString()
        assert ("strategy=broadcast" in plan) == hinted
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
