"""Importance resampling and token counts against plain computations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from churnspark.llm import queries, resampling, token_cache

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(x.encode()) % 10_000 for x in [*w, *map(" ".join, zip(w, w[1:]))]]


def resample(pairs, target, percent=25):
    rows = [(i, *features(t)) for i, t in pairs]
    s, t = Counter(), Counter()
    for _, _, f in rows:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    pool = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = pool[: percent * len(pool) // 100]
    return out, [(k + 1, *r) for k, r in enumerate(drawn)]


def some_text(r, n):
    return " ".join(r.choice(("Été", "data", "MODEL", "x1", "日本")) + str(r.randrange(30)) + r.choice(("", ",", " -")) for _ in range(n))


def some_pairs():
    r = random.Random(5)
    pairs = [(i, some_text(r, r.randrange(0, 60))) for i in range(300)]
    return pairs + [(300, None), (301, ""), (None, some_text(r, 30)), (None, None), (302, "a" * 3_000_000), (303, "word " * 400_000), (5, pairs[5][1])]


COLUMNS = ["doc_id", "n_words", "n_features", "weight", "score"]


@pytest.mark.parametrize("segment_rows", [1_000_000, 40, 3])
def test_resampling_equals_sorting(spark, make, segment_rows):
    pairs = some_pairs()
    target = [some_text(random.Random(9), 50), None, "MODEL1 model1"]
    found = resampling.resampled(make(pairs), spark.createDataFrame([(t,) for t in target], "text string"), segment_rows=segment_rows).collect()
    rows, drawn = resample(pairs, target)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in found) == Counter(rows)
    assert sorted((r["rank"], *(r[c] for c in COLUMNS)) for r in found if r["rank"]) == drawn


def test_ranks_of_equal_rows_are_split(spark):
    """A third of all rows share score and id: ranks stay gapless and splitters fall between them."""
    rows = [(10, 1)] * 2000 + [(s % 50, s) for s in range(4000)]
    df = spark.createDataFrame([(s, d, k) for k, (s, d) in enumerate(rows)], "score bigint, doc_id bigint, tie bigint").repartition(7)
    found = resampling.ranked(df, segment_rows=200).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 6001))
    want = sorted(range(6000), key=lambda k: (-rows[k][0], rows[k][1], k))
    assert [r["tie"] for r in sorted(found, key=lambda r: r["rank"])] == want


def test_many_short_runs_are_sampled(spark, tmp_path):
    """Runs far shorter than the distance of samples still give splitters."""
    spark.range(4000).selectExpr("id * 7919 % 4001 AS score", "id AS doc_id", "id AS tie").repartition(40).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    found = resampling.ranked(df, segment_rows=2000, samples=1)
    assert [r["score"] for r in found.orderBy("rank").collect()] == sorted((k * 7919 % 4001 for k in range(4000)), reverse=True)


def test_blocks_of_a_text_do_not_change_its_features():
    text = some_text(random.Random(1), 500)
    whole = sorted(np.concatenate(list(resampling.feature_buckets(text))))
    for block in (1, 7, 100):
        assert sorted(np.concatenate(list(resampling.feature_buckets(text, block=block)))) == whole == sorted(features(text)[1])


def test_resampling_of_nothing(spark, make):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resampled(make([], 1), nothing).count() == 0
    found = resampling.resampled(make([(1, "few words"), (2, None)]), nothing).collect()
    assert [r["rank"] for r in found] == [None, None]


# Token counts


def library(name):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(token_cache.public_tokenizers.path(name))
    return lambda text: len(made.encode(text or "", add_special_tokens=False))


ODD = ["", None, "x", "<|endoftext|> a<|endoftext|>", " \n\n  a", "日本語 " * 50, "é é", "A" * 70_000, "don't 've", "\0\x1c a b", "many small words " * 40_000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(make, name):
    texts = [t for t in ODD if t is None or len(t) < 100_000 or not name.endswith(".model")]
    pairs = [*enumerate(texts), (None, "null id"), (3, texts[3]), (3, "other"), *[(50 + i, "a copy of one text") for i in range(300)]]
    found = token_cache.token_counts(make(pairs), tokenizer=name, limit=20).collect()
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=token_cache.public_tokenizers.path(name))
        count = lambda t: len(model.encode(t or ""))
    else:
        count = library(name)
    want = [(i, len((t or "").encode()), count(t), count(t) > 20) for i, t in pairs]
    assert Counter(map(tuple, found)) == Counter(want)


def test_long_white_space(make):
    texts = [" " * 2_000_000, "a" + "\n" * 1_000_000 + "b"]
    found = {r["doc_id"]: r["n_tokens"] for r in token_cache.token_counts(make(enumerate(texts))).collect()}
    assert found == dict(enumerate(map(library(token_cache.TOKENIZER), texts)))


def test_parts_join_and_add_up():
    count, divisible = token_cache.counter()
    assert divisible
    text = "words of a text, 12 and  more\n " * 300
    cut = list(token_cache.parts(text, 64))
    assert "".join(cut) == text and len(cut) > 50
    assert sum(count(cut)) == count([text])[0] == list(token_cache._counts(iter([text]), token_cache.TOKENIZER, 64))[0]


def test_only_misses_are_encoded(spark, make, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    first = [(i, f"text {i % 20}") for i in range(100)]
    token_cache.token_counts(make(first), cache).count()
    assert spark.read.parquet(cache).count() == 20
    asked = []
    encoded = token_cache.encoded
    monkeypatch.setattr(token_cache, "encoded", lambda texts, *more: encoded(_seen(texts, asked), *more))
    both = first + [(200 + i, f"new text {i % 3}") for i in range(30)]
    for max_rows in (200_000, 0):  # few misses, and more than are sent to every task
        more = both + [(900, f"only {max_rows}")]
        found = token_cache.token_counts(make(more), cache, max_rows=max_rows).collect()
        assert Counter((r["doc_id"], r["n_tokens"]) for r in found) == Counter((i, library(token_cache.TOKENIZER)(t)) for i, t in more)
    assert asked == [["new text 0", "new text 1", "new text 2", "only 200000"], ["only 0"]]
    # Another version of the tokenizer finds nothing; counts that were appended twice do not matter.
    monkeypatch.setattr(token_cache, "version", lambda tokenizer: "other")
    assert token_cache.token_counts(make(first), cache).count() == 100
    spark.read.parquet(cache).where("tokenizer = 'other'").write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert token_cache.token_counts(make(first), cache).count() == 100


def _seen(texts, asked):
    asked.append(sorted(r["text"] for r in texts.collect()))
    return texts


def test_counts_of_nothing(make, tmp_path):
    assert token_cache.token_counts(make([], 1), str(tmp_path / "cache")).count() == 0


def test_queries(spark, make, folder):
    pairs = [(i, some_text(random.Random(i), 25)) for i in range(40)]
    conversations = spark.createDataFrame([(1, 0, "user", "hi.")], "conv_id bigint, turn bigint, role string, text string")
    path = folder(documents=make(pairs), benchmark=spark.createDataFrame([("i", "data1 model2")], "item_id string, text string"), conversations=conversations)
    for name in ("op11_prefix_doubling", "op12_regular_sampling", "op13_digest_cache"):
        assert queries.QUERIES[name](spark, path).count() == (1 if name.startswith("op11") else 40)
