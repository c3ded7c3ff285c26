"""SimHash fingerprints and their links within a Hamming radius, found with pivot distance tables.

Every fingerprint gets its Hamming distances to many reference fingerprints (pivots). By the triangle inequality two
fingerprints within ``radius`` differ by at most ``radius`` in every coordinate, so pairs with a larger maximum
coordinate difference are discarded from the table alone and only the survivors are compared bit by bit.
Fingerprints meet under keys of unchanged bits: of five blocks of bits at least two are equal for three changed bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from churnspark.llm.common import arrow_rows, components, documents_of
from churnspark.operators.sizing import fits
from churnspark.session import materialize

RADIUS = 3
PIVOTS = 24
#: Fingerprints of one key that are compared in one task; larger groups are dealt out as pairs of parts.
MAX_GROUP = 8192
#: Bytes of shingles of one key that are compared in one task, as above.
MAX_GROUP_BYTES = 64 * 1024 * 1024
#: Near copies: words of a shingle, least Jaccard similarity, and the radius within which their fingerprints lie.
NEAR_WORDS, NEAR_SIMILARITY, NEAR_RADIUS = 5, 0.8, 12
#: Keys under which near copies meet, each of two least hashes of the fingerprint's shingles.
NEAR_KEYS = 8


def shingles(text: str, width: int = 3) -> list[bytes]:
    """Word shingles, repeats included; the whole sequence if there are fewer words, none if there is no word."""
    found = text.encode().lower().split()
    if len(found) <= width:
        return [b" ".join(found)] if found else []
    return [b" ".join(s) for s in zip(*(found[i:] for i in range(width)))]


def simhash(text: str, width: int = 3) -> int:
    """Unsigned fingerprint: a bit is 1 if it is set in over half the shingles' XXH64 (seed 42)."""
    digest = xxhash.xxh64_intdigest
    parts = shingles(text, width)
    return _fingerprint(np.fromiter((digest(s, 42) for s in parts), np.uint64, len(parts)))


def _fingerprint(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, bits): the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("bits", pa.int64())])

    def rows(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield doc, _signed(simhash(text.as_py(), width))

    return documents.mapInArrow(arrow_rows(schema, rows), "doc_id bigint, bits bigint")


def pivots(n: int = PIVOTS, seed: int = 5) -> np.ndarray:
    """Reference fingerprints, drawn by rule."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed) for i in range(n)], np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two ascending arrays without repeats; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least, most = sorted((len(a), len(b)))
    both = np.intersect1d(a, b, assume_unique=True).size if least >= NEAR_SIMILARITY * most else 0
    return both / (least + most - both)


def linked(prints: np.ndarray, table: np.ndarray, radius: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Spanning links of the members of one group: at most one per member, not all pairs. With ``sets``, survivors must
    be similar as well."""
    out, rest = [], np.arange(len(prints))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            apart = np.abs(table[rest] - table[x]).max(axis=1)  # maximum coordinate difference
            near = np.flatnonzero(apart <= radius)
            near = near[np.bitwise_count(prints[rest[near]] ^ prints[x]) <= radius]
            if sets:
                near = np.array([y for y in near if jaccard(sets[x], sets[rest[y]]) >= NEAR_SIMILARITY], np.int64)
            if len(near):
                new = rest[near].tolist()
                out += [(x, y) for y in new]
                queue += new
                rest = np.delete(rest, near)
    return out


def _block_masks(radius: int, extra: int = 2) -> list[int]:
    """Masks that keep ``extra`` of radius + extra blocks of bits; one of them covers no changed bit."""
    n = radius + extra
    cuts = [64 * i // n for i in range(n + 1)]
    block = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(n)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(n), extra)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def with_table(prints: DataFrame) -> DataFrame:
    """Add ``table``: the Hamming distances of ``bits`` to the pivots."""
    distances = [F.bit_count(F.col("bits").bitwiseXOR(F.lit(_signed(int(p))))).cast("tinyint") for p in pivots()]
    return prints.withColumn("table", F.array(*distances))


def links(prints: DataFrame, radius: int = RADIUS, max_group: int = MAX_GROUP) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints (column ``bits``) at ``radius`` or fewer differing bits.

    Every pair within the radius is connected through the links.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("bits").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(_block_masks(radius))])
    table = materialize(with_table(prints.select("bits").distinct()), "prints")
    return group_links(table.select("bits", "table", F.col("bits").alias("node"), F.inline(masks)), radius, max_group)


def group_links(keyed: DataFrame, radius: int, max_group: int = MAX_GROUP) -> DataFrame:
    """Spanning links (a, b) of nodes that meet under a key, from (mask, key, node, bits, table) and, if links are to hold
    between similar texts only, their hashed shingles, ascending without repeats.

    A group of nodes under one key that exceeds ``max_group`` (or, with shingles, MAX_GROUP_BYTES) is dealt by a hash
    into parts, and every pair of parts is one bounded group of its own.
    """
    verified = ["shingles"] if "shingles" in keyed.columns else []
    size = F.sum(F.size("shingles") * F.lit(8)) if verified else F.lit(0)
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n"), size.alias("bytes"))
    fill = F.greatest(F.col("n") / max_group, F.col("bytes") / MAX_GROUP_BYTES)
    sizes = sizes.where("n > 1").select("mask", "key", F.when(fill > 1, F.ceil(2 * fill)).otherwise(1).cast("int").alias("parts"))
    sized = keyed.join(sizes, ["mask", "key"])
    part = F.pmod(F.xxhash64("node", F.lit(11)), F.col("parts")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")),
    )
    dealt = sized.withColumn("part", part).select("mask", "key", "node", "bits", "table", *verified, F.inline(others))
    group = ["mask", "key", "i", "j"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches):
        held, parts = None, []  # a group may go on in the next batch
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i), np.int64) for i in range(4)])
            nodes, bits = (np.asarray(batch.column(i), np.int64) for i in (4, 5))
            if not len(nodes):
                continue
            table = np.asarray(batch.column(6).flatten(), np.int8).reshape(len(nodes), -1)
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(nodes)]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(keys[:, a].tolist())
                if key != held:
                    yield from spanning(parts)
                    held, parts = key, []
                sets = [np.asarray(batch.column(7)[x].values, np.int64) for x in range(a, b)] if verified else []
                parts.append((nodes[a:b], bits[a:b], table[a:b], sets))
        yield from spanning(parts)

    def spanning(parts):
        if sum(len(p[0]) for p in parts) > 1:
            nodes, bits, table = (np.concatenate([p[i] for p in parts]) for i in range(3))
            sets = [one for p in parts for one in p[3]]
            for x, y in linked(bits.view(np.uint64), table, radius, sets):
                yield int(nodes[x]), int(nodes[y])

    return (
        dealt.repartition(*group)
        .sortWithinPartitions(*group)
        .select(*group, "node", "bits", "table", *verified)
        .mapInArrow(arrow_rows(schema, rows, 65536), "a bigint, b bigint")
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    ``component_id`` is the smallest id reachable over links of ``radius`` or fewer differing bits, the row's own
    included. Texts without a word (null, empty, white space) have fingerprint 0 and are linked like any other.
    Rows with equal fingerprints are one node, so copies are never paired; a null id takes part, and a group whose
    ids are all null has a null component. An empty table gives no rows.
    """
    prints = materialize(fingerprints(documents_of(df, id_col, text_col), width), "simhash")
    smallest = prints.groupBy("bits").agg(F.min("doc_id").alias("least"))
    joined = components(links(prints, radius))
    members = joined.join(smallest, joined["node"] == smallest["bits"]).select("node", "component", "least")
    least = members.groupBy("component").agg(F.min("least").alias("linked_id"))
    linked_least = members.join(least, "component").select(F.col("node").alias("bits"), "linked_id")
    classes = smallest.join(linked_least, "bits", "left").select("bits", F.coalesce("linked_id", "least").alias("component_id"))
    # Written before the join: between two plain exchanges Spark can split the fingerprint of a large group of copies.
    classes = materialize(classes, "classes")
    return prints.join(classes, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """A string that two rows share only if they share id (null is one of its own) and text (null is empty)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return F.concat_ws(":", F.col(f"`{id_col}`").cast("bigint").cast("string"), F.md5(text.cast("binary")))


def _met(documents: DataFrame, width: int) -> DataFrame:
    """(row_key, doc_id, node, bits, keys) of rows (row_key, doc_id, node, text); a node is a text."""
    factors = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 6) | 1 for i in range(2 * NEAR_KEYS)], np.uint64)
    schema = pa.schema([("row_key", pa.string()), ("doc_id", pa.int64()), ("node", pa.int64()), ("bits", pa.int64()), ("keys", pa.list_(pa.int64()))])
    digest = xxhash.xxh64_intdigest

    def rows(batches):
        for batch in batches:
            for key, doc, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                parts = shingles(text.as_py(), width)
                hashes = np.fromiter((digest(s, 42) for s in parts), np.uint64, len(parts))
                least = [int((hashes * f).min()) for f in factors] if parts else [0] * len(factors)
                yield key, doc, node, _signed(_fingerprint(hashes)), [a ^ b for a, b in zip(map(_signed, least[::2]), map(_signed, least[1::2]))]

    return documents.mapInArrow(arrow_rows(schema, rows), "row_key string, doc_id bigint, node bigint, bits bigint, keys array<bigint>")


def _word_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the hashes of a text's word shingles, ascending without repeats."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    digest = xxhash.xxh64_intdigest

    def rows(batches):
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = shingles(text.as_py(), words)
                yield node, np.unique(np.fromiter((digest(s, 42) for s in parts), np.uint64, len(parts)).view(np.int64))

    return texts.select("node", "text").mapInArrow(arrow_rows(schema, rows, 256), "node bigint, shingles array<bigint>")


def near_texts(nodes: DataFrame, texts: DataFrame, radius: int = NEAR_RADIUS, words: int = NEAR_WORDS) -> DataFrame:
    """(node, component) of texts that have a near copy, from nodes (node, bits, keys) and rows (node, text).

    Links are between texts of a ``words``-word Jaccard similarity of NEAR_SIMILARITY or more whose fingerprints are
    within ``radius``. Fingerprints that meet under a key give coarse components first; in them, links are found again
    between the texts themselves, so a pair that is not similar never stands for one that is.
    """
    table = materialize(with_table(nodes.select("node", "bits", "keys")), "near-prints")
    keyed = table.select("node", "bits", "table", F.posexplode("keys").alias("mask", "key"))
    coarse = materialize(components(group_links(keyed, radius)), "near-coarse")
    needed = F.broadcast(coarse) if fits(coarse, 1_000_000) else coarse
    sets = _word_sets(texts.join(needed, "node", "left_semi").dropDuplicates(["node"]), words)
    members = table.join(coarse, "node").join(sets, "node")
    placed = members.select(F.lit(0).alias("mask"), F.col("component").alias("key"), "node", "bits", "table", "shingles")
    return components(group_links(materialize(placed, "near-members"), radius))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(row_key): one for each component of near copies, that of its row with the smallest (doc_id, row_key).

    Components are those of texts (``near_texts``), so rows that share an id, or have none, are apart unless their texts
    are near. A null id is taken only if the component has no other.
    """
    documents = documents_of(df, id_col, text_col)
    keyed = documents.select(row_key().alias("row_key"), "doc_id", F.xxhash64("text").alias("node"), "text")
    prints = materialize(_met(keyed, width), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    nodes = materialize(prints.groupBy("node").agg(first, F.min("bits").alias("bits"), F.min("keys").alias("keys")), "near-nodes")
    joined = near_texts(nodes.select("node", "bits", "keys"), documents.select(F.xxhash64("text").alias("node"), "text"))
    classes = nodes.join(joined, "node", "left").select(F.coalesce("component", "node").alias("class"), "first")
    return classes.groupBy("class").agg(F.min("first").alias("first")).select("first.row_key")
