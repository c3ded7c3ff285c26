"""Impact-ordered postings, and a threshold search that skips the blocks which cannot enter the best k.

The postings of a term are put into levels of falling weight (a level spans half a power of two) and a level into blocks
of bounded size. A search takes four steps:

1. The levels that contribute most give partial sums; the k-th best of a question is a first threshold.
2. A level is read only if its contribution reaches the threshold divided by the question's terms: what all skipped
   levels could add together stays below the threshold, so a text met in none of the read levels cannot be among the
   best. Sums of the read levels raise the threshold; texts whose upper bound stays below it go.
3. Texts that are left take what the skipped levels add to them, which makes their sums whole.
4. The best k by these sums are scored from the postings by text.

Postings are dealt by text as they are stored, and meet the questions where they arrive, so a posting is shuffled once
however many questions have its term, and a sum of a question and a text not at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from churnspark.operators import index as I
from churnspark.operators.index import TextIndex, best_first, question_terms, saturation
from churnspark.operators.ranking import top_per_group
from churnspark.operators.sizing import fits
from churnspark.session import materialize

#: Levels of weights per power of two.
PER_OCTAVE = 2
#: Mean postings of a block.
BLOCK = 1024
#: Levels of more than one block that are sent to every task.
LARGE_ROWS = 1_000_000
#: Postings per wanted text that the first step reads for a question.
FIRST = 100
#: Scores are compared to nine decimals; bounds are kept apart from them by more.
MARGIN = 2e-9


@dataclass(frozen=True)
class ImpactIndex:
    """``blocks`` (term, level, part, n, top, entries): the postings of a level as arrays of keys and weight, their number
    and their largest weight; a written table."""

    index: TextIndex
    blocks: DataFrame

    def levels(self, terms: DataFrame) -> DataFrame:
        """(term, level, n, parts, top): the size and the largest weight of each level of these terms (term)."""
        blocks = self.blocks.select("term", "level", "part", "n", "top").join(_small(terms.select("term").distinct()), "term", "left_semi")
        parts = (F.max("part") + 1).alias("parts")
        return blocks.groupBy("term", "level").agg(F.sum("n").alias("n"), parts, F.max("top").alias("top"))


def _small(df: DataFrame) -> DataFrame:
    """A side of a join, broadcast if measured small."""
    return F.broadcast(df) if fits(df) else df


def _level(weight: Column) -> Column:
    return F.floor(-F.log2(weight) * PER_OCTAVE).cast("int")


def order(index: TextIndex, block: int = BLOCK) -> ImpactIndex:
    """Write the postings of an index by term and impact.

    The postings of a term that has no more of them than a block are brought together and put into levels there. Of other
    terms, a level is a group of its own, is counted before and is dealt by a hash into blocks, so the postings of the
    most frequent term are never in one task or one row.
    """
    level = _level(F.col("weight")).alias("level")
    postings = index.postings.select(*index.keys, "term", "weight", level)
    often = index.terms.where(F.col("df") > block).select("term")
    counted = postings.select("term", "level").join(_small(often), "term", "left_semi").groupBy("term", "level").agg(F.count("*").alias("n"))
    large = materialize(counted.where(F.col("n") > block).select("term", "level", F.ceil(F.col("n") / block).cast("int").alias("parts")), "levels")
    # Up to 64 MB: without it, all postings would be shuffled once more.
    sent = F.broadcast(large) if fits(large, max_rows=LARGE_ROWS) else large
    levels = postings.join(_small(often.withColumn("often", F.lit(True))), "term", "left").join(sent, ["term", "level"], "left")
    part = F.coalesce(F.pmod(F.xxhash64(*index.keys), F.col("parts")).cast("int"), F.lit(0))
    dealt = levels.withColumn("part", part).withColumn("dealt", F.when(F.col("often"), F.col("level")))
    packed = dealt.groupBy("term", "dealt", "part").agg(F.collect_list(F.struct(*index.keys, "weight")).alias("e"))
    found = F.array_distinct(F.transform("e", lambda e: _level(e["weight"])))
    parted = F.transform(found, lambda v: F.struct(v.alias("level"), F.filter("e", lambda e: _level(e["weight"]) == v).alias("entries")))
    whole = F.array(F.struct(F.col("dealt").alias("level"), F.col("e").alias("entries")))
    rows = packed.select("term", "part", F.inline(F.when(F.col("dealt").isNull(), parted).otherwise(whole)))
    blocks = rows.select("term", "level", "part", F.size("entries").cast("bigint").alias("n"), F.array_max("entries.weight").alias("top"), "entries")
    return ImpactIndex(index, materialize(blocks, "blocks"))


def _met(impact: ImpactIndex, chosen: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """(keys, weight, slot): the postings of the chosen (term, level, slot) rows, once each."""
    slots = chosen.select("term", "level", "slot").distinct()
    rows = impact.blocks.join(_small(slots), ["term", "level"]).select("slot", F.inline("entries"))
    return rows if allowed is None else rows.join(_small(allowed), impact.index.keys[0], "left_semi")


def _first_sums(impact: ImpactIndex, chosen: DataFrame, ids: list[str], allowed: DataFrame | None) -> DataFrame:
    """(ids, keys, seen): sums of contributions in the first blocks of the chosen (ids, term, level, q_weight, first_parts)."""
    keys = impact.index.keys
    read = impact.blocks.join(_small(chosen), ["term", "level"]).where("part < first_parts")
    rows = read.select(*ids, "q_weight", F.inline("entries"))
    if allowed is not None:
        rows = rows.join(_small(allowed), keys[0], "left_semi")
    return rows.groupBy(*ids, *keys).agg(F.sum(F.col("q_weight") * F.col("weight")).alias("seen"))


def _reaching(impact: ImpactIndex, marked: DataFrame, bounds: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """(keys, found): per text the questions (q, seen, gap) that it can still be among the best of: its sum in the levels
    that are read, and what the skipped levels can add at most."""
    keys = impact.index.keys
    chosen = marked.where("read")
    dealt = _met(impact, chosen, allowed).repartition(*keys)
    met = dealt.join(_small(chosen.select("slot", "q", "q_weight", "cut")), "slot")
    sums = met.groupBy("q", *keys).agg(F.sum(F.col("q_weight") * F.col("weight")).alias("seen"), F.sum("cut").alias("spared"))
    open_cut = marked.dropDuplicates(["q", "term"]).groupBy("q").agg(F.sum("cut").alias("open")).join(bounds, "q", "left")
    rated = sums.join(_small(materialize(open_cut, "open")), "q").withColumn("gap", F.col("open") - F.col("spared"))
    kept = rated.where(F.coalesce(F.col("seen") + F.col("gap") >= F.col("bound") - MARGIN, F.lit(True)))
    # The gap is only a bound: rounded to a float, and up by more than that takes away.
    found = F.struct("q", "seen", (F.col("gap") * (1 + 1e-6) + MARGIN).cast("float").alias("gap"))
    return materialize(kept.groupBy(*keys).agg(F.collect_list(found).alias("found")), "sums")


def _whole_sums(impact: ImpactIndex, marked: DataFrame, reaching: DataFrame, raised: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """(q, keys, score): the sums over all levels, of the texts that still reach the raised threshold."""
    keys = impact.index.keys
    left = reaching.select(*keys, F.inline("found")).join(_small(raised), "q", "left")
    left = left.where(F.coalesce(F.col("seen") + F.col("gap") >= F.col("bound") - MARGIN, F.lit(True)))
    left = left.groupBy(*keys).agg(F.collect_list(F.struct("q", "seen")).alias("found"))
    skipped = marked.where("NOT read")
    more = _met(impact, skipped, allowed).groupBy(*keys).agg(F.collect_list(F.struct("slot", "weight")).alias("more"))
    none = F.lit(None)
    seen = F.transform("found", lambda e: F.struct(e["q"].alias("own"), e["seen"].alias("value"), none.cast("bigint").alias("slot")))
    added = F.transform(
        F.coalesce("more", F.array().cast("array<struct<slot:bigint,weight:double>>")),
        lambda e: F.struct(none.cast("bigint").alias("own"), e["weight"].alias("value"), e["slot"].alias("slot")),
    )
    rows = left.join(more, keys, "left").select(*keys, F.inline(F.concat(seen, added)))
    weights = _small(skipped.select("slot", F.col("q").alias("asking"), "q_weight"))
    met = rows.join(weights, "slot", "left").withColumn("q", F.coalesce("own", "asking"))
    value = F.when(F.col("own").isNotNull(), F.col("value")).otherwise(F.col("q_weight") * F.col("value"))
    sums = met.groupBy("q", *keys).agg(F.sum(value).alias("score"), F.count("own").alias("left"))
    return sums.where("left > 0").drop("left")


def _thresholds(sums: DataFrame, ids: list[str], keys: list[str], k: int, parents: bool) -> DataFrame:
    """(ids, bound): the k-th best sum of each question that has k; with ``parents`` the k-th best parent's."""
    if parents:
        sums = sums.groupBy(*ids, *keys[:-1]).agg(F.max("seen").alias("seen"))
    top = top_per_group(sums.select(*ids, "seen"), ids, [F.desc("seen")], k)
    return top.where(F.col("rank") == k).select(*ids, F.col("seen").alias("bound"))


def plan(impact: ImpactIndex, terms: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, term, q_weight, level, n, parts, gain): the levels of every question's terms; ``gain`` is their largest
    contribution."""
    return impact.levels(terms).join(_small(terms.select(*ids, "term", "q_weight")), "term").select(
        *ids, "term", "q_weight", "level", "n", "parts", (F.col("q_weight") * F.col("top")).alias("gain")
    )


def _numbered(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(columns, name): the distinct values with a number each, written."""
    return materialize(rows.select(*columns).distinct().withColumn(name, F.monotonically_increasing_id()), name)


def read_levels(planned: DataFrame, bounds: DataFrame, ids: list[str]) -> DataFrame:
    """The planned levels with ``read``, and ``cut``, the largest contribution of a level of the term that is skipped."""
    m = planned.groupBy(*ids).agg(F.countDistinct("term").alias("m")).join(bounds, ids, "left")
    needed = F.col("gain") >= (F.col("bound") - MARGIN) / F.col("m")
    marked = planned.join(_small(m), ids).withColumn("read", F.coalesce(needed, F.lit(True)))
    skipped = F.max(F.when(~F.col("read"), F.col("gain"))).over(W.partitionBy(*ids, "term"))
    return marked.withColumn("cut", F.coalesce(skipped, F.lit(0.0)))


def skipped(impact: ImpactIndex, marked: DataFrame) -> DataFrame:
    """One row: postings and blocks of all question terms, and how many of them were read."""
    read = lambda c: F.sum(F.when(F.col("read"), F.col(c)).otherwise(0)).alias(f"{c}_read")
    return marked.agg(F.sum("n").alias("n"), read("n"), F.sum("parts").alias("parts"), read("parts"))


def best(
    impact: ImpactIndex,
    asked: DataFrame,
    ids: list[str],
    k: int,
    parents: bool = False,
    allowed: DataFrame | None = None,
    report: list | None = None,
    worth: float = 1.0,
) -> DataFrame:
    """(ids, kind, keys, score, bm25, rank), as ``index.best`` gives them, by threshold search.

    ``allowed`` (first key) restricts the texts that can be found. ``report`` receives the levels with ``read``. A
    question with fewer than k texts reads all of its levels. Null and empty questions have no terms and no rows. The
    postings that this search reads are shuffled, so it pays only where it skips much: if the share of postings to be
    read exceeds ``worth``, the dense scoring of ``index.best`` gives the same rows.
    """
    index, keys = impact.index, impact.index.keys
    terms = materialize(question_terms(index, asked, ids), "question-terms")
    planned = materialize(plan(impact, terms, ids), "planned")
    before = F.sum("n").over(W.partitionBy(*ids).orderBy(F.desc("gain"), "term", "level").rowsBetween(W.unboundedPreceding, -1))
    first = planned.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < FIRST * k)
    # Of a large level the first blocks are enough for a threshold.
    first = first.select(*ids, "term", "level", "q_weight", F.ceil(F.lit(FIRST * k) / F.greatest(F.lit(1), F.col("n") / F.col("parts"))).alias("first_parts"))
    bounds = materialize(_thresholds(_first_sums(impact, first, ids, allowed), ids, keys, k, parents), "bounds")
    questions, slots = _numbered(planned, ids, "q"), _numbered(planned, ["term", "level"], "slot")
    marked = read_levels(planned, bounds, ids).join(_small(questions), ids).join(_small(slots), ["term", "level"])
    marked = materialize(marked.drop("bound", "m"), "marked")
    if report is not None:
        report.append(marked)
    if worth < 1:
        share = skipped(impact, marked).first()
        if (share["n_read"] or 0) > worth * (share["n"] or 0):
            own = index if allowed is None else index.within(allowed)
            return I.best(own, asked, ids, k, parents)
    reaching = _reaching(impact, marked, bounds.join(_small(questions), ids).select("q", "bound"), allowed)
    raised = materialize(_thresholds(reaching.select(*keys, F.inline("found")), ["q"], keys, k, parents), "raised")
    sums = _whole_sums(impact, marked, reaching, raised, allowed)
    children = F.lit("child").alias("kind")
    top = sums.select("q", children, *keys, "score")
    if parents:
        own = questions.where("variant = 0") if "variant" in ids else questions
        group = sums.join(_small(own.select("q")), "q", "left_semi").groupBy("q", *keys[:-1]).agg(F.max("score").alias("score"))
        last = index.postings.schema[keys[-1]].dataType
        top = top.unionByName(group.select("q", F.lit("parent").alias("kind"), *keys[:-1], F.lit(None).cast(last).alias(keys[-1]), "score"))
    top = top_per_group(top, ["q", "kind"], best_first(keys), k).drop("rank")
    top = materialize(top.join(_small(questions), "q").drop("q"), "left")
    best = _exact(index, terms, top.where("kind = 'child'").select(*ids, *keys), ids).withColumn("kind", F.lit("child"))
    if parents:
        best = best.unionByName(top.where("kind = 'parent'").withColumn("bm25", F.lit(0.0)))
    return top_per_group(best.select(*ids, "kind", *keys, "score", "bm25"), [*ids, "kind"], best_first(keys), k)


def _exact(index: TextIndex, terms: DataFrame, left: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, keys, score, bm25) of the pairs (ids, keys) that are left."""
    texts = left.select(*index.keys).distinct()
    # Other texts are left out before their postings become rows.
    postings = index.postings if index.given else index.within(texts.select(index.keys[0]).distinct()).postings
    rows = postings.withColumn("saturated", saturation(index)).join(_small(texts), index.keys, "left_semi")
    met = rows.join(_small(terms.select(*ids, "term", "q_weight", "bm25_idf")), "term")
    scored = met.join(_small(left), [*ids, *index.keys], "left_semi").groupBy(*ids, *index.keys)
    return scored.agg(F.sum(F.col("q_weight") * F.col("weight")).alias("score"), F.sum(F.col("bm25_idf") * F.col("saturated")).alias("bm25"))
