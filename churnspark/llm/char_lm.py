"""Language identification by interpolated Kneser-Ney character models.

Texts are folded: letters in lower case, every other run of characters one space, a space at both ends. Four folded
characters of 16 bits are one 64-bit n-gram hash. The corpus yields one table: the count of every 4-gram per language.
Continuation counts of the lower orders follow from its distinct 4-grams; all orders are counted and joined in Spark. The
fitted model holds, per order, every n-gram of the corpus in sorted arrays of hashes with the log probability under every
language beside each, cut into parts of bounded bytes; a text's language is the one with the lowest cross-entropy per
character.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnspark.llm.common import arrow_rows, documents_of

ORDER = 4
#: Bytes of one part of a model table: the driver and a task hold one part of a table at a time.
PART_BYTES = 48 * 1024 * 1024
_FLUSH = 1 << 20
_CHUNK = 1 << 21


def _fold_table() -> np.ndarray:
    table = np.full(65536, 32, np.uint16)
    for code in range(65536):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 and ord(low) < 65536 else code
    return table


class Folder:
    """Folded code units of a text; letters beyond 16 bits are mapped into a private range by their low bits."""

    def __init__(self):
        self.table = _fold_table()

    def __call__(self, text: str) -> np.ndarray:
        """Code units with one space at both ends; empty if the text has no letter."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(codes) and codes.max() > 0xFFFF:
            far = np.flatnonzero(codes > 0xFFFF)
            units = self.table[np.minimum(codes, 0xFFFF)]
            letters = np.fromiter((chr(c).isalpha() for c in codes[far].tolist()), bool, len(far))
            units[far] = np.where(letters, 0xE000 + codes[far] % 0x1800, 32)
        else:
            units = self.table[codes]
        blank = units == 32
        if blank.all():
            return np.zeros(0, np.uint16)
        units = units[~(blank & np.concatenate([[True], blank[:-1]]))]
        tail = [] if units[-1] == 32 else [32]
        return np.concatenate([np.array([32], np.uint16), units, np.array(tail, np.uint16)])


def grams(units: np.ndarray) -> np.ndarray:
    """Hash of the 4-gram that ends at each position from the second on; before the start there are zeros."""
    padded = np.concatenate([np.zeros(ORDER - 2, np.uint64), units.astype(np.uint64)])
    n = len(padded) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = padded[:n].copy()
    for i in range(1, ORDER):
        out = (out << np.uint64(16)) | padded[i : i + n]
    return out


def gram_counts(documents: DataFrame) -> DataFrame:
    """(lang, gram, n) over all of ``documents`` (lang, text); counted inside the task first."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        fold = Folder()
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def settle(lang):
            keys, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            size[lang] = 0
            if lang in sums:
                both = np.concatenate([sums[lang][0], keys])
                keys, at = np.unique(both, return_inverse=True)
                n = np.bincount(at, np.concatenate([sums[lang][1], n]), len(keys)).astype(np.int64)
            sums[lang] = (keys, n)

        def emit(lang):
            keys, n = sums.pop(lang)
            for i in range(0, len(keys), 65536):
                part = keys[i : i + 65536].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[i : i + 65536])], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = grams(fold(text.as_py()))
                held.setdefault(lang, []).append(found)
                size[lang] = size.get(lang, 0) + len(found)
                if size[lang] > _CHUNK:
                    settle(lang)
                    if len(sums[lang][0]) > _FLUSH:
                        yield from emit(lang)
        for lang in list(held):
            settle(lang)
        for lang in list(sums):
            yield from emit(lang)

    partial = documents.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Table:
    """Sorted hashes with numbers (hash, language) beside each, in parts by range of hash. A part is a pair of arrays or
    the broadcast of one; of a table in several parts, a task loads one at a time."""

    def __init__(self, parts: list, bounds: np.ndarray | None = None):
        self.parts = parts
        self.bounds = np.zeros(0, np.uint64) if bounds is None else bounds  # smallest hash of each part but the first

    def find(self, wanted: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Which of ``wanted`` the table has; their numbers are written to ``out``."""
        found = np.zeros(len(wanted), bool)
        if len(self.parts) == 1:
            self._look(self.parts[0], wanted, slice(None), found, out)
            return found
        owner = np.searchsorted(self.bounds, wanted, side="right")
        for i in np.unique(owner).tolist():
            part = self.parts[i]
            self._look(part, wanted, np.flatnonzero(owner == i), found, out)
            if not isinstance(part, tuple):
                part.__dict__.pop("_value", None)  # the loaded copy; the next use loads it again
        return found

    @staticmethod
    def _look(part, wanted, rows, found, out) -> None:
        keys, values = part if isinstance(part, tuple) else part.value
        if len(keys):
            at = np.minimum(np.searchsorted(keys, wanted[rows]), len(keys) - 1)
            hit = keys[at] == wanted[rows]
            places = np.arange(len(wanted))[rows][hit]
            found[places] = True
            out[places] = values[at[hit]]


@dataclass
class Model:
    """Per order from 1 to 4: log probabilities of all n-grams; per context order 1 to 3: log weights of the next lower
    order. ``floor`` is the log probability of a character never seen."""

    languages: list[str]
    grams: list[Table]
    contexts: list[Table]
    floor: np.ndarray
    temperature: float = 1.0
    limits: np.ndarray | None = None  # cross-entropy above which a language's answer is rejected

    @property
    def keys(self) -> list[np.ndarray]:
        """Hashes of each order of a model in memory."""
        return [np.concatenate([part[0] for part in t.parts]) for t in self.grams]

    @property
    def parts(self) -> int:
        return max(len(t.parts) for t in [*self.grams, *self.contexts])


def _discount(counts: np.ndarray) -> float:
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (16 * order)) - 1)


def estimate(tables: dict[str, tuple[np.ndarray, np.ndarray, float]]) -> Model:
    """Interpolated Kneser-Ney probabilities from each language's (4-grams, counts, discount), in memory; ``fit`` gives
    the same from a written table."""
    languages = sorted(tables)
    grams_of, counts_of, discounts = {}, {}, {}
    for lang in languages:
        keys, counts, discount = tables[lang]
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        grams_of[lang], counts_of[lang], discounts[lang] = {ORDER: keys}, {ORDER: counts}, {ORDER: discount}
        for n in range(ORDER - 1, 0, -1):
            # Continuation count: how many distinct (n+1)-grams end in the n-gram.
            keys, c = np.unique(grams_of[lang][n + 1] & _mask(n), return_counts=True)
            grams_of[lang][n], counts_of[lang][n] = keys, c.astype(np.float64)
            discounts[lang][n] = _discount(c)
    units = [np.unique(np.concatenate([grams_of[lang][n] for lang in languages])) for n in range(1, ORDER + 1)]
    chars = len(units[0]) + 1
    tables_of, contexts = [], []
    lower = None  # probabilities of the union's (n-1)-grams
    for n in range(1, ORDER + 1):
        union = units[n - 1]
        p = np.zeros((len(union), len(languages)))
        if n > 1:
            context = np.unique(union >> np.uint64(16))
            w = np.ones((len(context), len(languages)))
            back = np.searchsorted(units[n - 2], union & _mask(n - 1))
            at = np.searchsorted(context, union >> np.uint64(16))
        for j, lang in enumerate(languages):
            keys, counts, d = grams_of[lang][n], counts_of[lang][n], discounts[lang][n]
            place = np.searchsorted(union, keys)
            if n == 1:
                total = counts.sum()
                p[:, j] = d * len(keys) / total / chars
                p[place, j] += np.maximum(counts - d, 0) / total
                continue
            own = np.searchsorted(context, keys >> np.uint64(16))
            total = np.bincount(own, counts, len(context))
            kinds = np.bincount(own, minlength=len(context))
            seen = total > 0
            w[seen, j] = d * kinds[seen] / total[seen]
            p[:, j] = w[at, j] * lower[back, j]
            p[place, j] += np.maximum(counts - d, 0) / total[own]
        if n > 1:
            contexts.append(Table([(context, np.log(w).astype(np.float32))]))
        lower = p
        tables_of.append(Table([(union, np.log(p).astype(np.float32))]))
    floor = np.array([np.log(max(discounts[lang][1] * len(grams_of[lang][1]) / counts_of[lang][1].sum(), 1e-9) / chars) for lang in languages], np.float32)
    return Model(languages, tables_of, contexts, floor)


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Columns gram, v0, v1, ... of a bounded table as sorted hashes and numbers."""
    table = df.toArrow()
    keys = table.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    values = np.empty((len(keys), table.num_columns - 1), np.float32)
    for i in range(values.shape[1]):
        values[:, i] = table.column(i + 1).to_numpy()[order]
    return keys[order], values


def _sent(df: DataFrame, part_bytes: int) -> Table:
    """Every row of (gram, v0, v1, ...) as broadcast parts of about ``part_bytes``; the driver holds one at a time."""
    from churnspark.session import fresh_path

    spark = df.sparkSession
    parts = max(1, math.ceil(df.count() * (8 + 4 * (len(df.columns) - 1)) / part_bytes))
    if parts == 1:
        return Table([spark.sparkContext.broadcast(_arrays(df))])
    place = F.col("gram").bitwiseXOR(F.lit(-(2**63)))  # the order of unsigned hashes
    cuts = sorted(set(df.agg(F.percentile_approx(place, [i / parts for i in range(1, parts)], 100 * parts)).first()[0]))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= place))
    path = fresh_path(spark, "parts")
    df.withColumn("part", part).repartition("part", F.pmod("gram", F.lit(16))).write.partitionBy("part").parquet(path)
    written = spark.read.parquet(path)
    held = [spark.sparkContext.broadcast(_arrays(written.where(F.col("part") == i).drop("part"))) for i in range(len(cuts) + 1)]
    return Table(held, np.array([c + 2**63 for c in cuts], np.uint64))


def _wide(table: DataFrame, key, languages: list[str], **values) -> DataFrame:
    """One row per ``key``; for each name in ``values`` and each language j a column name + j with the sum of the value."""
    sums = [F.coalesce(F.sum(F.when(F.col("lang") == lang, v)), F.lit(0)).alias(f"{name}{j}") for name, v in values.items() for j, lang in enumerate(languages)]
    return table.groupBy(key).agg(*sums)


def fit(counts: DataFrame, part_bytes: int = PART_BYTES) -> Model | None:
    """Interpolated Kneser-Ney probabilities from a written table of 4-grams (lang, gram, n); None from an empty one."""
    from churnspark.session import materialize

    tables = {ORDER: counts.withColumnRenamed("n", "c")}
    for n in range(ORDER - 1, 0, -1):
        # Continuation count: how many distinct (n+1)-grams end in the n-gram.
        suffix = F.col("gram").bitwiseAND(F.lit(int(_mask(n)))).alias("gram")
        tables[n] = materialize(tables[n + 1].groupBy("lang", suffix).agg(F.count("*").alias("c")), f"grams{n}")
    share = {}  # order -> language -> (discount, kinds, total)
    for n, table in tables.items():
        once, twice = (F.sum((F.col("c") == k).cast("long")) for k in (1, 2))
        rows = table.groupBy("lang").agg(F.count("*"), F.sum("c"), once, twice).collect()
        share[n] = {lang: (ones / (ones + 2 * twos) if ones and twos else 0.5, kinds, total) for lang, kinds, total, ones, twos in rows}
    languages = sorted(share[ORDER])
    if not languages:
        return None
    chars = tables[1].select("gram").distinct().count() + 1
    every = range(len(languages))
    logs, contexts = [], []
    lower = None  # probabilities of all (n-1)-grams
    for n in range(1, ORDER + 1):
        d = [share[n][lang][0] for lang in languages]
        wide = _wide(tables[n], "gram", languages, c=F.col("c"))
        above = [F.greatest(F.col(f"c{j}") - F.lit(d[j]), F.lit(0.0)) for j in every]
        if n == 1:
            size = [share[1][lang][1:] for lang in languages]
            p = wide.select("gram", *[(F.lit(d[j] * size[j][0] / size[j][1] / chars) + above[j] / F.lit(float(size[j][1]))).alias(f"v{j}") for j in every])
        else:
            start = F.shiftrightunsigned("gram", 16)
            sums = _wide(tables[n], start.alias("context"), languages, total=F.col("c"), kinds=F.lit(1))
            # A context that a language never saw leaves all to the lower order.
            weight = [F.coalesce(F.try_divide(F.lit(d[j]) * F.col(f"kinds{j}"), F.col(f"total{j}")), F.lit(1.0)).alias(f"w{j}") for j in every]
            context = materialize(sums.select("context", *[f"total{j}" for j in every], *weight), f"contexts{n}")
            contexts.append(_sent(context.select(F.col("context").alias("gram"), *[F.log(f"w{j}").cast("float").alias(f"v{j}") for j in every]), part_bytes))
            below = lower.select(F.col("gram").alias("suffix"), *[F.col(f"v{j}").alias(f"b{j}") for j in every])
            joined = wide.withColumns({"context": start, "suffix": F.col("gram").bitwiseAND(F.lit(int(_mask(n - 1))))}).join(context, "context").join(below, "suffix")
            own = [F.coalesce(F.try_divide(above[j], F.col(f"total{j}")), F.lit(0.0)) for j in every]
            p = joined.select("gram", *[(F.col(f"w{j}") * F.col(f"b{j}") + own[j]).alias(f"v{j}") for j in every])
        lower = materialize(p, f"chances{n}")
        logs.append(_sent(lower.select("gram", *[F.log(f"v{j}").cast("float").alias(f"v{j}") for j in every]), part_bytes))
    floor = np.array([np.log(max(share[1][lang][0] * share[1][lang][1] / share[1][lang][2], 1e-9) / chars) for lang in languages], np.float32)
    return Model(languages, logs, contexts, floor)


def _back_off(model: Model, wanted: np.ndarray, n: int) -> np.ndarray:
    """Log probabilities of n-grams, by the longest seen suffix and the weights of the contexts left behind."""
    if n == 0:
        return np.repeat(model.floor[None, :], len(wanted), axis=0)
    out = np.zeros((len(wanted), len(model.languages)), np.float32)
    missed = np.flatnonzero(~model.grams[n - 1].find(wanted, out))
    if len(missed):
        below = _back_off(model, wanted[missed] & _mask(n - 1), n - 1)
        if n > 1:
            weights = np.zeros_like(below)  # 0 for a context never seen
            model.contexts[n - 2].find(wanted[missed] >> np.uint64(16), weights)
            below = below + weights
        out[missed] = below
    return out


def entropies(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Cross-entropy per character (nats) of each folded text under each language."""
    parts = [grams(t) for t in texts]
    sizes = np.array([len(p) for p in parts])
    keys, places = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_inverse=True)
    found = _back_off(model, keys, ORDER)
    out = np.zeros((len(texts), len(model.languages)))
    owner = np.repeat(np.arange(len(texts)), sizes)
    for a in range(0, len(places), 1 << 18):  # bounded blocks of positions
        logs = found[places[a : a + (1 << 18)]]
        own = owner[a : a + (1 << 18)]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[starts]] -= np.add.reduceat(logs.astype(np.float64), starts, axis=0)
    return out / np.maximum(sizes, 1)[:, None]


def _posterior(h: np.ndarray, temperature: float) -> np.ndarray:
    z = np.exp(-(h - h.min(axis=1, keepdims=True)) / temperature)
    return z / z.sum(axis=1, keepdims=True)


def _scored(batches, model: Model, block: int = 1 << 20):
    """(batch columns, folded texts, entropies) in blocks of bounded text; larger ones if parts are loaded for each."""
    fold = Folder()
    block *= min(model.parts, 4)
    rows, texts, size = [], [], 0
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
            folded = fold(row[-1].as_py())
            rows.append([v.as_py() for v in row[:-1]])
            texts.append(folded)
            size += len(folded)
            if size > block:
                yield rows, texts, entropies(model, texts)
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts, entropies(model, texts)


def train(documents: DataFrame, part_bytes: int = PART_BYTES) -> Model | None:
    """Model of all labelled ``documents`` (doc_id, text, lang); None without any letter in a labelled text.

    Temperature and rejection limits come from all of them too: the temperature is the one under which their languages
    are likeliest, the limit of a language lies four deviations above its mean cross-entropy.
    """
    from churnspark.session import materialize

    known = documents.where(F.col("lang").isNotNull())
    model = fit(materialize(gram_counts(known), "grams"), part_bytes)
    if model is not None:
        _calibrate(model, known)
    return model


def _calibrate(model: Model, known: DataFrame) -> None:
    """Temperature and limits from every labelled text; each task sends only sums per language."""
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("mean", pa.float64()), ("squares", pa.float64()), ("losses", pa.list_(pa.float64()))])

    def score(batches):
        held: dict[str, list] = {}
        for meta, texts, h in _scored(batches, model):
            langs = np.array([row[0] for row in meta])
            lettered = np.array([len(t) > 0 for t in texts])
            for j, lang in enumerate(model.languages):
                own = h[(langs == lang) & lettered]
                if not len(own):
                    continue
                losses = np.array([-np.log(np.maximum(_posterior(own, t)[:, j], 1e-12)).sum() for t in _TEMPERATURES])
                part = (len(own), own[:, j].mean(), ((own[:, j] - own[:, j].mean()) ** 2).sum(), losses)
                held[lang] = _merged(held[lang], part) if lang in held else part
        for lang, (n, mean, squares, losses) in held.items():
            yield lang, n, float(mean), float(squares), losses.tolist()

    rows = known.select("lang", "text").mapInArrow(arrow_rows(schema, score, 512), "lang string, n bigint, mean double, squares double, losses array<double>").collect()
    model.limits = np.full(len(model.languages), np.inf)
    if not rows:
        return
    sums: dict[str, tuple] = {}
    for r in sorted(rows):
        part = (r["n"], r["mean"], r["squares"], np.array(r["losses"]))
        sums[r["lang"]] = _merged(sums[r["lang"]], part) if r["lang"] in sums else part
    model.temperature = float(_TEMPERATURES[int(np.argmin(sum(part[3] for part in sums.values())))])
    for j, lang in enumerate(model.languages):
        if lang in sums and sums[lang][0] > 1:
            n, mean, squares, _ = sums[lang]
            model.limits[j] = mean + 4 * math.sqrt(squares / n)


def _merged(a: tuple, b: tuple) -> tuple:
    """(rows, mean, sum of squared deviations, losses) of two sets of rows together."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n, a[3] + b[3]


_TEMPERATURES = 2.0 ** np.arange(-8, 3)


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """(doc_id[, carry], lang_pred, score, accepted, cross_entropy) of every row.

    'und' with score 0 for a text that is null or has no letter, and for every text if there is no model. ``score`` is
    the calibrated probability of the answer, ``accepted`` whether its cross-entropy is within the language's limit.
    Ties go to the language that sorts first. Repeated rows and null ids stay; an empty table gives no rows.
    """
    docs = df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), *([F.col(carry)] if carry else []), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    )
    kinds = dict(docs.dtypes)
    carried = [(carry, {"boolean": pa.bool_(), "string": pa.string(), "bigint": pa.int64()}[kinds[carry]])] if carry else []
    schema = pa.schema([("doc_id", pa.int64()), *carried, ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_()), ("cross_entropy", pa.float64())])

    def rows(batches):
        if model is None:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns[:-1])):
                    yield *row, "und", 0.0, False, None
            return
        limits = model.limits if model.limits is not None else np.full(len(model.languages), np.inf)
        for meta, texts, h in _scored(batches, model):
            best = h.argmin(axis=1)
            chance = _posterior(h, model.temperature)
            for i, row in enumerate(meta):
                if len(texts[i]):
                    b = int(best[i])
                    yield *row, model.languages[b], float(chance[i, b]), bool(h[i, b] <= limits[b]), float(h[i, b])
                else:
                    yield *row, "und", 0.0, False, None

    columns = "doc_id bigint, " + (f"{carry} {kinds[carry]}, " if carry else "") + "lang_pred string, score double, accepted boolean, cross_entropy double"
    return docs.mapInArrow(arrow_rows(schema, rows), columns)


def held_out(doc):
    """Whether a document is left out of training: crc32 of its id's digits, modulo 4, is 2 (a null id: not)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identified(df: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and have a language, then identify all."""
    docs = documents_of(df).withColumn("held_out", held_out("doc_id"))
    training = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(training.where(~held_out("doc_id")))
    return identify(docs, model, carry="held_out")
