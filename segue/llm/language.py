"""Language identification by interpolated Kneser-Ney character models, one per language.

All character n-grams of the training rows are counted.  The models of all languages share sorted arrays of
n-gram hashes with one column of log probabilities per language, so a place of a text is looked up once.
No n-gram is left out: a model beyond the size of a block is built and applied block by block.
The language of lowest cross-entropy per character wins; a text is rejected when its cross-entropy lies far
above that of training texts of the same language and length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from segue.llm.arrays import bounded_batches, frugal, mix
from segue.llm.bpe import LETTER, code_classes
from segue.llm.carry import held_out, with_row
from segue.session import materialize

ORDER = 4
BLOCK_CELLS = 1 << 23  # n-grams times languages of a block of the model, which is what the driver and a task hold
MAX_DEVIATIONS = 10.0
MIN_DEVIATION = 0.06  # nats per symbol
WIDE_DEVIATION = 0.12  # the least where the class itself was not measured: tails of mixed texts are not seen in few texts
MIN_CALIBRATION = 30
CLASSES = 64  # a length class is the number of bits of the number of symbols
UNKNOWN = "und"
BLANK = 32
_BITS = np.uint64(16)

_lowered: np.ndarray | None = None


def symbols() -> np.ndarray:
    """16-bit symbol of every code point: letters in lower case, marks as they are, all else a blank."""
    global _lowered
    if _lowered is None:
        import unicodedata

        points = np.arange(0x110000)
        found = np.full(0x110000, BLANK, np.uint16)
        for c in np.flatnonzero(code_classes() == LETTER).tolist():
            low = chr(c).lower()
            low = ord(low) if len(low) == 1 else c
            found[c] = low if low < 0xFFFF else 0xE000 + low % 0x1000
        marks = [c for c in range(0x300, 0x10000) if unicodedata.category(chr(c))[0] == "M"]
        found[marks] = points[marks]
        _lowered = found
    return _lowered


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams of ORDER symbols packed into 64 bits, offsets by text, whether the text has a letter).

    Runs of blanks are one blank; each text starts with ORDER - 1 blanks and ends with one."""
    whole = "".join(t or "" for t in texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "replace"), "<u4")
    offs = np.concatenate([[0], np.cumsum(np.fromiter((len(t or "") for t in texts), np.int64, len(texts)))])
    sym = symbols()[codes]
    full = sym != BLANK
    keep = full.copy()
    keep[1:] |= full[:-1]  # the first blank behind a symbol stays
    keep[offs[1:-1][offs[1:-1] < len(sym)]] &= full[offs[1:-1][offs[1:-1] < len(sym)]]  # but none opens a text
    kept = np.concatenate([[0], np.cumsum(keep)])[offs]
    ends_blank = np.zeros(len(texts), bool)
    some = kept[1:] > kept[:-1]
    sym = sym[keep]
    ends_blank[some] = sym[kept[1:][some] - 1] == BLANK
    counts = np.diff(kept) + ~ends_blank * some  # a blank is put at the end where there is none
    bounds = np.concatenate([[0], np.cumsum(counts + some * (ORDER - 1))])
    line = np.full(bounds[-1], BLANK, np.uint16)
    at = np.repeat(bounds[:-1] + some * (ORDER - 1) - kept[:-1], np.diff(kept)) + np.arange(kept[-1])
    line[at] = sym
    n = max(len(line) - ORDER + 1, 0)
    packed = np.zeros(n, np.uint64)
    for j in range(ORDER):
        packed = packed << _BITS | line[j : j + n].astype(np.uint64)
    grams = np.concatenate([[0], np.cumsum(counts)])
    take = np.repeat(bounds[:-1] - grams[:-1], counts) + np.arange(grams[-1])
    letters = np.concatenate([[0], np.cumsum(code_classes()[codes] == LETTER)])
    return packed[take], grams, letters[offs[1:]] > letters[offs[:-1]]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a partition; what is held is a row per distinct n-gram and is given out in good time."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (keys, counts) in held.items():
            for a in range(0, len(keys), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys[part])), pa.array(keys[part].view(np.int64)), pa.array(counts[part])],
                    names=["lang", "gram", "n"],
                )
        held.clear()

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            grams = np.sort(ngrams([t for t, own in zip(texts, langs) if own == lang])[0])
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
            keys, counts = grams[first], np.diff(np.append(first, len(grams)))
            have = held.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            held[lang] = _summed(np.concatenate([have[0], keys]), np.concatenate([have[1], counts]))
        if sum(len(k) for k, _ in held.values()) > 1 << 21:
            yield from out()
    yield from out()


class SortedHashes:
    """Numbers of n-grams in a sorted array of their hashes, found through the leading bits."""

    def __init__(self, keys: np.ndarray):
        hashes = mix(keys + np.uint64(1))
        self.order = np.argsort(hashes)
        self.hashes = np.append(hashes[self.order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.bits = max(8, int(len(keys)).bit_length() + 1)
        heads = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.start = np.searchsorted(self.hashes[:-1], heads).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each n-gram in the sorted array, -1 where it is not in it."""
        want = mix(keys + np.uint64(1))
        at = self.start[want >> np.uint64(64 - self.bits)]
        low = np.flatnonzero(self.hashes[at] < want)
        while len(low):
            at[low] += 1
            low = low[self.hashes[at[low]] < want[low]]
        at[(self.hashes[at] != want) | (at == len(self.hashes) - 1)] = -1
        return at


@dataclass
class Model:
    """Per order: an index of n-grams with log probabilities, and of contexts with log back-off weights."""

    langs: list[str]
    grams: list[tuple[SortedHashes, np.ndarray]]
    contexts: list[tuple[SortedHashes, np.ndarray]]
    unseen: np.ndarray

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Natural log probability of the last symbol of each n-gram after the others, a column per language."""
        index, values = self.grams[ORDER - 1]
        at = index.find(keys)
        out = values[at]
        missing = np.flatnonzero(at < 0)
        out[missing] = 0
        for n in range(ORDER - 1, 0, -1):
            if not len(missing):
                return out
            mask = np.uint64((1 << 16 * n) - 1)
            index, weights = self.contexts[n]  # contexts of n symbols
            at = index.find((keys[missing] >> _BITS) & mask)
            out[missing] += np.where((at >= 0)[:, None], weights[at], 0)
            index, values = self.grams[n - 1]
            at = index.find(keys[missing] & mask)
            out[missing[at >= 0]] += values[at[at >= 0]]
            missing = missing[at < 0]
        out[missing] += self.unseen
        return out


@dataclass
class Whole:
    """What a block of the model needs of all n-grams: the discount of each (language, order), all single symbols, and
    the pairs that start with a symbol of the block; a row per language with counts."""

    langs: list[str]
    discounts: dict[tuple[str, int], float]
    singles: object  # pandas (lang, gram, n)
    pairs: object


def discount_of(ones: int, twos: int) -> float:
    return min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5


def build(counts, whole: Whole | None = None) -> Model:
    """Interpolated Kneser-Ney models of the n-gram counts, a pandas table (lang, gram, n): of all of them, or of a block."""
    langs = whole.langs if whole else sorted(counts["lang"].unique().tolist())
    own = []  # per language and order: n-grams, counts

    def level(table, lang: str) -> tuple[np.ndarray, np.ndarray]:
        rows = table[table["lang"] == lang]
        keys = rows["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        return keys[order], rows["n"].to_numpy(np.int64)[order]

    for lang in langs:
        levels = {ORDER: level(counts, lang)}
        for n in range(ORDER - 1, 0, -1):
            # Below the highest order an n-gram counts once for each symbol it follows.
            mask = np.uint64((1 << 16 * n) - 1)
            if whole and n <= 2:
                levels[n] = level(whole.pairs if n == 2 else whole.singles, lang)
            else:
                levels[n] = _summed(levels[n + 1][0] & mask, np.ones(len(levels[n + 1][0]), np.int64))
        own.append(levels)
    grams, contexts = [], [None]
    size = 1 + len(np.unique(np.concatenate([levels[1][0] for levels in own])))
    unseen = np.zeros(len(langs))
    below = below_index = None
    for n in range(1, ORDER + 1):
        every = np.unique(np.concatenate([levels[n][0] for levels in own]))
        probability = np.zeros((len(every), len(langs)))
        if n > 1:
            heads = np.unique(every >> _BITS)
            weight = np.ones((len(heads), len(langs)))
            lower = below[np.searchsorted(below_index, every & np.uint64((1 << 16 * (n - 1)) - 1))]
        for i, levels in enumerate(own):
            keys, c = levels[n]
            discount = whole.discounts[langs[i], n] if whole else discount_of(int((c == 1).sum()), int((c == 2).sum()))
            at = np.searchsorted(every, keys)
            if n == 1:
                total = c.sum()
                rest = discount * len(c) / total
                probability[:, i] = rest / size
                probability[at, i] += (c - discount) / total
                unseen[i] = np.log(rest / size)
                continue
            head, totals = _summed(keys >> _BITS, c)
            _, kinds = _summed(keys >> _BITS, np.ones(len(keys), np.int64))
            where = np.searchsorted(heads, head)
            weight[where, i] = discount * kinds / totals
            probability[:, i] = weight[np.searchsorted(heads, every >> _BITS), i] * lower[:, i]
            probability[at, i] += (c - discount) / totals[np.searchsorted(head, keys >> _BITS)]
        index = SortedHashes(every)
        grams.append((index, np.log(probability[index.order]).astype(np.float32)))
        if n > 1:
            index = SortedHashes(heads)
            contexts.append((index, np.log(weight[index.order]).astype(np.float32)))
        below, below_index = probability, every
    return Model(langs, grams, contexts, unseen.astype(np.float32))


@dataclass
class Blocks:
    """The model in `n` blocks.  The block of an n-gram follows from its last symbol but one, and of a symbol with too
    many n-grams for one block also from the symbol before: so a block has all that its contexts, and the lower orders
    with them, are counted from."""

    langs: list[str]
    first: np.ndarray  # by symbol
    pieces: np.ndarray
    n: int
    load: Callable[[int], Model]

    def of(self, keys: np.ndarray) -> np.ndarray:
        last, before = ((keys >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.int64) for shift in (16, 32))
        return self.first[last] + before % self.pieces[last]


def lay_out(sizes: dict[int, int], limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first block, number of blocks) of every symbol, and the number of all blocks."""
    first, pieces = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
    block, filled = 0, 0
    for symbol, size in sorted(sizes.items()):
        if filled and filled + size > limit:
            block, filled = block + 1, 0
        first[symbol], pieces[symbol] = block, -(-size // limit)
        if size > limit:
            block += int(pieces[symbol])
        else:
            filled += size
    return first, pieces, block + (filled > 0)


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block_cells: int = BLOCK_CELLS
) -> Blocks | None:
    """Models of the languages of `docs`, counted over all rows whose text and language are not null.

    All n-grams are in the model; a block has about `block_cells` n-grams times languages.  None without such rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    counts = materialize(
        known.mapInArrow(frugal(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-counts"
    )
    rows = {r.lang: r.n for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not rows:
        return None
    langs, limit = sorted(rows), max(block_cells // len(rows), 1)
    if sum(rows.values()) <= limit:
        model = build(counts.toPandas())
        return Blocks(langs, np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64), 1, lambda b: model)

    symbol = lambda at: F.shiftright("gram", 16 * at).bitwiseAND(F.lit(0xFFFF))
    # One row per symbol, of which there are 65,536 at most.
    sizes = counts.groupBy(symbol(1).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    first, pieces, n_blocks = lay_out({r.c: r.n for r in sizes}, limit)
    layout = F.broadcast(spark.createDataFrame([(r.c, int(first[r.c]), int(pieces[r.c])) for r in sizes], "c long, first long, pieces long"))
    levels, discounts = {ORDER: counts}, {}
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            lower = levels[n + 1].select("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * n) - 1)).alias("gram"))
            levels[n] = materialize(lower.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), "language-level")
        few = levels[n].groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"))
        discounts |= {(r.lang, n): discount_of(r.ones, r.twos) for r in few.collect()}
    block = F.col("first") + symbol(2) % F.col("pieces")
    # In order of the blocks, so that a block is read without the others.
    cut = counts.withColumn("c", symbol(1)).join(layout, "c").select("lang", "gram", "n", block.alias("block"))
    cut = materialize(cut.repartitionByRange("block", "gram").sortWithinPartitions("block"), "language-blocks")
    pairs = levels[2].withColumn("c", symbol(1)).join(layout, "c")
    singles = levels[1].toPandas()

    def load(b: int) -> Model:
        own = pairs.filter((F.col("first") <= b) & (F.col("first") + F.col("pieces") > b)).select("lang", "gram", "n")
        return build(cut.filter(F.col("block") == b).drop("block").toPandas(), Whole(langs, discounts, singles, own.toPandas()))

    return Blocks(langs, first, pieces, n_blocks, load)


def _told(total: np.ndarray, sizes: np.ndarray, letters: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, cross-entropy, score) of each text from its log probability in every language."""
    n = len(sizes)
    bits = -total / np.maximum(sizes, 1)[:, None]
    best = bits.argmin(axis=1)
    gap = np.minimum((bits - bits[np.arange(n), best][:, None]) * sizes[:, None], 700)
    lang = np.where(letters, np.array(langs, object)[best], UNKNOWN)
    entropy = np.where(letters, bits[np.arange(n), best], np.nan)
    return lang, entropy, np.where(letters, 1 / np.exp(-gap).sum(axis=1), 0.0)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            grams, offs, letters = ngrams(batch.column("text").to_pylist())
            sizes = np.diff(offs)
            lang, entropy, score = np.full(n, UNKNOWN, object), np.full(n, np.nan), np.zeros(n)
            if model is not None and letters.any():
                total = np.zeros((n, len(model.langs)))
                some = sizes > 0
                total[some] = np.add.reduceat(model.log_probability(grams), offs[:-1][some], axis=0, dtype=np.float64)
                lang, entropy, score = _told(total, sizes, letters, model.langs)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(lang, pa.string()),
                 pa.array(entropy, from_pandas=True), pa.array(score), pa.array(sizes)],
                names=[*(c for c in batch.schema.names if c != "text"), "lang_pred", "cross_entropy", "score", "n_symbols"],
            )

    return run


def _score_block(shared, b: int):
    """(r, block, n_symbols, letters, total): the log probability in every language of the n-grams of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, first, pieces = shared.value
        place = Blocks(model.langs, first, pieces, 0, None)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            grams, offs, letters = ngrams(batch.column("text").to_pylist())
            sizes = np.diff(offs)
            mine = np.flatnonzero(place.of(grams) == b)
            text_of = np.repeat(np.arange(n), sizes)[mine]
            found = model.log_probability(grams[mine])
            total = np.stack([np.bincount(text_of, found[:, i], n) for i in range(len(model.langs))], axis=1)
            cuts = np.arange(n + 1, dtype=np.int32) * total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("r"), pa.array(np.full(n, b, np.int64)), pa.array(sizes), pa.array(letters),
                 pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(total.ravel()))],
                names=["r", "block", "n_symbols", "letters", "total"],
            )

    return run


def _tell(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                total = np.array(batch.column("total").to_pylist(), float)
                sizes, letters = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_symbols", "letters"))
                lang, entropy, score = _told(total, sizes, letters, langs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("r"), pa.array(lang, pa.string()), pa.array(entropy, from_pandas=True), pa.array(score), pa.array(sizes)],
                    names=["r", "lang_pred", "cross_entropy", "score", "n_symbols"],
                )

    return run


def score_rows(source: DataFrame, blocks: Blocks | None) -> DataFrame:
    """`source` with lang_pred, cross_entropy, score and n_symbols in place of `text`."""
    spark = source.sparkSession
    told = "lang_pred string, cross_entropy double, score double, n_symbols long"
    if blocks is None or blocks.n == 1:
        schema = T.StructType([f for f in source.schema.fields if f.name != "text"])
        for f in T.StructType.fromDDL(told).fields:
            schema = schema.add(f)
        shared = spark.sparkContext.broadcast(blocks and blocks.load(0))
        return source.mapInArrow(frugal(_score(shared)), schema)
    # Written with a number for each row, by which the sums of the blocks meet; the texts stay where they are.
    rows = materialize(source.withColumn("r", F.monotonically_increasing_id()), "language-rows")
    parts = None
    for b in range(blocks.n):
        shared = spark.sparkContext.broadcast((blocks.load(b), blocks.first, blocks.pieces))
        schema = "r long, block long, n_symbols long, letters boolean, total array<double>"
        part = materialize(rows.select("r", "text").mapInArrow(frugal(_score_block(shared, b)), schema), "language-part")
        shared.unpersist()
        parts = part if parts is None else parts.union(part)
    # Summed in the order of the blocks, so that equal texts get equal results.
    by_row = parts.groupBy("r").agg(
        F.max("n_symbols").alias("n_symbols"), F.max("letters").alias("letters"),
        F.sort_array(F.collect_list(F.struct("block", "total"))).alias("parts"),
    )
    zeros = F.array_repeat(F.lit(0.0), len(blocks.langs))
    total = F.aggregate("parts", zeros, lambda acc, p: F.zip_with(acc, p["total"], lambda x, y: x + y))
    found = by_row.select("r", "n_symbols", "letters", total.alias("total")).mapInArrow(frugal(_tell(blocks.langs)), "r long, " + told)
    return rows.drop("text").join(found, "r").drop("r")


def bounds(found: list[tuple], langs: list[str]) -> list[tuple[str, int, float, float]]:
    """(language, length class, mean, deviation) for every learned language and every length class.

    `found` has (known language, language told, class, texts, mean, variance) of the known texts.  A class of
    under MIN_CALIBRATION texts that were told rightly takes the values of the nearest fuller class of its
    language, or of all its texts where no class is full.  An average over fewer symbols spreads more, by the
    root of the ratio, so deviations are widened towards shorter classes; towards longer ones they stay.  A
    language of few texts has at least the deviation within the languages, one without any the values of all.
    """

    def pooled(rows: list[tuple]) -> tuple[float, float, int, int]:
        """(mean, variance, usual class, texts)"""
        n = sum(r[3] for r in rows)
        mean = sum(r[3] * r[4] for r in rows) / n
        return mean, sum(r[3] * (r[5] + (r[4] - mean) ** 2) for r in rows) / n, round(sum(r[3] * r[2] for r in rows) / n), n

    if not found:
        return []
    right = [r for r in found if r[0] == r[1]]
    own = {lang: [r for r in right if r[0] == lang] for lang in langs}
    every = pooled(right or found)
    within = [pooled(rows) for rows in own.values() if rows]
    spread = sum(p[1] * p[3] for p in within) / sum(p[3] for p in within) if within else every[1]
    out = []
    for lang in langs:
        full = {r[2]: (r[4], r[5]) for r in own[lang] if r[3] >= MIN_CALIBRATION}
        measured = set(full)
        if not full:
            mean, variance, usual, n = pooled(own[lang]) if own[lang] else every
            full = {usual: (mean, variance if n >= MIN_CALIBRATION else max(variance, spread))}
        for c in range(CLASSES + 1):
            near = min(full, key=lambda f: (abs(f - c), f))
            mean, variance = full[near]
            least = MIN_DEVIATION if near == c and c in measured else WIDE_DEVIATION
            out.append((lang, c, mean, max(variance**0.5, least) * 2 ** (max(near - c, 0) / 2)))
    return out


def identify(
    docs: DataFrame, known: DataFrame, text_col: str = "text", lang_col: str = "lang",
    max_deviations: float = MAX_DEVIATIONS, block_cells: int = BLOCK_CELLS, keep: list[str] | None = None,
) -> DataFrame:
    """(row, lang_pred, score, cross_entropy, rejected) for every row of `docs`; `row` is the input row,
    or its columns `keep`.

    Models are trained on `known`.  score is the posterior of the language over those learned, each as likely
    before.  A text that is null or has no letter is `und` with score 0 and rejected, as is every text when
    nothing was learned.  rejected: the cross-entropy per symbol lies `max_deviations` above the mean of the
    known texts of the language and length class, or of what stands for them; see `bounds`.  Equal texts get
    equal results, and of languages that fit equally well the first by code point is taken.  Very long texts are scored whole; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = train(known, text_col, lang_col, block_cells)

    def score(rows: DataFrame, row: bool) -> DataFrame:
        source = with_row(rows, keep, text=F.col(text_col)) if row else rows.select(
            F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
        )
        return score_rows(source, model).withColumn("class", F.length(F.bin("n_symbols")))

    if model is None:
        return score(docs, True).select("row", "lang_pred", "score", "cross_entropy", F.lit(True).alias("rejected"))
    scored = materialize(score(docs, True), "language")
    same = docs is known or docs.sameSemantics(known)
    base = scored.select(F.col(f"row.{lang_col}").cast("string").alias("lang"), "lang_pred", "cross_entropy", "class") if same else None
    if base is None:
        base = score(known, False)
    # At most CLASSES rows for each pair of learned languages.
    found = base.filter("lang IS NOT NULL AND cross_entropy IS NOT NULL").groupBy("lang", "lang_pred", "class").agg(
        F.count(F.lit(1)).alias("n"), F.avg("cross_entropy").alias("mean"), F.var_pop("cross_entropy").alias("variance")
    )
    usual = spark.createDataFrame(
        bounds(sorted(tuple(r) for r in found.collect()), model.langs), "at_lang string, at_class int, mean double, deviation double"
    )
    # One row per learned language and length class.
    joined = scored.join(F.broadcast(usual), (F.col("lang_pred") == F.col("at_lang")) & (F.col("class") == F.col("at_class")), "left")
    far = F.col("cross_entropy") > F.col("mean") + max_deviations * F.col("deviation")
    # Without a row there is no letter, or no known text has one.
    return joined.select("row", "lang_pred", "score", "cross_entropy", F.coalesce(far, F.lit(True)).alias("rejected"))


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """`identify` with models and calibration from the rows outside the hold-out.

    One scoring pass serves both: the calibration reads the scores of the training rows back."""
    marked = with_row(docs, keep, text=F.col("text"), lang=F.when(~held_out(id_col), F.col("lang")))
    found = identify(marked, marked, keep=["row", "lang"])
    return found.withColumn("row", F.col("row.row"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_held_out(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return found.select("row.doc_id", "lang_pred", "score", "cross_entropy", "rejected").withColumn("held_out", held_out("doc_id"))


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict = {}
