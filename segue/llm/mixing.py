"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the times it is taken on average.  Of all rates that give every source its target tokens, those
are looked for that lie nearest to one for every document (least relative entropy) and at most `most`.  They are exponential
tilts, min(most, exp(multiplier of the source * size / scale of the source)), and the multipliers solve the convex
dual, one equation a source, by Newton iterations.  The rates depend on source and size only, so the iterations pass over
the counts of documents per (source, size); each is one join with the small table of multipliers and one sum by
source, and only whether any source is still off comes to the driver.

Rates become whole copies cell by cell from the largest size down; what a cell takes too much or too little goes on to
the next, so a source misses its target by about half of its smallest document.  The documents of a cell share
its copies evenly, in the order of a hash of the id.

Sums are taken over whole numbers (terms in 1/1024 of a token), so the order of the rows does not move them and
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from segue.operators.order import with_row_index
from segue.session import configure, materialize

WEIGHTS = (5, 2, 1)  # of the sources by code point, repeating
PERCENT = 150  # of all tokens that are taken
MOST = 2
MAX_ROUNDS = 60
PARTS = 1024  # of a token in the sums

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_filled(sources: DataFrame, total: float, most: int) -> DataFrame:
    """`sources` (weight, source_size, ...) with target: `total` shared by weight, none above most * source_size.

    The excess of the stopped sources is shared by weight among the others until none is above; each round is one
    sum over the sources and brings two numbers to the driver."""
    cap = most * F.col("source_size")
    stopped = F.lit(False)
    while True:
        free = sources.filter(~stopped & (F.col("source_size") > 0))
        held = sources.filter(stopped).agg(F.coalesce(F.sum(cap), F.lit(0)).alias("x")).first()["x"]
        weight = free.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("x")).first()["x"]
        level = (total - held) / weight if weight else 0.0
        share = F.col("weight") * level
        if free.filter(share > cap).isEmpty():
            target = F.when(stopped | (F.col("source_size") == 0), cap.cast("double")).otherwise(share)
            return sources.withColumn("target", target)
        stopped = stopped | (share > cap)


def _solve(cells: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(src, multiplier) of every source: Newton steps on the logarithm of the tokens taken, kept inside the bounds
    known so far."""
    size, lam = F.col("size"), F.col("multiplier")
    state = materialize(sources.select(
        "src", "target", "source_size", "scale",
        # Rates of `most` for every document are the limit of an endless multiplier.
        F.when(F.col("target") >= most * F.col("source_size"), F.lit(float("inf")))
        .otherwise(F.log(F.col("target") / F.col("source_size"))).alias("multiplier"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
    ), "multipliers")
    for _ in range(MAX_ROUNDS):
        rated = cells.join(state, "src").withColumn("rate", tilt(most))
        tokens = F.col("n") * size * F.col("rate") * PARTS
        slope = F.when(F.col("rate") < most, tokens * size / F.col("scale")).otherwise(0.0)
        sums = rated.groupBy("src").agg(
            (F.sum(F.rint(tokens).cast("long")) / PARTS).alias("taken"), (F.sum(F.rint(slope).cast("long")) / PARTS).alias("slope")
        )
        off = F.col("taken") - F.col("target")
        settled = F.isnan(lam) | (lam == float("inf")) | (F.abs(off) <= 0.5 + 1e-9 * F.col("target"))
        low = F.when(off < 0, lam).otherwise(F.col("low"))
        high = F.when(off > 0, lam).otherwise(F.col("high"))
        newton = lam - F.log(F.col("taken") / F.col("target")) * F.try_divide(F.col("taken"), F.col("slope"))
        inside = newton.isNotNull() & ~F.isnan(newton) & (newton > F.coalesce(low, F.lit(float("-inf")))) & (newton < F.coalesce(high, F.lit(float("inf"))))
        beyond = F.when(low.isNull(), high - 1 - F.abs(high)).when(high.isNull(), low + 1 + F.abs(low)).otherwise((low + high) / 2)
        step = state.join(sums, "src").select(
            "src", "target", "source_size", "scale", F.when(settled, lam).when(inside, newton).otherwise(beyond).alias("multiplier"),
            low.alias("low"), high.alias("high"), settled.alias("settled"),
        )
        state = materialize(step, "multipliers")
        if state.filter("NOT settled").isEmpty():
            break
        state = state.drop("settled")
    return state.select("src", "multiplier")


def tilt(most: int) -> Column:
    """Rate of a document of `size`; empty documents keep the rate one."""
    return F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(float(most)), F.exp(F.col("multiplier") * F.col("size") / F.col("scale"))))


def _round_source(most: int):
    """Whole copies for the cells of one source, the largest size first.

    The rows of a source are its distinct sizes: D of them hold at least D^2 / 2 tokens, so 10^13 tokens have fewer than
    five million."""

    def run(key, frame):
        frame = frame.sort_values("size", ascending=False, kind="stable")
        n, size = frame["n"].tolist(), frame["size"].tolist()
        wanted = [a * s * r for a, s, r in zip(n, size, frame["rate"].tolist())]
        carry = (frame["target"].iloc[0] - sum(wanted)) if len(frame) else 0.0
        out = []
        for a, s, w in zip(n, size, wanted):
            if s == 0:
                out.append(a)
                continue
            copies = min(max(int((w + carry) // s + ((w + carry) % s >= s / 2)), 0), most * a)
            carry += w - copies * s
            out.append(copies)
        return frame.assign(copies=out)[["src", "size", "n", "rate", "copies"]]

    return run


def mix_sources(
    docs: DataFrame, source: Column, id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS,
    percent: int = PERCENT, most: int = MOST,
) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies, taken) for every row of `docs`.

    size: words between ASCII white space, 0 for a null text.  Sources are ordered by code point, null last, and weigh
    `weights` in turn; together they take `percent` of all sizes.  A source's target stops at `most` times its
    size, the excess is shared by weight among the others.  copies: how often the mix takes the whole row, at most
    `most` times; taken: copies * size.  Rows without words are taken once and add nothing; a source without words
    has the target 0.  Rows that share an id or are repeated are rows like others: among equal ones it makes no difference which
    gets a copy.  Very long texts are only counted.  An empty table gives an empty result; other columns are not read.
    """
    key = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))
    rows = materialize(docs.select(F.col(id_col).alias("id"), key.alias("src"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    cells = materialize(rows.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")

    sizes = cells.groupBy("src").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.sum(F.col("n") * F.col("size").cast("decimal(19,0)") * F.col("size")).cast("double").alias("squares"),
    )
    placed = with_row_index(sizes.withColumn("none", F.col("src") == ""), ["none", "src"], "place")
    in_turn = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    sources = materialize(placed.select(
        "src", "source_size", in_turn.cast("long").alias("weight"),
        F.coalesce(F.try_divide(F.col("squares"), F.col("source_size")), F.lit(1.0)).alias("scale"),
    ), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("x")).first()["x"] * percent / 100
    sources = materialize(water_filled(sources, total, most), "mix-targets")

    solved = _solve(cells, sources.filter("source_size > 0"), most)
    rated = cells.join(sources, "src").join(solved, "src", "left").withColumn("rate", tilt(most))
    rated = rated.select("src", "size", "n", F.coalesce("rate", F.lit(1.0)).alias("rate"), "target")
    whole = materialize(
        rated.groupBy("src").applyInPandas(_round_source(most), "src string, size long, n long, rate double, copies long"), "mix-copies"
    )

    # The documents of a cell in the order of a hash: sorted by range, so a cell of any size is spread over tasks.
    spread = F.xxhash64(F.col("id").cast("string"))
    placed = materialize(with_row_index(rows, ["src", "size", spread, "id"], "place"), "mix-order")
    first = placed.groupBy("src", "size").agg(F.min("place").alias("first"))
    table = whole.join(first, ["src", "size"]).join(sources.select("src", "source_size", "target"), "src")
    table = materialize(table, "mix-table")
    rank = F.col("place") - F.col("first")
    share = F.floor((rank + 1) * F.col("copies") / F.col("n")) - F.floor(rank * F.col("copies") / F.col("n"))
    joined = placed.join(table, ["src", "size"]).withColumn("own", share.cast("long"))
    return joined.select(
        F.col("id").alias(id_col), F.when(F.col("src") != "", F.expr("substring(src, 2)")).alias("source"), "size", "source_size",
        "target", "rate", F.col("own").alias("copies"), (F.col("own") * F.col("size")).alias("taken"),
    )


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


QUERIES = {"op12_mixing": op12_mixing}
ORACLES: dict = {}
