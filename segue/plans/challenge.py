"""The whole run: ten classes of incomplete lists, one result table.

Each class is routed by its seed count, title and seed order, retrieved and ranked in its own
way, filled up by popularity and put under the others."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, partial, reduce

from pyspark.sql import DataFrame, Window, functions as F

from segue.functions.hashing import hash_below, stable_hash
from segue.operators import cooccur, features, models, order, rank, relational as rel, retrieve, splits, title
from segue.operators.listmodels import STEPS
from segue.plans.tables import Tables
from segue.session import materialize, together


@dataclass(frozen=True)
class TwoStage:
    """A class that is retrieved by co-occurrence and ranked by boosted trees."""

    seeds: int
    freq: bool
    names: bool
    rows: float = models.GBT_ROWS


@dataclass(frozen=True)
class Classifier:
    """A class that is ranked by the linear classifier on co-occurrence features."""

    weighted: bool
    c: float


# How each slice is made.
TWO_STAGE = {
    "v2": TwoStage(1, freq=True, names=True, rows=models.GBT_ROWS_ONE_SEED),
    "v3": TwoStage(5, freq=True, names=True),
    "v5": TwoStage(10, freq=False, names=True),
    "v6": TwoStage(10, freq=False, names=False),
}
CLASSIFIERS = {
    "v7": Classifier(weighted=False, c=0.05),
    "v8": Classifier(weighted=True, c=0.8),
    "v9": Classifier(weighted=False, c=0.05),
    "v10": Classifier(weighted=True, c=0.4),
}
HOLDOUT_LISTS = 12_000  # training lists that a second stage is fit on, about so many, drawn by a hash
VALID_SEED = 1


@dataclass
class Challenge:
    """train: (pid, pos, track); lists: (pid, clean, num_tracks); test_lists: (pid, name, clean,
    num_samples); seeds: (pid, file_pos, pos, track); items with whole-number album and artist."""

    train: DataFrame
    lists: DataFrame
    test_lists: DataFrame
    seeds: DataFrame
    items: DataFrame
    width: int = 500
    depth: int = 1000
    rounds: int = models.GBT_ROUNDS
    rate: float = models.GBT_RATE
    vector_size: int = models.EMBEDDING_SIZE
    vector_rounds: int = models.EMBEDDING_ROUNDS
    svc_steps: int = STEPS
    holdout_lists: int = HOLDOUT_LISTS
    _held: dict[int, DataFrame] = field(default_factory=dict)
    _holdouts: dict[int, DataFrame] = field(default_factory=dict)

    @classmethod
    def from_tables(cls, t: Tables) -> "Challenge":
        """The run over the star schema, with all trainings at full length."""
        marked = splits.split_lists(t.sized_lists)
        test = marked.filter("is_test")
        # The seeds of a test list are its first rows; lists with a longer title give them shuffled.
        by_pos = Window.partitionBy("pid").orderBy("pos", "track")
        first = t.test.withColumn("rn", F.row_number().over(by_pos)).filter(F.col("rn") <= 100)
        wanted = first.join(test.select("pid", "clean", "num_samples"), "pid").filter(F.col("rn") <= F.col("num_samples"))
        shuffled = F.conv(F.substring(stable_hash("pid", "rn"), 1, 8), 16, 10).cast("bigint")
        in_order = F.coalesce(F.locate(" ", "clean") == 0, F.lit(True))
        seeds = wanted.select(
            "pid", F.when(in_order, F.col("rn")).otherwise(shuffled).alias("file_pos"),
            (F.col("rn") - 1).alias("pos"), "track",
        )
        return cls(
            materialize(t.train, "train"), materialize(marked.filter("not is_test").drop("is_test"), "lists"),
            materialize(test.drop("is_test"), "test-lists"), materialize(seeds, "test-seeds"), t.encoded_items,
        )

    @cached_property
    def slices(self) -> DataFrame:
        """(pid, slice): the class of every test list; 25 and 100 seeds split on their order."""
        routed = self.test_lists.withColumn("subtask", rel.route_subtask())
        flags = rel.ordered_flag(self.seeds, 25).unionByName(rel.ordered_flag(self.seeds, 100))
        joined = routed.join(flags, "pid", "left")
        ordered = F.coalesce(F.col("ordered"), F.lit(0)) == 1
        name = (
            F.when(F.col("subtask") == "v7", F.when(ordered, "v7").otherwise("v8"))
            .when(F.col("subtask") == "v8", F.when(ordered, "v9").otherwise("v10"))
            .otherwise(F.col("subtask"))
        )
        return materialize(joined.select("pid", "clean", name.alias("slice")), "slices")

    @cached_property
    def cells(self) -> cooccur.Cells:
        return cooccur.cells_of(self.train)

    @cached_property
    def counted_cells(self) -> cooccur.Cells:
        return cooccur.cells_of(self.train, counted=True)

    @cached_property
    def popular(self) -> DataFrame:
        """(rank, track): all tracks by falling popularity, ordered once for all slices."""
        return materialize(order.popularity_order(self.freq).select("rank", "track"), "popular")

    @cached_property
    def freq(self) -> DataFrame:
        return materialize(rel.track_freq(self.train), "freq")

    def held(self, n: int) -> DataFrame:
        """Training lists that are cut to n seeds for the second stage."""
        if n not in self._held:
            fitting = rel.drop_null_lists(rel.filter_length(self.lists, n), ["clean"])
            share = min(1.0, self.holdout_lists / max(fitting.count(), 1))
            self._held[n] = materialize(fitting.select("pid").filter(hash_below(share, "pid", seed=n)), "held")
        return self._held[n]

    @cached_property
    def embeddings(self) -> dict:
        """Vectors of tracks, albums and artists, trained once, without the lists that validate a second stage."""
        held = reduce(DataFrame.unionByName, [self.held(n) for n in sorted({p.seeds for p in TWO_STAGE.values()})])
        rows = rel.drop_pids(self.train, held.filter(hash_below(0.2, "pid", seed=VALID_SEED)))
        album, artist = self.items.select("track", "album"), self.items.select("track", "artist")
        keys = {"w2v_track_sim": None, "w2v_album_sim": album, "w2v_artist_sim": artist}

        def train(own: DataFrame | None) -> DataFrame:
            return materialize(models.train_embeddings(models.key_rows(rows, own), self.vector_size, self.vector_rounds), "vectors")

        found = together(rows.sparkSession, [partial(train, own) for own in keys.values()])
        return {name: (vectors, own) for (name, own), vectors in zip(keys.items(), found)}

    def holdout(self, n: int) -> DataFrame:
        """Labelled features of training lists cut to n seeds."""
        if n not in self._holdouts:
            held = self.held(n)
            seeds, truth = splits.split_prefix(rel.keep_pids(self.train, held), n)
            seeds, truth = materialize(seeds, "seeds"), materialize(truth, "truth")
            found = retrieve.cf_recommend(seeds, cooccur.without_lists(self.cells, held), self.depth)
            table = features.feature_table(
                found.withColumnRenamed("score", "cf_prob"), truth, seeds, self.items, self.lists, self.freq,
                self.embeddings,
            )
            self._holdouts[n] = materialize(table, "features")
        return self._holdouts[n]

    def two_stage(self, plan: TwoStage, pids: DataFrame, seeds: DataFrame) -> DataFrame:
        table = self.holdout(plan.seeds)
        unused = ([] if plan.freq else ["freq"]) + ([] if plan.names else features.NAME_COLUMNS)
        model = models.gbt_train(
            table.drop(*unused), self.rounds, self.rate, plan.rows, seed=VALID_SEED
        )
        found = retrieve.cf_recommend(seeds, self.cells, self.depth).withColumnRenamed("score", "cf_prob")
        wanted = features.feature_table(
            found, None, seeds, self.items, pids, self.freq if plan.freq else None,
            self.embeddings, plan.names,
        )
        return rank.rank_emit(models.gbt_score(model, wanted), seeds, self.width + 50, self.width, "prob")

    def classified(self, plan: Classifier, seeds: DataFrame) -> DataFrame:
        build = cooccur.weighted_packs if plan.weighted else cooccur.normalised_packs
        return models.svc_rerank(build(seeds, self.counted_cells), seeds, self.items, plan.c, self.width, self.svc_steps)

    def from_titles(self, pids: DataFrame) -> DataFrame:
        titled = rel.drop_null_lists(self.lists, ["clean"])
        known = cooccur.of_lists(self.cells, titled)
        found = title.title_recommend(pids, titled, self.train, known, self.width)
        lost = title.lists_without_known_word(pids, titled)
        drawn = rank.random_tracks(lost, self.items, self.width)
        return found.select("pid", "rank", "track").unionByName(drawn.select("pid", "rank", "track"))

    def slice(self, name: str) -> DataFrame:
        """(pid, rank, track) of one class, every list filled up to the full width."""
        pids = self.slices.filter(F.col("slice") == name)
        seeds = materialize(rel.keep_pids(self.seeds, pids).select("pid", "pos", "track"), "slice-seeds")
        if name == "v1":
            found = self.from_titles(pids)
        elif name in TWO_STAGE:
            found = self.two_stage(TWO_STAGE[name], pids, seeds)
        elif name in CLASSIFIERS:
            found = self.classified(CLASSIFIERS[name], seeds)
        else:
            found = retrieve.cf_recommend(seeds, self.cells, self.width)
        found = materialize(found.select("pid", "rank", "track"), "found")
        return rank.popularity_backfill(pids, found, seeds, self.popular, self.width)

    def second_stages(self, names: list[str]) -> list[DataFrame]:
        """The two-stage classes; what several of them read is made before they are run together."""
        if not names:
            return []
        seeds, spark = sorted({TWO_STAGE[name].seeds for name in names}), self.train.sparkSession
        self.embeddings
        together(spark, [partial(self.holdout, n) for n in seeds])
        return together(spark, [partial(self.slice, name) for name in names])

    def run(self) -> DataFrame:
        """(slice, pid, rank, track) over all classes that have lists.

        The classes do not need one another and are made at the same time, after what all of them read."""
        present = {r["slice"] for r in self.slices.select("slice").dropna().distinct().collect()}  # ten at most
        names = [f"v{i}" for i in range(1, 11) if f"v{i}" in present]
        trained, others = [n for n in names if n in TWO_STAGE], [n for n in names if n not in TWO_STAGE]
        self.popular, self.cells
        if any(n in CLASSIFIERS for n in others):
            self.counted_cells
        done, *rest = together(
            self.train.sparkSession, [partial(self.second_stages, trained), *[partial(self.slice, name) for name in others]]
        )
        made = {**dict(zip(trained, done)), **dict(zip(others, rest))}
        return rank.union_slices({name: made[name] for name in names})
