"""Every operator as a query over the star schema, keyed by its name in the blueprint."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from segue import schemas, sources
from segue.functions.hashing import hash_below
from segue.functions.lists import list_concat, list_split, parse_list
from segue.functions.titles import clean_title, title_ngrams, title_tokens, title_weight
from segue.operators import cooccur, features, listmodels, metrics, models, order, rank, relational as rel, retrieve, splits, title, windows
from segue.plans.challenge import Challenge
from segue.plans.tables import Tables
from segue.session import configure, materialize, spread, stage_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOP = 500  # recommendation depth
SHOWN = 10  # depth of the small top-k reports


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register under the function's name; a trailing underscore keeps clear of an import."""
    QUERIES[fn.__name__.rstrip("_")] = lambda spark, folder: fn(Tables(configure(spark), folder))
    return fn


def _names(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    return items.select("track", "album"), items.select("track", "artist")


# ---- sources and sinks


@query
def src_json_lists(t: Tables) -> DataFrame:
    lists = sources.read_json_lists(t.spark, t.json_slices())
    return lists.select("pid", "name", "num_tracks", F.size("tracks").alias("n_tracks"))


@query
def unnest_tracks(t: Tables) -> DataFrame:
    return sources.unnest_tracks(sources.read_json_lists(t.spark, t.json_slices()))


@query
def src_csv_gz(t: Tables) -> DataFrame:
    path = stage_path(t.spark, "csv")
    sources.write_table(t.interactions.select("pos", "track", "pid"), path, "csv")
    return sources.read_csv_gz(t.spark, path, schemas.INTERACTIONS, ["pid", "track"])


@query
def src_json_test_lists(t: Tables) -> DataFrame:
    """Incomplete lists: null titles, and fields that the files leave out, come as nulls."""
    lists = sources.read_json_lists(t.spark, t.json_test_slices(), schemas.TEST_SLICE)
    rows = lists.select("pid", "name", "num_samples", "num_holdouts", F.explode("tracks").alias("t"))
    return rows.select("pid", "name", "num_samples", "num_holdouts", "t.pos", "t.track_uri", "t.album_uri")


@query
def src_range_csv(t: Tables) -> DataFrame:
    path = stage_path(t.spark, "rows")
    t.interactions.select(*schemas.INTERACTIONS.names).write.csv(path)
    return sources.read_csv_rows(t.spark, path, schemas.INTERACTIONS, ["pid", "pos", "track"], skip=1000)


@query
def src_triplets(t: Tables) -> DataFrame:
    path = stage_path(t.spark, "triplets")
    t.triplets.write.option("sep", "\t").csv(path)
    return sources.read_triplets(t.spark, path)


@query
def src_sep_tracks(t: Tables) -> DataFrame:
    path = stage_path(t.spark, "sep")
    line = F.concat_ws("<SEP>", "artist", F.col("track").cast("string"), "artist_name", "track_name")
    t.items.select(line).write.text(path)
    return sources.read_sep_tracks(t.spark, path)


@query
def src_lines(t: Tables) -> DataFrame:
    path = stage_path(t.spark, "lines")
    t.read("customer").select(F.concat(F.lit("  "), "c_name", F.lit(" "))).write.text(path)
    return sources.read_lines(t.spark, path)


def _song_index(t: Tables) -> DataFrame:
    ids = order.dense_ids(t.triplets.select("song"))
    path = stage_path(t.spark, "song-index")
    ids.write.option("sep", " ").csv(path)
    return sources.read_key_value(t.spark, path)


@query
def src_key_value(t: Tables) -> DataFrame:
    return _song_index(t)


@query
def sink_table(t: Tables) -> DataFrame:
    path = stage_path(t.spark, "table")
    sources.write_table(t.interactions, path)
    return t.spark.read.parquet(path)


@query
def sink_submission(t: Tables) -> DataFrame:
    path = stage_path(t.spark, "submission")
    best = rank.topk_per_list(t.scored, TOP, "cf_prob")
    sources.write_submission(best, path, TOP)
    fields = ", ".join(["pid bigint"] + [f"t{i} bigint" for i in range(1, TOP + 1)])
    return t.spark.read.schema(fields).option("header", True).csv(path)


@query
def sink_indexed_lines(t: Tables) -> DataFrame:
    path = stage_path(t.spark, "indexed")
    songs = rank.topk_per_list(t.scored, TOP, "cf_prob").select("pid", "rank", F.concat(F.lit("S"), F.col("track").cast("string")).alias("song"))
    sources.write_indexed_lines(songs, _song_index(t), path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


# ---- projections, filters, sampling


@query
def project_drop(t: Tables) -> DataFrame:
    return t.items.drop("artist_name", "album_name").withColumnRenamed("track", "track_uri")


@query
def route_subtask(t: Tables) -> DataFrame:
    return t.sized_lists.select("pid", "num_samples", rel.route_subtask().alias("subtask"))


@query
def filter_length(t: Tables) -> DataFrame:
    kept = [rel.filter_length(t.sized_lists, n).select(F.lit(n).alias("seeds"), "pid", "num_tracks") for n in (1, 5, 10)]
    return reduce(DataFrame.unionByName, kept)


@query
def drop_null_lists(t: Tables) -> DataFrame:
    return rel.drop_null_lists(t.lists, ["pid", "clean"])


@query
def head_n(t: Tables) -> DataFrame:
    return order.head_n(t.lists.select("pid", "name"), 1000, ["pid"])


@query
def semi_pids(t: Tables) -> DataFrame:
    return rel.keep_pids(t.interactions, rel.drop_null_lists(t.lists, ["clean"]))


@query
def anti_pids(t: Tables) -> DataFrame:
    _, test = t.marked_lists()
    return rel.drop_pids(t.interactions, test)


@query
def sample_ratio_users(t: Tables) -> DataFrame:
    users = rel.drop_null_lists(t.lists, ["clean"]).select(F.col("pid").cast("string").alias("user"))
    return rel.sample_rows(t.triplets, 0.5, users, seed=7)


@query
def fill_zero(t: Tables) -> DataFrame:
    freq = rel.track_freq(t.train)
    return rel.fill_zero(t.items.select("track").join(freq, "track", "left"), ["freq"])


@query
def order_flag(t: Tables) -> DataFrame:
    return rel.ordered_flag(t.orders_as_lists, 3)


# ---- joins


@query
def join_list_items(t: Tables) -> DataFrame:
    return rel.lists_with_items(t.lists, t.interactions)


@query
def join_label(t: Tables) -> DataFrame:
    return features.label_candidates(t.scored, t.returned)


@query
def join_popularity(t: Tables) -> DataFrame:
    return features.add_popularity(t.scored, rel.track_freq(t.interactions))


@query
def lookup_item_attrs(t: Tables) -> DataFrame:
    return features.add_item_attrs(t.scored, t.items)


@query
def lookup_title(t: Tables) -> DataFrame:
    return features.add_title(t.scored, t.lists)


@query
def join_seeds(t: Tables) -> DataFrame:
    first = splits.first_items(t.interactions, 5).select("pid", "pos", F.col("track").alias("seed"))
    return t.scored.join(first, "pid", "left")


@query
def self_join_cooc(t: Tables) -> DataFrame:
    seeds, _ = t.holdout()
    cells = cooccur.cells_of(t.train)
    return cooccur.seed_cooccurrence(seeds, cells, cooccur.list_counts(cells)).select("seed", "track", "c")


@query
def anti_seeds(t: Tables) -> DataFrame:
    return rank.drop_seeds(t.scored, splits.first_items(t.interactions, 5))


@query
def decode_ids(t: Tables) -> DataFrame:
    ids = order.dense_ids(t.uris.select("uri"))
    encoded = order.encode(t.uris, ids, "uri", "track")
    return order.decode(encoded, ids, "track", "track_uri")


# ---- aggregations


@query
def track_freq(t: Tables) -> DataFrame:
    return rel.track_freq(t.interactions)


@query
def track_list_count(t: Tables) -> DataFrame:
    return rel.track_list_count(t.train, t.items)


@query
def user_count(t: Tables) -> DataFrame:
    return rel.rows_per_key(t.interactions, "pid")


@query
def list_size_sum(t: Tables) -> DataFrame:
    songs = rel.rows_per_key(t.interactions, "track", "total").select(F.lit("song").alias("side"), F.col("track").alias("id"), "total")
    lists = rel.rows_per_key(t.interactions, "pid", "total").select(F.lit("list").alias("side"), F.col("pid").alias("id"), "total")
    return songs.unionByName(lists)


@query
def popularity_order(t: Tables) -> DataFrame:
    return order.popularity_order(rel.track_freq(t.interactions))


@query
def collect_items(t: Tables) -> DataFrame:
    return rel.ordered_items(t.interactions, 50).select("pid", "chunk", list_concat("tracks").alias("tracks"))


@query
def track_to_lists(t: Tables) -> DataFrame:
    return rel.distinct_cells(t.interactions, "track", "pid")


@query
def user_to_tracks(t: Tables) -> DataFrame:
    return rel.distinct_cells(t.triplets, "user", "song")


@query
def distinct_users(t: Tables) -> DataFrame:
    return t.triplets.select("user").distinct()


@query
def first_per_key(t: Tables) -> DataFrame:
    rows = t.interactions.select("track", "pid", "pos")
    return rel.first_per_key(rows, "track", ["pid", "pos"])


@query
def group_mean(t: Tables) -> DataFrame:
    return features.group_mean(t.scored)


@query
def metric_mean(t: Tables) -> DataFrame:
    # Lists without a returned row have nothing hidden, so there is nothing to measure on them.
    means = metrics.evaluate(rel.keep_pids(t.predictions, t.returned), t.returned)
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@query
def describe_scores(t: Tables) -> DataFrame:
    stats = order.describe(t.scored, "cf_prob")
    return stats.select("column", "count", *[F.round(c, 2).alias(c) for c in stats.columns[2:]])


# ---- windows, top-k, splits


@query
def topk_per_list(t: Tables) -> DataFrame:
    return rank.topk_per_list(t.scored, SHOWN, "cf_prob")


@query
def topk_per_list_500(t: Tables) -> DataFrame:
    return rank.topk_per_list(t.scored, TOP, "cf_prob")


@query
def topk_oversample(t: Tables) -> DataFrame:
    seeds = splits.first_items(t.interactions, 5)
    return rank.topk_per_list(rank.drop_seeds(t.scored, seeds), SHOWN, "cf_prob")


@query
def topk_oversample_1000(t: Tables) -> DataFrame:
    return rank.rank_emit(t.scored, splits.first_items(t.interactions, 5), top=1100, k=1000, score="cf_prob")


@query
def dense_encode(t: Tables) -> DataFrame:
    train = t.uris.join(t.marked_lists()[0].select("pid"), "pid", "left_semi")
    test = t.uris.join(t.marked_lists()[1].select("pid"), "pid", "left_semi")
    return order.dense_ids(train.select("uri"), test.select("uri"))


@query
def relative_score(t: Tables) -> DataFrame:
    scored = features.relative_score(t.scored)
    return scored.select("pid", "track", "cf_prob", F.round("cf_rlt_prob", 6).alias("cf_rlt_prob"))


@query
def split_prefix(t: Tables) -> DataFrame:
    marked = splits.mark_prefix(t.interactions, 5)
    return marked.select("pid", "pos", "track", F.when(F.col("is_seed"), "seed").otherwise("truth").alias("part"))


@query
def split_random_items(t: Tables) -> DataFrame:
    seeds, truth, train = splits.split_random_items(t.interactions, 10, seed=1)
    named = [("seed", seeds), ("truth", truth), ("train", train)]
    return reduce(DataFrame.unionByName, [df.select("pid", "track", F.lit(n).alias("part")) for n, df in named])


@query
def split_sequential(t: Tables) -> DataFrame:
    return splits.split_sequential(t.lists.select("pid", "name"), 1000, 200)


@query
def split_lists_80_20(t: Tables) -> DataFrame:
    return splits.split_lists(t.lists.select("pid"))


# ---- set operations


@query
def union_train_test(t: Tables) -> DataFrame:
    return t.train.unionByName(t.test)


@query
def union_slices(t: Tables) -> DataFrame:
    routed = t.sized_lists.select("pid", rel.route_subtask().alias("subtask"))
    best = materialize(t.ranked.join(routed, "pid"), "ranked")
    return rank.union_slices({v: best.filter(F.col("subtask") == v) for v in rel.SUBTASK_SAMPLES})


@query
def intersect_lists(t: Tables) -> DataFrame:
    return t.scored.select("pid", "track").join(t.returned.select("pid", "track").distinct(), ["pid", "track"], "left_semi")


@query
def except_lists(t: Tables) -> DataFrame:
    seeds = splits.first_items(t.interactions, 5)
    return rank.drop_seeds(t.interactions.select("pid", "track").distinct(), seeds)


# ---- scalar functions


@query
def clean_title_(t: Tables) -> DataFrame:
    docs = spread(t.read("documents").select("doc_id", "text")).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), "text")
    talk = t.read("conversations").select(F.lit("conv").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    return docs.unionByName(talk).select("kind", "id", "turn", clean_title("text").alias("clean"))


def _clean_docs(t: Tables) -> DataFrame:
    return spread(t.read("documents").select("doc_id", "text")).select("doc_id", clean_title("text").alias("clean"))


@query
def title_tokens_(t: Tables) -> DataFrame:
    words = _clean_docs(t).select("doc_id", F.explode(title_tokens("clean")).alias("token"))
    return words.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query
def title_ngrams_(t: Tables) -> DataFrame:
    return _clean_docs(t).select("doc_id", F.explode(title_ngrams("clean")).alias("ngram"))


@query
def vocab_index(t: Tables) -> DataFrame:
    grams = t.lists.select(F.explode(title_ngrams("clean")).alias("ngram"))
    return order.dense_ids(grams).select(F.col("value").alias("ngram"), F.col("id").alias("idx"))


@query
def title_weight_(t: Tables) -> DataFrame:
    return rel.drop_null_lists(t.lists, ["clean"]).select("pid", "clean", title_weight("clean").alias("weight"))


def _arrays(t: Tables) -> DataFrame:
    """(pid, chunk, pred[], scores[]): all candidates of a list in order, in arrays of at most 50."""
    packed = F.array_sort(F.collect_list(F.struct("rank", "track", "cf_prob")))
    return t.ranked.groupBy("pid", F.floor((F.col("rank") - 1) / 50).alias("chunk")).agg(
        F.transform(packed, lambda x: x["track"]).alias("pred"),
        F.transform(packed, lambda x: x["cf_prob"]).alias("scores"),
    )


@query
def list_concat_(t: Tables) -> DataFrame:
    text = _arrays(t).select("pid", "chunk", list_concat("pred").alias("text"))
    return text.select("pid", "chunk", "text", F.posexplode(list_split("text")).alias("i", "track"))


@query
def parse_list_(t: Tables) -> DataFrame:
    text = _arrays(t).select("pid", "chunk", F.concat(F.lit("["), F.array_join("pred", ", "), F.lit("]")).alias("text"))
    return text.select("pid", "chunk", F.posexplode(parse_list("text")).alias("i", "track"))


@query
def explode_scored(t: Tables) -> DataFrame:
    return features.explode_scored(_arrays(t))


def _named(t: Tables) -> DataFrame:
    return features.add_title(features.add_item_attrs(t.scored, t.items), t.lists)


@query
def name_similarity(t: Tables) -> DataFrame:
    sims = features.name_similarities(_named(t))
    return sims.select("pid", "track", *[F.round(c, 6).alias(c) for c in features.NAME_COLUMNS])


# ---- retrieval


@query
def item_sim_pairs(t: Tables) -> DataFrame:
    """Every list's first track paired with each of its other tracks."""
    first = rel.first_per_key(t.interactions, "pid", ["pos", "track"]).select("pid", F.col("track").alias("s"))
    pairs = t.interactions.select("pid", F.col("track").alias("u")).join(first, "pid").filter("s <> u")
    sims = cooccur.pair_similarity(pairs, cooccur.cells_of(t.interactions))
    return sims.select("s", "u", F.round("sim", 6).alias("sim"))


@query
def cf_score(t: Tables) -> DataFrame:
    seeds, _ = t.holdout()
    scored = retrieve.cf_score(seeds, cooccur.cells_of(t.train))
    return scored.select("pid", "track", rank.rounded("score").alias("score"))


@query
def cf_recommend(t: Tables) -> DataFrame:
    seeds, _ = t.holdout()
    return retrieve.cf_recommend(seeds, cooccur.cells_of(t.train), TOP)


@query
def evaluate_cf(t: Tables) -> DataFrame:
    seeds, truth = t.holdout()
    # Lists of at most five rows have nothing hidden, so there is nothing to measure on them.
    found = retrieve.cf_recommend(seeds, cooccur.cells_of(t.train), 2 * TOP)
    found = found.join(truth.select("pid").distinct(), "pid", "left_semi")
    means = metrics.evaluate(found, truth)
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@query
def popularity_backfill(t: Tables) -> DataFrame:
    """Lists filled up to the recommendation depth from what they would get by price."""
    seeds = materialize(splits.first_items(t.interactions, 5), "seeds")
    own = materialize(rank.topk_per_list(rank.drop_seeds(t.scored, seeds), SHOWN, "cf_prob"), "own")
    popular = order.popularity_order(rel.track_freq(t.interactions))
    return rank.popularity_backfill(t.lists, own, seeds, popular, TOP)


def _title_weights(t: Tables) -> tuple[DataFrame, DataFrame]:
    train, test = t.marked_lists()
    return test, title.ngram_weights(train, t.interactions)


@query
def title_ngram_track(t: Tables) -> DataFrame:
    return title.ngram_weights(t.lists, t.interactions)


@query
def title_score(t: Tables) -> DataFrame:
    return title.title_scores(*_title_weights(t))


@query
def title_expand(t: Tables) -> DataFrame:
    train, _ = t.marked_lists()
    best = title.best_title_tracks(materialize(title.title_scores(*_title_weights(t)), "title-scores"))
    cells = cooccur.cells_of(rel.keep_pids(t.interactions, rel.drop_null_lists(train, ["clean"])))
    nb = title.title_expand(best, cells)
    return nb.select("clean", "track", F.round("nb", 6).alias("nb"))


@query
def title_recommend(t: Tables) -> DataFrame:
    train, test = t.marked_lists()
    cells = cooccur.cells_of(rel.keep_pids(t.interactions, rel.drop_null_lists(train, ["clean"])))
    return title.title_recommend(test, train, t.interactions, cells, TOP)


@query
def title_fallback(t: Tables) -> DataFrame:
    train, _ = t.marked_lists()
    return rank.random_tracks(title.lists_without_known_word(t.lists, train), t.items, TOP, seed=3)


@query
def cooc_norm_features(t: Tables) -> DataFrame:
    seeds, _ = t.holdout()
    v = cooccur.normalised_features(seeds, cooccur.cells_of(t.train, counted=True))
    return v.select("seed", "track", F.round("v", 6).alias("v"))


@query
def list_weight(t: Tables) -> DataFrame:
    seeds, _ = t.holdout()
    w = cooccur.list_weights(seeds, cooccur.cells_of(t.train, counted=True))
    return w.select("test", "pid", F.round("w", 6).alias("w"))


@query
def cooc_weighted_features(t: Tables) -> DataFrame:
    seeds, _ = t.holdout()
    v = cooccur.weighted_features(seeds, cooccur.cells_of(t.train, counted=True))
    return v.select("test", "seed", "track", F.round("v", 6).alias("v"))


def _values(t: Tables, seeds: DataFrame, weighted: bool) -> cooccur.Packs:
    build = cooccur.weighted_packs if weighted else cooccur.normalised_packs
    return build(seeds, cooccur.cells_of(t.train, counted=True))


@query
def svc_features(t: Tables) -> DataFrame:
    seeds, _ = t.holdout()
    table = models.svc_features(_values(t, seeds, weighted=False), seeds)
    return table.select("test", "track", "label", "v_count", *[F.round(c, 6).alias(c) for c in ("v_sum", "v_mean", "v_max")])


@query
def svc_rows(t: Tables) -> DataFrame:
    """What each list's own model is fit on: the values of its candidates by its seeds."""
    seeds, _ = t.holdout()
    rows = listmodels.candidate_rows(_values(t, seeds, weighted=False), seeds, t.items)
    return rows.select("test", "k", "track", F.col("label").cast("int").alias("label"), "times", F.size("at").alias("n_terms"),
                       F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("v_sum"))


@query
def svc_rerank(t: Tables) -> DataFrame:
    seeds, _ = t.holdout()
    return models.svc_rerank(_values(t, seeds, weighted=False), seeds, t.items, c=0.05, k=TOP)


@query
def svc_rerank_weighted(t: Tables) -> DataFrame:
    seeds, _ = t.holdout()
    return models.svc_rerank(_values(t, seeds, weighted=True), seeds, t.items, c=0.8, k=TOP)


# ---- learned features and models


@query
def w2v_pairs(t: Tables) -> DataFrame:
    """The neighbours that the vectors of tracks are made from."""
    return windows.window_pairs(models.key_rows(t.train))


@query
def w2v_artist_pairs(t: Tables) -> DataFrame:
    _, artist = _names(t.items)
    return windows.window_pairs(models.key_rows(t.train, artist))


@query
def w2v_tracks(t: Tables) -> DataFrame:
    return models.train_embeddings(models.key_rows(t.train))


@query
def w2v_albums(t: Tables) -> DataFrame:
    album, _ = _names(t.items)
    return models.train_embeddings(models.key_rows(t.train, album))


@query
def w2v_artists(t: Tables) -> DataFrame:
    _, artist = _names(t.items)
    return models.train_embeddings(models.key_rows(t.train, artist))


@query
def seed_embed_similarity(t: Tables) -> DataFrame:
    seeds = splits.first_items(t.interactions, 5)
    sims = features.seed_similarity(t.scored, seeds, t.vectors, "w2v_track_sim")
    return sims.select("pid", "track", F.round("w2v_track_sim", 6).alias("w2v_track_sim"))


@query
def vector_topk(t: Tables) -> DataFrame:
    first = features.first_with_vector(t.interactions, t.vectors)
    return features.vector_topk(first, t.vectors, TOP)


@query
def vector_truth(t: Tables) -> DataFrame:
    """What the nearest items are held against: every list's rows without its query track."""
    return features.truth_without_query(t.interactions, features.first_with_vector(t.interactions, t.vectors))


def _feature_table(t: Tables) -> DataFrame:
    seeds = splits.first_items(t.interactions, 5)
    return features.feature_table(
        rank.drop_seeds(t.scored, seeds), t.returned, seeds, t.encoded_items, t.lists, rel.track_freq(t.interactions),
        {"w2v_track_sim": (t.vectors, None)},
    )


@query
def feature_table(t: Tables) -> DataFrame:
    table = _feature_table(t)
    floats = features.NAME_COLUMNS + ["cf_rlt_prob", "w2v_track_sim"]
    return table.select(
        "pid", "track", "cf_prob", "label", "freq", "artist", "album", *[F.round(c, 6).alias(c) for c in floats]
    )


@query
def gbt_train(t: Tables) -> DataFrame:
    """The trained model's feature importances."""
    weights = models.gbt_train(_feature_table(t)).importances
    return t.spark.createDataFrame(list(weights.items()), "feature string, importance double")


@query
def gbt_report(t: Tables) -> DataFrame:
    """The squared error on the validation lists after each round that was tried, and the area under the curve of the kept rounds."""
    done = models.gbt_train(_feature_table(t))
    rows = [(i + 1, e, i + 1 <= done.rounds, done.auc) for i, e in enumerate(done.errors)]
    return t.spark.createDataFrame(rows, "round int, squared_error double, kept boolean, auc double")


@query
def gbt_score(t: Tables) -> DataFrame:
    table = materialize(_feature_table(t), "features")
    return models.gbt_score(models.gbt_train(table), table)


@query
def rank_emit(t: Tables) -> DataFrame:
    seeds = splits.first_items(t.interactions, 5)
    return rank.rank_emit(t.scored, seeds, top=SHOWN + 5, k=SHOWN, score="cf_prob")


@query
def rank_emit_500(t: Tables) -> DataFrame:
    return rank.rank_emit(t.scored, splits.first_items(t.interactions, 5), top=TOP + 50, k=TOP, score="cf_prob")


# ---- evaluation


def _metric(fn: Callable[[DataFrame, DataFrame], DataFrame], t: Tables) -> DataFrame:
    values = fn(t.predictions, t.returned)
    return values.select("pid", *[F.round(c, 6).alias(c) for c in values.columns[1:]])


@query
def metric_r_precision(t: Tables) -> DataFrame:
    return _metric(metrics.r_precision, t)


@query
def metric_ndcg(t: Tables) -> DataFrame:
    return _metric(metrics.ndcg, t)


@query
def metric_clicks(t: Tables) -> DataFrame:
    return _metric(metrics.clicks, t)


@query
def metric_coverage(t: Tables) -> DataFrame:
    return _metric(metrics.coverage, t)


@query
def metric_recall_ndcg_alt(t: Tables) -> DataFrame:
    return _metric(metrics.recall_ndcg_alt, t)


@query
def metric_group_rprec(t: Tables) -> DataFrame:
    values = metrics.group_r_precision(features.label_candidates(t.scored, t.returned), "cf_prob")
    return values.select("pid", F.round("r_precision", 6).alias("r_precision"))


def _before_and_after(before: DataFrame, after: DataFrame, truth: DataFrame) -> DataFrame:
    """The mean metrics of two rankings of the same lists."""
    rows = []
    for stage, ranked in (("before", before), ("after", after)):
        means = metrics.evaluate(ranked.join(truth.select("pid").distinct(), "pid", "left_semi"), truth)
        rows.append(means.select(F.lit(stage).alias("stage"), *[F.round(c, 6).alias(c) for c in means.columns]))
    return rows[0].unionByName(rows[1])


@query
def evaluate_title(t: Tables) -> DataFrame:
    """Test lists with a title: the most popular tracks, and the tracks of the title."""
    train, test = t.marked_lists()
    titled = rel.drop_null_lists(test, ["clean"])
    truth = materialize(rel.keep_pids(t.test, titled), "title-truth")
    cells = cooccur.cells_of(rel.keep_pids(t.train, rel.drop_null_lists(train, ["clean"])))
    found = title.title_recommend(titled, train, t.train, cells, TOP)
    head = order.popularity_order(rel.track_freq(t.train)).filter(F.col("rank") <= TOP)  # TOP rows for every list
    popular = titled.select("pid", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(TOP).cast("bigint"))).alias("rank")).join(head, "rank")
    return _before_and_after(popular, found, truth)


@query
def evaluate_svc(t: Tables) -> DataFrame:
    """Test lists: the co-occurrence order, and that of each list's own classifier on the same seeds."""
    seeds, truth = t.holdout()
    found = retrieve.cf_recommend(seeds, cooccur.cells_of(t.train), TOP)
    return _before_and_after(found, models.svc_rerank(_values(t, seeds, weighted=False), seeds, t.items, c=0.05, k=TOP), truth)


@query
def evaluate_svc_pooled(t: Tables) -> DataFrame:
    """Test lists: one classifier for all lists, and each list's own."""
    seeds, truth = t.holdout()
    values = _values(t, seeds, weighted=False).staged()
    pooled = models.svc_rerank_pooled(models.svc_features(values, seeds), c=0.05, k=TOP)
    return _before_and_after(pooled, models.svc_rerank(values, seeds, t.items, c=0.05, k=TOP), truth)


@query
def evaluate_gbt(t: Tables) -> DataFrame:
    """Test lists of one half: the co-occurrence order, and that of trees fit on the lists of the other half."""
    seeds, truth = t.holdout()
    found = retrieve.cf_recommend(seeds, cooccur.cells_of(t.train), 2 * TOP).withColumnRenamed("score", "cf_prob")
    table = features.feature_table(
        found, truth, seeds, t.encoded_items, t.lists, rel.track_freq(t.train), {"w2v_track_sim": (t.vectors, None)}
    )
    table = materialize(table.withColumn("fit", hash_below(0.5, "pid", seed=2)), "features")
    model = models.gbt_train(table.filter("fit").drop("fit"))
    asked = table.filter("NOT fit").drop("fit")
    after = rank.rank_emit(models.gbt_score(model, asked), seeds, TOP + 50, TOP, "prob")
    before = rank.topk_per_list(asked.select("pid", "track", "cf_prob"), TOP, "cf_prob")
    own = truth.join(asked.select("pid").distinct(), "pid", "left_semi")
    return _before_and_after(before, after, own)


# ---- the whole run


@query
def challenge_slices(t: Tables) -> DataFrame:
    return Challenge.from_tables(t).run()


@query
def submission(t: Tables) -> DataFrame:
    """The whole run as a submission: a row per list, its tracks by their URIs, 500 columns wide, written and read back."""
    ids = t.items.select((F.col("track")).alias("id"), F.concat(F.lit("track:"), F.col("track").cast("string")).alias("value"))
    slices = order.decode(Challenge.from_tables(t).run(), ids, "track", "track_uri")
    path = stage_path(t.spark, "submission")
    sources.write_submission(slices, path, TOP, "track_uri")
    fields = ", ".join(["pid bigint"] + [f"t{i} string" for i in range(1, TOP + 1)])
    return t.spark.read.schema(fields).option("header", True).csv(path)
