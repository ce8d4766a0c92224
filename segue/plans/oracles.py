"""The queries of the catalog as plain SQL over the star schema, for checking."""

from __future__ import annotations

import re

TOP, SHOWN = 500, 10

# Common table expressions, in an order in which each uses only earlier ones.
PARTS = {
    "interactions": """SELECT o_custkey AS pid, l_orderkey * 8 + l_linenumber AS pos, l_partkey AS track
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "named": """SELECT c_custkey AS pid, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 5000 THEN c_mktsegment
        ELSE c_mktsegment || ' ' || n_name END AS name
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "lists": """SELECT pid, name, regexp_replace(lower(name), '[^a-z0-9'' ]', '', 'g') AS clean FROM named""",
    "sized": """SELECT lists.*, num_tracks, CASE WHEN num_tracks < 20 THEN 0 WHEN num_tracks < 30 THEN 1
        WHEN num_tracks < 40 THEN 5 WHEN num_tracks < 50 THEN 10 WHEN num_tracks < 90 THEN 25 ELSE 100 END AS num_samples
        FROM lists JOIN (SELECT pid, count(*) AS num_tracks FROM interactions GROUP BY pid) USING (pid)""",
    "routed": """SELECT pid, num_samples, CASE WHEN num_samples = 0 THEN 'v1' WHEN num_samples = 1 THEN 'v2'
        WHEN num_samples = 5 AND name IS NOT NULL THEN 'v3' WHEN num_samples = 5 THEN 'v4'
        WHEN num_samples = 10 AND name IS NOT NULL THEN 'v5' WHEN num_samples = 10 THEN 'v6'
        WHEN num_samples = 25 THEN 'v7' WHEN num_samples = 100 THEN 'v8' END AS subtask FROM sized""",
    "items": """SELECT p_partkey AS track, p_brand AS artist, p_type AS album, p_name AS track_name,
        p_type AS album_name, p_brand AS artist_name FROM part""",
    "train_lists": "SELECT * FROM lists WHERE NOT md5('666|' || pid) < '33333333'",
    "test_lists": "SELECT * FROM lists WHERE md5('666|' || pid) < '33333333'",
    "train": "SELECT * FROM interactions WHERE NOT md5('666|' || pid) < '33333333'",
    "test": "SELECT * FROM interactions WHERE md5('666|' || pid) < '33333333'",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY pid ORDER BY pos, track) AS rn FROM interactions",
    "first5": "SELECT pid, pos, track FROM numbered WHERE rn <= 5",
    "test_numbered": "SELECT *, row_number() OVER (PARTITION BY pid ORDER BY pos, track) AS rn FROM test",
    "seeds": "SELECT pid, pos, track FROM test_numbered WHERE rn <= 5",
    "truth": "SELECT pid, pos, track FROM test_numbered WHERE rn > 5",
    "scored": """SELECT o_custkey AS pid, l_partkey AS track, floor(max(l_extendedprice) * 100 + 0.5) AS cf_prob
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY pid ORDER BY cf_prob DESC, track) AS rank FROM scored""",
    "best": "SELECT * FROM ranked WHERE rank <= 10",
    "returned": """SELECT o_custkey AS pid, l_orderkey * 8 + l_linenumber AS pos, l_partkey AS track
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    "predictions": """SELECT * FROM (SELECT o_custkey AS pid, l_partkey AS track,
        row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_partkey) AS rank
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "freq": "SELECT track, count(*) AS freq FROM interactions GROUP BY track",
    "triplets": """SELECT pid::VARCHAR AS "user", 'S' || track AS song, count(*)::INT AS plays
        FROM interactions GROUP BY pid, track""",
    # co-occurrence over the training lists
    "cells": "SELECT DISTINCT pid, track FROM train",
    "n": "SELECT track, count(*) AS n FROM cells GROUP BY track",
    "pairs": """SELECT s.track AS seed, t.track, count(*) AS c
        FROM cells s JOIN (SELECT DISTINCT track FROM seeds) USING (track) JOIN cells t ON s.pid = t.pid
        GROUP BY 1, 2""",
    "seed_rows": "SELECT pid, track AS seed, count(*) AS m FROM seeds GROUP BY 1, 2",
    "seed_size": "SELECT pid, sum(m) AS k FROM seed_rows GROUP BY 1",
    "cf": """SELECT r.pid, p.track, floor(sum(r.m * pow(p.c / (pow(nt.n, 0.1) * pow(ns.n, 0.9)), 0.5)) / max(k)
        * 1000000.0 + 0.5) / 1000000.0 AS score
        FROM seed_rows r JOIN seed_size USING (pid) JOIN pairs p ON p.seed = r.seed
        JOIN n nt ON nt.track = p.track JOIN n ns ON ns.track = r.seed GROUP BY 1, 2""",
    "cf_fresh": "SELECT * FROM cf ANTI JOIN seeds USING (pid, track)",
    "cf_ranked": "SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, track) AS rank FROM cf_fresh",
    # counted cells of the training lists
    "counted": "SELECT pid, track, count(*) AS m FROM train GROUP BY 1, 2",
    "i_song": "SELECT track, sum(m) AS i FROM counted GROUP BY 1",
    "i_list": "SELECT pid, sum(m) AS i FROM counted GROUP BY 1",
    "norm": """SELECT s.track AS seed, t.track, sum(s.m * t.m) * max(pow(0.1 + si.i, -0.9)) * max(pow(0.1 + ti.i, -0.1)) AS v
        FROM counted s JOIN (SELECT DISTINCT track FROM seeds) USING (track) JOIN counted t ON s.pid = t.pid
        JOIN i_song si ON si.track = s.track JOIN i_song ti ON ti.track = t.track GROUP BY 1, 2""",
    "wanted": "SELECT DISTINCT pid AS test, track AS seed FROM seeds",
    "weights": """SELECT test, c.pid, pow(sum(c.m * pow(0.1 + l.i, -0.3)), 0.99) AS w
        FROM wanted JOIN counted c ON c.track = seed JOIN i_list l ON l.pid = c.pid GROUP BY 1, 2""",
    "weighted": """SELECT w.test, w.seed, t.track, sum(s.m * lw.w * t.m) * max(pow(0.1 + si.i, -0.9)) * max(pow(0.1 + ti.i, -0.1)) AS v
        FROM wanted w JOIN counted s ON s.track = w.seed JOIN weights lw ON lw.test = w.test AND lw.pid = s.pid
        JOIN counted t ON t.pid = s.pid JOIN i_song si ON si.track = w.seed JOIN i_song ti ON ti.track = t.track
        GROUP BY 1, 2, 3""",
    # titles
    "title_words": """SELECT clean, regexp_extract_all(clean, '[a-z0-9]{2,}') AS w FROM (SELECT DISTINCT clean FROM lists WHERE clean IS NOT NULL)""",
    "title_grams": """SELECT DISTINCT clean, unnest(list_concat(w,
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS ngram FROM title_words""",
    "title_w": "SELECT clean, CASE WHEN len(string_split(clean, ' ')) = 1 THEN 1 ELSE 3 END AS w FROM title_words",
    "gram_track_all": """SELECT ngram, track, sum(w) AS w FROM interactions JOIN lists USING (pid)
        JOIN title_w USING (clean) JOIN title_grams USING (clean) GROUP BY 1, 2""",
    "gram_track": """SELECT ngram, track, sum(w) AS w FROM train JOIN lists USING (pid)
        JOIN title_w USING (clean) JOIN title_grams USING (clean) GROUP BY 1, 2""",
    "tscore": """SELECT clean, track, sum(w) AS score FROM (SELECT DISTINCT clean FROM test_lists WHERE clean IS NOT NULL)
        JOIN title_grams USING (clean) JOIN gram_track USING (ngram) GROUP BY 1, 2""",
    "tbest": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY score DESC, track) AS rk FROM tscore)
        WHERE rk <= 100""",
    "tcells": "SELECT DISTINCT pid, track FROM train JOIN lists USING (pid) WHERE clean IS NOT NULL",
    "tn": "SELECT track, count(*) AS n FROM tcells GROUP BY track",
    "tpairs": """SELECT s.track AS seed, t.track, count(*) AS c FROM tcells s JOIN (SELECT DISTINCT track FROM tbest) USING (track)
        JOIN tcells t ON s.pid = t.pid GROUP BY 1, 2""",
    "nb": """SELECT clean, p.track, sum(b.score * p.c / (pow(nt.n, 0.1) * pow(ns.n, 0.9))) / 100 AS nb
        FROM tbest b JOIN tpairs p ON p.seed = b.track JOIN tn nt ON nt.track = p.track JOIN tn ns ON ns.track = b.track
        GROUP BY 1, 2""",
    "tmixed": """SELECT clean, track, floor((0.5 * coalesce(score, 0) + 0.5 * coalesce(nb, 0)) * 1000000.0 + 0.5) / 1000000.0 AS score
        FROM tscore FULL JOIN nb USING (clean, track)""",
    # embeddings
    "units": """SELECT vec_id AS track, list_transform(embedding::DOUBLE[], lambda x:
        x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings""",
    # metrics
    "hidden": "SELECT DISTINCT pid, track FROM returned",
    "hidden_size": "SELECT pid, count(*) AS g FROM hidden GROUP BY 1",
    "m_rprec": """SELECT pid, coalesce(found, 0) / g AS r_precision FROM hidden_size LEFT JOIN (
        SELECT pid, count(DISTINCT track) AS found FROM predictions JOIN hidden USING (pid, track) JOIN hidden_size USING (pid)
        WHERE rank <= least(g, 500) GROUP BY 1) USING (pid)""",
    "m_unique": """SELECT pid, track, row_number() OVER (PARTITION BY pid ORDER BY min(rank)) AS place
        FROM predictions WHERE rank <= 500 GROUP BY pid, track""",
    "m_ideal": """SELECT pid, sum(1 / log2(1 + i)) AS idcg FROM (
        SELECT pid, unnest(range(1, count(DISTINCT track) + 1)) AS i FROM (
            SELECT *, row_number() OVER (PARTITION BY pid ORDER BY pos, track) AS rn FROM returned) WHERE rn <= 500 GROUP BY pid)
        GROUP BY 1""",
    "m_ndcg": """SELECT pid, coalesce(dcg, 0) / idcg AS ndcg FROM m_ideal LEFT JOIN (
        SELECT pid, sum(1 / log2(1 + place)) AS dcg FROM m_unique JOIN hidden USING (pid, track) GROUP BY 1) USING (pid)""",
    "m_clicks": """SELECT pid, coalesce(floor((r - 1) / 10), 51.0) AS clicks FROM hidden_size LEFT JOIN (
        SELECT pid, min(rank) AS r FROM predictions JOIN hidden USING (pid, track) WHERE rank <= 500 GROUP BY 1) USING (pid)""",
    "m_coverage": """SELECT pid, coalesce(found, 0) / n AS coverage FROM (SELECT pid, count(*) AS n FROM returned GROUP BY 1) LEFT JOIN (
        SELECT pid, count(DISTINCT track) AS found FROM predictions JOIN hidden USING (pid, track) WHERE rank <= 1000 GROUP BY 1)
        USING (pid)""",
}

# Metrics of the co-occurrence recommendations instead of the price ranking.
_METRIC_PARTS = [name for name in PARTS if name.startswith(("m_", "hidden"))]


def _evaluated(predictions: str, returned: str) -> dict[str, str]:
    """The parts with other predictions and hidden items under the metrics."""
    return {
        **{name: text for name, text in PARTS.items() if name not in ["predictions", "returned", *_METRIC_PARTS]},
        "predictions": predictions, "returned": returned, **{name: PARTS[name] for name in _METRIC_PARTS},
    }


CF_PARTS = _evaluated("SELECT pid, rank, track FROM cf_ranked WHERE rank <= 1000 AND pid IN (SELECT pid FROM truth)", "SELECT * FROM truth")
# Test lists with a title: the most popular tracks, and the tracks of the title.
_TITLED = "SELECT pid, pos, track FROM test WHERE pid IN (SELECT pid FROM test_lists WHERE clean IS NOT NULL)"
TITLE_STAGES = {
    "before": _evaluated(f"""SELECT pid, rank, track FROM (SELECT DISTINCT pid FROM ({_TITLED})), (
        SELECT track, row_number() OVER (ORDER BY count(*) DESC, track) AS rank FROM train GROUP BY track) WHERE rank <= {TOP}""", _TITLED),
    "after": _evaluated(f"""SELECT pid, rank, track FROM (SELECT DISTINCT pid FROM ({_TITLED})) JOIN test_lists USING (pid) JOIN (
        SELECT *, row_number() OVER (PARTITION BY clean ORDER BY score DESC, track) AS rank FROM tmixed) USING (clean) WHERE rank <= {TOP}""", _TITLED),
}


def _mentioned(text: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", text))
    return [name for name in PARTS if name in words]


def sql(body: str, parts: dict[str, str] = PARTS) -> str:
    """The body with the common table expressions it needs, directly or not, before it.

    A body that starts with a comma brings expressions of its own."""
    needed: set[str] = set()
    todo = _mentioned(body)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo.extend(_mentioned(parts[name]))
    shared = ", ".join(f"{name} AS ({parts[name]})" for name in parts if name in needed)
    return f"WITH {shared}{'' if body.startswith(',') else ' '}{body}" if shared else body


def _clean_sql(source: str, keys: str) -> str:
    """Title cleaning of `source` (keys, text) without back-references: runs are found by comparing
    neighbouring characters, and a run of three or more keeps one character."""
    return f"""
        chars AS (SELECT {keys}, unnest(string_split(lower(text), '')) AS ch,
            generate_subscripts(string_split(lower(text), ''), 1) AS i FROM {source}),
        starts AS (SELECT *, CASE WHEN ch = lag(ch) OVER w THEN 0 ELSE 1 END AS starts FROM chars
            WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
        runs AS (SELECT *, sum(starts) OVER (PARTITION BY {keys} ORDER BY i) AS run FROM starts),
        sizes AS (SELECT {keys}, run, min(i) AS i, any_value(ch) AS ch, count(*) AS len FROM runs GROUP BY {keys}, run),
        squeezed AS (SELECT {keys}, string_agg(CASE WHEN len >= 3 THEN ch ELSE repeat(ch, len) END, '' ORDER BY i) AS s
            FROM sizes GROUP BY {keys}),
        cleaned AS (SELECT {keys}, nullif(trim(regexp_replace(regexp_replace(s, '[^a-z0-9'' ]', '', 'g'), ' +', ' ', 'g')), '')
            AS clean FROM squeezed)"""


_DOC_CLEAN = "WITH docs AS (SELECT doc_id, text FROM documents)," + _clean_sql("docs", "doc_id")
_DOC_WORDS = _DOC_CLEAN + ", words AS (SELECT doc_id, regexp_extract_all(clean, '[a-z0-9]{2,}') AS w FROM cleaned)"

_SIM = """CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0
    ELSE 1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"""


def _sim(column: str) -> str:
    return _SIM.format(a=f"coalesce(lower({column}), 'nan')", b="coalesce(lower(clean), 'nan')")


_NAME_SIMS = ", ".join(f"round({_sim(c)}, 6) AS {n}" for c, n in (
    ("track_name", "name_sim"), ("album_name", "album_sim"), ("artist_name", "artist_sim")))

_EMBED_SIM = """(SELECT pid, track, round(coalesce(list_dot_product(u, total), 0.0) / k, 6) AS w2v_track_sim
    FROM {candidates} LEFT JOIN units USING (track) JOIN (SELECT pid, count(*) AS k FROM first5 GROUP BY 1) USING (pid)
    LEFT JOIN (SELECT pid, list(x ORDER BY d) AS total FROM (
        SELECT pid, d, sum(u[d]) AS x FROM (SELECT pid, u, unnest(range(1, 65)) AS d FROM first5 JOIN units USING (track))
        GROUP BY 1, 2) GROUP BY 1) USING (pid))"""

_SLICE = """SELECT l_orderkey AS pid, {fields} FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN orders ON l_orderkey = o_orderkey"""

_QUARTILES = ", ".join(f"round(quantile_cont(cf_prob, {q}), 2) AS {n}" for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))

_METRICS = "m_rprec JOIN m_ndcg USING (pid) JOIN m_clicks USING (pid) JOIN m_coverage USING (pid)"
_MEANS = "round(avg(r_precision), 6) AS r_precision, round(avg(ndcg), 6) AS ndcg, round(avg(clicks), 6) AS clicks, round(avg(coverage), 6) AS coverage"

_RAW: dict[str, str] = {
    "src_json_lists": """SELECT o_orderkey AS pid, o_orderpriority AS name, count(*)::INT AS num_tracks, count(*)::INT AS n_tracks
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "unnest_tracks": _SLICE.format(fields="""'artist:' || p_brand AS artist_uri, l_linenumber AS pos, p_brand AS artist_name,
        'track:' || l_partkey AS track_uri, p_name AS track_name, 'album:' || p_type AS album_uri,
        (l_quantity * 1000)::BIGINT AS duration_ms, p_type AS album_name"""),
    "src_csv_gz": "SELECT pid, track FROM interactions",
    "src_range_csv": """SELECT pid, pos, track FROM (SELECT *, row_number() OVER (ORDER BY pid, pos, track) AS rn FROM interactions)
        WHERE rn > 1000""",
    "src_triplets": "SELECT * FROM triplets",
    "src_sep_tracks": "SELECT p_brand AS a_id, p_partkey::VARCHAR AS s_id, p_brand AS artist, p_name AS song FROM part",
    "src_lines": """SELECT c_name AS "user" FROM customer""",
    "src_key_value": "SELECT song, (row_number() OVER (ORDER BY song) - 1)::VARCHAR AS idx FROM (SELECT DISTINCT song FROM triplets)",
    "sink_table": "SELECT * FROM interactions",
    "sink_submission": "SELECT pid, " + ", ".join(
        f"max(CASE WHEN rank = {i} THEN track END) AS t{i}" for i in range(1, TOP + 1)) + " FROM ranked GROUP BY pid",
    "sink_indexed_lines": """SELECT line FROM (SELECT pid, string_agg(idx, ' ' ORDER BY rank) AS line
        FROM (SELECT * FROM ranked WHERE rank <= 500) JOIN (SELECT song, (row_number() OVER (ORDER BY song) - 1)::VARCHAR AS idx
            FROM (SELECT DISTINCT song FROM triplets)) ON song = 'S' || track GROUP BY pid)""",
    "project_drop": "SELECT track AS track_uri, artist, album, track_name FROM items",
    "route_subtask": "SELECT pid, num_samples, subtask FROM routed",
    "filter_length": """SELECT 1 AS seeds, pid, num_tracks FROM sized WHERE num_tracks BETWEEN 11 AND 80
        UNION ALL SELECT 5, pid, num_tracks FROM sized WHERE num_tracks BETWEEN 40 AND 100
        UNION ALL SELECT 10, pid, num_tracks FROM sized WHERE num_tracks BETWEEN 40 AND 100""",
    "drop_null_lists": "SELECT * FROM lists WHERE clean IS NOT NULL",
    "head_n": "SELECT pid, name FROM lists ORDER BY pid LIMIT 1000",
    "semi_pids": "SELECT * FROM interactions WHERE pid IN (SELECT pid FROM lists WHERE clean IS NOT NULL)",
    "anti_pids": "SELECT * FROM train",
    "sample_ratio_users": """SELECT * FROM triplets WHERE md5('7|' || "user" || '|' || song || '|' || plays) < '80000000'
        AND "user" IN (SELECT pid::VARCHAR FROM lists WHERE clean IS NOT NULL)""",
    "fill_zero": """SELECT track, coalesce(freq_r, 0) AS freq FROM items LEFT JOIN
        (SELECT track, count(*) AS freq_r FROM train GROUP BY 1) USING (track)""",
    "order_flag": """SELECT pid, (bool_and(rises) AND max(last) - max(first) = 2)::INT AS ordered FROM (
        SELECT pid, coalesce(pos >= lag(pos) OVER w, true) AS rises, first_value(pos) OVER w AS first,
            last_value(pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, count(*) OVER (PARTITION BY pid) AS size
        FROM (SELECT l_orderkey AS pid, epoch(l_shipdate)::BIGINT AS file_pos, l_linenumber AS pos FROM lineitem)
        WINDOW w AS (PARTITION BY pid ORDER BY file_pos, pos)) WHERE size = 3 GROUP BY pid""",
    "join_list_items": "SELECT pid, name, clean, pos, track FROM lists LEFT JOIN interactions USING (pid)",
    "join_label": """SELECT s.pid, s.track, cf_prob, CASE WHEN h.pid IS NULL THEN 0 ELSE 1 END AS label
        FROM scored s LEFT JOIN hidden h ON s.pid = h.pid AND s.track = h.track""",
    "join_popularity": "SELECT pid, track, cf_prob, freq FROM scored LEFT JOIN freq USING (track)",
    "lookup_item_attrs": "SELECT * FROM scored JOIN items USING (track)",
    "lookup_title": "SELECT pid, track, cf_prob, clean FROM scored LEFT JOIN lists USING (pid)",
    "join_seeds": """SELECT s.pid, s.track, cf_prob, f.pos, f.track AS seed FROM scored s LEFT JOIN first5 f ON s.pid = f.pid""",
    "self_join_cooc": "SELECT * FROM pairs",
    "anti_seeds": "SELECT * FROM scored ANTI JOIN first5 USING (pid, track)",
    "decode_ids": """SELECT pid, pos, id AS track, 'track:' || i.track AS track_uri FROM interactions i JOIN (
        SELECT track, row_number() OVER (ORDER BY 'track:' || track) - 1 AS id FROM (SELECT DISTINCT track FROM interactions)) USING (track)""",
    "track_freq": "SELECT * FROM freq",
    "track_list_count": """SELECT track, coalesce(c, 0) AS n_lists FROM items LEFT JOIN
        (SELECT track, count(DISTINCT pid) AS c FROM train GROUP BY 1) USING (track)""",
    "user_count": "SELECT pid, count(*) AS n_rows FROM interactions GROUP BY 1",
    "list_size_sum": """SELECT 'song' AS side, track AS id, count(*) AS total FROM interactions GROUP BY 2
        UNION ALL SELECT 'list', pid, count(*) FROM interactions GROUP BY 2""",
    "popularity_order": "SELECT track, freq, row_number() OVER (ORDER BY freq DESC, track) AS rank FROM freq",
    "collect_items": """SELECT pid, (rn - 1) // 50 AS chunk, string_agg(track::VARCHAR, ' ' ORDER BY rn) AS tracks
        FROM numbered GROUP BY 1, 2""",
    "track_to_lists": "SELECT DISTINCT track, pid FROM interactions",
    "user_to_tracks": """SELECT "user", song FROM triplets""",
    "distinct_users": """SELECT DISTINCT "user" FROM triplets""",
    "first_per_key": """SELECT track, pid, pos FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY pid, pos) AS rn
        FROM interactions) WHERE rn = 1""",
    "group_mean": "SELECT pid, avg(cf_prob) AS cf_avg_prob FROM scored GROUP BY 1",
    "metric_mean": f"SELECT {_MEANS} FROM {_METRICS}",
    "describe_scores": f"""SELECT 'cf_prob' AS "column", count(*) AS count, round(avg(cf_prob), 2) AS mean,
        round(stddev_samp(cf_prob), 2) AS std, round(min(cf_prob), 2) AS min, {_QUARTILES}, round(max(cf_prob), 2) AS max FROM scored""",
    "topk_per_list": "SELECT * FROM best",
    "topk_per_list_500": "SELECT * FROM ranked WHERE rank <= 500",
    "topk_oversample_1000": """SELECT pid, track, cf_prob, row_number() OVER (PARTITION BY pid ORDER BY rank) AS rank
        FROM (SELECT * FROM ranked WHERE rank <= 1100) ANTI JOIN first5 USING (pid, track)
        QUALIFY row_number() OVER (PARTITION BY pid ORDER BY rank) <= 1000""",
    "topk_oversample": """SELECT pid, track, cf_prob, row_number() OVER (PARTITION BY pid ORDER BY rank) AS rank
        FROM (SELECT * FROM ranked WHERE rank <= 15) ANTI JOIN first5 USING (pid, track)
        QUALIFY row_number() OVER (PARTITION BY pid ORDER BY rank) <= 10""",
    "dense_encode": """SELECT value, row_number() OVER (ORDER BY value) - 1 AS id
        FROM (SELECT DISTINCT 'track:' || track AS value FROM interactions)""",
    "relative_score": """SELECT pid, track, cf_prob, round(cf_prob / avg(cf_prob) OVER (PARTITION BY pid), 6) AS cf_rlt_prob
        FROM scored""",
    "split_prefix": """SELECT pid, pos, track, CASE WHEN rn <= 5 THEN 'seed' ELSE 'truth' END AS part FROM numbered""",
    "split_random_items": """, drawn AS (SELECT pid, track, count(*) OVER (PARTITION BY pid) AS size, row_number() OVER (PARTITION BY pid
            ORDER BY md5('1|' || pid || '|' || pos || '|' || track), pos, track) AS rn FROM interactions)
        SELECT pid, track, 'seed' AS part FROM drawn WHERE rn <= 10 AND size > 10
        UNION ALL SELECT pid, track, 'train' FROM drawn WHERE rn <= 10
        UNION ALL SELECT DISTINCT pid, track, 'truth' FROM drawn d WHERE size > 10 AND NOT EXISTS (
            SELECT 1 FROM drawn x WHERE x.pid = d.pid AND x.track = d.track AND x.rn <= 10)""",
    "split_sequential": """SELECT pid, name, CASE WHEN rn <= 1000 THEN 'train' ELSE 'test' END AS part
        FROM (SELECT pid, name, row_number() OVER (ORDER BY pid) AS rn FROM lists) WHERE rn <= 1200""",
    "split_lists_80_20": "SELECT pid, md5('666|' || pid) < '33333333' AS is_test FROM lists",
    "union_train_test": "SELECT * FROM interactions",
    "union_slices": "SELECT subtask AS slice, pid, rank, track FROM ranked JOIN routed USING (pid)",
    "intersect_lists": "SELECT pid, track FROM scored SEMI JOIN hidden USING (pid, track)",
    "except_lists": "SELECT DISTINCT pid, track FROM interactions ANTI JOIN first5 USING (pid, track)",
    "vocab_index": "SELECT ngram, row_number() OVER (ORDER BY ngram) - 1 AS idx FROM (SELECT DISTINCT ngram FROM title_grams)",
    "title_weight": "SELECT pid, clean, w::INT AS weight FROM lists JOIN title_w USING (clean)",
    "list_concat": """SELECT pid, (rank - 1) // 50 AS chunk, string_agg(track::VARCHAR, ' ' ORDER BY rank) OVER (
            PARTITION BY pid, (rank - 1) // 50 ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS text,
            ((rank - 1) % 50)::INT AS i, track FROM ranked""",
    "parse_list": "SELECT pid, (rank - 1) // 50 AS chunk, ((rank - 1) % 50)::INT AS i, track FROM ranked",
    "explode_scored": "SELECT pid, track, cf_prob FROM scored",
    "name_similarity": f"SELECT pid, track, {_NAME_SIMS} FROM scored JOIN items USING (track) LEFT JOIN lists USING (pid)",
    "item_sim_pairs": """, firsts AS (SELECT pid, track AS s FROM numbered WHERE rn = 1),
        wanted_pairs AS (SELECT DISTINCT s, track AS u FROM interactions JOIN firsts USING (pid) WHERE s <> track),
        all_cells AS (SELECT DISTINCT pid, track FROM interactions),
        all_n AS (SELECT track, count(*) AS n FROM all_cells GROUP BY 1),
        both_in AS (SELECT s, u, count(*) AS c FROM wanted_pairs JOIN all_cells a ON a.track = s
            JOIN all_cells b ON b.track = u AND b.pid = a.pid GROUP BY 1, 2)
        SELECT s, u, round(pow(c / (pow(x.n, 0.1) * pow(y.n, 0.9)), 0.5), 6) AS sim
        FROM both_in JOIN all_n x ON x.track = s JOIN all_n y ON y.track = u""",
    "cf_score": "SELECT pid, track, score FROM cf",
    "cf_recommend": f"SELECT pid, track, score, rank FROM cf_ranked WHERE rank <= {TOP}",
    "popularity_backfill": """, fresh AS (SELECT * FROM scored ANTI JOIN first5 USING (pid, track)),
        own AS (SELECT pid, track, rank FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY cf_prob DESC, track) AS rank FROM fresh)
            WHERE rank <= 10),
        have AS (SELECT pid, count(*) AS n_have FROM own GROUP BY 1),
        popular AS (SELECT track, row_number() OVER (ORDER BY freq DESC, track) AS pop FROM freq),
        filler AS (SELECT l.pid, p.track, coalesce(n_have, 0) + row_number() OVER (PARTITION BY l.pid ORDER BY pop) AS rank
            FROM lists l CROSS JOIN popular p LEFT JOIN have ON have.pid = l.pid
            WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.pid = l.pid AND own.track = p.track)
              AND NOT EXISTS (SELECT 1 FROM first5 f WHERE f.pid = l.pid AND f.track = p.track))
        SELECT pid, track, rank::INT AS rank FROM own UNION ALL SELECT pid, track, rank::INT FROM filler WHERE rank <= 500""",
    "title_ngram_track": "SELECT ngram, track, w::BIGINT AS w FROM gram_track_all",
    "title_score": "SELECT clean, track, score::BIGINT AS score FROM tscore",
    "title_expand": "SELECT clean, track, round(nb, 6) AS nb FROM nb",
    "title_recommend": f"""SELECT pid, track, score, rank FROM test_lists JOIN (SELECT *, row_number() OVER (
        PARTITION BY clean ORDER BY score DESC, track) AS rank FROM tmixed) USING (clean) WHERE rank <= {TOP}""",
    "title_fallback": f""", known AS (SELECT DISTINCT g.clean FROM title_grams g WHERE g.ngram IN (
            SELECT ngram FROM title_grams SEMI JOIN train_lists USING (clean))),
        lost AS (SELECT pid FROM lists WHERE clean IS NULL OR clean NOT IN (SELECT clean FROM known)),
        catalogue AS (SELECT track, row_number() OVER (ORDER BY track) - 1 AS no FROM items),
        total AS (SELECT count(*) AS size FROM catalogue),
        walk AS (SELECT pid, unnest(range(0, least({TOP}, size))) AS j, size FROM lost, total)
        SELECT pid, track, (j + 1)::INT AS rank FROM walk JOIN catalogue ON no =
            (((pid % 2147483647) * 48271 + 3) % 2147483647 + j * (2147483647 % size)) % size""",
    "cooc_norm_features": "SELECT seed, track, round(v, 6) AS v FROM norm",
    "list_weight": "SELECT test, pid, round(w, 6) AS w FROM weights",
    "cooc_weighted_features": "SELECT test, seed, track, round(v, 6) AS v FROM weighted",
    "svc_features": """, stats AS (SELECT test, track, max(CASE WHEN seed = track THEN 1 ELSE 0 END) AS label,
            coalesce(sum(CASE WHEN seed <> track THEN v END), 0) AS v_sum, coalesce(max(CASE WHEN seed <> track THEN v END), 0) AS v_max,
            count(CASE WHEN seed <> track THEN v END) AS v_count FROM wanted JOIN norm USING (seed) GROUP BY 1, 2)
        SELECT test, track, label, v_count, round(v_sum, 6) AS v_sum,
            round(CASE WHEN k = label THEN 0.0 ELSE v_sum / (k - label) END, 6) AS v_mean, round(v_max, 6) AS v_max
        FROM stats JOIN (SELECT test, count(*) AS k FROM wanted GROUP BY 1) USING (test)""",
    "svc_rows": """, terms AS (SELECT test, track, count(*)::INT AS n_terms, sum(v) AS v_sum FROM wanted JOIN norm USING (seed) GROUP BY 1, 2),
        sizes AS (SELECT test, count(*)::INT AS k FROM wanted GROUP BY 1),
        known AS (SELECT test, track, CASE WHEN own THEN 1 ELSE 0 END AS label, coalesce(n_terms, 0) AS n_terms, coalesce(v_sum, 0.0) AS v_sum
            FROM terms FULL JOIN (SELECT test, seed AS track, true AS own FROM wanted) USING (test, track))
        SELECT test, k, track, label, 1::BIGINT AS times, n_terms, round(v_sum, 6) AS v_sum FROM known JOIN sizes USING (test)
        UNION ALL SELECT test, k, NULL, 0, (SELECT count(DISTINCT track) FROM items) - count(*), 0, 0.0
        FROM known JOIN sizes USING (test) GROUP BY test, k HAVING count(*) < (SELECT count(DISTINCT track) FROM items)""",
    "seed_embed_similarity": f"SELECT * FROM {_EMBED_SIM.format(candidates='scored')}",
    "vector_topk": f""", firsts AS (SELECT pid, track AS query FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY pos, track) AS rk
            FROM interactions SEMI JOIN units USING (track)) WHERE rk = 1),
        near AS (SELECT q.track AS query, i.track, floor(list_dot_product(q.u, i.u) * 1000000.0 + 0.5) / 1000000.0 AS score
            FROM units q JOIN units i ON q.track <> i.track WHERE q.track IN (SELECT query FROM firsts)),
        near_ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, track) AS rank FROM near)
        SELECT pid, query, track, score, rank FROM firsts JOIN near_ranked USING (query) WHERE rank <= {TOP}""",
    "vector_truth": """, firsts AS (SELECT pid, track AS query FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY pos, track) AS rk
            FROM interactions SEMI JOIN units USING (track)) WHERE rk = 1)
        SELECT pid, pos, track FROM interactions JOIN firsts USING (pid) WHERE track <> query""",
    "src_json_test_lists": """SELECT pid, name, least(num_tracks, 2)::INT AS num_samples, (num_tracks - least(num_tracks, 2))::INT AS num_holdouts,
        (rn - 1)::INT AS pos, 'track:' || track AS track_uri, NULL::VARCHAR AS album_uri
        FROM numbered JOIN sized USING (pid) WHERE rn <= 2""",
    "feature_table": f""", pool AS (SELECT * FROM scored ANTI JOIN first5 USING (pid, track)),
        sims AS {_EMBED_SIM.format(candidates='pool')},
        artists AS (SELECT artist, row_number() OVER (ORDER BY artist) - 1 AS artist_id FROM (SELECT DISTINCT artist FROM items)),
        albums AS (SELECT album, row_number() OVER (ORDER BY album) - 1 AS album_id FROM (SELECT DISTINCT album FROM items))
        SELECT c.pid, c.track, cf_prob, CASE WHEN h.pid IS NULL THEN 0 ELSE 1 END AS label, freq, artist_id AS artist, album_id AS album,
            {_NAME_SIMS}, round(cf_prob / avg(cf_prob) OVER (PARTITION BY c.pid), 6) AS cf_rlt_prob, w2v_track_sim
        FROM pool c LEFT JOIN hidden h ON h.pid = c.pid AND h.track = c.track JOIN freq ON freq.track = c.track
        JOIN items ON items.track = c.track JOIN artists USING (artist) JOIN albums USING (album)
        JOIN lists ON lists.pid = c.pid JOIN sims ON sims.pid = c.pid AND sims.track = c.track""",
    "rank_emit": """SELECT pid, track, cf_prob, row_number() OVER (PARTITION BY pid ORDER BY rank) AS rank
        FROM (SELECT * FROM ranked WHERE rank <= 15) ANTI JOIN first5 USING (pid, track)
        QUALIFY row_number() OVER (PARTITION BY pid ORDER BY rank) <= 10""",
    "rank_emit_500": """SELECT pid, track, cf_prob, row_number() OVER (PARTITION BY pid ORDER BY rank) AS rank
        FROM (SELECT * FROM ranked WHERE rank <= 550) ANTI JOIN first5 USING (pid, track)
        QUALIFY row_number() OVER (PARTITION BY pid ORDER BY rank) <= 500""",
    "metric_r_precision": "SELECT pid, round(r_precision, 6) AS r_precision FROM m_rprec",
    "metric_ndcg": "SELECT pid, round(ndcg, 6) AS ndcg FROM m_ndcg",
    "metric_clicks": "SELECT pid, clicks FROM m_clicks",
    "metric_coverage": "SELECT pid, round(coverage, 6) AS coverage FROM m_coverage",
    "metric_recall_ndcg_alt": """, hit AS (SELECT pid, track, sum(CASE WHEN rank = 1 THEN 1.0 ELSE 1 / log2(rank) END) AS gain
            FROM predictions JOIN hidden USING (pid, track) GROUP BY 1, 2),
        per AS (SELECT pid, count(*) AS hits, sum(gain) AS dcg FROM hit GROUP BY 1),
        ideal AS (SELECT pid, 1 + coalesce(sum(CASE WHEN i > 1 THEN 1 / log2(i) END), 0) AS idcg
            FROM (SELECT pid, unnest(range(1, hits + 1)) AS i FROM per) GROUP BY 1)
        SELECT pid, round(coalesce(hits, 0) / size, 6) AS recall, round(coalesce(dcg / idcg, 0), 6) AS ndcg
        FROM (SELECT pid, count(*) AS size FROM returned GROUP BY 1) LEFT JOIN per USING (pid) LEFT JOIN ideal USING (pid)""",
    "metric_group_rprec": """, labelled AS (SELECT r.pid, r.rank, CASE WHEN h.pid IS NULL THEN 0 ELSE 1 END AS label
            FROM ranked r LEFT JOIN hidden h ON h.pid = r.pid AND h.track = r.track)
        SELECT pid, round(sum(CASE WHEN rank <= total THEN label ELSE 0 END) / max(total), 6) AS r_precision
        FROM (SELECT *, sum(label) OVER (PARTITION BY pid) AS total FROM labelled) WHERE total > 0 GROUP BY pid""",
}


# Neighbours within five places of the training lists; K is the expression of the key.
_PLACED = "SELECT pid, K AS key, row_number() OVER (PARTITION BY pid ORDER BY pos, K) AS at FROM train JOIN items USING (track)"
_WINDOW_PAIRS = """SELECT least(x.key, y.key) AS a, greatest(x.key, y.key) AS b, sum(6 - (y.at - x.at))::BIGINT AS weight, count(*) AS n
    FROM placed x JOIN placed y ON x.pid = y.pid AND y.at > x.at AND y.at <= x.at + 5 AND x.key <> y.key GROUP BY 1, 2"""


def _build() -> dict[str, str]:
    out = {name: sql(body) for name, body in _RAW.items()}
    out["evaluate_cf"] = sql(_RAW["metric_mean"], CF_PARTS)
    stages = [f"SELECT '{stage}' AS stage, * FROM ({sql(_RAW['metric_mean'], parts)})" for stage, parts in TITLE_STAGES.items()]
    out["evaluate_title"] = " UNION ALL ".join(stages)
    for name, key in (("w2v_pairs", "track"), ("w2v_artist_pairs", "artist")):
        out[name] = sql(f", placed AS ({_PLACED}) {_WINDOW_PAIRS}".replace("K AS key", f"{key} AS key").replace("pos, K", f"pos, {key}"))
    docs = "SELECT 'doc' AS kind, doc_id AS id, 0 AS turn, text FROM documents"
    talk = "SELECT 'conv' AS kind, conv_id AS id, turn, text FROM conversations"
    out["clean_title"] = f"WITH texts AS ({docs} UNION ALL {talk})," + _clean_sql("texts", "kind, id, turn") + \
        " SELECT kind, id, turn, clean FROM cleaned"
    out["title_tokens"] = _DOC_WORDS + """ SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(w) AS token FROM words) GROUP BY 1, 2"""
    out["title_ngrams"] = _DOC_WORDS + """ SELECT DISTINCT doc_id, unnest(list_concat(w,
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS ngram FROM words"""
    return out


ORACLES = _build()
