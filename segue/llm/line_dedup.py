"""Line dedup by site-relative frequency, in DataFrame functions only.

Within each host the different pages that hold a line are counted and divided by the host's different pages; lines above
the boilerplate ratio are dropped from every page of that host.  Copies of a page are one page here, whatever
their number: near copies mostly share the line of the smallest hash, which stands for them, by four hashes.  So the text of a page that was
copied often is no boilerplate; its copies are left to near-dedup.  Pages keep their row: only the host's short
list of boilerplate lines is joined to them, so no text is cut up and put together again.  Lines are hashed once: the hashes are
written beside the rows, for the counts and for the places of the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from segue.llm.carry import with_row
from segue.llm.lines import frequent_lines
from segue.session import materialize

MAX_SHARE = 0.05  # boilerplate of one section of a large mixed host is on a few percent of its pages
MIN_PAGES = 4
SKETCHES = (1, 17, 33, 49)  # places in a line's 64 hexadecimal digits where its hashes begin


def bare(line: Column) -> Column:
    """A line without outer white space and case."""
    return F.lower(F.trim(F.translate(line, "\t\x0b\f\r", "    ")))


def drop_boilerplate(
    pages: DataFrame, host: Column, text_col: str = "text", max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES,
    hold_rows: bool = True,
) -> DataFrame:
    """`pages` with the boilerplate lines of their host left out of `text_col`; all other columns as they are.

    A line is boilerplate when it stands in over `max_share` of the host's different pages, and in `min_pages` of them at
    least (below that a ratio says little).  Pages are counted by the smallest hash of their lines, so copies and
    repeated rows count once (of four such counts the largest holds); a repeated line of a page counts once, and a page without lines does not count.  Blank lines stay.  A null
    text stays null; rows with a null host are left as they are.  A page all of whose lines are boilerplate has no line of
    its own that the others could be told from: it stays whole, so no text becomes empty.  Very long texts are
    worked on whole; an empty table gives an empty result.

    `hold_rows`: write the rows beside their hashes, which saves making `pages` twice; without it only the hashes are written and
    the rows are read again, which saves the disk where `pages` is a written table.
    """

    def digest(l: Column) -> Column:
        return F.concat(F.md5(l.cast("binary")), F.md5(F.concat(F.lit("+"), l).cast("binary")))

    def least(digests: Column) -> Column:
        """The smallest of the lines' hashes, by each of the sketches."""
        return F.array(*[F.array_min(F.transform(digests, lambda d: F.substring(d, at, 16))) for at in SKETCHES])

    def names(bares: Column) -> Column:
        full = F.filter(bares, lambda l: l != "")
        return F.struct(
            F.transform(bares, lambda l: F.when(l != "", F.xxhash64(l))).alias("keys"),
            F.when(F.exists(bares, lambda l: l != ""), F.transform(F.array(F.transform(full, digest)), least)[0]).alias("copies"),
        )

    # One-element arrays bind what is used more than once, so that it is taken once.
    bares = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), bare)
    both = F.transform(F.array(bares), names)[0].alias("named")
    distinct = F.array_distinct(F.array_compact("keys")).alias("keys")
    if hold_rows:
        held = with_row(pages, host=host, named=both).select("row", "host", "named.*")
        held = materialize(held, "line-keys")
        rows = held.select("host", distinct, "copies")
    else:
        rows = materialize(pages.select(host.alias("host"), both).select("host", "named.*").select("host", distinct, "copies"), "line-keys")
        held = with_row(pages, host=host, keys=F.transform(bares, lambda l: F.when(l != "", F.xxhash64(l))))
    frequent = frequent_lines(rows, max_share, min_pages).withColumnRenamed("host", "at")
    joined = held.join(frequent, F.col("host") == F.col("at"), "left")
    text = F.col("row").getField(text_col)

    def rewrite(hit: Column) -> Column:
        """The text without the lines whose key, at the same place, is among the page's frequent ones."""
        own = F.exists("keys", lambda k: k.isNotNull() & ~F.array_contains(hit, k))
        at_place = lambda i: F.coalesce(F.array_contains(hit, F.col("keys")[i]), F.lit(False))
        kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda l, i: ~at_place(i)), "\n")
        return F.when((F.size(hit) > 0) & own, kept).otherwise(text)

    new = F.when(F.col("frequent").isNull(), text).otherwise(F.transform(F.array(F.array_intersect("keys", "frequent")), rewrite)[0])
    return joined.select(F.col("row").withField(text_col, new).alias("row")).select("row.*")


# Script, style and comment bodies are no lines; every other tag ends one.
NO_TEXT = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>"


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, host, text): the text between the tags, one line per run of text."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), NO_TEXT, "\n")
    text = F.trim(F.regexp_replace(html, r"[ \t\r]*\n\s*", "\n"), F.lit(" \n"))
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    return pages.select("page_id", F.when(host != "", F.lower(host)).alias("host"), text.alias("text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_lines(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    with_count = pages.withColumn("n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1))))
    kept = drop_boilerplate(with_count, F.col("host"))
    n_kept = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1)))
    return kept.select(
        "page_id", "host", F.col("n_lines").cast("long"), n_kept.cast("long").alias("n_kept"), F.md5("text").alias("text_md5")
    )


SQL = rf"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '') AS host,
      trim(regexp_replace(regexp_replace(coalesce(html, ''), '{NO_TEXT}', chr(10), 'g'), '[ \t\r]*\n\s*', chr(10), 'g'), ' ' || chr(10)) AS text
      FROM pages),
l AS (SELECT r, host, text, string_split(text, chr(10)) AS lines FROM p),
e AS (SELECT r, host, i, lines[i] AS line, lower(trim(regexp_replace(lines[i], '[\t\v\f\r]', ' ', 'g'))) AS bare
      FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l)),
c AS (SELECT r, host, digit, min(substr(md5(bare) || md5('+' || bare), digit, 16)) AS copy FROM e, (SELECT unnest({list(SKETCHES)}) AS digit) AS s
      WHERE bare <> '' GROUP BY ALL),
t AS (SELECT host, max(n) AS total FROM (SELECT host, digit, count(DISTINCT copy) AS n FROM c GROUP BY ALL) GROUP BY host),
f AS (SELECT host, bare FROM (SELECT host, bare, max(n) AS n FROM (SELECT e.host, bare, digit, count(DISTINCT copy) AS n
      FROM e JOIN c USING (r) WHERE bare <> '' AND e.host IS NOT NULL GROUP BY ALL) GROUP BY ALL) JOIN t USING (host) WHERE n >= {MIN_PAGES} AND n > {MAX_SHARE} * total),
m AS (SELECT e.*, f.bare IS NOT NULL AS over FROM e LEFT JOIN f ON e.host = f.host AND e.bare = f.bare),
o AS (SELECT r, bool_or(bare <> '' AND NOT over) AS has_own FROM m GROUP BY r),
k AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS kept FROM m JOIN o USING (r) WHERE NOT over OR NOT has_own GROUP BY r)
SELECT page_id, host, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
       CASE WHEN coalesce(kept, '') = '' THEN 0 ELSE len(string_split(kept, chr(10))) END::BIGINT AS n_kept,
       md5(coalesce(kept, '')) AS text_md5
FROM p LEFT JOIN k USING (r)"""

QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES = {"op8_line_dedup": SQL}
