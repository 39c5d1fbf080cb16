"""Queries of the page triage beyond text: titles, rasters, visual pages in the free slots, whole cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TEST_WORDS
from ..operators import triage, visual
from ..sources import tables as src
from . import inputs_sql as S
from .registry import DEFAULT, SMALL, long, query

_PROFILE = """px AS (
  SELECT vec_id // 20 AS doc_id, vec_id // 200 AS case_id, vec_id // 20 % 10 + 1 AS page_number, vec_id % 20 AS row_no,
    CASE WHEN vec_id % (2 + vec_id // 20 % 4) = 0 THEN list_transform(embedding, lambda x: CAST(255 AS BIGINT))
      ELSE list_transform(CASE WHEN vec_id // 20 % 3 = 0 THEN list_sort(embedding) ELSE embedding END, lambda x: CAST(floor(128 + 256 * x::DOUBLE) AS BIGINT)) END AS p
  FROM embeddings),
lim AS (SELECT doc_id, floor(CAST(sum(list_sum(p)) AS DOUBLE) / CAST(sum(len(p)) AS DOUBLE) * 0.7::DOUBLE) AS t FROM px GROUP BY 1),
bits AS (SELECT px.*, len(p) AS n, array_to_string(list_transform(p, lambda x: CASE WHEN x < t THEN '1' ELSE '0' END), '') AS b FROM px JOIN lim USING (doc_id)),
inked AS (
  SELECT *, length(replace(b, '0', '')) AS ink, length(replace(b, '0', '')) >= greatest(2, CAST(floor(n * 0.005) AS INT)) AS has,
    contains(b, repeat('1', greatest(2, CAST(floor(n * 0.06) AS INT)))) AS rule FROM bits),
edges AS (SELECT *, has AND NOT coalesce(lag(has) OVER (PARTITION BY doc_id ORDER BY row_no), false) AS rising FROM inked),
profile AS (
  SELECT doc_id, case_id, page_number, max(n) AS width, count(*) AS height, sum(ink)::DOUBLE / sum(n)::DOUBLE AS ink_ratio,
    count(*) FILTER (rising) AS bands, count(*) FILTER (rule) AS ruled FROM edges GROUP BY ALL)"""
_INK = "ink_ratio BETWEEN 0.0005 AND 0.5"
_TABLE = "(bands >= 8 OR ruled >= 16 AND bands >= 3)"


@query(f"""WITH {_PROFILE}
SELECT CAST(case_id AS BIGINT) AS case_id, CAST(page_number AS BIGINT) AS page_number, CAST(width AS BIGINT) AS width, height, round(ink_ratio, 9) AS ink_ratio, bands, ruled,
  {_INK} AS has_ink, {_TABLE} AS looks_like_table FROM profile""")
def visual_profile(spark, sf):
    rows = visual.ink_profile(src.rasters(spark, sf), DEFAULT)
    return rows.select(
        *long("case_id", "page_number", "width", "height"), F.round("ink_ratio", 9).alias("ink_ratio"), *long("bands", "ruled"),
        visual.has_ink(DEFAULT).alias("has_ink"), visual.is_table(DEFAULT).alias("looks_like_table"))


@query(f"""WITH {_PROFILE}, a AS (SELECT *, {_INK} AS inked, {_INK} AND {_TABLE} AS accepted FROM profile),
n AS (SELECT *, NOT accepted AND inked AND bands >= 3 AND (coalesce(lag(accepted) OVER w, false) OR coalesce(lead(accepted) OVER w, false)) AS neighbor
  FROM a WINDOW w AS (PARTITION BY case_id ORDER BY page_number)),
s AS (SELECT *, CASE WHEN accepted THEN (2 * least(bands, 40) + least(ruled, 40))::DOUBLE ELSE 5.0::DOUBLE END AS score FROM n WHERE accepted OR neighbor)
SELECT CAST(case_id AS BIGINT) AS case_id, CAST(page_number AS BIGINT) AS page_number, accepted, score,
  row_number() OVER (PARTITION BY case_id ORDER BY score DESC, page_number) AS rank FROM s""")
def visual_rank_neighbors(spark, sf):
    rows = visual.visual_candidates(visual.ink_profile(src.rasters(spark, sf), DEFAULT), DEFAULT)
    return rows.select(*long("case_id", "page_number"), "accepted", "score", *long("rank"))


_COVER = """least(coalesce(list_sum(list_transform(range(doc_id % 3), lambda i:
    greatest(least(50.0::DOUBLE * i + 10.0::DOUBLE * (doc_id % 90), 612.0::DOUBLE) - 50.0::DOUBLE * i, 0.0::DOUBLE) * 792.0::DOUBLE)), 0.0::DOUBLE)
  / (612.0::DOUBLE * 792.0::DOUBLE), 1.0::DOUBLE)"""


def _with_images(rows):
    """Pages with up to two images side by side, by their doc_id."""
    at = lambda k: F.struct(
        (50.0 * k).alias("x0"), F.lit(-5.0).alias("y0"), (50.0 * k + 10.0 * (F.col("doc_id") % 90)).alias("x1"), F.lit(900.0).alias("y1"))
    images = F.slice(F.transform(F.sequence(F.lit(0), F.lit(1)), at), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    return visual.image_cover(rows.withColumns({"images": images, "width": F.lit(612.0), "height": F.lit(792.0)})).drop("images", "width", "height")


def _signals(spark, sf):
    read = triage.read_pages(src.page_texts(spark, sf), TEST_WORDS)
    return triage.scored(src.numbered(_with_images(read)), src.toc(spark, sf), TEST_WORDS)


_VISUAL = f"""{S.NEIGHBORS},
seen AS (SELECT *, {_COVER} AS cover, NOT calculation AND NOT is_primary AND (little_text AND doc_id % 3 >= 1 OR {_COVER} >= 0.85::DOUBLE) AS visual FROM near)"""


@query(f"WITH {_VISUAL} SELECT case_id, CAST(page_number AS BIGINT) AS page_number, CAST(doc_id % 3 AS BIGINT) AS n_images, round(cover, 6) AS coverage, visual FROM seen")
def visual_pages(spark, sf):
    read = _with_images(triage.read_pages(src.page_texts(spark, sf), TEST_WORDS))
    kept = src.numbered(read).select("case_id", "page_number", "n_images", F.round("coverage", 6).alias("coverage"))
    return kept.join(_signals(spark, sf).select("case_id", "page_number", "visual"), ["case_id", "page_number"]).select("case_id", *long("page_number", "n_images"), "coverage", "visual")


def _slots_sql(cap: int, keep_all: int = 0) -> str:
    """Text pages, accepted visual pages, visual pages beside anchors, then the other visual pages of cases of up to 15 pages."""
    return f"""WITH {_VISUAL}, {_PROFILE},
v AS (SELECT s.* EXCLUDE (b, neighbor), visual AND coalesce({_INK}, false) AS inked, visual AND coalesce({_INK} AND {_TABLE}, false) AS accepted,
    is_primary AND keywords <> '' AS anchor, s.b AND NOT calculation AND NOT is_primary AND patterns > 0 AND keywords = '' AND NOT visual AS neighbor,
    p.bands, p.ruled, max(s.page_number) OVER (PARTITION BY s.case_id) AS n_pages
  FROM seen s LEFT JOIN profile p ON s.doc_id = p.doc_id * 3 + 2),
near_v AS (SELECT *, coalesce(lag(accepted OR anchor) OVER w, false) OR coalesce(lead(accepted OR anchor) OVER w, false) AS beside
  FROM v WINDOW w AS (PARTITION BY case_id ORDER BY page_number)),
tiers AS (SELECT *, CASE WHEN is_primary OR neighbor THEN 0 WHEN accepted THEN 1 WHEN inked AND beside AND bands >= 3 THEN 2 WHEN visual AND n_pages <= 15 THEN 3 END AS tier FROM near_v),
points AS (SELECT *, CASE tier WHEN 1 THEN (2 * least(bands, 40) + least(ruled, 40))::DOUBLE WHEN 2 THEN 5.0::DOUBLE WHEN 0 THEN score END AS place, n_pages <= {keep_all} AS whole FROM tiers),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN NOT whole THEN tier END, CASE WHEN NOT whole THEN place END DESC NULLS LAST, page_number) AS rank
  FROM points WHERE whole OR tier IS NOT NULL)
SELECT case_id, CAST(page_number AS BIGINT) AS page_number, CAST(tier AS BIGINT) AS tier, rank, NOT whole AND rank > {cap} AS overflow FROM ranked"""


def _slots(spark, sf, config, keep_all_up_to: int = 0):
    signals = _signals(spark, sf)
    shown = src.rasters(spark, sf).drop("case_id", "page_number").join(signals.select("doc_id", "case_id", "page_number"), "doc_id")
    rows = triage.triage(signals, config, profile=visual.ink_profile(shown, config), keep_all_up_to=keep_all_up_to)
    return rows.select("case_id", *long("page_number", "tier", "rank"), "overflow")


@query(_slots_sql(25))
def triage_visual_slots(spark, sf):
    """Visual pages fill the slots that text pages leave free."""
    return _slots(spark, sf, TEST_WORDS)


@query(_slots_sql(2))
def triage_visual_overflow(spark, sf):
    return _slots(spark, sf, SMALL)


@query(_slots_sql(2, 12))
def triage_whole_cases(spark, sf):
    """Cases of up to 12 pages go whole, the others are ranked: one triage."""
    return _slots(spark, sf, SMALL, 12)


@query(f"""WITH c AS ({_slots_sql(2)}), s AS (SELECT case_id, page_number, visual FROM ({f"WITH {_VISUAL} SELECT * FROM seen"}))
SELECT c.case_id, c.page_number, c.rank FROM c JOIN s ON c.case_id = s.case_id AND c.page_number = s.page_number WHERE NOT visual""")
def candidates_without_visual(spark, sf):
    """Candidates that are left for the model when visual pages were read elsewhere."""
    read = _signals(spark, sf).where("visual")
    return triage.text_only(_slots(spark, sf, SMALL), read).select("case_id", "page_number", "rank")


@query(f"""WITH c AS ({_slots_sql(25)})
SELECT case_id, page_number, rank, CAST((rank + 4) // 5 AS BIGINT) AS calls_so_far, CAST((max(rank) OVER (PARTITION BY case_id) + 4) // 5 AS BIGINT) AS calls FROM c WHERE NOT overflow""")
def triage_call_counts(spark, sf):
    rows = triage.call_counts(_slots(spark, sf, TEST_WORDS), DEFAULT.pages_per_call)
    return rows.select("case_id", "page_number", "rank", *long("calls_so_far", "calls"))


@query(f"WITH {S.TOC} SELECT case_id, string_agg(title, chr(10) ORDER BY page_number, item_id) AS titles, count(*) AS n FROM toc GROUP BY 1")
def toc_title_lists(spark, sf):
    rows = triage.toc_titles(src.toc(spark, sf), "item_id")
    return rows.select("case_id", F.array_join("titles", "\n").alias("titles"), F.size("titles").cast("bigint").alias("n"))


@query(f"""WITH {_VISUAL} SELECT case_id, count(*) AS pages, count(*) FILTER (calculation) AS calculation_pages, count(*) FILTER (is_primary) AS primary_pages,
  count(*) FILTER (visual) AS visual_pages FROM seen GROUP BY 1""")
def page_kind_counts(spark, sf):
    return triage.page_counts(_signals(spark, sf))
