"""Keys and cross-source resolution."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.keys import legacy_spelling
from gleaner.functions.text import normalize_company
from gleaner.operators import dedup
from gleaner.operators.skew import running_min
from gleaner.plans import sqlviews as s
from gleaner.plans.registry import query
from gleaner.plans.views import Tables, shown
from gleaner.session import cut_lineage

GROUPS = """edges AS (SELECT seq, 'c:' || canonical AS key FROM keyed UNION SELECT seq, 'link:' || link FROM keyed WHERE link <> ''),
pairs AS (SELECT DISTINCT a.seq AS a, b.seq AS b FROM edges a JOIN edges b USING (key)),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
grouped AS (SELECT k.*, c.component FROM keyed k JOIN (SELECT a AS seq, min(b) AS component FROM reach GROUP BY a) c USING (seq)),
per_source AS (SELECT component, source, count(*) AS k, min(seq) AS first_seq FROM grouped GROUP BY 1, 2),
longest AS (SELECT component, arg_max(source, struct_pack(a := length(text), b := -seq)) AS long_source, arg_max(seq, struct_pack(a := length(text), b := -seq)) AS long_seq, max(length(text)) AS long_len FROM grouped GROUP BY 1),
keeper AS (SELECT p.component, p.source AS keeper_source, p.k FROM per_source p JOIN longest USING (component)
  QUALIFY row_number() OVER (PARTITION BY p.component ORDER BY p.k DESC, (p.source = long_source)::INT DESC, p.first_seq) = 1),
roles AS (SELECT g.*, g.source = keeper_source AS is_keeper, k, row_number() OVER (PARTITION BY g.component, g.source = keeper_source ORDER BY g.seq) - 1 AS i FROM grouped g JOIN keeper USING (component)),
plan AS (SELECT r.component, r.seq, CASE WHEN r.is_keeper THEN 'keeper' ELSE 'copy' END AS role, h.seq AS keeper_seq
  FROM roles r JOIN roles h ON h.component = r.component AND h.is_keeper AND h.i = CASE WHEN r.is_keeper THEN r.i ELSE r.i % r.k END)"""


def resolved(select: str, **extra: str) -> str:
    return s.sql(select, "keyed", recursive=GROUPS, **extra)


class Resolution:
    """Components once, then the keepers and folds that follow from them. The fold plan is a narrow table of
    ids; it is written once because several joins read it."""

    def __init__(self, t: Tables):
        self.keyed = t.keys
        self.grouped = cut_lineage(self.keyed.join(dedup.components(self.keyed), "seq"))

    @cached_property
    def plan(self) -> DataFrame:
        return cut_lineage(dedup.fold_plan(self.grouped))


@query("str_01_normalize_title", s.sql("SELECT seq, title_norm FROM keyed", "keyed"))
def titles(t: Tables) -> DataFrame:
    return t.keyed.select("seq", "title_norm")


@query("str_02_normalize_company", s.sql(
    f"""SELECT company_norm, count(*) AS n FROM (SELECT {s.named_company('ct')} AS company_norm FROM normed
    UNION ALL SELECT {s.named_company('tokens')} FROM (SELECT string_split({s.norm_title("CASE c_custkey % 4 WHEN 0 THEN 'ТОВ ' || c_name WHEN 1 THEN c_name || ', Inc.' WHEN 2 THEN '—' ELSE 'Group LLC' END")}, ' ') AS tokens FROM customer)) GROUP BY 1""".replace("WHEN 2 THEN '—'", "WHEN 2 THEN ''"), "normed"))
def companies(t: Tables) -> DataFrame:
    key = F.col("c_custkey") % 4
    named = t.table("customer").select(
        F.when(key == 0, F.concat(F.lit("ТОВ "), "c_name")).when(key == 1, F.concat("c_name", F.lit(", Inc.")))
        .when(key == 2, fixed.BLANK_FIELD).otherwise("Group LLC").alias("company")
    )
    both = t.postings.select("company").unionByName(named)
    return both.groupBy(normalize_company("company").alias("company_norm")).agg(F.count(F.lit(1)).alias("n"))


@query("str_05_identity_key", s.sql(
    "SELECT seq, id, trim(regexp_replace(regexp_replace(id, '[+#]+', ' ', 'g'), '\\s+', ' ', 'g')) AS legacy FROM keyed", "keyed"))
def identities(t: Tables) -> DataFrame:
    return t.keyed.select("seq", "id", legacy_spelling("id").alias("legacy"))


@query("str_06_canonical_key", s.sql("SELECT seq, canonical FROM keyed", "keyed"))
def canonicals(t: Tables) -> DataFrame:
    return t.keyed.select("seq", "canonical")


@query("joi_08_components", resolved("SELECT seq, component FROM grouped"))
def components(t: Tables) -> DataFrame:
    return dedup.components(t.keys)


@query("agg_03_keepers", resolved("SELECT component, keeper_source, k FROM keeper"))
def keepers(t: Tables) -> DataFrame:
    return dedup.keeper_sources(Resolution(t).grouped).select("component", "keeper_source", "k")


@query("win_02_fold_plan", resolved("SELECT component, seq, role, keeper_seq FROM plan"))
def folds(t: Tables) -> DataFrame:
    return Resolution(t).plan


@query("agg_04_folded_copies", resolved("""
SELECT p.keeper_seq, p.seq, c.source AS alt_source, c.url AS alt_url, CASE WHEN c.id <> k.id THEN c.id END AS merged_id,
  CASE WHEN c.title_norm <> k.title_norm THEN c.title END AS merged_title, CASE WHEN c.canonical <> k.canonical THEN c.canonical END AS merged_key
FROM plan p JOIN keyed c USING (seq) JOIN keyed k ON k.seq = p.keeper_seq WHERE p.role = 'copy'"""))
def copies(t: Tables) -> DataFrame:
    r = Resolution(t)
    return dedup.folded_copies(r.keyed, r.plan)


MERGED_SQL = dict(
    richest="SELECT p.component, arg_max(seq, struct_pack(a := length(text), b := -seq)) AS rich_seq, max(length(text)) AS rich_len FROM plan p JOIN keyed USING (seq) WHERE role = 'keeper' GROUP BY 1",
    stamps="""SELECT p.keeper_seq, arg_min(kind, struct_pack(a := stamp, b := role = 'copy', c := p.seq, d := o)) AS kind, min(stamp) AS stamp
      FROM plan p JOIN (SELECT seq, 'posted' AS kind, 0 AS o, posted AS stamp FROM keyed UNION ALL SELECT seq, 'relisted', 1, relisted FROM keyed UNION ALL SELECT seq, 'updated', 2, updated FROM keyed) d USING (seq)
      WHERE stamp IS NOT NULL AND p.keeper_seq IN (SELECT keeper_seq FROM plan WHERE role = 'copy') GROUP BY 1""",
)


@query("agg_05_earliest_dates", resolved(f"SELECT keeper_seq, kind, {s.shown('stamp')} AS first_at FROM stamps", stamps=MERGED_SQL["stamps"]))
def dates(t: Tables) -> DataFrame:
    r = Resolution(t)
    return dedup.earliest_dates(r.keyed, r.plan).select("keeper_seq", "kind", shown("at").alias("first_at"))


@query("agg_04_merged_postings", resolved(f"""
SELECT k.seq, k.source, md5(CASE WHEN rich_seq = k.seq AND long_len > rich_len THEN l.text ELSE k.text END) AS text_md5,
  {s.shown("CASE WHEN d.kind IS NULL THEN k.posted WHEN d.kind = 'posted' THEN d.stamp END")} AS posted,
  {s.shown("CASE WHEN d.kind IS NULL THEN k.relisted WHEN d.kind = 'relisted' THEN d.stamp END")} AS relisted,
  {s.shown("CASE WHEN d.kind IS NULL THEN k.updated WHEN d.kind = 'updated' THEN d.stamp END")} AS updated
FROM plan p JOIN keyed k USING (seq) JOIN richest USING (component) JOIN longest USING (component) JOIN keyed l ON l.seq = long_seq
LEFT JOIN stamps d ON d.keeper_seq = k.seq WHERE p.role = 'keeper'""", **MERGED_SQL))
def merged(t: Tables) -> DataFrame:
    r = Resolution(t)
    out = dedup.merged_postings(r.grouped, r.plan, t.texts)
    return out.select("seq", "source", F.md5("text").alias("text_md5"), *[shown(k).alias(k) for k in fixed.DATE_KINDS])


@query("agg_02_merged_count", resolved("SELECT count(*) FILTER (role = 'copy') AS merged FROM plan"))
def merged_count(t: Tables) -> DataFrame:
    return dedup.merged_count(Resolution(t).plan)


@query("src_17_unique_by_url", s.sql("SELECT seq, url FROM keyed QUALIFY row_number() OVER (PARTITION BY link ORDER BY seq) = 1", "keyed"))
def unique(t: Tables) -> DataFrame:
    return dedup.unique_by_url(t.keyed.select("seq", "url", "link"), "link").select("seq", "url")


@query("src_16_mark_relisted", """
SELECT seq, strftime(posted, '%Y-%m-%d') AS posted, strftime(relisted, '%Y-%m-%d') AS relisted FROM (
  SELECT seq, CASE WHEN NOT coalesce(day > low + INTERVAL 1 DAY, false) THEN day END AS posted, CASE WHEN day > low + INTERVAL 1 DAY THEN day END AS relisted FROM (
    SELECT o_orderkey AS seq, o_orderdate AS day, min(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM orders))""")
def relisted(t: Tables) -> DataFrame:
    """Per board, ids descending; the running minimum is taken in id ranges, so a big board is many tasks."""
    o = t.table("orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("board"), F.col("o_orderdate").cast("timestamp").alias("at"))
    low = running_min(o, ["board"], -F.floor(F.col("seq") / 100_000), [F.col("seq").desc()], "at", "low")
    late = F.coalesce(F.col("at") > F.col("low") + F.expr(f"INTERVAL {fixed.RELIST_MARGIN_DAYS} DAY"), F.lit(False))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return low.select("seq", day(F.when(~late, F.col("at"))).alias("posted"), day(F.when(late, F.col("at"))).alias("relisted"))
