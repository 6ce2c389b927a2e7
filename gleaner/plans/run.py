"""One whole run over all postings: resolve, gate, judge once, budget, verdict, package, stamp."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.operators import dedup, gate
from gleaner.operators import run as rn
from gleaner.operators.scoring import profile_scorer
from gleaner.plans import sqlviews as s
from gleaner.plans.gates import _RUN, live
from gleaner.plans.registry import query
from gleaner.plans.resolve import GROUPS, MERGED_SQL, Resolution
from gleaner.plans.verdict import _PACKAGED, packaged
from gleaner.plans.views import EXCLUDED_TITLES, MIN_SCORE, NOW, PROFILE, Tables, stamp
from gleaner.session import cut_lineage

BUDGET, LEAST, BORDERLINE = 150, 70, 50

_MARKS = "key IN (SELECT key FROM run_marks)"
_WHOLE = {
    **_RUN,
    "hits": _RUN["hits"].replace("source := p.source, generated", "source := p.source, url := p.url, reposts := p.reposts, generated"),
    "fresh": _RUN["fresh"].replace("h.best.file AS repost_file", "h.best.file AS repost_file, h.best.url AS repost_url, h.best.reposts + 1 AS reposts"),
    "run_marks": """SELECT 'llm-retry:' || id AS key FROM keyed WHERE seq % 2 = 1 UNION SELECT 'title-only-llm:' || id FROM keyed WHERE seq % 3 = 1
      UNION SELECT 'title-only-kw:' || id FROM keyed WHERE seq % 3 = 2""",
    "kinds": f"""SELECT d.seq, k.id, k.link, d.repost_file, CASE WHEN early IS NOT NULL THEN early WHEN d.score < {MIN_SCORE} THEN 'low' ELSE 'match' END AS kind,
      CASE WHEN early IS NULL THEN d.score END AS score, early IS NULL AND short AS retry, 'title-only-kw:' || k.id NOT IN (SELECT key FROM run_marks) AS kw_first
      FROM decided d JOIN keepers k USING (seq)""",
    "once": "SELECT seq, id, score, retry, first_value(seq) OVER (PARTITION BY id ORDER BY retry::INT, seq) AS judged_seq FROM kinds WHERE kind = 'match'",
    "budgeted": f"SELECT *, row_number() OVER (ORDER BY score DESC, seq) > {BUDGET} AS deferred FROM once WHERE seq = judged_seq",
    "told": """SELECT b.*, l.llm_score, coalesce(l.suspect, false) AS suspect, 'llm-retry:' || b.id NOT IN (SELECT key FROM run_marks) AS retry_first,
      'title-only-llm:' || b.id NOT IN (SELECT key FROM run_marks) AS title_first FROM budgeted b LEFT JOIN verdicts l ON l.seq = b.seq""",
    "acted": f"""SELECT *, CASE WHEN deferred THEN 'deferred' WHEN llm_score IS NULL AND retry_first THEN 'defer'
      WHEN llm_score IS NULL OR (llm_score < {LEAST} AND (llm_score >= {BORDERLINE} OR suspect)) THEN CASE WHEN retry AND title_first THEN 'hold' ELSE 'borderline' END
      WHEN llm_score < {LEAST} THEN 'drop' ELSE 'write' END AS action FROM told""",
    "stamping": """SELECT *, CASE WHEN action IN ('deferred', 'defer', 'hold') THEN false WHEN action = 'drop' THEN NOT (retry AND title_first) ELSE true END AS stamped FROM acted""",
    "ways": """SELECT p.seq, p.component, p.role, p.keeper_seq, k.kind, k.score, o.judged_seq, a.action, CASE WHEN a.action = 'borderline' THEN 'borderline' END AS tier,
      CASE WHEN k.kind = 'match' THEN coalesce(a.stamped, false) ELSE NOT (k.retry AND k.kw_first) END AS stamped, CASE WHEN a.action IN ('write', 'borderline') THEN o.judged_seq END AS package_seq
      FROM plan p JOIN kinds k ON k.seq = p.keeper_seq LEFT JOIN once o ON o.seq = k.seq LEFT JOIN stamping a ON a.seq = o.judged_seq""",
    "done": """SELECT k.seq, k.id, k.repost_file, CASE WHEN k.kind = 'match' AND w.judged_seq <> k.seq AND k.repost_file IS NULL THEN '' ELSE k.link END AS link
      FROM kinds k JOIN ways w ON w.seq = k.seq WHERE w.stamped""",
    "stamps": MERGED_SQL["stamps"],
}


def whole(select: str, *without: str) -> str:
    return s.sql(select, "keyed", "packages", "package_links", "live_seen", "verdicts", recursive=GROUPS, **{k: v for k, v in _WHOLE.items() if k not in without})


class Run:
    """A run's tables, each made once."""

    def __init__(self, t: Tables):
        self.t, self.resolution = t, Resolution(t)
        k = t.keys.select("seq", "id")
        mark = lambda name, n, rest: k.filter(F.col("seq") % n == rest).select(F.concat(F.lit(name), "id").alias("key"))
        marks = mark(rn.RETRY, 2, 1).union(mark(rn.TITLE_ONLY_VERDICT, 3, 1)).union(mark(rn.TITLE_ONLY, 3, 2)).distinct()
        self.seen = cut_lineage(live(t).select("key", "last_seen").unionByName(marks.withColumn("last_seen", stamp(NOW))))

    @cached_property
    def copies(self) -> DataFrame:
        return cut_lineage(dedup.folded_copies(self.resolution.keyed, self.resolution.plan))

    @cached_property
    def merged(self) -> DataFrame:
        return dedup.merged_postings(self.resolution.grouped, self.resolution.plan, self.t.texts)

    @cached_property
    def decisions(self) -> DataFrame:
        r = self.resolution
        keepers = cut_lineage(r.keyed.join(r.plan.filter("role = 'keeper'").select("seq"), "seq"))
        texts = self.merged.select("seq", "text")
        return cut_lineage(gate.keyword_gate(keepers, texts, self.seen, self.t.packages, profile_scorer(PROFILE), EXCLUDED_TITLES, MIN_SCORE, copies=self.copies))

    @cached_property
    def judged(self) -> tuple[DataFrame, DataFrame]:
        return tuple(map(cut_lineage, rn.judged_matches(self.decisions, self.seen, self.t.verdicts, BUDGET, LEAST, BORDERLINE)))

    @cached_property
    def ways(self) -> DataFrame:
        return cut_lineage(rn.lineage(self.resolution.plan, self.decisions, *self.judged, self.seen))


@query("snk_01_run_lineage", whole("SELECT seq, component, role, keeper_seq, kind, score, judged_seq, action, tier, stamped, package_seq FROM ways"))
def run_lineage(t: Tables) -> DataFrame:
    """The way of every posting through one run: what it was folded into, what the gates said, which package it ended in."""
    return Run(t).ways


@query("snk_01_run_packages", whole(rf"""
SELECT {_PACKAGED}, reposts, reposted_from FROM (SELECT k.seq, k.source, k.title, k.company, k.location, k.url, a.action, a.suspect, a.llm_score, j.score, j.matched_role, j.matched_skills, j.penalties, f.reposts, f.repost_url AS reposted_from,
  CASE WHEN d.kind IS NULL THEN k.posted WHEN d.kind = 'posted' THEN d.stamp END AS posted, CASE WHEN d.kind IS NULL THEN k.relisted WHEN d.kind = 'relisted' THEN d.stamp END AS relisted,
  CASE WHEN d.kind IS NULL THEN k.updated WHEN d.kind = 'updated' THEN d.stamp END AS updated
  FROM stamping a JOIN keepers k USING (seq) JOIN judged j USING (seq) LEFT JOIN fresh f USING (seq) LEFT JOIN stamps d ON d.keeper_seq = k.seq WHERE a.action IN ('write', 'borderline'))"""))
def run_packages(t: Tables) -> DataFrame:
    """The packages of the run, every column: the longest text, the earliest date, score, verdict, and what was listed before."""
    run = Run(t)
    scored = ["score", "matched_role", "matched_skills", "penalties", "repost_url", "reposts", "llm_score", "suspect", "tier"]
    accepted = run.judged[1].filter("action IN ('write', 'borderline')").select("seq", *scored)
    return packaged(run.merged.select("seq", "source", "title", "company", "location", "url", "text", *fixed.DATE_KINDS).join(accepted, "seq"))


@query("snk_01_run_package_links", whole("SELECT w.package_seq, w.seq, k.source, k.url FROM ways w JOIN keyed k USING (seq) WHERE w.package_seq IS NOT NULL AND w.seq <> w.package_seq"))
def run_package_links(t: Tables) -> DataFrame:
    run = Run(t)
    return rn.package_links(run.ways, run.resolution.keyed)


@query("scr_11_run_stamps", whole("""
SELECT DISTINCT key FROM (SELECT id AS key FROM done UNION ALL SELECT c.merged_id FROM copies c JOIN done d ON d.seq = c.keeper_seq WHERE c.merged_id IS NOT NULL
  UNION ALL SELECT 'repost:' || link FROM done WHERE link <> '' AND (repost_file IS NOT NULL OR 'repost:' || link IN (SELECT key FROM live_seen))
  UNION ALL SELECT 'title-only-kw:' || id FROM kinds WHERE kind <> 'match' AND retry AND kw_first
  UNION ALL SELECT 'llm-retry:' || id FROM stamping WHERE action = 'defer'
  UNION ALL SELECT 'title-only-llm:' || id FROM stamping WHERE action = 'hold' OR (action = 'drop' AND NOT stamped))"""))
def run_stamps(t: Tables) -> DataFrame:
    """What the run leaves in the seen store."""
    run = Run(t)
    return rn.run_stamps(run.decisions, run.ways, run.judged[1], run.seen, run.copies)
