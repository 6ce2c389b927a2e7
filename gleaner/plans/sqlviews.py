"""The same views as SQL text, for the independent check."""

from __future__ import annotations

from gleaner import fixed
from gleaner.operators.profile import Profile, _HAS_CYRILLIC
from gleaner.plans import views as v


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(lit(x) for x in values) + "]"


def norm_title(e: str) -> str:
    return (
        rf"trim(regexp_replace(regexp_replace(lower(nfc_normalize(coalesce({e}, ''))), '[^\p{{L}}\p{{N}}+#\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
    )


AUTHORITY = r"(?i)^([a-z][a-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:@\s]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def part(e: str, i: int) -> str:
    return f"regexp_extract({e}, {lit(AUTHORITY)}, {i})"


def host(e: str) -> str:
    return f"lower({part(e, 3)})"


def path(e: str) -> str:
    return f"CASE WHEN {part(e, 5)} = '' AND {part(e, 3)} <> '' THEN '/' ELSE {part(e, 5)} END"


def url_key(e: str) -> str:
    return f"CASE WHEN {part(e, 3)} = '' THEN {e} ELSE {host(e)} || CASE WHEN {part(e, 4)} NOT IN ('', '80', '443') THEN ':' || {part(e, 4)} ELSE '' END || ({path(e)}) END"


def link_key(e: str) -> str:
    h = rf"regexp_replace({host(e)}, '^www\.', '')"
    p = f"regexp_replace({path(e)}, '/+$', '')"
    kept = f"list_sort(list_transform(list_filter(string_split({part(e, 6)}, '&'), lambda q: q <> '' AND NOT regexp_matches(q, {lit(fixed.TRACKING_PARAM)})), lambda q: CASE WHEN contains(q, '=') THEN q ELSE q || '=' END))"
    query = f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"
    board = f"{h} = 'djinni.co' AND regexp_extract({p}, '^/jobs/[0-9]+') <> ''"
    return f"CASE WHEN {part(e, 3)} = '' THEN '' WHEN {board} THEN {h} || regexp_extract({p}, '^/jobs/[0-9]+') ELSE {h} || {p} || {query} END"


def named_company(tokens: str) -> str:
    forms = ", ".join(lit(f) for f in fixed.LEGAL_FORMS)
    named = f"list_filter({tokens}, lambda x: x <> '' AND x NOT IN ({forms}))"
    return f"CASE WHEN len({named}) > 0 THEN array_to_string({named}, ' ') ELSE {tokens}[1] END"


def canonical_tokens(title_norm: str) -> str:
    t = title_norm
    for phrase, short in fixed.TITLE_PHRASES:
        for _ in range(2):  # RE2 has no look-around: a second pass takes neighbours that share a space
            t = rf"regexp_replace({t}, '(^|[^a-z0-9_]){phrase}($|[^a-z0-9_])', '\1{short}\2', 'g')"
    kept = f"list_filter(string_split({t}, ' '), lambda x: x <> '' AND NOT regexp_full_match(x, '#?[0-9]{{3,}}'))"
    return f"array_to_string(list_sort(list_distinct(flatten(list_transform({kept}, lambda x: CASE WHEN x = 'aqa' THEN ['automation', 'qa'] ELSE [x] END)))), ' ')"


def mentions(hay: str, term: str) -> str:
    """Whole-word test without look-around (RE2); for Latin terms."""
    assert not _HAS_CYRILLIC.search(term)
    words = r"\s+".join(term.lower().split())
    return rf"regexp_matches({hay}, '(^|[^a-z0-9]){words}($|[^a-z0-9+#]|\+($|[^+]))')"


def concept(hay: str, term: str, profile: Profile) -> str:
    return "(" + " OR ".join(mentions(hay, t) for t in [term, *profile.synonyms.get(term, [])]) + ")"


def scored(source: str, profile: Profile = v.PROFILE) -> str:
    """matched_role, matched_skills, penalties, score over ``source`` (needs lower-cased column hay)."""
    role = "CASE " + " ".join(f"WHEN {mentions('hay', r)} THEN {lit(r)}" for r in profile.roles) + " END"
    skills = "[" + ", ".join(f"CASE WHEN {concept('hay', t, profile)} THEN {lit(t)} END" for t in profile.skills) + "]"
    weights = "[" + ", ".join(f"CASE WHEN {concept('hay', t, profile)} THEN {w} END" for t, w in profile.skills.items()) + "]"
    anti = "[" + ", ".join(f"CASE WHEN {mentions('hay', t)} THEN {lit(t)} END" for t in profile.penalties) + "]"
    minus = " + ".join(f"CASE WHEN {mentions('hay', t)} THEN {w} ELSE 0 END" for t, w in profile.penalties.items())
    return (
        f"SELECT *, CASE WHEN matched_role IS NULL THEN 0 ELSE {fixed.ROLE_BONUS} END + points + minus AS score FROM ("
        f"SELECT *, {role} AS matched_role, array_to_string(list_filter({skills}, lambda x: x IS NOT NULL), ', ') AS matched_skills, "
        f"array_to_string(list_filter({anti}, lambda x: x IS NOT NULL), ', ') AS penalties, {minus} AS minus, "
        f"coalesce(list_sum(list_sort(list_filter({weights}, lambda x: x IS NOT NULL), 'DESC')[1:{profile.max_skills}]), 0)::INT AS points "
        f"FROM {source})"
    )


def excluded_term(title: str, terms=v.EXCLUDED_TITLES) -> str:
    return "CASE " + " ".join(
        rf"WHEN regexp_matches(lower({title}), '(^|[^\p{{L}}\p{{N}}]){t}($|[^\p{{L}}\p{{N}}])') THEN {lit(t)}" for t in terms
    ) + " END"


def shown(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%d %H:%M:%S')"


CTES: dict[str, tuple[list[str], str]] = {}

CTES["words"] = ([], r"SELECT doc_id, source, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents")
CTES["postings"] = (["words"], f"""
SELECT doc_id AS seq, source, {items(v.BOARDS)}[1 + doc_id % 5] AS board, array_to_string(w[1:3], ' ') AS title,
  CASE WHEN len(w) < 4 THEN '' ELSE w[4] || CASE doc_id % 3 WHEN 0 THEN ' LLC' WHEN 1 THEN ', Inc.' ELSE '' END END AS company,
  'https://' || CASE WHEN doc_id % 2 = 0 THEN 'www.' ELSE '' END || 'boards.example.org/jobs/'
    || (CASE WHEN doc_id % 10 = 9 THEN doc_id - 5 ELSE doc_id END)::VARCHAR || '/?utm_source=x' AS url,
  {items(v.LOCATIONS)}[1 + doc_id % 6] AS location,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id % 720) END AS posted,
  CASE WHEN doc_id % 3 = 1 AND doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id % 720) END AS relisted,
  CASE WHEN doc_id % 3 = 2 AND doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id % 720) END AS updated,
  text
FROM words""")
CTES["normed"] = (["postings"], f"SELECT *, {norm_title('title')} AS title_norm, string_split({norm_title('company')}, ' ') AS ct FROM postings")
CTES["keyed"] = (["normed"], f"""
SELECT * EXCLUDE (ct, cn, uk), coalesce(nullif(cn, ''), uk) || '::' || title_norm AS id,
  coalesce(nullif(split_part(cn, ' ', 1), ''), uk) || '::' || {canonical_tokens('title_norm')} AS canonical
FROM (SELECT *, {named_company('ct')} AS cn, {url_key('url')} AS uk, {link_key('url')} AS link FROM normed)""")
CTES["seen"] = (["keyed"], """
SELECT id AS key, TIMESTAMP '2024-01-31' - to_days((seq % 150)::INT) AS last_seen FROM keyed WHERE seq % 7 = 0
UNION ALL SELECT 'repost:' || link, TIMESTAMP '2024-01-31' - to_days((seq % 150)::INT) FROM keyed WHERE seq % 35 = 0""")
CTES["live_seen"] = (["seen"], f"SELECT key, max(last_seen) AS last_seen FROM seen GROUP BY key HAVING max(last_seen) >= TIMESTAMP '{v.NOW}' - INTERVAL {fixed.SEEN_TTL_DAYS} DAY")
CTES["packages"] = (["keyed"], """
SELECT 'pkg-' || seq AS file, seq, source, board, url, canonical, id, link, title, company, location,
  TIMESTAMP '2023-11-01' + to_hours(seq * 7 % 1500) AS generated, (seq % 3)::INT AS reposts, seq % 20 = 1 AS archived, seq % 10 = 1 AS closed,
  (seq % 47)::INT AS score, CASE WHEN seq % 3 <> 0 THEN (seq % 101)::INT END AS llm_score, CASE WHEN seq % 4 = 1 THEN 'borderline' END AS tier
FROM keyed WHERE seq % 5 = 1""")
CTES["package_links"] = (["packages"], """
SELECT link, arg_min(file, seq) AS file FROM (
  SELECT link, file, seq FROM packages WHERE NOT archived
  UNION ALL SELECT 'boards.example.org/jobs/' || (seq + 2), file, seq FROM packages WHERE NOT archived)
WHERE link <> '' GROUP BY link""")
CTES["verdicts"] = ([], "SELECT doc_id AS seq, (quality * 60 + doc_id % 40)::INT AS llm_score, toxic = 1 AS suspect FROM labels")
CTES["scored"] = (["keyed"], scored("(SELECT *, lower(text) AS hay FROM keyed)"))
CTES["repost_hits"] = (["keyed", "packages"], """
SELECT j.seq, arg_max(struct_pack(file := p.file, url := p.url, source := p.source, generated := p.generated, reposts := p.reposts),
  struct_pack(g := p.generated, n := -p.seq)) AS best
FROM keyed j JOIN packages p ON p.canonical = j.canonical AND p.source = j.source AND p.closed AND p.url <> j.url AND p.link <> j.link
GROUP BY j.seq""")
CTES["reposts"] = (["repost_hits", "keyed", "packages"], """
SELECT h.seq, h.best.file AS repost_file, h.best.url AS repost_url, h.best.reposts + 1 AS reposts
FROM repost_hits h JOIN keyed j USING (seq)
WHERE NOT EXISTS (SELECT 1 FROM packages p WHERE p.canonical = j.canonical AND p.source = h.best.source AND NOT p.closed AND p.generated > h.best.generated)""")
CTES["fresh"] = (["reposts", "keyed", "live_seen"], """
SELECT r.* FROM reposts r JOIN keyed j USING (seq) WHERE j.link <> '' AND 'repost:' || j.link NOT IN (SELECT key FROM live_seen)""")
CTES["gated"] = (["scored", "fresh", "live_seen", "packages", "package_links"], f"""
SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN score < {v.MIN_SCORE} THEN 'low' ELSE 'match' END AS kind,
  early IS NULL OR early = 'excluded' AS considered, early IS NULL AND length(text) < {fixed.SHORT_TEXT} AS retry
FROM (SELECT s.*, f.repost_file, CASE
    WHEN f.seq IS NULL AND EXISTS (SELECT 1 FROM live_seen z WHERE z.key = s.id OR z.key = trim(regexp_replace(regexp_replace(s.id, '[+#]+', ' ', 'g'), '\\s+', ' ', 'g'))) THEN 'seen'
    WHEN EXISTS (SELECT 1 FROM packages p WHERE NOT p.archived AND p.canonical = s.canonical AND p.source = s.source AND p.url = s.url) THEN 'packaged'
    WHEN s.link <> '' AND EXISTS (SELECT 1 FROM package_links l WHERE l.link = s.link) THEN 'packaged'
    WHEN EXISTS (SELECT 1 FROM packages p WHERE NOT p.archived AND p.canonical = s.canonical AND p.source <> s.source) THEN 'dup'
    WHEN {excluded_term('s.title')} IS NOT NULL THEN 'excluded' END AS early
  FROM scored s LEFT JOIN fresh f ON f.seq = s.seq)""")

# ---- orders -------------------------------------------------------------------
CTES["listings"] = ([], f"""
SELECT *, CASE WHEN source = 'dou' THEN 'https://jobs.dou.ua/vacancies/' || seq
    WHEN source = 'djinni' OR (source = 'tgchannels' AND seq % 2 = 0) THEN 'https://djinni.co/jobs/' || seq
    WHEN source = 'himalayas' THEN 'https://himalayas.app/jobs/' || seq
    WHEN source = 'tgchannels' THEN 'https://t.me/channel/' || seq
    ELSE 'https://www.linkedin.com/jobs/view/' || seq END AS url,
  CASE WHEN source = 'dou' THEN 'dou' WHEN source = 'djinni' OR (source = 'tgchannels' AND seq % 2 = 0) THEN 'djinni' WHEN source = 'linkedin' THEN 'linkedin' END AS probe_board
FROM (SELECT o_orderkey AS seq, 'pkg-' || o_orderkey AS file, {items(v.BOARDS)}[left(o_orderpriority, 1)::INT] AS source, o_custkey, o_orderstatus, o_totalprice,
  'cust-' || o_custkey AS canonical, o_orderdate AS generated, o_orderstatus = 'F' AS closed, o_orderkey % 8 = 0 AS archived,
  CASE WHEN o_orderkey % 9 = 0 THEN 'borderline' END AS tier, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 16 = 0 THEN o_orderdate END AS closed_at,
  (o_orderkey % 4)::INT AS reposts FROM orders)""")
CTES["job_state"] = (["listings"], """
SELECT url, CASE WHEN closed THEN 'closed' ELSE 'viewed' END AS status, CASE WHEN seq % 13 = 0 THEN 'call back' END AS note,
  CASE WHEN seq % 17 <> 0 THEN generated + to_days((seq % 40)::INT) END AS updated_at
FROM listings WHERE o_orderstatus <> 'O'""")
CTES["probes"] = (["listings"], """
SELECT url, max(l_shipdate) AS checked_at, max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS tried_at,
  min(CASE WHEN l_returnflag = 'A' THEN l_shipdate END) AS gone_at
FROM lineitem JOIN listings ON seq = l_orderkey GROUP BY url""")

# ---- events -------------------------------------------------------------------
CTES["per_run"] = ([], """
SELECT event_type, make_timestamp((epoch_us(ts) // 10800000000) * 10800000000) AS run, count(*) AS found, count(*) FILTER (value > 300) AS rare
FROM events GROUP BY 1, 2""")
CTES["source_counts"] = (["per_run"], "SELECT event_type AS source, run, found FROM per_run UNION ALL SELECT event_type || '-rare', run, rare FROM per_run")
CTES["run_stats"] = ([], """
SELECT date_trunc('day', ts) AS stamp, count(*) AS considered, count(*) FILTER (event_type = 'purchase') AS written, count(*) FILTER (event_type = 'signup') AS borderline,
  count(*) FILTER (event_type = 'click') AS dropped, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS llm_calls,
  (sum(floor(value * 100)::BIGINT)::BIGINT // 100) AS llm_ms
FROM events GROUP BY 1""")
CTES["beats"] = ([], "SELECT event_id AS seq, 'job-' || user_id AS job, ts AS stamp FROM events")
CTES["messages"] = ([], "SELECT conv_id AS thread, turn AS pos, role = 'user' AS incoming, text FROM conversations")


def sql(select: str, *names: str, recursive: str = "", **extra: str) -> str:
    """``select`` over the named views and what they need; ``extra`` adds views of its own, ``recursive`` raw ones."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in CTES[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + ([recursive] if recursive else [])
    parts += [f"{n} AS ({body})" for n, body in extra.items()]
    if not parts:
        return select
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " " + select
