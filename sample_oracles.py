"""The same results in plain SQL over whole tables, for DuckDB."""

from __future__ import annotations

import sample_views as V
from digestry import rules

P = V.SETTINGS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _hits(words, text="txt") -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {_text(w.lower())}) AS BIGINT)" for w in words) + ")"


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)


LINK_PATTERN = r"bit\.ly|utm_|affiliate"
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

ITEMS = f"""
ev AS (
  SELECT user_id AS u,
    CAST(SUM(CASE WHEN event_type='view' THEN FLOOR(value*100) ELSE 0 END) AS BIGINT) AS v,
    CAST(SUM(CASE WHEN event_type='click' THEN FLOOR(value*20) ELSE 0 END) AS BIGINT) AS l,
    CAST(SUM(CASE WHEN event_type='purchase' THEN FLOOR(value*2) ELSE 0 END) AS BIGINT) AS c
  FROM events GROUP BY user_id),
items AS (
  SELECT doc_id // 100 AS brief_id, doc_id // 100 AS user_id, doc_id AS ord, CAST(doc_id AS VARCHAR) AS item_id,
    CASE WHEN doc_id % 2 = 0 THEN 'YouTube' ELSE 'RSS' END AS kind, source AS channel,
    CASE lang WHEN 'en' THEN 'AI' WHEN 'fr' THEN '芯片' WHEN 'de' THEN '机器人' ELSE 'other' END AS domain,
    split_part(split_part(text, chr(10), 1), '. ', 1) AS title,
    substring(text, 1, 2000) AS description,
    CASE WHEN doc_id % 29 > 0 THEN {AS_OF} - to_hours((doc_id * 7) % 48) END AS published_at,
    'PT' || (doc_id % 17) || 'M' || (doc_id % 60) || 'S' AS duration,
    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'high' WHEN doc_id % 3 = 1 THEN 'medium' ELSE 'low' END
      AS authority,
    (coalesce(v, 0) * (doc_id % 13)) // 50 AS views,
    (coalesce(l, 0) * (CASE WHEN doc_id % 11 < 4 THEN 4 ELSE 150 END) * (doc_id % 11)) // 1000 AS likes,
    (coalesce(c, 0) * 3 * (doc_id % 11)) // 100 AS comments,
    'https://example.com/a/' || doc_id AS url, lang,
    lower(split_part(split_part(text, chr(10), 1), '. ', 1) || ' ' || substring(text, 1, 2000)) AS txt
  FROM documents LEFT JOIN ev ON ev.u = doc_id // 8)"""

REACTIONS = """
fb AS (
  SELECT event_id AS event_ord, user_id, 'i' || (event_id % 40) AS item_id,
    CASE event_type WHEN 'click' THEN 'like' ELSE 'dislike' END AS reaction,
    'title ' || (event_id % 40) || ' & more/é' AS title,
    CASE WHEN event_id % 13 = 0 THEN '' ELSE 'src' || (event_id % 20) END AS channel,
    CASE event_id % 4 WHEN 0 THEN 'AI' WHEN 1 THEN '芯片' WHEN 2 THEN '机器人' ELSE '' END AS domain
  FROM events WHERE event_type IN ('click', 'error'))"""


def _weights(key: str) -> str:
    return (f"SELECT user_id, {key}, CAST(SUM(CASE reaction WHEN 'like' THEN 1 ELSE -2 END) AS BIGINT) AS weight "
            f"FROM fb WHERE {key} <> '' GROUP BY user_id, {key}")


COMPONENTS = {
    "credibility": f"CASE WHEN list_contains({_list(P.whitelist)}, channel) THEN 25 WHEN views > 10000 THEN 15 "
                   "ELSE 5 END",
    "length": "CASE WHEN kind = 'YouTube' THEN CASE WHEN ord % 17 >= 10 THEN 15 WHEN ord % 17 >= 5 THEN 10 "
              "WHEN ord % 17 >= 2 THEN 5 ELSE 0 END "
              "ELSE CASE WHEN length(description) >= 1000 THEN 15 WHEN length(description) >= 500 THEN 10 "
              "WHEN length(description) >= 200 THEN 5 ELSE 0 END END",
    "engagement": "CASE WHEN kind = 'RSS' THEN CASE coalesce(authority, 'medium') WHEN 'high' THEN 15 "
                  "WHEN 'medium' THEN 10 ELSE 3 END "
                  "WHEN likes + 2 * comments > 5000 THEN 20 WHEN likes + 2 * comments > 1000 THEN 15 "
                  "WHEN likes + 2 * comments > 100 THEN 10 ELSE 3 END",
    "relevance": f"least(5 * {_hits(P.all_keywords)}, 20)",
    "recency": "CASE WHEN published_at IS NULL THEN 3 WHEN (ord * 7) % 48 < 6 THEN 10 WHEN (ord * 7) % 48 < 12 THEN 7 "
               "WHEN (ord * 7) % 48 < 24 THEN 5 ELSE 0 END",
    "spam": f"least(15 * {_hits(P.spam_keywords)}, 45) + "
            f"CASE WHEN regexp_matches(txt, '{LINK_PATTERN}') THEN 15 ELSE 0 END",
}
BASE = " + ".join(f"({COMPONENTS[k]})" for k in COMPONENTS if k != "spam") + f" - ({COMPONENTS['spam']})"
PREFERENCE = "3 * coalesce(sw.weight, 0) + 2 * coalesce(dw.weight, 0)"

PREFS = f"sw AS ({_weights('channel')}),\ndw AS ({_weights('domain')})"
JOIN_PREFS = ("items i LEFT JOIN sw ON sw.user_id = i.user_id AND sw.channel = i.channel "
              "LEFT JOIN dw ON dw.user_id = i.user_id AND dw.domain = i.domain")
SCORED = f"""
rated AS (SELECT *, CAST({BASE} AS BIGINT) AS base FROM items),
scored AS (
  SELECT i.*, greatest(i.base + {PREFERENCE}, 0) AS quality_score
  FROM {JOIN_PREFS.replace('items i', 'rated i')})"""
TO_SCORED = f"{ITEMS},\n{REACTIONS},\n{PREFS},\n{SCORED}"

TOKENS = r"list_sort(list_distinct(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')))"
SIMILAR = "2 * len(list_intersect({a}, {b})) > least(len({a}), len({b}))"


def _walks(source: str) -> str:
    """`kept` per briefing after the greedy walk over `source`, and the capped selection over it."""
    similar = SIMILAR.format(a="k.w", b="c.w")
    return f"""
cand AS (SELECT *, {TOKENS} AS w,
    row_number() OVER (PARTITION BY brief_id ORDER BY quality_score DESC, ord) AS rn FROM {source}),
walk(brief_id, rn, kept) AS (
  SELECT DISTINCT brief_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(o BIGINT, w VARCHAR[])[]) FROM cand
  UNION ALL
  SELECT c.brief_id, c.rn, CASE WHEN len(list_filter(walk.kept, lambda k: {similar})) > 0 THEN walk.kept
    ELSE list_append(walk.kept, {{'o': c.ord, 'w': c.w}}) END
  FROM walk JOIN cand c ON c.brief_id = walk.brief_id AND c.rn = walk.rn + 1),
final AS (SELECT brief_id, max_by(kept, rn) AS kept FROM walk GROUP BY brief_id),
uniq AS (SELECT c.* FROM cand c JOIN (SELECT brief_id, unnest(kept).o AS ord FROM final) f USING (brief_id, ord))"""


def _picks(source: str) -> str:
    return f"""
line AS (SELECT brief_id, ord, coalesce(domain, 'other') AS d, coalesce(channel, '') AS ch,
    row_number() OVER (PARTITION BY brief_id ORDER BY quality_score DESC, ord) AS p FROM {source}),
choose(brief_id, p, taken) AS (
  SELECT DISTINCT brief_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(o BIGINT, d VARCHAR, ch VARCHAR)[]) FROM line
  UNION ALL
  SELECT c.brief_id, c.p, CASE WHEN len(taken) < {P.total}
      AND len(list_filter(taken, lambda t: t.d = c.d)) < {P.per_domain}
      AND len(list_filter(taken, lambda t: t.ch = c.ch)) < {P.per_channel}
    THEN list_append(taken, {{'o': c.ord, 'd': c.d, 'ch': c.ch}}) ELSE taken END
  FROM choose JOIN line c ON c.brief_id = choose.brief_id AND c.p = choose.p + 1),
chosen AS (SELECT brief_id, max_by(taken, p) AS taken FROM choose GROUP BY brief_id),
picked AS (
  SELECT s.*, t.pick FROM scored s JOIN (
    SELECT brief_id, unnest(taken).o AS ord, generate_subscripts(taken, 1) AS pick FROM chosen) t USING (brief_id, ord))"""


# The flagship: threshold with fallback, greedy titles, caps.
PASSING = f"""
passing AS (
  SELECT * FROM (SELECT *, max(quality_score) OVER (PARTITION BY brief_id) AS best FROM scored)
  WHERE quality_score >= CASE WHEN best >= {P.threshold} THEN {P.threshold} ELSE {P.fallback_threshold} END)"""
ABOVE = f"above AS (SELECT * FROM scored WHERE quality_score >= {P.threshold})"
CURATED = f"{TO_SCORED},\n{PASSING},\n{_walks('passing')},\n{_picks('uniq')}"

RAW = """CASE doc_id % 3 WHEN 0 THEN '摘要： ' || headline || chr(10) || 'Why it matters：: ' || lang || '  '
  WHEN 1 THEN headline END"""
RESPONSES = f"""
resp AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, doc_id % 3 AS way, headline, lang, description, {RAW} AS raw
  FROM (SELECT *, split_part(split_part(text, chr(10), 1), '. ', 1) AS headline,
    substring(text, 1, 2000) AS description FROM documents))"""
_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]+"
_SUMMARY = f"regexp_replace(regexp_replace(headline, '^{_BLANK}', ''), '{_BLANK}$', '')"
SUMMARY = f"CASE way WHEN 0 THEN {_SUMMARY} WHEN 1 THEN headline ELSE substring(description, 1, 200) END"
WHY = "CASE way WHEN 0 THEN lang ELSE '' END"

LABEL = "(ord % 17) || ' 分钟'"
SOURCE_LINE = (f"CASE kind WHEN 'YouTube' THEN '📺 YouTube · ' || channel || ' · ' || {LABEL} "
               "ELSE '📝 ' || channel END")
LINK = "CASE kind WHEN 'YouTube' THEN '观看原视频' ELSE '阅读原文' END"
ICON = "CASE domain " + " ".join(f"WHEN '{d}' THEN '{i}'" for d, i in rules.DOMAIN_ICONS) + " END"
POSITION = "CASE domain " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(P.domains, 1)) + " END"
RATE = "CASE WHEN collected > 0 THEN printf('%.1f', CAST(selected AS DOUBLE) / collected * 100) ELSE '0' END"

DOCS = f"""
{RESPONSES},
placed AS (
  SELECT p.*, r.summary, r.why, {POSITION} AS domain_ord
  FROM picked p JOIN (SELECT item_id, {SUMMARY} AS summary, {WHY} AS why FROM resp) r USING (item_id)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY brief_id ORDER BY domain_ord, pick) AS number,
    count(*) OVER (PARTITION BY brief_id, domain) AS domain_count
  FROM placed WHERE domain_ord IS NOT NULL),
counts AS (
  SELECT brief_id, count(*) AS collected, coalesce(any_value(n), 0) AS selected
  FROM items LEFT JOIN (SELECT brief_id, count(*) AS n FROM picked GROUP BY brief_id) USING (brief_id)
  GROUP BY brief_id),
pieces AS (
  SELECT brief_id, 0 AS a, 0 AS b, 0 AS c, '# {rules.REPORT_NAME} — 2024.01.31（周三）' || chr(10) || chr(10)
    || '> 今日共采集 ' || collected || ' 条内容，精选 ' || selected || ' 条高质量信息。' || chr(10) || chr(10)
    || '---' || chr(10) AS t FROM counts
  UNION ALL SELECT DISTINCT brief_id, domain_ord, 0, 0,
    '## ' || {ICON} || ' ' || domain || '领域（' || domain_count || ' 条）' || chr(10) FROM numbered
  UNION ALL SELECT brief_id, domain_ord, 1, number, '### ' || number || '. ' || title || chr(10) || {SOURCE_LINE}
    || chr(10) || summary || CASE WHEN why <> '' THEN chr(10) || '💡 **Why it matters**: ' || why ELSE '' END
    || chr(10) || '🔗 [' || {LINK} || '](' || url || ')' || chr(10) FROM numbered
  UNION ALL SELECT DISTINCT brief_id, domain_ord, 2, 0, '---' || chr(10) FROM numbered
  UNION ALL SELECT brief_id, 9, 0, 0, '📊 **今日数据**：采集 ' || collected || ' 条 → 精选 ' || selected
    || ' 条（入选率 ' || {RATE} || '%）' || chr(10) || '💡 **趋势洞察**：{rules.DEFAULT_TREND}' || chr(10) || chr(10)
    || {" || chr(10) || ".join(_text(line) for line in rules.FOOTER)} FROM counts),
docs AS (SELECT brief_id, string_agg(t, chr(10) ORDER BY a, b, c) AS md FROM pieces GROUP BY brief_id),
lines AS (
  SELECT brief_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line
  FROM (SELECT brief_id, string_split(md, chr(10)) AS l FROM docs))"""
TO_DOCS = f"{CURATED},\n{DOCS}"



def _stripped(value: str) -> str:
    return f"regexp_replace(regexp_replace({value}, '^{_BLANK}', ''), '{_BLANK}$', '')"


PARSED = f"""
listed AS (
  SELECT brief_id, line_no, line, lead(line) OVER (PARTITION BY brief_id ORDER BY line_no) AS nxt,
    last_value(CASE WHEN starts_with(line, '## ') AND contains(line, '领域') THEN
      CASE WHEN contains(line, 'AI') THEN 'AI' WHEN contains(line, '芯片') THEN '芯片'
           WHEN contains(line, '机器人') THEN '机器人' END END IGNORE NULLS)
      OVER (PARTITION BY brief_id ORDER BY line_no) AS domain
  FROM lines),
headed AS (SELECT *, {_stripped("regexp_replace(line, '^[# ]+', '')")} AS heading
  FROM listed WHERE starts_with(line, '### ')),
parsed AS (
  SELECT brief_id, row_number() OVER (PARTITION BY brief_id ORDER BY line_no) AS number,
    CASE WHEN contains(heading, '. ') THEN substring(heading, instr(heading, '. ') + 2) ELSE heading END AS title,
    CASE WHEN contains(coalesce(nxt, ''), '·') THEN trim(split_part(nxt, '·', 2)) ELSE '' END AS channel,
    coalesce(domain, '') AS domain
  FROM headed)"""

ENCODED = ("replace(replace(replace(url_encode(substring(regexp_replace(title, '^\\d+\\.\\s*', ''), 1, 50)), "
           "'%2F', '/'), '%7E', '~'), '+', '%20')")
_LINK_OF = "'{base}/feedback?id=' || {n} || '&r={r}&t=' || " + ENCODED
LIKE_URL = _LINK_OF.format(base=P.feedback_base, n="number", r="like")
DISLIKE_URL = _LINK_OF.format(base=P.feedback_base, n="number", r="dislike")

CARD = f"""
stripped AS (SELECT brief_id, line_no, {_stripped('line')} AS s FROM lines),
marked AS (
  SELECT *, (s = '' OR starts_with(s, '##') OR s = '---') AS mark FROM stripped),
blocks AS (SELECT *, sum(CAST(mark AS INT)) OVER (PARTITION BY brief_id ORDER BY line_no) AS blk FROM marked),
opened AS (SELECT *, first_value(s) OVER (PARTITION BY brief_id, blk ORDER BY line_no) AS head FROM blocks),
joined AS (
  SELECT brief_id, min(line_no) AS line_no, 'item' AS kind, string_agg(
      CASE WHEN mark THEN '**' || regexp_replace(s, '^[# ]+', '') || '**' ELSE s END, chr(10) ORDER BY line_no) AS t,
    regexp_replace(any_value(head), '^[# ]+', '') AS title
  FROM opened WHERE starts_with(head, '### ') GROUP BY brief_id, blk
  UNION ALL
  SELECT brief_id, line_no, CASE WHEN s = '---' THEN 'hr' WHEN starts_with(s, '> ') THEN 'note'
      WHEN starts_with(s, '## ') THEN 'heading' ELSE 'text' END,
    CASE WHEN s = '---' THEN NULL WHEN starts_with(s, '> ') THEN regexp_replace(s, '^[> ]+', '')
      WHEN starts_with(s, '## ') THEN '**' || regexp_replace(s, '^[# ]+', '') || '**' ELSE s END, NULL
  FROM opened WHERE NOT starts_with(head, '### ') AND s <> '' AND NOT starts_with(s, '# ')),
counted AS (SELECT *, row_number() OVER (PARTITION BY brief_id, kind ORDER BY line_no) AS number FROM joined),
elements AS (
  SELECT brief_id, line_no, 0 AS sub, CASE WHEN kind IN ('hr', 'note') THEN kind ELSE 'markdown' END AS tag,
    t AS content, NULL AS like_url, NULL AS dislike_url FROM counted
  UNION ALL SELECT brief_id, line_no, 1, 'action', NULL, {LIKE_URL}, {DISLIKE_URL} FROM counted WHERE kind = 'item'
  UNION ALL SELECT brief_id, 1000000000, 0, 'hr', NULL, NULL, NULL FROM docs
  UNION ALL SELECT brief_id, 1000000000, 1, 'note', '{rules.CARD_NOTE}', NULL, NULL FROM docs)"""

SUBSCRIBED = "CASE channel " + " ".join(f"WHEN '{c}' THEN '{d}'" for c, d in P.channels) + " END"
NEWEST = f"""
subscribed AS (
  SELECT channel, item_id, ord, {SUBSCRIBED} AS domain, published_at FROM (
    SELECT *, row_number() OVER (PARTITION BY channel ORDER BY published_at DESC NULLS LAST, ord) AS n
    FROM items WHERE {SUBSCRIBED} IS NOT NULL)
  WHERE n <= 5 AND published_at >= {AS_OF} - INTERVAL 1 DAY)"""
_WORDS = [(d, k) for d, group in P.search_keywords for k in group]
FOUND = f"""
words(keyword_ord, domain, keyword) AS (VALUES {", ".join(f"({i}, '{d}', '{k}')" for i, (d, k) in enumerate(_WORDS))}),
found AS (
  SELECT keyword, domain, keyword_ord, item_id, occurrences,
    row_number() OVER (PARTITION BY keyword_ord ORDER BY occurrences DESC, published_at DESC, ord) AS place
  FROM (SELECT w.*, item_id, published_at, ord,
      CAST((length(txt) - length(replace(txt, keyword, ''))) // length(keyword) AS BIGINT) AS occurrences
    FROM items JOIN words w ON contains(txt, keyword) WHERE published_at >= {AS_OF} - INTERVAL 1 DAY))"""

# RE2 and Java name the characters XML can carry in the same way here.
_PLAIN = r"trim(replace(regexp_replace({x}, '[^\x20-\x7E\x{{A1}}-\x{{D7FF}}]+', ' ', 'g'), '<', '('))"


def _classified(allowed: str, text: str) -> str:
    """Most hits among the allowed domains, earliest configured first, else the first allowed."""
    by = [f"CASE WHEN list_contains({allowed}, '{d}') THEN {_hits(w, text)} ELSE 0 END" for d, w in P.domain_keywords]
    top = f"greatest({', '.join(by)})"
    cases = " ".join(f"WHEN {top} > 0 AND {n} = {top} THEN '{d}'" for (d, _), n in zip(P.domain_keywords, by))
    return f"CASE {cases} ELSE {allowed}[1] END"


ORACLES: dict[str, str] = {
    "ingest_flatten": f"""{_with(ITEMS)}
SELECT item_id, 'YouTube' AS kind, channel, title, description, CAST(epoch(published_at) AS BIGINT) AS published_at,
  CASE WHEN ord % 5 > 0 THEN views ELSE 0 END AS views,
  CASE WHEN ord % 5 > 0 AND ord % 4 > 0 THEN likes ELSE 0 END AS likes,
  CASE WHEN ord % 5 > 0 THEN comments ELSE 0 END AS comments,
  duration, 'https://youtube.com/watch?v=' || item_id AS url FROM items""",
    "latest_per_channel": f"""{_with(ITEMS, NEWEST)}
SELECT channel, item_id, ord, domain, CAST(epoch(published_at) AS BIGINT) AS published_at FROM subscribed""",
    "keyword_topk": f"""{_with(ITEMS, FOUND)}
SELECT keyword, domain, place, item_id, occurrences FROM found WHERE place <= 5""",
    "first_by_id": f"""{_with(ITEMS, NEWEST, FOUND)}
SELECT item_id, domain, mode FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY mode, keyword_ord, o) AS n FROM (
    SELECT item_id, domain, CAST(0 AS BIGINT) AS mode, 0 AS keyword_ord, ord AS o FROM subscribed
    UNION ALL SELECT item_id, domain, 1, keyword_ord, place FROM found WHERE place <= 5)) WHERE n = 1""",
    "transcript_join": """
WITH s AS (
  SELECT conv_id AS video_id, turn, text, CASE role
    WHEN 'user' THEN CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 3 END
    WHEN 'assistant' THEN CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END END AS pref FROM conversations),
t AS (SELECT video_id, pref, substring(string_agg(text, ' ' ORDER BY turn), 1, 3000) AS transcript FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id, pref ORDER BY turn) AS n FROM s WHERE pref IS NOT NULL)
  WHERE n <= 200 GROUP BY video_id, pref)
SELECT v.video_id, coalesce(b.transcript, '') AS transcript FROM (SELECT DISTINCT video_id FROM s) v
LEFT JOIN (SELECT video_id, min_by(transcript, pref) AS transcript FROM t GROUP BY video_id) b USING (video_id)""",
    "feed_entries": f"""{_with(ITEMS)},
e AS (
  SELECT *, channel || '/' || (ord // 500) AS feed,
    {_PLAIN.format(x='title')} AS ti, {_PLAIN.format(x='description')} AS de,
    row_number() OVER (PARTITION BY channel, ord // 500 ORDER BY ord) - 1 AS entry_no FROM items),
f AS (
  SELECT *, substring(regexp_replace('x ' || de, '<[^>]+>', '', 'g'), 1, 2000) AS body,
    CASE length(feed) % 3 WHEN 0 THEN ['AI', '芯片', '机器人'] WHEN 1 THEN ['机器人', 'AI'] ELSE ['芯片'] END AS allowed
  FROM e WHERE entry_no < 20 AND (published_at IS NULL OR published_at >= {AS_OF} - INTERVAL 1 DAY)),
g AS (SELECT *, lower(ti || ' ' || body) AS t FROM f)
SELECT feed AS channel, entry_no,
  CASE WHEN ord % 3 > 0 THEN 'g' || item_id WHEN ord % 6 > 0 THEN url ELSE ti END AS item_id,
  ti AS title, body AS description, {_classified('allowed', 't')} AS domain,
  CASE WHEN ord % 6 > 0 THEN url ELSE '' END AS url, 'high' AS authority,
  CAST(epoch(published_at) AS BIGINT) AS published_at FROM g""",
    "strip_tags": "SELECT page_id, substring(regexp_replace(html, '<[^>]+>', '', 'g'), 1, 2000) AS body FROM pages",
    "script_normalised": "SELECT doc_id, CASE WHEN lang = 'de' THEN translate(text, 'äöüéè', 'aouee') ELSE text END "
                         "AS text FROM documents",
    "multi_source_union": f"""{_with(ITEMS)}
SELECT CAST(CASE kind WHEN 'YouTube' THEN 0 ELSE 1 END AS BIGINT) AS source_no, ord, item_id, kind,
  CASE kind WHEN 'RSS' THEN authority END AS authority, CASE kind WHEN 'YouTube' THEN duration END AS duration
FROM items""",
    "classify_domain": f"""{_with(ITEMS)}
SELECT item_id, {_classified('allowed', 'txt')} AS domain FROM (
  SELECT *, CASE ord % 5 WHEN 0 THEN ['芯片', 'AI'] WHEN 1 THEN ['AI', '芯片', '机器人'] WHEN 2 THEN ['机器人']
    WHEN 3 THEN ['机器人', 'AI'] ELSE ['AI', '芯片', '机器人'] END AS allowed FROM items)""",
    "keyword_hits": f"{_with(ITEMS)} SELECT item_id, {_hits(P.all_keywords)} AS hits FROM items",
    "duration_minutes": f"""{_with(ITEMS)}
SELECT item_id, (ord % 17) * 60 + ord % 60 AS seconds, {LABEL} AS label FROM items""",
    "tracking_links": f"SELECT page_id, regexp_matches(url, '{LINK_PATTERN}') AS tracked FROM pages",
    "score_feedback": f"""{_with(ITEMS, REACTIONS, PREFS)}
SELECT i.item_id, {PREFERENCE} AS points FROM {JOIN_PREFS}""",
    "quality_score": f"{_with(TO_SCORED)} SELECT brief_id, ord, item_id, quality_score FROM scored",
    "threshold_filter": f"{_with(TO_SCORED, ABOVE)} SELECT brief_id, ord, item_id, quality_score FROM above",
    "threshold_fallback": f"""{_with(TO_SCORED)}
SELECT brief_id, ord, item_id, quality_score, threshold_used FROM (
  SELECT *, CAST(CASE WHEN max(quality_score) OVER (PARTITION BY brief_id) >= 70 THEN 70 ELSE 40 END AS BIGINT)
    AS threshold_used FROM scored) WHERE quality_score >= threshold_used""",
    "ranked_items": f"""{_with(TO_SCORED, ABOVE)}
SELECT brief_id, ord, item_id, quality_score,
  row_number() OVER (PARTITION BY brief_id ORDER BY quality_score DESC, ord) AS rank FROM above""",
    "title_tokens": f"{_with(ITEMS)} SELECT item_id, array_to_string({TOKENS}, ' ') AS words FROM items",
    "similar_title_pairs": f"""{_with(TO_SCORED, ABOVE, _walks('above'), recursive=True)},
kept AS (SELECT brief_id, unnest(kept) AS k FROM final),
hit AS (
  SELECT c.brief_id, c.ord, k.o AS duplicate_of, len(list_intersect(k.w, c.w)) AS shared_words,
    least(len(k.w), len(c.w)) AS smaller_words,
    row_number() OVER (PARTITION BY c.brief_id, c.ord ORDER BY o.rn) AS n
  FROM cand c JOIN kept USING (brief_id) JOIN cand o ON o.brief_id = c.brief_id AND o.ord = k.o
  WHERE o.rn < c.rn AND {SIMILAR.format(a='k.w', b='c.w')})
SELECT brief_id, ord, duplicate_of, shared_words, smaller_words FROM hit WHERE n = 1""",
    "dedup_titles": f"""{_with(TO_SCORED, ABOVE, _walks('above'), recursive=True)}
SELECT brief_id, ord, item_id, quality_score FROM uniq""",
    "capped_topk": f"""{_with(TO_SCORED, ABOVE, _picks('above'), recursive=True)}
SELECT brief_id, ord, item_id, quality_score, pick FROM picked""",
    "funnel_counts": f"""{_with(TO_SCORED, ABOVE, _walks('above'), _picks('uniq'), recursive=True)}
SELECT brief_id, count(*) AS collected, count(*) FILTER (quality_score >= {P.threshold}) AS above_threshold,
  coalesce(any_value(u.n), 0) AS unique_titles, coalesce(any_value(p.n), 0) AS selected
FROM scored LEFT JOIN (SELECT brief_id, count(*) AS n FROM uniq GROUP BY brief_id) u USING (brief_id)
LEFT JOIN (SELECT brief_id, count(*) AS n FROM picked GROUP BY brief_id) p USING (brief_id) GROUP BY brief_id""",
    "curate": f"""{_with(CURATED, recursive=True)}
SELECT brief_id, ord, item_id, quality_score, channel, domain, title, pick FROM picked""",
    "latest_reaction": f"""{_with(REACTIONS)}
SELECT user_id, item_id, event_ord, reaction, title, channel, domain FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY event_ord DESC) AS n FROM fb) WHERE n = 1""",
    "source_weights": f"{_with(REACTIONS)} {_weights('channel')}",
    "domain_weights": f"{_with(REACTIONS)} {_weights('domain')}",
    "feedback_stats": f"""{_with(REACTIONS)}
SELECT user_id, count(*) AS total, count(*) FILTER (reaction = 'like') AS likes,
  count(*) FILTER (reaction = 'dislike') AS dislikes FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY event_ord DESC) AS n FROM fb)
WHERE n = 1 GROUP BY user_id""",
    "feedback_from_log": f"""{_with(REACTIONS)}
SELECT event_ord, user_id, item_id, reaction, CASE WHEN event_ord % 10 = 0 THEN '100%zz' ELSE title END AS title,
  '' AS channel, '' AS domain FROM fb WHERE event_ord % 10 <> 0 OR (event_ord // 10) % 5 = 4""",
    "parse_briefing": f"""{_with(TO_DOCS, PARSED, recursive=True)}
SELECT brief_id, number, title, channel, domain FROM parsed""",
    "reaction_join": f"""{_with(TO_DOCS, PARSED, recursive=True)},
votes AS (SELECT event_id AS event_ord, user_id AS brief_id, event_id % 10 AS number,
  CASE event_type WHEN 'click' THEN 'like' ELSE 'dislike' END AS reaction
  FROM events WHERE event_type IN ('click', 'error'))
SELECT brief_id, number, event_ord, reaction, title, channel, domain, title AS item_id
FROM votes JOIN parsed USING (brief_id, number)""",
    "attach_summaries": f"{_with(RESPONSES)} SELECT item_id, {SUMMARY} AS summary, {WHY} AS why_it_matters FROM resp",
    "parse_responses": f"""{_with(RESPONSES)}
SELECT item_id, {SUMMARY} AS summary, {WHY} AS why_it_matters FROM resp WHERE raw IS NOT NULL""",
    "trend_prompts": f"""{_with(TO_DOCS, recursive=True)}
SELECT brief_id, {_text(rules.TREND_PROMPT.split('{items_summary}')[0])}
  || string_agg('- [' || domain || '] ' || title || ': ' || summary, chr(10) ORDER BY pick)
  || {_text(rules.TREND_PROMPT.split('{items_summary}')[1])} AS prompt FROM placed GROUP BY brief_id""",
    "briefing_sections": f"""{_with(TO_DOCS, recursive=True)}
SELECT brief_id, item_id, domain, CAST(domain_ord AS BIGINT) AS domain_ord, number, domain_count FROM numbered""",
    "source_lines": f"{_with(ITEMS)} SELECT item_id, {SOURCE_LINE} AS source_line, {LINK} AS link_label FROM items",
    "selection_rate": f"""{_with(TO_DOCS, recursive=True)}
SELECT brief_id, collected, selected, {RATE} AS rate FROM counts""",
    "briefing_lines": f"{_with(TO_DOCS, recursive=True)} SELECT brief_id, line_no, line FROM lines",
    "briefing_doc": f"{_with(TO_DOCS, recursive=True)} SELECT brief_id, md FROM docs",
    "briefing_sink": f"{_with(TO_DOCS, recursive=True)} SELECT brief_id, md, '2024-01-31' AS brief_date FROM docs",
    "card_elements": f"""{_with(TO_DOCS, CARD, recursive=True)}
SELECT brief_id, row_number() OVER (PARTITION BY brief_id ORDER BY line_no, sub) AS element_no, tag, content, like_url,
  dislike_url FROM elements""",
    "card_payload_sink": f"""{_with(TO_DOCS, CARD, recursive=True)}
SELECT 'interactive' AS msg_type, '{rules.REPORT_NAME} — 2024.01.31（周三）' AS title, 'blue' AS template,
  count(*) AS elements FROM elements GROUP BY brief_id""",
    "reaction_links": f"""{_with(TO_DOCS, CARD, recursive=True)}
SELECT brief_id, number, {LIKE_URL} AS like_url, {DISLIKE_URL} AS dislike_url FROM counted WHERE kind = 'item'""",
    "reaction_store": f"""{_with(REACTIONS)}
SELECT event_ord, user_id, item_id, reaction, title, channel, domain FROM fb""",
}

for _key, _name in (("score_credibility", "credibility"), ("score_length", "length"),
                    ("score_engagement", "engagement"), ("score_relevance", "relevance"),
                    ("score_recency", "recency"), ("score_spam", "spam")):
    ORACLES[_key] = f"{_with(ITEMS)} SELECT item_id, CAST({COMPONENTS[_name]} AS BIGINT) AS points FROM items"
ORACLES["stream_weights"] = ORACLES["source_weights"]
ORACLES["stream_alerts"] = f"""{_with(TO_SCORED)}
SELECT brief_id, item_id, title, channel, domain, quality_score FROM scored WHERE quality_score >= 55"""
#: All pairs; near-copies are close to each other and to nothing else, so the first of them displaces all others.
ORACLES["embedding_pairs"] = """WITH v AS (
  SELECT vec_id + copy * 1000000 AS vec_id, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + 0.01 * copy * ((vec_id * 31 + (i - 1) * 17) % 7 - 3)) AS e
  FROM embeddings, range(3) r(copy) WHERE copy <= vec_id % 3)
SELECT b.vec_id, coalesce(min(a.vec_id), b.vec_id) AS representative, min(a.vec_id) IS NULL AS kept
FROM v b LEFT JOIN v a ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9 GROUP BY b.vec_id"""
ORACLES["preference_weights"] = f"""{_with(REACTIONS)}
SELECT user_id, CASE WHEN grouping(channel) = 0 THEN 'channel' ELSE 'domain' END AS key, coalesce(channel, domain) AS value,
  CAST(sum(CASE WHEN reaction = 'like' THEN 1 ELSE -2 END) AS BIGINT) AS weight
FROM fb GROUP BY GROUPING SETS ((user_id, channel), (user_id, domain)) HAVING coalesce(channel, domain) <> ''"""
ORACLES["rule_tables"] = f"""{_with(ITEMS)},
found AS (SELECT source, min(lang) AS domain FROM documents GROUP BY source),
newest AS (SELECT domain, published_at FROM (
  SELECT f.domain, published_at, row_number() OVER (PARTITION BY channel ORDER BY published_at DESC NULLS LAST, ord) AS n
  FROM items JOIN found f ON f.source = channel) WHERE n <= 5 AND published_at >= {AS_OF} - INTERVAL 1 DAY)
SELECT 'channels' AS name, count(*) AS rules, CAST(0 AS BIGINT) AS unread FROM found
UNION ALL SELECT 'whitelist', count(*), 1 FROM found
UNION ALL SELECT 'spam_keywords', 0, 1
UNION ALL SELECT 'feeds', 0, 0
UNION ALL SELECT 'domains', 3, 0
UNION ALL SELECT 'videos of ' || domain, count(*), 0 FROM newest GROUP BY domain"""
ORACLES["stream_latest"] = ORACLES["latest_reaction"]


def _prompt() -> str:
    pieces, rest = [], rules.ITEM_PROMPT
    for name, value in (("title", "title"), ("channel", "channel"), ("description", "substring(description, 1, 1000)"),
                        ("transcript", "''")):
        before, rest = rest.split("{" + name + "}")
        pieces += [_text(before), value]
    return " || ".join([*pieces, _text(rest)])


ORACLES["prompt_table"] = f"{_with(ITEMS)} SELECT item_id, {_prompt()} AS prompt FROM items"

# Large briefings: the same rules over one briefing per language.
LARGE = (TO_SCORED.replace("\nscored AS (", "\nscored_small AS (")
         + ",\nscored AS (SELECT * REPLACE (CAST(CASE domain WHEN 'AI' THEN 0 WHEN '芯片' THEN 1 WHEN '机器人' THEN 2 ELSE 3 END AS BIGINT) AS brief_id) FROM scored_small)")
ORACLES["ranked_large"] = f"""{_with(LARGE, ABOVE)}
SELECT brief_id, ord, item_id, quality_score, row_number() OVER (PARTITION BY brief_id ORDER BY quality_score DESC, ord) AS rank FROM above"""
ORACLES["dedup_titles_large"] = f"""{_with(LARGE, ABOVE, _walks('above'), recursive=True)}
SELECT brief_id, ord, item_id, quality_score FROM uniq"""
ORACLES["curate_large"] = f"""{_with(LARGE, PASSING, _walks('passing'), _picks('uniq'), recursive=True)}
SELECT brief_id, ord, item_id, quality_score, channel, domain, title, pick FROM picked"""

ORACLES["landed_rejects"] = """SELECT 'payload' AS kind, doc_id FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT 'feed', doc_id FROM documents WHERE doc_id % 11 = 0"""
ORACLES["feed_forms"] = """SELECT 'g' || doc_id AS item_id, 'T' || doc_id AS title, 'body & ' || doc_id AS description,
  CASE doc_id % 3 WHEN 0 THEN 1706670900 WHEN 1 THEN 1706652900 ELSE 1706649300 END AS published_at FROM documents"""

ORACLES["keyword_weights"] = f"""{_with(REACTIONS)}
SELECT user_id, keyword, CAST(sum(CASE reaction WHEN 'like' THEN 1 ELSE -2 END) AS BIGINT) AS weight
FROM fb JOIN (VALUES ('title 1'), ('title 2'), ('more'), ('É'), ('nothing')) k(keyword) ON contains(lower(title), lower(keyword))
GROUP BY user_id, keyword"""
ORACLES["preference_examples"] = f"""{_with(REACTIONS)},
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY event_ord DESC) AS n FROM fb) WHERE n = 1)
SELECT user_id, reaction, place, item_id, title FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, reaction ORDER BY event_ord DESC) AS place FROM latest) WHERE place <= 5"""
ORACLES["emerging_terms"] = f"""{_with(ITEMS)},
said AS (
  SELECT CAST(epoch(published_at) AS BIGINT) // 43200 AS period, unnest({TOKENS}) AS term FROM items WHERE published_at IS NOT NULL),
counted AS (SELECT period, term, count(*) AS n FROM said GROUP BY period, term)
SELECT c.period, c.term, c.n, coalesce(b.n, 0) AS before FROM counted c LEFT JOIN counted b ON b.term = c.term AND b.period = c.period - 1
WHERE c.n > coalesce(b.n, 0)"""
