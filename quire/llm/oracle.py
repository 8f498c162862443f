"""SQL for those of the text problems that it can express, written over whole tables.

Problems 1, 6 and 8 are decoders and merges over tokens, problem 7 needs Unicode folding and an alignment: none
of them is SQL, and each has a brute-force twin in tests.
"""

from __future__ import annotations

#: White space as the statistics count it.
_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_TAG = r"(?i)</?(?:table|thead|tbody|tr|td|th)\b[^>]*>"
_LEADER = r"\.{4,}|…{2,}"
_CLOSERS = r"""["''”’»)\]]*"""
_ITEM = rf"^{_WS}*(?:[-*•·▪◦–—]|\(?\p{{Nd}}{{1,3}}[.)]|\(?[a-zA-Z][.)]|\[\p{{Nd}}{{1,3}}\]){_WS}"
_VOWELS = "aeiouyäöüáéíóúàèìòùâêîôûëïœæå"


def _left(text: str, pattern: str) -> str:
    """Characters that a pattern takes out."""
    return f"(length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')))"


_STATS = f"""
pages AS (SELECT DISTINCT page_id, regexp_replace(coalesce(content, ''), '\\r\\n?', chr(10), 'g') AS t FROM page_texts),
plain AS (SELECT page_id, t, regexp_replace(t, '{_TAG}', ' ', 'g') AS p FROM pages),
often AS (SELECT list(DISTINCT lower(word)) AS c FROM common_words WHERE word IS NOT NULL),
words AS (SELECT *, regexp_extract_all(p, '[\\p{{L}}\\p{{N}}]+') AS ws FROM plain),
folded AS (SELECT words.*, c, list_transform(ws, lambda w: lower(w)) AS lw FROM words CROSS JOIN often),
visible AS (SELECT page_id, list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{_WS}', '', 'g')) > 0) AS ls FROM pages),
lines AS (
  SELECT page_id, len(ls) AS lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '[.!?:;。！？…]{_CLOSERS}{_WS}*$'))) AS punctuated,
    len(list_filter(ls, lambda x: regexp_matches(x, '{_ITEM}'))) AS items,
    len(list_filter(ls, lambda x: length(x) - length(replace(x, '|', '')) >= 2 OR contains(x, chr(9)) OR regexp_matches(x, ';[^ ]|;$') OR regexp_matches(x, '[^\\s\\p{{Z}},],[^\\s\\p{{Z}},]|,,|,$')
      OR regexp_matches(x, '[^\\s\\p{{Z}}] {{3,}}[^\\s\\p{{Z}}]') OR regexp_matches(x, '{_TAG}'))) AS rows,
    list_sum(list_transform(ls, lambda x: len(regexp_extract_all(x, '{_TAG}')))) AS tags,
    len(list_filter(ls, lambda x: regexp_matches(x, '{_LEADER}'))) AS toc
  FROM visible
), counted AS (
  SELECT page_id, len(ws) AS words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS word_chars, {_left('t', '(' + _WS + ')')} AS spaces, length(t) AS chars,
    length(regexp_replace(regexp_replace(p, '{_LEADER}', ' ', 'g'), '[\\p{{L}}\\p{{N}}|-]|{_WS}', '', 'g')) AS symbols,
    len(list_filter(lw, lambda w: list_contains(c, w))) AS common,
    len(list_filter(ws, lambda w: regexp_full_match(w, '(?i)[0-9a-f]{{2}}|[0-9a-f]{{8}}'))) AS hexes,
    coalesce(list_sum(list_transform(ws, lambda w: CASE WHEN length(w) > 24 THEN length(w) ELSE 0 END)), 0) AS long_chars,
    len(list_filter(list_transform(lw, lambda w, i: list_contains(lw[greatest(1, i - 3):i - 1], w)), lambda x: x)) AS repeats,
    {_left('p', '[' + chr(92) + 'p{L}' + chr(92) + 'p{Nl}' + chr(92) + 'p{No}]')} AS letters, {_left('p', chr(92) + 'p{Nd}')} AS digits, {_left('p', '(?i)[' + _VOWELS + ']')} AS vowels
  FROM folded
), sums AS (SELECT *, chars - spaces AS seen FROM counted JOIN lines USING (page_id)), shares AS (
  SELECT *, word_chars / words AS mean, symbols / seen AS symbol_share, common / words AS common_share FROM sums
), kinds AS (
  SELECT *, CASE
    WHEN seen = 0 THEN NULL
    WHEN words = 0 THEN 'junk'
    WHEN (mean < 1.7 AND symbol_share > 0.15) OR (mean < 2.6 AND symbol_share > 0.25 AND digits < 0.05 * letters) OR symbol_share > 0.4 OR (words > 8 AND repeats > 0.6 * words)
      OR hexes > 0.75 * words OR long_chars > 0.5 * word_chars OR (letters > 20 AND vowels < 0.18 * letters) THEN 'junk'
    WHEN toc >= 0.5 * lines THEN 'list'
    WHEN tags >= 8 AND common_share < 0.235 THEN 'table'
    WHEN items >= 0.5 * lines AND common_share < 0.3 THEN 'list'
    WHEN common_share >= 0.235 THEN 'prose'
    WHEN rows >= 0.5 * lines THEN 'table'
    ELSE 'list' END AS kind FROM shares
)"""

# Problem 4. Regions' latest versions, what their texts' lengths and endings are, and each source's piles of lengths.
_CLOSING = r"""[\p{Pf}\p{Pe}"''’”»)\]]*"""
_MARKER = r"(?:[-*•·–]|\d{1,3}[.)]|\(\d{1,3}\)|[A-Za-z][.)])\s"
_CAPTION = r"(?i)^\s*(?:#|(?:figure|fig|table|abbildung|abb|tabelle|tableau|figura|tabla)\.?\s*\p{Nd})"


def _n(pattern: str, text: str = "w") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_MARKS = rf"""
newest AS (SELECT * FROM regions WHERE task IN ('text', 'table') AND region_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY ingested_at DESC) = 1),
ends AS (SELECT *, regexp_replace(content, '[\t-\r ]+$', '') AS e, regexp_replace(content, chr(65533) || '+$', '') AS w, task = 'table' OR label = 'table' AS tabular FROM newest),
raw AS (
  SELECT *, length(w) AS chars, strlen(w) AS utf8, {_n('[' + chr(92) + 'x{10000}-' + chr(92) + 'x{10FFFF}]')} AS astral, {_n(chr(92) + 'n')} - {_n(chr(92) + 'r' + chr(92) + 'n')} AS newlines,
    {_n('[' + chr(34) + chr(92) * 2 + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 't]')} + 5 * {_n('[' + chr(92) + 'x00-' + chr(92) + 'x08' + chr(92) + 'x0b' + chr(92) + 'x0c' + chr(92) + 'x0e-' + chr(92) + 'x1f]')} AS escapes,
    {_n('[^' + chr(92) + 'x00-' + chr(92) + 'x7f]')} AS wide, {_n('&')} AS amps, {_n('[<>]')} AS angles,
    string_split(e, chr(10))[1] AS first_line, string_split(e, chr(10))[-1] AS last_line FROM ends
), marks AS (
  SELECT region_id, scan_id, page_index, region_index, label, source, tabular, content, content <> '' AS filled,
    [chars, utf8, chars + astral, chars + 4 * amps + 3 * angles, chars + escapes + 5 * wide + 6 * astral, chars + escapes, chars + newlines, utf8 + newlines] AS sizes,
    label IN ('text', 'abstract', 'reference_content', 'vision_footnote', 'vertical_text', 'content') AND task = 'text' AS prose,
    label <> 'content' OR (NOT regexp_matches(e, '{_CAPTION}') AND (regexp_matches(e, '[.!?][\\p{{Pf}}\\p{{Pe}}"'']*\\s+\\S') OR regexp_matches(e, '[,;]$'))) AS sentences,
    ends_with(content, chr(65533)) AS torn, regexp_matches(content, '^\p{{Ll}}') AND NOT regexp_matches(content, '^\p{{Ll}}[.)]\s') AS begins_low, regexp_matches(e, '(?:\.\.\.|…)$') AS dots,
    regexp_matches(e, '[.!?。！？]{_CLOSING}$') AND NOT regexp_matches(e, '(?:^|\s)(?:\p{{Nd}}{{1,3}}|\p{{Lu}})\.$') AS ends_well,
    {_n('[(“«„]', 'e')} > {_n('[)”»“]', 'e')} AS opened, regexp_matches(e, '^\s*{_MARKER}') AND regexp_matches(e, '\n\s*{_MARKER}') AS listed,
    CASE WHEN tabular AND regexp_matches(e, '(?i)^\s*<table') THEN CASE WHEN regexp_matches(e, '(?i)</table>$') THEN 'closed' ELSE 'open' END
      WHEN tabular AND regexp_matches(e, '^\s*\|') AND (NOT ends_with(last_line, '|') OR {_n('[|]', 'last_line')} < {_n('[|]', 'first_line')}) THEN 'open' END AS table_end
  FROM raw
), open AS (
  SELECT *, coalesce(CASE WHEN tabular THEN coalesce(table_end = 'open', false) ELSE prose AND sentences AND NOT listed AND (NOT ends_well OR opened OR dots) END OR torn, false) AS unfinished FROM marks
), long AS (SELECT source, unfinished, torn, content, unnest(sizes) AS n, generate_subscripts(sizes, 1) - 1 AS coding FROM open WHERE filled AND source IS NOT NULL),
hist AS (SELECT source, coding, n, count(*) AS k, count(*) FILTER (unfinished) AS u, count(*) FILTER (torn) AS t, count(DISTINCT content) AS kinds FROM long GROUP BY ALL),
totals AS (SELECT source, sum(k) AS texts FROM hist WHERE coding = 0 GROUP BY source),
near AS (
  SELECT *, CASE WHEN coding IN (1, 7) THEN coalesce(sum(t) OVER (PARTITION BY source, coding ORDER BY n RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS bytes,
    coalesce(sum(k) OVER (PARTITION BY source, coding ORDER BY n RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) + coalesce(sum(k) OVER (PARTITION BY source, coding ORDER BY n RANGE BETWEEN 1 FOLLOWING AND 20 FOLLOWING), 0) AS beside,
    coalesce(sum(k) OVER (PARTITION BY source, coding ORDER BY n RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING), 0) AS beyond FROM hist
), piles AS (
  SELECT source, coding, n, k + bytes AS at_limit, texts, row_number() OVER (PARTITION BY source ORDER BY k + bytes DESC, coding, n DESC) AS r FROM near JOIN totals USING (source)
  WHERE k >= 5 AND k + bytes >= 0.02 * texts AND (k + bytes) * 40 >= 4 * (beside - bytes) AND u + bytes >= 0.5 * (k + bytes) AND kinds >= 4 AND k >= beyond
), queue AS (SELECT source, any_value(texts) AS texts, list(struct_pack(c := coding, n := n, a := at_limit) ORDER BY r) AS q FROM piles GROUP BY source),
walk AS (
  SELECT source, texts, q, 1 AS i, q[1:0] AS kept FROM queue
  UNION ALL
  SELECT source, texts, q, i + 1, CASE WHEN len(list_filter(list_transform(kept, lambda y: abs(y.n - q[i].n) <= CASE WHEN y.c = q[i].c THEN 4 ELSE 0.1 * greatest(y.n, q[i].n) END), lambda x: x)) > 0 THEN kept ELSE list_append(kept, q[i]) END FROM walk WHERE i <= len(q)
), limits AS (SELECT source, texts, unnest(kept) AS l FROM walk WHERE i = len(q) + 1)"""

_CUT = f"""{_MARKS}, begun AS (
  SELECT *, CASE WHEN label = 'text' THEN coalesce(begins_low, false) WHEN label = 'content' AND begins_low THEN true END AS low FROM open
), following AS (
  SELECT *, CASE WHEN scan_id IS NOT NULL THEN last_value(low IGNORE NULLS) OVER (PARTITION BY scan_id ORDER BY page_index DESC, region_index DESC, region_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS next_low FROM begun
), of_source AS (SELECT source, list(l) AS ls FROM limits GROUP BY source),
held AS (
  SELECT f.*, len(list_filter(list_transform(coalesce(ls, []), lambda x: sizes[x.c + 1] <= x.n AND sizes[x.c + 1] >= x.n - CASE WHEN torn THEN 3 ELSE 0 END), lambda x: x)) > 0 AS at_limit,
    len(list_filter(list_transform(coalesce(ls, []), lambda x: sizes[x.c + 1] <= x.n AND sizes[x.c + 1] >= x.n - 3), lambda x: x)) > 0 AS near_limit
  FROM following f LEFT JOIN of_source USING (source) WHERE filled
), told AS (
  SELECT region_id, source, label, CASE
    WHEN torn THEN 'bytes'
    WHEN tabular THEN CASE WHEN table_end = 'open' THEN 'table' WHEN at_limit AND table_end IS DISTINCT FROM 'closed' THEN 'limit' END
    WHEN NOT prose THEN NULL
    WHEN dots AND near_limit THEN 'marked'
    WHEN at_limit AND NOT dots AND (NOT ends_well OR opened) THEN 'limit'
    WHEN listed OR dots OR ends_well OR coalesce(next_low, false) OR NOT sentences THEN NULL
    ELSE 'sentence' END AS reason FROM held
)"""

SQL = {
    "p3_stats": f"""WITH {_STATS.strip()} SELECT page_id, words AS word_count, CASE WHEN words > 0 THEN round(mean, 6) ELSE 0.0::DOUBLE END AS mean_word_length,
      CASE WHEN seen > 0 THEN round(symbol_share, 6) ELSE 0.0::DOUBLE END AS symbol_ratio, CASE WHEN lines > 0 THEN round(punctuated / lines, 6) ELSE 0.0::DOUBLE END AS punctuated_lines,
      CASE WHEN words > 0 THEN round(common_share, 6) ELSE 0.0::DOUBLE END AS common_words, kind FROM kinds""",
    "p3_found": f"WITH {_STATS.strip()} SELECT page_id, kind FROM kinds WHERE kind <> 'prose' AND page_id IS NOT NULL",
    "p4_limits": f"WITH RECURSIVE {_MARKS.strip()} SELECT source, ['chars', 'utf8', 'utf16', 'html', 'json_ascii', 'json', 'crlf', 'utf8_crlf'][l.c + 1] AS coding, CAST(l.n AS INT) AS limit_length, CAST(l.a AS BIGINT) AS at_limit, CAST(texts AS BIGINT) AS texts FROM limits",
    "p4_cuts": f"WITH RECURSIVE {_CUT.strip()} SELECT region_id, source, label, reason FROM told WHERE reason IS NOT NULL",
    "p4_found": f"WITH RECURSIVE {_CUT.strip()} SELECT region_id FROM told WHERE reason IS NOT NULL",
    "p4_rates": f"WITH RECURSIVE {_CUT.strip()} SELECT source, count(*) AS texts, count(reason) AS cut, round(count(reason) / count(*), 6) AS rate FROM told GROUP BY source",
}
