"""SQL of further queries: over their fixtures, parsed anew in SQL, or over the tables."""

from __future__ import annotations

from tessera.functions import text as T
from tessera.operators import review as R
from tessera.operators import scan as S
from tessera.plans import code, planning, review, scan, upkeep
from tessera.plans.fixture import ctes, literal

_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{literal(k)}: {literal(v)}" for k, v in pairs.items()) + "}"


# Lines of the documents; the last line before that opens or closes a block comment tells whether a line is inside one.
_LINE_STATS = f"""WITH l AS (SELECT doc_id, i, {_TRIM.format("string_split(text, chr(10))[i]")} AS x FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
e AS (SELECT *, CASE WHEN contains(x, '*/') THEN 0 WHEN starts_with(x, '/*') THEN 1 END AS turn FROM l),
s AS (SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inside FROM e),
c AS (SELECT doc_id, x = '' AS blank, x <> '' AND (inside OR starts_with(x, '/*') OR starts_with(x, '//') OR starts_with(x, '#')) AS comment FROM s)
SELECT doc_id, count(*) AS total, count(*) FILTER (NOT blank AND NOT comment) AS code, count(*) FILTER (comment) AS comment, count(*) FILTER (blank) AS blank FROM c GROUP BY doc_id"""

# Files of the diffs: a file begins with `diff --git`, a hunk with `@@`; new lines are counted from the hunk's header.
_DIFF = f"""{ctes(review.DIFFS)},
l AS (SELECT diff_id, i, string_split(diff, chr(10))[i] AS x FROM (SELECT diff_id, diff, unnest(range(1, len(string_split(diff, chr(10))) + 1)) AS i FROM diffs WHERE diff IS NOT NULL)),
f AS (SELECT *, sum((starts_with(x, 'diff --git '))::INT) OVER w - 1 AS file_no, sum((starts_with(x, '@@'))::INT) OVER w AS h FROM l WINDOW w AS (PARTITION BY diff_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, h - coalesce(min(h) FILTER (starts_with(x, 'diff --git ')) OVER (PARTITION BY diff_id, file_no), 0) AS hunk, max(CASE WHEN starts_with(x, '@@') THEN CAST(regexp_extract(x, '\\+(\\d+)', 1) AS INTEGER) END) OVER (PARTITION BY diff_id, h) AS first FROM f WHERE file_no >= 0),
b AS (SELECT *, hunk > 0 AND starts_with(x, '+') AS plus, hunk > 0 AND starts_with(x, '-') AS minus FROM g),
n AS (SELECT *, first + sum((hunk > 0 AND NOT minus AND NOT starts_with(x, '@@') AND NOT starts_with(x, '\\'))::INT) OVER (PARTITION BY diff_id, h ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS line FROM b),
files AS (SELECT diff_id, file_no, max(CASE WHEN starts_with(x, 'diff --git ') THEN regexp_extract(x, ' a/(.+) b/', 1) END) AS old_path, max(CASE WHEN starts_with(x, 'diff --git ') THEN regexp_extract(x, ' b/(.+)$', 1) END) AS new_path,
  bool_or(starts_with(x, 'new file')) AS is_new, bool_or(starts_with(x, 'deleted file')) AS is_deleted, bool_or(starts_with(x, 'Binary files')) AS is_binary, count(*) FILTER (plus) AS added, count(*) FILTER (minus) AS removed,
  count(*) FILTER (plus AND regexp_matches(x, {_re(R.BUGFIX)})) AS bugfix, count(*) FILTER ((plus OR minus) AND regexp_matches(substr(x, 2), {_re(R.EXPORT)})) AS exports, list(line) FILTER (plus) AS changed FROM n GROUP BY diff_id, file_no)"""
_HOT = "list_sort(list_filter([" + ", ".join(f"CASE WHEN bool_or(regexp_matches(new_path, {_re(r)})) THEN {literal(k)} END" for k, r in R.HOTSPOTS) + "], lambda h: h IS NOT NULL))"
_CHECKED = f"""{_DIFF},
c AS (SELECT diff_id, count(*) AS files, {_HOT} AS hot, bool_or(regexp_matches(new_path, '(?i)^src/index\\.ts$|^src/mcp/tools/') OR exports > 0) AS public_api, bool_or(regexp_matches(new_path, {_re(R.CONFIG)})) AS config,
  bool_or(regexp_matches(new_path, '(?i)^tests/|/__tests__/|\\.(test|spec)\\.[jt]s$')) AS tests, bool_or(is_binary) AS "binary", arg_min(new_path, file_no) AS first_path FROM files GROUP BY diff_id),
k AS (SELECT *, 1.0 + (files > 10)::INT + 0.5 * len(hot) + 1.5 * public_api::INT + 0.5 * config::INT + (NOT tests)::INT AS raw FROM c)"""
_CHANGE = f"""{_DIFF}, c AS (SELECT diff_id, count(*) AS n, count(*) FILTER (regexp_matches(new_path, {_re(R.DOCS)})) AS docs, count(*) FILTER (regexp_matches(new_path, {_re(R.INFRA)})) AS infra,
  count(*) FILTER (is_new AND NOT regexp_matches(new_path, {_re(R.DOCS)})) AS new, sum(bugfix) AS bugfix, count(*) FILTER (regexp_matches(new_path, {_re(R.TESTS)})) AS tests, sum(added) AS a, sum(removed) AS r FROM files GROUP BY diff_id),
h AS (SELECT diff_id, CASE WHEN docs = n THEN 'docs' WHEN infra > 0 AND infra >= ceil(n / 2) THEN 'infra' WHEN new > 0 THEN 'feature' WHEN bugfix > 0 THEN 'bugfix' WHEN tests = n THEN 'refactor'
  WHEN a + r >= 20 AND least(a, r) / greatest(1, greatest(a, r)) >= 0.6 THEN 'refactor' ELSE 'feature' END AS change FROM c)"""
_ON_LINE = f"""{_DIFF}, {ctes(review.FINDINGS).removeprefix("WITH ")},
p AS (SELECT regexp_replace(new_path, '^[ab]/', '') AS path, changed FROM files WHERE diff_id = 0 UNION ALL SELECT regexp_replace(old_path, '^[ab]/', ''), changed FROM files WHERE diff_id = 0 AND old_path <> new_path),
o AS (SELECT ord, any_value(priority) AS priority, coalesce(any_value(on_line), bool_or(coalesce(len(list_filter(changed, lambda x: x >= greatest(1, least(lo, hi)) AND x <= greatest(1, greatest(lo, hi)))), 0) > 0), false) AS on_line
  FROM findings LEFT JOIN p ON regexp_replace(regexp_replace(file, '^[ab]/', ''), '^\\.?/', '') = path GROUP BY ord)"""
_PRIORITY = "5 + (added + removed > 50)::INT + 2 * is_new::INT - is_deleted::INT + 2 * (" + " OR ".join(f"list_contains(hot, {literal(k)}) AND regexp_matches(new_path, {_re(r)})" for k, r in R.HOTSPOTS[:4]) + ")::INT + public_api::INT"
_PLAN = f"""{_CHECKED}, q AS (SELECT files.*, greatest(1, least(10, {_PRIORITY})) AS priority, CASE WHEN count(*) OVER d <= 3 AND sum(added + removed) OVER d <= 200 THEN 'broad' ELSE 'focused' END AS strategy FROM files JOIN k USING (diff_id) WINDOW d AS (PARTITION BY files.diff_id)),
r AS (SELECT * FROM q WHERE NOT is_binary QUALIFY row_number() OVER (PARTITION BY diff_id ORDER BY priority DESC, file_no) <= 5),
t AS (SELECT *, greatest(200, floor(2000 * priority / sum(priority) OVER (PARTITION BY diff_id))) AS tokens FROM r),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY diff_id) AS total FROM t)"""
_RULE = "regexp_replace(id, '[^A-Za-z0-9_.-]', '_', 'g')"
_RESULT = f"""json_object('ruleId', {_RULE}, 'level', CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END,
 'message', json_object('text', title || chr(10) || chr(10) || 'Impact: ' || impact || chr(10) || chr(10) || 'Recommendation: ' || recommendation),
 'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', file), 'region', json_object('startLine', lo, 'endLine', coalesce(hi, lo))))),
 'properties', json_object('id', id, 'category', category, 'severity', severity, 'confidence', confidence))"""
_RULE_OF = f"json_object('id', {_RULE}, 'name', {_RULE}, 'shortDescription', json_object('text', title), 'fullDescription', json_object('text', recommendation), 'properties', json_object('category', category, 'severity', severity, 'confidence', confidence))"
_EVENTS = "e AS (SELECT user_id || '|' || event_type AS key, epoch_us(ts) // 1000 AS at_ms, event_id AS ord, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events)"
_DEDUPE = f"""WITH RECURSIVE {_EVENTS},
r AS (SELECT key, i, at_ms, ord, true AS is_new, 1 AS occurrence, at_ms AS seen FROM e WHERE i = 1 UNION ALL
  SELECT e.key, e.i, e.at_ms, e.ord, e.at_ms - seen > 172800000, occurrence + (e.at_ms - seen > 172800000)::INT, CASE WHEN e.at_ms - seen > 172800000 THEN e.at_ms ELSE seen END FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)"""
#: What validation finds (v) in inputs(id, content, content_type).
VALIDATED = f"""
s AS (SELECT id, i, c, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM (SELECT id, unnest(range(0, len(cs))) AS i, unnest(cs) AS c FROM (SELECT id, string_split(content, '') AS cs FROM inputs)) WHERE contains('()[]{{}}', c) AND c <> ''),
w AS (SELECT id, 0::BIGINT AS k, []::STRUCT(c VARCHAR, i BIGINT)[] AS stack, []::STRUCT(c VARCHAR, i BIGINT)[] AS wrong FROM inputs UNION ALL
  SELECT s.id, s.k, CASE WHEN contains('([{{', c) THEN list_append(stack, {{'c': c, 'i': i}}) ELSE stack[:greatest(len(stack) - 1, 0)] END, CASE WHEN contains('([{{', c) OR coalesce(stack[len(stack)].c || c IN ('()', '[]', '{{}}'), false) THEN wrong ELSE list_append(wrong, {{'c': c, 'i': i}}) END
  FROM w JOIN s ON s.id = w.id AND s.k = w.k + 1),
z AS (SELECT id, unnest(list_concat(wrong, stack)) AS b FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1),
n AS (SELECT id, content_type, unnest(range(1, len(ls) + 1))::INT AS line, unnest(ls) AS x FROM (SELECT *, string_split(content, chr(10)) AS ls FROM inputs)),
g AS (SELECT * FROM n WHERE content_type = 'generated_code'),
v AS (SELECT id, 'T1-001' AS rule, 'error' AS severity, 1 AS tier, 'Unbalanced or unclosed bracket: ''' || b.c || ''' at position ' || b.i AS message, len(string_split(substr(content, 1, b.i::INT), chr(10)))::INT AS line FROM z JOIN inputs USING (id)
  UNION ALL SELECT id, 'T1-002', 'error', 1, 'Invalid JSON', NULL FROM inputs WHERE content_type = 'plan_output' AND NOT json_valid(content)
  UNION ALL SELECT id, 'T1-003', 'warning', 1, 'Content is empty or contains only whitespace', NULL FROM inputs WHERE {_TRIM.format("content")} = ''
  UNION ALL SELECT id, 'T2-001', 'warning', 2, 'Found marker: ' || substr(regexp_extract(x, '(?i)\\b(?:TODO|FIXME|XXX|HACK)\\b.*$'), 1, 60), line FROM g WHERE regexp_matches(x, '(?i)\\b(?:TODO|FIXME|XXX|HACK)\\b')
  UNION ALL SELECT id, 'T2-002', 'info', 2, 'Console statement found: ' || unnest(regexp_extract_all(x, '\\bconsole\\.(?:log|debug|info|warn|error)\\s*\\(')), line FROM g
  UNION ALL SELECT id, 'T2-003', 'info', 2, 'Hardcoded URL found: ' || u, line FROM (SELECT id, line, unnest(regexp_extract_all(x, '(?i)https?://(?:localhost|127\\.0\\.0\\.1|[a-z0-9-]+\\.[a-z]{{2,}})[^\\s"''`]*')) AS u FROM g) WHERE NOT contains(u, 'example.com') AND NOT contains(u, 'schema.org')
  UNION ALL SELECT id, 'T2-004', 'info', 2, 'Line exceeds 120 characters: ' || length(x), line FROM n WHERE length(x) > 120 QUALIFY row_number() OVER (PARTITION BY id ORDER BY line) <= 5)"""
_BRACKETS = f"WITH RECURSIVE {ctes(scan.INPUTS).removeprefix('WITH ')},{VALIDATED}"
_CHARS = "SELECT id, i, body[i] AS c FROM (SELECT id, body, unnest(range(0, length(body) + 1)) AS i FROM bodies)"
_SKIP = "(^|/)(node_modules|dist|build|\\.git|\\.next|__pycache__|vendor|\\.dart_tool|Pods|\\.pub-cache|coverage|\\.local-context|\\.memories)/"
_IGNORED = "regexp_matches(path, '^root\\.cfg(/|$)|(^|/)gen/|(^|/)[^/]*\\.log(/|$)|(^|/)tmp[^/]\\.ts(/|$)|(^|/)src/tmpx/')"
_BLAME = f"""{ctes(upkeep.BLAME)}, l AS (SELECT file, i, string_split(output, chr(10))[i] AS x FROM (SELECT *, unnest(range(1, len(string_split(output, chr(10))) + 1)) AS i FROM blame)),
a AS (SELECT *, last_value(CASE WHEN starts_with(x, 'author ') THEN substr(x, 8) END IGNORE NULLS) OVER w AS author, last_value(CASE WHEN starts_with(x, 'author-time ') THEN substr(x, 13) END IGNORE NULLS) OVER w AS secs FROM l WINDOW w AS (PARTITION BY file ORDER BY i ROWS UNBOUNDED PRECEDING)),
b AS (SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY i) AS INTEGER) AS line, author, strftime(make_timestamp(CAST(secs AS BIGINT) * 1000000), '%Y-%m-%d') AS date, substr(x, 2) AS content FROM a WHERE starts_with(x, chr(9)))"""
#: Lines, complexity and nesting of the fixture's functions as code_metrics gives them: the SQL tests what health makes of them.
_METRICS = [(3, 3, 2), (1, 3, 1), (6, 6, 4), (3, 5, 3), (5, 4, 2), (3, 4, 1), (1, 1, 1), (2, 1, 1), (1, 1, 1), (3, 2, 0), (2, 1, 0), (2, 1, 0), (2, 1, 1), (172, 1, 1), (2, 1, 1), (2, 1, 1), (1, 1, 0), (2, 1, 1)]
#: Local imports of the fixture, (file, path without extension, names).
_LOCAL = [("src/app/store.ts", "src/app/util", "a,b"), ("src/app/store.ts", "src/core/base", "Base")]
_EDGES = f"""{ctes(code.FILES)}, i(a, base, symbols) AS (VALUES {", ".join(map(literal, _LOCAL)).replace("[", "(").replace("]", ")")}),
t AS (SELECT a, base, symbols, unnest([1, 2, 3, 4]) AS place, unnest([base || '.ts', base || '.js', base || '/index.ts', base || '/index.js']) AS b FROM i),
e AS (SELECT a, b, symbols FROM t WHERE b IN (SELECT path FROM files) QUALIFY row_number() OVER (PARTITION BY a, base ORDER BY place) = 1)"""
_STATUS = f"{ctes(upkeep.STATUS)}, l AS (SELECT repo, unnest(string_split(output, chr(10))) AS x FROM status)"
_GRADE = "CASE WHEN complex + long + deep > 0.3 * functions THEN 'D' WHEN complex + long + deep > 0.2 * functions THEN 'C' WHEN complex + long + deep > 0.1 * functions THEN 'B' ELSE 'A' END"
_EXT = "lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1))"

ORACLES = {
    "line_stats": _LINE_STATS,
    "binary_reject": "SELECT coalesce(contains(text, chr(0)) OR length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0E-\\x1F]', '', 'g')) > 0.1 * length(text), false) AS \"binary\", count(*) AS files FROM documents GROUP BY 1",
    "validation_findings": f"{_BRACKETS} SELECT * FROM v",
    "validation_by_severity": f"{_BRACKETS} SELECT severity, count(*) AS findings FROM v GROUP BY severity",
    "path_parts": f"""WITH RECURSIVE {ctes(scan.PATHS).removeprefix("WITH ")}, p AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS ps FROM paths),
f AS (SELECT id, ps, []::VARCHAR[] AS acc, 1 AS i FROM p UNION ALL SELECT id, ps, CASE WHEN ps[i] = '..' THEN acc[:greatest(len(acc) - 1, 0)] ELSE list_append(acc, ps[i]) END, i + 1 FROM f WHERE i <= len(ps))
SELECT id, coalesce(array_to_string(acc, '/'), '') AS normal, {_EXT} AS ext, regexp_extract(path, '[^/]*$') AS base_name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder,
  regexp_replace(path, '([^/])\\.[^./]+$', '\\1') AS stem, coalesce({_map(T.PARSER_LANGUAGE)}[{_EXT}], 'unknown') AS language FROM p JOIN f USING (id) WHERE i = len(f.ps) + 1""",
    "language_of_extension": f"{ctes(scan.PATHS)} SELECT id, coalesce({_map(S.LANGUAGES)}[{_EXT}], 'Other') AS language FROM paths",
    "plan_names": f"""{ctes(scan.GOALS)}, c AS (SELECT id, {_TRIM.format("regexp_replace(substr(goal, 1, 50), '[^a-zA-Z0-9\\s]', '', 'g')")} AS x FROM goals)
SELECT id, CASE WHEN x <> '' THEN array_to_string(list_transform(string_split(x, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') END AS name FROM c""",
    "nesting_of": f"{ctes(code.BODIES)}, c AS ({_CHARS}), d AS (SELECT id, sum(CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS depth FROM c) SELECT id, CAST(greatest(0, max(depth)) AS INTEGER) AS nesting FROM d GROUP BY id",
    "graph_stats": f"""{ctes(code.FILES)}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS x FROM files)
SELECT (SELECT count(*) FROM files) AS files, count(*) FILTER (regexp_matches(x, '^(import .*[''"]|import [a-z.]+( as|\\.)|from \\w+ import|use |using |require |const \\w+ = require|\\t\\w* ?")')) AS imports,
  count(*) FILTER (regexp_matches(x, '^(export (class|const|function)|pub fn) ') OR path LIKE '%.py' AND regexp_matches(x, '^\\s*(class|def|async def) ')) AS exports FROM l""",
    "import_edges": f'{_EDGES} SELECT a AS "from", b AS "to", symbols FROM e',
    "dependents": f"{_EDGES} SELECT b AS path, count(*) AS dependents FROM e GROUP BY b",
    "related_files": f"""{_EDGES.replace("WITH ", "WITH RECURSIVE ", 1)}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT 'src/app/util.ts' AS node, 0 AS distance UNION SELECT b, distance + 1 FROM r JOIN u ON node = a WHERE distance < 2)
SELECT 'src/app/util.ts' AS start, node, CAST(min(distance) AS INTEGER) AS distance FROM r GROUP BY node HAVING min(distance) > 0""",
    "code_health": f"""WITH m(n, c, d) AS (VALUES {", ".join(map(str, _METRICS))}), h AS (SELECT count(*) AS functions, round(avg(c), 1) AS avg_complexity, round(avg(n), 0) AS avg_lines, count(*) FILTER (c > 10) AS complex, count(*) FILTER (n > 50) AS long, count(*) FILTER (d > 4) AS deep FROM m)
SELECT *, {_GRADE} AS grade FROM h""",
    "diff_stats": f"{_DIFF} SELECT diff_id, count(*) AS files, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM files GROUP BY diff_id",
    "change_classification": f"{_CHANGE} SELECT * FROM h",
    "preflight_risk": f'{_CHECKED} SELECT diff_id, files, coalesce(array_to_string(hot, \',\'), \'\') AS hotspots, public_api, config, tests, "binary", first_path, CAST(raw AS DOUBLE) AS raw_risk, CAST(least(5, greatest(1, ceil(raw))) AS INTEGER) AS risk FROM k',
    "review_context_plan": f"{_PLAN} SELECT diff_id, new_path AS file, CAST(priority AS INTEGER) AS priority, CAST(CASE WHEN total > 2000 THEN greatest(200, floor(tokens * (2000 / total))) ELSE tokens END AS BIGINT) AS tokens, strategy FROM u",
    "changed_line_range_join": f"{_ON_LINE} SELECT ord, on_line FROM o",
    "changed_lines_only": f"{_ON_LINE} SELECT ord, priority FROM o WHERE priority = 0 OR on_line",
    "sarif_results": f"{ctes(review.FINDINGS)} SELECT ord, CAST({_RESULT} AS VARCHAR) AS result FROM findings",
    "sarif_rules": f"{ctes(review.FINDINGS)}, f AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1) SELECT id, CAST({_RULE_OF} AS VARCHAR) AS rule FROM f",
    "semgrep_output": f"""{ctes(review.SCANS)}, r AS (SELECT id, i, json_extract(output, '$.results[' || (i - 1) || ']') AS r FROM (SELECT id, output, unnest(range(1, least(20, CAST(json_array_length(output, '$.results') AS BIGINT)) + 1)) AS i FROM scans WHERE json_valid(output)))
SELECT id, 'SEMGREP-' || coalesce(r->>'$.check_id', 'unknown-' || i) || '-' || i AS finding, CASE upper(coalesce(r->>'$.extra.severity', '')) WHEN 'ERROR' THEN 'CRITICAL' WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'WARNING' THEN 'HIGH' WHEN 'HIGH' THEN 'HIGH' WHEN 'INFO' THEN 'LOW' WHEN 'LOW' THEN 'LOW' ELSE 'MEDIUM' END AS severity,
  coalesce(r->>'$.path', '(unknown file)') AS file, coalesce((r->>'$.start.line')::INT, 1) AS lo, coalesce((r->>'$.end.line')::INT, (r->>'$.start.line')::INT, 1) AS hi, coalesce(r->>'$.extra.message', 'Semgrep finding') AS message FROM r""",
    "model_findings": f"""{ctes(review.REPLIES)}, b AS (SELECT id, coalesce(nullif(regexp_extract(reply, '(?s)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1), ''), regexp_extract(reply, '(?s)(\\{{.*\\}})', 1)) AS j FROM replies),
f AS (SELECT id, unnest(from_json(json_extract(j, '$.findings'), '["JSON"]')) AS f FROM b WHERE json_valid(j))
SELECT id, f->>'$.id' AS finding, f->>'$.severity' AS severity, f->>'$.title' AS title, coalesce(array_to_string(from_json(json_extract(f, '$.evidence'), '["VARCHAR"]')[:5], '; '), '') AS evidence FROM f WHERE f->>'$.id' IS NOT NULL AND f->>'$.severity' IS NOT NULL AND f->>'$.title' IS NOT NULL""",
    "plan_mermaid": f"""{ctes(planning.STEPS)}, n AS (SELECT plan_id, 0 AS k, step AS a, 0 AS b, '    step_' || step || '["' || step || '. ' || replace(coalesce(title, ''), '"', '''') || '"]' AS line FROM steps),
d AS (SELECT plan_id, step, unnest(depends_on) AS dep FROM steps), m AS (SELECT * FROM n UNION ALL SELECT DISTINCT d.plan_id, 1, d.dep, d.step, '    step_' || d.dep || ' --> step_' || d.step FROM d JOIN steps s ON s.plan_id = d.plan_id AND s.step = d.dep)
SELECT plan_id, 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY k, a, b) AS graph FROM m GROUP BY plan_id""",
    "plan_upsert": f"""{ctes(planning.PLANS, planning.NEW)}, m AS (SELECT n.*, min(o.plan_id) AS old, min(o.created_at) AS born FROM new n LEFT JOIN plans o ON o.plan_id = n.plan_id OR lower(o.name) = lower(n.name) GROUP BY ALL)
SELECT plan_id, name, status, created_at, updated_at FROM plans WHERE plan_id NOT IN (SELECT coalesce(old, plan_id) FROM m) UNION ALL SELECT coalesce(old, plan_id), name, status, coalesce(born, created_at), updated_at FROM m""",
    "review_file_assignment": f"""{ctes(planning.TASKS, planning.PATHS)}, n AS (SELECT step, unnest(tasks.paths) AS path FROM tasks), own AS (SELECT n.* FROM n JOIN paths USING (path)), k AS (SELECT greatest(1, ceil(count(*) / 12)) AS k FROM paths),
s AS (SELECT path, CAST(floor((row_number() OVER (ORDER BY ord) - 1) / k) + 1 AS INTEGER) AS step FROM paths, k) SELECT step, path FROM own UNION ALL SELECT step, path FROM s WHERE step IN (SELECT step FROM tasks) AND step NOT IN (SELECT step FROM own)""",
    "git_log_parse": f"""{ctes(upkeep.GIT)}, l AS (SELECT repo, i - 1 AS ord, string_split(output, chr(10))[i] AS x FROM (SELECT *, unnest(range(1, len(string_split(output, chr(10))) + 1)) AS i FROM git)), p AS (SELECT *, string_split(x, '|') AS p FROM l WHERE x <> '')
SELECT repo, CAST(ord AS INTEGER) AS ord, p[1] AS hash, p[2] AS author, p[3] AS "when", array_to_string(p[4:], '|') AS message FROM p""",
    "blame_lines": f"{_BLAME} SELECT * FROM b",
    "blame_ownership": f"{_BLAME} SELECT file, author, count(*) AS lines, round(count(*) / sum(count(*)) OVER (PARTITION BY file) * 100, 1) AS pct FROM b GROUP BY file, author",
    "git_status_counts": f"""{_STATUS}, k AS (SELECT repo, unnest(list_filter([CASE WHEN starts_with(x, '??') THEN 'untracked' END, CASE WHEN x[1] NOT IN (' ', '?') THEN 'staged' END, CASE WHEN x[2] NOT IN (' ', '?') THEN 'unstaged' END], lambda v: v IS NOT NULL)) AS kind FROM l WHERE length(x) > 3)
SELECT repo, kind, count(*) AS files FROM k GROUP BY ALL""",
    "memory_counts": f"{ctes(upkeep.MEMORIES)} SELECT category, CAST(len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\\s*(-|###)'))) AS INTEGER) AS entries, substr(content, 1, 500) AS preview FROM memories",
    "memory_entries": f"""{ctes(upkeep.NOTES)}, l AS (SELECT id, title, list_filter(list_transform(string_split(substr(content, 1, 5000), chr(10)), lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS ls FROM notes)
SELECT id, '### [2024-05-01] ' || title || chr(10) || coalesce(array_to_string(list_transform(ls, lambda x: CASE WHEN starts_with(x, '- ') THEN x ELSE '- ' || x END), chr(10)), '') AS entry FROM l""",
    "ignore_match": f"{ctes(upkeep.PATHS)} SELECT path, {_IGNORED} AS ignored, regexp_matches(path, '{_SKIP}') AS skipped FROM paths",
    "workspace_crawl": f"""{ctes(upkeep.PATHS)} SELECT path FROM paths WHERE NOT {_IGNORED} AND NOT regexp_matches(path, '{_SKIP}') AND (path IN ('src', 'docs', 'Makefile', 'logs') OR regexp_matches(path, '^(src|docs|Makefile|logs)/'))
AND ({_EXT} IN ('.ts', '.js', '.md', '.log', '.cfg') OR lower(regexp_extract(path, '[^/]*$')) = 'makefile') AND NOT regexp_matches(path, '(^|/)\\.[^/]')""",
    "finding_dedupe_ttl": f"{_DEDUPE} SELECT key, at_ms, ord, is_new, occurrence FROM r",
    "finding_dedupe_stats": f"{_DEDUPE} SELECT count(*) AS checked, count(*) FILTER (NOT is_new) AS duplicates, round(avg((NOT is_new)::INT), 6) AS rate FROM r",
}
