"""A probe of every pattern of the stateless rules: each event takes the form of one case, whose findings are stated beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainspark.operators.rules import detect
from chainspark.plans.queries import query
from chainspark.plans.stored import derived

# Fields of a case, and its findings as (rule, severity, technique).
ENCODED = ("ENCODED_POWERSHELL", "HIGH", "T1027")
LOUD, SOFT = ("SUSPICIOUS_POWERSHELL", "HIGH", "T1059.001"), ("SUSPICIOUS_POWERSHELL", "MEDIUM", "T1059.001")
OFFICE = ("OFFICE_SPAWNS_POWERSHELL", "HIGH", "T1059.001")
TOOL, FETCH = ("SUSPICIOUS_LOLBIN", "HIGH", "T1218"), ("SUSPICIOUS_LOLBIN", "HIGH", "T1105")
STARTUP = ("SUSPICIOUS_EXECUTABLE_CREATION", "HIGH", "T1547.001")
WRITTEN, DROPPED = ("SUSPICIOUS_EXECUTABLE_CREATION", "HIGH", "T1105"), ("SUSPICIOUS_EXECUTABLE_CREATION", "MEDIUM", "T1105")
USER_DIR = ("SCRIPT_IN_USER_DIRECTORY", "MEDIUM", "T1059.001")
OUT, OUT_SOFT = ("UNUSUAL_OUTBOUND_CONNECTION", "HIGH", "T1071.001"), ("UNUSUAL_OUTBOUND_CONNECTION", "MEDIUM", "T1071.001")
NAME, NAME_SOFT = ("SUSPICIOUS_DNS_QUERY", "HIGH", "T1071.004"), ("SUSPICIOUS_DNS_QUERY", "MEDIUM", "T1071.004")
KEY = ("REGISTRY_PERSISTENCE", "HIGH", "T1547.001")
SERVICE = ("SUSPICIOUS_SERVICE_INSTALL", "HIGH", "T1543.003")
TASK = ("SCHEDULED_TASK_CREATED", "HIGH", "T1053.005")
DUMP = ("CREDENTIAL_DUMPING_TOOL", "CRITICAL", "T1003.001")
UAC, ADMIN, GRANT = (("PRIVILEGED_LOGON", s, t) for s, t in (("HIGH", "T1548.002"), ("HIGH", "T1078"), ("MEDIUM", "T1078")))


def _remote(technique: str) -> tuple[str, str, str]:
    return ("REMOTE_EXECUTION", "HIGH", technique)


def _process(name: str, command: str | None = None, *found, parent: str | None = None) -> tuple[dict, tuple]:
    return {"event_type": "PROCESS_CREATED", "process_name": name, "command_line": command, "parent_process": parent}, found


def _file(path: str, *found, process: str | None = "explorer.exe", parent: str | None = None) -> tuple[dict, tuple]:
    return {"event_type": "FILE_CREATED", "file_path": path, "process_name": process, "parent_process": parent}, found


def _connection(ip: str, *found, port: int = 443, process: str = "chrome.exe") -> tuple[dict, tuple]:
    return {"event_type": "NETWORK_CONNECTION", "destination_ip": ip, "destination_port": port, "process_name": process}, found


def _of(kind: str, *found, **fields) -> tuple[dict, tuple]:
    return {"event_type": kind, **fields}, found


POWERSHELL_CASES = [
    _process("powershell.exe", "powershell -enc AAAA", ENCODED, LOUD),
    _process("PowerShell.EXE", "-EncodedCommand AAAA", ENCODED, LOUD),
    _process("pwsh.exe", "pwsh -ec AAAA", ENCODED, LOUD),
    _process("powershell.exe", "my-encoder", ENCODED),
    _process("powershell.exe", "x " + "A" * 120, ENCODED),
    _process("powershell.exe", "x " + "A" * 119),
    _process("cmd.exe", "cmd -enc AAAA"),
    *[_process("powershell.exe", c, LOUD) for c in ("[Convert]::FromBase64String(x)", "x.DownloadString(y)", "x.DownloadFile(y)", "New-Object Net.WebClient", "Start-BitsTransfer x", "IEX x", "a;Invoke-Expression b")],
    *[_process("pwsh.exe", c, LOUD) for c in ("amsiInitFailed", "AmsiUtils", "Add-MpPreference x", "ExclusionPath", "VirtualAlloc", "GetProcAddress", "WriteProcessMemory", "CreateThread")],
    *[_process("powershell.exe", c, SOFT) for c in ("Invoke-WebRequest x", "-ep bypass", "-nop x", "-w hidden", "-windowstyle hidden", "Invoke-Command x", "Enter-PSSession y")],
    *[_process("powershell.exe", c) for c in ("bypassed", "x-nop-y", "Get-Process | Format-Table", "Test-Connection h", "iexplore", None)],
    _process("powershell.exe", "Get-Service; iex x", LOUD),
    _process("notepad.exe", "iex x"),
]
PROCESS_CASES = [
    *[_process("cmd.exe", None, OFFICE, parent=p) for p in ("WINWORD.EXE", "excel.exe", "powerpnt.exe", "outlook.exe", "msaccess.exe", "visio.exe")],
    *[_process(c, None, OFFICE, parent="excel.exe") for c in ("powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe")],
    _process("notepad.exe", None, parent="winword.exe"),
    _process("cmd.exe", None, parent="explorer.exe"),
    _process("certutil.exe", "certutil -URLCACHE x", FETCH),
    _process("rundll32.exe", "javascript:x", TOOL),
    _process("regsvr32.exe", "regsvr32 /i x", TOOL),
    _process("mshta.exe", "vbscript:x", TOOL),
    _process("bitsadmin.exe", "get HTTP x", TOOL),
    _process("wmic.exe", "hidden", TOOL),
    _process("msbuild.exe", r"\\share\x", TOOL),
    _process("rundll32.exe", "scrobj.dll", TOOL),
    _process("rundll32.exe", "shell32.dll"),
    _process("notepad.exe", "http://x"),
    _process("wscript.exe", r"C:\Users\a\AppData\x.js", USER_DIR),
    _process("cscript.exe", r"c:\temp\x.js", USER_DIR),
    _process("mshta.exe", r"c:\users\public\x.hta", USER_DIR),
    _process("powershell.exe", "%TEMP%", USER_DIR),
    _process("powershell.exe", r"Get-ChildItem c:\temp\x"),
    _process("pwsh.exe", r"c:\temp\x.ps1"),
    _process("schtasks.exe", "schtasks /CREATE x", TASK),
    _process("x.exe", "/tn updater", TASK),
    *[_process(n, None, DUMP) for n in ("mimikatz.exe", "procdump.exe", "lazagne.exe", "Invoke-Mimikatz", "nanodump.exe", "sharpdump.exe")],
    *[_process("x.exe", c, DUMP) for c in ("dump LSASS", "comsvcs.dll", "MiniDump")],
]
FILE_CASES = [
    _file(r"C:\x\Startup\a.exe", STARTUP),
    _file(r"C:\x\Startup\a.lnk"),
    *[_file(rf"c:\x\a.{e}", WRITTEN, process="svchost.exe") for e in ("exe", "dll", "scr", "bat", "cmd", "ps1", "vbs", "js", "msi")],
    _file(r"c:\x\a.txt", process="svchost.exe"),
    _file(r"c:\x\a.exe", WRITTEN, process=None, parent="cmd.exe"),
    _file(r"c:\x\a.exe", WRITTEN, process="msiexec.exe"),
    _file(r"c:\x\a.exe", WRITTEN, process="bitsadmin.exe"),
    _file(r"C:\Users\Public\a.js", DROPPED),
    _file(r"c:\temp\a.dll", DROPPED),
    _file("/temp/a.js", DROPPED),
    _file(r"c:\users\a\appdata\a.vbs", DROPPED),
    _file(r"c:\program files\a.exe"),
    _file(r"c:\windows\tasks\a.job", TASK),
    _file(r"c:\x\a.dmp", DUMP, process="procdump.exe"),
]
NETWORK_CASES = [
    _connection("8.8.8.8"),
    *[_connection("8.8.8.8", OUT, port=p) for p in (4444, 5555, 8080, 8443, 1337, 9001, 6667)],
    *[_connection("8.8.8.8", OUT_SOFT, process=p) for p in ("powershell.exe", "pwsh.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "curl.exe", "wget.exe", "certutil.exe", "bitsadmin.exe", "rundll32.exe", "regsvr32.exe")],
    *[_connection(ip, OUT) for ip in ("185.220.101.45", "45.155.205.233", "91.219.236.19")],
    *[_connection(ip, port=4444) for ip in (
        "10.0.0.1", "127.0.0.1", "169.254.1.1", "172.16.0.1", "172.31.255.255", "192.168.1.1", "192.0.0.9", "192.0.2.1", "198.18.0.1", "198.19.255.255",
        "198.51.100.7", "203.0.113.9", "224.0.0.1", "255.255.255.255", "0.1.2.3", "not an address", "256.1.1.1", "::1", "fe80::1", "fc00::1", "ff02::1",
    )],
    *[_connection(ip, OUT, port=4444) for ip in ("172.32.0.1", "172.15.255.255", "192.0.1.1", "198.20.0.1", "11.0.0.1", "223.255.255.255", "2606:4700::1111")],
    _of("DNS_QUERY", NAME, domain="update-cdn-live.net"),
    _of("DNS_QUERY", NAME, domain="a.fast-dl-host.net"),
    _of("DNS_QUERY", NAME, domain="CDN-update-check.net"),
    _of("DNS_QUERY", domain="xmail-secure-login.com"),
    _of("DNS_QUERY", NAME, domain="x.mail-secure-login.com"),
    _of("DNS_QUERY", NAME_SOFT, domain="aa." * 19 + "com"),
    _of("DNS_QUERY", domain="aa." * 18 + "comx"),
    _of("DNS_QUERY", NAME_SOFT, domain="b" * 41 + ".com"),
    _of("DNS_QUERY", domain="b" * 40 + ".com"),
    _of("DNS_QUERY"),
]
OTHER_CASES = [
    *[_of("REGISTRY_MODIFIED", KEY, file_path=p) for p in (
        r"HKLM\Software\Microsoft\Windows\CurrentVersion\Run\x", r"HKCU\x\currentversion\RunOnce", r"x\CurrentVersion\RunServices", r"x\Windows NT\CurrentVersion\Winlogon",
        r"x\Image File Execution Options\y", r"x\CurrentVersion\Shell", r"x\CurrentVersion\Userinit", r"HKLM\System\Services\y", r"x\Explorer\Run",
    )],
    _of("REGISTRY_MODIFIED", KEY, command_line=r"add \currentversion\run"),
    _of("REGISTRY_MODIFIED", file_path=r"HKLM\Software\Vendor"),
    _of("REGISTRY_MODIFIED", TASK, file_path=r"x\Tasks\y"),
    _of("SERVICE_CREATED", SERVICE, file_path=r"c:\windows\x.EXE"),
    _of("SERVICE_CREATED", file_path=r"c:\windows\x.sys"),
    *[_of("SERVICE_CREATED", SERVICE, file_path=p) for p in (r"C:\ProgramData\x.sys", "/temp/x", r"c:\Temp\x.sys", r"c:\users\public\x", r"x\AppData\Local\Temp\y", "x.dll", "x.cmd")],
    _of("SERVICE_CREATED", SERVICE, command_line="x.bat"),
    _of("SERVICE_CREATED", TASK, file_path=r"c:\windows\tasks\x"),
    _of("REMOTE_EXECUTION", _remote("T1021.006"), note="WinRM"),
    _of("REMOTE_EXECUTION", _remote("T1021.006"), protocol="https"),
    _of("REMOTE_EXECUTION", _remote("T1047"), note="wmi"),
    _of("REMOTE_EXECUTION", _remote("T1021.002"), note="psexec"),
    *[_of("PRIVILEGE_CHANGE", UAC, note=m) for m in ("fodhelper", "CompMgmt", "eventvwr", "sdclt", "cmstp", "uaclcrl", "consent.exe")],
    _of("PRIVILEGE_CHANGE", UAC, command_line="start fodhelper"),
    *[_of("PRIVILEGE_CHANGE", ADMIN, user=u) for u in ("admin1", "root", "svc_x", "myservice")],
    *[_of("PRIVILEGE_CHANGE", ADMIN, user="ann", note=m) for m in ("SeBackupPrivilege", "SeDebugPrivilege")],
    _of("PRIVILEGE_CHANGE", GRANT, user="ann", note="logon"),
    _of("FILE_MODIFIED", file_path=r"c:\temp\a.exe"),
    _of("AUTHENTICATION", user="admin"),
]
CASES = [*POWERSHELL_CASES, *PROCESS_CASES, *FILE_CASES, *NETWORK_CASES, *OTHER_CASES]
FIELDS = ("event_type", "user", "destination_ip", "destination_port", "protocol", "process_name", "parent_process", "command_line", "file_path", "domain", "note")

_WANT = ", ".join(f"({i}, '{rule}', '{severity}', '{technique}')" for i, (_, found) in enumerate(CASES) for rule, severity, technique in found)
_SQL = f"""SELECT w.probe, rule_id, severity, technique_id, count(*) AS n FROM (SELECT event_id % {len(CASES)} AS probe FROM events) e JOIN (VALUES {_WANT}) w(probe, rule_id, severity, technique_id) ON w.probe = e.probe GROUP BY ALL"""


@query("rules_probe", _SQL)
def rules_probe(spark, sf_dir):
    """Findings of every case, one case an event in turn; a case without a finding must have no row."""
    d = derived(spark, sf_dir)
    rows = [(i, *(str(fields[c]) if fields.get(c) is not None else None for c in FIELDS)) for i, (fields, _) in enumerate(CASES)]
    cases = spark.createDataFrame(rows, "probe int, " + ", ".join(f"{c} string" for c in FIELDS))
    own = d.telemetry.select("event_id", "sec", F.concat(F.lit("own-"), F.col("event_id")).alias("host"), F.lit(None).cast("string").alias("source_ip"))
    own = own.withColumn("probe", (F.substring("event_id", 5, 12).cast("long") % len(CASES)).cast("int"))
    events = own.join(F.broadcast(cases), "probe").withColumn("destination_port", F.col("destination_port").cast("int"))
    found = detect(events).join(own.select("event_id", "probe"), "event_id")
    return found.groupBy("probe", "rule_id", "severity", "technique_id").agg(F.count(F.lit(1)).alias("n"))
