"""Dimensions: techniques, tactic order, kill-chain stages, suggestions.  All values are fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tactics in kill-chain order, and the stage of each.
TACTICS = (
    ("RECONNAISSANCE", 1), ("RESOURCE DEVELOPMENT", 2), ("INITIAL ACCESS", 3), ("EXECUTION", 4), ("PERSISTENCE", 5),
    ("PRIVILEGE ESCALATION", 5), ("DEFENSE EVASION", 5), ("CREDENTIAL ACCESS", 7), ("DISCOVERY", 7), ("LATERAL MOVEMENT", 7),
    ("COLLECTION", 7), ("COMMAND AND CONTROL", 6), ("EXFILTRATION", 7), ("IMPACT", 7),
)
STAGES = ("Recon", "Weaponization", "Delivery", "Exploitation", "Installation", "C2", "Actions on Objectives")

# The technique catalog.
TECHNIQUES = (
    ("T1566", "Phishing", "INITIAL ACCESS"),
    ("T1566.001", "Phishing: Spearphishing Attachment", "INITIAL ACCESS"),
    ("T1566.002", "Phishing: Spearphishing Link", "INITIAL ACCESS"),
    ("T1078", "Valid Accounts", "PERSISTENCE"),
    ("T1078.002", "Valid Accounts: Domain Accounts", "PERSISTENCE"),
    ("T1078.003", "Valid Accounts: Local Accounts", "PERSISTENCE"),
    ("T1110", "Brute Force", "CREDENTIAL ACCESS"),
    ("T1110.001", "Brute Force: Password Guessing", "CREDENTIAL ACCESS"),
    ("T1110.003", "Brute Force: Password Spraying", "CREDENTIAL ACCESS"),
    ("T1059", "Command and Scripting Interpreter", "EXECUTION"),
    ("T1059.001", "Command and Scripting Interpreter: PowerShell", "EXECUTION"),
    ("T1059.003", "Command and Scripting Interpreter: Windows Command Shell", "EXECUTION"),
    ("T1059.005", "Command and Scripting Interpreter: Windows Script Host", "EXECUTION"),
    ("T1047", "Windows Management Instrumentation", "EXECUTION"),
    ("T1204", "User Execution", "EXECUTION"),
    ("T1204.002", "User Execution: Malicious File", "EXECUTION"),
    ("T1547", "Boot or Logon Autostart Execution", "PERSISTENCE"),
    ("T1547.001", "Boot or Logon Autostart Execution: Registry Run Keys / Startup Folder", "PERSISTENCE"),
    ("T1543", "Create or Modify System Process", "PERSISTENCE"),
    ("T1543.003", "Create or Modify System Process: Windows Service", "PERSISTENCE"),
    ("T1053", "Scheduled Task/Job", "PERSISTENCE"),
    ("T1053.005", "Scheduled Task/Job: Scheduled Task", "PERSISTENCE"),
    ("T1136", "Create Account", "PERSISTENCE"),
    ("T1548", "Abuse Elevation Control Mechanism", "PRIVILEGE ESCALATION"),
    ("T1548.002", "Abuse Elevation Control Mechanism: Bypass User Account Control", "PRIVILEGE ESCALATION"),
    ("T1134", "Access Token Manipulation", "PRIVILEGE ESCALATION"),
    ("T1027", "Obfuscated Files or Information", "DEFENSE EVASION"),
    ("T1218", "System Binary Proxy Execution", "DEFENSE EVASION"),
    ("T1218.011", "System Binary Proxy Execution: rundll32", "DEFENSE EVASION"),
    ("T1112", "Modify Registry", "DEFENSE EVASION"),
    ("T1070", "Indicator Removal", "DEFENSE EVASION"),
    ("T1003", "OS Credential Dumping", "CREDENTIAL ACCESS"),
    ("T1003.001", "OS Credential Dumping: LSASS Memory", "CREDENTIAL ACCESS"),
    ("T1555", "Credentials from Password Stores", "CREDENTIAL ACCESS"),
    ("T1552", "Unsecured Credentials", "CREDENTIAL ACCESS"),
    ("T1046", "Network Service Discovery", "DISCOVERY"),
    ("T1018", "Remote System Discovery", "DISCOVERY"),
    ("T1087", "Account Discovery", "DISCOVERY"),
    ("T1021", "Remote Services", "LATERAL MOVEMENT"),
    ("T1021.002", "Remote Services: SMB/Windows Admin Shares", "LATERAL MOVEMENT"),
    ("T1021.006", "Remote Services: Windows Remote Management", "LATERAL MOVEMENT"),
    ("T1570", "Lateral Tool Transfer", "LATERAL MOVEMENT"),
    ("T1071", "Application Layer Protocol", "COMMAND AND CONTROL"),
    ("T1071.001", "Application Layer Protocol: Web Protocols", "COMMAND AND CONTROL"),
    ("T1071.004", "Application Layer Protocol: DNS", "COMMAND AND CONTROL"),
    ("T1105", "Ingress Tool Transfer", "COMMAND AND CONTROL"),
    ("T1568", "Dynamic Resolution", "COMMAND AND CONTROL"),
    ("T1041", "Exfiltration Over C2 Channel", "EXFILTRATION"),
    ("T1560", "Archive Collected Data", "COLLECTION"),
    ("T1005", "Data from Local System", "COLLECTION"),
)

# The technique suggested for a tactic without telemetry.
SUGGESTED = (
    ("INITIAL ACCESS", "T1566"), ("EXECUTION", "T1204"), ("PERSISTENCE", "T1547.001"), ("CREDENTIAL ACCESS", "T1003"),
    ("DISCOVERY", "T1046"), ("LATERAL MOVEMENT", "T1021.002"), ("COMMAND AND CONTROL", "T1071.001"), ("DEFENSE EVASION", "T1027"),
    ("PRIVILEGE ESCALATION", "T1548.002"), ("COLLECTION", "T1005"), ("EXFILTRATION", "T1041"), ("IMPACT", "T1486"),
)

# Risk points of a tactic.
TACTIC_RISK = (
    ("CREDENTIAL ACCESS", 15), ("PERSISTENCE", 15), ("LATERAL MOVEMENT", 15), ("COMMAND AND CONTROL", 15), ("PRIVILEGE ESCALATION", 10),
    ("DEFENSE EVASION", 8), ("EXECUTION", 6), ("INITIAL ACCESS", 8), ("DISCOVERY", 6), ("EXFILTRATION", 15), ("IMPACT", 20),
)
SEVERITIES = (("INFO", 0, 0), ("LOW", 1, 4), ("MEDIUM", 2, 10), ("HIGH", 3, 18), ("CRITICAL", 4, 25))


def techniques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TECHNIQUES), "technique_id string, name string, tactic string")


def tactics(spark: SparkSession) -> DataFrame:
    rows = [(t, i, s, STAGES[s - 1]) for i, (t, s) in enumerate(TACTICS)]
    return spark.createDataFrame(rows, "tactic string, idx int, stage int, stage_name string")


def suggestions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SUGGESTED), "tactic string, technique_id string")


def _pick(key: Column, pairs) -> Column:
    literal = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return F.element_at(F.expr(f"map({', '.join(literal(x) for pair in pairs for x in pair)})"), key)


def tactic_index(tactic: Column) -> Column:
    return _pick(F.coalesce(tactic, F.lit("")), [(t, i) for i, (t, _) in enumerate(TACTICS)])


def tactic_stage(tactic: Column) -> Column:
    return _pick(F.coalesce(tactic, F.lit("")), TACTICS)


def tactic_risk(tactic: Column) -> Column:
    return F.coalesce(_pick(F.coalesce(tactic, F.lit("")), TACTIC_RISK), F.lit(0))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(_pick(F.coalesce(severity, F.lit("")), [(s, r) for s, r, _ in SEVERITIES]), F.lit(0))


def technique_field(technique: Column, field: int) -> Column:
    """Name (1) or tactic (2) of a technique, from its own entry or its parent's."""
    table = [(t[0], t[field]) for t in TECHNIQUES]
    own = F.coalesce(F.upper(technique), F.lit(""))
    return F.coalesce(_pick(own, table), _pick(F.split(own, r"\.")[0], table))
