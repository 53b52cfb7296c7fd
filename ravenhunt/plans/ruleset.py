"""Rules, techniques and tactics used by the registered queries.

The first three rules and the technique/tactic values are fixed by the
reference's sample rules and goldens. The other rules are ours; they give
every operator and condition form (wildcard, startswith, endswith, equals,
numeric values, not/or/parentheses, unsupported syntax, undefined names,
unknown technique, missing level) a case on the log view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravenhunt.schemas import TECHNIQUE_SCHEMA
from ravenhunt.sources.rules import rules_from_documents

# --- fixed values: the reference's three sample rules ----------------------
REFERENCE_RULES = [
    {
        "title": "PowerShell Process Creation Keywords",
        "id": "d76a74b1-e2c8-4a92-b437-02b4d96a74b1",
        "description": "Detects suspicious PowerShell process creation using keywords.",
        "logsource": {"category": "process_creation", "product": "windows"},
        "detection": {
            "selection": {"Image|contains": ["powershell.exe", "pwsh.exe"]},
            "condition": "selection",
        },
        "tags": ["attack.execution", "attack.t1059.001"],
        "level": "medium",
    },
    {
        "title": "Network Connections Discovery via Netstat",
        "id": "e2b3c4d5-f6a7-8b9c-0d1e-2f3a4b5c6d7e",
        "description": "Detects usage of netstat for network connection enumeration.",
        "logsource": {"category": "process_creation", "product": "windows"},
        "detection": {
            "selection": {"Image|contains": "netstat.exe"},
            "condition": "selection",
        },
        "tags": ["attack.discovery", "attack.t1049"],
        "level": "low",
    },
    {
        "title": "WMIC usage for Credential Access",
        "id": "d1c9b2f3-e4d5-4c67-a89b-01c2d3e4f5a6",
        "description": "Detects suspicious WMIC usage potentially related to credential access "
        "or system information.",
        "logsource": {"category": "process_creation", "product": "windows"},
        "detection": {
            "selection_wmic": {"Image|endswith": ["wmic.exe"]},
            "selection_keywords": {"CommandLine|contains": ["shadowcopy", "lsass.exe", "hash"]},
            "condition": "selection_wmic and selection_keywords",
        },
        "tags": ["attack.collection", "attack.t1003", "attack.t1047"],
        "level": "high",
    },
]

# --- fixed values: technique names/urls of the goldens, tactic map ---------
TECHNIQUES = [
    ("T1059.001", "PowerShell", "Adversaries may abuse PowerShell commands and scripts for execution."),
    ("T1049", "System Network Connections Discovery", "Adversaries may list network connections."),
    ("T1003", "OS Credential Dumping", "Adversaries may dump credentials from the operating system."),
    ("T1047", "Windows Management Instrumentation", "Adversaries may abuse WMI to execute commands."),
    ("T1083", "File and Directory Discovery", "Adversaries may enumerate files and directories."),
    ("T1082", "System Information Discovery", "Adversaries may gather system information."),
]
TECHNIQUE_URL_PREFIX = "https://attack.mitre.org/techniques/"
# ----------------------------------------------------------------------------

EXTRA_RULES = [
    {
        "title": "Encoded PowerShell Command",
        "id": "7f3e1a20-0001-4c1a-9e55-encodedps001",
        "detection": {"selection": {"CommandLine|contains": "*powershell*-enc*"}, "condition": "selection"},
        "tags": ["attack.execution", "attack.t1059.001"],
        "level": "high",
    },
    {
        "title": "Command Shell Outside Shadow Copy Use",
        "id": "7f3e1a20-0002-4c1a-9e55-cmdshell0002",
        "detection": {
            "selection": {"Image|startswith": "CMD"},
            "filter": {"CommandLine|contains": "shadowcopy"},
            "condition": "selection and not filter",
        },
        "tags": ["attack.discovery", "attack.t1083"],
        "level": "low",
    },
    {
        "title": "Rundll32 Error Events",
        "id": "7f3e1a20-0003-4c1a-9e55-rundll320003",
        "detection": {
            "selection": {"Image|endswith": "RunDll32.exe", "action": "error"},
            "condition": "selection",
        },
        "tags": ["attack.defense_evasion", "attack.t1218.011"],
        "level": "critical",
    },
    {
        "title": "Explorer Or Started Process Not Viewed",
        "id": "7f3e1a20-0004-4c1a-9e55-explorer0004",
        "detection": {
            "sel_a": {"Image|contains": "explorer"},
            "sel_b": {"CommandLine|contains": "started"},
            "sel_c": {"action": "view"},
            "condition": "(sel_a or sel_b) and not sel_c",
        },
        "tags": ["attack.t1083"],
    },
    {
        "title": "Counting Condition Not Supported",
        "id": "7f3e1a20-0005-4c1a-9e55-oneofsel0005",
        "detection": {"selection1": {"Image|contains": "calc"}, "condition": "1 of selection*"},
        "tags": ["attack.t1082"],
        "level": "medium",
    },
    {
        "title": "Calculator With Undefined Alternative",
        "id": "7f3e1a20-0006-4c1a-9e55-calcundef006",
        "detection": {"selection": {"Image": "calc.exe"}, "condition": "selection or undefined_name"},
        "tags": ["attack.discovery", "attack.t1082"],
        "level": "medium",
    },
    {
        "title": "Undefined Name First",
        "id": "7f3e1a20-0007-4c1a-9e55-undeffirst07",
        "detection": {"selection": {"Image": "calc.exe"}, "condition": "undefined_name or selection"},
        "tags": ["attack.t1082"],
        "level": "low",
    },
    {
        "title": "Selected Event Ids On Host 7",
        "id": "7f3e1a20-0008-4c1a-9e55-eventids0008",
        "detection": {
            "selection": {"event_id": [4104, 4688, 1234], "hostname|endswith": "-7"},
            "condition": "selection",
        },
        "tags": ["attack.discovery", "attack.t1049"],
        "level": "high",
    },
]

CATALOG_RULES = REFERENCE_RULES + EXTRA_RULES


def rule_table(spark: SparkSession, docs: list[dict] | None = None) -> DataFrame:
    return rules_from_documents(spark, CATALOG_RULES if docs is None else docs)


def technique_table(spark: SparkSession) -> DataFrame:
    rows = [(tid, name, desc, TECHNIQUE_URL_PREFIX + tid) for tid, name, desc in TECHNIQUES]
    return spark.createDataFrame(rows, TECHNIQUE_SCHEMA)
