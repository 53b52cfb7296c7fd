"""Hand-written DuckDB SQL for the hunt over the log view (oracle side).

It restates the catalog rules as plain SQL predicates, independently of the
Spark rule compiler, so that the oracle checks the compiler too.
"""

from ravenhunt.plans.views import LOG_VIEW_SQL

TECH_VALUES_SQL = """
SELECT * FROM (VALUES
  ('T1059.001', 'PowerShell'),
  ('T1049', 'System Network Connections Discovery'),
  ('T1003', 'OS Credential Dumping'),
  ('T1047', 'Windows Management Instrumentation'),
  ('T1083', 'File and Directory Discovery'),
  ('T1082', 'System Information Discovery')
) t(technique_id, name)
"""

_RAW_COLS = "timestamp, hostname, username, process_name, event_id, message, source_ip, destination_ip, action"


def _rule(rule_id: str, title: str, level: str, tid: str | None, where: str) -> str:
    tid_sql = "NULL" if tid is None else f"'{tid}'"
    return (
        f"SELECT {_RAW_COLS}, '{rule_id}' AS hunting_rule_id, '{title}' AS hunting_rule_title, "
        f"'{level}' AS rule_level, CAST({tid_sql} AS VARCHAR) AS mitre_technique_id FROM lc WHERE {where}"
    )


_RULES_SQL = "\nUNION ALL\n".join(
    [
        _rule(
            "d76a74b1-e2c8-4a92-b437-02b4d96a74b1",
            "PowerShell Process Creation Keywords",
            "medium",
            "T1059.001",
            "coalesce(contains(p, 'powershell.exe') OR contains(p, 'pwsh.exe'), false)",
        ),
        _rule(
            "e2b3c4d5-f6a7-8b9c-0d1e-2f3a4b5c6d7e",
            "Network Connections Discovery via Netstat",
            "low",
            "T1049",
            "coalesce(contains(p, 'netstat.exe'), false)",
        ),
        _rule(
            "d1c9b2f3-e4d5-4c67-a89b-01c2d3e4f5a6",
            "WMIC usage for Credential Access",
            "high",
            "T1003",
            "coalesce(ends_with(p, 'wmic.exe'), false) AND coalesce(contains(m, 'shadowcopy') "
            "OR contains(m, 'lsass.exe') OR contains(m, 'hash'), false)",
        ),
        _rule(
            "7f3e1a20-0001-4c1a-9e55-encodedps001",
            "Encoded PowerShell Command",
            "high",
            "T1059.001",
            "coalesce(regexp_matches(m, 'powershell.*-enc'), false)",
        ),
        _rule(
            "7f3e1a20-0002-4c1a-9e55-cmdshell0002",
            "Command Shell Outside Shadow Copy Use",
            "low",
            "T1083",
            "coalesce(starts_with(p, 'cmd'), false) AND NOT coalesce(contains(m, 'shadowcopy'), false)",
        ),
        _rule(
            "7f3e1a20-0003-4c1a-9e55-rundll320003",
            "Rundll32 Error Events",
            "critical",
            "T1218.011",
            "coalesce(ends_with(p, 'rundll32.exe'), false) AND coalesce(a = 'error', false)",
        ),
        _rule(
            "7f3e1a20-0004-4c1a-9e55-explorer0004",
            "Explorer Or Started Process Not Viewed",
            "informational",
            "T1083",
            "(coalesce(contains(p, 'explorer'), false) OR coalesce(contains(m, 'started'), false)) "
            "AND NOT coalesce(a = 'view', false)",
        ),
        _rule(
            "7f3e1a20-0006-4c1a-9e55-calcundef006",
            "Calculator With Undefined Alternative",
            "medium",
            "T1082",
            "coalesce(p = 'calc.exe', false)",
        ),
        _rule(
            "7f3e1a20-0008-4c1a-9e55-eventids0008",
            "Selected Event Ids On Host 7",
            "high",
            "T1049",
            "coalesce(e IN ('4104', '4688', '1234'), false) AND coalesce(ends_with(h, '-7'), false)",
        ),
    ]
)

HUNT_WITH = f"""
WITH lv AS ({LOG_VIEW_SQL}),
lc AS (
  SELECT *, lower(process_name) AS p, lower(message) AS m, lower(action) AS a,
         lower(hostname) AS h, lower(CAST(event_id AS VARCHAR)) AS e
  FROM lv
),
raw AS ({_RULES_SQL}),
tech AS ({TECH_VALUES_SQL}),
enriched AS (
  SELECT r.timestamp, r.hostname, r.username, r.process_name, r.hunting_rule_id,
         r.hunting_rule_title, r.rule_level, r.mitre_technique_id,
         t.name AS mitre_technique_name,
         CAST(CASE WHEN t.technique_id IS NULL THEN 0
                   WHEN r.rule_level = 'critical' THEN 100
                   WHEN r.rule_level = 'high' THEN 90
                   WHEN r.rule_level = 'medium' THEN 70
                   WHEN r.rule_level = 'low' THEN 40
                   ELSE 20 END AS INTEGER) AS risk_score,
         CASE WHEN t.technique_id IS NOT NULL
              THEN 'https://attack.mitre.org/techniques/' || t.technique_id END AS mitre_technique_url,
         CAST(r.event_id AS VARCHAR) AS event_id, r.message, r.source_ip, r.destination_ip, r.action
  FROM raw r LEFT JOIN tech t ON r.mitre_technique_id = t.technique_id
),
hunt AS (SELECT DISTINCT * FROM enriched)
"""
