"""SQL building blocks of the oracle: the same tables by another engine's window functions."""

from __future__ import annotations

from .inputs import FLOW_SQL, LABELLED_SQL, PACKETS_SQL

FLOW = "src_ip, dst_ip, src_port, dst_port, protocol"
BASE = f"{FLOW}, packet_size, tcp_flags, ts_us"


def d(x) -> str:
    return f"{x}::DOUBLE"


def fixed(x: str, digits: int) -> str:
    scale = 10**digits
    q = f"CAST(floor(({x}) * {d(float(scale))} + {d(0.5)}) AS BIGINT)"
    return f"(({q} // {scale})::VARCHAR || '.' || lpad(({q} % {scale})::VARCHAR, {digits}, '0'))"


def whole(x: str) -> str:
    return f"CAST(floor({x}) AS BIGINT)::VARCHAR"


def ip(x: str) -> str:
    return f"(({x}>>24)&255)::VARCHAR||'.'||(({x}>>16)&255)::VARCHAR||'.'||(({x}>>8)&255)::VARCHAR||'.'||({x}&255)::VARCHAR"


SYN = "CASE WHEN protocol=6 AND (tcp_flags & 18)=2 THEN 1 ELSE 0 END"

STATS = f"""SELECT {BASE},
  count(*) OVER s AS src_total_packets, CAST(sum({SYN}) OVER s AS BIGINT) AS syn_count,
  count(DISTINCT dst_port) OVER s AS src_unique_dst_ports, count(*) OVER f AS packet_count,
  CAST(sum(packet_size) OVER f AS BIGINT) AS byte_count,
  CAST(sum(packet_size) OVER f AS DOUBLE) / count(*) OVER f AS avg_packet_size,
  CAST(1 AS BIGINT) AS unique_dst_ports, count(*) OVER s AS connection_attempts,
  count(*) OVER s / 3.0::DOUBLE AS packet_rate, ts_us AS last_seen
  FROM packets
  WINDOW s AS (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN 3000000 PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY {FLOW} ORDER BY ts_us RANGE BETWEEN 3000000 PRECEDING AND CURRENT ROW)"""

FEATS = f"""SELECT * EXCLUDE (unique_ports_l) FROM (SELECT {BASE}, packet_rate, avg_packet_size,
  src_unique_dst_ports, src_unique_dst_ports AS unique_ports_l, src_unique_dst_ports::DOUBLE AS unique_ports,
  syn_count::DOUBLE AS syn_count, src_total_packets::DOUBLE AS connection_count,
  syn_count::DOUBLE / src_total_packets::DOUBLE AS syn_ratio,
  src_unique_dst_ports::DOUBLE / 3.0::DOUBLE AS port_scan_rate, packet_rate * avg_packet_size AS bytes_per_sec FROM stats)"""

HEURISTIC = """SELECT *,
  CASE WHEN unique_ports>20 OR syn_count>40 OR packet_rate>400 THEN 1.0::DOUBLE
       WHEN packet_rate>100 OR syn_count>15 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS ml_score,
  CASE WHEN unique_ports>20 THEN 'PortScan' WHEN syn_count>40 THEN 'SYNFlood' WHEN packet_rate>400 THEN 'DoS'
       WHEN packet_rate>100 OR syn_count>15 THEN 'Suspicious' ELSE 'Normal' END AS ml_label FROM feats"""


def rules(source: str, ports=15, ratio=0.85, syn_rate=50.0, dos=500.0, baseline: bool = False) -> str:
    hit = [
        f"src_unique_dst_ports >= {ports}", f"syn_ratio >= {d(ratio)} AND packet_rate >= {d(syn_rate)}",
        f"packet_rate >= {d(dos)}",
    ]
    kinds = ["'Port Scan'", "'SYN Flood'", "'DoS Attack'"]
    severities = [f"CASE WHEN src_unique_dst_ports >= {ports * 3} THEN 2 ELSE 1 END", "2", "2"]
    reasons = [
        f"'Port scan: ' || src_unique_dst_ports::VARCHAR || ' unique ports from ' || {ip('src_ip')} || "
        f"' in 3s window (threshold: {ports})'",
        f"'SYN flood: ratio=' || {fixed('syn_ratio', 2)} || ' (' || {whole('syn_count')} || ' SYNs / ' || "
        f"{whole('connection_count')} || ' pkts) at ' || {fixed('packet_rate', 1)} || ' pkt/s'",
        f"'DoS flood: ' || {fixed('packet_rate', 1)} || ' pkt/s (' || {whole('bytes_per_sec / 1000.0::DOUBLE')} || "
        f"' KB/s) (threshold: {dos:.1f})'",
    ]
    if baseline:
        hit.append("baseline > 0 AND packet_rate >= baseline * 5.0::DOUBLE")
        kinds.append("'Traffic Spike'")
        severities.append("1")
        reasons.append(
            f"'Traffic spike: ' || {fixed('packet_rate', 1)} || ' pkt/s is ' || {fixed('packet_rate / baseline', 1)} || "
            f"'x above baseline (' || {fixed('baseline', 1)} || ' pkt/s)'"
        )

    def case(values):
        return "CASE " + " ".join(f"WHEN {h} THEN {v}" for h, v in zip(hit, values)) + " END"

    return (
        f"SELECT *, {case(kinds)} AS rule_type, {case(reasons)} AS rule_reason, "
        f"CAST({case(severities)} AS INT) AS rule_severity FROM {source}"
    )


def decide(source: str) -> str:
    score = f"substr({fixed('ml_score', 6)}, 1, 6)"
    context = (
        f"' | pkt_rate=' || {whole('packet_rate')} || ' | ports=' || {whole('unique_ports')} || ' | syn=' || {whole('syn_count')}"
    )
    named = "ml_label NOT IN ('Normal', 'Other', '')"
    flag = f"(ml_score >= 0.5 OR {named})"
    return f"""SELECT *,
      CASE WHEN rule_type IS NOT NULL THEN rule_severity WHEN {named} THEN 2 WHEN ml_score >= 0.5 THEN 1 ELSE 0 END::INT AS severity,
      CASE WHEN rule_type IS NOT NULL THEN rule_type WHEN {named} THEN ml_label WHEN ml_score >= 0.5 THEN 'Anomaly' ELSE '' END AS attack_type,
      CASE WHEN rule_type IS NOT NULL THEN rule_reason || CASE WHEN {flag} THEN ' | ML: ' || ml_label || ' (score=' || {score} || ')' ELSE '' END
           WHEN {named} THEN 'ML classifier: ' || ml_label || ' | anomaly score=' || {score} || {context}
           WHEN ml_score >= 0.5 THEN 'iForest score=' || {score} || ' RF=' || ml_label || {context} ELSE '' END AS reason,
      {ip('src_ip')} AS src_ip_str, ml_score AS anomaly_score, rule_type IS NOT NULL AS rule_triggered, {flag} AS ml_triggered
      FROM {source}"""


DETECTION = "ts_us, src_ip, src_ip_str, severity, attack_type, reason, anomaly_score, rule_triggered, ml_triggered"

STEPS = {
    "packets": PACKETS_SQL,
    "stats": STATS,
    "feats": FEATS,
    "scored": HEURISTIC,
    "ruled": rules("scored"),
    "det": decide("ruled"),
    "flowrows": FLOW_SQL,
    "labelled": LABELLED_SQL,
    "ticks": f"""SELECT src_ip, ts_us // 1000000 AS sec, count(*) AS packets, CAST(sum(packet_size) AS BIGINT) AS bytes,
      CAST(sum({SYN}) AS BIGINT) AS syns, count(DISTINCT dst_port) AS ports FROM packets GROUP BY 1, 2""",
    # The newest statistics row of each flow; rows of one flow and time are equal but for their own size and flags.
    "current": f"""SELECT {FLOW}, ts_us AS last_seen, src_total_packets, packet_count, byte_count, packet_rate FROM
      (SELECT *, row_number() OVER (PARTITION BY {FLOW} ORDER BY ts_us DESC) AS rn FROM stats) WHERE rn = 1""",
    "clean": """SELECT * FROM flowrows WHERE isfinite(packet_rate) AND isfinite(syn_count) AND isfinite(avg_packet_size)
      AND isfinite(conn_count) AND isfinite(dst_port)""",
    "train": """SELECT row_a, row_b, row_c, row_d, row_e,
      greatest(0.0::DOUBLE, least(1000000.0::DOUBLE, packet_rate)) AS packet_rate,
      CASE WHEN dst_port < 1024 THEN 1.0::DOUBLE WHEN dst_port < 10000 THEN 3.0::DOUBLE ELSE floor(dst_port / 10000.0::DOUBLE) + 4 END AS unique_ports,
      greatest(0.0::DOUBLE, least(500.0::DOUBLE, syn_count)) AS syn_count,
      greatest(0.0::DOUBLE, least(1518.0::DOUBLE, avg_packet_size)) AS avg_packet_size,
      greatest(0.0::DOUBLE, least(100000.0::DOUBLE, conn_count)) AS conn_count,
      CASE trim(label) WHEN 'BENIGN' THEN 'Normal' WHEN 'DoS Hulk' THEN 'DoS' WHEN 'DoS GoldenEye' THEN 'DoS'
        WHEN 'DoS slowloris' THEN 'DoS' WHEN 'DoS Slowhttptest' THEN 'DoS' WHEN 'Heartbleed' THEN 'DoS' WHEN 'DDoS' THEN 'DDoS'
        WHEN 'PortScan' THEN 'PortScan' WHEN 'FTP-Patator' THEN 'BruteForce' WHEN 'SSH-Patator' THEN 'BruteForce'
        WHEN 'Web Attack  Brute Force' THEN 'WebAttack' WHEN 'Web Attack  XSS' THEN 'WebAttack'
        WHEN 'Web Attack  Sql Injection' THEN 'WebAttack' WHEN 'Infiltration' THEN 'Infiltration' WHEN 'Bot' THEN 'Botnet'
        ELSE 'Other' END AS label FROM clean""",
    "hosts": """SELECT src_ip, src_ip_str, count(*) AS hits, count(*) FILTER (severity = 2) AS attack_hits,
      arg_max(attack_type, (ts_us, severity, attack_type)) AS last_type, max(anomaly_score) AS max_score,
      arg_max(severity, (ts_us, severity, attack_type)) AS last_severity, max(ts_us) AS last_ts_us
      FROM det WHERE severity > 0 GROUP BY 1, 2""",
    "logs": """SELECT ts_us, CASE WHEN severity = 2 THEN 'ATTACK' ELSE 'WARN' END AS level,
      '[' || CASE WHEN severity = 2 THEN 'ATTACK' ELSE 'WARN' END || '] ' || attack_type || ' from ' || src_ip_str || ' — ' || reason AS message
      FROM det WHERE severity > 0""",
    "thru": "SELECT ts_us // 1000000 AS sec, count(*) AS packets, CAST(sum(packet_size) AS BIGINT) AS bytes FROM packets GROUP BY 1",
}

NEEDS = {
    "stats": ["packets"], "feats": ["stats"], "scored": ["feats"], "ruled": ["scored"], "det": ["ruled"],
    "ticks": ["packets"], "current": ["stats"], "clean": ["flowrows"], "train": ["clean"], "hosts": ["det"], "logs": ["det"],
    "thru": ["packets"],
}


def query(select: str, *steps: str, recursive: bool = False, **extra: str) -> str:
    """WITH the named steps (and what they need) and extra CTEs, then the SELECT."""
    wanted: list[str] = []

    def want(step):
        for need in NEEDS.get(step, []):
            want(need)
        if step not in wanted:
            wanted.append(step)

    for step in steps:
        want(step)
    parts = [f"{s} AS ({STEPS[s]})" for s in wanted] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    if not parts:
        return select
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select
