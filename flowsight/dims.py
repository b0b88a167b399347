"""Static dimensions (small, fixed-size tables) and the fixed values behind them.

Everything in the FIXED VALUES block must equal the reference behaviour for
results to match; it is stated plainly, in natural order.  The helpers below
turn the values into tiny DataFrames that are safe to broadcast (their size
does not grow with the data).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference)
# ---------------------------------------------------------------------------

ATTACK_LABELS = ["Normal", "Brute_Force", "Port_Scan", "HTTP_DDoS", "ICMP_Flood", "Web_Crwling"]

# label -> (technique_id, technique_name, tactic, description, next_techniques, mitigations)
ATTACK_MAPPING = {
    "Brute_Force": (
        "T1110", "Brute Force", "Credential Access",
        "Adversaries may use brute force techniques to gain access to accounts when passwords are unknown or when password hashes are obtained.",
        ["T1078 (Valid Accounts)", "T1021 (Remote Services)", "T1076 (RDP)"],
        ["Enable Multi-Factor Authentication (MFA)",
         "Implement account lockout policies after failed attempts",
         "Block source IP at firewall",
         "Reset compromised credentials immediately",
         "Monitor SMB and RDP for lateral movement"],
    ),
    "Port_Scan": (
        "T1046", "Network Service Scanning", "Discovery",
        "Adversaries may scan for services running on remote hosts to identify exploitable targets.",
        ["T1190 (Exploit Public-Facing App)", "T1133 (External Remote Services)"],
        ["Implement network segmentation",
         "Deploy IDS/IPS signatures for scan detection",
         "Rate-limit connection attempts per source IP",
         "Block known scanner tools at perimeter",
         "Enable host-based firewall rules"],
    ),
    "HTTP_DDoS": (
        "T1499", "Endpoint Denial of Service", "Impact",
        "Adversaries may perform DoS attacks to degrade or block availability of targeted resources.",
        ["T1498 (Network DoS)", "T1489 (Service Stop)"],
        ["Deploy DDoS mitigation services (e.g., Cloudflare, AWS Shield)",
         "Implement rate limiting on web servers",
         "Enable connection throttling",
         "Use CDN for traffic absorption",
         "Set up auto-scaling for critical services"],
    ),
    "ICMP_Flood": (
        "T1498", "Network Denial of Service", "Impact",
        "Adversaries may perform network-level DoS attacks using ICMP floods to overwhelm targets.",
        ["T1499 (Endpoint DoS)", "T1485 (Data Destruction)"],
        ["Rate-limit ICMP traffic at network perimeter",
         "Configure ICMP flood protection on firewalls",
         "Deploy upstream DDoS scrubbing",
         "Disable ICMP echo replies on critical servers",
         "Implement BCP38 anti-spoofing"],
    ),
    "Web_Crwling": (
        "T1595", "Active Scanning", "Reconnaissance",
        "Adversaries may scan websites to gather information for targeting.",
        ["T1190 (Exploit Public-Facing App)", "T1589 (Gather Victim Identity)"],
        ["Implement rate limiting on web applications",
         "Deploy CAPTCHA on sensitive endpoints",
         "Use robots.txt and WAF rules to block scrapers",
         "Monitor for unusual crawling patterns",
         "Implement IP reputation scoring"],
    ),
    "Normal": (
        "N/A", "Benign Traffic", "N/A",
        "Normal network traffic with no malicious indicators.",
        [],
        ["No action required — traffic is benign"],
    ),
}

# Dataset label -> canonical label (second flow-dataset family).
DATASET_LABEL_MAP = {
    "BENIGN": "Normal",
    "FTP-Patator": "Brute_Force",
    "SSH-Patator": "Brute_Force",
    "DoS slowloris": "HTTP_DDoS",
    "DoS Slowhttptest": "HTTP_DDoS",
    "DoS Hulk": "HTTP_DDoS",
    "DoS GoldenEye": "HTTP_DDoS",
    "Heartbleed": "HTTP_DDoS",
    "Web Attack – Brute Force": "Brute_Force",
    "Web Attack – XSS": "Web_Crwling",
    "Web Attack – Sql Injection": "Web_Crwling",
    "Infiltration": "Web_Crwling",
    "Bot": "Brute_Force",
    "PortScan": "Port_Scan",
    "DDoS": "HTTP_DDoS",
}

# Behavioural detector.
AUTH_PORTS = [21, 22, 23, 3389, 5900]
SAFE_IP_PREFIXES = ["127.", "0.", "224.", "239.", "255.", "169.254.", "ff", "::1", "fe80:"]
SAFE_IPS = ["8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "208.67.222.222", "208.67.220.220"]
WINDOW_SECONDS = 30
FLOOD_THRESHOLD = 60
SCAN_THRESHOLD = 25
BRUTE_THRESHOLD = 25

# Risk scoring.
ENSEMBLE_WEIGHTS = {"classifier": 0.4, "gnn": 0.2, "temporal": 0.2, "autoencoder": 0.2}
RISK_LEVELS = ["Low", "Medium", "High", "Critical"]          # upper bounds 30 / 60 / 80
MIN_ATTACK_CONFIDENCE = 0.55
MIN_ATTACK_RISK = 35.0
URGENCY_TEXT = [
    (81, "CRITICAL — Immediate action required"),
    (61, "HIGH — Action needed within 1 hour"),
    (31, "MEDIUM — Investigate within 4 hours"),
    (None, "LOW — Monitor and review"),
]

# Kill-chain phases of the timeline page: (phase, attack list text).
KILL_CHAIN = [
    ("Reconnaissance", "Web_Crwling"),
    ("Initial Access", "Brute_Force"),
    ("Discovery", "Port_Scan"),
    ("Credential Access", "Brute_Force"),
    ("Impact", "HTTP_DDoS, ICMP_Flood"),
]

# Identity columns dropped before modelling.
IDENTITY_COLUMNS = ["Flow_ID", "Source_IP", "Destination_IP", "Timestamp", "Src_IP", "Dst_IP"]

# ---------------------------------------------------------------------------
# Stand-in mapping of the driver's `events` table onto flows (our choice, not
# the reference's): event types -> canonical labels; `view` stays unmapped.
# ---------------------------------------------------------------------------
EVENT_LABEL_MAP = {
    "click": "Web_Crwling",
    "signup": "Brute_Force",
    "error": "Port_Scan",
    "purchase": "HTTP_DDoS",
}
EVENT_PORTS = [21, 22, 80, 443, 3389]

# ---------------------------------------------------------------------------
# DataFrame views of the dimensions (all bounded, broadcast-safe).
# ---------------------------------------------------------------------------

ATTACK_SCHEMA = T.StructType([
    T.StructField("label", T.StringType(), False),
    T.StructField("technique_id", T.StringType(), False),
    T.StructField("technique_name", T.StringType(), False),
    T.StructField("tactic", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("next_techniques", T.ArrayType(T.StringType(), False), False),
    T.StructField("mitigations", T.ArrayType(T.StringType(), False), False),
])


#: Labels of the behavioural rules that stand for a mapped label.
ATTACK_ALIASES = {"HTTP_Flood": "HTTP_DDoS"}


def attack_rows() -> list[tuple]:
    """Mapping rows, then the aliases' (the last field tells them apart)."""
    return ([(k, *v, False) for k, v in ATTACK_MAPPING.items()]
            + [(a, *ATTACK_MAPPING[k], True) for a, k in ATTACK_ALIASES.items()])


def attack_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(attack_rows(), T.StructType([*ATTACK_SCHEMA.fields, T.StructField("is_alias", T.BooleanType())]))


def label_map_dim(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    mapping = DATASET_LABEL_MAP if mapping is None else mapping
    return spark.createDataFrame(sorted(mapping.items()), "raw string, label string")


def kill_chain_dim(spark: SparkSession) -> DataFrame:
    rows = [(i, p, a) for i, (p, a) in enumerate(KILL_CHAIN)]
    return spark.createDataFrame(rows, "phase_order int, phase string, attacks string")


def risk_level_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(RISK_LEVELS)), "level_order int, risk_label string")


def attack_label_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ATTACK_LABELS], "label string")
