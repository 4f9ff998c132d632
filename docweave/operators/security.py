"""Governance: threat classes, attack scores, PII masking, stored rules, rate limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: patterns of hostile queries, read without regard to case
INJECTION = (
    r"ignore\s+(previous|all|above|prior)\s+instructions?", r"forget\s+(everything|all|previous)", r"you\s+are\s+now\s+(a|an|the)",
    r"pretend\s+(you|to\s+be)", r"act\s+as\s+(if|a|an)", r"jailbreak", r"DAN\b", r"do\s+anything\s+now", r"system\s*prompt",
    r"reveal\s+(your|the)\s+(prompt|instructions?|system)", r"bypass\s+(security|filter|restriction)",
    r"override\s+(safety|filter|restriction|rule)", r"<\s*script\s*>", r"<\s*img\s+src\s*=", r"\bexec\s*\(", r"\beval\s*\(",
    r"__import__", r"subprocess", r"os\.system", r"DROP\s+TABLE", r"DELETE\s+FROM", r"INSERT\s+INTO.*SELECT", r"UNION\s+SELECT", r";\s*--",
)
LEAKAGE = (
    r"\bpassword\b.*\buser(s)?\b", r"\bapi[_\s]?key\b", r"\bsecret[_\s]?key\b", r"\bssn\b|\bsocial\s+security\b",
    r"\bcredit\s+card\b|\bcard\s+number\b", r"\bpersonal\s+identifiable\b", r"\bdump\s+(all|every|the)\s+(data|database|table)",
    r"\blist\s+all\s+users?\b", r"\bexport\s+(all|every)\b",
)
SCRAPING = (
    r"(give|show|list|print|dump|output)\s+(all|every|each|the\s+entire)", r"repeat\s+(this|that|everything|the\s+above)\s+\d+\s*times",
    r"loop\s+(forever|infinitely)",
)
# fixed values: PII patterns in the order in which they are masked
PII = (
    ("SSN", r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"),
    ("PASSPORT", r"\b[A-Z]{1,2}\d{6,9}\b"),
    ("IP_ADDRESS", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
)


def any_pattern(text: Column, patterns: tuple[str, ...]) -> Column:
    """One alternation instead of a scan per pattern."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def threat(text: Column, limited: Column | None = None) -> Column:
    """First threat class that applies, or null."""
    out = F.when(any_pattern(text, INJECTION), "prompt_injection").when(any_pattern(text, LEAKAGE), "data_leakage").when(any_pattern(text, SCRAPING), "scraping")
    return out if limited is None else F.when(limited, "rate_limit").otherwise(out)


def severity(kind: Column) -> Column:
    return F.when(kind.isin("prompt_injection", "data_leakage"), "high").when(kind.isin("rate_limit", "scraping"), "medium").otherwise("none")


def attack(text: Column) -> tuple[Column, Column]:
    """(score 0-10, labels): the severest class that applies, and all that do."""
    hit = [any_pattern(text, p) for p in (INJECTION, LEAKAGE, SCRAPING)]
    score = F.greatest(*[F.when(h, s).otherwise(0.0) for h, s in zip(hit, (10.0, 8.0, 5.0))])
    labels = F.array_compact(F.array(*[F.when(h, n) for h, n in zip(hit, ("PROMPT_INJECTION", "DATA_LEAKAGE", "SCRAPING"))]))
    return score, labels


def mask_pii(rows: DataFrame, column: str) -> DataFrame:
    """Adds masked and pii (types found): patterns apply one after another to what the last one left."""
    out = rows.withColumn("masked", F.coalesce(column, F.lit(""))).withColumn("pii", F.array().cast("array<string>"))
    for name, pattern in PII:
        hit = F.col("masked").rlike(pattern)
        out = out.withColumn("pii", F.when(hit, F.array_append("pii", F.lit(name))).otherwise(F.col("pii"))).withColumn(
            "masked", F.regexp_replace("masked", pattern, f"[{name}_REDACTED]")
        )
    return out


def analyse(rows: DataFrame, column: str) -> DataFrame:
    """Threat, severity, score, masking, and the combined risk level and block and warn flags."""
    kind = threat(F.col(column))
    score, labels = attack(F.col(column))
    out = mask_pii(rows, column).withColumns({"threat": kind, "severity": severity(kind), "attack_score": score, "attacks": labels})
    level = F.when((F.col("attack_score") >= 7) | (F.col("severity") == "high"), "HIGH").when((F.col("attack_score") >= 3) | (F.size("pii") > 0), "MEDIUM").otherwise("LOW")
    return out.withColumn("risk_level", level).withColumn("block", F.col("threat").isNotNull() & (F.col("severity") == "high")).withColumn("warn", F.col("risk_level") == "MEDIUM")


def apply_rules(queries: DataFrame, rules: DataFrame, column: str) -> DataFrame:
    """Queries with the active stored rules (name, pattern, action, role, active) that match them.

    The rule table is the stated query set; its rows meet every query of their role (null: any role).
    """
    active = rules.where("active").select("name", "pattern", "action", F.col("role").alias("rule_role"))
    match = F.expr(f"{column} rlike concat('(?i)', pattern)") & (F.col("rule_role").isNull() | (F.col("rule_role") == F.col("role")))
    return queries.join(active, match, "inner")


def admitted(requests: DataFrame, limit: int, seconds: int, admin_limit: int | None = None) -> DataFrame:
    """Requests (user_id, request_id, ts, role) with allowed and retry_after: at most limit admitted in the last seconds.

    A rejected request is not recorded, so this is a fold over a user's requests in order: users are
    dealt by key and sorted, and a task reads them as a stream that holds one user's admitted times
    of the window, however many requests there are.
    """
    schema = "user_id long, request_id long, allowed boolean, retry_after int"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, deque()
        for pdf in batches:
            out = []
            for user, request, at, role in zip(pdf["user_id"], pdf["request_id"], pdf["at"], pdf["role"]):
                if user != now:
                    now, held = user, deque()
                most = admin_limit if admin_limit is not None and role == "admin" else limit
                while held and at - held[0] >= seconds:
                    held.popleft()
                allowed = len(held) < most
                out.append((user, request, allowed, 0 if allowed else int(seconds - (at - held[0])) + 1))
                if allowed:
                    held.append(at)
            yield pd.DataFrame(out, columns=["user_id", "request_id", "allowed", "retry_after"])

    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = requests.select("user_id", "request_id", at.alias("at"), "role")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "at", "request_id").mapInPandas(fold, schema)


def guarded(requests: DataFrame, limit: int, seconds: int, admin_limit: int | None = None) -> DataFrame:
    """requests(user_id, request_id, ts, role, query) with allowed, retry_after, threat and severity: rate limits first, then the patterns.

    A request beyond its user's limit is a rate_limit threat whatever it says; requests are told apart by request_id.
    """
    verdicts = admitted(requests, limit, seconds, admin_limit).drop("user_id")
    rows = requests.join(verdicts, "request_id")
    kind = threat(F.col("query"), ~F.col("allowed"))
    return rows.withColumn("threat", kind).withColumn("severity", severity(F.col("threat")))
