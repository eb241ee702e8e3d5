"""Content inspection and evidence policy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a secret, an authorisation or an attempt to steer a
# model. Patterns are written for both Java and RE2.
SECRET = (
    r"(?i)(?:^|[^A-Za-z0-9_])(?:[A-Za-z0-9]+[_-])*(?:password|passwd|secret|token|api[-_]?key|client[-_]?secret)"
    r"(?:[_-][A-Za-z0-9]+)*\s*[:=]\s*(?:\"[^\"\r\n]*\"|'[^'\r\n]*'|[^\s,;]+)"
)
AUTHORIZATION = r"(?i)(?:\bauthorization\b\s*[:=]\s*\S+|\bbearer\s+[A-Za-z0-9._~+/=-]+)"
INJECTION = (
    r"(?i)(?:ignore\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above)\s+instructions?"
    r"|disregard\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above)\s+instructions?"
    r"|reveal\s+(?:the\s+)?system\s+prompt|system\s+message|you\s+are\s+(?:now\s+)?chatgpt|jailbreak)"
)
#: Any mention of a private key; headers of key files hold one.
PRIVATE_KEY = r"(?i)private[ _]key"
BINARY = r"[\x00-\x08\x0E-\x1F\x7F]"
REDACTED = "[redacted]"
DECISIONS = ("allow", "redact", "deny")
#: The strictest decisions that hold for a class whatever the policy says.
CLASS_FLOORS = {
    "safe_text": ("allow", "allow"),
    "sensitive": ("redact", "deny"),
    "prompt_injection": ("redact", "deny"),
    "binary": ("deny", "deny"),
    "invalid": ("deny", "deny"),
    "prohibited": ("deny", "deny"),
}


#: A text in which a pattern can match holds one of its words, in lower case.
WORDS = {
    SECRET: ("passw", "secret", "token", "key"),
    AUTHORIZATION: ("authorization", "bearer"),
    PRIVATE_KEY: ("private",),
    INJECTION: ("ignore", "disregard", "reveal", "system", "chatgpt", "jailbreak"),
}


def findings(content: Column) -> Column:
    """Names of all that is found in a text, distinct and in order.

    Null and empty texts have none, those that aren't UTF-8 or hold control
    characters just that. Patterns are tried only where one of their words is.
    """

    def named(lower: Column) -> Column:
        def told(pattern: str, *names: str) -> Column:
            gate = F.lit(False)
            for word in WORDS[pattern]:
                gate = gate | lower.contains(word)
            return F.when(gate & content.rlike(pattern), F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>"))

        return F.concat(told(SECRET, "secret_assignment", "secret"), told(AUTHORIZATION, "authorization", "bearer"), told(PRIVATE_KEY, "pem_private_key", "secret"), told(INJECTION, "prompt_injection"))

    found = F.get(F.transform(F.array(F.lower(content)), named), F.lit(0))  # the text is put in lower case once
    none = F.array().cast("array<string>")
    return (
        F.when(content.isNull() | (content == ""), none)
        .when(~F.is_valid_utf8(content), F.array(F.lit("invalid_utf8")))
        .when(content.rlike(BINARY), F.array(F.lit("binary")))
        .otherwise(F.array_sort(F.array_distinct(found)))
    )


def classify(content: Column, found: Column) -> Column:
    """The class of a text by what ``findings`` found: empty and null texts are safe
    but omitted."""

    def told(found: Column) -> Column:
        return (
            F.when(content.isNull() | (content == ""), "safe_text")
            .when(F.array_contains(found, "invalid_utf8"), "invalid")
            .when(F.array_contains(found, "binary"), "binary")
            .when(F.size(F.array_except(found, F.array(F.lit("prompt_injection")))) > 0, "sensitive")
            .when(F.size(found) > 0, "prompt_injection")
            .otherwise("safe_text")
        )

    return F.get(F.transform(F.array(found), told), F.lit(0))  # a text is searched once, not for each branch


def content_state(content: Column, kind: Column) -> Column:
    return F.when(content.isNull() | (content == "") | kind.isin("invalid", "binary"), "omitted").when(kind.isin("sensitive", "prompt_injection"), "redacted").otherwise("present")


def rank(decision: Column) -> Column:
    return F.when(decision == "deny", 2).when(decision == "redact", 1).when(decision == "allow", 0)


def strictest(*decisions: Column) -> Column:
    """Of decisions, nulls left out, the most restrictive; all null: allow."""
    worst = F.coalesce(F.greatest(*[F.coalesce(rank(d), F.lit(0)) for d in decisions], F.lit(0)), F.lit(0))
    return F.element_at(F.array(*[F.lit(d) for d in DECISIONS]), worst + 1)


def floor_of(kind: Column, side: int) -> Column:
    out = F.lit("allow")
    for name, floors in CLASS_FLOORS.items():
        out = F.when(kind == name, floors[side]).otherwise(out)
    return out


def represent(content: Column, state: Column, decision: Column) -> Column:
    """What may be kept under a decision: the text, the marker, or nothing."""
    nothing = F.lit(None).cast("string")
    return F.when((decision == "deny") | (state == "omitted"), nothing).when((decision == "redact") | (state == "redacted"), F.lit(REDACTED)).otherwise(content)


def transferable(kind: Column, state: Column, decision: Column) -> Column:
    """Only safe, present text under an allow decision may leave."""
    return (kind == "safe_text") & (state == "present") & (decision == "allow")


def transfer_reason(content: Column, kind: Column, state: Column, decision: Column) -> Column:
    """Why a text may not be transferred; null if it may."""
    return (
        F.when(kind == "prohibited", "content_prohibited")
        .when((state == "omitted") | (F.trim(content) == ""), "content_omitted")
        .when((decision == "deny") | (kind != "safe_text"), "transfer_denied")
        .when((decision == "redact") | (state == "redacted"), "content_prohibited")
    )


def persistible(content: Column, state: Column, decision: Column) -> Column:
    present = (state == "present") & (decision == "allow") & (F.trim(content) != "")
    return present | ((state == "redacted") & decision.isin("allow", "redact") & (content == REDACTED))
