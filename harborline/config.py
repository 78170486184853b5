"""Every tunable of the engine, in one immutable object.

The values marked "fixed values" decide results, so their defaults are part of
the contract; pass ``Config(...)`` with other values to change them.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# Signal name, weight, label shown to people. The order is also
# the order of summation and the tie-break between equal contributions.
SIGNALS = (
    ("usage_decline", 0.20, "📉 Usage Decline"),
    ("competitor_mention", 0.12, "🏢 Competitor Evaluation"),
    ("p1_tickets", 0.10, "🔴 P1 Support Tickets"),
    ("nps_detractor", 0.10, "😤 NPS Detractor Score"),
    ("open_tickets", 0.08, "📋 Unresolved Tickets"),
    ("executive_escalation", 0.08, "👔 Executive Involvement"),
    ("budget_concern", 0.07, "💰 Budget Constraints"),
    ("champion_loss", 0.06, "🏆 Champion at Risk"),
    ("nps_deterioration", 0.05, "📊 NPS Deterioration"),
    ("sdk_deprecation_risk", 0.05, "⚠️ SDK Deprecation"),
    ("product_risk_impact", 0.05, "🔧 Product Risk Impact"),
    ("missed_qbrs", 0.04, "📅 Missed QBRs"),
)

# Product events (version, date, type, title, affects, severity).
CHANGELOG_EVENTS = (
    ("v4.3.2", "2026-03-01", "deprecation",
     "REST API v2 sunset extended to April 30, 2026", "all_v3_sdk", "critical"),
    ("v4.3.2", "2026-03-01", "deprecation",
     "Legacy editor removal in v4.4.0 (May 2026)", "legacy_editor_users", "high"),
    ("v4.3.2", "2026-03-01", "deprecation",
     "SDK v3.x security patches end April 30, 2026", "all_v3_sdk", "critical"),
    ("v4.2.0", "2025-10-15", "breaking_change",
     "Response envelope change: entry → data", "sdk_below_4.2.0", "high"),
    ("v4.2.0", "2025-10-15", "breaking_change",
     "Webhook payload v2 default", "webhook_users", "medium"),
    ("v4.3.0", "2025-12-15", "deprecation",
     "Legacy Workflow Engine deprecated", "workflow_users", "medium"),
    ("v4.2.3", "2025-11-01", "bugfix",
     "Locale fallback null fix (v4.0.0 and v4.1.0)", "v4.0.0_v4.1.0", "medium"),
    ("v4.3.2", "2026-03-01", "security",
     "Privilege escalation patch (CVE-2026-1102)", "all_below_4.3.2", "critical"),
)

# Survey comment vocabulary.
NPS_NEGATIVE = (
    "downgrade", "competitor", "done", "frustrated", "disappointed", "expensive",
    "steep", "evaluating", "watching competitors", "fallen off", "wasted",
    "embarrassing", "lost faith", "no communication", "forever", "cliff",
)
NPS_POSITIVE = (
    "love", "great", "best", "transformed", "phenomenal", "recommend", "easily", "won",
)

# Marks of a comment that is not English.
FOREIGN_SCRIPT = "一-鿿"
FOREIGN_LETTERS = "àâäéèêëîïôùûüçñ¿¡"
FOREIGN_WORDS = (
    "est", "mais", "pour", "notre", "équipe", "produit", "l'interface",
    "soporte", "español", "inexistente", "producto", "bueno", "pero",
)

# Call-note vocabulary.
COMPETITORS = (
    ("hygraph", "Hygraph"), ("contentful", "Contentful"), ("strapi", "Strapi"),
    ("sanity", "Sanity"), ("kontent.ai", "Kontent.ai"), ("builder.io", "builder.io"),
    ("wordpress", "WordPress"),
)
NOTE_NEGATIVE = (
    "frustrated", "furious", "tense", "threatening", "walk", "done", "embarrassing",
    "lost faith", "poorly", "painful",
)
NOTE_POSITIVE = (
    "happy", "love", "great", "smooth", "champagne", "excellent", "expanding", "good news",
)
EXECUTIVE_WORDS = ("vp", "cto", "cro", "ciso", "director", "c-suite", "chief")
BUDGET_WORDS = ("budget", "price", "cost", "discount", "expensive", "cut")
NO_SHOW_WORDS = ("no show", "no-show")
CHURN_WORDS = ("churn", "cancel")
MIGRATION_WORDS = ("migration", "moving")
DOWNGRADE_WORDS = ("downgrade",)
MERGER_WORDS = ("merger", "acquired")
RENEWAL_NEGATIVE = ("walk", "cancel", "done", "explore options")
RENEWAL_POSITIVE = ("expanding", "upgrade", "locked in", "formality")
CHAMPION_WORDS = ("lost faith", "nervous", "champion")
CHAMPION_RISK_WORDS = ("lost", "nervous")
MISSED_QBR_PHRASES = ("missed qbr", "no show", "no-show")

# Ticket topic -> phrases in subject or description (multi-label).
TICKET_TOPICS = (
    ("sdk_deprecation", ("sdk upgrade", "rest api deprecation", "sdk upgrade guidance")),
    ("legacy_editor", ("migration from legacy editor", "new editor crash")),
    ("locale_fallback", ("locale fallback",)),
    ("workflow_broken", ("workflow automation broken",)),
    ("breaking_change", ("rest api deprecation migration",)),
)

# Subject phrase -> product event, first match wins.
TICKET_EVENT_LINKS = (
    ("sdk upgrade guidance", "sdk_deprecation"),
    ("rest api deprecation migration", "rest_api_sunset"),
    ("migration from legacy editor", "legacy_editor_removal"),
    ("locale fallback not working", "locale_fallback_bug"),
    ("workflow automation broken", "workflow_deprecation"),
    ("new editor crash", "new_editor_issues"),
    ("custom field rendering issue", "custom_field_xss_patch"),
)

# What is said of a version that a product change hits; {version} is the version.
VERSION_IMPACT_DETAILS = {
    "sdk_deprecated": (
        "Running {version} — SDK v3.x is deprecated. Security patches ended April 30, 2026. "
        "REST API v2 endpoints sunset. Must migrate to v4.2.3+ immediately."
    ),
    "sdk_risky_version": (
        "Running {version} — hit by locale fallback bug (fixed in v4.2.3) and affected by v4.2.0 "
        "breaking change (response.entry → response.data). Upgrade recommended."
    ),
    "rest_api_sunset": "REST Content Delivery API v2 sunset April 30, 2026",
    "breaking_change_impact": "SDK v4.2.0 changed response envelope (entry → data). Must update API integrations.",
    "locale_fallback_bug": "Missing locale fallback null fix (available in v4.2.3)",
}

# Call-note header formats.
NOTE_SEPARATOR = "---"
NOTE_FILE_HEADER = "CSM Call Notes"
NOTE_MIN_LENGTH = 10
ACCOUNT_ID_PATTERNS = (
    r"acct\s*(\d{4})", r"#(\d{4})", r"account\s*(\d{4})", r"\((\d{4})\)",
)
NAME_PIPE_PATTERN = r"\|\s*([A-Za-z][A-Za-z\s&\-'\.]+?)\s*\|"
NAME_TALKED_PATTERN = r"[Tt]alked to\s+(.+?)[\.\,]"
NAME_DASH_PATTERN = r"[-–]\s*([A-Za-z][A-Za-z\s&\-'\.]+?)(?:\s*[\(\-#\n]|$)"
NAME_DATE_PATTERN = (
    r"(?:\d{1,2}/\d{1,2}|\d{4}-\d{2}-\d{2}|[A-Za-z]+\s+\d{1,2})"
    r"\s+([A-Za-z][a-z]+(?:\s+[A-Za-z]+)+)"
)
NAME_DASH_STOP = ("note", "all good", "routine", "quick")
NAME_DATE_STOP = ("note for", "all good", "routine check", "quick sync", "just a quick")
DATE_ISO_PATTERN = r"(\d{4}-\d{2}-\d{2})"
DATE_SLASH_PATTERN = r"\b(\d{1,2}/\d{1,2})\b"
DATE_WORD_PATTERN = r"\b([A-Za-z]+)\s+(\d{1,2})\b"
OWNERS = (
    "Carlos Mendez", "Sarah Chen", "David Kim", "Raj Patel",
    "James Okafor", "Emily Watson", "Priya Sharma", "Anna Kowalski",
)

# The heat map shows these signals in this order.
HEATMAP_SIGNALS = (
    ("usage_decline", "Usage ↓"), ("competitor_mention", "Competitors"),
    ("p1_tickets", "P1 Tickets"), ("nps_detractor", "NPS Low"),
    ("open_tickets", "Open Tickets"), ("executive_escalation", "Exec Involved"),
    ("budget_concern", "Budget Risk"), ("sdk_deprecation_risk", "SDK Risk"),
    ("product_risk_impact", "Product Risk"),
)

TIERS = ("High", "Medium", "Low")


@dataclass(frozen=True)
class Config:
    as_of: dt.date = dt.date(2026, 6, 9)
    window_from_days: int = -30
    window_to_days: int = 90
    recent_ticket_days: int = 90
    signals: tuple = SIGNALS
    high_threshold: float = 0.65
    medium_threshold: float = 0.40
    decline_severe: float = 0.40
    decline_moderate: float = 0.20
    decline_mild: float = 0.10
    min_usage_months: int = 4
    deprecated_sdks: tuple = ("v3.1.2", "v3.2.0", "v3.4.1")
    risky_sdks: tuple = ("v4.0.0",)
    envelope_sdks: tuple = ("v4.0.0", "v4.1.0")
    below_envelope_sdks: tuple = ("v3.1.2", "v3.2.0", "v3.4.1", "v4.0.0", "v4.1.0")
    locale_fix_version: tuple = (4, 2, 3)
    fuzzy_threshold: float = 75.0
    events: tuple = CHANGELOG_EVENTS
    owners: tuple = OWNERS
    # An account with more usage rows than this is ordered in several pieces,
    # each holding at most this many consecutive input rows.
    heavy_rows: int = 500_000
    # Longest text, in characters, sent to a text model in one prompt.
    prompt_characters: int = 200_000

    def __post_init__(self) -> None:
        total = sum(weight for _, weight, _ in self.signals)
        if abs(total - 1.0) >= 0.001:
            raise ValueError(f"signal weights must sum to 1.0, got {total}")
