"""Deterministic stand-ins for a text model. They answer from what they find in the prompt, so a query
that uses one shows what the prompt carried; the oracles state the same rules in SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable


def _fenced(answer: dict) -> str:
    return "```json\n" + json.dumps(answer) + "\n```"


def note_client() -> Callable[[str], str]:
    """Reads the notes of one account; has no valid answer where a merger is planned."""
    def client(prompt: str) -> str:
        notes = prompt.split("Notes:\n", 1)[1].rsplit("\n\nFields of", 1)[0]
        if "merger planned" in notes:
            return "not json"
        return _fenced({
            "sentiment": "negative" if "frustrated" in notes else "positive",
            "competitors": [name for name in ("Strapi", "Sanity") if name in notes],
            "risk_factors": [f"{len(notes)} characters"], "executive_involved": "VP joined" in notes,
            "budget_concern": "budget cut" in notes, "renewal_signal": "mixed",
            "champion_status": "lost" if "lost faith" in notes else "active", "missed_qbrs": notes.count("no show"),
            "action_items": [], "key_quote": notes[:20],
        })
    return client


def overview_client() -> Callable[[str], str]:
    """Names the accounts whose notes open with a date and a name, and counts missed meetings."""
    def client(prompt: str) -> str:
        names = re.findall(r"(?m)^2026-03-20 \| (.*) \| James O\.$", prompt)
        return _fenced({
            "high_risk_accounts": [
                {"account_name": name, "risk_level": "high", "key_risks": [], "competitors_mentioned": [], "executive_involved": False}
                for name in names
            ],
            "portfolio_themes": [f"{len(prompt)} characters"], "urgent_actions": [f"{prompt.count('no show')} missed meetings"],
        })
    return client


def translation_client() -> Callable[[str], str]:
    """Answers every comment with its length and its first characters."""
    def client(prompt: str) -> str:
        comment = prompt.split("Comment: ", 1)[1].rsplit("\n\nFields of", 1)[0]
        return _fenced({
            "translation": f"{len(comment)} characters: {comment[:10]}", "original_language": "other",
            "sentiment": "negative" if "Too expensive" in comment else "neutral", "risk_signals": [],
        })
    return client


def churn_client() -> Callable[[str], str]:
    """Sees silent churn where the score is good and calls to the interface fall."""
    def client(prompt: str) -> str:
        name, score = re.search(r"Account (.*)\. Survey score (\S+), comment ", prompt).groups()
        calls = re.search(r"Change of API calls (\S+)%, active", prompt).group(1)
        silent = score.isdigit() and int(score) >= 7 and calls.startswith("-")
        return _fenced({
            "is_silent_churn": silent, "confidence": 0.75 if silent else 0.25,
            "pattern_type": "falling_use" if silent else "none", "evidence": [f"{name}: {score}"],
            "counter_evidence": [], "recommended_investigation": "calls " + ("fall" if calls.startswith("-") else "hold"),
        })
    return client


def no_client() -> Callable[[str], str]:
    """For runs in which every answer must come from the store."""
    def client(prompt: str) -> str:
        raise AssertionError("asked again")
    return client
