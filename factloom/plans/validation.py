"""Reading the JSON that models reply with, and validating facts with a model."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from factloom.plans import prompts
from factloom.plans.models import ChatModel

Fact = tuple[str, str, str]
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)


def json_in(text: str | None) -> dict | None:
    """The JSON object in a reply: within fences, else from the first brace to the last; null if there is none."""
    if not text:
        return None
    for candidate in [m.group(1) for m in _FENCE.finditer(text)] + [text[text.find("{") : text.rfind("}") + 1]]:
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


def as_fact(value) -> Fact | None:
    """The first three parts of a list, blanks as underscores; null for anything else."""
    if not isinstance(value, list) or len(value) < 3:
        return None
    return tuple(str(v).strip().replace(" ", "_") for v in value[:3])


@dataclass
class Checked:
    fact: Fact
    status: str
    reason: str = ""
    original: Fact | None = None


@dataclass
class Validation:
    """Facts a model validated, corrected or rejected."""

    query: str = ""
    accepted: list[Checked] = field(default_factory=list)
    rejected: list[Checked] = field(default_factory=list)
    model: str = ""
    at: str = ""

    @property
    def all_rejected(self) -> bool:
        return bool(self.rejected) and not self.accepted

    def to_dict(self) -> dict:
        return asdict(self)

    def notice(self) -> str:
        """What to tell the user; empty if nothing was accepted."""
        lines = []
        for c in self.accepted:
            was = f" (from ({', '.join(c.original)}))" if c.original else ""
            lines.append(f"- [{c.status}] ({', '.join(c.fact)}){was}")
        return "New facts:\n" + "\n".join(lines) if lines else ""


def read_validation(reply: str | None, query: str = "", model: str = "", now: datetime | None = None) -> Validation:
    """Validated, corrected and rejected facts of a reply; a fact that is rejected anywhere is rejected.

    A reply without JSON yields no facts at all. Facts given as text are skipped.
    """
    out = Validation(query=query, model=model, at=(now or datetime.now(timezone.utc)).isoformat())
    body = json_in(reply) or {}
    entries = lambda k: [e for e in body.get(k) or [] if isinstance(e, dict)]
    for e in entries("rejected"):
        if (f := as_fact(e.get("triplet"))) is not None:
            out.rejected.append(Checked(f, "rejected", str(e.get("reason") or "")))
    refused = {c.fact for c in out.rejected}
    for e in entries("validated"):
        if (f := as_fact(e.get("triplet"))) is not None and f not in refused:
            out.accepted.append(Checked(f, "validated", str(e.get("reason") or "")))
    for e in entries("corrected"):
        f, original = as_fact(e.get("corrected")), as_fact(e.get("original"))
        if f is not None and f not in refused:
            out.accepted.append(Checked(f, "corrected", str(e.get("reason") or ""), original))
    return out


def validate(facts: list[Fact], query: str, model: ChatModel, now: datetime | None = None) -> Validation:
    """Ask a model about facts; if the model fails, all are rejected."""
    if not facts:
        return Validation(query=query, model=model.name)
    try:
        reply = model.reply(prompts.messages("validation", query=query, facts=numbered(facts)), temperature=0.1, max_tokens=1024)
    except Exception as failure:  # any failure of a model means no fact is accepted
        return Validation(query=query, rejected=[Checked(f, "rejected", str(failure)) for f in facts], model="error")
    return read_validation(reply, query, model.name, now)


def validate_batch(batches: list[tuple[str, list[Fact]]], model: ChatModel) -> list[Validation]:
    return [validate(facts, query, model) for query, facts in batches]


def numbered(facts: list[Fact]) -> str:
    return "\n".join(f"{k}. ({s}, {p}, {o})" for k, (s, p, o) in enumerate(facts, 1))


def bulleted(lines: list[str]) -> str:
    return "\n".join(f"- {x}" for x in lines)


@dataclass
class Assessment:
    sufficient: bool = False
    label: str = "INSUFFICIENT"
    confidence: float = 0.0
    answer: str = ""
    missing: list[str] = field(default_factory=list)
    proposed: list[Fact] = field(default_factory=list)


def read_assessment(reply: str | None) -> Assessment:
    """Whether known facts suffice; unknown labels and unreadable replies mean they do not."""
    body = json_in(reply)
    if body is None:
        return Assessment()
    label = str(body.get("assessment") or "").upper()
    label = label if label in ("SUFFICIENT", "INSUFFICIENT") else "INSUFFICIENT"
    try:
        confidence = min(1.0, max(0.0, float(body.get("confidence", 0.5))))
    except (TypeError, ValueError):
        confidence = 0.5
    proposed = [f for f in map(as_fact, body.get("proposed_triplets") or []) if f is not None]
    return Assessment(label == "SUFFICIENT", label, confidence, str(body.get("answer") or ""), [str(m) for m in body.get("missing_information") or []], proposed)


def read_reproposal(reply: str | None, previous: list[Fact]) -> list[Fact]:
    """Newly proposed facts; the previous ones if there are none or the reply can't be read."""
    proposed = [f for f in map(as_fact, (json_in(reply) or {}).get("proposed_triplets") or []) if f is not None]
    return proposed or previous


def read_justification(reply: str | None, facts: list[Fact]) -> list[Fact]:
    """The facts to persist; all of them if the reply can't be read or names none either way."""
    body = json_in(reply)
    pick = lambda k: [f for f in (as_fact(e.get("triplet")) for e in (body or {}).get(k) or [] if isinstance(e, dict)) if f is not None]
    keep, skip = pick("persist"), pick("skip")
    if body is None or not (keep or skip):
        return list(facts)
    return [f for f in facts if f in set(keep)]
