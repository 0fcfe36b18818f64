"""Wording of the prompts; the JSON that is asked for is what :mod:`factloom.plans.validation` reads."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

NO_CONTEXT = "There are no stored facts about this."
EXPANDED_MARK = "--- facts proposed by a model ---"

TEMPLATES = {
    "answer": "Answer from these facts only; say so if they do not tell.\nFacts:\n{context}\n\nQuestion: {question}\nAnswer:",
    "supplement": "Answer the question. Stored facts:\n{context}\n{count} facts were added and checked by {model}:\n{added}\n\nQuestion: {question}\nAnswer:",
    "expansion": "Stored facts:\n{context}\nRelations in use:\n{relations}\nPropose up to {limit} further facts on the question, one per line as (subject, predicate, object).\nQuestion: {question}",
    "assessment": 'Do these facts answer the question? Reply with JSON {{"assessment": "SUFFICIENT" or "INSUFFICIENT", "confidence": 0 to 1, "answer": text, "missing_information": [text], "proposed_triplets": [[subject, predicate, object]]}}.\nFacts:\n{context}\nQuestion: {question}',
    "validation": 'Check these facts. Reply with JSON {{"validated": [{{"triplet": [s, p, o], "reason": text}}], "corrected": [{{"original": [s, p, o], "corrected": [s, p, o], "reason": text}}], "rejected": [{{"triplet": [s, p, o], "reason": text}}]}}.\nQuestion: {query}\nFacts:\n{facts}',
    "reproposal": 'All these facts were rejected:\n{rejected}\nPropose better ones for the question as JSON {{"proposed_triplets": [[s, p, o]], "reasoning": text}}.\nQuestion: {query}',
    "justification": 'Which of these facts are worth keeping? Reply with JSON {{"persist": [{{"triplet": [s, p, o], "reason": text}}], "skip": [{{"triplet": [s, p, o], "reason": text}}]}}.\nQuestion: {query}\nFacts:\n{facts}',
    "tools": 'Tools:\n{tools}\nTo use one reply with JSON {{"tool": name, "arguments": {{...}}}}; else reply with the answer.\nQuestion: {question}',
}


@lru_cache(maxsize=64)
def template(name: str, folder: str | None = None) -> str:
    """A template by name, from a folder of ``<name>.txt`` files if one is given. Unknown or empty templates raise ValueError."""
    text = (Path(folder) / f"{name}.txt").read_text(encoding="utf-8") if folder else TEMPLATES.get(name, "")
    if not text.strip():
        raise ValueError(f"prompt template {name!r} is unknown or empty")
    return text


def fill(name: str, **values) -> str:
    if not str(values.get("context", "x")).strip():
        values["context"] = NO_CONTEXT
    return template(name).format(**values)


def messages(name: str, **values) -> list[dict[str, str]]:
    return [{"role": "system", "content": "You work on a knowledge graph of facts (subject, predicate, object)."}, {"role": "user", "content": fill(name, **values)}]
