"""Agents that call tools, and the loop of proposing, validating and persisting facts."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from factloom.plans import prompts, rendering
from factloom.plans.models import ChatModel
from factloom.plans.tools import Toolbox
from factloom.plans.validation import Checked, Fact, Validation, numbered, read_assessment, read_justification, read_reproposal, validate


def tool_call_in(reply: str) -> tuple[str, dict] | None:
    """(tool, arguments) of a reply; null if it calls none."""
    for text in re.findall(r"```(?:json)?\s*(.*?)```", reply, re.DOTALL) + [reply[reply.find("{") : reply.rfind("}") + 1]]:
        try:
            body = json.loads(text)
        except ValueError:
            continue
        name = body.get("tool") or body.get("name") if isinstance(body, dict) else None
        if name:
            return str(name), body.get("arguments") or {}
    return None


def clean_answer(reply: str) -> str:
    """A reply without fenced blocks and answer labels."""
    text = re.sub(r"```.*?```", "", reply, flags=re.DOTALL)
    return re.sub(r"^\s*(?:final answer|answer)\s*:\s*", "", text, flags=re.IGNORECASE).strip()


@dataclass
class Run:
    """What an agent did."""

    query: str
    answer: str = ""
    tool_calls: list[dict] = field(default_factory=list)
    iterations: int = 0
    validation_history: list[dict] = field(default_factory=list)
    validated_triplets: list[dict] = field(default_factory=list)
    persisted: int = 0
    warning: str | None = None

    def to_dict(self) -> dict:
        return asdict(self)


class ToolAgent:
    """Up to ``rounds`` tool calls, then an answer."""

    def __init__(self, tools: Toolbox, model: ChatModel, rounds: int = 3):
        self.tools, self.model, self.rounds = tools, model, rounds

    def run(self, question: str) -> Run:
        run = Run(question)
        messages = prompts.messages("tools", tools=rendering.tool_list(self.tools.tools()), question=question)
        for run.iterations in range(1, self.rounds + 1):
            reply = self.model.reply(messages)
            call = tool_call_in(reply)
            if call is None:
                run.answer = clean_answer(reply)
                return run
            result = self.tools.call(*call)
            run.tool_calls.append({"iteration": run.iterations, "tool": call[0], "arguments": call[1], "result": json.loads(result)})
            messages = [*messages, {"role": "assistant", "content": reply}, {"role": "user", "content": f"Result: {result}"}]
        run.answer = clean_answer(self.model.reply([*messages, {"role": "user", "content": "Answer now, without tools."}]))
        return run


def _key(fact: Fact) -> str:
    return re.sub(r"[ _()]", "", ", ".join(fact).lower()).replace(",", "|")


class ValidatingAgent:
    """Searches, asks whether the facts suffice, has proposed facts validated by a second model, answers and persists.

    Validated facts are shown to every later assessment.
    """

    def __init__(self, tools: Toolbox, model: ChatModel, checker: ChatModel | None, cycles: int = 3, retries: int = 3, auto_expand: bool = True):
        self.tools, self.model, self.checker, self.cycles, self.retries, self.auto_expand = tools, model, checker, cycles, retries, auto_expand

    def run(self, question: str) -> Run:
        run = Run(question)
        gained: list[Checked] = []
        seen: set[str] = set()
        facts: list[Fact] = []
        for run.iterations in range(1, self.cycles + 1):
            arguments = {"query": question, "top_k": 10}
            found = json.loads(self.tools.call("search_knowledge_graph", arguments))
            run.tool_calls.append({"iteration": run.iterations, "tool": "search_knowledge_graph", "arguments": arguments, "knowledge_iteration": run.iterations, "result": found})
            facts = [(f["subject"], f["predicate"], f["object"]) for f in found.get("facts", [])]
            seen |= {_key(f) for f in facts}
            context = numbered(facts + [c.fact for c in gained])
            assessment = read_assessment(self.model.reply(prompts.messages("assessment", context=context, question=question)))
            fresh = list({_key(f): f for f in assessment.proposed if _key(f) not in seen}.values())
            if assessment.sufficient or not self.auto_expand or not fresh or self.checker is None:
                break
            seen |= {_key(f) for f in fresh}
            result = self._validated(fresh, question, run)
            if not result.accepted:
                run.warning = "no proposed fact was accepted"
                break
            gained += result.accepted
        stored = numbered(facts)
        if gained:
            prompt = prompts.fill("supplement", context=stored, count=len(gained), model=self.checker.name, added=numbered([c.fact for c in gained]), question=question)
        else:
            prompt = prompts.fill("answer", context=stored, question=question)
        run.answer = clean_answer(self.model.reply([{"role": "user", "content": prompt}]))
        run.validated_triplets = [{"triplet": list(c.fact), "status": c.status, "reason": c.reason, "original": list(c.original) if c.original else None} for c in gained]
        if gained:
            reply = self.model.reply(prompts.messages("justification", query=question, facts=numbered([c.fact for c in gained])))
            keep = set(read_justification(reply, [c.fact for c in gained]))
            run.persisted = self.tools.persist([c for c in gained if c.fact in keep], "remote_validated")
        return run

    def _validated(self, facts: list[Fact], question: str, run: Run) -> Validation:
        """The first validation that accepts anything; rejected facts are proposed anew, up to ``retries`` times."""
        result = Validation()
        for attempt in range(1, self.retries + 1):
            result = validate(facts, question, self.checker)
            run.validation_history.append({"attempt": attempt, "proposed": [list(f) for f in facts], "validated": [list(c.fact) for c in result.accepted], "rejected": [list(c.fact) for c in result.rejected], "all_rejected": result.all_rejected, "remote_model": result.model})
            if result.accepted:
                break
            rejected = "\n".join(f"({', '.join(c.fact)}): {c.reason}" for c in result.rejected)
            facts = read_reproposal(self.model.reply(prompts.messages("reproposal", rejected=rejected, query=question)), facts)
        return result
