"""Command line: ``python -m factloom.plans.cli index|search|entity|expand|stats|query|answer|chat STORE ...``.

``answer`` and ``chat`` need a chat model: ``--model package.module:name`` names an object, or a function that makes one.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable
from importlib import import_module

from pyspark.sql import functions as F

from factloom.operators.graph import graph_report
from factloom.operators.stats import source_counts, top_counts
from factloom.plans import rendering
from factloom.plans.agent import Run, ToolAgent
from factloom.plans.models import ChatModel, HashedEmbedder
from factloom.plans.retrieval import Generator, index_facts, stored_index
from factloom.plans.tools import Toolbox
from factloom.session import local_session, ship
from factloom.sources.files import load_facts
from factloom.sources.store import FactStore

#: Tool of a command and the name of the argument its text becomes.
TOOL_OF = {"search": ("search_knowledge_graph", "query"), "entity": ("query_entity", "entity"), "expand": ("expand_entity", "entity"), "query": ("run_cypher", "query")}


def load_model(name: str) -> ChatModel:
    """The object that ``package.module:name`` names; a function or class is called without arguments."""
    module, _, attribute = name.partition(":")
    found = getattr(import_module(module), attribute)
    return found if hasattr(found, "reply") and not isinstance(found, type) else found()


def chat(tools: Toolbox, model: ChatModel, lines: Iterable[str], say: Callable[[str], None] = print) -> list[Run]:
    """Answer questions line by line; lines with a slash are commands (``/help`` lists them). Returns the runs."""
    agent, runs = ToolAgent(tools, model), []

    def stats() -> str:
        return f"{tools.store.size()} facts, {len(runs)} questions"

    commands = {
        "/help": lambda: "\n".join(sorted(commands)),
        "/tools": lambda: rendering.tool_list(tools.tools()),
        "/stats": stats,
        "/last": lambda: json.dumps(runs[-1].to_dict(), ensure_ascii=False) if runs else "no question yet",
        "/history": lambda: "\n".join(f"{k}. {r.query}" for k, r in enumerate(runs[-10:], 1)) or "no question yet",
        "/quit": lambda: "",
    }
    for line in map(str.strip, lines):
        if line == "/quit":
            break
        if line.startswith("/"):
            say(commands.get(line.split()[0], lambda: "unknown command, see /help")())
        elif line:
            runs.append(agent.run(line))
            say(runs[-1].answer)
    return runs


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, extra in (("index", ["input"]), *((c, ["text"]) for c in TOOL_OF), ("stats", []), ("answer", ["text"]), ("chat", [])):
        sub = commands.add_parser(name)
        sub.add_argument("store")
        for argument in extra:
            sub.add_argument(argument, nargs="+" if name == "answer" else None)
        sub.add_argument("--top-k", type=int, default=5)
        if name in ("answer", "chat"):
            sub.add_argument("--model", required=True)
            sub.add_argument("--expand", action="store_true", help="let the model propose facts beyond the ones found")
            sub.add_argument("--save", help="folder for the answers as JSON lines")
    options = parser.parse_args(argv)
    spark = local_session()
    ship(spark)
    store, embedder = FactStore(spark, options.store), HashedEmbedder()
    if options.command == "index":
        index_facts(store, load_facts(spark, options.input).withColumn("row_id", F.monotonically_increasing_id()), embedder)
        store.save_config(embedding_model="hashed", embedding_dim=embedder.dim, representation_mode="triplet_text")
        print(f"{store.size()} facts")
    elif options.command == "stats":
        facts = store.read().withColumn("row_id", F.coalesce("row_id", F.lit(0)))
        for table in (graph_report(facts), top_counts(facts, "predicate", 5), source_counts(facts)):
            print(rendering.result_table(table))
    elif options.command == "answer":
        generator = Generator(stored_index(store.read(), embedder), embedder, load_model(options.model))
        answers = generator.answer_all(options.text, k=options.top_k, expand=options.expand)
        for a in answers:
            print(f"{a.query}\n{a.answer}")
        if options.save:
            print(json.dumps(generator.save(answers, options.save)))
    elif options.command == "chat":
        chat(Toolbox(spark, store, embedder, load_model(options.model)), load_model(options.model), sys.stdin)
    else:
        tool, argument = TOOL_OF[options.command]
        print(Toolbox(spark, store, embedder).call(tool, {argument: options.text, "top_k": options.top_k}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
