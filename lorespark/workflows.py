"""Workflows around a language model. Retrieval, aggregation and formatting are Spark; generation is a callable.

A generator takes a prompt and returns text. The default one quotes its context, so that every workflow runs offline.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

Generate = Callable[[str], str]
Tool = Callable[[str], str]
MAX_TOOL_ROUNDS = 3


def extractive(prompt: str) -> str:
    """The first paragraphs of the prompt's context."""
    return "\n\n".join(prompt.split("\n\n")[1:4])


def rag(question: str, retrieve: Callable[[str, int], str], generate: Generate = extractive, k: int = 5, shape: str | None = None) -> dict[str, Any]:
    """Retrieve, then generate, with an optional form of the answer."""
    context = retrieve(question, k)
    asked = f"Answer from the context: {question}" + (f"\nForm of the answer: {shape}" if shape else "")
    return {"question": question, "context": context, "answer": generate(f"{asked}\n\n{context}")}


def knowledge_agent(task: str, tools: dict[str, Tool], decide: Callable[[str, list[str]], tuple[str, str] | None], generate: Generate = extractive, rounds: int = MAX_TOOL_ROUNDS) -> dict[str, Any]:
    """Lets `decide` name a tool and its argument, up to a number of rounds, then generates from what the tools said."""
    said: list[str] = []
    used = 0
    while used < rounds and (step := decide(task, said)) is not None:
        name, argument = step
        said.append(tools[name](argument) if name in tools else f"no tool {name}")
        used += 1
    return {"task": task, "rounds": used, "answer": generate("\n\n".join([task, *said]))}


def call_prep(topic: str, retrieve: Callable[[str, int], str], answer: Callable[[str], str], generate: Generate = extractive) -> dict[str, Any]:
    """A briefing from a search and an answer."""
    found, said = retrieve(topic, 8), answer(topic)
    return {"topic": topic, "briefing": generate(f"Briefing on {topic}\n\n{said}\n\n{found}")}


def session_diff(before: dict[str, float], after: dict[str, float]) -> dict[str, Any]:
    """What changed between two sets of statistics."""
    keys = sorted(set(before) | set(after))
    rows = {k: after.get(k, 0) - before.get(k, 0) for k in keys}
    return {"changes": rows, "report": "\n".join(f"- {k}: {before.get(k, 0)} -> {after.get(k, 0)}" for k in keys)}


def evaluate(questions: list[dict[str, Any]], answer: Callable[[str], str], question_id: str | None = None) -> dict[str, Any]:
    """Runs questions (id, question, expected?) and counts those whose answer holds what is expected."""
    rows = []
    for q in questions:
        if question_id is None or q["id"] == question_id:
            said = answer(q["question"])
            rows.append({"id": q["id"], "ok": bool(said) and str(q.get("expected") or "").lower() in said.lower(), "tokens": len(said) // 4})
    n = len(rows)
    passed = sum(r["ok"] for r in rows)
    return {"total": n, "passed": passed, "percent": round(100 * passed / n, 1) if n else 0.0, "tokens": sum(r["tokens"] for r in rows), "rows": rows}
