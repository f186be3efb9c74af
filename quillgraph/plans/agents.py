"""Agents: what answers a prompt with an object of a given JSON schema; and stand-ins without a model."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable
from typing import Any, Protocol


class AgentError(RuntimeError):
    """The agent gave no usable answer."""


class StructuredAgent(Protocol):
    def answer(self, prompt: str, schema: dict) -> Any: ...


class CommandAgent:
    """A command that reads the prompt on its standard input and prints one JSON object.

    The schema is handed over as the last argument. A time-out, a failure and an answer that is no JSON are AgentErrors.
    """

    def __init__(self, command: list[str], timeout: float = 600):
        self.command, self.timeout = command, timeout

    def answer(self, prompt: str, schema: dict) -> Any:
        try:
            done = subprocess.run([*self.command, json.dumps(schema)], input=prompt, capture_output=True, text=True, timeout=self.timeout, check=False)
        except (OSError, subprocess.TimeoutExpired) as e:
            raise AgentError(str(e)) from e
        if done.returncode:
            raise AgentError(f"exit code {done.returncode}: {done.stderr.strip()[-500:]}")
        try:
            return json.loads(done.stdout)
        except ValueError as e:
            raise AgentError(f"the answer is no JSON: {e}") from e


class ScriptedAgent:
    """Answers from a function of the prompt, or from a list in order; for tests and dry runs."""

    def __init__(self, answers: Callable[[str, dict], Any] | list[Any]):
        self.answers, self.prompts = answers, []

    def answer(self, prompt: str, schema: dict) -> Any:
        self.prompts.append(prompt)
        if callable(self.answers):
            return self.answers(prompt, schema)
        if not self.answers:
            raise AgentError("no answer is left")
        return self.answers.pop(0)


def json_schema(kind, optional: frozenset[str] = frozenset()) -> dict:
    """A JSON schema of a Spark type, for agents; unknown fields are forbidden."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StructType):
        return {
            "type": "object", "additionalProperties": False, "properties": {f.name: json_schema(f.dataType, optional) for f in kind.fields}, "required": [f.name for f in kind.fields if f.name not in optional],
        }
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType, optional)}
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return {"type": "integer"}
    return {"type": "string"}
