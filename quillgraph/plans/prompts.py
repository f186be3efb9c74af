"""Prompts of the agent stages: instructions, the vocabulary, one line per row, and on a retry what was wrong."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from ..functions.vocabulary import describe_vocabulary

NONE = "(none)"


def lines(rows: Iterable[str]) -> str:
    return "\n".join(rows) or NONE


def concept_line(c: dict) -> str:
    extra = [f"also: {', '.join(c['aliases'])}"] if c.get("aliases") else []
    return " | ".join([f"paper {c['paper_id']} {c['local_id']}", c["type"], c["name"], *extra, c.get("description") or ""]).rstrip(" |")


def pair_line(p: dict) -> str:
    return f"paper {p['left_paper']} {p['left_local']} ~ paper {p['right_paper']} {p['right_local']} | {p['score']:.3f}"


def normalized_line(c: dict) -> str:
    return f"{c['id']} | {c['type']} | {c['canonical_name']}"


def stated_line(r: dict) -> str:
    return f"{r['source_id']} {r['relation']} {r['target_id']} | papers {', '.join(map(str, r['paper_ids']))}"


def retry_section(previous: object | None, issues: Sequence[dict]) -> str:
    if previous is None and not issues:
        return ""
    return "\n## Your last answer was rejected\n\n" + json.dumps(previous, ensure_ascii=False, indent=1) + "\n\nProblems:\n" + lines(f"- {i['path']}: {i['message']}" for i in issues) + "\n"


def _prompt(task: str, rules: Sequence[str], sections: dict[str, str], previous: object | None, issues: Sequence[dict], vocabulary: bool = True) -> str:
    parts = [f"# Task\n\n{task}", "# Rules\n\n" + lines(f"- {r}" for r in rules)]
    if vocabulary:
        parts.append(describe_vocabulary())
    parts += [f"# {title}\n\n{body}" for title, body in sections.items()]
    return "\n\n".join(parts) + "\n" + retry_section(previous, issues)


def extraction_prompt(meta: dict, pages: Sequence[tuple[int, str]], previous: object | None = None, issues: Sequence[dict] = ()) -> str:
    return _prompt(
        "Extract a summary in Japanese, the concepts of this paper, and how paper and concepts relate.",
        ["Quote every relation word for word from one page.", "Number concepts c1, c2, ... .", "Use only the vocabulary below."],
        {"Paper": f"{meta['id']}: {meta['title']}"} | {f"Page {n}": text for n, text in pages}, previous, issues,
    )


def grouping_prompt(concepts: Sequence[dict], pairs: Sequence[dict], previous: object | None = None, issues: Sequence[dict] = ()) -> str:
    return _prompt(
        "Put concepts that may be the same into groups.",
        ["A group has at least two concepts.", "A concept is in one group at most.", "Concepts without a counterpart stay out.", "The pairs are hints by vector distance, no decision."],
        {"Concepts": lines(map(concept_line, concepts)), "Close pairs": lines(map(pair_line, pairs))}, previous, issues, vocabulary=False,
    )


def merge_prompt(group: Sequence[dict], previous: object | None = None, issues: Sequence[dict] = ()) -> str:
    return _prompt(
        "Merge the concepts of this group that are the same; keep apart those that aren't.",
        ["Every concept of the group is in exactly one merged_from.", "A type is that of one of the sources.", "An id is made of a-z, 0-9 and single hyphens."],
        {"Group": lines(map(concept_line, group))}, previous, issues,
    )


def relations_prompt(concepts: Sequence[dict], stated: Sequence[dict], previous: object | None = None, issues: Sequence[dict] = ()) -> str:
    return _prompt(
        "Add relations between concepts that are general knowledge.",
        ["Give each a rationale.", "Don't repeat what a paper states.", "No concept relates to itself."],
        {"Concepts": lines(map(normalized_line, concepts)), "Stated by papers": lines(map(stated_line, stated))}, previous, issues,
    )
