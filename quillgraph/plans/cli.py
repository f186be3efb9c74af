"""Commands build, search, normalize, extract, papers: one JSON object on standard output; exit codes 0 ok, 1 invalid, 2 error."""

from __future__ import annotations

import argparse
import json
import shlex
import sys

from pyspark.sql import SparkSession

from ..functions.embedders import Embedder, EmbeddingError, HashEmbedder, SentenceModelEmbedder
from ..operators.chunking import DEFAULT_MAX_TOKENS
from ..operators.graph import GraphError
from ..operators.traversal import SearchConfig
from ..sources import corpus, index_store
from .agents import AgentError, CommandAgent
from .build_index import Rejected, build_index
from .extract import extract
from .normalize import normalize
from .search_papers import ModelMismatch, search, search_to_tables

OK, INVALID, ERROR = 0, 1, 2
VERSION = "0.2.0"
DEFAULT_MODEL = "Qwen/Qwen3-Embedding-0.6B"


def positive(text: str) -> int:
    if (value := int(text)) < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return value


def non_negative(text: str) -> int:
    if (value := int(text)) < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return value


def share(text: str) -> float:
    if not 0 <= (value := float(text)) <= 1:
        raise argparse.ArgumentTypeError("must be between 0 and 1")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillgraph")
    top.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *, embedder: bool = False, agent: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("--data-dir", default="data")
        p.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
        if embedder:
            p.add_argument("--embedder", choices=["model", "fake"], default="model")
            p.add_argument("--embedding-model", default=None)
        if agent:
            p.add_argument("--agent", required=True, help="command that reads a prompt and prints JSON")
            p.add_argument("--model", default=None, help="model that the agent's command is to use")
            p.add_argument("--max-attempts", type=positive, default=3)
        return p

    command("build", embedder=True).add_argument("--max-tokens", type=positive, default=DEFAULT_MAX_TOKENS)
    p = command("search", embedder=True)
    p.add_argument("queries", nargs="+", metavar="QUERY")
    base = SearchConfig()
    p.add_argument("--top-k", type=positive, default=base.top_k)
    p.add_argument("--max-hops", type=non_negative, default=base.max_hops)
    p.add_argument("--max-graph-candidates", type=non_negative, default=base.max_graph_candidates)
    p.add_argument("--generic-concept-threshold", type=share, default=base.generic_concept_threshold)
    p.add_argument("--output", default=None, help="folder for the result as tables; without it, it is printed")
    p = command("normalize", embedder=True, agent=True)
    p.add_argument("--neighbors", type=positive, default=5)
    p.add_argument("--concurrency", type=positive, default=4)
    command("extract", agent=True).add_argument("paper_id", type=positive)
    command("papers")
    return top


def _agent(args: argparse.Namespace) -> CommandAgent:
    return CommandAgent([*shlex.split(args.agent), *(["--model", args.model] if args.model else [])])


def _embedder(args: argparse.Namespace, stored: str | None = None) -> Embedder:
    return HashEmbedder() if args.embedder == "fake" else SentenceModelEmbedder(args.embedding_model or stored or DEFAULT_MODEL)


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[int, dict]:
    """(exit code, what to print)."""
    d = args.data_dir
    try:
        if args.command == "build":
            return OK, {"status": "ok"} | build_index(spark, d, _embedder(args), args.max_tokens) | {"paths": index_store.artifact_paths(d)}
        if args.command == "search":
            config = SearchConfig(top_k=args.top_k, max_hops=args.max_hops, max_graph_candidates=args.max_graph_candidates, generic_concept_threshold=args.generic_concept_threshold)
            stored = None if args.embedder == "fake" or args.embedding_model else index_store.read_manifest(spark, d).embedding_model
            if args.output:
                return OK, {"status": "ok", "tables": search_to_tables(spark, d, args.queries, _embedder(args, stored), args.output, config)}
            return OK, {"status": "ok"} | search(spark, d, args.queries, _embedder(args, stored), config)
        if args.command == "normalize":
            return OK, {"status": "ok"} | normalize(spark, d, _agent(args), _embedder(args), args.neighbors, args.max_attempts, args.concurrency)
        if args.command == "extract":
            done = extract(spark, d, args.paper_id, _agent(args), args.max_attempts)
            e = done["extraction"]
            return OK, {"status": "ok", "paper_id": e["paper_id"], "attempts": done["attempts"], "path": done["path"]} | {n: len(e.get(n) or ()) for n in ("concepts", "paper_concepts", "concept_relations")}
        return OK, {"status": "ok", "papers": [{"id": r["paper_id"], "title": r["title"]} for r in corpus.paper_ledger(spark, d).orderBy("corpus_pos").collect()]}
    except ModelMismatch as e:
        # fixed values: the fields of this answer
        return INVALID, {"status": "invalid", "reason": "embedding_model_mismatch", "index_model": e.index_model, "embedder_model": e.embedder_model, "message": str(e)}
    except Rejected as e:
        more = {"total": e.total, "all_findings": e.table} if e.table else {}
        return INVALID, {"status": "invalid"} | _rejection(args, e) | more
    except (corpus.SourceError, AgentError, EmbeddingError, GraphError, ValueError) as e:
        return ERROR, {"status": "error", "message": str(e)}


def _rejection(args: argparse.Namespace, e: Rejected) -> dict:
    """What was wrong, by command: build has a reason, normalize a stage, and both agent commands their attempts."""
    if args.command == "extract":
        return {"attempts": args.max_attempts, "issues": e.rows}
    if args.command == "normalize":
        return {"stage": e.reason, "attempts": args.max_attempts, "issues": e.rows}
    if e.reason == "extraction_mismatch":
        papers: dict[int, list[dict]] = {}
        for r in e.rows:
            papers.setdefault(r["paper_id"], []).append({"path": r["path"], "message": r["message"]})
        return {"reason": e.reason, "papers": [{"paper_id": p, "issues": i} for p, i in papers.items()]}
    return {"reason": e.reason, "unresolved" if e.reason == "unresolved_evidence" else "issues": e.rows}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    code, payload = run(SparkSession.builder.appName("quillgraph").getOrCreate(), args)
    sys.stdout.write(json.dumps(payload, ensure_ascii=False, indent=2, default=str) + "\n")
    return code


if __name__ == "__main__":
    sys.exit(main())
