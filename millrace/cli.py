"""python -m millrace.cli init | ingest | ask | eval"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from dataclasses import asdict
from pathlib import Path

from millrace import providers, runner
from millrace.agent import Agent
from millrace.errors import MillraceError
from millrace.index import Index
from millrace.operators import evaluate
from millrace.session import session
from millrace.sources import evalsets, settings


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"at": self.formatTime(record), "level": record.levelname, "name": record.name, "message": record.getMessage()})


def log_to_stderr(level: str, as_json: bool) -> None:
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(_Json() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    logging.basicConfig(level=level.upper(), handlers=[handler], force=True)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("--config", default="millrace.yaml")
    commands = parser.add_subparsers(dest="command", required=True)
    init = commands.add_parser("init", help="write a settings file")
    init.add_argument("--force", action="store_true")
    ingest = commands.add_parser("ingest", help="index a folder")
    ingest.add_argument("--repo", required=True)
    ingest.add_argument("--id", required=True)
    ingest.add_argument("--prune", action="store_true", help="take out chunks that the folder no longer has")
    ask = commands.add_parser("ask", help="answer a question")
    ask.add_argument("question")
    ask.add_argument("--repo-id", required=True)
    measure = commands.add_parser("eval", help="measure answers")
    measure.add_argument("--repo-id", required=True)
    measure.add_argument("--dataset", required=True)
    measure.add_argument("--k", type=int, default=10)
    measure.add_argument("--out")
    return parser


def main(args: list[str] | None = None) -> int:
    given = _parser().parse_args(args)
    try:
        return _run(given)
    except MillraceError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


def _run(given: argparse.Namespace) -> int:
    if given.command == "init":
        import yaml

        path = Path(given.config)
        if path.exists() and not given.force:
            print(f"error: {path} is there; use --force", file=sys.stderr)
            return 1
        path.write_text(yaml.safe_dump(json.loads(json.dumps(asdict(settings.Settings()))), sort_keys=False))
        print(path)
        return 0
    own = settings.load(given.config)
    log_to_stderr(own.app.log_level, own.app.log_json)
    spark = session()
    embed = providers.embedder(own.embeddings.provider, dimension=own.embeddings.dimension)
    index = Index(spark, own.storage.root_dir, embed)
    if given.command == "ingest":
        for name, n in index.ingest(given.repo, given.id, list(own.ingestion.ignore_patterns), prune=given.prune).items():
            print(f"{name}: {n}")
        return 0
    if given.command == "eval":
        cases, rates = evalsets.cases(spark, given.dataset), evalsets.rates(spark, own.eval.cost_rates_path)
    chat = providers.chat_model(own.chat.provider)
    agent = Agent(index, chat, given.repo_id)
    if given.command == "ask":
        answer = agent.ask(given.question)
        print(answer.text)
        for c in answer.citations:
            print(f"  {c['path']}:{c['start_line']}-{c['end_line']}" + (f" {c['symbol']}" if c["symbol"] else ""))
        print(f"{answer.latency_ms} ms, {answer.usage.prompt + answer.usage.completion} tokens")
        return 0
    run_id, measured, summary = runner.run(spark, agent, chat, cases, index.chunks.read(), rates, own.chat.provider, own.chat.model, given.k)
    for path in evaluate.report(measured, summary, run_id, given.out or own.eval.reports_dir):
        print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
