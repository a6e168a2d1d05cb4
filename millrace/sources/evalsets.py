"""Evaluation cases and rate cards from YAML."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import EvalError
from millrace.schema import CASES, RATES


def _yaml(path: str) -> Any:
    import yaml

    try:
        return yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as error:
        raise EvalError("can't be read", {"path": path, "error": str(error)}) from error


def cases(spark: SparkSession, path: str) -> DataFrame:
    """The list under ``cases``; each needs its own case_id, a repo_id and a question."""
    found = _yaml(path)
    if not isinstance(found, dict) or not isinstance(found.get("cases"), list):
        raise EvalError("a list named cases is needed", {"path": path})
    rows, seen = [], set()
    lists = ("expected_files", "expected_symbols", "expected_answer_traits")
    for i, case in enumerate(found["cases"]):
        where = {"path": path, "index": i}
        if not isinstance(case, dict) or set(case) - {"case_id", "repo_id", "question", *lists}:
            raise EvalError("not a case", where)
        texts = [case.get(k) for k in ("case_id", "repo_id", "question")]
        more = [case.get(k) or [] for k in lists]
        if not all(isinstance(x, str) and x for x in texts) or not all(isinstance(x, list) and all(isinstance(y, str) for y in x) for x in more):
            raise EvalError("a case with a field that does not hold", where)
        if texts[0] in seen:
            raise EvalError("a case_id twice", where | {"case_id": texts[0]})
        seen.add(texts[0])
        rows.append((*texts, *more))
    return spark.createDataFrame(rows, CASES)


def rates(spark: SparkSession, path: str) -> DataFrame:
    """A map of providers to models to prompt_per_1k and completion_per_1k."""
    found = _yaml(path)
    rows = []
    if not isinstance(found, dict):
        raise EvalError("a map of providers is needed", {"path": path})
    for provider, models in found.items():
        if not isinstance(models, dict):
            raise EvalError("a map of models is needed", {"provider": provider})
        for model, rate in models.items():
            parts = [rate.get(k) if isinstance(rate, dict) else None for k in ("prompt_per_1k", "completion_per_1k")]
            if not all(isinstance(x, (int, float)) and not isinstance(x, bool) and x >= 0 for x in parts):
                raise EvalError("a rate that does not hold", {"provider": provider, "model": model})
            rows.append((str(provider), str(model), *map(float, parts)))
    return spark.createDataFrame(rows, RATES)
