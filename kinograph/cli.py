"""``python -m kinograph.cli STEP --config FILE``: one step of the pipeline, or all. Exit codes: 0 done, 1 failed, 130 interrupted."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time
from pathlib import Path

from kinograph.operators.training import Training
from kinograph.plans.pipeline import Config, Pipeline
from kinograph.session import create_session

STEPS = ("prepare-cohort", "prepare-input-data", "extract-graph-scenes", "extract-description-scenes", "embed-representations", "prepare-module", "run-recommendation", "run-diagnosis", "all")


def load_config(path: str) -> Config:
    """Settings from a JSON file, or a YAML file where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise ValueError("no YAML reader is installed; use JSON") from error
        values = yaml.safe_load(text)
    else:
        values = json.loads(text)
    if not isinstance(values, dict):
        raise ValueError("settings must be an object")
    for name in ("penalties", "seeds"):
        if name in values:
            values[name] = tuple(values[name])
    experiments = values.get("experiments", [])
    known = {"": (values, Config), "training": (values.get("training", {}), Training)}
    unknown = [f"{name}.{x}".strip(".") for name, (given, kind) in known.items() for x in given if x not in kind.__dataclass_fields__]
    unknown += [f"experiments.{x}" for e in experiments for x in e if x not in ("label", "source")]
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(set(unknown)))}")
    if "experiments" in values:
        values["experiments"] = tuple((e["label"], e["source"]) for e in experiments)
    if "training" in values:
        values["training"] = Training(**values["training"])
    return Config(**values)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("step", choices=STEPS)
    parser.add_argument("--config", required=True)
    parser.add_argument("--force", action="store_true", help="run the step again even if its result is there")
    options = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    began = time.monotonic()
    try:
        pipeline = Pipeline(create_session(), load_config(options.config), force=options.force)
        steps = {
            "extract-graph-scenes": lambda: pipeline.extract_scenes("graph"), "extract-description-scenes": lambda: pipeline.extract_scenes("description"), "all": pipeline.run,
        }
        result = steps.get(options.step, getattr(pipeline, options.step.replace("-", "_"), None))()
        if isinstance(result, str):
            print(result)
        logging.info("%s took %.1f s", options.step, time.monotonic() - began)
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception:  # noqa: BLE001
        logging.exception("%s failed", options.step)
        return 1


if __name__ == "__main__":
    sys.exit(main())
