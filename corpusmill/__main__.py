"""python -m corpusmill compile|infer|metrics|profile|build|dry-run …: the plans from a shell."""

from __future__ import annotations

import argparse
import importlib
import json
import logging
import os
import sys
import time

from pyspark.sql import SparkSession

from corpusmill.functions.tokens import WhitespaceTokenizer
from corpusmill.plans import build
from corpusmill.sources import readers


def factory(name: str):
    """The function `module:name` that makes a model in a worker (batch of prompts -> batch of answers)."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusmill")
    parser.add_argument("--log-level", default="INFO")
    parser.add_argument("--log-dir", default="", help="a folder for a log file of this run, beside the console; only the driver logs")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, args in {"compile": ("predictions", "--out", "--errors", "--classpath", "--java-dir", "--store"), "infer": ("prompts", "model", "--out", "--label", "--run", "--n", "--batch", "--score"), "metrics": ("prompts", "predictions", "--model", "--n", "--flat"), "profile": ("table",), "build": ("config",), "dry-run": ("config",)}.items():
        p = commands.add_parser(name)
        for a in args:
            p.add_argument(a, **({"action": "store_true"} if a in ("--flat", "--score") else {"default": ""} if a.startswith("--") else {}))
    a = parser.parse_args(argv)
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if a.log_dir:
        os.makedirs(a.log_dir, exist_ok=True)
        handlers.append(logging.FileHandler(os.path.join(a.log_dir, f"{a.command}-{time.strftime('%Y%m%d-%H%M%S')}.log"), encoding="utf-8"))
    logging.basicConfig(level=a.log_level, format="%(asctime)s %(levelname)s %(message)s", handlers=handlers, force=True)
    began = time.monotonic()
    spark = SparkSession.builder.appName("corpusmill").getOrCreate()
    if a.command == "compile":
        build.compile_report(spark, a.predictions, a.out or None, a.errors or None, a.classpath, a.java_dir or None, a.store or None)[0].show()
    elif a.command == "infer":
        path, scores = build.infer(readers.read_table(spark, a.prompts), factory(a.model), a.out or ".", a.label or a.model.rpartition(":")[2], a.run or "1", int(a.n) if a.n else None, int(a.batch or 128), a.score)
        logging.info("predictions are in %s", path)
        if scores is not None:
            scores.show(truncate=False)
    elif a.command == "metrics":
        predictions = readers.read_predictions(spark, a.predictions).withColumnRenamed("original_idx", "idx")
        build.evaluate(readers.read_table(spark, a.prompts), predictions, a.model or "chatml", cascade=not a.flat, n=int(a.n) if a.n else None).show(truncate=False)
    elif a.command == "profile":
        build.profile_lengths(readers.read_table(spark, a.table), WhitespaceTokenizer()).show()
    else:
        with open(a.config, encoding="utf-8") as f:
            config = json.load(f)
        if a.command == "build":
            build.build_datasets(spark, config, WhitespaceTokenizer()).groupBy("split").count().show()
        else:
            for df in build.dry_run(spark, config, WhitespaceTokenizer()).values():
                df.show(truncate=False)
    logging.info("%s took %.1f s", a.command, time.monotonic() - began)
    return 0


if __name__ == "__main__":
    sys.exit(main())
