"""Command line: version, new, validate, run, eval."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import spec as specs

VERSION = "0.1.0"


def _template(name: str) -> specs.Spec:
    return specs.from_dict({"name": name, "seed": 1, "scenario": {"question_id": name, "prompt": "Replace this with the question.", "options": ["Agree", "Disagree", "Neither"]}})


def _new(args) -> int:
    path = Path(args.path or f"{args.name}.json")
    if path.exists() and not args.force:
        print(f"{path} exists (--force overwrites)", file=sys.stderr)
        return 1
    path.parent.mkdir(parents=True, exist_ok=True)
    specs.dump(_template(args.name), path)
    print(path)
    return 0


def _loaded(path: str) -> specs.Spec | None:
    try:
        return specs.load(path)
    except (OSError, ValueError) as e:
        print(f"{path}: {e}", file=sys.stderr)
        return None


def _validate(args) -> int:
    found = _loaded(args.spec)
    if found is None:
        return 1
    print(f"{args.spec}: valid, fingerprint {found.fingerprint()}, arms {', '.join(found.scenario.questions())}")
    return 0


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("popspark").getOrCreate()


def _microdata(spark, path: str | None):
    if not path:
        return None
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True)


def _population_inputs(spark, found: specs.Spec):
    from .functions.harmonize import TAXONOMY
    from .sources.targets import Targets

    return TAXONOMY, Targets.load(spark, found.population.targets, TAXONOMY), _microdata(spark, found.population.microdata)


def _run(args) -> int:
    found = _loaded(args.spec)
    if found is None:
        return 1
    from .plans import simulate
    from .publish.report import publish

    spark = _session()
    taxonomy, targets, microdata = _population_inputs(spark, found)
    result = simulate.run(spark, found, taxonomy, targets, microdata)
    for path in publish(result, args.out):
        print(path)
    return 0


def _eval(args) -> int:
    base = _loaded(args.spec)
    if base is None:
        return 1
    from pyspark.sql import functions as F

    from .lineage import cut
    from .plans import backtest, simulate
    from .publish import report
    from .sources.targets import QuestionBank

    engines = args.engines.split(",") if args.engines else list(backtest.ENGINES)
    unknown = sorted(set(engines) - set(backtest.ENGINES))
    if unknown:
        print(f"unknown engines: {', '.join(unknown)}", file=sys.stderr)
        return 1
    spark = _session()
    taxonomy, targets, microdata = _population_inputs(spark, base)
    bank = QuestionBank.load(spark, args.bank)
    rows = cut(backtest.run(spark, base.to_dict(), engines, bank.questions, lambda s: simulate.synthesize(spark, s, targets, microdata), taxonomy.attributes, args.only.split(",") if args.only else ()), "grid")
    contrast = bank.questions.groupBy("question_id", "option").agg(F.max("option_ix").alias("contrast_ix"))
    experiments = bank.experiments.join(contrast, (F.col("arms")[0] == F.col("question_id")) & (F.col("contrast_option") == F.col("option"))).select("id", "arms", "contrast_ix")
    board = [r.asDict() for r in backtest.leaderboard(rows, experiments).collect()]
    focus = "hybrid" if "hybrid" in engines else engines[0]
    gaps = [r.asDict() for r in backtest.gaps(rows, experiments).where(F.col("engine") == focus).collect()]
    out = Path(args.out)
    out.mkdir(parents=True, exist_ok=True)
    (out / "accuracy.md").write_text(report.accuracy(board, gaps, [r.asDict() for r in backtest.worst(rows, focus).collect()]), encoding="utf-8")
    (out / "eval.json").write_text(json.dumps(board, indent=2, sort_keys=True), encoding="utf-8")
    print(out / "accuracy.md")
    if args.check:
        missed = backtest.failures(spark, spark.createDataFrame(board, backtest.leaderboard(rows, experiments).schema), focus, base.predictor.provider.name != "stub").collect()
        for r in missed:
            print(f"gate {r['metric']}: {report.number(r['value'])}, {r['kind']} {r['bound']}", file=sys.stderr)
        return 1 if missed else 0
    return 0


def main(argv=None) -> int:
    parser = argparse.ArgumentParser(prog="popspark")
    add = parser.add_subparsers(dest="command", required=True).add_parser
    add("version").set_defaults(do=lambda a: print(f"popspark {VERSION}") or 0)
    new = add("new")
    new.add_argument("name")
    new.add_argument("--path")
    new.add_argument("--force", action="store_true")
    new.set_defaults(do=_new)
    for name, do in (("validate", _validate), ("run", _run), ("eval", _eval)):
        one = add(name)
        one.add_argument("spec")
        one.set_defaults(do=do)
        if name != "validate":
            one.add_argument("--out", default=None if name == "run" else "artifacts")
        if name == "eval":
            one.add_argument("--bank", required=True)
            one.add_argument("--engines")
            one.add_argument("--only")
            one.add_argument("--check", action="store_true")
    args = parser.parse_args(argv)
    return args.do(args)


if __name__ == "__main__":
    sys.exit(main())
