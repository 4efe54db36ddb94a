"""Command line: validate and init.  Exits with 0 (clean), 1 (an error finding, or drift) or 2 (usage)."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from folioscope.deploy import ship
from folioscope.operators import findings, infer
from folioscope.operators.validate import validate_corpus
from folioscope.plans import ddl
from folioscope.plans.grammar import ContractError, CorpusConfig
from folioscope.sources.files import read_tree


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("folioscope")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("validate")
    v.add_argument("path")
    v.add_argument("--format", choices=["human", "json", "sarif"], default="human")
    v.add_argument("--config")
    v.add_argument("--contract", action="append", default=[])
    v.add_argument("--path", dest="paths", action="append", default=[])
    i = sub.add_parser("init")
    i.add_argument("dirs", nargs="+")
    i.add_argument("--meta", action="store_true")
    i.add_argument("--depth", type=int)
    i.add_argument("--relax", action="store_true")
    i.add_argument("--out")
    i.add_argument("--force", action="store_true")
    i.add_argument("--dry-run", action="store_true")
    i.add_argument("--check", action="store_true")
    for x in (v, i):
        x.add_argument("--include", "--glob", action="append", default=[])
        x.add_argument("--exclude", action="append", default=[])
    return p


def write_new(path: str, text: str, force: bool) -> None:
    if Path(path).exists() and not force:
        raise ContractError(f"{path} is there already; --force writes over it")
    Path(path).write_text(text, encoding="utf-8")


def run(argv: list[str], spark: SparkSession | None = None) -> tuple[int, str]:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return (0 if e.code == 0 else 2), ""
    spark = ship(spark or SparkSession.builder.appName("folioscope").getOrCreate())
    try:
        return validate(spark, args) if args.command == "validate" else init(spark, args)
    except (ContractError, OSError) as e:
        return 2, str(e)


def validate(spark: SparkSession, args: argparse.Namespace) -> tuple[int, str]:
    if args.config and args.contract:
        raise ContractError("either --config or --contract is expected")
    if not Path(args.path).exists():
        raise ContractError(f"{args.path} is not there")
    config = ddl.load_config_file(args.config) if args.config else ddl.inline_config(args.contract, args.paths) if args.contract else ddl.find_config(args.path)
    if config is None:
        raise ContractError("no configuration was found")
    result = validate_corpus(read_tree(spark, str(Path(args.path).resolve())), CorpusConfig(config.routes, (*config.include, *args.include), (*config.exclude, *args.exclude)))
    result.findings = result.findings.persist()
    try:
        text = {"human": findings.render_human, "json": findings.render_json, "sarif": findings.render_sarif}[args.format](result.findings)
        if args.format == "human":
            text += "\n" + findings.run_summary(result)
        return result.exit_code(), text
    finally:
        result.findings.unpersist()


def init(spark: SparkSession, args: argparse.Namespace) -> tuple[int, str]:
    files = None
    for d in args.dirs:
        tree = read_tree(spark, str(Path(d).resolve()), tuple(args.include), tuple(args.exclude), ".md")
        files = tree if files is None else files.unionByName(tree)
    if args.check:
        config = ddl.find_config(args.dirs[0])
        if config is None:
            raise ContractError("no configuration was found")
        errors = infer.check(files, config)
        text = findings.render_human(errors)
        return (0 if text == "No findings." else 1), text
    depth = args.depth if args.depth is not None else 1 if args.meta else None
    contracts = infer.infer(files, depth, args.relax)
    text = infer.as_config(contracts)
    if infer.check(files, infer.load_inferred(contracts)).limit(1).count():
        raise ContractError("the inferred contracts do not accept their own files")
    if not args.dry_run and args.out:
        write_new(args.out, text, args.force)
    return 0, text


def main() -> None:
    code, text = run(sys.argv[1:])
    print(text, file=sys.stderr if code == 2 else sys.stdout)
    sys.exit(code)


if __name__ == "__main__":
    main()
