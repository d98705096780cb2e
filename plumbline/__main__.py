"""Command line: audit, extract, rerun and evaluate JSON lines, and pull a corpus from the registry. The input - is standard input."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from plumbline import api
from plumbline.operators import corpus, incremental, normalize
from plumbline.sources import files, registry


def pull(spark, output: str, limit: int, url: str) -> None:  # noqa: ANN001
    """The first so many acceptable studies of the registry, by id, as records; data and manifest appear together."""
    registry.register(spark)
    most = min(registry.MOST, max(5 * limit, limit + 1000))
    raw = files.written(spark.read.format("study_registry").option("limit", most).option("url", url).load(), "studies")
    studies = raw.select(F.from_json("value", normalize.STUDY_DDL).alias("s")).select("s.*")
    records = incremental.accept_first(normalize.normalize(studies.where(F.size(normalize.qualification_errors()) == 0)), ["study_id"], limit)
    about = files.manifest(studies, records, limit, registry.FILTERS | {"limit": most})
    files.publish(records, about, output, limit)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline")
    p.add_argument("command", choices=["audit", "extract", "rerun", "evaluate", "pull"])
    p.add_argument("input", help="a path, or - for standard input; for pull the registry's address")
    p.add_argument("--output")
    p.add_argument("--config")
    p.add_argument("--limit", type=int, default=2000, help="studies that pull must accept")
    p.add_argument("--store", help="a table of responses: only lines that it lacks are audited")
    p.add_argument("--runs", type=int, default=3)
    p.add_argument("--replicates", type=int, default=corpus.BOOTSTRAP)
    a = p.parse_args(argv)
    spark, cfg = api.session(), api.load(a.config)
    lines = None if a.command in ("extract", "pull") else files.read_stdin(spark) if a.input == "-" else spark.read.text(a.input)
    if a.command == "pull":
        if not a.output:
            p.error("pull needs --output")
        pull(spark, a.output, a.limit, a.input)
        return 0
    if a.command == "extract":
        out = files.read_texts(spark, a.input)
    elif a.command == "audit":
        out = incremental.audit_new(lines, a.store, cfg) if a.store else api.audit_lines(lines, cfg)[0]
    else:
        out = api.rerun(api.split(api.parsed(lines))[0], a.runs, cfg) if a.command == "rerun" else api.evaluate(api.labelled(lines), cfg, a.replicates)
    if a.output:
        files.write_jsonl(out, a.output)
    else:
        out.show(truncate=False)
    return int(a.command == "rerun" and out.first()["mismatches"] > 0)


if __name__ == "__main__":
    raise SystemExit(main())
