"""python -m sparkscribe COMMAND WORKSPACE: the engine's steps from the command line."""

from __future__ import annotations

import argparse
import json


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sparkscribe", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name_: str, **options):
        c = sub.add_parser(name_)
        c.add_argument("workspace")
        for o, (kind, default) in options.items():
            if kind is bool:
                c.add_argument(f"--{o.replace('_', '-')}", action="store_true")
            else:
                c.add_argument(f"--{o.replace('_', '-')}", type=kind, default=default)
        return c

    command("pages", raw=(str, None), start_page=(int, 11), prefix=(str, "chunk"))
    command("vectors", dim=(int, 384), model=(str, "hash-v1"), force=(bool, False))
    command("concepts", least=(float, 0.6), max_chars=(int, 4000))
    command("graph")
    command("link", name=(str, "main"))
    command("retrieve", query=(str, None), k=(int, 5), max_edges=(int, 8), no_graph=(bool, False), out=(str, None))
    command("simulate", policy=(str, "retrieval_epsilon"), rounds=(int, 200), k=(int, 10), epsilon=(float, 0.1), alpha=(float, 1.0), seed=(int, 42))
    command("train", alpha=(float, 1.0), l2=(float, 1.0), reset=(bool, False))
    command("evaluate", epsilon=(float, 0.05), reg=(float, 1.0), seed=(int, 42))
    a = vars(p.parse_args(args))
    name, workspace = a.pop("command"), a.pop("workspace")

    from pyspark.sql import SparkSession

    from sparkscribe.plans import pipelines as run
    from sparkscribe.sources import files, schemas

    spark = SparkSession.builder.appName("sparkscribe").getOrCreate()
    if name == "pages":
        out = run.process_pages(files.checked_jsonl(spark, a["raw"], schemas.RAW_PAGE), workspace, start_page=a["start_page"], prefix=a["prefix"])
    elif name == "retrieve":
        hits = run.retrieve(spark, workspace, [a["query"]], k=a["k"], max_edges=a["max_edges"], with_graph=not a["no_graph"])
        out = run.payload(hits, a["out"])
    else:
        steps = {"vectors": run.build_vector_store, "concepts": run.extract_concepts, "graph": run.ingest_graph, "link": run.link_vector_graph, "simulate": run.simulate, "train": run.train, "evaluate": run.evaluate}
        out = steps[name](spark, workspace, **a)
    print(json.dumps(out, ensure_ascii=False, default=str, indent=1))


if __name__ == "__main__":
    main()
