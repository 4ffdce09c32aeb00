"""python -m textloom run|locales|detect: small jobs from the command line over Parquet files of documents."""

from __future__ import annotations

import argparse
import sys


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="textloom")
    p.add_argument("job", choices=("run", "locales", "detect"))
    p.add_argument("--input", help="a Parquet file or folder with doc_id, text and lang")
    p.add_argument("--output", help="a folder for the results")
    p.add_argument("--target", action="append", help="a target locale; may be given more than once")
    a = p.parse_args(args)
    from .engine import Engine
    from .session import session

    spark = session()
    e = Engine(spark)
    if a.job == "locales":
        e.list_locales().show(truncate=False)
        return 0
    if not a.input or not a.output:
        p.error("--input and --output are needed")
    docs = spark.read.parquet(a.input)
    if a.job == "detect":
        e.detect(docs).drop("text").write.mode("overwrite").parquet(a.output)
        return 0
    rows = e.run(e.ingest_text(docs), tuple(a.target or ("de-CH",)))
    rows.write.mode("overwrite").partitionBy("target").parquet(a.output)
    results = e.locale_results(spark.read.parquet(a.output)).collect()
    for r in results:
        print(r.target, r.verdict, r.score, r.segments)
    return int(any(r.verdict == "FAIL" for r in results))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
