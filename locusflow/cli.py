"""Command line: version, dump-records, recount."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from . import __version__


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="locusflow")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    dump = sub.add_parser("dump-records")
    dump.add_argument("--bam", required=True)
    dump.add_argument("--limit", type=int, default=0, help="0: all")
    re = sub.add_parser("recount")
    re.add_argument("--bam", required=True)
    re.add_argument("--sites", required=True)
    re.add_argument("--sample", default="sample")
    re.add_argument("--threads", type=int, default=1)
    re.add_argument("--min-base-quality", type=int, default=0)
    re.add_argument("--min-mapping-quality", type=int, default=0)
    re.add_argument("--min-alt", type=int, default=0, help="0: all sites")
    re.add_argument("--output", help="a folder for the table; standard output without it")
    got = parser.parse_args(args)
    if got.command == "version":
        print(__version__)
        return 0
    from pyspark.sql import functions as F

    from .operators import recount
    from .sources import bam, dump as dumps, sites

    spark = SparkSession.builder.appName("locusflow").getOrCreate()
    rows = bam.read_bam(spark, got.bam)
    if got.command == "dump-records":
        print(dumps.header_line(bam.header_of(got.bam)))
        lines = dumps.json_lines(rows).orderBy("file_offset")
        for r in (lines.limit(got.limit) if got.limit else lines).toLocalIterator():
            print(r.value)
        return 0
    began = time.time()
    found = recount.recount(
        rows, sites.read_sites(spark, got.sites), got.sample, got.min_base_quality, got.min_mapping_quality, got.min_alt
    )
    if got.output:
        recount.to_tsv(found, got.output)
    else:
        print("\t".join(recount.OUTPUT))
        for r in found.withColumn("AF", F.format_string("%.6f", "AF")).orderBy("site_idx").toLocalIterator():
            print("\t".join(str(r[c]) for c in recount.OUTPUT))
    print(f"recount: {time.time() - began:.3f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
