"""Command line: build an index from a reference, map reads to it."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from strandwise.functions.sequence import fill_ambiguous
from strandwise.operators import reporting
from strandwise.operators.scan import Counters
from strandwise.plans import mapping
from strandwise.sources import sequences


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandwise")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="write an index of BASE.txt or BASE.fasta")
    build.add_argument("base")
    build.add_argument("index")
    build.add_argument("-l", "--seed-length", type=int, default=100, help="length of the seed that fills letters other than ACGT; 0: random letters")
    build.add_argument("--preprocess", action="store_true", help="write the sequences and their reverses only")
    run = commands.add_parser("map", help="map reads and write SAM, or a hit list if the output does not end in .sam")
    run.add_argument("-r", "--reference", required=True, help="index folder")
    run.add_argument("-f", "--reads-file", required=True)
    run.add_argument("-o", "--output-file", default="strandwise.sam")
    run.add_argument("-e", "--max-distance", type=int, default=0)
    run.add_argument("-m", "--metric", default="edit")
    run.add_argument("-S", "--search-scheme", default="columba")
    own = run.add_mutually_exclusive_group()
    own.add_argument("-c", "--custom", help="folder of own search schemes, in place of -S")
    own.add_argument("-d", "--dynamic-selection", help="folder of several own schemes for each number of errors, in place of -S")
    run.add_argument("-T", "--XA-tag", action="store_true", help="list further hits in a tag of the primary row")
    run.add_argument("-a", "--mode", default="all")
    run.add_argument("-i", "--identity", type=int)
    run.add_argument("-U", "--no-unmapped", action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    log = logging.getLogger("strandwise")
    spark = SparkSession.builder.appName("strandwise").getOrCreate()
    if args.command == "build":
        mode, path = sequences.reference_path(args.base)
        refs = sequences.read_text_reference(spark, path) if mode == "text" else sequences.read_reference_fasta(spark, path)
        refs = fill_ambiguous(refs, "seq", args.seed_length)
        if args.preprocess:
            sequences.write_preprocessed(refs, args.index)
        else:
            mapping.write_index(refs, args.index)
        log.info("wrote %s", args.index)
        return
    config = mapping.MapConfig(metric=args.metric, k=args.max_distance, strategy=args.search_scheme, mode=args.mode, identity=args.identity, folder=args.custom or args.dynamic_selection)
    index, reads = mapping.read_index(spark, args.reference), sequences.read_reads(spark, args.reads_file, with_place=True)
    refs = index.refs
    counters = Counters(spark)
    hits = mapping.map_reads(reads, index, config, counters).cache()
    if args.output_file.endswith(".sam"):
        mapping.write_sam(hits, reads, refs, args.output_file, unmapped=not args.no_unmapped, xa=args.XA_tag)
    else:
        mapping.write_rhs(hits, reads, refs, args.output_file)
    stats = reporting.mapping_stats(hits, reads).first().asDict()
    log.info(", ".join(f"{k}: {v}" for k, v in {**stats, **counters.values()}.items()))


if __name__ == "__main__":
    main()
