"""The mapping interface: configuration, index, and one call per run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.sequence import distance_for_identity
from strandwise.operators import matching, reporting, schemes, seed_index
from strandwise.operators.scan import Counters
from strandwise.operators.seed_index import SeedIndex


@dataclass(frozen=True)
class MapConfig:
    """Options of a run; wrong ones are refused when it is made.

    strategy names a search scheme; folder, in its place, holds own schemes, one or several for each number of errors.
    All schemes that cover all distributions of errors find the same hits, so they are checked and only stand for cost.
    mode is all, best, or best+x for hits within x errors of the best. identity (50 to 100), if given, bounds
    errors by read length in place of k.
    """

    metric: str = "edit"
    k: int = 0
    strategy: str = "columba"
    mode: str = "all"
    identity: int | None = None
    folder: str | None = None

    def __post_init__(self):
        if self.metric not in ("edit", "hamming"):
            raise ValueError("metric must be edit or hamming")
        if not 0 <= self.k <= 13:
            raise ValueError("k must lie within 0 and 13")
        if self.strategy in ("custom", "multiple"):
            raise ValueError("custom schemes are given as a folder, not as a strategy")
        if self.folder is not None:
            most = schemes.folder_errors(self.folder)
            if self.k > most:
                raise ValueError(f"{self.folder} has schemes for at most {most} errors")
        elif self.strategy not in schemes.LIMITS:
            raise ValueError(f"strategy must be one of {', '.join(schemes.LIMITS)}")
        elif self.k > schemes.LIMITS[self.strategy]:
            raise ValueError(f"{self.strategy} allows at most {schemes.LIMITS[self.strategy]} errors")
        if self.mode not in ("all", "best") and not (self.mode.startswith("best+") and self.mode[5:].isdigit()):
            raise ValueError("mode must be all, best or best+x")
        if self.identity is not None and not 50 <= self.identity <= 100:
            raise ValueError("identity must lie within 50 and 100")

    @property
    def beyond(self) -> int | None:
        return None if self.mode == "all" else int(self.mode[5:] or 0)


def write_index(refs: DataFrame, path: str, **options) -> SeedIndex:
    """See seed_index.build."""
    return seed_index.build(refs, path, **options)


def read_index(spark: SparkSession, path: str) -> SeedIndex:
    return seed_index.load(spark, path)


def map_reads(reads: DataFrame, refs: DataFrame | SeedIndex, config: MapConfig | None = None, counters: Counters | None = None) -> DataFrame:
    """Hits (read_id, strand, seq_idx, begin, end, distance) of reads(read_id, seq) in refs(seq_idx, name, seq) or an index of them.

    With an index no reference is shuffled. In the best modes reads are searched in rounds of growing k, except
    where identity bounds errors by length: then all are searched once. counters, with an index, count what scans meet.
    """
    config = config or MapConfig()
    k, bound = config.k, None
    if config.identity is not None:
        bound = distance_for_identity(F.length("seq"), F.lit(config.identity))
        k = int(reads.agg(F.max(bound)).first()[0] or 0)

    def find(own: DataFrame, errors: int) -> DataFrame:
        if isinstance(refs, SeedIndex):
            return seed_index.found(own, refs, errors, config.metric, counters=counters)
        return matching.found(own, refs, errors, config.metric)

    if config.beyond is not None and bound is None:
        return matching.best_match(reads, k, config.beyond, config.metric, find)
    hits = find(reads, k)
    if k:
        hits = matching.nonredundant(hits, k) if config.metric == "edit" else matching.one_strand(hits)
    if bound is not None:
        hits = hits.join(reads.select("read_id", bound.alias("_most")), "read_id").where("distance <= _most").drop("_most")
    return hits if config.beyond is None else reporting.best_strata(hits, config.beyond)


def _order(reads: DataFrame) -> DataFrame | None:
    return reads.select("read_id", "at") if "at" in reads.columns else None


def write_sam(hits: DataFrame, reads: DataFrame, refs: DataFrame, path: str, *, unmapped: bool = True, xa: bool = False) -> None:
    """SAM lines; with xa, a read's other hits are listed in tags of its primary row in place of rows of their own. Reads with their
    place (at) are written in input order, others by name."""
    from strandwise.sources.sequences import write_lines

    records = reporting.sam_records(hits, reads, refs, unmapped=unmapped)
    write_lines(reporting.sam_lines(reporting.with_xa(records, hits, reads, refs) if xa else records, refs, _order(reads)), path)


def write_rhs(hits: DataFrame, reads: DataFrame, refs: DataFrame, path: str) -> None:
    from strandwise.sources.sequences import write_lines

    write_lines(reporting.rhs_lines(reporting.rhs_records(hits, reads, refs), _order(reads)), path)
