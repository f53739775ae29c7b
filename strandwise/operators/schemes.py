"""Search schemes: tables, reader, checks, coverage and critical parts."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Published search schemes, one search per line as {order of parts} {lower} {upper} bounds.
KUCHEROV_1 = {
    1: """{0,1} {0,1} {0,1}
{1,0} {0,0} {0,1}""",
    2: """{0,1,2} {0,0,0} {0,2,2}
{2,1,0} {0,0,0} {0,1,2}
{1,0,2} {0,0,1} {0,1,2}""",
    3: """{0,1,2,3} {0,0,0,0} {0,1,3,3}
{1,0,2,3} {0,0,1,1} {0,1,3,3}
{2,3,1,0} {0,0,0,0} {0,1,3,3}
{3,2,1,0} {0,0,1,1} {0,1,3,3}""",
    4: """{0,1,2,3,4} {0,0,0,0,0} {0,2,2,4,4}
{4,3,2,1,0} {0,0,0,0,0} {0,1,3,4,4}
{1,0,2,3,4} {0,0,1,3,3} {0,1,3,3,4}
{0,1,2,3,4} {0,0,1,3,3} {0,1,3,3,4}
{3,2,4,1,0} {0,0,0,1,1} {0,1,2,4,4}
{2,1,0,3,4} {0,0,0,1,3} {0,1,2,4,4}
{1,0,2,3,4} {0,0,1,2,4} {0,1,2,4,4}
{0,1,2,3,4} {0,0,0,3,4} {0,0,4,4,4}""",
}
KUCHEROV_2 = {
    1: """{0,1,2} {0,0,0} {0,1,1}
{1,2,0} {0,0,0} {0,0,1}""",
    2: """{0,1,2,3} {0,0,0,0} {0,1,1,2}
{3,2,1,0} {0,0,0,0} {0,1,2,2}
{1,2,3,0} {0,0,0,1} {0,0,1,2}
{0,1,2,3} {0,0,0,2} {0,0,2,2}""",
    3: """{0,1,2,3,4} {0,0,0,0,0} {0,1,2,3,3}
{1,2,3,4,0} {0,0,0,0,0} {0,1,2,2,3}
{2,3,4,1,0} {0,0,0,0,1} {0,1,1,3,3}
{3,4,2,1,0} {0,0,0,1,2} {0,0,3,3,3}""",
    4: """{0,1,2,3,4,5} {0,0,0,0,0,0} {0,1,2,3,4,4}
{1,2,3,4,5,0} {0,0,0,0,0,0} {0,1,2,3,4,4}
{5,4,3,2,1,0} {0,0,0,0,0,1} {0,1,2,2,4,4}
{3,4,5,2,1,0} {0,0,0,0,1,2} {0,1,1,3,4,4}
{2,3,4,5,1,0} {0,0,0,0,2,3} {0,1,1,2,4,4}
{4,5,3,2,1,0} {0,0,0,1,3,3} {0,0,3,3,4,4}
{0,1,2,3,4,5} {0,0,0,3,3,3} {0,0,3,3,4,4}
{0,1,2,3,4,5} {0,0,0,0,4,4} {0,0,2,4,4,4}
{2,3,1,0,4,5} {0,0,0,1,2,4} {0,0,2,2,4,4}
{4,5,3,2,1,0} {0,0,0,0,4,4} {0,0,1,4,4,4}""",
}
KIANFAR = {
    1: """{0,1} {0,0} {0,1}
{1,0} {0,0} {0,1}""",
    2: """{0,1,2} {0,0,2} {0,1,2}
{2,1,0} {0,0,0} {0,2,2}
{1,2,0} {0,1,1} {0,1,2}""",
    3: """{0,1,2,3} {0,0,0,3} {0,2,3,3}
{1,2,3,0} {0,0,0,0} {1,2,3,3}
{2,3,1,0} {0,0,2,2} {0,0,3,3}""",
    4: """{0,1,2,3,4} {0,0,0,0,4} {0,3,3,4,4}
{1,2,3,4,0} {0,0,0,0,0} {2,2,3,3,4}
{4,3,2,1,0} {0,0,0,3,3} {0,0,4,4,4}""",
}
MANUAL = {
    4: """{0,1,2,3,4,5} {0,0,0,0,0,4} {0,3,3,3,4,4}
{1,2,3,4,5,0} {0,0,0,0,0,0} {0,2,2,3,3,4}
{2,1,3,4,5,0} {0,1,1,1,1,1} {0,2,2,3,3,4}
{3,2,1,4,5,0} {0,1,2,2,2,2} {0,1,2,3,3,4}
{5,4,3,2,1,0} {0,0,0,0,3,3} {0,0,4,4,4,4}""",
}
MIN_U = {
    1: """{0,1} {0,0} {0,1}
{1,0} {0,0} {0,1}""",
    2: """{0,1,2} {0,1,1} {0,2,2}
{1,0,2} {0,0,0} {0,1,2}
{2,1,0} {0,0,2} {0,1,2}""",
    3: """{0,1,2,3} {0,0,0,0} {0,1,3,3}
{1,0,2,3} {0,1,1,1} {0,1,3,3}
{2,3,1,0} {0,0,0,2} {0,1,3,3}
{3,2,1,0} {0,1,1,3} {0,1,3,3}""",
    4: """{0,1,2,3,4} {0,0,2,2,2} {0,2,2,4,4}
{1,2,0,3,4} {0,0,0,0,0} {0,1,2,4,4}
{2,1,0,3,4} {0,1,1,1,1} {0,1,2,4,4}
{3,4,2,1,0} {0,0,0,0,3} {0,1,4,4,4}
{4,3,2,1,0} {0,1,1,1,4} {0,1,4,4,4}""",
    5: """{0,1,2,3,4,5} {0,0,0,2,2,2} {0,1,3,5,5,5}
{1,0,2,3,4,5} {0,1,1,3,3,3} {0,1,3,5,5,5}
{2,3,1,0,4,5} {0,0,0,0,0,0} {0,1,3,3,5,5}
{3,2,1,0,4,5} {0,1,1,1,1,1} {0,1,3,3,5,5}
{4,5,3,2,1,0} {0,0,0,0,0,4} {0,1,3,5,5,5}
{5,4,3,2,1,0} {0,1,1,1,1,5} {0,1,3,5,5,5}""",
    6: """{0,1,2,3,4,5,6} {0,0,2,2,2,2,6} {0,2,2,6,6,6,6}
{1,2,0,3,4,5,6} {0,1,1,1,1,1,5} {0,1,2,6,6,6,6}
{2,1,0,3,4,5,6} {0,0,0,0,0,0,4} {0,1,2,6,6,6,6}
{3,4,5,6,2,1,0} {0,0,0,0,0,0,0} {0,1,3,3,6,6,6}
{4,3,5,6,2,1,0} {0,1,1,1,1,1,1} {0,1,3,3,6,6,6}
{5,6,4,3,2,1,0} {0,0,0,2,2,2,2} {0,1,3,3,6,6,6}
{6,5,4,3,2,1,0} {0,1,1,3,3,3,3} {0,1,3,3,6,6,6}""",
    7: """{0,1,2,3,4,5,6,7} {0,0,0,0,0,0,0,0} {0,1,3,3,7,7,7,7}
{1,0,2,3,4,5,6,7} {0,1,1,1,1,1,1,1} {0,1,3,3,7,7,7,7}
{2,3,1,0,4,5,6,7} {0,0,0,2,2,2,2,2} {0,1,3,3,7,7,7,7}
{3,2,1,0,4,5,6,7} {0,1,1,3,3,3,3,3} {0,1,3,3,7,7,7,7}
{4,5,6,7,3,2,1,0} {0,0,0,0,0,0,0,4} {0,1,3,3,7,7,7,7}
{5,4,6,7,3,2,1,0} {0,1,1,1,1,1,1,5} {0,1,3,3,7,7,7,7}
{6,7,5,4,3,2,1,0} {0,0,0,2,2,2,2,6} {0,1,3,3,7,7,7,7}
{7,6,5,4,3,2,1,0} {0,1,1,3,3,3,3,7} {0,1,3,3,7,7,7,7}""",
}
TABLES = {"kuch1": KUCHEROV_1, "kuch2": KUCHEROV_2, "kianfar": KIANFAR, "manbest": MANUAL, "minU": MIN_U}
#: Most errors of each strategy; those by rule have no table, and columba takes minU's as far as they go. All give the same hits; they differ in what a search costs.
LIMITS = {"kuch1": 4, "kuch2": 4, "kianfar": 4, "manbest": 4, "01*0": 4, "pigeon": 4, "minU": 7, "columba": 13, "naive": 13}


@dataclass(frozen=True)
class Search:
    order: tuple[int, ...]
    lower: tuple[int, ...]
    upper: tuple[int, ...]

    def __post_init__(self):
        p = len(self.order)
        if not len(self.lower) == len(self.upper) == p:
            raise ValueError("order and bounds must have one length")
        if sorted(self.order) != list(range(p)):
            raise ValueError("the order must hold each part once, from 0")
        for n in range(1, p):
            seen = self.order[:n]
            if self.order[n] not in (min(seen) - 1, max(seen) + 1):
                raise ValueError("each part must adjoin the parts before it")
        for bound in (self.lower, self.upper):
            if any(a > b for a, b in zip(bound, bound[1:])):
                raise ValueError("bounds must not decrease")
        if any(a > b for a, b in zip(self.lower, self.upper)):
            raise ValueError("lower bounds must not exceed upper bounds")

    def covers(self, errors: tuple[int, ...]) -> bool:
        total = 0
        for part, lo, hi in zip(self.order, self.lower, self.upper):
            total += errors[part]
            if not lo <= total <= hi:
                return False
        return True

    def mirrored(self) -> Search:
        p = len(self.order)
        return Search(tuple(p - 1 - x for x in self.order), self.lower, self.upper)


def parse(text: str) -> list[Search]:
    """Searches from lines of three lists in braces."""
    out = []
    for line in text.splitlines():
        if line.strip():
            lists = re.findall(r"\{([\d,\s]*)\}", line)
            if len(lists) != 3:
                raise ValueError(f"not a search: {line.strip()}")
            out.append(Search(*(tuple(int(x) for x in part.split(",")) for part in lists)))
    if len({len(s.order) for s in out}) > 1:
        raise ValueError("all searches must have one number of parts")
    return out


def pigeonhole(k: int) -> list[Search]:
    """One search per part, which it matches without error; then to the right, then to the left."""
    parts = k + 1
    orders = [(*range(i, parts), *range(i - 1, -1, -1)) for i in range(parts)]
    return [Search(o, (0,) * parts, (0,) + (k,) * k) for o in orders]


def zero_one_star(k: int) -> list[Search]:
    """Of k + 2 parts, two have no error and those between them one each: a search per first of the two."""
    parts = k + 2
    out = []
    for i in range(k + 1):
        order = (*range(i, parts), *range(i - 1, -1, -1))
        upper = (0, 1) + (k,) * k if i < k else (0, 0) + (k,) * k
        out.append(Search(order, (0,) * parts, upper))
    return out


def build(strategy: str, k: int) -> list[Search]:
    if strategy not in LIMITS:
        raise ValueError(f"unknown strategy {strategy}; there are {', '.join(LIMITS)}")
    if not 1 <= k <= LIMITS[strategy]:
        raise ValueError(f"{strategy} allows 1 to {LIMITS[strategy]} errors")
    if strategy == "naive":
        return [Search((0,), (0,), (k,))]
    if strategy == "columba" and k in MIN_U:
        strategy = "minU"
    if strategy in TABLES:
        if k not in TABLES[strategy]:
            raise ValueError(f"{strategy} has no scheme for {k} errors")
        return parse(TABLES[strategy][k])
    return zero_one_star(k) if strategy == "01*0" else pigeonhole(k)


def with_mirrors(alternatives: list[list[Search]]) -> list[list[Search]]:
    return [s for a in alternatives for s in (a, [x.mirrored() for x in a])]


def uncovered(searches: list[Search], k: int) -> list[tuple[int, ...]]:
    """Distributions of at most k errors over the parts that no search covers."""
    each = [()]
    for _ in searches[0].order:
        each = [(*d, e) for d in each for e in range(k - sum(d) + 1)]
    return [d for d in each if not any(s.covers(d) for s in searches)]


def critical_part(searches: list[Search]) -> int:
    """The first part of the search with the least order: upper bounds descending, then lower ascending, then position."""
    return min(enumerate(searches), key=lambda x: ([-u for u in x[1].upper], x[1].lower, x[0]))[1].order[0]


def read_folder(path: str, k: int) -> list[list[Search]]:
    """Alternatives of a scheme folder for k errors: name.txt, then <k>/searches.txt, or scheme1.txt, scheme2.txt and so on."""
    if not os.path.exists(f"{path}/name.txt"):
        raise FileNotFoundError(f"{path} has no name.txt")
    files = [f"{path}/{k}/searches.txt"] if os.path.exists(f"{path}/{k}/searches.txt") else []
    while not (files and files[0].endswith("searches.txt")) and os.path.exists(f := f"{path}/{k}/scheme{len(files) + 1}.txt"):
        files.append(f)
    out = []
    for f in files:
        with open(f, encoding="utf-8") as text:
            out.append(parse(text.read()))
        if uncovered(out[-1], k):
            raise ValueError(f"{f} does not cover all distributions of {k} errors")
    if not out:
        raise FileNotFoundError(f"{path} has no scheme for {k} errors")
    return out


def folder_errors(path: str) -> int:
    """The most errors k for which a scheme folder has schemes for 1 to k; each of them is read and checked."""
    k = 0
    while os.path.exists(f"{path}/{k + 1}/searches.txt") or os.path.exists(f"{path}/{k + 1}/scheme1.txt"):
        k += 1
        read_folder(path, k)
    return k


def read_static_partitioning(path: str, k: int, parts: int) -> list[float]:
    """The inner boundaries of <k>/static_partitioning.txt: parts - 1 ascending numbers in (0, 1)."""
    with open(f"{path}/{k}/static_partitioning.txt", encoding="utf-8") as f:
        begins = [float(x) for x in f.read().split()]
    if len(begins) != parts - 1 or any(not 0 < x < 1 for x in begins) or begins != sorted(set(begins)):
        raise ValueError(f"{path}: {parts - 1} ascending numbers within (0, 1) are needed")
    return begins


def read_dynamic_partitioning(path: str, k: int, parts: int) -> tuple[list[float], list[int]]:
    """(parts - 2 seeds, parts weights) of <k>/dynamic_partitioning.txt."""
    with open(f"{path}/{k}/dynamic_partitioning.txt", encoding="utf-8") as f:
        first, second = f.read().strip().splitlines()[:2]
    seeds, weights = [float(x) for x in first.split()], [int(x) for x in second.split()]
    if len(seeds) != parts - 2 or len(weights) != parts or any(not 0 < x < 1 for x in seeds):
        raise ValueError(f"{path}: {parts - 2} seeds within (0, 1) and {parts} weights are needed")
    return seeds, weights


SCHEMA = T.StructType([T.StructField("scheme", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("k", "search_idx")), *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("pi", "lower", "upper"))])
SHOWN = [(s, k) for s in ("kuch1", "kuch2", "kianfar", "01*0", "pigeon") for k in range(1, 5)] + [("manbest", 4)] + [("minU", k) for k in range(1, 8)]


def scheme_rows() -> list[tuple]:
    return [(s, k, n, list(x.order), list(x.lower), list(x.upper)) for s, k in SHOWN for n, x in enumerate(build(s, k))]


def scheme_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(scheme_rows(), SCHEMA)


def scheme_coverage(schemes: DataFrame, most_parts: int = 8) -> DataFrame:
    """(scheme, k, n_distributions, n_covered): how many distributions of at most k errors some search covers; schemes have up to most_parts parts."""
    d = schemes.groupBy("scheme", "k").agg(F.max(F.size("pi")).alias("p")).withColumn("d", F.expr("cast(array() as array<bigint>)"))
    for _ in range(most_parts):  # a part more; a scheme that has no more parts gets an empty list
        left = F.expr("if(size(d) < p, transform(sequence(0L, k - aggregate(d, 0L, (a, x) -> a + x)), e -> array(e)), array(cast(array() as array<bigint>)))")
        d = d.withColumn("e", F.explode(left)).withColumn("d", F.concat("d", "e")).drop("e")
    met = d.join(schemes.select("scheme", "k", "pi", "lower", "upper"), ["scheme", "k"])
    good = F.expr("forall(sequence(1, size(pi)), n -> aggregate(slice(pi, 1, n), 0L, (a, x) -> a + d[cast(x as int)]) BETWEEN lower[n - 1] AND upper[n - 1])")
    per = met.groupBy("scheme", "k", "d").agg(F.max(good.cast("long")).alias("good"))
    return per.groupBy("scheme", "k").agg(F.count(F.lit(1)).alias("n_distributions"), F.sum("good").alias("n_covered"))


def critical_parts(schemes: DataFrame) -> DataFrame:
    order = F.struct(F.transform("upper", lambda x: -x), "lower", "search_idx")
    return schemes.groupBy("scheme", "k").agg(F.min_by(F.element_at("pi", 1), order).alias("critical_part"))


def directions(schemes: DataFrame) -> DataFrame:
    """(scheme, k, search_idx, directions, switches): F or B for each part after the first, as it lies right or left of those before."""
    steps = F.expr("transform(sequence(2, size(pi)), n -> if(pi[n - 1] > pi[n - 2], 'F', 'B'))")
    turned = F.expr("size(filter(sequence(2, size(d)), n -> n <= size(d) AND n > 1 AND d[n - 1] <> d[n - 2]))")
    each = schemes.withColumn("d", F.when(F.size("pi") > 1, steps).otherwise(F.expr("cast(array() as array<string>)")))
    return each.select("scheme", "k", "search_idx", F.concat_ws("", "d").alias("directions"), F.when(F.size("d") > 1, turned).otherwise(0).cast("long").alias("switches"))


def seed_positions(parts: int) -> list[float]:
    """Where the inner parts of a partitioning by selectivity start to grow, if a scheme names no places: evenly."""
    return [n / (parts - 1) for n in range(1, parts - 1)]


def part_weights(parts: int) -> list[int]:
    """Outer parts weigh 2, as they can grow on one side only."""
    return [2 if n in (0, parts - 1) else 1 for n in range(parts)]


def default_partitions(spark: SparkSession, most_errors: int = 13) -> DataFrame:
    """(parts, part, seed, weight) for 2 to most_errors + 1 parts; the outer parts start at 0 and 1."""
    rows = [(p, n, s, w) for p in range(2, most_errors + 2) for n, (s, w) in enumerate(zip([0.0, *seed_positions(p), 1.0], part_weights(p)))]
    return spark.createDataFrame(rows, "parts long, part long, seed double, weight long")
