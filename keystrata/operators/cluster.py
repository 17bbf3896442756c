"""Ordered first-fit clustering of findings into assets.

Findings of one file are taken in emission order; each joins the first cluster all of
whose members it is compatible with, else it opens a new one. That is sequential by
definition, so the work is cut into pieces that cannot influence each other:

1. Equal findings are folded first. Findings of one path with the same attributes and
   line always end in the same cluster, so a profile row (with counts, sums and first
   occurrences) stands for all of them, however many there are. This is an ordinary
   aggregation with map-side combine: a path or a value that holds a large part of all
   rows shrinks before anything is shuffled.
2. Profiles are split by path, by algorithm family and by line island. In paths with
   findings that have no family or are free of line proximity (binary, container or
   file-level) the split is by components of the conflict graph over the path's distinct
   kinds, and only the components that hold such a finding stay whole.
3. The pieces stream through Python in sorted order, many to a task; only the clusters
   of the piece at hand are held, indexed by what they accept, so a piece takes time in
   proportion to its profiles. A piece is one file's profiles at most, so its size is
   bounded by the lines of a file and not by the number of findings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.dims.aliases import DISCOVERY_METHODS
from keystrata.functions.binding import bind
from keystrata.operators.normalize import ATTRIBUTES
from keystrata.session import checkpointed

# Findings at most this many lines apart can share a cluster.
LINE_GAP = 2
# Lines per bucket of the two-level island labelling.
BUCKET_LINES = 4096

# Findings of one profile from which on they are combined in the tasks that read them.
HOT_PROFILE = 100_000

_SHAPE = ["family", "alg", "key", "mode", "curve", "wide", "line", "is_library"]


# --- the compatibility rule -------------------------------------------------

def names_match(a: str, b: str, family: str) -> bool:
    """Whether two upper-cased algorithm names can mean the same asset."""
    if a == b or a in _UNNAMED or b in _UNNAMED or family in (a, b):
        return True
    if a.startswith(b) or b.startswith(a):
        return True
    return bool(family) and a.startswith(family) and b.startswith(family)


_UNNAMED = ("UNKNOWN ALGORITHM", "N/A")


def shapes_compatible(member: tuple, newcomer: tuple) -> bool:
    """Whether ``newcomer`` may join a cluster that holds ``member``; tuples as in _SHAPE."""
    fam1, alg1, key1, mode1, curve1, wide1, line1, lib1 = member
    fam2, alg2, key2, mode2, curve2, wide2, line2, _ = newcomer
    if fam1 and fam2 and fam1 != fam2:
        return False
    if not names_match(alg1, alg2, fam1):
        return False
    if key1 is not None and key2 is not None and key1 != key2:
        return False
    if (mode1 and mode2 and mode1 != mode2) or (curve1 and curve2 and curve1 != curve2):
        return False
    if wide1 or wide2:
        return True
    if line1 is None or line2 is None:
        return (line1 is None and line2 is None) or not lib1
    return abs(line1 - line2) <= LINE_GAP


def compatible(member: Column, newcomer: Column) -> Column:
    """The same rule over two structs with the _SHAPE fields, as a column."""
    a, b = member, newcomer
    blank = lambda c: F.coalesce(c, F.lit(""))
    differ = lambda f: (blank(a[f]) != "") & (blank(b[f]) != "") & (a[f] != b[f])
    family, n1, n2 = blank(a["family"]), a["alg"], b["alg"]
    names = (
        (n1 == n2) | n1.isin(*_UNNAMED) | n2.isin(*_UNNAMED) | (n1 == family) | (n2 == family)
        | F.startswith(n1, n2) | F.startswith(n2, n1)
        | ((family != "") & F.startswith(n1, family) & F.startswith(n2, family))
    )
    keys = F.coalesce(a["key"] == b["key"], F.lit(True))
    near = (
        F.when(a["wide"] | b["wide"], True)
        .when(a["line"].isNotNull() & b["line"].isNotNull(), F.abs(a["line"] - b["line"]) <= LINE_GAP)
        .when(a["line"].isNull() & b["line"].isNull(), True)
        .otherwise(~a["is_library"])
    )
    return ~differ("family") & names & keys & ~differ("mode") & ~differ("curve") & near


# --- profiles ---------------------------------------------------------------

def _wide() -> Column:
    return F.col("binary_format").isNotNull() | F.col("container_context").isNotNull()


def with_profile(normalized: DataFrame) -> DataFrame:
    """Adds the profile columns: whether line proximity is waived, the line that counts,
    and a digest of everything that distinguishes one profile of a path from another."""
    df = bind(normalized, wide=_wide(), line=F.when(~_wide(), F.col("location.start_line")))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in [*ATTRIBUTES, "wide", "line"]]
    return bind(df, profile_id=F.md5(F.concat_ws("\u0001", *parts)))


_OTHER = "OTHER"


def method_bit(method: Column) -> Column:
    """The bit of a discovery method; names that are not listed share one."""
    bit = F.when(method.isNotNull(), 1 << len(DISCOVERY_METHODS)).otherwise(0)
    for i, name in enumerate(DISCOVERY_METHODS):
        bit = F.when(method == name, 1 << i).otherwise(bit)
    return bit


def method_names(bits: Column) -> Column:
    """Sorted method names of a bit set."""
    names = sorted((n, i) for i, n in enumerate([*DISCOVERY_METHODS, _OTHER]))
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(1 << i) != 0, n) for n, i in names]))


_PROFILE = ["path_key", "profile_id", *ATTRIBUTES, "wide", "line"]


def fold_profiles(normalized: DataFrame) -> DataFrame:
    """One row per path and profile, with what the later merge needs of its findings.

    All aggregates are sums, counts, bit sets or minima of ordered structs, so they
    combine on the map side and again per cluster.
    """
    df = normalized if "profile_id" in normalized.columns else with_profile(normalized)
    return _folded(df)


def fold_dealt(profiled: DataFrame) -> DataFrame:
    """The rows of ``fold_profiles``, for a table that is written already. Combining on the
    map side sorts every task's findings, which is lost work where few of them are equal. So
    findings are counted by profile first; only those of hot profiles are combined where
    they are read, all others are dealt by profile and folded once. Sorting for that goes by
    a number first, which tells most findings apart without a look at their texts."""
    keyed = profiled.withColumn("_key", profile_key())
    counts = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    hot = checkpointed(counts.where(F.col("_n") >= HOT_PROFILE).select("_key"))
    if hot.isEmpty():
        return _folded_by_key(profiled)
    # One row for each HOT_PROFILE findings at most, on which adaptive execution decides.
    rest = _folded_by_key(keyed.join(hot, "_key", "left_anti").drop("_key"))
    return rest.unionByName(_folded(keyed.join(hot, "_key", "left_semi")))


def profile_key() -> Column:
    """A number of path and profile, to sort and join by before their texts: different
    profiles may share one, so the texts are always compared as well."""
    return F.xxhash64("path_key", "profile_id")


def _folded_by_key(profiled: DataFrame) -> DataFrame:
    # The number is made from the dealt findings, so it is not shuffled with them.
    return _folded(profiled.repartition(*_PROFILE).withColumn("_key", profile_key()), "_key").drop("_key")


def _folded(df: DataFrame, *first_by: str) -> DataFrame:
    score, seq, fid = F.col("confidence_score"), F.col("emit_seq"), F.col("finding_id")
    lined = F.col("location.start_line").isNotNull()
    parsed = (F.col("discovery_method") == "AST") & lined & (F.coalesce("location.snippet", F.lit("")) != "")
    tier = F.when(parsed, 1).when(lined, 2).otherwise(3)
    first = lambda value: F.min(
        F.when(F.col(value).isNotNull(), F.struct(seq.alias("seq"), fid.alias("id"), F.col(value).alias("value")))
    )
    return df.groupBy(*first_by, *_PROFILE).agg(
        F.min(F.struct(seq.alias("seq"), fid.alias("id"))).alias("first_key"),
        F.count(F.lit(1)).alias("n"),
        F.sum(score).alias("score_sum"),
        F.bit_or(method_bit(F.col("discovery_method"))).alias("method_bits"),
        F.min(F.struct(
            (-score).alias("rank"), seq.alias("seq"), fid.alias("id"),
            F.col("discovery_method").alias("method"), F.col("confidence_rationale").alias("rationale"),
        )).alias("anchor"),
        F.min(F.struct(
            tier.alias("tier"), F.when(tier == 1, 0.0).otherwise(-score).alias("rank"),
            seq.alias("seq"), fid.alias("id"), F.col("location").alias("location"),
        )).alias("primary"),
        first("container_context").alias("container_first"),
        first("binary_format").alias("binary_first"),
    )


# --- pieces -----------------------------------------------------------------

def line_islands(df: DataFrame, keys: list[str], line: str = "line", gap: int = LINE_GAP) -> DataFrame:
    """Adds ``island``: the first line of the run of lines, no two neighbours more than
    ``gap`` apart, that a row belongs to within ``keys`` (which must not be null).

    Two levels keep any one window small: breaks are found inside buckets of BUCKET_LINES
    lines, and only one row per bucket takes part in linking buckets to runs. Rows are
    spread by bucket explicitly, or Spark would keep a coarser partitioning it finds in
    place and put all of a large path into one task.
    """
    at = F.col(line)
    df = df.withColumn("_bucket", F.floor(at / BUCKET_LINES)).repartition(*keys, "_bucket")
    inside = W.partitionBy(*keys, "_bucket").orderBy(line)
    across = W.partitionBy(*keys).orderBy("_bucket")
    step = at - F.lag(line).over(inside)
    df = df.withColumn("_break", F.when(step > gap, at))
    buckets = df.groupBy(*keys, "_bucket").agg(
        F.min(line).alias("_first"), F.max(line).alias("_last"), F.max("_break").alias("_last_break")
    )
    joined = F.col("_first") - F.lag("_last").over(across) <= gap
    buckets = buckets.withColumn("_joined", F.coalesce(joined, F.lit(False)))
    # Where the bucket's last run starts, null when it started in an earlier bucket.
    buckets = buckets.withColumn(
        "_anchor", F.coalesce("_last_break", F.when(~F.col("_joined"), F.col("_first")))
    )
    earlier = F.last("_anchor", ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1))
    entry = F.when(F.col("_joined"), earlier).otherwise(F.col("_first"))
    df = df.join(buckets.select(*keys, "_bucket", entry.alias("_entry")), [*keys, "_bucket"])
    # By range: rows of one line may have changed places since the break was found on one of them.
    run = F.max("_break").over(inside.rangeBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn("island", F.coalesce(run, F.col("_entry"))).drop("_bucket", "_break", "_entry")


_KIND = ["family", "key", "mode", "curve"]
_COMPONENTS = "path_key string, family string, key int, mode string, curve string, component string, boundless boolean"


def _components(_: tuple, kinds: pd.DataFrame) -> pd.DataFrame:
    """Connected components of one path's kinds, two of which are linked unless a field that
    both have differs. A finding never joins a cluster of another component. Kinds are taken
    in their own order, since names that follow the order of arrival differ between two runs
    of the step, whose rows are joined by these names."""
    kinds = kinds.sort_values(_KIND, na_position="first", ignore_index=True)
    n = len(kinds)
    codes = np.stack([pd.factorize(kinds[c].where(kinds[c] != "", None), use_na_sentinel=True)[0] for c in _KIND])
    label, todo = np.full(n, -1), list(range(n - 1, -1, -1))
    while todo:
        i = todo.pop()
        if label[i] < 0:
            label[i] = i
        own = codes[:, i : i + 1]
        near = np.flatnonzero(((codes == own) | (codes < 0) | (own < 0)).all(axis=0) & (label < 0))
        label[near] = label[i]
        todo.extend(near.tolist())
    kinds["component"] = [f"#{x}" for x in label]
    kinds["boundless"] = kinds.groupby("component")["boundless"].transform("max")
    return kinds


def pieces(profiles: DataFrame) -> DataFrame:
    """Adds the piece a profile is clustered in: (path_key, piece_family, island).

    In most paths that is the family and the line island. A finding without a family links
    families, one without a line (or free of it) links lines; in paths that hold such
    findings the pieces are the components of the distinct kinds (family, key, mode, curve)
    that conflict in no field, and only components with a boundless finding are one island."""
    shape = shape_columns()
    boundless, familyless = F.col("wide") | F.col("line").isNull(), shape["family"] == ""
    key = {c: F.coalesce(shape[c].cast("string"), F.lit("")) for c in _KIND}
    kinds = profiles.groupBy("path_key", *(shape[c].alias(c) for c in _KIND)).agg(F.max(boundless).alias("boundless"), F.max(familyless).alias("_familyless"))
    # Only the paths that hold such a finding are joined in.
    special = kinds.where("boundless or _familyless").select("path_key").distinct()
    kinds = kinds.drop("_familyless").join(special, "path_key", "left_semi").groupBy("path_key").applyInPandas(_components, _COMPONENTS)
    kinds = kinds.select("path_key", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in _KIND), "component", "boundless")
    df = profiles.withColumns({f"_{c}": key[c] for c in _KIND}).join(kinds, ["path_key", *(f"_{c}" for c in _KIND)], "left")
    df = df.withColumn("piece_family", F.coalesce("component", "_family"))
    # Where proximity is waived somewhere in a component, all its lines count as one run.
    df = df.withColumn("_run_line", F.when(~F.coalesce("boundless", F.lit(False)), F.col("line")).otherwise(F.lit(0)))
    return line_islands(df, ["path_key", "piece_family"], "_run_line").drop("component", "boundless", "_run_line", *(f"_{c}" for c in _KIND))


# --- first fit --------------------------------------------------------------

class FirstFit:
    """Clusters of one piece, fed in emission order.

    A member's kind is its shape without the number of its line. What a cluster accepts
    depends on the set of its members' kinds (its signature) and, for a newcomer with a
    line, on the span of its members' lines. Clusters are kept by signature, so a newcomer
    is held against signatures, and against single clusters only near its line."""

    def __init__(self) -> None:
        self.leaders: list[tuple] = []  # order key of the profile that opened the cluster
        self.signature: list[int] = []
        self.span: list[tuple[int, int] | None] = []
        self.by_line: dict[int, list[int]] = {}
        self.sets: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.clusters: list[list[int]] = []  # of each signature, a heap; clusters that moved on stay until met
        self.free: list[bool] = []  # whether no member of the signature is bound to lines
        self.accepting: dict[tuple, list] = {}  # kind: signatures looked at, those that accept, those of them that are free
        self.pairs: dict[tuple, bool] = {}

    def _fits(self, signature: int, kind: tuple) -> bool:
        pairs = self.pairs
        for member in self.sets[signature]:
            fit = pairs.get((member, kind))
            if fit is None:
                fit = pairs[member, kind] = shapes_compatible(member, kind)
            if not fit:
                return False
        return True

    def _signatures(self, kind: tuple, free: bool) -> list[int]:
        known = self.accepting.setdefault(kind, [0, [], []])
        for s in range(known[0], len(self.sets)):
            if self._fits(s, kind):
                known[1].append(s)
                if self.free[s]:
                    known[2].append(s)
        known[0] = len(self.sets)
        return known[2 if free else 1]

    def _first(self, signature: int) -> int | None:
        heap = self.clusters[signature]
        while heap and self.signature[heap[0]] != signature:
            heappop(heap)
        return heap[0] if heap else None

    def _join(self, c: int, kind: tuple, line: int | None) -> None:
        old = self.signature[c]
        kinds = self.sets[old] | {kind} if old >= 0 else frozenset([kind])
        if old < 0 or len(kinds) > len(self.sets[old]):
            number = self.numbers.get(kinds)
            if number is None:
                number = self.numbers[kinds] = len(self.sets)
                self.sets.append(kinds)
                self.clusters.append([])
                self.free.append(all(k[6] is None for k in kinds))
            self.signature[c] = number
            heappush(self.clusters[number], c)
        if line is not None:
            low, high = self.span[c] or (line, line)
            near = self.by_line.setdefault(line, [])
            if c not in near:
                near.append(c)
            self.span[c] = min(low, line), max(high, line)

    def place(self, order_key: tuple, shape: tuple) -> tuple:
        line = None if shape[5] else shape[6]
        kind = shape[:6] + (None if line is None else 0,) + shape[7:]
        tops = [x for x in (self._first(s) for s in self._signatures(kind, line is not None)) if x is not None]
        if line is not None:
            for n in range(line - LINE_GAP, line + LINE_GAP + 1):
                for c in self.by_line.get(n, ()):
                    low, high = self.span[c]
                    if high - line <= LINE_GAP and line - low <= LINE_GAP and self._fits(self.signature[c], kind):
                        tops.append(c)
        if tops:
            c = min(tops)
        else:
            c = len(self.leaders)
            self.leaders.append(order_key)
            self.signature.append(-1)
            self.span.append(None)
        self._join(c, kind, line)
        return self.leaders[c]


_PIECE = ["path_key", "piece_family", "island"]
_ORDER = ["seq", "id"]
_ASSIGNED = "path_key string, profile_id string, leader_seq long, leader_id string"


def _first_fit_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs first fit over rows sorted by piece and order; a piece may span batches. A profile
    alone in its piece leads itself."""
    current, fit = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        paths, profiles, seqs, ids_ = columns[0], *columns[3:6]
        piece = list(zip(*columns[:3]))
        shapes, last = zip(*columns[6:]) if batch.num_rows else (), batch.num_rows - 1
        seq_out, id_out = list(seqs), list(ids_)
        for k, shape in enumerate(shapes):
            if piece[k] != current:
                current, fit = piece[k], None
                if k < last and piece[k + 1] != current:
                    continue
                fit = FirstFit()
            seq_out[k], id_out[k] = fit.place((seqs[k], ids_[k]), shape)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(profiles, pa.string()), pa.array(seq_out, pa.int64()), pa.array(id_out, pa.string())], names=["path_key", "profile_id", "leader_seq", "leader_id"])


def shape_columns() -> dict[str, Column]:
    return {
        "family": F.upper(F.coalesce("algorithm_family", F.lit(""))),
        "alg": F.upper("algorithm"),
        "key": F.col("key_length_bits"),
        "mode": F.upper(F.coalesce("mode", F.lit(""))),
        "curve": F.lower(F.coalesce("curve", F.lit(""))),
        "wide": F.col("wide"),
        "line": F.col("line"),
        "is_library": F.col("primitive_type") == "LIBRARY",
    }


def first_fit_clusters(profiles: DataFrame) -> DataFrame:
    """Cluster of every profile: (path_key, profile_id, leader_seq, leader_id), the leader
    being the first finding of the cluster."""
    rows = pieces(profiles).select(
        *_PIECE, "profile_id", F.col("first_key.seq").alias("seq"), F.col("first_key.id").alias("id"),
        *[c.alias(n) for n, c in shape_columns().items()],
    )
    return rows.repartition(*_PIECE).sortWithinPartitions(*_PIECE, *_ORDER).mapInArrow(_first_fit_sorted, _ASSIGNED)


def _level_libraries(profiles: DataFrame) -> DataFrame:
    return profiles.where(~F.col("wide") & F.col("line").isNull() & (F.col("primitive_type") == "LIBRARY"))


def _uneven_paths(profiles: DataFrame) -> DataFrame:
    """Paths where equal findings may part ways. The rule is one-sided in one case: a
    file-level library finding may join a finding with a line, but not the reverse. So of
    two equal findings the later one may find the cluster closed by a library finding."""
    narrow = profiles.where(~F.col("wide"))
    level = _level_libraries(profiles).select("path_key").distinct()
    lined = narrow.where(F.col("line").isNotNull()).select("path_key").distinct()
    return level.join(lined, "path_key")


# What only normalising reads; neither profiles nor evidence hold it.
_RAW = [
    "scanner_version", "discovered_at", "suspected_algorithm", "artifact_category", "library_hint", "key_size_hint",
    "mode_hint", "curve_hint", "raw_parameters",
]


@dataclass
class Clustered:
    """Findings (without the hints they were normalised from) with their profile, the folded profiles, and the cluster of each profile."""

    profiled: DataFrame
    profiles: DataFrame
    clusters: DataFrame


def assign_clusters(normalized: DataFrame) -> Clustered:
    """Clusters all findings. Findings with their profile and the folded profiles are written
    once to the checkpoint folder: folding and evidence read the findings; piece finding,
    clustering and merging the profiles. A table that has profiles is taken to be written.
    Findings of uneven paths (none, as far as the scanners go) are not folded but keep a
    profile each."""
    profiled = normalized if "profile_id" in normalized.columns else checkpointed(with_profile(normalized.drop(*_RAW)))
    # Written by path and digest: in a part, findings whose order keys are null keep their order.
    profiles = checkpointed(fold_dealt(profiled).sortWithinPartitions("path_key", "profile_id"))
    if not _level_libraries(profiles).isEmpty():
        uneven = checkpointed(_uneven_paths(profiles))
        flagged = uneven.withColumn("_uneven", F.lit(True))
        own = F.md5(F.concat("profile_id", "finding_id"))
        profiled = profiled.join(flagged, "path_key", "left")
        profiled = bind(profiled, profile_id=F.when(F.col("_uneven"), own).otherwise(F.col("profile_id")))
        single = fold_profiles(profiled.where(F.col("_uneven")))
        profiles = checkpointed(profiles.join(uneven, "path_key", "left_anti").unionByName(single))
        profiled = profiled.drop("_uneven")
    return Clustered(profiled, profiles, checkpointed(first_fit_clusters(profiles)))
