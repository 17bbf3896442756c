"""Clustering against a plain sequential first fit, on random findings."""

import random
import re
import time

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.operators import cluster, merge
from keystrata.schemas import CONTAINER_CONTEXT, FINDINGS, LOCATION

SCHEMA = T.StructType([
    *[f for f in FINDINGS.fields],
    T.StructField("path_key", T.StringType()), T.StructField("algorithm", T.StringType()),
    T.StructField("algorithm_family", T.StringType()), T.StructField("primitive_type", T.StringType()),
    T.StructField("key_length_bits", T.IntegerType()), T.StructField("curve", T.StringType()),
    T.StructField("mode", T.StringType()), T.StructField("padding", T.StringType()),
    T.StructField("implementation_library", T.StringType()),
])
NAMES = [
    ("AES", "AES"), ("AES-256-GCM", "AES"), ("AES-128", "AES"), ("SHA-256", "SHA"), ("SHA-512", "SHA"), ("ECDSA", "ECC"),
    ("ECDH", "ECC"), ("Unknown Algorithm", None), ("Library: x", "LIBRARY"), ("RSA", "RSA"),
]


def random_findings(seed: int, n: int, kinds: str) -> list[dict]:
    r = random.Random(seed)
    rows = []
    for i in range(n):
        name, family = r.choice(NAMES if "unknown" in kinds else [x for x in NAMES if x[1]])
        wide = "wide" in kinds and r.random() < 0.2
        line = None if "level" in kinds and r.random() < 0.3 else r.randint(1, 25)
        rows.append({
            "finding_id": f"f{i:05d}", "emit_seq": i, "path_key": f"p{r.randint(0, 2)}", "algorithm": name,
            "algorithm_family": family,
            "primitive_type": "LIBRARY" if family == "LIBRARY" or ("library" in kinds and r.random() < 0.3) else "HASH_FUNCTION",
            "key_length_bits": r.choice([None, None, 128, 256]), "mode": r.choice([None, None, "GCM", "CBC"]),
            "curve": r.choice([None, None, "c1"]), "padding": None, "implementation_library": r.choice([None, "L"]),
            "binary_format": "ELF" if wide else None, "confidence_score": round(r.random(), 3),
            "discovery_method": r.choice(["AST", "REGEX"]), "scanner_name": "s", "confidence_rationale": "why",
            "location": {"file_path": "p", "start_line": line, "end_line": None, "byte_offset": None, "snippet": "x"},
        })
    return rows


def compatible(e: dict, c: dict) -> bool:
    f1, f2 = (e["algorithm_family"] or "").upper(), (c["algorithm_family"] or "").upper()
    if f1 and f2 and f1 != f2:
        return False
    a1, a2 = e["algorithm"].upper(), c["algorithm"].upper()
    same = (
        a1 == a2 or "UNKNOWN ALGORITHM" in (a1, a2) or f1 in (a1, a2) or a1.startswith(a2) or a2.startswith(a1)
        or (f1 and a1.startswith(f1) and a2.startswith(f1))
    )
    if not same:
        return False
    for k in ("key_length_bits", "mode", "curve"):
        if e[k] and c[k] and e[k] != c[k]:
            return False
    if e["binary_format"] or c["binary_format"]:
        return True
    l1, l2 = e["location"]["start_line"], c["location"]["start_line"]
    if l1 is not None and l2 is not None:
        return abs(l1 - l2) <= 2
    return (l1 is None and l2 is None) or e["primitive_type"] != "LIBRARY"


def first_fit(rows: list[dict]) -> dict[str, str]:
    leader = {}
    for path in {r["path_key"] for r in rows}:
        clusters = []
        for row in (r for r in rows if r["path_key"] == path):
            for members in clusters:
                if all(compatible(m, row) for m in members):
                    members.append(row)
                    break
            else:
                members = [row]
                clusters.append(members)
            leader[row["finding_id"]] = members[0]["finding_id"]
    return leader


def frame(spark, rows, partitions=4):
    full = [tuple(r.get(f.name) for f in SCHEMA.fields) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def clustered(spark, rows, partitions=4):
    found = cluster.assign_clusters(frame(spark, rows, partitions))
    joined = found.profiled.join(found.clusters, ["path_key", "profile_id"]).select("finding_id", "leader_id")
    return {r.finding_id: r.leader_id for r in joined.collect()}


def test_matches_sequential_first_fit(spark):
    for seed, kinds in enumerate(["lines", "lines unknown", "wide", "wide unknown", "level", "level unknown library wide", "level library"]):
        rows = random_findings(seed, 250, kinds)
        assert clustered(spark, rows) == first_fit(rows), kinds


def test_first_fit_against_a_scan_of_all_clusters():
    r = random.Random(11)
    for _ in range(300):
        fit, clusters = cluster.FirstFit(), []
        for i in range(r.randint(1, 120)):
            wide, line = r.random() < 0.15, r.choice([None, r.randint(1, 12), r.randint(1, 12)])
            fam = r.choice(["AES", "AES", "SHA", ""])
            shape = (fam, r.choice([fam or "N/A", fam + "-128", "UNKNOWN ALGORITHM", "OTHER"]), r.choice([None, 128, 256]), r.choice(["", "GCM", "CBC"]), r.choice(["", "c"]),
                     wide, None if wide else line, r.random() < 0.3)
            leader = next((c for c in clusters if all(cluster.shapes_compatible(m, shape) for m in c[1])), None)
            if leader is None:
                clusters.append(leader := (i, []))
            leader[1].append(shape)
            assert fit.place(i, shape) == leader[0]


def test_hot_path_of_boundless_findings_takes_linear_time():
    took = []
    for n in (10_000, 20_000):
        r, fit, start = random.Random(1), cluster.FirstFit(), time.process_time()
        for i in range(n):
            wide, line = i % 3 == 0, None if i % 3 < 2 else 3 * i
            fit.place(i, ("AES", "AES", r.choice([None, 128, 192, 256]), r.choice(["", "GCM", "CBC", "CTR"]), "", wide, line, i % 7 == 0))
        took.append(time.process_time() - start)
    assert took[1] < 3 * took[0] + 0.1


def test_components_of_a_hot_path(spark):
    rows = random_findings(8, 400, "wide level")
    for i, row in enumerate(rows):  # kinds that conflict: the path falls into several pieces
        row.update(path_key="hot", key_length_bits=[128, 256, 512][i % 3], mode="GCM", curve="c1")
    profiles = cluster.fold_profiles(cluster.with_profile(frame(spark, rows)))
    assert cluster.pieces(profiles).select("piece_family").distinct().count() >= 12
    assert clustered(spark, rows) == first_fit(rows)


def test_partitioning_does_not_matter(spark):
    rows = random_findings(99, 200, "lines wide unknown")
    assert clustered(spark, rows, 1) == clustered(spark, rows, 7)


def test_equal_findings_are_folded(spark):
    rows = random_findings(5, 1, "lines") * 500
    rows = [dict(r, finding_id=f"c{i:04d}", emit_seq=i) for i, r in enumerate(rows)]
    found = cluster.assign_clusters(frame(spark, rows))
    assert found.profiles.count() == 1
    assets, evidence = merge.build_assets(frame(spark, rows))
    only = assets.collect()
    assert len(only) == 1 and only[0].finding_count == 500 and only[0].confidence_score == 1.0
    assert evidence.count() == 500
    chunks = merge.evidence_chunks(evidence, 100)
    assert chunks.count() == 5 and chunks.selectExpr("max(size(supporting_findings))").first()[0] == 100


def test_findings_are_normalised_and_sorted_once(spark):
    rows = random_findings(7, 300, "lines wide unknown")
    found = cluster.assign_clusters(frame(spark, rows))
    # Profiles come from a written table, to the fold as to the evidence.
    assert "md5(" not in found.profiled._jdf.queryExecution().executedPlan().toString()
    plan = cluster.fold_dealt(found.profiled)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1


def test_hot_profiles_are_combined_where_they_are_read(spark, monkeypatch):
    rows = random_findings(6, 200, "lines wide") + random_findings(5, 1, "lines") * 300
    rows = [dict(r, finding_id=f"c{i:04d}", emit_seq=i) for i, r in enumerate(rows)]
    profiled = cluster.with_profile(frame(spark, rows))
    plain = lambda df: {(r.path_key, r.profile_id): (r.n, round(r.score_sum, 6), r.method_bits, r.first_key, r.anchor, r.primary, r.binary_first) for r in df.collect()}
    want = plain(cluster.fold_profiles(profiled))
    assert plain(cluster.fold_dealt(profiled)) == want
    monkeypatch.setattr(cluster, "HOT_PROFILE", 200)
    dealt = cluster.fold_dealt(profiled)
    assert "Union" in dealt._jdf.queryExecution().executedPlan().toString()
    assert dealt.count() == len(want) and plain(dealt) == want


def test_islands_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BUCKET_LINES", 8)
    r = random.Random(3)
    lines = sorted({r.randint(1, 400) for _ in range(180)})
    want, start, last = {}, None, None
    for line in lines:
        if last is None or line - last > 2:
            start = line
        want[line], last = start, line
    df = spark.createDataFrame([("p", x) for x in lines], "path string, line int")
    got = {row.line: row.island for row in cluster.line_islands(df, ["path"]).collect()}
    assert got == want


def test_singleton_keeps_its_rationale_and_location_prefers_parsed_calls(spark):
    base = random_findings(1, 1, "lines")[0]
    base.update(algorithm="RSA", algorithm_family="RSA", key_length_bits=None, mode=None, curve=None)
    weak = dict(base, finding_id="a", emit_seq=0, discovery_method="REGEX", confidence_score=0.9)
    weak["location"] = dict(base["location"], start_line=5)
    parsed = dict(base, finding_id="b", emit_seq=1, discovery_method="AST", confidence_score=0.5)
    parsed["location"] = dict(base["location"], start_line=6)
    alone = dict(base, finding_id="c", emit_seq=2, path_key="other")
    assets, _ = merge.build_assets(frame(spark, [weak, parsed, alone]))
    rows = {r.leader_id: r for r in assets.collect()}
    assert rows["a"].location.start_line == 6 and rows["a"].confidence_score == 0.925
    assert rows["c"].confidence_rationale == "why"
    assert LOCATION and CONTAINER_CONTEXT and F


def test_unlisted_methods_are_kept(spark):
    from pyspark.sql import functions as F

    from keystrata.operators.cluster import method_bit, method_names

    df = spark.createDataFrame([("AST",), ("MANUAL",), (None,)], "m string")
    got = df.agg(method_names(F.bit_or(method_bit(F.col("m")))).alias("v")).first().v
    assert got == ["AST", "OTHER"]


def test_checkpoints_can_be_dropped(spark):
    import os

    from keystrata import session

    kept = session._WRITTEN.pop(spark.sparkContext.applicationId, [])
    assert session.checkpointed(spark.range(3)).count() == 3
    (path,) = session._WRITTEN[spark.sparkContext.applicationId]
    assert os.path.isdir(path.removeprefix("file:")) and session.drop_checkpoints(spark) == 1
    assert not os.path.exists(path.removeprefix("file:"))
    session._WRITTEN[spark.sparkContext.applicationId] = kept


def test_detail_shuffles_findings_once(spark):
    from keystrata.operators import listing

    assets, evidence = merge.build_assets(frame(spark, random_findings(5, 60, "lines")))
    evidence = spark.createDataFrame(evidence.collect(), evidence.schema)
    detail = listing.asset_detail(assets, evidence, 7)
    whole = detail._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(asset_id" in whole and not re.search(r"hashpartitioning\(asset_id#\d+, path_key", whole)
    assert sum(len(x.supporting_finding_ids) for x in detail.collect()) == evidence.join(assets, "asset_id").count()


def sort_orders(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"\bSort \[(.*?)\], false", plan)]


def test_findings_are_sorted_by_a_number_first(spark):
    found = cluster.assign_clusters(frame(spark, random_findings(5, 60, "wide")))
    folded = sort_orders(cluster.fold_dealt(found.profiled))
    assert len(folded) == 1 and folded[0].startswith("_key ASC") and "profile_id ASC" in folded[0]
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        evidence = merge.asset_evidence(found, merge.merge_clusters(found.profiles, found.clusters))
        assert sort_orders(evidence)[0].startswith("_key ASC")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_profiles_with_one_number_stay_apart(spark, monkeypatch):
    rows = random_findings(6, 200, "wide library")
    found = cluster.assign_clusters(frame(spark, rows))
    plain = lambda df: sorted(map(str, df.drop("score_sum").collect()))
    members = lambda f: plain(merge.asset_evidence(f, merge.merge_clusters(f.profiles, f.clusters)))
    want, evidence = plain(cluster.fold_profiles(found.profiled)), members(found)
    monkeypatch.setattr(cluster, "profile_key", lambda: F.lit(1).cast("long"))
    assert plain(cluster.fold_dealt(found.profiled)) == want
    assert members(found) == evidence


def test_components_are_named_the_same_in_any_order():
    kinds = [("AES", 128, "", ""), ("AES", None, "GCM", ""), ("", 256, "", "c1"), ("RSA", None, "", ""), ("SHA", None, "", "c2")]
    frame_of = lambda rows: pd.DataFrame(rows, columns=[*cluster._KIND]).assign(boundless=False)
    named = lambda rows: {tuple(map(str, x[:4])): x[5] for x in cluster._components((), frame_of(rows)).itertuples(index=False)}
    assert named(kinds) == named(kinds[::-1]) == named(kinds[2:] + kinds[:2])


def test_rows_of_one_line_share_their_island(spark):
    rows = [(f"p{p}", line, n) for p in range(40) for line in (1, 2, 9, 10, 30) for n in range(30)]
    df = spark.createDataFrame(rows, "path_key string, line int, n int").repartition(7)
    got = {(r.line, r.island) for r in cluster.line_islands(df, ["path_key"]).distinct().collect()}
    assert got == {(1, 1), (2, 1), (9, 9), (10, 9), (30, 30)}
