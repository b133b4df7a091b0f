import json

import pytest
from pyspark.sql import functions as F

from filewright import profile, sinks
from filewright.config import InconsistentPolicy, RetentionPolicy, Taxonomy, drift
from filewright.operators import placement, policy, skew
from filewright.plans import jobs, pipeline
from filewright.sources import inventory

TAXONOMY, POLICY = Taxonomy(), RetentionPolicy.default()


def plan(spark, rows):
    """rows: (path, category)"""
    return spark.createDataFrame(
        [(i, p, c, 95, "Rules", "r") for i, (p, c) in enumerate(rows)],
        "seq long, path string, category string, confidence int, method string, reason string")


def listing(spark, paths):
    return spark.createDataFrame([(p, 10) for p in paths], "path string, size_bytes long")


def test_policy_covers_the_taxonomy():
    POLICY.must_fit(TAXONOMY.names)
    with pytest.raises(InconsistentPolicy, match="Extra: not in the policy"):
        POLICY.must_fit([*TAXONOMY.names, "Extra"])
    with pytest.raises(InconsistentPolicy, match="Travel_Transit: in the policy only"):
        POLICY.must_fit([n for n in TAXONOMY.names if n != "Travel_Transit"])
    with pytest.raises(InconsistentPolicy, match="more than once: a, b"):
        RetentionPolicy.of({"keep": ["a", "b", "b"], "leave": ["a"]})


def test_drift_table(spark):
    left = spark.createDataFrame([("a",), ("b",), ("a",)], "category string")
    right = spark.createDataFrame([("b",), ("c",)], "category string")
    assert sorted(map(tuple, drift(left, right).collect())) == [("a", "no disposition"), ("c", "no such category")]


def test_load_files(spark, tmp_path):
    raw = {"categories": {"A": {"extensions": [".x"], "keywords": ["one two", "co-op"]}, "B": {}}, "settings": {"confidence_threshold": 70},
           "markers": [["^a\\b", "A", "starts with a"]]}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(raw))
    t = Taxonomy.load(path)
    assert t.names == ["A", "B"] and t.threshold == 70 and t.markers == [("^a\\b", "A", "starts with a")]
    assert t.dead_keywords() == ["co-op"]
    assert [tuple(r)[1:] for r in t.report(spark).collect()] == [("A", ".x", 2), ("B", "(any)", 0)]
    yaml = pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text(yaml.safe_dump({"dispositions": {"keep": ["A"], "review": None}, "never_export": ["A"]}))
    p = RetentionPolicy.load(tmp_path / "p.yaml")
    assert p.by_category == {"A": "keep"} and p.barred == {"A"}
    assert [tuple(r) for r in p.report(spark).collect()] == [("keep", ["A"], ["A"])]


def test_dead_keywords_of_the_profile():
    assert TAXONOMY.dead_keywords() == ["liberty-corp", "id_rsa", "customer-metadata"]


def test_unknown_category_fails_closed(spark):
    with pytest.raises(Exception, match="category 'Nope' has no disposition"):
        policy.disposition_counts(plan(spark, [("/a", "Nope")]), POLICY).collect()


def test_export_takes_keep_only_and_never_secrets(spark):
    wrong = RetentionPolicy.of({**profile.DISPOSITIONS, "keep": ["Credentials_Secrets", "Financial_Taxes"], "review": []}, ["Credentials_Secrets"])
    df = plan(spark, [("/a/x.pdf", "Financial_Taxes"), ("/b/x.pdf", "Financial_Taxes"), ("/a/k.txt", "Credentials_Secrets"),
                      ("/a/w.txt", "Customer_Data")])
    got = {r.path: (r.dest, r.status) for r in placement.export_plan(df, wrong, "/out").collect()}
    assert got == {"/a/x.pdf": ("/out/Financial_Taxes/x.pdf", "exported"), "/b/x.pdf": ("/out/Financial_Taxes/x_1.pdf", "exported"),
                   "/a/k.txt": (None, "skipped_never_export")}


def test_manifest_and_review(spark, tmp_path):
    df = plan(spark, [("/z/q\"uote, x.pdf", "Financial_Taxes"), ("/a/u.bin", "Unknown_Unsorted"), ("/b/k.txt", "Credentials_Secrets"),
                      ("/a/i.xml", "Customer_Data")])
    for applied in (True, False):
        rows = policy.manifest(df, POLICY, applied).collect()
        assert [r.disposition for r in rows] == ["keep", "leave", "review", "review"]
        assert [r.exported for r in rows] == ["yes" if applied else "no", "no", "no", "no"]
    assert rows[0].__fields__ == ["disposition", "exported", "category", "confidence", "method", "filename", "source_path", "reason"]
    assert [r.filename for r in policy.review_list(df, POLICY).collect()] == ["k.txt", "u.bin"]
    sinks.write_manifest(policy.manifest(df, POLICY, True), str(tmp_path / "m"))
    import csv

    lines = [r for p in sorted((tmp_path / "m").glob("part-*")) for r in list(csv.reader(p.open()))[1:]]
    assert len(lines) == 4 and 'q"uote, x.pdf' in lines[0]


def test_candidates(spark):
    df = listing(spark, ["/r/a.pdf", "/r/Financial_Taxes/b.pdf", "/r/Media_Images", "/r/.filewright_log", "/r/s/c.pdf", "/r/s/Financial_Taxes/d.pdf", "/x/e.pdf"])
    found = {r.path for r in inventory.candidates(df, "/r", TAXONOMY.names).collect()}
    assert found == {"/r/a.pdf", "/r/s/c.pdf", "/r/s/Financial_Taxes/d.pdf"}
    assert {r.path for r in inventory.candidates(df, "/r/", TAXONOMY.names, recursive=False).collect()} == {"/r/a.pdf"}


def test_sort_then_undo(spark, tmp_path):
    before = ["/r/my resume 7.pdf", "/r/lettersT4.pdf", "/r/blob 12.bin", "/r/.DS_Store", "/r/Canadian_PR_Docs/lettersT4.pdf"]
    out = jobs.sort(listing(spark, before), "/r", TAXONOMY, stages=pipeline.RULES_ONLY)
    moves = {r.path: r.dest for r in out.moves.collect()}
    assert moves == {"/r/my resume 7.pdf": "/r/Resumes_Career_Tech/my resume 7.pdf", "/r/lettersT4.pdf": "/r/Canadian_PR_Docs/lettersT4_1.pdf"}
    log = str(tmp_path / "log")
    jobs.apply_moves(out.moves, log, "run-1", "2024-01-01 00:00:00")
    after = ["/r/Resumes_Career_Tech/my resume 7.pdf", "/r/Canadian_PR_Docs/lettersT4_1.pdf", "/r/my resume 7.pdf"]
    undone = {r.original: (r.restored_to, r.status) for r in jobs.undo(spark, log, listing(spark, after)).collect()}
    assert undone == {"/r/my resume 7.pdf": ("/r/my resume 7_restored_1.pdf", "restored"), "/r/lettersT4.pdf": ("/r/lettersT4.pdf", "restored")}
    undone = jobs.undo(spark, log, listing(spark, after[:1]))
    assert tuple(placement.undo_counts(undone).first()) == (1, 1)


def test_log_grows_and_refuses_broken_lines(spark, tmp_path):
    log = tmp_path / "log"
    moves = plan(spark, [("/a", "Financial_Taxes")]).withColumn("dest", F.lit("/b"))
    jobs.apply_moves(moves.limit(0), str(log), "r0", "2024-01-01 00:00:00")
    assert not log.exists()
    for run in ("r1", "r2"):
        jobs.apply_moves(moves, str(log), run, "2024-01-01 00:00:00")
    assert sorted(r.run_id for r in sinks.read_move_log(spark, str(log)).collect()) == ["r1", "r2"]
    (log / "broken.json").write_text("{not json\n")
    with pytest.raises(Exception, match="broken.json"):
        sinks.read_move_log(spark, str(log)).collect()


def test_manifest_keeps_blanks(spark, tmp_path):
    sinks.write_manifest(spark.createDataFrame([(" a.pdf", "b ")], "filename string, reason string"), str(tmp_path / "m"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "m")).collect()] == [(" a.pdf", "b ")]


def test_offboard_writes_only_when_applied(spark, tmp_path):
    src = listing(spark, ["/r/my resume 7.pdf", "/r/id_rsa", "/r/server.log"])
    dest = str(tmp_path / "out")
    dry = jobs.offboard(src, "/r", TAXONOMY, POLICY, dest, stages=pipeline.RULES_ONLY)
    assert dry.export.count() == 1 and not (tmp_path / "out").exists()
    assert [r.exported for r in dry.manifest.collect()] == ["no"] * 3
    jobs.offboard(src, "/r", TAXONOMY, POLICY, dest, stages=pipeline.RULES_ONLY, apply=True)
    kept = spark.read.parquet(dest + "/export")
    assert [(r.path, r.category) for r in kept.collect()] == [("/r/my resume 7.pdf", "Resumes_Career_Tech")]
    assert spark.read.option("header", True).csv(dest + "/manifest").count() == 3
    with pytest.raises(InconsistentPolicy):
        jobs.offboard(src, "/r", TAXONOMY, RetentionPolicy.of({"keep": []}), dest)


def one_by_one(log, present):
    """Undo as a person would: latest move first, looking at what is there each time."""
    there, out = set(present), {}
    for seq, original, new in sorted(log, reverse=True):
        if new not in there:
            out[seq] = (None, "missing")
            continue
        there.discard(new)
        stem, dot, ext = original.rpartition(".")
        place = next(p for k in range(99) if (p := f"{stem}_restored_{k}{dot}{ext}" if k else original) not in there)
        there.add(place)
        out[seq] = (place, "restored")
    return out


def undone(spark, log, present):
    df = spark.createDataFrame([("r", i, o, n, "c") for i, o, n in log], "run_id string, seq long, original string, new string, category string")
    return {r.seq: (r.restored_to, r.status) for r in placement.undo_plan(df, listing(spark, present)).collect()}


@pytest.mark.parametrize("log, present", [
    ([(1, "/a.x", "/C/a.x"), (2, "/b.x", "/C/a.x")], ["/C/a.x"]),  # a place used twice
    ([(1, "/a.x", "/C/a.x"), (2, "/C/a.x", "/D/a.x"), (3, "/D/a.x", "/E/a.x")], ["/E/a.x"]),  # a chain
    ([(1, "/a.x", "/C/a.x"), (2, "/b.x", "/a.x")], ["/C/a.x", "/a.x"]),  # a place that is freed first
    ([(1, "/A.x", "/Z.x"), (2, "/q.x", "/A.x"), (3, "/A.x", "/B.x")], ["/B.x", "/Z.x"]),  # passed through, then wanted
    ([(1, "/a.x", "/C/a.x"), (2, "/a.x", "/C/b.x")], ["/C/a.x", "/C/b.x", "/a.x"]),  # taken, for two
    ([(1, "/a.x", "/C/a.x"), (2, "/C/a.x", "/D/a.x")], ["/D/a.x", "/C/a.x"]),  # a chain whose middle is taken
])
def test_undo_equals_one_by_one(spark, log, present):
    assert undone(spark, log, present) == one_by_one(log, present)


def test_a_bundle_carries_contents_or_leaves_nothing(spark, tmp_path):
    plan = spark.createDataFrame([(i, f"/r/{i}", "A" if i % 3 else "B", f"/b/{i}", "exported" if i else "skipped_never_export") for i in range(9)],
                                 "seq long, path string, category string, dest string, status string")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "seq long, text string")
    folder = str(tmp_path / "out" / "export")
    sinks.write_bundle(plan, texts, folder, "seq")
    assert sorted((r.seq, r.text, r.category) for r in sinks.read_bundle(spark, folder).collect()) == [(i, f"text {i}", "A" if i % 3 else "B") for i in range(1, 9)]
    with pytest.raises(FileExistsError):
        sinks.write_bundle(plan, texts, folder, "seq")
    failing = texts.withColumn("text", F.when(F.col("seq") == 5, F.raise_error(F.lit("unreadable"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="unreadable"):
        sinks.write_bundle(plan, failing, str(tmp_path / "out" / "other"), "seq")
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")] == ["export"]


def test_an_undo_closes_the_log(spark, tmp_path):
    log = str(tmp_path / "log")
    moves = spark.createDataFrame([(1, "/a/x", "/a/A/x", "A"), (2, "/a/y", "/a/A/y", "A")], "seq long, path string, dest string, category string")
    present = spark.createDataFrame([("/a/A/x",), ("/a/A/y",)], "path string")
    sinks.close_move_log(spark, log, "u0", "2024-01-01 00:00:00")  # there is no log yet
    jobs.apply_moves(moves.where("seq = 1"), log, "r1", "2024-01-01 00:00:00")
    jobs.apply_moves(moves.where("seq = 2"), log, "r2", "2024-01-01 00:00:01")
    assert [r.status for r in jobs.undo(spark, log, present).collect()] == ["restored"] * 2  # a look changes nothing
    assert [r.status for r in jobs.undo(spark, log, present, apply=True).collect()] == ["restored"] * 2
    assert jobs.undo(spark, log, present, apply=True).collect() == []
    jobs.apply_moves(moves, log, "r3", "2023-01-01 00:00:00")  # a later run, whatever its clock says
    assert [r.original for r in jobs.undo(spark, log, present, apply=True).collect()] == ["/a/y", "/a/x"]
    assert jobs.undo(spark, log, present).collect() == [] and sinks._log(spark, log).where("closes").count() == 2


def test_a_long_chain_takes_few_tables_and_a_hot_place_many_parts(spark, monkeypatch):
    """One file moved sixteen times and then gone; and a place through which a third of all files went."""
    written = []
    whole = placement.cut_lineage
    monkeypatch.setattr(placement, "cut_lineage", lambda df: written.append(1) or whole(df))
    monkeypatch.setattr(skew, "cut_lineage", lambda df: written.append(1) or whole(df))
    chain = [(i, f"/c/{i}", f"/c/{i + 1}") for i in range(16)]
    log = spark.createDataFrame([(s, a, b, "A") for s, a, b in chain], "seq long, original string, new string, category string")
    nothing = spark.createDataFrame([], "path string")
    steps = placement._steps(log, nothing)
    assert len(written) <= 9 and steps.where("_found").count() == 0
    there = spark.createDataFrame([("/c/16",)], "path string")
    assert placement._steps(log, there).where("NOT _found").count() == 0
    monkeypatch.setattr(skew, "ROWS_PER_PART", 50)
    hot = [(i, "/inbox/scan.pdf", f"/A/scan_{i}.pdf") for i in range(300)] + [(1000 + i, f"/o/{i}", f"/A/{i}") for i in range(300)]
    log = spark.createDataFrame([(s, a, b, "A") for s, a, b in hot], "seq long, original string, new string, category string")
    there = log.where("seq % 4 <> 0").select(F.col("new").alias("path"))
    got = {r.original + str(r.seq): (r.restored_to, r.status) for r in placement.undo_plan(log, there).collect()}
    turn = [s for s in range(299, -1, -1) if s % 4]
    want = {f"/inbox/scan.pdf{s}": ("/inbox/scan.pdf" if not i else f"/inbox/scan_restored_{i}.pdf", "restored") for i, s in enumerate(turn)}
    assert {k: got[k] for k in want} == want and sum(v[1] == "missing" for v in got.values()) == 150
