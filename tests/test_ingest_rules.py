"""Rules on cells: worked out once a row, and files parsed once for their posts."""

from pyspark.sql import functions as F

from banderole.functions import classify
from banderole.sources import posts_csv

HEAD = "Post Unique Reference,Name,Grade,Job Title,FTE,Actual Pay Floor (£),Actual Pay Ceiling (£),Professional/Occupational Group,Valid?"


def posts_of(spark, files):
    made = [(k, bytearray("\n".join([HEAD, *rows]).encode())) for k, rows in files.items()]
    return posts_csv.normalise(posts_csv.raw_rows(spark.createDataFrame(made, "path string, content binary")))


def test_a_file_is_parsed_once_and_no_rule_is_written_out_again(spark):
    posts, _ = posts_of(spark, {"a": ["P1,Ash,SCS1,Solicitor,1.00,70000,74999,,1"]})
    plan = posts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert [plan.count(p) for p in ("cabinet secretary", "^of\\s*[6-9]$", "tbc|unassigned", "withheld|redact")] == [1, 1, 1, 1]


def test_posts_and_files_agree_on_refusals_and_flags(spark):
    same = lambda n, grade, flag, fte="1.00": [f"R{i % 3},Ash,{grade},Solicitor,{fte},70000,74999,,{flag}" for i in range(n)]
    files = {
        "junior": same(20, "HEO", "1"),
        "few": same(19, "HEO", "1"),
        "heads": same(20, "Unheard of", "1", "12"),
        "blank": [",,,,,,,,1"] * 3,
        "flags": same(4, "SCS1", "1") + same(3, "SCS1", "0") + [",,,,,,,,0"] * 9,
        "distrusted": same(3, "SCS1", "1") + same(3, "SCS1", "0"),
    }
    posts, verdicts = posts_of(spark, files)
    assert {r["file"]: (r["reason"], r["valid_applied"]) for r in verdicts.collect()} == {
        "junior": ("junior-content", True), "few": (None, True), "heads": ("junior-content-fte", True), "blank": ("all-rows-blank", False), "flags": (None, True), "distrusted": (None, False),
    }
    got = {}
    for r in sorted(posts.collect(), key=lambda r: (r["file"], r["row_idx"])):
        got.setdefault(r["file"], []).append((r["pur"], r["ordinal"]))
    assert {k: len(v) for k, v in got.items()} == {"few": 19, "flags": 4, "distrusted": 6}
    assert got["flags"] == [("R0", 0), ("R1", 0), ("R2", 0), ("R0", 1)]


def test_phrases_are_found_as_by_their_patterns(spark):
    rules = [p for _, p in classify.PROFESSIONS] + [p for p, _ in classify.SPECIALISTS] + [p for p, _, _ in classify.TITLES]
    parts = sorted({w for p in rules for w in classify._either(p) if w.isascii()} | {"kim", "akim", "kim_", "it", "it2", "vet", "vets", "r&d", "counter fraud", "nursing", "wnurse", "hr", "chr", "", "scs 4", "pb4", "xpb4", "dg", "dgs"})
    df = spark.createDataFrame([(x,) for w in parts for x in (w, f"head of {w}", f"{w}s and more")], "t string")
    t = F.col("t")
    assert df.where(F.greatest(*((classify.holds(t, p) != t.rlike(p)).cast("int") for p in rules)) > 0).count() == 0
