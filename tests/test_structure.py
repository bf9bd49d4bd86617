"""Heading trees, streaming, readers, and every registered query on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corvid.operators import checks, judge
from corvid.operators import sections as S
from corvid.operators import structure
from corvid.operators.registry import sort_key
from corvid.plans import catalogue
from corvid.sources import readers
from corvid.streaming import stream

MD = """---
report_id: R
# not a heading <!-- id: x -->
---
before
# One <!-- id: R_c1 -->

text
### Deep <!-- id: R_c1s1 -->
deep text
## Two <!-- id: R_c1s2 -->
# 참고문헌 <!-- id: R_c2 -->
refs"""


def test_heading_tree(spark):
    docs = spark.createDataFrame([(1, MD), (2, "no headings")], "doc_id long, text string")
    heads = S.headings(S.markdown_lines(docs))
    rows = {r.hid: r for r in heads.collect()}
    assert {h: (r.depth, r.parent, r.body_end - r.line, r.end_line - r.line) for h, r in rows.items()} == {
        "R_c1": (1, None, 3, 6), "R_c1s1": (3, "R_c1", 2, 2), "R_c1s2": (2, "R_c1", 1, 1), "R_c2": (1, None, 2, 2),
    }
    assert {r.hid: r.ordinal for r in S.paths(heads).collect()} == {"R_c1": "c1", "R_c1s1": "c1s1", "R_c1s2": "c1s2", "R_c2": "c2"}


@pytest.mark.parametrize("size, kinds", [(199, []), (200, ["subtree"]), (4000, ["subtree"]), (4001, ["subtree"])])
def test_unit_sizes(spark, size, kinds):
    docs = spark.createDataFrame([(1, "# A <!-- id: a_c1 -->\n" + "x" * size)], "doc_id long, text string")
    assert [r.kind for r in S.units(docs).collect()] == kinds


def test_large_parents_split(spark):
    text = "# A <!-- id: a_c1 -->\n" + "x" * 250 + "\n## B <!-- id: a_c1s1 -->\n" + "y" * 3900 + "\n# 부록 <!-- id: a_c2 -->\n" + "z" * 900
    got = {r.hid: (r.kind, r.chars) for r in S.units(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got == {"a_c1": ("intro", 250), "a_c1s1": ("subtree", 3900)}


def test_chapters_need_two_in_turn(spark):
    lines = spark.createDataFrame([(1, 0, "1. A"), (1, 1, "3. C"), (1, 2, "2. B"), (2, 0, "1. only")], "doc_id int, addr int, text string")
    assert [(r.doc_id, r.addr, r.value) for r in structure.chapters(lines).orderBy("addr").collect()] == [(1, 0, 1), (1, 2, 2)]


def test_streaming_streaks_equal_batch(spark, tmp_path):
    rows = [("s", f"h{k % 3}", k, ["PASS", "FAIL", "FAIL", "WARN"][k * 7 % 4], str(k * k % 5)) for k in range(40)]
    df = spark.createDataFrame(rows, "stem string, hid string, seq long, verdict string, summary_sha string")
    df.repartition(1).write.parquet(f"{tmp_path}/in")
    q = stream.streaks(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("streaks").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("streaks").collect()} == {tuple(r) for r in judge.streaks(df).collect()}


def test_streaming_sync(spark, tmp_path):
    schema = "filepath string, version long, content string, complete boolean"
    read = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def step(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream.sync_batches(read(), f"{tmp_path}/ledger", f"{tmp_path}/c").awaitTermination()
        return {r.filepath for r in stream.ledger_at(spark, f"{tmp_path}/ledger").collect()}

    assert step(("a", 1, "1", True), ("b", 1, "1", False)) == {"a"}
    assert step(("b", 2, "2", True), ("c", 1, "1", True), ("c", 2, "2", False)) == {"a", "b"}
    assert step(("a", 2, "1", False), ("b", 3, None, True)) == {"a"}  # unchanged, gone


def test_registry_files(spark, tmp_path):
    from corvid.operators import registry

    with open(f"{tmp_path}/r.tsv", "w") as f:
        f.write("file\treport_id\textra\nb.pdf\t2020-02\tx\na.pdf\t2020-01\ty\n")
    rows = readers.read_registry(spark, f"{tmp_path}/r.tsv")
    assert rows.columns == list(registry.COLUMNS) and {r.note for r in rows.collect()} == {""}
    p = registry.parsed(rows)
    readers.write_registry(p, f"{tmp_path}/out", sort_key(p))
    assert [r.file for r in readers.read_registry(spark, f"{tmp_path}/out").collect()] == ["a.pdf", "b.pdf"]


def test_markdown_files(spark, tmp_path):
    with open(f"{tmp_path}/2020-01.md", "w") as f:
        f.write(MD + "\n")
    row = readers.read_markdown(spark, f"{tmp_path}/*.md").first()
    assert row.stem == "2020-01" and row.text == MD




def test_front_matter_is_rewritten(spark):
    from corvid.operators import frontmatter as M

    head = "---\nreport_id: R\nverified_annotate: z\nsummary_reviewed: x\nverified_register: a\n---\nverified_extract: body"
    row = spark.createDataFrame([(head,)], "t string")
    stamps = [F.lit(v) for v in ("1", "2", "")]
    got = row.select(M.with_stamps(F.col("t"), *stamps).alias("s"), M.with_reviewed(F.col("t"), F.array(F.lit("b"), F.lit("a"))).alias("r"), M.with_stamps(F.col("t"), F.lit(""), F.lit("2"), F.lit("")).alias("broken")).first()
    assert got.s == "---\nreport_id: R\nsummary_reviewed: x\nverified_register: 1\nverified_extract: 2\n---\nverified_extract: body"
    assert got.r == "---\nreport_id: R\nsummary_reviewed: a b\nverified_annotate: z\nverified_register: a\n---\nverified_extract: body" and got.broken is None
    none = spark.createDataFrame([("no front matter",), (None,), ("",)], "t string").select(M.with_stamps(F.col("t"), F.lit(""), F.lit(""), F.lit("")).alias("s"), M.without_stamps(F.col("t")).alias("w")).collect()
    assert [r.s for r in none] == ["no front matter", None, ""] and [r.w for r in none] == ["no front matter", None, ""]


def test_assigned_ids_are_swapped_or_left(spark):
    from corvid.operators import register

    rows = spark.createDataFrame([("a", "", "2020-01", "cover", "", "d", ""), ("b", "", "2020-02", "cover", "", "d", ""), ("c", "", "", "", "", "", "")], "file string, pages string, report_id string, source string, cover_title string, registered string, note string")
    ask = lambda *x: spark.createDataFrame(x, "batch string, file string, pages string, report_id string")
    new = lambda *x: {r.file: r.report_id for r in register.assign(rows, ask(*x), "today").collect()}
    assert new(("1", "a", "", "2020-02"), ("1", "b", "", "2020-01"), ("2", "c", "", "2021-00")) == {"a": "2020-02", "b": "2020-01", "c": "2021-00-v1"}
    assert new(("1", "c", "", "2020-02")) == {"a": "2020-01", "b": "2020-02", "c": ""}


def test_contents_chains(spark):
    from corvid.operators import pages

    texts = {0: ["목 차", "a"], 1: ["1", "2", "3"], 2: ["plain"], 3: ["CONTENTS"], 4: ["4", "표 차례"], 5: ["5", "6", "7"]}
    rows = [(1, p, k, t) for p, ts in texts.items() for k, t in enumerate(ts)]
    got = {r.page: r.lane for r in pages.contents_pages(spark.createDataFrame(rows, "doc_id int, page int, line int, text string")).collect()}
    assert got == {0: "primary", 1: "primary", 3: "secondary", 4: "secondary"}


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_runs(spark, name):
    df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(df.columns) == len(set(map(str.lower, df.columns))) and df.limit(5).collect() is not None


def test_contract(spark):
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("most", [0, 2, 6])
def test_similar_titles_without_pairing_all(spark, monkeypatch, most):
    import random
    import re

    from corvid import config
    from corvid.operators import registry

    monkeypatch.setattr(registry, "MOST", most)
    rng = random.Random(5)
    parts = ["가나다", "가나다라", "나다라", "마바사아", "가나다라마바", "보고서", "자차"]
    titles = {k: " ".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for k in range(60)}
    words = {k: {w for w in re.findall("[가-힣]{3,}", t) if w not in config.TITLE_STOP} for k, t in titles.items()}
    want = set()
    for a in titles:
        shared = {b: sum(len(w) for w in words[a] | words[b] if (w in words[a] and w in titles[b]) or (w in words[b] and w in titles[a])) for b in titles if b != a}
        for rank, b in enumerate(sorted((b for b in shared if shared[b]), key=lambda b: (-shared[b], b))[:3], 1):
            want.add((a, b, shared[b], rank))
    got = registry.similar(spark.createDataFrame(list(titles.items()), "id long, title string"))
    assert got.columns == ["id", "other", "shared", "rank"] and {tuple(r) for r in got.collect()} == want


def test_similar_titles_of_one_word_are_not_paired(spark):
    from corvid.operators import registry

    rows = spark.range(4000).selectExpr("id", "'가나다라' AS title")
    got = registry.similar(rows)
    assert got.groupBy("other").count().count() == 4 and got.count() == 12000


def test_report_rows_make_their_documents_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(k, f"# A <!-- id: {k}_c1 -->\n" + "x" * 300) for k in range(5)], "doc_id long, text string").mapInArrow(count, "doc_id long, text string")
    assert {(r.doc_id, r.hid, r.body) for r in S.report_rows(docs).collect()} == {(k, f"{k}_c1", "x" * 300) for k in range(5)}
    assert made.value == 5


def test_coverage_folds_each_line_once(spark):
    lines = [(1, 0, 0, "a  b"), (1, 0, 1, "a b .... 3"), (1, 0, 2, " □ "), (1, 0, 3, "편집 순서 1"), (1, 1, 0, "□ 없 다"), (1, 1, 1, None), (2, 0, 0, "x")]
    found = checks.uncovered(spark.createDataFrame(lines, "doc_id long, page int, line int, text string"), spark.createDataFrame([(1, "xa b\n"), (3, "x")], "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0, "a  b", True), (1, 1, 0, "□ 없 다", False)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2  # of the line and of the document
