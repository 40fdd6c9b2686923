import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from memlake.llm import toxicity
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_mixing import levels
from tests.llm.test_packing import check as packs
from tests.llm.test_shingle_join import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, __x int"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the output of each stage over real documents."""
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        got = spark.read.parquet(f"{base}/{name}")
        out.append((docs.collect(), got.collect()))
        docs = got
    return out


def test_names_and_columns(stages, spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "shingle_join", "mixing", "packing"]
    for _, got in stages[:4]:
        assert list(got[0].asDict()) == COLUMNS
    run = cp.run(spark, SF).collect()
    assert Counter(map(str, run)) == Counter(map(str, stages[4][1]))


def test_toxic_documents_go_and_only_those(stages, spark):
    before, after = stages[0]
    scored = toxicity.op2_toxicity(spark, SF).collect()
    toxic = {r.doc_id for r in scored if r.predicted == 1}
    assert toxic and Counter(map(tuple, after)) == Counter(tuple(r) for r in before if r.doc_id not in toxic)


def test_lines_against_plain_counts(stages):
    before, after = stages[1]
    want = dict(plain_lines([(r.doc_id, r.source, r.text) for r in before]))
    assert {r.doc_id: r.text for r in after} == want and len(before) == len(after)


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    comp = {i: c for i, _, c in brute([(r.doc_id, r.text) for r in before], 80, 100, 5)}
    assert sorted(r.doc_id for r in after) == sorted(i for i, c in comp.items() if i == c)


def test_mix_and_windows(stages):
    before, after = stages[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, taken = defaultdict(int), defaultdict(int)
    for r in before:
        total[r.source] += size(r.text)
    for r in after:
        taken[r.source] += size(r.text)
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    for s, t in levels(total).items():
        assert abs(taken[s] - t) <= 50
    assert packs(stages[4][1], [(r.doc_id, r.text) for r in after]) == 0


def test_hard_rows_pass_through(spark, tmp_path):
    rows = [(None, "alone words here", None, None, None, 0.5, 1), (None, None, None, None, None, None, None), (1, "", "en", "a", 0, 0.1, 1), (1, "", "en", "a", 0, 0.1, 1), (2, "one two three four five six", "en", "a", 1, 0.9, 2), (2, "one two three four five six", "en", "a", 1, 0.9, 2), (3, "x " * 20_000, "en", "b", 1, 0.9, 2)]
    docs, seen = spark.createDataFrame(rows, DOCS), []
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(Counter((r.doc_id, r.text) for r in docs.collect()) if i < 4 else docs.collect())
    every = Counter((r[0], r[1]) for r in rows)
    assert seen[0] == every and seen[1] == every  # nothing is toxic, no line is boilerplate
    assert seen[2] == Counter({(None, "alone words here"): 1, (None, None): 1, (1, ""): 2, (2, rows[4][1]): 1, (3, rows[6][1]): 1})
    assert set(seen[3]) <= set(seen[2]) and max(seen[3].values()) <= 6
    assert {r.doc_id for r in seen[4]} == {i for i, _ in seen[3]}
    none = spark.createDataFrame([], DOCS)
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, none, SF).write.parquet(f"{tmp_path}/none{i}")
        none = spark.read.parquet(f"{tmp_path}/none{i}")
    assert none.count() == 0 and docs.count() > 0


def test_each_group_of_copies_keeps_one_whole_text(spark, tmp_path):
    text = lambda i: "\n".join(f"sentence {k} of text {i} says {i * k} things in words" for k in range(6))
    rows = [(10 * i + c, text(i), "en", f"site {i % 3}", 1, 0.5, 1) for i in range(6) for c in range(1 + i)]
    docs = spark.createDataFrame(rows, DOCS)
    cp.line_dedup(spark, docs, SF).write.parquet(f"{tmp_path}/lines")
    got = cp.shingle_join(spark, spark.read.parquet(f"{tmp_path}/lines"), SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(10 * i, text(i)) for i in range(6)]
