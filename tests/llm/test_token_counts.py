import base64
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from memlake.llm import token_counts as tc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, docs long, tokens long"
CHANGES = "op string, source string, lang string, text string, old_source string, old_lang string, old_text string"


def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text):
    return len(encoder().encode_ordinary(text)) if text else 0


def test_query_against_plain_counts(spark, tables):
    data = [(i, t, lang, s, 1, 7, 7) for i, (t, lang, s) in enumerate([("one two", "en", "a"), ("été  \n\n x", "fr", "a"), (None, "en", None), ("", None, "a"), ("<|endoftext|>", "en", "a"), ("one two", "en", "a"), ("word " * 5000, "en", "b")])]
    data += [data[0]]
    want, n = Counter(), Counter()
    for _, t, lang, s, *_ in data:
        want[(s, lang)] += count(t)
        n[(s, lang)] += 1
    got = tc.op1_token_counts(spark, tables(documents=(data, DOCS))).collect()
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in got} == {k: (n[k], want[k]) for k in n}
    assert {r.tokenizer_version for r in got} == {tc.VERSION}
    assert tc.op1_token_counts(spark, tables(documents=([], DOCS))).collect() == []


def test_signed_batches_commit_once_in_any_order(spark, tmp_path):
    rollup = tc.Rollup(spark, f"{tmp_path}/r")
    assert rollup.totals().collect() == []
    load = spark.createDataFrame([("insert", "a", "en", "one two three", None, None, None), ("insert", "a", "en", "four", None, None, None), ("insert", "b", "fr", "x", None, None, None)], CHANGES)
    later = spark.createDataFrame([("revise", "b", "en", "one", "a", "en", "one two three"), ("delete", None, None, None, "b", "fr", "x")], CHANGES)
    second, first = tc.deltas(tc.signed_rows(later)), tc.deltas(tc.signed_rows(load))
    assert rollup.commit("2", second) and rollup.commit("1", first)
    assert not rollup.commit("1", first) and not rollup.commit("2", second)
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in rollup.totals().collect()} == {("a", "en"): (1, count("four")), ("b", "en"): (1, count("one"))}
    assert rollup.batches() == ["1", "2"]
    with pytest.raises(ValueError):
        rollup.commit("../x", first)


def test_a_batch_that_broke_off_is_written_anew(spark, tmp_path):
    rollup = tc.Rollup(spark, f"{tmp_path}/r")
    rows = tc.deltas(tc.signed_rows(spark.createDataFrame([("insert", "a", "en", "one", None, None, None)], CHANGES)))
    rows.write.parquet(f"{tmp_path}/r/batch_id=1")
    (tmp_path / "r" / "batch_id=1" / "_SUCCESS").unlink()
    assert rollup.totals().collect() == [] and rollup.commit("1", rows)
    assert [(r.docs, r.tokens) for r in rollup.totals().collect()] == [(1, count("one"))]


def test_unknown_op_is_an_error(spark):
    with pytest.raises(Exception, match="unknown op"):
        tc.signed_rows(spark.createDataFrame([("upsert", "a", "en", "one", None, None, None)], CHANGES)).collect()


def test_long_texts_count_the_same_in_pieces(monkeypatch):
    text = "alpha Beta  gamma 12 34 -- it's x\n\n y é日本 " * 300
    want = count(text)
    for n in (7, 100, 999):
        monkeypatch.setattr(tc, "LONG_TEXT", n)
        assert tc.count_tokens(text) == want
