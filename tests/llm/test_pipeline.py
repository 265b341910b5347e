"""The pipeline's stages on a small table."""

import random

import pytest
from test_operators import ODD, brute_lines, brute_links, frame, words

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402


def test_stages_keep_columns_and_decide(spark, tmp_path):
    passage = " ".join(words(60, 77))
    near = words(100, 5)
    rows = [*ODD, (20, passage + "\n" + " ".join(words(30, 1))), (21, "begin of another text\n" + passage), (22, passage), (30, " ".join(near)), (31, " ".join([*near[:50], "x", *near[51:]])), (30, " ".join(near))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert len(seen["quality"]) == len({i for i, _ in rows})
    after = seen["lines"]
    assert after[21]["text"] == "begin of another text" and after[21]["n_chars"] == 21 and 22 not in after
    assert after[20]["text"].startswith(passage) and after[3]["text"] == ""
    assert 30 in seen["near_duplicates"] and 31 not in seen["near_duplicates"]
    assert docs.where("doc_id = 30").count() == 1
    assert {r["doc_id"] for r in docs.collect()} == set(seen["near_duplicates"])


def test_near_duplicates_decide_by_id_and_text(spark):
    a, b = words(100, 5), words(100, 6)
    near = lambda w, x: " ".join([*w[:50], x, *w[51:]])
    rows = [(1, " ".join(a)), (2, near(a, "x")), (2, "a text of its own that nothing else is like"), (2, near(a, "x")), (None, near(a, "y"))]
    rows += [(None, " ".join(b)), (None, near(b, "x")), (None, " ".join(b)), (None, "another text of its own, without any id"), (3, None), (3, ""), (4, "")]
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").select("doc_id", "text").collect()
    got = sorted(((r["doc_id"], r["text"]) for r in kept), key=repr)
    rest = [r for r in got if r[0] is None and r[1] in (" ".join(b), near(b, "x"))]
    assert len(rest) == 1 and len(got) == 7
    assert set(got) - set(rest) == {(1, " ".join(a)), (2, rows[2][1]), (None, rows[8][1]), (3, None), (3, ""), (4, "")}


def test_run_is_the_stages(spark, tmp_path):
    frame(spark, [(1, "some text of its own here"), (2, "and another one")]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2] and len({r["sequence_id"] for r in out}) == 1


def test_quality_with_labels_and_empty_tables(spark, tmp_path):
    r = random.Random(5)
    good = lambda: " ".join(r.choice(["the", "river", "of", "house", "and", "stone", "walks"]) for _ in range(60)) + "."
    bad = lambda: " ".join(r.choice(["BUY!!", "$$$", "%%%", "WIN!!", "###"]) for _ in range(60))
    rows = [(k, bad() if k % 4 == 0 else good()) for k in range(400)]
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, [*rows, (500, None), (1, rows[0][1])])  # an id that repeats with another text
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sum(x["doc_id"] % 4 != 0 and x["text"] is not None and "BUY" not in x["text"] for x in got) > 0.97 * 300
    assert sum(x["text"] is not None and "BUY" in x["text"] for x in got) <= 3
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_lines_and_near_duplicates_equal_brute_force(spark):
    """The two middle stages on a table with shared lines and near copies, against plain versions of themselves."""
    r = random.Random(9)
    pool = [" ".join(words(7, 40 + k)) for k in range(12)]
    rows = [(k, "\n".join([" ".join(words(30, 300 + k)), *(r.choice(pool) for _ in range(3)), " ".join(words(9, 700 + k))])) for k in range(40)]
    rows += [(100 + k, rows[k][1].replace(" ", "  ", 1)) for k in range(5)] + [(200 + k, " ".join([*words(90, 900 + k)[:80], "x"])) for k in range(3)] + [(210 + k, " ".join(words(90, 900 + k)[:80])) for k in range(3)]
    want = [(i, t) for i, t, n, gone in brute_lines(rows) if not gone or gone < n]
    lines = corpus_pipeline.lines(spark, frame(spark, rows), "").select("doc_id", "text").collect()
    assert sorted(map(tuple, lines)) == sorted(want)
    _, root = brute_links(want)
    first = {}
    for x, (i, _) in enumerate(want):
        first[root[x]] = min(first.get(root[x], i), i)
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, want), "").collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(first.values()) and len(kept) < len(want)
