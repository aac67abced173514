import corpus_pipeline as C
from caseflow.llm import packing
from caseflow.llm.common import written
from tests.conftest import SF_ORACLE
from tests.llm.test_lines_and_rules import WORD, plain_features, plain_pairs
from tests.llm.test_pack import check
from tests.llm.test_superminhash import brute


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_every_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        after = written(stage(spark, docs, SF_ORACLE), f"test-{name}")
        seen[name] = (docs, after)
        docs = after
    assert list(seen) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert all(after.columns == columns for n, (_, after) in seen.items() if n != "packing")

    before, after = seen["quality_rules"]
    passed = {d for d, t in texts(before) if (f := plain_features(t))[0] >= 20 and 100 * f[4] <= 30 * f[0]}
    assert {d for d, _ in texts(after)} == passed                # no host of this table fails as a whole

    before, after = seen["line_dedup"]
    left, first = dict(texts(after)), {}
    lines = sorted((d, i, frozenset(WORD.findall(x.lower()))) for d, t in texts(before) for i, x in enumerate(t.split("\n")))
    kept = []
    for d, t in sorted(texts(before)):
        out = []
        for x in t.split("\n"):
            s = frozenset(WORD.findall(x.lower()))
            if not s or s not in first:
                first.setdefault(s, d)
                out.append(x)
        kept.append((d, out))
    # exact copies by sets are gone; what is gone beyond them matches an earlier line
    for d, out in kept:
        got = left.get(d, "").split("\n")
        for x in out:
            if x not in got and WORD.search(x):
                s = frozenset(WORD.findall(x.lower()))
                assert any(100 * len(s & u) >= 80 * len(s | u) for e, i, u in lines if u and u != s), (d, x)
        assert [x for x in got if WORD.search(x)] == [x for x in out if x in got and WORD.search(x)]

    before, after = seen["near_dedup"]
    assert {d for d, _ in texts(after)} == {d for d, _, c in brute(texts(before), 80) if d == c}

    before, after = seen["decontamination"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_ORACLE}/benchmark.parquet").collect()]
    bad = {d for d, *_ in plain_pairs(texts(before), bench)}
    assert {d for d, _ in texts(after)} == {d for d, _ in texts(before)} - bad

    before, after = seen["packing"]
    check(after, texts(before), packing.CAPACITY)


def test_empty_and_null_rows(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    good = " ".join(f"w{i}" for i in range(40))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()),
                        ("n_chars", pa.int64())])
    bench = pa.table({"item_id": pa.array([1], pa.int64()), "text": ["nothing like it at all here"]})
    rows = [(None, good, None, None, 1), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, good, "en", None, 1),
            (3, good, "en", None, 1)]
    for name, data in (("a", rows), ("b", [])):
        folder = tmp_path / name
        folder.mkdir()
        pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in data], schema=schema),
                       folder / "documents.parquet")
        pq.write_table(bench, folder / "benchmark.parquet")
        got = C.run(spark, str(folder)).collect()
        assert len(got) == (1 if data else 0)
