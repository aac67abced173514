from collections import Counter

from caseflow.llm import langid
from caseflow.llm import toxicity as T
from caseflow.llm.queries import QUERIES
from tests.conftest import SF_ORACLE


def found(text, learned=()):
    return T.events(text, T.Lexicon.of(list(learned)), T.grammar())


def test_composed_machine_equals_the_rules():
    assert found("what an idiot") == Counter({("I", False, False, False): 1})
    assert found("you are an idiot") == Counter({("I", False, False, True): 1})
    assert found("not an idiot") == Counter({("I", True, False, False): 1})
    assert found("not one of the big words idiot") == Counter({("I", False, False, False): 1})
    assert found("he said idiot") == Counter({("I", False, True, True): 1})
    assert found("They said it. An idiot.") == Counter({("I", False, False, False): 1})
    assert found("I will kill you")[("T", False, False, True)] == 1
    assert found("I will kill time") == Counter({("T", False, False, False): 1})
    assert found("nothing here") == found("") == found(None) == Counter()
    assert found("a lowerix word", ["lower"]) == Counter({("I", False, False, False): 1})


def test_negated_and_reported_insults_weigh_less():
    m = T.Model([], [T.math.log1p(-max(0.01, T._PRIOR[e])) for e in T.EVENTS], 0.01)
    plain, negated, reported = (m.score(found(t)) for t in ("an idiot", "not an idiot", "it says idiot"))
    assert plain > reported > negated and plain >= 0.5 > negated
    assert m.score(found("kill time")) < 0.5 <= m.score(found("i will kill you"))


def test_held_out_accuracy(spark):
    p = QUERIES["op2_pattern_grammar"](spark, SF_ORACLE)
    y = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    rows = p.join(y, "doc_id").select("held_out", "predicted", "toxic").collect()
    held = [(r.predicted, r.toxic) for r in rows if r.held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert p.count() == spark.read.parquet(f"{SF_ORACLE}/documents.parquet").count()


def test_labels_of_held_out_rows_change_nothing(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    out = langid.held_out(F.col("doc_id"), 5, 0)
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (T.fit(T.labelled(docs, x, ~out)) for x in (labels, flipped))
    assert a == b


def test_only_equal_sets_of_words_count_once(spark):
    from pyspark.sql import functions as F
    low = spark.range(20_000).selectExpr("concat('w', id) AS w").orderBy(F.xxhash64("w")).first().w
    rows = [(i, f"{low} zorbify u{i} v{i}", 1) for i in range(30)] + [(100 + i, f"{low} x{i} y{i}", 0) for i in range(200)]
    rows += [(400 + i, f"{low} repeatedly " + "repeatedly " * i, 1) for i in range(30)]     # one set of words
    assert T.learn_stems(spark.createDataFrame(rows, "doc_id long, text string, toxic long")) == ["zorbi"]


def test_few_toxic_documents_and_long_beginnings_teach(spark):
    rows = [(i, f"blatherinkoo{i} u{i} v{i}", 1) for i in range(4)]
    rows += [(100 + i, f"blatherings x{i} y{i}", 0) for i in range(400)]
    got = T.learn_stems(spark.createDataFrame(rows, "doc_id long, text string, toxic long"))
    assert got == ["blatherink"]


def test_nulls_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "you idiot", 1), (2, "", 1), (2, "", 1), (3, "x" * 300_000, 1)],
                                 "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = T.fit(T.labelled(docs, none))
    got = {(r.doc_id, r.predicted) for r in T.score(docs, m).collect()}
    assert got == {(1, 0), (None, 1), (2, 0), (3, 0)}
    assert all(0 <= r.score <= 1 for r in T.score(docs, m).collect())
    assert T.score(docs.limit(0), m).count() == 0
