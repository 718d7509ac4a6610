import random

from pyspark.sql import functions as F

from gistmill.llm import url_filter as U
from gistmill.llm.quality_rules import oracle as rules_sql
from gistmill.llm.quality_rules import quality_rules
from tests.llm.oracle import duck, rows


def texts():
    rng = random.Random(2)
    vocab = ["the", "of", "cat", "été", "#x", "a|b", "UP", "und", "zz$"]
    out = ["\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 6))) for _ in range(120)]
    out += [" ".join(["a b c d e f g h"] * 4), "x " * 50, "\t\x0b\x0c\r\n", "", None, "one two three four five six seven eight nine ten eleven " * 2, " lead and trail ", "same line\nsame line\n\n \nsame line", "w " * 9000]
    return [*enumerate(out), (3, "the repeated row"), (3, "the repeated row"), (None, "the of and to in is")]


def test_rules_equal_sql(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS n_words")
    got = quality_rules(df).toArrow()
    want = duck(rules_sql(), documents=df.select("doc_id", "text").toArrow())
    assert rows(got) == rows(want)
    assert quality_rules(df.limit(0)).count() == 0
    assert sum(got["kept"].to_pylist()) > 0


def test_rules_run_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality_rules(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan and plan.count("rlike") < 20


def pages():
    rng = random.Random(1)
    hosts = ["a.example.org", "example.org", "EXAMPLE.org", "cheap-pills.example.com", "x.cheap-pills.example.com", "notcheap-pills.example.com", "b.com", "example.net", "org", "", "a..b", "x.y:80", ".".join("a" * 200)]
    out = [(i, f"{rng.choice(['http', 'https', 'x'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/en/1', '/en/12?x', '/fr/', '/de/q#://', '?a/b', '#f'])}") for i in range(300)]
    return [*out, (1, None), (1, None), (2, "no scheme"), (3, ""), (None, "http://b.com/fr/"), (4, "http://a\nb.com/x\ny"), (5, "http://" + "a." * 3000 + "com/")]


def test_urls_equal_sql(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string").selectExpr("*", "'k' AS host", "'k' AS key")
    listed = spark.createDataFrame([(k,) for k in (*U.LISTED, None, "")], "key string")
    want = rows(duck(U.oracle(), pages=df.select("page_id", "url").toArrow()))
    assert rows(U.url_filter(df, listed).toArrow()) == want
    assert rows(U.url_filter(df, listed, most_bits=0).toArrow()) == want
    plan = U.url_filter(df, listed)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Join" not in plan


def test_cascade_is_exact_and_needs_levels(spark, monkeypatch):
    monkeypatch.setattr(U, "BITS_PER_KEY", 2)
    monkeypatch.setattr(U, "HASHES", 1)
    universe = spark.range(3000).selectExpr("concat('h', id) AS key")
    listed = universe.where("key LIKE '%7' OR key = 'gone'")
    levels = U.cascade(universe, listed)
    assert len(levels) > 3
    wrong = universe.where(U.member(universe["key"], levels) != universe["key"].like("%7"))
    assert wrong.count() == 0


def test_empty_list_and_table(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    assert {r.verdict for r in U.url_filter(df, none, rules=()).collect()} == {"allow"}
    assert U.url_filter(df.limit(0), spark.createDataFrame([("b.com",)], "key string")).count() == 0


def test_filter_of_many_chunks(spark):
    """A long list: the cells come in chunks, none is lost, and membership stays exact."""
    universe = spark.range(60_000).selectExpr("concat('h', id) AS key")
    listed = universe.where("xxhash64(key) % 3 = 0")
    levels = U.cascade(universe, listed)
    assert len(levels[0][0]) > 3 * U.CHUNK and all(len(cells) * U.CELL == bits for cells, bits in levels)
    assert universe.where(U.member(universe["key"], levels) != F.expr("xxhash64(key) % 3 = 0")).isEmpty()


def test_list_of_names(spark):
    names = ("a.b", "it's", "x\\y")
    assert sorted(r.key for r in U.listed_domains(spark, names).collect()) == sorted(names)
    assert U.listed_domains(spark, ()).isEmpty()
