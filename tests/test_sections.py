import pytest
from pyspark.sql import functions as F

from lorewell.functions import sections as sec, vectors as vx
from lorewell.sources import index_store, synthetic


@pytest.mark.parametrize("line,out", [("# A", (1, "A")), ("   ###### B ##", (6, "B")), ("####### no", None), ("#tag", None), ("#", (1, "")), ("## **C** [t](u) [[p|q]] `d`", (2, "C t q d")), ("    # code", None), ("# C#", (1, "C#"))])
def test_heading(line, out):
    assert sec.heading(line) == out


def test_sections():
    text = "---\na: b\n---\nlead\n# A\none\n## B\n```py\n# no\n~~~\n```\n### C\n## D\nend\n# E\n~~~\n# open"
    assert sec.sections(text) == [
        (0, [], "lead"),
        (1, ["A"], "one"),
        (2, ["A", "B"], "```py\n# no\n~~~\n```"),
        (3, ["A", "B", "C"], ""),
        (2, ["A", "D"], "end"),
        (1, ["E"], "~~~\n# open"),
    ]
    assert sec.sections("") == [] and sec.sections("\n \n") == [] and sec.sections("---\nopen") == [(0, [], "---\nopen")]


def test_chunks_with_and_without_context(spark):
    df = spark.createDataFrame([("N", "lead text.\n# A\n" + "w " * 400 + "."), ("M", None), (None, "")], "b string, t string")
    rows = df.select(sec.chunks(F.col("b"), F.col("t")).alias("x"), sec.chunks(F.col("b"), F.col("t"), heading_context=False).alias("y"), sec.chunks(F.col("b"), F.col("t"), most=2).alias("z")).collect()
    x, y = rows[0].x, rows[0].y
    assert x[0].text == "N" and x[1].text == "N\nlead text." and x[2].text.startswith("N > A\nw w") and not x[3].text.startswith("N")
    assert [(c.section, len(c.text)) for c in y[:2]] == [(0, 1), (1, 10)] and len(x) == len(y) and len(rows[0].z) == 2
    assert [[c.text for c in r.x] for r in rows[1:]] == [["M"], [""]]


def test_ideas():
    same, other = " ".join(["apple banana cherry"] * 30), " ".join(["stone river cloud"] * 30)  # 90 words each
    assert sec.ideas([], []) == [] and sec.ideas(["t"], [0]) == [0]
    assert sec.ideas(["t", same, other], [0, 1, 2]) == [0, 1, 1]  # few words
    assert sec.ideas(["t", *[same] * 3, *[other] * 3], [0] + [1] * 6) == [0, 1, 1, 1, 2, 2, 2]  # a valley
    assert sec.ideas(["t", *[same] * 12], [0] + [1] * 12) == [0] + [1] * 5 + [2] * 5 + [3] * 2  # at most 500 words
    assert sec.ideas(["t", *[same] * 3, *[same] * 3], [0] + [1] * 3 + [2] * 3) == [0, 1, 1, 1, 2, 2, 2]  # a heading
    assert sec.ideas(["t", *[same] * 3, other], [0, 1, 1, 1, 2]) == [0, 1, 1, 1, 1]  # a small rest


def test_legacy_round_trip(spark):
    rows = [("a", 1, 2, 2, [0.5, -0.25], [([-128, 127], 0.5), ([0, -1], 1.0)]), ("b", 2, 2, 1, [0.0, 1.0], [([1, 2, 3], 1.0)])]
    e = spark.createDataFrame(rows, "path string, mtime long, dims int, chunk_count int, mean array<double>, chunks array<struct<q: array<tinyint>, scale: double>>")
    lines = index_store.to_legacy(e)
    assert '"q":"gH8A/w=="' in lines.first().value
    back = index_store.from_legacy(lines.unionByName(spark.createDataFrame([("not json",), (None,)], "value string"))).collect()
    assert back == e.where("path = 'a'").collect()


def test_synthetic_index(spark):
    rows = synthetic.index(spark, 200, 8)
    again = synthetic.index(spark, 50, 8).repartition(7).collect()
    assert set(map(str, again)) <= set(map(str, rows.collect()))
    got = rows.select("chunk_count", F.size("chunks").alias("n"), F.forall("chunks", lambda c: F.abs(F.array_max(F.transform(c["q"], lambda x: F.abs(x.cast("int")))) - 127) == 0).alias("full")).collect()
    assert all(r.n == r.chunk_count and 1 <= r.n <= 33 and r.full for r in got) and 14 < sum(r.n for r in got) / 200 < 20
    norm = synthetic.index(spark, 1, 8).select(F.explode("chunks").alias("c")).select(vx.dot(vx.dequantize(F.col("c.q"), F.col("c.scale")), vx.dequantize(F.col("c.q"), F.col("c.scale"))).alias("d")).first().d
    assert norm == pytest.approx(1)
