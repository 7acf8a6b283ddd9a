from pyspark.sql import functions as F

from orrery.functions import columns as C


def test_tags_in_compatibility_forms(spark):
    given = ["Ｆｕｌｌ", "ﬁsh", "\u3000a b", "\u2028steel\u1680", " Brand_1 ", "größe", "", None, "x" * 65, "①"]
    rows = spark.createDataFrame([(t,) for t in given], "raw string").select(C.normalise_tag(F.col("raw")).alias("tag")).collect()
    assert [r.tag for r in rows] == ["full", "fish", None, "steel", "brand_1", None, None, None, None, "1"]


def test_arrays_of_tags(spark):
    given = [["Ａ", "a", "\u3000", "ﬂow"], ["a", "b c"], None, [], [f"t{i}" for i in range(33)], ["a", None]]
    rows = spark.createDataFrame([(t,) for t in given], "raw array<string>").select(C.normalise_tags(F.col("raw")).alias("tags")).collect()
    assert [r.tags for r in rows] == [["a", "flow"], None, None, [], None, None]


def test_file_names_in_compatibility_forms(spark):
    given = ["ﬁle.jpg", "a／b.png", "c:\\x\\ .n\u0007ame. ", "..", None, "é" * 300]
    rows = spark.createDataFrame([(t,) for t in given], "raw string").select(C.file_name(F.col("raw")).alias("name")).collect()
    assert [r.name for r in rows] == ["file.jpg", "b.png", "name", None, None, "é" * 255]
