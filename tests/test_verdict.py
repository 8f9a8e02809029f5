"""Cases that earlier versions got wrong."""
from pyspark.sql import functions as F

from tracework.operators.documents import header_sections, separator_chunks
from tracework.operators.models import smote
from tracework.sources.files import crop_boxes, document_files


def test_long_header_is_whole(spark):
    d = spark.createDataFrame([(1, "# " + "h" * 3_000_000 + "\nbody")], "id int, text string")
    assert header_sections(d, ["id"], "text").select(F.length("header_1")).first()[0] == 3_000_000


def test_separator_is_literal(spark):
    d = spark.createDataFrame([(1, "a.b|c.d")], "id int, text string")
    assert [r.text for r in separator_chunks(d, "text", sep="|", size=3).collect()] == ["a.b", "c.d"]


def test_crops_are_squares(spark):
    d = spark.createDataFrame([(1, 1920, 1080)], "id int, w0 int, h0 int")
    boxes = {r.crop: (r.left, r.top, r.w, r.h) for r in crop_boxes(d, "id", "w0", "h0").collect()}
    assert boxes["full"] == (0, 0, 1920, 1080) and boxes["center"] == (609, 189, 702, 702)


def test_no_default_size_limit(spark):
    assert document_files(spark.createDataFrame([("a.txt", 1 << 40)], "path string, length long")).count() == 1


def test_smote_shares_are_uniform(spark):
    d = spark.createDataFrame([(i, [float(i % 9), float(i % 7)], 1) for i in range(120)], "id long, x array<double>, label int")
    out = smote(d, "id", "x", "label", 1, copies=8)
    assert out.count() == 960
    line = spark.createDataFrame([(0, [0.0], 1), (1, [1.0], 1)], "id long, x array<double>, label int")
    mean = smote(line, "id", "x", "label", 1, copies=800, k=1).agg(F.avg(F.when(F.col("id") == 0, F.col("x")[0]).otherwise(1 - F.col("x")[0]))).first()[0]
    assert abs(mean - 0.5) < 0.03


def test_separator_chunks_of_a_long_text():
    """A text of one MiB in lines of ten characters takes less than a second, and chunks are those of the plain rule."""
    import time
    from tracework.operators.documents import split_separator
    text = "\n".join(["123456789"] * 110_000)
    begin = time.perf_counter()
    chunks = split_separator(text, "\n", 100)
    assert time.perf_counter() - begin < 1 and len(chunks) == 11_000 and set(map(len, chunks)) == {99}
    assert split_separator("a\n\n b \n" + "c" * 200 + "\nd\n ", "\n", 5) == ["a\n b", "c" * 200, "d\n"]
    assert split_separator("", "\n") == [] and split_separator("a||b", "|", 3) == ["a|b"]


def test_header_sections_row_by_row():
    from tracework.operators.documents import split_headers
    got = split_headers(" lead \n# A\n## B\nx\n\n y\n#no header\n# C\nz\n## \nw\n# ")
    assert got == [(0, None, None, "lead"), (2, "A", "B", "x\ny\n#no header"), (3, "C", None, "z\n##\nw\n#")]
