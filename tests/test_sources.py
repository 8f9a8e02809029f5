"""Readers on small hand-made files."""
import json
import struct
import zlib

import numpy as np
import pytest

from tracework.operators import documents as doc
from tracework.operators import explore as ex
from tracework.sources import files as fs
from tracework.sources import logs


def test_sensor_log_drops_frames(spark, tmp_path):
    for folder, label in (("Worn_a", 1), ("Good_b", 0)):
        (tmp_path / folder).mkdir()
        text = "".join(f"Ger\xe4t {i};x\n" for i in range(8)) + "Unix TimeStamp (ms),Measurement Type,Data / x_axis,y_axis,z_axis\n"
        text += "".join(f"{1000 + i},A,{i}.5,2,3\n" for i in range(5)) + "Rate 2kHz\n"
        (tmp_path / folder / "log.csv").write_bytes(text.encode("cp1252"))
    rows = logs.sensor_log(spark, str(tmp_path)).collect()
    assert len(rows) == 10 and {r["label"] for r in rows} == {0, 1}
    assert sorted({r["ts_ms"] for r in rows}) == [1000, 1001, 1002, 1003, 1004]


def test_field_dump_checks_count(spark, tmp_path):
    for t, n in (("0.5", 2), ("0.7", 2)):
        (tmp_path / t).mkdir()
        (tmp_path / t / "U").write_text(f"internalField nonuniform List<vector>\n{n}\n(\n(1 2 3)\n(-4e-1 5 6)\n)\n;\n")
    (tmp_path / "constant").mkdir()
    (tmp_path / "constant" / "U").write_text("(9 9 9)\n")
    rows = logs.field_dump(spark, str(tmp_path)).orderBy("t", "cell").collect()
    assert [(round(r["t"], 3), r["cell"], r["ux"]) for r in rows] == [(0.0, 0, 1.0), (0.0, 1, -0.4), (0.2, 0, 1.0), (0.2, 1, -0.4)]
    (tmp_path / "0.9").mkdir()
    (tmp_path / "0.9" / "U").write_text("3\n(\n(1 2 3)\n)\n")
    with pytest.raises(Exception, match="count mismatch"):
        logs.field_dump(spark, str(tmp_path)).collect()


def test_part_catalog_reasons(spark, tmp_path):
    ok = ["d/frontside/external.h5", "d/backside/external.h5"]
    parts = [("good", ok), ("failed", [*ok, "d/SENSOR_FAILURE"]), ("two", [*ok, "e/frontside/external.h5"])]
    data = [{"part_id": p, "process_data": [{"data_paths": []}, {"start_time": 1.0, "end_time": 2.0, "anomaly": False, "data_paths": q}]} for p, q in parts]
    (tmp_path / "c.json").write_text(json.dumps(data))
    got = {r["part_id"]: (r["path"], r["reason"]) for r in logs.locate_parts(logs.part_catalog(spark, str(tmp_path / "c.json")), "frontside").collect()}
    assert got == {"good": (ok[0], None), "failed": (None, "sensor_failure"), "two": (None, "path_count")}
    with pytest.raises(ValueError):
        logs.locate_parts(spark.createDataFrame([], "part_id string, process_data array<int>"), "top")


def png(a):
    h, w, _ = a.shape
    raw = b"".join(b"\x01" + bytes([(int(row[x][c]) - (int(row[x - 1][c]) if x else 0)) & 255 for x in range(w) for c in range(3)]) for row in a)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_pixels_and_image_files(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 256, (5, 4, 3)).astype(np.uint8)
    np.testing.assert_allclose(fs.pixels(png(a)), a / 255.0)
    (tmp_path / "x.PNG").write_bytes(png(a))
    (tmp_path / "y.txt").write_text("no image")
    files = fs.image_files(spark, str(tmp_path))
    assert files.count() == 1
    r = fs.audit(files.select("path", "content"), "content").first()
    assert (r["width"], r["height"], r["mode"], r["error"]) == (4, 5, "RGB", None)


def test_profile_and_shear(spark, tmp_path):
    (tmp_path / "p.xy").write_text("0.1 2 3\n\n 0.2  4 5\n")
    assert [tuple(r) for r in logs.profile_matrix(spark, str(tmp_path / "p.xy"), ["y", "a", "b"]).collect()] == [(0.1, 2.0, 3.0), (0.2, 4.0, 5.0)]
    (tmp_path / "s.dat").write_text("# c\n0.5 (1 -2 3e-1)\n")
    assert [tuple(r) for r in logs.shear_table(spark, str(tmp_path / "s.dat")).collect()] == [(0.5, 1.0, -2.0, 0.3)]


def test_size_limit(spark):
    d = spark.createDataFrame([("a.md", 10), ("b.exe", 5)], "path string, length long")
    assert {r["path"]: r["status"] for r in fs.document_files(d).collect()} == {"a.md": "accepted", "b.exe": "skipped"}
    with pytest.raises(Exception, match="exceeds"):
        fs.document_files(d, limit=12).collect()


def test_recursive_chunks_cover_text():
    text = "\n\n".join(" ".join(f"word{i}" for i in range(k, k + 60)) for k in range(0, 300, 60)) + "x" * 450
    chunks = doc.split_recursive(text, 200, 20)
    assert all(len(c) <= 200 for c in chunks)
    assert {w for c in chunks for w in c.split() if w.startswith("word") and "x" not in w} >= {f"word{i}" for i in range(299)}


def test_chunk_table_function(spark):
    doc.register_chunk_udtf(spark)
    rows = spark.sql("SELECT * FROM chunk_text('aa bb cc', 5, 0)").collect()
    assert [r["text"] for r in rows] == ["aa bb", "cc"]


def test_allowed_methods_only(spark):
    with pytest.raises(ValueError):
        ex.call_method(spark.range(3), "drop", "id")
