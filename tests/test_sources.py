"""Scans, sinks, images and decisions on odd inputs."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.calendar import widen
from plumbline.functions.ordered import hot_keys, parts_of, quantiles, running, salted_join, with_chunks
from plumbline.operators import clean, images, profile, query, series, validate
from plumbline.sources import export, files
from plumbline.spec import DatasetSpec, FieldSpec
from plumbline.streaming import progress


def test_csv_null_tokens_before_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v,w,day\n1,1.5,x,2024-01-02 03:04:05\n2,NA,(null),2024-01-03 00:00:00\n3,N/A,n/a,NA\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "v": "double", "w": "string", "day": "timestamp_ntz"}
    assert [r["v"] for r in df.orderBy("id").collect()] == [1.5, None, None]
    assert df.where("w = 'n/a'").count() == 1
    assert files.read_csv(spark, str(tmp_path / "a.csv"), extra_tokens=True).where("w = 'n/a'").count() == 0
    typed = files.read_csv(spark, str(tmp_path / "a.csv"), "id int, v float")
    assert dict(typed.dtypes)["v"] == "float"


def test_sheet_of_several_files(spark, tmp_path):
    folder = tmp_path / "a sheet"
    folder.mkdir()
    (folder / "0.csv").write_text("")
    (folder / "1.csv").write_text("Title\n*k,v*\n1,a\n")
    (folder / "2.csv").write_text("2,b\n,\n3,c\n" + "".join(f"{k},d\n" for k in range(4, 400)))
    (folder / "3.csv").write_text("400,e\n")
    got = files.sheet_rows(spark, str(folder), header_row=2)
    assert got.columns == ["k", "v"] and sorted(int(r.k) for r in got.collect()) == list(range(1, 401))
    assert files.sheet_rows(spark, str(folder / "1.csv"), header_row=2).count() == 1
    with pytest.raises(ValueError):
        files.sheet_rows(spark, str(folder), header_row=9)
    with pytest.raises(ValueError):
        files.sheet_rows(spark, str(folder / "0.csv"), header_row=2)


def test_json_array_and_sql_over_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": 1, "v": "x"}, {"k": 2, "v": "y"}]))
    (tmp_path / "b.csv").write_text("k,n\n1,10\n2,20\n")
    (tmp_path / "bb.csv").write_text("k,n\n1,7\n")
    got = files.sql_over_files(spark, "SELECT a.v, b.n, c.n AS m FROM 'a.json' a JOIN 'b.csv' b ON a.k = b.k LEFT JOIN 'bb.csv' c ON c.k = a.k "
                                      "WHERE a.v <> 'z' ORDER BY 1", str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("x", 10, 7), ("y", 20, None)]
    with pytest.raises(ValueError):
        files.read_any(spark, "a.xlsx")


def test_rejects_put_the_reason_last(spark, tmp_path):
    df = spark.createDataFrame([("bad", 1)], "reason string, id int")
    export.write_rejects(df, str(tmp_path / "r"), "csv")
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == ["id", "reason"]


def bmp(path, pixels):
    """A 24-bit bitmap from rows of (blue, green, red)."""
    h, w = len(pixels), len(pixels[0])
    body = b"".join(bytes(v for p in row for v in p) + b"\0" * (-3 * w % 4) for row in reversed(pixels))
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0)
    path.write_bytes(head + body)


@pytest.fixture
def pictures(spark, tmp_path):
    rng = np.random.default_rng(0)
    for i in range(3):
        bmp(tmp_path / f"{i}.bmp", rng.integers(0, 256, (8, 6, 3)).tolist())
    return files.read_any(spark, f"{tmp_path}/")


def test_image_profile_and_preview(pictures):
    row = profile.image_profile(pictures).first()
    assert (row["count"], row["min_channels"], row["max_height"], row["max_width"]) == (3, 3, 8, 6)
    assert profile.image_preview(pictures, limit=2).count() == 2


@pytest.mark.parametrize("step,shape", [
    ({"operation": "resize", "param": [4, 3]}, (4, 3, 3)), ({"operation": "resize", "param": 12}, (16, 12, 3)), ({"operation": "crop", "param": 4}, (4, 4, 3)),
    ({"operation": "pad", "param": 2}, (12, 10, 3)), ({"operation": "hflip", "param": 1.0}, (8, 6, 3)), ({"operation": "vflip", "param": 1.0}, (8, 6, 3)),
    ({"operation": "rotate", "param": 30}, (8, 6, 3)), ({"operation": "brightness", "param": 0.5}, (8, 6, 3)), ({"operation": "contrast", "param": 0.5}, (8, 6, 3)),
    ({"operation": "saturation", "param": 0.5}, (8, 6, 3)), ({"operation": "hue", "param": 0.2}, (8, 6, 3)), ({"operation": "grayscale", "param": 1}, (8, 6, 1)),
    ({"operation": "blur", "param": 3}, (8, 6, 3)), ({"operation": "sharpness", "param": 2.0}, (8, 6, 3)),
    ({"operation": "normalize", "param": {"mean": [0.5] * 3, "std": [0.5] * 3}}, (8, 6, 3))])
def test_image_operations(pictures, step, shape):
    first, again = (images.transform_images(pictures, [step], 1).orderBy("origin").collect() for _ in range(2))
    assert first == again
    for r in first:
        assert (r["height"], r["width"], r["channels"]) == shape and len(r["pixels"]) == np.prod(shape)
        low, high = (-1, 1) if step["operation"] == "normalize" else (0, 1)
        assert min(r["pixels"]) >= low - 1e-9 and max(r["pixels"]) <= high + 1e-9


def test_image_flip_and_unknown(pictures):
    plain = {r["origin"]: np.array(r["pixels"]).reshape(8, 6, 3) for r in images.transform_images(pictures, []).collect()}
    turned = images.transform_images(pictures, [{"operation": "hflip", "param": 1.0}]).collect()
    assert all(np.allclose(np.array(r["pixels"]).reshape(8, 6, 3), plain[r["origin"]][:, ::-1]) for r in turned)
    quarter = images.transform_images(pictures, [{"operation": "rotate", "param": [180, 180]}]).collect()
    assert all(np.allclose(np.array(r["pixels"]).reshape(8, 6, 3), plain[r["origin"]][::-1, ::-1], atol=1e-6) for r in quarter)
    with pytest.raises(Exception):
        images.transform_images(pictures, [{"operation": "melt"}]).collect()


def test_strips_hold_every_row(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (7, 5, 3))
    bmp(tmp_path / "a.bmp", pixels.tolist())
    (tmp_path / "b.bmp").write_bytes(b"no image")
    rows = images.strips(files.read_any(spark, f"{tmp_path}/"), 3).collect()
    found = [r for r in rows if r["origin"].endswith("a.bmp")]
    assert [(r["height"], r["width"], r["nChannels"]) for r in found] == [(3, 5, 3), (3, 5, 3), (1, 5, 3)]
    assert b"".join(bytes(r["data"]) for r in found) == pixels.astype(np.uint8).tobytes()
    assert [(r["height"], len(r["data"])) for r in rows if r["origin"].endswith("b.bmp")] == [(-1, 0)]


def test_source_images_makes_few_files(spark, tmp_path, monkeypatch):
    """A bitmap holds many pictures, so files are far fewer than rows."""
    from plumbline.sources import files as source
    rows = [(i, [((i * 7 + j) % 100) / 100 for j in range(16)], 0) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, read = [], source.read_images
    monkeypatch.setattr(source, "read_images", lambda spark, folder: seen.append(folder) or read(spark, folder))
    from __spark_entry__ import queries
    got = queries()["source_images"](spark, str(tmp_path)).collect()
    assert sum(r["images"] for r in got) == 200 and {(r["height"], r["width"], r["nChannels"]) for r in got} == {(4, 4, 3)}
    assert sum(r["light"] * r["images"] for r in got) == sum(3 * int((float(np.float32(x)) + 1) * 63) for _, v, _ in rows for x in v)
    assert spark.read.format("binaryFile").load(seen[0]).count() == 7 + 200 - 7 * 28


# --- decisions ---------------------------------------------------------------------------------------

def test_filters_refuse_unknown_operators(spark):
    with pytest.raises(ValueError):
        query.where(spark.range(3), {"id": ("~", 1)})
    assert query.where(spark.range(3), {"id": None}).count() == 3


def test_constant_fill_and_unknown_methods(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "i int, v double")
    assert clean.fill(df, "v", 9.0).where("v = 9").count() == 1
    with pytest.raises(ValueError):
        clean.fill(df, "v", "guess")
    with pytest.raises(ValueError):
        clean.fill(df, "v", "prev")
    with pytest.raises(ValueError):
        FieldSpec("a", attr="shape")


def test_mode_takes_the_smallest_on_ties_and_fills_all(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([2.0, 1.0, 2.0, 1.0, None, None])], "i int, v double")
    assert clean.fill(df, "v", "mode").where("v = 1").count() == 4


def test_clean_keeps_scoring_rows_and_constants(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("b", 3.0), (None, None)], "c string, v double")
    spec = DatasetSpec.of([{"name": "c", "attr": "cat", "encode": "ordinal"}, {"name": "v", "attr": "conti", "miss": "mean", "scale": "minmax"}])
    fitted, rows = clean.fit(train, spec)
    assert rows.count() == 2                              # the empty and the repeated row are gone
    scored = clean.apply(spark.createDataFrame([("b", 5.0), ("b", 5.0), ("z", None)], "c string, v double"), fitted)
    assert [tuple(r) for r in scored.collect()] == [(1.0, 2.0), (1.0, 2.0), (-1.0, 0.5)]


def test_daily_gap_counts_whole_days(spark):
    df = spark.sql("SELECT timestamp_ntz '2024-01-01' + make_dt_interval(id * 2) AS ts FROM range(5)")
    assert profile.time_profile(df, "ts").first()["gap"] == 2880


def test_widening():
    assert widen("min", 5, None) == "5min" and widen("h", 90, 180) == "3h" and widen("D", 3000, None) == "3D"
    assert widen("D", None, 20_000) == "2W" and widen("YS", 20_000, None) == "YS" and widen("D", 5, None) == "D"
    assert widen("min", 60, None) == "h" and widen("min", None, 1440) == "D" and widen("h", 10_080, 5) == "W" and widen("W", 43_200, None) == "MS"
    assert widen("5min", 3, None) == "5min" and widen("s", 1, None) == "min" and widen("h", 61, None) == "2h" and widen("D", None, None) == "D"


def test_resample_multiples_start_at_the_first_day(spark):
    df = spark.sql("SELECT timestamp_ntz '2024-01-03 05:00:00' + make_dt_interval(id) AS ts, double(id) AS v FROM range(6)")
    got = series.resample(df, "ts", ["v"], period="2D", agg="sum").orderBy("ts").collect()
    assert [(r["ts"].day, r["v"]) for r in got] == [(3, 1.0), (5, 5.0), (7, 9.0)]


@pytest.mark.parametrize("many", [64, 65])
def test_codes_do_not_depend_on_the_size_of_the_domain(spark, many):
    rows = spark.range(many).select(F.format_string("v%03d", "id").alias("c"), F.format_string("v%03d", "id").alias("l"), F.lit(1.0).alias("x"))
    rows = rows.union(spark.createDataFrame([(None, None, 1.0)], "c string, l string, x double"))
    spec = DatasetSpec.of([{"name": "c", "attr": "cat", "encode": "ordinal"}, {"name": "l", "attr": "cat", "encode": "label"}, {"name": "x", "attr": "conti"}])
    fitted, coded = clean.fit(rows, spec)
    scored = clean.apply(spark.createDataFrame([("v003", "v003", 1.0), (None, None, 1.0), ("new", "new", 1.0)], "c string, l string, x double"), fitted).drop("x")
    assert dict(coded.drop("x").dtypes) == dict(scored.dtypes) == {"c": "double", "l": "bigint"}
    assert sorted(map(tuple, coded.drop("x").collect())) == [(float(i), i) for i in range(-1, many)]
    assert sorted(map(tuple, scored.collect())) == [(-1.0, -1), (-1.0, -1), (3.0, 3)]


@pytest.mark.parametrize("many", [256, 257])
def test_one_hot_form_is_the_callers_choice(spark, many):
    rows = spark.range(many).select(F.format_string("v%03d", "id").alias("c"), F.lit(1.0).alias("x"))
    rows = rows.union(spark.createDataFrame([(None, 1.0)], "c string, x double"))
    new = spark.createDataFrame([("v003", 1.0), (None, 1.0), ("new", 1.0)], "c string, x double")
    fitted, coded = clean.fit(rows, DatasetSpec.of([{"name": "c", "attr": "cat", "encode": "hot"}, {"name": "x", "attr": "conti"}]))
    assert coded.columns == clean.apply(new, fitted).columns == ["x", *[f"c_v{i:03d}" for i in range(many)]]
    assert sorted(sum(r[1:]) for r in clean.apply(new, fitted).collect()) == [0, 0, 1]
    fitted, coded = clean.fit(rows, DatasetSpec.of([{"name": "c", "attr": "cat", "encode": "hot_vector"}, {"name": "x", "attr": "conti"}]))
    assert coded.columns == ["x", "c_hot"] and {r.c_hot.size for r in coded.collect()} == {many}
    assert [list(r.c_hot.indices) for r in clean.apply(new, fitted).collect()] == [[3], [], []]


@pytest.mark.parametrize("rows", [5_000, 40_000])
def test_hot_keys_are_cut_by_the_bound(spark, rows):
    spark.conf.set("plumbline.groupRows", "500")
    try:
        df = spark.range(rows).select(F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("o"))
        hot = hot_keys(df, ["k"])
        assert [tuple(r) for r in hot.collect()] == [(0, rows * 8 // 10)]
        sizes = [r["count"] for r in with_chunks(df, ["k"], "o", hot).where("k = 0").groupBy("_o_chunk").count().collect()]
        assert sum(sizes) == rows * 8 // 10 and max(sizes) <= 500
        plan = salted_join(df, spark.range(10).select(F.col("id").alias("k")), ["k"])
        assert plan.count() == rows * 8 // 10 + 2
        salts = hot.select(parts_of(F.col("_n"), spark)).first()[0]
        assert salts == -(-rows * 8 // 10 // 500)
    finally:
        spark.conf.unset("plumbline.groupRows")


def test_late_reports_count(spark, tmp_path):
    rows = spark.range(300).selectExpr("timestamp '2024-02-01' - make_dt_interval(cast(id % 30 AS int)) AS ts", "'e' AS experiment", "3 AS code",
                                       "id % 10 = 0 AS failed", "double(id) AS score")
    for turn in range(2):    # the second run goes on from the first one's checkpoint, with older reports
        rows.where(F.col("score") % 2 == turn).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        progress.store_progress(stream, str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination()
    got = progress.progress(spark.read.parquet(str(tmp_path / "table")), 100, 300).first()
    assert (got.trial_progress, got.rate, got.best) == (100, 90, 299.0)


def test_calendar_is_not_in_the_plan(spark):
    df = spark.sql("SELECT timestamp_ntz '2024-01-01' + make_dt_interval(0, id) AS ts, double(id) AS v FROM range(48)")
    out = series.resample(df, "ts", ["v"], period="s", agg="sum")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and "[0," not in plan and out.count() == 47 * 3600 + 1


def test_workers_find_the_package(tmp_path):
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\nfrom pyspark.sql import SparkSession\nfrom __spark_entry__ import queries\n"
            "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
            "print('rows', queries()['series_cycles'](spark, '/root/testdata/sf0.001').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_validation_reports_first_fault(spark):
    df = spark.createDataFrame([("", "x"), ("a", "y")], "n string, o string")
    out = validate.check_rows(df, [validate.Header("n", "N", required=True), validate.Header("o", "O", options=(("y", "1"),))])
    good, bad = validate.split_rows(out)
    assert bad.first()["reason"] == "N is required" and good.first()["o"] == "1"


# --- large-data ways -----------------------------------------------------------------------------------

def test_running_and_quantiles_with_a_hot_key(tight):
    rows = tight.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
                                    F.col("id").alias("o"), (F.xxhash64("id") % 1000).cast("double").alias("v"))
    got = running(rows, ["k"], "o", {"r": F.lit(1), "s": F.col("v")}, {"n": F.lit(1)}).toPandas().sort_values(["k", "o"])
    assert (got.groupby("k").cumcount() + 1 == got["r"]).all() and np.allclose(got.groupby("k")["v"].cumsum(), got["s"])
    assert (got.groupby("k")["v"].transform("size") == got["n"]).all()
    q = quantiles(rows, ["k"], "v", [0.1, 0.5, 0.93]).toPandas().set_index("k")["q"]
    want = rows.toPandas().groupby("k")["v"].quantile([0.1, 0.5, 0.93]).unstack()
    for k in want.index:
        np.testing.assert_allclose(q[k], want.loc[k], atol=1e-9)


def test_salted_join_with_a_hot_key(tight):
    left = tight.range(2000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).alias("k"), F.lit("same").alias("a"))
    right = tight.range(2, 1000).select((F.col("id") - 1).alias("k"), F.col("id").alias("b"))
    counted = lambda d: sorted(map(tuple, d.groupBy("a", "b").count().fillna(-1).collect()))
    for how in ("inner", "left"):
        assert counted(salted_join(left, right, ["k"], how)) == counted(left.join(right, "k", how))


def test_lookup_of_null_keys_is_the_same_small_and_large(spark, tight):
    df = tight.range(2000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 40).alias("k"), F.col("id"))
    codes = clean.count_encode(df, "k")
    large = clean.attach_code(df, codes, "k").groupBy("k").count().orderBy("k").collect()
    tight.conf.set("plumbline.broadcastRows", "1000")
    assert large == clean.attach_code(df, codes, "k").groupBy("k").count().orderBy("k").collect()
    assert max(r["k"] for r in large) == 667


def test_timeline_resampling_inside_cleaning(spark):
    df = spark.sql("SELECT timestamp_ntz '2024-01-01' + make_dt_interval(0, id * 4) AS ts, double(id) AS v FROM range(5)")
    spec = DatasetSpec.of([{"name": "ts", "attr": "date", "timeline": True, "resample": 180}, {"name": "v", "attr": "conti"}])
    got = [r["v"] for r in clean.clean(df, spec).orderBy("ts").collect()]
    assert got == [0.0, 1.0, 2.0, 2.0, 3.0, 4.0]


def test_calendar_ignores_the_session_zone(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz '2024-03-10 02:30:00', timestamp_ntz '2024-03-10 23:59:59.999999')) AS ts, 1.0D AS v")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        day = series.resample(df, "ts", ["v"], period="D", agg="sum").collect()
        half = series.resample(df, "ts", ["v"], period="12h", agg="sum").orderBy("ts").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [(r["ts"].day, r["ts"].hour, r["v"]) for r in day] == [(10, 0, 2.0)]
    assert [(r["ts"].hour, r["v"]) for r in half] == [(0, 1.0), (12, 1.0)]


def test_scratch_is_cleared(spark):
    import os

    from plumbline.functions.settings import clear_scratch, scratch_folder
    clear_scratch(spark)
    path = scratch_folder(spark, "x")
    spark.range(3).write.parquet(path)
    assert os.path.exists(path) and clear_scratch(spark) == 1 and not os.path.exists(path) and clear_scratch(spark) == 0
