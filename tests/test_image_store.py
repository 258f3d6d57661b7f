"""The image store: nothing twice, nothing lost that is referred to, all back on loading."""

from lonja.sources import image_store as store

ROWS = "row_seq long, img string, digest string"


def _img(k):
    return f"data:image/png;base64,{'A' * (k + 1)}="


def test_save_load_collect(spark, tmp_path):
    path = f"file://{tmp_path}/images"
    rows = spark.createDataFrame([(k, _img(k % 7) if k % 5 else [None, "-", "http://x/y.png"][k % 3], "clash") for k in range(60)], ROWS)
    saved = store.save(rows, path)
    files = sorted(p.name for p in tmp_path.rglob("*.parquet"))
    assert store.contents(spark, path).count() == 7 and all(r["img"] is None or not r["img"].startswith("data:") for r in saved.collect())
    assert sorted(map(str, store.loaded(saved, path).collect())) == sorted(map(str, rows.collect()))
    store.save(rows, path)
    assert sorted(p.name for p in tmp_path.rglob("*.parquet")) == files
    some = saved.where("img IS NULL OR row_seq % 7 < 3")
    left = {r["img"] for r in some.collect() if r["img"] and r["img"].startswith(store.PREFIX)}
    assert store.collect(some, path) == 7 - len(left) > 0
    assert {store.PREFIX + r["digest"] for r in store.contents(spark, path).collect()} == left
    assert sorted(map(str, store.loaded(some, path).collect())) == sorted(map(str, rows.join(some.select("row_seq"), "row_seq").select("row_seq", "img", "digest").collect()))
    assert store.collect(some, path) == 0
    assert store.collect(some.limit(0), path) == len(left) and store.contents(spark, path).isEmpty()


def test_no_images(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    rows = spark.createDataFrame([(1, None, ""), (2, "image:" + "0" * 64, "")], ROWS)
    saved = store.save(rows, path)
    assert [tuple(r) for r in store.loaded(saved, path).orderBy("row_seq").collect()] == [(1, None, ""), (2, None, "")]
    assert store.collect(saved, path) == 0
