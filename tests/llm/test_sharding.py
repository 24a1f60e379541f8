import zlib
from collections import Counter

from usagelens.llm import sharding
from usagelens.llm.queries import QUERIES


def rows(spark, number=5000):
    data = [(k // 2 if k % 3 else 7, "t" if k % 3 == 0 else f"t{k}", None if k % 5 else k) for k in range(number)]
    return spark.createDataFrame(data, "doc_id long, text string, SHARD int"), data


def test_shards_hold_all_rows_with_equal_counts(spark):
    table, data = rows(spark)
    got = sharding.shuffle_to_shards(table, 16, bucket_rows=300).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for d, t, _ in data)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, count in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(count))


def test_order_is_seeded_and_mixed(spark):
    table = spark.range(8000).selectExpr("id doc_id")
    first, again, other = (
        [r.doc_id for r in sorted(sharding.shuffle_to_shards(table, 1, seed=seed, bucket_rows=500).collect(),
                                  key=lambda r: r.slot)] for seed in (1, 1, 2))
    assert first == again != other
    assert sorted(first) == list(range(8000))
    # Places are not tied to ids: about half the neighbours rise, and each quarter holds its share of small ids.
    assert 0.45 < sum(a < b for a, b in zip(first, first[1:])) / 8000 < 0.55
    for part in range(4):
        assert 850 < sum(k < 4000 for k in first[part * 2000:part * 2000 + 2000]) < 1150


def test_hot_copies_scatter_over_buckets(spark):
    table = spark.createDataFrame([(1, "same")] * 3000 + [(k, "x") for k in range(3000)], "doc_id long, text string")
    got = sharding.shuffle_to_shards(table, 4, bucket_rows=200).collect()
    hot = Counter(r.shard for r in got if r.text == "same")
    assert sum(hot.values()) == 3000 and min(hot.values()) > 600


def test_bytes_bound_and_nulls_and_empty_table(spark):
    table = spark.createDataFrame([(None, 10), (None, 10), (1, None)], "doc_id long, size long")
    got = sharding.shuffle_to_shards(table, 2, bytes_col="size", bucket_bytes=4).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (1, 0)]
    assert sharding.shuffle_to_shards(table.limit(0), 2).collect() == []


def test_written_shards(spark, tmp_path):
    table, data = rows(spark, 500)
    sharding.write_shards(table, f"{tmp_path}/s", 4, bucket_rows=50)
    back = spark.read.parquet(f"{tmp_path}/s").collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((d, t) for d, t, _ in data)


def test_bytes_bound_holds_by_default(spark, tmp_path, monkeypatch):
    written = {}
    monkeypatch.setattr(sharding, "stage", lambda rows, purpose, **options: written.update(rows=rows) or (rows, ""))
    table = spark.createDataFrame([(k, "é" * 500, [f"{k}" * 50]) for k in range(200)], "doc_id long, text string, tags array<string>")
    sharding.write_shards(table, f"{tmp_path}/s", 4, bucket_bytes=20_000)
    sizes = [sum(len(r.text.encode()) for r in row.rows) for row in written["rows"].collect()]
    assert sum(sizes) == 200_000 and len(sizes) >= 9 and max(sizes) < 50_000
    back = spark.read.parquet(f"{tmp_path}/s").collect()
    assert Counter(r.doc_id for r in back) == Counter(range(200))


def test_query_moves_whole_documents(spark, monkeypatch):
    moved = {}
    whole = sharding.shuffle_to_shards

    def seen(rows, *args, **options):
        moved.update(columns=set(rows.columns), bytes_col=options.get("bytes_col"))
        return whole(rows, *args, **options)

    monkeypatch.setattr(sharding, "shuffle_to_shards", seen)
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op8_sharding"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert moved["columns"] >= set(docs.columns) and moved["bytes_col"] == "size"
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in texts)
    assert sorted(r.slot * 16 + r.shard for r in got) == list(range(len(texts)))


def test_no_python_in_the_plan(spark):
    plan = sharding.shuffle_to_shards(spark.range(10), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_values_come_back_as_they_were(spark):
    kinds = "a double, b float, c array<double>, d struct<x: double, `y z`: map<string, double>>, e map<string, int>, `f.g` string"
    data = [(-0.0, -0.0, [-0.0, None, 0.0], (-0.0, {"k": -0.0, "j": 1.0}), {"b": 1, "a": None}, "x"),
            (0.0, 0.0, [0.0, None, -0.0], (0.0, {"j": 1.0, "k": 0.0}), {"a": None, "b": 1}, "x"),
            (None, None, None, None, None, None), (-1.5, float("-inf"), [], (None, None), {}, ""),
            (float("nan"), float("nan"), [None], (None, {}), {"": 0}, "y")] * 3
    table = spark.createDataFrame(data, kinds)
    got = sharding.shuffle_to_shards(table, 4, bucket_rows=2)
    assert got.dtypes[:-2] == table.dtypes

    def seen(rows):
        return Counter(repr(tuple(r.asDict(True)[c] for c in table.columns)) for r in rows.collect())

    assert seen(got) == seen(table)
    assert max(seen(table).values()) == 3 and len(seen(table)) == 5
