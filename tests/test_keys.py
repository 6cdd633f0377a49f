import random

from pyspark.sql import functions as F

from quizlake.operators.keys import assign_ids, bucket_digits, number_within, rank_rows


def test_ids_are_dense_and_repeatable(spark):
    rows = [(u, f"m{i}") for u in range(40) for i in range(u % 7 + 1)]
    existing = spark.createDataFrame([(5,), (11,)], "module_id bigint")
    random.seed(3)
    runs = []
    for parts in (1, 7):
        random.shuffle(rows)
        batch = spark.createDataFrame(rows, "user_id bigint, module_name string").repartition(parts)
        got = assign_ids(batch, "module_id", ["user_id", "module_name"], existing=existing)
        runs.append({(r["user_id"], r["module_name"]): r["module_id"] for r in got.collect()})
    assert runs[0] == runs[1]
    assert sorted(runs[0].values()) == list(range(12, 12 + len(rows)))


def test_ids_without_existing_rows(spark):
    empty = spark.createDataFrame([], "id bigint")
    batch = spark.createDataFrame([("a",), ("b",)], "k string")
    for existing in (None, empty):
        got = assign_ids(batch, "id", ["k"], existing=existing).collect()
        assert sorted(r["id"] for r in got) == [1, 2]


def test_ids_of_a_hot_key_keep_their_order_across_spans(spark):
    rows = [(1, p) for p in range(1000)] + [(k, p) for k in range(2, 30) for p in range(3)]
    batch = spark.createDataFrame(rows, "request bigint, position int")
    got = assign_ids(batch, "id", ["request"], position_column="position", span_bits=4).collect()
    assert sorted(r["id"] for r in got) == list(range(1, len(rows) + 1))
    for key in (1, 5, 29):
        ids = [r["id"] for r in sorted(got, key=lambda r: r["position"]) if r["request"] == key]
        assert ids == sorted(ids)


def test_buckets_follow_the_shuffle_partitions(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        for partitions, digits in ((1, 3), (4096, 3), (4097, 4), (65536, 4), (10**6, 5)):
            spark.conf.set(name, partitions)
            assert bucket_digits(spark) == digits
    finally:
        spark.conf.set(name, before)


def test_ids_do_not_depend_on_the_number_of_buckets(spark):
    rows = [(k, p) for k in range(60) for p in range(k % 5 + 1)] + [(None, 0), (None, 1)]
    batch = spark.createDataFrame(rows, "k int, p int")
    runs = [
        {(r["k"], r["p"]): r["id"] for r in assign_ids(batch, "id", ["k"], "p", hex_digits=digits).collect()}
        for digits in (1, 2, None, 5)
    ]
    assert all(run == runs[0] for run in runs)
    assert sorted(runs[0].values()) == list(range(1, len(rows) + 1))


def test_numbers_within_a_key(spark):
    random.seed(5)
    ids = random.sample(range(10**17, 10**17 + 20_000), 3000)
    rows = [(1 if random.random() < 0.5 else random.randrange(2, 60), i) for i in ids]
    frame = spark.createDataFrame(rows, "quiz_id bigint, question_id bigint")
    expected = {}
    for quiz in {q for q, _ in rows}:
        for n, i in enumerate(sorted(i for q, i in rows if q == quiz), 1):
            expected[i] = n
    for bits in (3, 8, 16):
        got = number_within(frame, "quiz_id", "question_id", "n", span_bits=bits).collect()
        assert {r["question_id"]: r["n"] for r in got} == expected


def test_a_hot_key_is_numbered_by_many_groups(spark):
    """No window group is larger than a span."""
    frame = spark.range(5000).select(F.lit(1).alias("quiz_id"), F.col("id").alias("question_id"))
    numbered = number_within(frame, "quiz_id", "question_id", "n", span_bits=6)
    spans = numbered.groupBy(F.shiftright("question_id", 6)).agg(F.count("*").alias("c"))
    assert spans.agg(F.max("c")).collect()[0][0] <= 64
    assert numbered.filter(F.col("n") != F.col("question_id") + 1).count() == 0


def test_ranks_over_ranges_equal_one_sort(spark):
    random.seed(5)
    rows = [(k, random.choice([None, "a", "b"]) if k % 3 else "a", random.choice([None, 1, 2, 3])) for k in range(500)]
    frame = spark.createDataFrame(rows, "id bigint, owner string, day int").repartition(5)
    first = lambda value: (value is not None, value or 0)
    expected, counts = {}, {}
    for k, owner, day in sorted(rows, key=lambda r: (first(r[2]), r[0])):
        counts[owner] = counts.get(owner, 0) + 1
        expected[k] = counts[owner]
    ranked = rank_rows(frame, ["day", "id"], "place", ["owner"])
    assert ranked.columns == ["id", "owner", "day", "place"]
    assert {r["id"]: r["place"] for r in ranked.collect()} == expected
    newest = rank_rows(frame, [F.desc_nulls_last("day"), F.desc("id")], "place").collect()
    in_order = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), -r[0]))
    assert {r["id"]: r["place"] for r in newest} == {r[0]: i + 1 for i, r in enumerate(in_order)}
    assert rank_rows(frame.limit(0), ["id"], "place", ["owner"]).count() == 0
