from querytide.operators import brand

CASES = [  # query, brand, held
    ("별담 신발", "별담", True), ("별담이 산책", "별담", False), ("큰한울 후기", "한울", False), ("한울 후기", "한울", True),
    ("솔 비누", "솔", True), ("해솔 마을", "솔", False), ("가을보리 차", "을보리", False), ("을보리 차", "을보리", True),
    ("국산 녹차 누리7", "누리", True), ("푸른숲길 지도", "푸른 숲길", True), ("북마루길 걷기", "마루", False),
    ("brand#20 ring", "brand#2", False), ("brand#2 ring", "brand#2", True), ("brand#2x ring", "brand#2", True),
]
NAMES = [("별담", "별담"), ("한울", "한울"), ("솔", "솔"), ("을보리", "을보리"), ("누리", "누리"), ("푸른 숲길", "푸른 숲길"), ("마루", "마루"), ("brand#2", "brand#2")]
EXCLUDES = [("별담", "별담이"), ("한울", "큰한울"), ("brand#2", "brand#20")]


def tables(spark):
    q = spark.createDataFrame([("a", q) for q, _, _ in CASES], "run_id string, query string").distinct()
    n = spark.createDataFrame([("a", b, x) for b, x in NAMES], "run_id string, brand string, name string")
    x = spark.createDataFrame([("a", b, t) for b, t in EXCLUDES], "run_id string, brand string, text string")
    return q, n, x


def test_brand_matching(spark):
    hits = {(r.query, r.brand) for r in brand.brand_hits(*tables(spark)).collect()}
    assert {(q, b): (q, b) in hits for q, b, _ in CASES} == {(q, b): held for q, b, held in CASES}


def test_missing_and_zero_volume_differ(spark):
    asked = spark.createDataFrame([("a", "x"), ("a", "y y"), ("a", "z"), ("a", "w w")], "run_id string, query string")
    vols = spark.createDataFrame([("a", "x", 0.0), ("a", "yy", 4.0), ("a", "y  y", 6.0), ("a", "w w", 1.0), ("a", "ww", 9.0)], "run_id string, keyword string, volume double")
    assert {r.query: r.volume for r in brand.volume_lookup(asked, vols).collect()} == {"x": 0.0, "y y": 6.0, "z": None, "w w": 1.0}


def test_steps_count_from_the_seed_and_ignore_the_seed_itself(spark):
    j = spark.createDataFrame([("a", "ring", ["x ring", "ring", "brand#2 a", "brand#2 b"]), ("a", "ring", ["brand#2 a", "y"])], "run_id string, category string, seq array<string>")
    hits = spark.createDataFrame([("a", "brand#2 a", "b2"), ("a", "brand#2 b", "b2")], "run_id string, query string, brand string")
    r = brand.journey_brand_index(j, hits, ["run_id", "category"], "category").first()
    assert (r.n, r.step) == (2, 1)  # the node at position 0 without a seed is not a step
