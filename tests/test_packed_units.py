from vacantia.operators import packed, units


def unpack(spark, texts):
    rows = [("s", i, "f", t, "clash") for i, t in enumerate(texts)]
    out = {}
    for r in packed.unpack(spark.createDataFrame(rows, "src string, record_id long, field_name string, text string, val string")).collect():
        out.setdefault(r["record_id"], []).append((r["pos"], r["val"]))
    return {k: [v for _, v in sorted(xs)] for k, xs in out.items() if [p for p, _ in sorted(xs)] == list(range(1, len(xs) + 1))}


def test_packed(spark):
    texts = [
        "Spain, Mexico and Peru", "Bosnia and Herzegovina; Spain", "Spain, Bosnia and Herzegovina", '["a, b", "so \\"x\\""]', '"a ""b""";c', "Korea\\, Republic of, Spain", "- one\r\n- two\r\n",
        "TCP/IP / A/B testing", ",a,, b,", "EU | Spain;Peru, Mexico", "Spain or Peru", "R&D & Spain", " single ", "Peru and Bosnia and Herzegovina", "R&D|Spain", None, "  ", "[broken, list",
    ]
    got = unpack(spark, texts)
    assert got[0] == ["Spain", "Mexico", "Peru"] and got[1] == ["Bosnia and Herzegovina", "Spain"] and got[2] == ["Spain", "Bosnia and Herzegovina"]
    assert got[3] == ["a, b", 'so "x"'] and got[4] == ['a "b"', "c"] and got[5] == ["Korea, Republic of", "Spain"] and got[6] == ["one", "two"]
    assert got[7] == ["TCP/IP", "A/B testing"] and got[8] == ["a", "b"] and got[9] == ["EU", "Spain", "Peru", "Mexico"] and got[10] == ["Spain", "Peru"]
    assert got[11] == ["R&D", "Spain"] and got[12] == ["single"] and got[13] == ["Peru", "Bosnia and Herzegovina"] and 15 not in got and 16 not in got


def test_known_value_of_any_number_of_parts(spark):
    long = "a and b and c and d and e and f"
    got = unpack(spark, [f'"{long}"; x', f"y, {long}", long])
    assert got == {0: [long, "x"], 1: ["y", long], 2: [long]}


def test_packed_long_and_empty(spark):
    assert len(unpack(spark, [", ".join(f"v{i}" for i in range(5000))])[0]) == 5000
    assert unpack(spark, []) == {}


PAY = "id long, min_amount double, max_amount double, currency string, period string, source string, evidence string, seniority string, observation_type string, extra int"


def test_units(spark):
    rows = [
        (1, 50.0, 60.0, "usd", "p.h.", "s", None, None, "explicit", 1),
        (2, 5000.0, None, "EUR", "year", "s", "6 400-5000 US$ monthly; 28 days off each year", None, "explicit", 1),
        (3, 9.0, 12.0, "INR", None, "s", "9 to 12 LPA", None, "explicit", 1),
        (4, 92.0, 126.0, None, None, "s", "USD 92 - 126 thousand per annum", None, "explicit", 1),
        (5, 54500.0, 68000.0, None, None, "s", "EUR 54,500 - 68K a year", None, "explicit", 1),
        (6, 4500.0, 6400.0, "EUR", "month", "s", "amounts given in cents, per hour", None, "explicit", 1),
        (7, 4.9, 5.0, "EUR", "month", "s", "in T€ /month", None, "explicit", 1),
        (8, 100.0, 100.0, None, "hour", "s", "see posting", None, "explicit", 1),
        (9, None, None, "USD", "year", "s", "", None, "explicit", 1),
        (10, 80.0, None, "XYZ", "year", None, None, None, None, 1),
    ]
    rates = spark.createDataFrame([("USD", 1.0), ("EUR", 1.0835), ("INR", 0.01189)], "currency string, usd_per_unit double")
    got = {(r["id"], r["bound"]): r for r in units.convert(spark.createDataFrame(rows, PAY), rates).collect()}
    want = {(1, "min"): 104000, (1, "max"): 124800, (2, "min"): 60000, (3, "min"): 10701, (4, "max"): 126000, (5, "max"): 73678, (6, "min"): 101416, (7, "max"): 65010}
    assert {k: got[k]["usd_year"] for k in want} == want and all(got[k]["status"] == "stated" for k in want)
    assert got[(8, "min")]["status"] != "stated" and got[(10, "min")]["status"] == "review" and (9, "min") not in got


def test_units_empty(spark):
    assert units.convert(spark.createDataFrame([], PAY), spark.createDataFrame([], "currency string, usd_per_unit double")).count() == 0


def test_accuracy_where_none_is_confident(spark):
    # as many of either period at the same amount: no prediction is above 0.9
    rows = [(i, 50.0, 60.0, "USD", ("hour", "year")[i // 2 % 2], "s", None, None, "explicit", 1) for i in range(200)]
    got = {r["unit"]: r for r in units.held_out(spark.createDataFrame(rows, PAY)).collect()}
    assert got["period_code"]["rows"] > 20 and got["period_code"]["confident"] == 0.0 and got["period_code"]["confident_right"] is None
    assert got["currency_code"]["rows"] > 20 and got["currency_code"]["confident_right"] is None  # one class only, so no forest


def test_accuracy_of_few_rows(spark):
    for n in (0, 1, 2, 5):
        rows = [(i, 50.0, None, ("USD", "EUR")[i % 2], ("hour", "year")[i % 2], "s", None, None, "explicit", 1) for i in range(n)]
        got = {r["unit"]: r for r in units.held_out(spark.createDataFrame(rows, PAY)).collect()}
        assert set(got) == {"period_code", "currency_code"} and all(0 <= r["rows"] <= n and r["confident_right"] in (None, 1.0) for r in got.values())


def test_forest_of_held_rows_only(spark):
    ids = [r["id"] for r in spark.range(200).filter("pmod(xxhash64(id), 5) = 0").limit(2).collect()]
    rows = [(i, 50.0, None, "USD", p, "s", None, None, "explicit", 1) for i, p in zip(ids, ("hour", "year"))] + [(1000, 50.0, None, "USD", None, "s", None, None, "explicit", 1)]
    base = units.stated(spark.createDataFrame(rows, PAY))
    got = units.Forest(base, "period_code", "currency_code").apply(base.filter("period_code is null")).collect()
    assert [(r["predicted_period_code"], r["probability_period_code"]) for r in got] == [(None, 0.0)]
