import random

import pytest

from ultradia.operators import badrows, hotdeck


def lines(spark, rows):
    return spark.createDataFrame([(i, f, n, t, "clash") for i, (f, n, t) in enumerate(rows)], "line_id long, source_file string, line_no int, raw_line string, monitor string")


HEAD = {",": "Monitor,Channel,Genotype,Sex,Treatment", "|": "Monitor|Channel|Genotype|Sex|Treatment", "\t": "Monitor\tChannel\tGenotype\tSex\tTreatment", ";": "Monitor;Channel;Genotype;Sex;Treatment"}


@pytest.mark.parametrize("d", [",", "|", "\t", ";"])
def test_reasons(spark, d):
    cases = [
        ("1_a{d}ch1{d}Wt-A{d}Male{d}VEH", None), (" 1_a {d} \"ch32\" {d}x{d}y{d} \"VEH (a{d} b)\" ", None), ("1{d}CH07{d}x{d}y{d}0.5mM Gly + 3 uM Arg (new)", None),
        ("1{d}ch1{d}x{d}y{d}\"VEH (the \"\"B\"\" one)\"", None), ("1{d}ch1{d}na{d}NA{d}Na", None), ("", None), ("   ", None), (None, None),
        ("1{d}ch1{d}x{d}y{d}\"VEH", "quoting"), ("1{d}ch1{d}x{d}y{d}\"VEH\"x", "quoting"), ("1{d}ch1{d}x{d}y{d}V\"EH", "quoting"), ("1{d}\"ch1{d}x{d}y", "quoting"),
        ("1{d}ch1{d}x{d}y", "columns"), ("1{d}ch1{d}x{d}y{d}VEH{d}", "columns"), ("just text", "columns"),
        ("1{d}ch33{d}x{d}y{d}VEH", "channel"), ("1{d}ch0{d}x{d}y{d}bad", "channel"), ("1{d}{d}na{d}na{d}na", "channel"), ("1{d}ch 1{d}x{d}y{d}VEH", "channel"), ("1{d}ch001{d}x{d}y{d}VEH", "channel"),
        ("1{d}ch1{d}x{d}y{d}", "treatment"), ("1{d}ch1{d}x{d}y{d}veh", "treatment"), ("1{d}ch1{d}x{d}y{d}0mM Gly", "treatment"), ("1{d}ch1{d}x{d}y{d}2mMGly", "treatment"), ("1{d}ch1{d}x{d}y{d}2mM G", "treatment"),
        ("1{d}ch1{d}x{d}y{d}VEH (a) (b)", "treatment"), ("1{d}ch1{d}x{d}y{d}1mM Gly +2mM Arg", "treatment"), ("1{d}ch1{d}x{d}y{d}-1mM Gly", "treatment"),
    ]
    df = lines(spark, [("f", 1, HEAD[d]), *[("f", i + 2, None if t is None else t.format(d=d)) for i, (t, _) in enumerate(cases)]])
    good, faulty = badrows.split_lines(df)
    got = {r.line_id: r.reason for r in faulty.collect()}
    assert got == {i + 1: why for i, (_, why) in enumerate(cases) if why}
    rows = {r.line_id: r for r in good.collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert rows[2].treatment == f"VEH (a{d} b)" and rows[2].channel == 32 and rows[4].treatment == 'VEH (the "B" one)'


def test_long_lines_empty_tables_and_files_without_header(spark):
    long = "1,ch1,x,y,\"" + 'a""b,' * 60_000 + "\""
    df = lines(spark, [("f", 1, HEAD[","]), ("f", 2, long), ("f", 3, long[:-1]), ("g", 2, "1,ch1,x,y,VEH")])
    assert {r.line_id: r.reason for r in badrows.split_lines(df)[1].collect()} == {1: "treatment", 2: "quoting", 3: "columns"}
    good, faulty = badrows.split_lines(lines(spark, []))
    assert good.count() == faulty.count() == 0


def deck(spark, rows):
    df = spark.createDataFrame(rows, "fly string, a string, b string, o int, v double, donor_scope string")
    return {r.fly: r for r in hotdeck.hot_deck(df, "fly", ["a", "b"], "o", "v").collect()}


def test_nearest_donor(spark):
    rows = [("f1", "x", "m", 1, 1.0), ("f2", "x", "m", 3, None), ("f3", "x", "m", 4, 4.0), ("f4", "x", "m", 2, None), ("f5", "x", "n", 1, None), ("f6", "y", "q", 1, None), ("f7", None, None, None, None)]
    got = deck(spark, [(*r, "clash") for r in rows])
    assert (got["f2"].filled_value, got["f2"].donor, got["f2"].donor_scope, got["f2"].distance) == (4.0, "f3", 0, 1.0)
    assert got["f4"].donor == "f1"  # equally near is decided by the earlier one
    assert got["f5"].was_filled and got["f5"].donor_scope == 1 and got["f5"].donor == "f1" and got["f5"].distance == 0.0  # the wider group's nearest by order
    assert got["f6"].donor_scope == 2 and got["f7"].was_filled
    assert not got["f1"].was_filled and got["f1"].donor is None


def test_no_donor_and_no_rows(spark):
    assert not deck(spark, [("f1", "x", "m", 1, None, "c")])["f1"].was_filled
    assert deck(spark, []) == {}


def test_hot_deck_beats_the_mean(spark):
    """Held-out values that neighbours share."""
    rng = random.Random(4)
    truth, rows = {}, []
    for m in range(12):
        for c in range(32):
            v = 100.0 * m + 10 * (c // 8) + rng.random()
            hide = rng.random() < 0.2
            truth[f"{m}-{c}"] = (v, hide)
            rows.append((f"{m}-{c}", "x", str(m), c, None if hide else v, "c"))
    got = deck(spark, rows)
    known = [v for v, h in truth.values() if not h]
    mean = sum(known) / len(known)
    hidden = [(k, v) for k, (v, h) in truth.items() if h]
    assert sum(abs(got[k].filled_value - v) for k, v in hidden) < 0.05 * sum(abs(mean - v) for _, v in hidden)


def test_filled_fields_on_repeats_and_odd_values(spark):
    strains = spark.createDataFrame([("Wt-A",), ("Obd",)], "genotype string")
    flies = spark.createDataFrame(
        [("M1_Ch01", 1, " wt-a ", "F", "VEH"), ("M1_Ch01", 1, " wt-a ", "F", "VEH"), ("M1_Ch02", 1, "n/a", "male", "VEH"), ("M1_Ch03", 1, None, None, None), ("odd", 1, "Obd", "F", "VEH")],
        "fly_id string, experiment_id int, genotype string, sex string, treatment string",
    )
    features = spark.createDataFrame(
        [(1, 1, "M1_Ch01", float("nan"), 1440.0), (2, 1, "M1_Ch02", 0.0, -1.0), (3, 1, "M1_Ch03", 1.0, 1441.0), (4, 1, "M1_Ch03", 1.0, 1441.0), (5, 1, "odd", None, 0.0)],
        "feature_id long, experiment_id int, fly_id string, p_doze_mean double, total_sleep_mean double",
    )
    got = {(r.fly_id, r.field): r for r in hotdeck.filled_fields(features, flies, strains).collect()}
    missing = {k for k, r in got.items() if r.was_missing}
    assert missing == {("M1_Ch01", "p_doze_mean"), ("odd", "p_doze_mean"), ("M1_Ch02", "total_sleep_mean"), ("M1_Ch03", "total_sleep_mean"), ("M1_Ch02", "genotype"), ("M1_Ch03", "genotype")}
    assert all(got[k].was_filled for k in missing) and got[("M1_Ch02", "genotype")].filled_value == "Wt-A"
    assert len(got) == 4 * 3
