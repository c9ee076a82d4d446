"""CSV files of mixed layouts: every line is a row, a rejected line or a header."""

from panelmill.sources import feeds, layouts

PRICE, LOSSES, CONGESTION = (feeds.VENDOR_HEADERS[n] for n in ("LBMP", "Marginal_Cost_Losses", "Marginal_Cost_Congestion"))
USUAL = f'Time Stamp,Name,PTID,{PRICE},{LOSSES},{CONGESTION}'


def write(folder, **files):
    for name, lines in files.items():
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n" if lines else "")
    return f"{folder}/*.csv"


def read(spark, path):
    rows, rejects = layouts.read_checked_feed(spark, path, feeds.PRICE_SCHEMA)
    return rows.collect(), {(r.file.split("/")[-1], r.line): list(r.reasons) for r in rejects.collect()}


def test_orders_extra_columns_and_quotes_in_one_folder(spark, tmp_path):
    path = write(
        tmp_path,
        a=[USUAL, "01/02/2024 03:00:00,N,1,30,0.5,2"],
        b=[f'"Time Stamp",x,"{CONGESTION}","{LOSSES}",LBMP,PTID,Name', '"01/02/2024 04:00:00","p,q",2,0.5,30,1,"N, ""S"""'],
        c=[USUAL, "", "   ", "01/02/2024 05:00:00, N ,1,,0.5,2"],
    )
    rows, rejects = read(spark, path)
    got = sorted((str(r.timestamp), r.Name, r.PTID, r.LBMP, r.Marginal_Cost_Losses, r.Marginal_Cost_Congestion) for r in rows)
    assert got == [
        ("2024-01-02 03:00:00", "N", 1, 30.0, 0.5, 2.0),
        ("2024-01-02 04:00:00", 'N, "S"', 1, 30.0, 0.5, 2.0),
        ("2024-01-02 05:00:00", "N", 1, None, 0.5, 2.0),
    ]
    assert rejects == {}


def test_reasons_add_up_to_the_lines(spark, tmp_path):
    bad = {
        "13/02/2024 03:00:00,N,1,30,0.5,2": ["timestamp"],
        ",N,1,30,0.5,2": ["timestamp"],
        "01/02/2024 03:00:00,N,x,n/a,0.5,2": ["PTID", "LBMP"],
        "01/02/2024 03:00:00,N,1,30,0.5": ["fields"],
        "01/02/2024 03:00:00,N,1,30,0.5,2,9": ["fields"],
    }
    good = "01/02/2024 03:00:00,N,1,30,0.5,2"
    path = write(
        tmp_path,
        a=[USUAL, *bad, good, good, USUAL],
        lacks=[f"Time Stamp,Name,{PRICE}", "01/02/2024 03:00:00,N,30"],
        bare=["01/02/2024 03:00:00,N,1,30,0.5,2"],
        two=[USUAL, good, f"Time Stamp,PTID,Name,{PRICE},{LOSSES},{CONGESTION}"],
        empty=[],
    )
    rows, rejects = read(spark, path)
    assert len(rows) == 2
    assert {line: why for (file, line), why in rejects.items() if file == "a.csv"} == bad
    others = {(file, why[0]) for (file, _), why in rejects.items() if file != "a.csv"}
    assert others == {("lacks.csv", "layout"), ("bare.csv", "layout"), ("two.csv", "layout")}
    lines, headers = layouts.read_lines(spark, path).count(), 2 + 1
    assert lines == len(rows) + len(rejects) + headers


def test_plan_shuffles_no_rows(spark, tmp_path):
    path = write(tmp_path, a=[USUAL, "01/02/2024 03:00:00,N,1,30,0.5,2"])
    rows, rejects = layouts.read_checked_feed(spark, path, feeds.PRICE_SCHEMA)
    for df in (rows, rejects):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Python" not in plan
