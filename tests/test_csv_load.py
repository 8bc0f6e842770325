"""CSV files read once into good rows and rejects, and the command line over five CSV files."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spineworks.plans.params import Params
from spineworks.plans.registry import QUERIES
from spineworks.plans.tables import Tables
from spineworks.sources.csv import checked_csv, csv_loaders, load_csv, quarantine, read_csv
from spineworks.sources.schemas import SCHEMAS
from spineworks.sources.sink import read_table

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("when", T.DateType()),
                       T.StructField("name", T.StringType()), T.StructField("ok", T.BooleanType())])


def _write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


@pytest.fixture
def folder():
    d = tempfile.mkdtemp(prefix="spineworks-csv-load-")
    _write(f"{d}/in", "a.csv", "id,when,name,ok\n1,2024-01-05,a,true\n2.0,NA,,False\n3,2024-02-30,c,true\n")
    _write(f"{d}/in", "b.csv", 'id,when,name,ok\nx,soon,"say ""hi""",maybe\n5,2024-03-01,NULL,1\n6.5,2024-03-02,e,0\n')
    return d


def test_rows_in_are_good_or_rejected(spark, folder):
    good, bad = load_csv(spark, f"{folder}/in", SCHEMA, f"{folder}/out")
    assert sorted(tuple(r) for r in good.collect()) == [
        (1, dt.date(2024, 1, 5), "a", True), (2, None, None, False), (5, dt.date(2024, 3, 1), None, True)]
    errors = {r["name"]: [(e["column"], e["text"], os.path.basename(e["file"])) for e in r["_errors"]] for r in bad.collect()}
    assert errors == {"c": [("when", "2024-02-30", "a.csv")], "e": [("id", "6.5", "b.csv")],
                      'say "hi"': [("id", "x", "b.csv"), ("when", "soon", "b.csv"), ("ok", "maybe", "b.csv")]}
    assert good.count() + bad.count() == 6
    # the plain quarantine lists the same rows
    assert sorted(r["name"] for r in quarantine(spark, f"{folder}/in", SCHEMA).collect()) == sorted(errors)


def test_each_file_is_read_once(spark, folder):
    df = checked_csv(spark, f"{folder}/in", SCHEMA)
    plan = df.withColumn("_rejected", F.size("_errors") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1
    good, bad = load_csv(spark, f"{folder}/in", SCHEMA, f"{folder}/out")
    for part in (good, bad):  # both are read from what was written
        assert "FileScan csv" not in part._jdf.queryExecution().executedPlan().toString()


def test_good_files_agree_with_the_strict_read(spark, folder):
    _write(f"{folder}/fine", "a.csv", "ok,id,name,when\ntrue,1,a,2024-01-05\n,2,n/a,\n")
    good, bad = load_csv(spark, f"{folder}/fine", SCHEMA, f"{folder}/out")
    assert bad.count() == 0
    assert sorted(map(str, good.collect())) == sorted(map(str, read_csv(spark, f"{folder}/fine", SCHEMA).collect()))


def _entities(folder):
    _write(folder, "account.csv", "account_id,account_name,industry,country,signup_date,referral_source,plan_tier,seats,is_trial,churn_flag\n"
           "A-1,One,FinTech,US,2023-11-05,ads,Pro,5,False,False\nA-2,Two,EdTech,DE,2024-01-20,partner,Basic,2,False,True\n")
    _write(folder, "subscription.csv", "subscription_id,account_id,start_date,end_date,plan_tier,seats,mrr_amount,arr_amount,is_trial,"
           "upgrade_flag,downgrade_flag,churn_flag,billing_frequency,auto_renew_flag\n"
           "S-1,A-1,2023-12-10,,Pro,5,100,1200,False,False,False,False,monthly,True\n"
           "S-2,A-2,2024-02-01,2024-05-15,Basic,2,20.5,246,False,False,False,True,annual,False\n"
           "S-3,A-2,2024-02-01,2024-05-15,Basic,2,20.5,246,False,False,False,True,annual,False\n"
           "S-4,A-1,2024-06-01,,Pro,1,0,0,True,False,False,False,monthly,True\n")
    _write(folder, "feature_usage.csv", "usage_id,subscription_id,usage_date,feature_name,usage_count,usage_duration_secs,error_count\n"
           "U-1,S-1,2024-01-02,feature_1,3,60,1\nU-1,S-2,2024-03-02,feature_2,0,60,1\n")
    _write(folder, "support_ticket.csv", "ticket_id,account_id,submitted_at,closed_at,resolution_time_hours,priority,"
           "first_response_time_minutes,satisfaction_score,escalation_flag\n"
           "T-1,A-1,2024-01-03,2024-01-05 10:00:00,58,high,30,4.0,False\nT-2,A-1,2024-02-03,2024-02-05 10:00:00,58,low,30,,True\n")
    _write(folder, "churn_event.csv", "churn_event_id,account_id,churn_date,reason_code,refund_amount_usd,feedback_text,is_reactivation\n"
           "C-1,A-2,2024-05-15,pricing,10.5,too expensive,False\n")


def test_command_line_over_csv_files(spark, folder):
    from spineworks.run import main
    _entities(f"{folder}/src")
    reports = ("recurring_revenue", "tickets_per_month", "null_profile", "clean_usage", "churn_reconciliation")
    main(["--source", f"{folder}/src", "--warehouse", f"{folder}/wh", "--out", f"{folder}/out", "--format", "csv",
          "--reports", ",".join(reports)])
    got = {r["month_date"].month: r["revenue"] for r in read_table(spark, f"{folder}/out/recurring_revenue").collect()}
    # the copy S-3 is removed; S-1 is open, S-2 runs from February to May; the open trial adds nothing
    assert got == {m: 120.5 if 2 <= m <= 5 else 100.0 for m in range(1, 13)}
    assert read_table(spark, f"{folder}/out/clean_usage").count() == 1
    loaded = Tables(spark, "", csv_loaders({n: f"{folder}/src/{n}.csv" for n in SCHEMAS}))
    for name in reports:
        bag = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
        assert bag(read_table(spark, f"{folder}/out/{name}")) == bag(QUERIES[name](loaded, Params())), name


def test_command_line_sets_rejects_aside(spark, folder):
    from spineworks.run import main
    _entities(f"{folder}/src")
    with open(f"{folder}/src/subscription.csv", "a") as f:
        f.write("S-9,A-1,not a date,,Pro,many,100,1200,False,False,False,False,monthly,True\n")
    args = ["--source", f"{folder}/src", "--warehouse", f"{folder}/wh", "--out", f"{folder}/out", "--format", "csv",
            "--reports", "count_open_subs"]
    with pytest.raises(Exception):
        main(args)
    main([*args, "--rejects", f"{folder}/rejects"])
    assert read_table(spark, f"{folder}/out/count_open_subs").first()[0] == 2
    bad = read_table(spark, f"{folder}/rejects/subscription").where("_rejected = 'true'").collect()
    assert [[(e["column"], e["text"]) for e in r["_errors"]] for r in bad] == [[("start_date", "not a date"), ("seats", "many")]]
