import os
import tempfile

from pyspark.sql import types as T

from spineworks.sources.calendar import month_spine
from spineworks.sources.catalog import column_catalog, id_columns, list_tables
from spineworks.sources.csv import read_csv
from spineworks.sources.sink import read_table, write_table
from helpers import D


def test_csv_na_tokens_and_types(spark):
    d = tempfile.mkdtemp(prefix="spineworks-csv-")
    path = os.path.join(d, "x.csv")
    with open(path, "w") as f:
        f.write("id,name,when,flag\n1,NA,2024-01-05,True\n2,null,,False\n3,,2024-02-01,\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                           T.StructField("when", T.DateType()), T.StructField("flag", T.BooleanType())])
    got = sorted(tuple(r) for r in read_csv(spark, path, schema).collect())
    assert got == [(1, None, D("2024-01-05"), True), (2, None, None, False),
                   (3, None, D("2024-02-01"), None)]


def test_month_spine_inclusive(spark):
    got = [r["month_date"] for r in month_spine(spark, D("2024-01-01"), D("2024-12-01")).collect()]
    assert len(got) == 12 and got[0] == D("2024-01-01") and got[-1] == D("2024-12-01")


def test_catalog(spark):
    a = spark.createDataFrame([(1, "x")], "usage_id bigint, account_id string")
    b = spark.createDataFrame([("s", 1)], "subscription_id string, seats bigint")
    tabs = {"b": b, "a": a}
    assert [r[0] for r in list_tables(spark, tabs).collect()] == ["a", "b"]
    cat = [tuple(r) for r in column_catalog(spark, tabs).collect()]
    assert cat[0] == ("a", "usage_id", "bigint", 1)
    assert [tuple(r) for r in id_columns(spark, tabs).collect()] == [
        ("a", "account_id"), ("b", "subscription_id")]


def test_sink_overwrites(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="spineworks-sink-"), "t")
    write_table(spark.range(5), d)
    write_table(spark.range(3), d)
    assert read_table(spark, d).count() == 3


def test_csv_bad_dates_fail_or_quarantine(spark):
    import pytest
    d = tempfile.mkdtemp(prefix="spineworks-csv-")
    path = os.path.join(d, "bad.csv")
    with open(path, "w") as f:
        f.write("id,when\n1,2024-01-05\n2,not-a-date\n3,NA\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("when", T.DateType())])
    with pytest.raises(Exception):
        read_csv(spark, path, schema).collect()
    got = sorted(tuple(r) for r in read_csv(spark, path, schema, on_error="null").collect())
    assert got == [(1, D("2024-01-05")), (2, None), (3, None)]
    from spineworks.sources.csv import quarantine
    assert [r["id"] for r in quarantine(spark, path, schema).collect()] == ["2"]


def test_csv_loaders_feed_tables(spark):
    from spineworks.plans.tables import Tables
    from spineworks.plans import subscriptions as S
    from spineworks.plans.params import Params
    from spineworks.sources.csv import csv_loaders
    d = tempfile.mkdtemp(prefix="spineworks-csv-")
    files = {
        "subscription": "subscription_id,account_id,start_date,end_date,plan_tier,seats,mrr_amount,"
                        "arr_amount,is_trial,upgrade_flag,downgrade_flag,churn_flag,billing_frequency,"
                        "auto_renew_flag\nS-1,A-1,2024-01-10,2024-03-05,Pro,3,10.5,126,False,False,False,"
                        "True,monthly,True\nS-2,A-1,2024-02-01,,Basic,1,0,0,True,False,False,False,"
                        "monthly,False\n",
        "account": "account_id,account_name,industry,country,signup_date,referral_source,plan_tier,"
                   "seats,is_trial,churn_flag\nA-1,Acme,FinTech,US,2023-12-01,ads,Pro,3,False,False\n",
        "feature_usage": "usage_id,subscription_id,usage_date,feature_name,usage_count,"
                         "usage_duration_secs,error_count\nU-1,S-1,2024-01-12,f1,3,40,1\n",
        "support_ticket": "ticket_id,account_id,submitted_at,closed_at,resolution_time_hours,"
                          "first_response_time_minutes,priority,escalation_flag,satisfaction_score\n"
                          "T-1,A-1,2024-01-05 10:00:00,2024-01-06 10:00:00,24,30,high,False,NA\n",
        "churn_event": "churn_event_id,account_id,churn_date,reason_code,refund_amount_usd,"
                       "feedback_text,is_reactivation\nC-1,A-1,2024-03-05,pricing,0,,False\n",
    }
    paths = {}
    for name, text in files.items():
        paths[name] = os.path.join(d, f"{name}.csv")
        with open(paths[name], "w") as f:
            f.write(text)
    t = Tables(spark, d, loaders=csv_loaders(paths))
    got = {r["month_date"]: r["active_subscriptions"]
           for r in S.active_end_month_included(t.subscription, Params()).collect()}
    assert got[D("2024-01-01")] == 1 and got[D("2024-02-01")] == 2 and got[D("2024-03-01")] == 2
    assert t.support_ticket.first()["satisfaction_score"] is None
    assert t.churn_event.first()["feedback_text"] is None


def test_scale_conf_sizes_partitions():
    from spineworks.session import scale_conf
    conf = scale_conf(total_cores=8000, input_bytes=100 << 40)
    assert int(conf["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert scale_conf(64, 1 << 30)["spark.sql.shuffle.partitions"] == "128"


def _csv(text):
    path = os.path.join(tempfile.mkdtemp(prefix="spineworks-csv-"), "x.csv")
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("txt", T.StringType()),
                    T.StructField("n", T.LongType())])


def test_csv_columns_are_found_by_name(spark):
    import pytest
    assert [tuple(r) for r in read_csv(spark, _csv("txt,id,n\nhello,1,3.0\n"), ROW).collect()] == [(1, "hello", 3)]
    for header in ("txt,id\nhello,1\n", "txt,id,n,more\nhello,1,2,3\n"):
        with pytest.raises(ValueError):
            read_csv(spark, _csv(header), ROW)
    with pytest.raises(Exception):
        read_csv(spark, _csv("id,txt,n\n1,a,3.5\n"), ROW).collect()
    assert read_csv(spark, _csv("id,txt,n\n1,a,3.5\n"), ROW, on_error="null").first()["n"] is None


def test_csv_quotes_commas_and_newlines(spark):
    text = 'id,txt,n\n1,"say ""hi"", ok",2\n2,"two\nlines",\n'
    got = [tuple(r) for r in read_csv(spark, _csv(text), ROW, multi_line=True).collect()]
    assert got == [(1, 'say "hi", ok', 2), (2, "two\nlines", None)]
