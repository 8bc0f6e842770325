import os
import tempfile

from spineworks.sources.sink import read_table


def test_cli_writes_reports(spark):
    from spineworks.run import main
    d = tempfile.mkdtemp(prefix="spineworks-cli-")
    main(["--source", "/root/testdata/sf0.001", "--warehouse", f"{d}/wh", "--out", f"{d}/out",
          "--reports", "active_end_month_included,clean_usage", "--fixture"])
    assert sorted(os.listdir(f"{d}/out")) == ["active_end_month_included", "clean_usage"]
    assert read_table(spark, f"{d}/out/active_end_month_included").count() == 12
