"""The batch-job entry point writes a report that equals the registered query."""

import dataclasses
import json
import os
import tempfile

import pytest

from tradewind.__main__ import main
from tradewind.functions import AsOf
from tradewind.plans import FIXTURE, REPORTS, Params, present
from tradewind.sources import Warehouse, publish_report, read_report


def test_cli_writes_report(spark, sf_small):
    out = os.path.join(tempfile.mkdtemp(prefix="tradewind-cli-"), "inbound")
    main(["inbound_buckets", sf_small, out, "--fixture"], spark=spark)
    got = read_report(spark, out)
    want = present(REPORTS["inbound_buckets"](Warehouse(spark, sf_small), FIXTURE))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_cli_wants_clock_and_parameters(spark, sf_small):
    for more in ([], ["--as-of", "2000-06-15 10:00:00"], ["--fixture", "--params", "p.json"]):
        with pytest.raises(SystemExit):
            main(["inbound_buckets", sf_small, "/nowhere", *more], spark=spark)


def _file(tmp_path, fields):
    path = tmp_path / "p.json"
    path.write_text(json.dumps(fields))
    return str(path)


def test_parameters_go_through_json():
    assert Params.from_json(json.loads(json.dumps(FIXTURE.to_json())), FIXTURE.as_of) == FIXTURE


def test_a_params_file_names_every_field(spark, sf_small, tmp_path, capsys):
    """Nothing is taken silently from the test tables."""
    main(["show-params"])
    full = json.loads(capsys.readouterr().out)
    for name in full:
        some = {k: v for k, v in full.items() if k != name}
        with pytest.raises(ValueError, match=name):
            Params.from_json(some, "2000-07-01")
    with pytest.raises(SystemExit, match="missing parameters: .*plant"):
        main(["inbound_buckets", sf_small, "/nowhere", "--as-of", "2000-07-01", "--params", _file(tmp_path, {"sell_in_days": 60})], spark=spark)
    with pytest.raises(SystemExit, match="unknown parameters: colour"):
        main(["inbound_buckets", sf_small, "/nowhere", "--as-of", "2000-07-01", "--params", _file(tmp_path, full | {"colour": 1})], spark=spark)


def test_cli_params_and_clock(spark, sf_small, tmp_path):
    own = FIXTURE.to_json() | {"sell_in_days": 60, "account_patterns": ["%BUILD%"]}
    out = str(tmp_path / "sellin")
    main(["sell_in_trailing", sf_small, out, "--params", _file(tmp_path, own), "--as-of", "2000-07-01 09:00:00", "--format", "csv"], spark=spark)
    p = dataclasses.replace(FIXTURE, sell_in_days=60, account_patterns=("%BUILD%",), as_of=AsOf.of("2000-07-01 09:00:00"))
    want = present(REPORTS["sell_in_trailing"](Warehouse(spark, sf_small), p))
    got = read_report(spark, out)
    assert got.schema == want.schema and got.count() == want.count()


def test_a_report_lost_before_the_switch_leaves_the_old_one(spark, tmp_path, monkeypatch):
    from tradewind.sources import sheet
    path = str(tmp_path / "report")
    publish_report(spark.range(3), path)

    def lost(*_, **__):
        raise KeyboardInterrupt
    monkeypatch.setattr(sheet, "switch", lost)
    with pytest.raises(KeyboardInterrupt):
        publish_report(spark.range(9), path)
    assert read_report(spark, path).count() == 3
    monkeypatch.undo()
    with pytest.raises(Exception, match="half way"):
        publish_report(spark.range(9).selectExpr("if(id = 8, raise_error('half way'), id) AS id"), path)
    assert read_report(spark, path).count() == 3
    publish_report(spark.range(9), path)
    assert read_report(spark, path).count() == 9
    with pytest.raises(FileNotFoundError):
        read_report(spark, str(tmp_path / "none"))
