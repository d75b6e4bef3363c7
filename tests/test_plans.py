"""Every query with a DuckDB twin agrees with it on the smallest tables."""

import time

import pytest

from rollcall.plans import registry
from tests.oracle import rows_of, twin

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_agrees_with_its_twin(spark, name):
    assert rows_of(registry.QUERIES[name](spark, SMALL)) == twin(registry.ORACLE[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() >= 0


def test_ideal_points_of_every_legislature_and_current_members_alone(spark, monkeypatch):
    from rollcall.plans import division_plans as plans

    rows = [(h, f"{h}:{m}", f"d{k}", "aye" if (m + (k if m % 3 else 2 * k)) % 5 < 2 + m % 2 else "no", f"{k:03}") for h in "FO" for m in range(26) for k in range(60)]
    cast = spark.createDataFrame(rows, "legislature string, member_key string, division string, direction string, seq string")
    seats = [(h, f"{h}:{m}", "red" if m % 2 else "blue", "historical" if m < 2 else "current") for h in "FO" for m in range(26)]
    monkeypatch.setattr(plans, "votes", lambda *_: cast)
    monkeypatch.setattr(plans, "members", lambda *_: spark.createDataFrame(seats, "legislature string, member_key string, party string, status string"))
    wanted = {k for _, k, _, status in seats if status == "current"}
    assert {r["member_key"] for r in registry.QUERIES["ideal_points"](spark, SMALL).collect()} == wanted
    assert [(r["legislature"], r["members_placed"]) for r in registry.QUERIES["scaling_report"](spark, SMALL).orderBy("legislature").collect()] == [("F", 24), ("O", 24)]


def test_entry_is_importable_and_covers_the_plans():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["member_record", "benchmarks", "app_payload", "area_members"])
def test_reports_read_the_votes_once(spark, name, monkeypatch):
    """What branches share is written; the votes' own tables are in no plan but that of the shared table."""
    from rollcall.plans import report_plans

    plans = []

    class Noting(report_plans.Scratch):
        def cut(self, df, what):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return super().cut(df, what)

        def keep(self, df, what):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return super().keep(df, what)

    monkeypatch.setattr(report_plans, "Scratch", Noting)
    plans.append(registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("l_suppkey") > 0 for p in plans) == 1


def test_reports_leave_their_result_alone_behind(spark, tmp_path, monkeypatch):
    from rollcall.sources import scratch

    monkeypatch.setattr(scratch, "folder", lambda _, name: f"file://{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}-{time.monotonic_ns()}")
    assert registry.QUERIES["benchmarks"](spark, SMALL).count() > 0
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["report"]
