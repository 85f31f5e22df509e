from datetime import datetime, timedelta, timezone

import pytest

from larkspur.functions.periods import interval_ms, parse_period, resolve
from larkspur.operators.trends import checkpoint_sample, with_baseline
from larkspur.sources.git import commit_frame, commit_up_to, commits_between, parse_log

UTC = timezone.utc
MONTH = 30 * 86_400_000


@pytest.mark.parametrize(("text", "days"), [("1y", 365), ("6m", 180), ("2w", 14), ("30d", 30), ("2W", 14), (" 1Y ", 365)])
def test_periods(text, days):
    assert parse_period(text) == timedelta(days=days)


def test_dates_and_garbage():
    assert parse_period("2024-01-15") == datetime(2024, 1, 15, tzinfo=UTC)
    assert resolve(parse_period("1d"), datetime(2024, 1, 2, tzinfo=UTC)) == datetime(2024, 1, 1, tzinfo=UTC)
    for bad in ("", "x", "6", "m6", "1h"):
        with pytest.raises(ValueError, match="period"):
            parse_period(bad)
    with pytest.raises(ValueError, match="interval"):
        interval_ms("2024-01-01")


def test_log_lines():
    assert list(parse_log("abc 2024-01-15T00:00:00+00:00\n\nbroken\nx y\n")) == [("abc", "2024-01-15T00:00:00+00:00", 1705276800000)]
    assert list(parse_log("")) == []


def test_ranges_include_both_ends():
    asked = []
    commits_between("/r", datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 2, 1, tzinfo=UTC), lambda p, a: asked.append(a) or "")
    assert "--after=2023-12-31T23:59:59+00:00" in asked[0]
    assert commit_up_to("/r", datetime(2024, 1, 1, tzinfo=UTC), lambda p, a: asked.append(a) or "a 2024-01-01T00:00:00Z") == ("a", "2024-01-01T00:00:00Z", 1704067200000)
    assert "--before=2024-01-01T00:00:01+00:00" in asked[1]
    assert commit_up_to("/r", datetime(2024, 1, 1, tzinfo=UTC), lambda p, a: "") is None


def monthly(spark):
    at = [datetime(2024, m, 15, tzinfo=UTC) for m in range(1, 7)]
    return commit_frame(spark, [(f"c{i}", d.isoformat(), int(d.timestamp() * 1000)) for i, d in enumerate(at)])


def test_one_commit_a_span_newest_first(spark):
    rows = [r.sha for r in checkpoint_sample(monthly(spark), "epoch_ms", MONTH, (), "sha").collect()]
    assert rows == sorted(rows, reverse=True)
    whole = [r.sha for r in checkpoint_sample(monthly(spark), "epoch_ms", 365 * 86_400_000, (), "sha").collect()]
    assert whole == ["c5"]
    assert checkpoint_sample(commit_frame(spark, []), "epoch_ms", MONTH).count() == 0


def test_baseline_is_pinned_to_the_start(spark):
    commits = monthly(spark)
    start = int(datetime(2024, 3, 1, tzinfo=UTC).timestamp() * 1000)
    sampled = commits.filter(f"epoch_ms > {start}")
    rows = {r.sha: r.code_at_ms for r in with_baseline(sampled, commits, start).collect()}
    assert rows["c1"] == start and len(rows) == 5
    again = with_baseline(commits, commits, start)
    assert again.count() == 6
