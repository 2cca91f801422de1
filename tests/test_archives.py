"""Archives of a period: chosen by name, the others never opened."""

import datetime as dt
import zipfile

import pytest

from tidemesh.sources import archives, quotes, sinks


def record(ticker, date, market="010"):
    return f"01{date}02{ticker:<12}{market}{'COMPANY':<12}{'PN':<10}{' ' * 7}{'0000000001000' * 3}{'0000000001100'}{'0000000001234'}{'0' * 26}00007{'0' * 18}{'000000000000050000'}"


def archive(folder, name, *records):
    with zipfile.ZipFile(folder / name, "w") as z:
        z.writestr(f"{name[:-4]}.TXT", "\n".join(["00HEAD", *records, "99TAIL"]))


@pytest.fixture
def folder(tmp_path):
    archive(tmp_path, "COTAHIST_A1999.ZIP", record("OLD3", "19991230"))
    archive(tmp_path, "COTAHIST_A2000.ZIP", record("AAA3", "20000103"), record("AAA3", "20000210"), record("AAA3", "20000310"), record("OPT1", "20000310", "070"), record("DEC3", "20001228"))
    archive(tmp_path, "cotahist_m022000.zip", record("AAA3", "20000210"), record("LATE3", "20000211"))
    (tmp_path / "COTAHIST_A2001.ZIP").write_bytes(b"not an archive")
    (tmp_path / "notes.zip").write_bytes(b"nor this")
    return tmp_path


def read(spark, folder, first, last, **more):
    rows = archives.read_period(spark, str(folder), first, last, **more).collect()
    return sorted((str(r.obs_date), r.ticker) for r in rows)


def test_a_period_opens_its_archives_only(spark, folder):
    # 2001's archive can't be opened: a scan that tried would fail.
    assert read(spark, folder, dt.date(2000, 1, 1), dt.date(2000, 12, 31)) == [("2000-01-03", "AAA3"), ("2000-02-10", "AAA3"), ("2000-02-11", "LATE3"), ("2000-03-10", "AAA3"), ("2000-03-10", "OPT1"), ("2000-12-28", "DEC3")]
    assert read(spark, folder, dt.date(2000, 2, 1), dt.date(2000, 2, 29)) == [("2000-02-10", "AAA3"), ("2000-02-11", "LATE3")]
    assert read(spark, folder, dt.date(1999, 12, 30), dt.date(2000, 1, 31)) == [("1999-12-30", "OLD3"), ("2000-01-03", "AAA3")]
    with pytest.raises(Exception, match="(?i)zip"):
        read(spark, folder, dt.date(2000, 12, 1), dt.date(2001, 1, 1))


def test_markets_and_layouts(spark, folder):
    march = (dt.date(2000, 3, 1), dt.date(2000, 3, 31))
    assert read(spark, folder, *march, market="010") == [("2000-03-10", "AAA3")]
    assert archives.read_period(spark, str(folder), *march, quotes.EXTENDED, "070").first()["trades"] == 7


def test_nothing_to_read(spark, folder):
    assert read(spark, folder, dt.date(1990, 1, 1), dt.date(1990, 2, 1)) == []
    assert read(spark, folder, dt.date(2000, 5, 1), dt.date(2000, 4, 1)) == []


def test_which_archive_holds_a_month(spark):
    paths = [("/a/COTAHIST_A2000.ZIP",), ("/b/COTAHIST_A2000.ZIP",), ("/a/COTAHIST_M022000.ZIP",), ("/a/COTAHIST_M132000X.ZIP",), (None,), ("/a/COTAHIST_M012001.zip",)]
    listed = archives.catalogue(spark.createDataFrame(paths, "path string"))
    assert listed.count() == 4
    months = archives.months_of(spark, dt.date(2000, 2, 5), dt.date(2001, 2, 1))
    held = {r.path: sorted(r.months) for r in archives.holding(listed, months).collect()}
    assert held == {"/b/COTAHIST_A2000.ZIP": list(range(3, 13)), "/a/COTAHIST_M022000.ZIP": [2], "/a/COTAHIST_M012001.zip": [1]}
    assert [tuple(r) for r in archives.missing_months(listed, months).collect()] == [(2001, 2)]


def test_a_write_that_fails_for_another_reason_is_raised(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, 2)], "window_id int, k int")
    (tmp_path / "file").write_text("x")
    with pytest.raises(Exception) as e:
        sinks.write_csv_by_window(df, f"{tmp_path}/file/below")
    assert "attempts" not in str(e.value)
