"""One-day scan of time-sorted CSV files: results and bytes read."""

import datetime as dt
import random

import pytest

from barloom.sources import sorted_csv as sc


def write(path, days, per_day, rng=None, bad=0):
    rng = rng or random.Random(1)
    with open(path, "w", newline="") as f:
        f.write("timestamp,symbol,close\n")
        for k in range(days):
            day = dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
            for m in range(per_day(k)):
                f.write(f"{day + dt.timedelta(seconds=m)},{'s' * rng.randint(1, 9)},{k + m / 1000}\n")
                if bad and rng.random() < bad:
                    f.write(rng.choice(["\n", "no stamp,x,1\n", "a,b,c,d\n", ",,\n"]))
    return path


def reader(path, first=None, last=None, **kw):
    options = {"path": str(path), **({"from": first} if first else {}), **({"to": last} if last else {}), **kw}
    return sc.SortedCsvReader(sc.SortedCsv({"path": str(path)}).schema(), options)


def lines_of(r):
    return [tuple(row.values()) for part in r.partitions() for batch in r.read(part) for row in batch.to_pylist()]


def test_range_is_exact_for_every_day_and_split(tmp_path):
    rng = random.Random(3)
    path = write(tmp_path / "a.csv", 12, lambda k: rng.choice([0, 1, 3, 40]) if k else 5, rng, bad=0.1)
    rows = [tuple(line.split(",")) for line in path.read_text().splitlines()[1:] if line.startswith("2024") and line.count(",") == 2]
    for first, last in [(f"2024-01-{a:02d}", f"2024-01-{b:02d}") for a in range(1, 15) for b in range(a, 15)] + [(None, "2024-01-05"), ("2024-01-05", None), ("2023-01-01", "2023-12-31")]:
        want = [r for r in rows if (first or "") <= r[0][:10] <= (last or "9")]
        for split in ("7", "100", "1000000"):
            got = [r for r in lines_of(reader(path, first, last, split_bytes=split)) if r[0] and r[0].startswith("2024")]
            assert got == want, (first, last, split)


def test_one_day_of_a_hundred_reads_two_percent(tmp_path):
    path = write(tmp_path / "big.csv", 100, lambda k: 2000)
    r = reader(path, "2024-02-20", "2024-02-20")
    file = sc.sources(str(path))[0]
    start, end = r.day_range(file)
    assert path.read_bytes()[start:end].count(b"\n") == 2000 and path.read_bytes()[start:].startswith(b"2024-02-20 00:00:00,")
    assert file.probed + end - start < 0.02 * file.size and end - start < 0.0101 * file.size


def test_scan_of_a_folder(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}").mkdir()
        write(tmp_path / f"part{k}" / "bars.csv", 10 + k, lambda d: 50)
    (tmp_path / "empty.csv").write_text("timestamp,symbol,close\n")
    (tmp_path / "_SUCCESS").write_text("")
    out = sc.read_day_csv(spark, str(tmp_path), "2024-01-11", ["close"], ["symbol"], zone="Asia/Kolkata", split_bytes=300)
    rows = out.collect()
    assert len(rows) == 100 and out.rdd.getNumPartitions() > 5
    assert {str(r.ts)[:13] for r in rows} == {"2024-01-10 18"}  # local midnight
    assert sc.read_day_csv(spark, str(tmp_path), "2025-01-01", ["close"]).count() == 0
    with pytest.raises(Exception, match="NotFound|nowhere"):
        sc.scan_days(spark, str(tmp_path / "nowhere"), "2024-01-01", "2024-01-01").count()
