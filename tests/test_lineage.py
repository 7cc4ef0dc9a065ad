"""Scratch scopes: each owns what its thread makes inside it."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from millrace.functions.lineage import Scratch, discard, written


def there(df):
    return Path(df._scratch_path.removeprefix("file://").removeprefix("file:")).exists()


def test_scopes_of_threads_do_not_meet(spark):
    outside = written(spark.range(3), "outside")

    def job(n):
        with Scratch(spark) as own:
            mine = written(spark.range(n), "mine")
            with Scratch(spark) as inner:
                deeper = written(spark.range(n), "deeper")
        after = written(spark.range(n), "after")
        return own, inner, mine, deeper, after

    with ThreadPoolExecutor(2) as pool:
        first, second = pool.map(job, (4, 5))
    first[0].delete()
    assert [there(x) for x in (first[2], first[3], first[4], *second[2:], outside)] == [False, True, True, True, True, True, True]
    second[1].delete()
    assert not there(second[3]) and second[2].count() == 5 and outside.count() == 3
    second[0].delete()
    second[0].delete()
    discard(outside, first[3], first[4], second[4], None)
    assert not any(there(x) for x in (outside, first[3], first[4], second[2], second[4]))
