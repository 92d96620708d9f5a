"""Tables below the shared checkpoint folder."""

import os
from urllib.parse import urlparse

import pytest

from flagtide import session as S


def there(path):
    return os.path.isdir(urlparse(path).path)


def test_scratch_goes_but_for_what_is_kept(spark):
    with S.scratch(spark) as made:
        S.materialize(spark.range(5))
        path = S.store(spark.range(7))
        with S.scratch(spark) as inner:
            S.store(spark.range(2))
        made.keep(path)
        gone = list(made.paths)
        assert len(gone) == 1 and all(map(there, gone)) and not any(map(there, inner.paths))
    assert there(path) and not any(map(there, gone))
    assert spark.read.parquet(path).count() == 7
    S.delete(spark, path)
    assert not there(path)


def test_nothing_goes_after_an_error_or_without_a_block(spark):
    with pytest.raises(KeyError), S.scratch(spark) as made:
        S.store(spark.range(3))
        raise KeyError
    assert all(map(there, made.paths)) and made.paths
    assert S.materialize(spark.range(4)).count() == 4
