from revlens.session import BATCH_BYTES, ship


def test_batches_are_bounded_unless_set(spark):
    key, small, default = BATCH_BYTES
    ship(spark)
    assert spark.conf.get(key) in (small, "4194304b")
    spark.conf.set(key, "1m")
    try:
        ship(spark)
        assert spark.conf.get(key) in ("1m", "1048576b")
    finally:
        spark.conf.set(key, small)


def test_default_is_replaced(spark):
    key, small, _ = BATCH_BYTES
    spark.conf.unset(key)
    ship(spark)
    assert spark.conf.get(key) in (small, "4194304b")
