"""Meetings of the sample store are brought down to a row each before they are dealt."""

from quorumlens.plans import sample


def test_meetings_are_summed_before_the_shuffle(spark):
    sample.forget(spark)
    u, _, met = sample.store(spark, "/root/testdata/sf0.001")
    assert "Repartition" not in met._jdf.queryExecution().logical().toString()
    assert sorted(map(str, met.collect())) == sorted(map(str, sample.meetings(u).collect()))
    sample.forget(spark)
