"""Where a registered query keeps to the reference or the text and its DuckDB SQL does not."""

from __future__ import annotations

from groundshift.operators import raster, text


def test_a_band_with_equal_percentiles_is_zero(spark):
    """As the reference's preview: zeros unless the 98th percentile exceeds the 2nd, outliers included; null stays null."""
    rows = [(i, 0.07) for i in range(200)] + [(200, 0.06), (201, 0.08), (202, None)]
    got = {r.i: r.stretched for r in raster.percentile_stretch(spark.createDataFrame(rows, "i int, v double"), "v").collect()}
    assert got == {i: 0.0 for i in range(202)} | {202: None}


def test_tokens_of_large_numbers_are_whole(spark):
    """Each token stands in the text and its number is what it says, also above 1,999."""
    df = spark.createDataFrame([(1, "share 2,499 of all."), (2, "share 91,499 of all."), (3, "share 1,001,000 of all.")], "id long, t string")
    got = [(r.id, r.token, r.number) for r in text.number_tokens(df, "id", "t").orderBy("id").collect()]
    assert got == [(1, "2,499", "2499"), (2, "91,499", "91499"), (3, "1,001,000", "1001000")]
