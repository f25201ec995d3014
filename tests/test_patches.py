"""Connected patches that span many tiles."""

from groundshift.operators import focal


def test_snake_is_one_patch(spark):
    """A winding patch of 121 tiles, longer than the 64 rounds that once ended the search."""
    cells = [(r, c) for r in range(0, 22, 2) for c in range(22)]
    cells += [(r + 1, 21 if r % 4 == 0 else 0) for r in range(0, 20, 2)]
    df = spark.createDataFrame([(r, c, 1) for r, c in cells], "row int, col int, class_id int")
    tiles = {(r // 2, c // 2) for r, c in cells}
    assert len(tiles) > 64
    assert {r["label"] for r in focal.component_labels(df, tile=2).collect()} == {0}
