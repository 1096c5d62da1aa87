"""Best of N batch by batch against one batch."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import selection
from inkwell.sources import files
from inkwell.streaming.best_of_n import BestOfN

REWARDS = ["linguistic", "density"]


@pytest.fixture(scope="module")
def candidates(spark):
    """Ties in every record, null and NaN rewards, a record without anything within the gate, repeated rows."""
    i, nan = F.col("id"), F.lit(float("nan"))
    rows = spark.range(240).select(
        F.when(i % 40 == 39, F.lit(None)).otherwise(F.concat(F.lit("r"), (i % 11).cast("string"))).alias("record_id"), i.alias("i"), F.when(i % 7 == 3, nan).when(i % 13 != 5, (i * 37 % 10) / 10.0).alias("linguistic"),
        F.when(i % 17 != 2, (i * 53 % 8) / 10.0).alias("density"), (-(i % 3) / 10.0).alias("length_guard"), F.when(i % 11 == 4, 5).otherwise(i % 4).cast("int").alias("unsup"),
    )
    return rows.unionByName(rows.where("i < 30")).repartition(3).cache()


def rows(df):
    return sorted(map(str, df.select("record_id", "pick_linguistic", "pick_density", "pick_gated").collect()))


def test_any_split(spark, candidates):
    want = rows(selection.pick(candidates, REWARDS))
    for parts in (1, 2, 5):
        held = BestOfN(spark, files.folder(spark, "best"), REWARDS)
        assert held.picks() is None and held.batches() == set()
        for n in reversed(range(parts)):
            assert held.add(candidates.where(F.col("i") % parts == n), f"b{n}")
            if n % 2:
                held.compact()
        assert not held.add(candidates.where("false"), "b0")
        held.compact()
        assert rows(held.picks()) == want
        held.drop_replaced()
        again = BestOfN(spark, held.where, REWARDS)
        assert rows(again.picks()) == want and again.batches() == {f"b{n}" for n in range(parts)} and not again.add(candidates, "b0")
        assert len(files.names(spark, f"{held.where}/data")) == 1
    with pytest.raises(ValueError):
        held.add(candidates, "a/b")


def test_broken_off(spark, candidates, monkeypatch):
    """A batch whose data were written but not its marker counts for nothing, and is added whole later."""
    held = BestOfN(spark, files.folder(spark, "best"), REWARDS)
    held.add(candidates.where("i % 2 = 0"), "even")
    before = rows(held.picks())
    with monkeypatch.context() as m:
        m.setattr(files, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            held.add(candidates.where("i % 2 = 1"), "odd")
    assert rows(held.picks()) == before and held.batches() == {"even"}
    assert held.add(candidates.where("i % 2 = 1"), "odd")
    assert rows(held.picks()) == rows(selection.pick(candidates, REWARDS))


def test_stream_with_a_restart(spark, candidates, tmp_path):
    source, where, check = str(tmp_path / "in"), files.folder(spark, "best"), str(tmp_path / "check")
    for n in range(2):
        candidates.where(F.col("i") % 3 == n).coalesce(1).write.mode("append").parquet(source)
    read = lambda: spark.readStream.schema(candidates.schema).option("maxFilesPerTrigger", 1).parquet(source)
    BestOfN(spark, where, REWARDS).follow(read(), check).awaitTermination()
    candidates.where(F.col("i") % 3 == 2).coalesce(1).write.mode("append").parquet(source)
    held = BestOfN(spark, where, REWARDS)
    held.compact()
    held.follow(read(), check).awaitTermination()
    assert held.batches() == {"stream-0", "stream-1", "stream-2"} and rows(held.picks()) == rows(selection.pick(candidates, REWARDS))
