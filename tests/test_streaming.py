from pyspark.sql import functions as F

from satloom.operators import decompose as D
from satloom.streaming import streams as T


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    rows = [(0, "a", "ACGT" * 6), (1, "b", "ACGTT" * 8)]
    spark.createDataFrame(rows, T.SCHEMA).write.parquet(str(tmp_path / "in"))
    arrays = T.read_array_stream(spark, str(tmp_path / "in"))
    done = run(T.decompose_stream(arrays), "done", "append")
    assert {r["array_ord"]: r["pieces"] for r in done.collect()} == {i: D.decompose_text(s, compat=False)[3] for i, _, s in rows}
    counts = run(T.monomer_stream(T.decompose_stream(arrays)), "counts", "complete")
    assert counts.agg(F.sum(F.col("n") * F.col("length"))).first()[0] == sum(len(s) for *_, s in rows)
