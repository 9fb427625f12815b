"""Costly steps that several branches of a query read are done once."""

import os
import tempfile

from veilspark.plans import masking
from veilspark.streaming import events as E


def test_vault_path_masks_once(spark, sf_dir, monkeypatch):
    asked = []
    real = masking.restore_from_vault
    monkeypatch.setattr(masking, "restore_from_vault", lambda texts, *rest: asked.append(texts) or real(texts, *rest))
    assert masking.vault_path(spark, sf_dir).first().n_different == 0
    # what is restored is read back: the patterns are not in its plan
    assert "regexp_replace" not in asked[0]._jdf.queryExecution().optimizedPlan().toString()


def test_a_batch_is_computed_once(spark):
    folder = tempfile.mkdtemp(prefix="batch-")
    path = os.path.join(folder, "rows")
    spark.range(10, numPartitions=1).write.parquet(path)
    count = spark.sparkContext.accumulator(0)

    def seen(rows):
        for batch in rows:
            count.add(batch.num_rows)
            yield batch

    stream = E.read_stream(spark, path, "id long").mapInArrow(seen, "id long")
    out = E.run_to_end(stream, spark, "batch", transform=lambda b: b.join(b.selectExpr("id", "id + 1 as n"), "id"))
    assert sorted(map(tuple, out.select("id", "n").collect())) == [(i, i + 1) for i in range(10)]
    assert count.value == 10
