"""What a task holds, and what the driver is sent, doesn't grow with batches and partitions."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from featurelab.operators import merging, shape


def test_images_are_read_few_at_once(spark):
    rng = np.random.default_rng(1)
    some = [rng.random(784).round(2).tolist() for _ in range(7)]
    images = spark.createDataFrame([(i, some[i % 7]) for i in range(600)], "image_id int, pixels array<double>").coalesce(1)
    seen = shape._by_images("int", lambda a: pa.array(np.full(len(a), len(a), dtype=np.int32)))
    assert {r[0] for r in images.select(seen(F.col("pixels"))).collect()} == {256, 88}
    for read in (shape.hog, shape.shapes):
        rows = {r.image_id: tuple(r)[1:] for r in read(images).collect()}
        assert len(rows) == 600 and all(rows[i] == rows[i % 7] for i in rows)
    assert shape.shapes(images.limit(0)).count() == 0


def test_the_driver_is_sent_one_state(spark, monkeypatch):
    sent = []
    loads = merging.pickle.loads
    monkeypatch.setattr(merging.pickle, "loads", lambda b: sent.append(len(b)) or loads(b))
    for parts in (1, 5, 40):
        sent.clear()
        rows = spark.range(1000).repartition(parts)
        assert merging.merged(rows, lambda b: b.num_rows, lambda a, b: a + b, tasks=parts) == 1000 and len(sent) == 1
