"""Training of the toxicity model: equal to a plain computation, and no table of all buckets passes through the driver."""

import random
import tracemalloc

import numpy as np

from lonja.llm import toxicity


def test_model_and_what_the_driver_holds(spark):
    r = random.Random(3)
    rows = [(i, " ".join([f"w{r.randrange(900)}" for _ in range(30)] + ["idiot"] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(240)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    used = {x["doc_id"] for x in labels.where(toxicity.fold("doc_id") != toxicity.HELD_OUT).collect()}

    tracemalloc.start()
    model = toxicity.train(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6  # the weights are 4 MB

    sample = sorted((y, toxicity._present(t).astype("<i4").tobytes()) for k, t, y in rows if k in used)
    held, y = [np.frombuffer(x, "<i4") for _, x in sample], np.array([y for y, _ in sample])
    total = np.zeros((2, 1 << toxicity.BITS), np.int64)
    for label, x in zip(y, held):
        total[label][x] += 1
    n = np.bincount(y)
    p, q, share = (total[1] + 1) / (n[1] + 2), (total[0] + 1) / (n[0] + 2), total.sum(0) / n.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1]))
    best = np.flatnonzero(np.abs(total[1] / n[1] - total[0] / n[0]) / error >= toxicity.SIGNIFICANT)
    ratio = (np.log(p / q) - np.log((1 - p) / (1 - q)))[best]
    w, b = toxicity._fit([np.searchsorted(best, x[np.isin(x, best)]) for x in held], y.astype(float), ratio)
    assert len(best) > 5 and set(np.flatnonzero(model["weights"])) <= set(best)
    assert np.allclose(model["weights"][best], w, rtol=1e-4, atol=1e-6) and abs(model["bias"] - b) < 1e-6
