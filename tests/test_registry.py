"""Models by rank: the right family, nothing trained twice, half a model is no model, missing ones are errors."""

import numpy as np
import pytest

from kmerflow.operators import classify, registry


def test_chain_of_ranks(spark, tmp_path):
    rng = np.random.default_rng(1)
    label = lambda i: ("Bacteria", "g" + "ab"[i % 2]) if i % 3 else ("host", None)
    x = rng.poisson(1, (60, 5)) + np.array([[6 * (i % 3 == 0), 0, 0, 5 * (i % 2), 5 * (1 - i % 2)] for i in range(60)])
    long = spark.createDataFrame([(i, f"k{j}", float(x[i, j])) for i in range(60) for j in range(5) if x[i, j]], "id long, kmer string, value double")
    classes = spark.createDataFrame([(i, *label(i)) for i in range(60)], "id long, domain string, genus string")
    models = registry.RankModels(spark, str(tmp_path / "m"))
    assert (models.family("domain"), models.family("host"), models.family("genus")) == ("linear", "linear", "mnb")
    with pytest.raises(FileNotFoundError, match="genus"):
        models.load(["genus"])
    assert models.fit(["domain", "genus"], long, classes, 5, domain={"rounds": 30, "rate": 0.5}) == ["domain", "genus"]
    assert models.fit(["domain", "genus"], long, classes, 5) == []
    out = classify.top_down(long.select("id").distinct(), ["domain", "genus"], models.scorers(["domain", "genus"], long), 0.5)
    got = {(r["id"], r["rank"]): r["label"] for r in out.collect()}
    assert np.mean([got[i, "domain"] == label(i)[0] for i in range(60)]) > 0.9
    assert np.mean([got[i, "genus"] == label(i)[1] for i in range(60) if i % 3]) > 0.9
    before = sorted(map(tuple, models.load(["genus"])["genus"].predict(long).collect()))
    (tmp_path / "m" / "mnb_genus" / "note" / "_SUCCESS").unlink()  # as if the session had ended in between
    assert models.missing(["domain", "genus"]) == ["genus"] and models.fit(["domain", "genus"], long, classes, 5) == ["genus"]
    assert sorted(map(tuple, models.load(["genus"])["genus"].predict(long).collect())) == before
    with pytest.raises(ValueError):
        registry.RankModels(spark, "x", binary="none")
