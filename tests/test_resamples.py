import inspect

from corpusmill.operators import inference
from corpusmill.plans import registry


def test_bootstrap_queries_use_the_frozen_number_of_draws(spark, monkeypatch):
    seen = {}

    def spy(name):
        whole = getattr(inference, name)
        signature = inspect.signature(whole)

        def call(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            seen.setdefault(name, []).extend(v for k, v in bound.arguments.items() if "resamples" in k)
            return whole(*args, **kwargs)

        return call

    for name in ("paired_bootstrap", "pairwise_comparisons"):
        monkeypatch.setattr(inference, name, spy(name))
    registry.QUERIES["inference_bootstrap"](spark, "/root/testdata/sf0.001")
    registry.QUERIES["inference_pairwise"](spark, "/root/testdata/sf0.001")
    assert set(seen) == {"paired_bootstrap", "pairwise_comparisons"} and {v for each in seen.values() for v in each} == {10_000}
