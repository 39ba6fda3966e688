from types import SimpleNamespace

from riskweir.models import search as tune
from riskweir.plans import learned


def test_registered_queries_use_the_published_numbers(monkeypatch):
    seen, held = [], []
    monkeypatch.setattr(learned.tb, "split_merchants", lambda *_: None)
    monkeypatch.setattr(learned, "part", lambda *_: None)
    monkeypatch.setattr(learned.modeling, "run_tuning", lambda parts, **settings: seen.append(settings) or SimpleNamespace(final=None))
    learned.final_evaluation(None, "")
    assert seen == [{"trials": dict.fromkeys(learned.MODELS, 40)}]  # rounds and search ranges are the library's
    monkeypatch.setattr(tune, "make_folds", lambda *_: [])
    monkeypatch.setattr(tune, "search", lambda name, folds, trials, **settings: held.append((trials, settings)))
    monkeypatch.setattr(tune, "trials_table", lambda *_: None)
    monkeypatch.setattr(learned.compare, "running_best", lambda _: None)
    learned.param_search(None, "")
    assert held == [(40, {})] * len(learned.MODELS)
    assert learned.ROUNDS == learned.CONFIG["parameters"]["rounds"] == 300
