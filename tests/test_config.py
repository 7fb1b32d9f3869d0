import pytest

from corvane import config

COMMON = {
    "corpora": {"a": {"corpus_id": "a", "corpus_path": "a.xml", "default_modality": "web"}, "b": {"corpus_id": "b", "corpus_path": "b.xml"}},
    "balance": {"strategies": {"cap_docs": {"presets": {"p": {"cap_per_label": 3}}}}, "presets": {"q": {"alpha": 0.5}}},
    "hardware": {"presets": {"small": {"max_train_docs_sklearn": 10}, "lab": {"max_train_docs_sklearn": 20}}},
    "models": {"families": {"sklearn": {}}},
}


def test_cast():
    values = ["true", "None", "3", "2.5", "[]", "[a, 2]", '["x"]', "{'k': 1}", "word", "[1"]
    assert [config.cast(v) for v in values] == [True, None, 3, 2.5, [], ["a", 2], ["x"], {"k": 1}, "word", "[1"]
    assert config.cast(7) == 7 and config.cast(" ") == " "


def test_seed():
    assert [config.seed_of(x) for x in (None, "", "null", "7", 0, "x", 3.0)] == [42, 42, 42, 7, 0, 42, 3]
    assert config.seed_of("now") > 10**9


def test_override():
    out = config.override({"a": {"b": 1}}, ["a.b=2", "c.d=x", "families=check,sklearn"])
    assert out == {"a": {"b": 2}, "c": {"d": "x"}, "families": ["check", "sklearn"]}
    with pytest.raises(ValueError):
        config.override({}, ["nothing"])


def test_nested_and_legacy():
    profile = {"profile": "p", "corpora": ["a", "b"], "corpus_id": "a", "train": {"train_prop": 0.7, "seed": 5}}
    one = config.resolve(profile, COMMON)
    assert (one.train_prop, one.seed, [c.corpus_id for c in one.corpora], one.dataset_id) == (0.7, 5, ["a", "b"], "p")
    old = config.resolve(profile, COMMON, legacy=True)
    assert (old.train_prop, old.seed, old.dataset_id) == (0.8, 42, "a")


def test_presets_and_errors():
    p = config.resolve({"corpus_id": "a", "balance_mode": "oversample", "balance_preset": "p"}, COMMON, ["hardware_preset=lab"])
    assert (p.balance_strategy, p.preset, p.cap("sklearn")) == ("cap_docs", {"cap_per_label": 3}, 20)
    assert config.resolve({"corpus_id": "a", "balance_mode": "weights"}, COMMON).balance_strategy == "class_weights"
    for bad in ({"corpus_id": "zz"}, {}, {"corpus_id": "a", "surprise": 1}, {"corpus_id": "a", "seed": 1, "train": {"seed": 2}}, {"corpora": ["a"], "data": {"corpus_ids": ["b"]}}):
        with pytest.raises(ValueError):
            config.resolve(bad, COMMON)
